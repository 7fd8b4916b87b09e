"""Small tables with every awkward case, and brute-force versions."""

from __future__ import annotations

import re

WHITE = re.compile("[\x20\x09-\x0D]")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, norm string, fp string, place int"


def documents(spark, texts, ids=None, source="s"):
    """Documents with extra columns whose names the operators use themselves."""
    rows = [(i, t, "en", source, len(t or ""), "x", "y", 1) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def words(text):
    return (text or "").encode().lower().split()


AWKWARD = [None, "", " ", "a", "A b", "a\tB", "a b c", "é x 𝒳", "word " * 3000, "a", None, "tie one", "tie  one", "x" * 5000]
