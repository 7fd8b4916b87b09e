import os
import zlib

import numpy as np
import pytest
from tidemark.llm import packing
from tidemark.llm.queries import tokenizer_path
from tests.llm.helpers import AWKWARD, documents


def test_round_trip_and_padding(spark):
    texts = AWKWARD + ["mark <|endoftext|> in text", "it's 12 o'clock\n\n  ok  "] + [f"line {k} " * (k % 90) for k in range(300)]
    rows = packing.pack(documents(spark, texts).repartition(3), tokenizer_path()).toPandas()
    check(rows, texts)
    assert packing.pack(documents(spark, ["a"]).where("false"), tokenizer_path()).count() == 0


def test_levels_grow_least():
    """Each piece goes where the sum of squares of the level array is least, by trying them all."""
    packer, rng = packing.Packer(32), np.random.default_rng(2)
    for doc in range(400):
        n = int(rng.integers(1, 32))
        before = packer.levels.copy()
        packer.place(doc, n)
        best = None
        for h in range(32 - n + 1):
            if h and not before[h]:
                continue
            after = before.copy()
            after[h] -= 1 if h else 0
            if h + n < 32:
                after[h + n] += 1
            cost = int((after**2).sum())
            best = cost if best is None else min(best, cost)
        assert int((packer.levels**2).sum()) == best


@pytest.mark.parametrize("words", [[600], [3, 40, 700, 1000, 1023, 1024, 2500]])
def test_many_levels(spark, words):
    """Pieces of many tasks; with one length alone no two pieces fit into a window."""
    texts = ["a" + " a" * (words[k % len(words)] - 1) for k in range(120)]
    rows = packing.pack(documents(spark, texts).repartition(5), tokenizer_path(), pieces=10).toPandas()
    check(rows, texts)


def check(rows, texts, window=1024):
    """Every id in exactly one piece, no gaps and no padding."""
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokenizer_path()).encode
    ids = {i: np.array([*encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for i, t in enumerate(texts)}
    for r in rows.itertuples():
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    for i, parts in rows.sort_values("start").groupby("doc_id"):
        assert list(parts.start) == [0, *np.cumsum(parts.length)[:-1]] and parts.length.sum() == len(ids[i])
    assert set(rows.doc_id) == set(ids)
    filled = []
    for _, parts in rows.sort_values("offset").groupby("sequence_id"):
        assert list(parts.offset) == [0, *np.cumsum(parts.length)[:-1]]
        filled.append(int(parts.length.sum()))
    assert max(filled) <= window and sum(0 if n & (n - 1) == 0 else window - n for n in filled) == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the given tables")
def test_the_level_array_fills_most_windows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(32)
    rows = packing.pack(docs, tokenizer_path()).toPandas()
    assert rows.length.sum() == rows.drop_duplicates("doc_id").doc_tokens.sum() and rows.doc_id.nunique() == docs.count()
    online = rows[~((rows.length == 1024) & (rows.start % 1024 == 0) & (rows.offset == 0))]
    uncut = (online.start % 1024 == 0) & (online.start + online.length == online.doc_tokens)
    per_window = uncut.groupby(online.sequence_id).all()
    full = online.groupby("sequence_id").length.sum() == 1024
    filled = online[online.sequence_id.isin(per_window.index[per_window & full])].length.sum()
    assert filled >= 0.8 * online.length.sum()


def test_rows_that_repeat_and_nulls(spark):
    rows = [(1, "a b c " * 200)] * 30 + [(1, "other"), (None, "x y " * 300), (None, "x y " * 300), (2, None)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, hash int, seq int")
    got = packing.pack(df, tokenizer_path(), pieces=7).toPandas()
    assert (got[got.start == 0].doc_id.isna().sum(), (got[got.start == 0].doc_id == 1).sum()) == (2, 31)
    assert got.groupby("sequence_id").length.sum().max() <= 1024
    totals = got.drop_duplicates(["sequence_id", "offset"]).length.sum()
    assert totals == sum(len(x) for x in packing.encoder(tokenizer_path(), 0)([t or "" for _, t in rows]))


@pytest.mark.parametrize("text", ["", " ", "a  b", "　x\u0085y", "é‍🇫🇷", "<|endoftext|><|endoftext|> a", "1234 ١٢٣ Ⅷ"])
def test_fast_encoder_agrees(text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids
    assert packing.encoder(tokenizer_path(), 0)([text])[0].tolist() == [*want, 0]


def test_long_white_space_has_the_librarys_ids(spark):
    from tokenizers import Tokenizer

    library, encode = Tokenizer.from_file(tokenizer_path()), packing.encoder(tokenizer_path(), 0)
    runs = [" " * 2_000_000, "\n" * 2_000_000, "\t \r\n\x0b" * 100_000, "\u2003" * 30_000]
    texts = [*runs, f"a{runs[1]}b", f"end {runs[0]}", "x" * 12_000, " " * packing.RUN, "a" + " " * (packing.RUN + 1)]
    for text, ids in zip(texts, encode(texts), strict=True):
        assert ids.tolist() == [*library.encode(text, add_special_tokens=False).ids, 0]
    near = [" " * k + "a" for k in (1, 2, 3, 50, packing.RUN - 1)] + ["a\n \n" + " " * 7 + "<|endoftext|> " + "\n" * 9]
    for text, ids in zip(near, encode(near), strict=True):
        assert ids.tolist() == [*library.encode(text, add_special_tokens=False).ids, 0]
    rows = packing.pack(documents(spark, ["a", f"a{runs[1]}b"]), tokenizer_path()).toPandas()
    check(rows, ["a", f"a{runs[1]}b"])
