import os
import random

import pytest

import corpus_pipeline
from tidemark.llm import exact_dedup, line_quality, packing, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
        if name != "packing":
            assert docs.columns == before.columns
    good = {r.doc_id for r in line_quality.score(spark.read.parquet(f"{SF}/documents.parquet"), labels).where("predicted = 1").collect()}
    assert kept["quality"] == good
    whole = spark.read.parquet(str(tmp_path / "quality"))
    assert kept["exact_dedup"] == {r.doc_id for r in exact_dedup.exact_groups(whole).where("kept").collect()}
    assert kept["near_dedup"] <= kept["exact_dedup"] and kept["mixing"] <= kept["near_dedup"] and kept["packing"] == kept["mixing"]
    mixed = spark.read.parquet(str(tmp_path / "mixing"))
    want = packing.pack(mixed, queries.tokenizer_path())
    assert docs.agg({"length": "sum"}).first()[0] == want.agg({"length": "sum"}).first()[0]


def made(spark, folder, rows):
    """A folder of documents, with extra columns whose names the stages use themselves, and labels."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, copy int, key string, fp int, score int, label int, raw int, hash int, `__mix_mean` int"
    spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "k", 2, 3, 4, 5, 6, 7) for i, t, s in rows], schema).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 0 if (t or "").count("!!") > 3 else 1) for i, t, _ in rows if t and i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def corpus():
    rng = random.Random(6)
    good = lambda: "\n".join(" ".join(rng.choice("the of and a in to it is was on".split()) + f" w{rng.randrange(900)}" for _ in range(20)).capitalize() + "." for _ in range(4))
    rows = [(k, good(), "s1" if k % 3 else None) for k in range(90)]
    rows += [(100 + k, "\n".join(" ".join(f"W{rng.randrange(400)}!!" for _ in range(30)) for _ in range(3)), "s1") for k in range(30)]
    rows += [(200 + k, rows[k][1], "s2") for k in range(10)]  # exact copies
    rows += [(300 + k, rows[k][1].replace(".", ". ", 1) + " end", "s2") for k in range(10, 20)]  # near copies
    return rows + [(400, None, "s1"), (401, "", None), (None, good(), "s1"), (5, rows[5][1], "s1"), (402, "long word " * 4000, "s1")]


def test_stages_over_awkward_rows(spark, tmp_path):
    folder = made(spark, tmp_path / "in", corpus())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        assert name == "packing" or out.columns == docs.columns
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    clean = set(range(90))
    assert clean <= set(kept["quality"]) and not set(range(100, 130)) & set(kept["quality"])
    assert not set(range(200, 210)) & set(kept["exact_dedup"]) and clean - set(range(10)) <= set(kept["exact_dedup"])
    # brute force over what the stage was given: one document of every group of 5-word Jaccard similarity 0.8 or more stays
    given = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "exact_dedup")).collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in given.items() for w in [(t or "").encode().lower().split()]}
    group = {i: i for i in sets}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(sets, key=lambda i: (i is None, i))
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                group[top(i)] = top(j)
    assert sorted(kept["near_dedup"], key=str) == sorted({top(i) for i in ids}, key=str)
    assert set(kept["packing"]) == set(kept["mixing"])


def test_an_empty_table(spark, tmp_path):
    folder = made(spark, tmp_path / "in", [])
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_run_gives_pieces(spark):
    if os.path.isdir(SF):
        assert corpus_pipeline.run(spark, SF).count() > 0
