import base64
import gzip
import hashlib

from pyspark.sql import functions as F
from tidemark.llm import warc

ROWS = [(1, "u", "a"), (2, "u", "a"), (2, "u", "a"), (3, None, None), (4, "x\r\ny", ""), (None, "v", "a"), (5, "z", "b\r\n\r\nWARC/1.1\r\n"), (6, "é", "é𝒳"), (7, "q", "a\r\n\r\n"), (8, "w", "long " * 50_000)]


def expected(rows, least=0):
    groups = {}
    for i, _, h in rows:
        groups.setdefault(h or "", []).append(i)
    out = []
    for h, ids in groups.items():
        raw = h.encode()
        ids = sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)
        for k, i in enumerate(ids):
            again = k > 0 and len(raw) >= least
            out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=str)


def pages(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))


def test_round_trip(spark):
    for least in (0, 2):
        got = warc.round_trip(pages(spark), least).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(ROWS, least)
    assert warc.round_trip(pages(spark).where("false")).count() == 0


def test_selected_records_are_read_by_few_ranges(spark, tmp_path):
    rows = [(k, f"http://x/{k}", f"page {k} " * (k % 50)) for k in range(300)]
    folder = f"file://{tmp_path}"
    warc.write(pages(spark, rows).coalesce(1), folder)
    index = warc.index(spark, folder).cache()
    assert index.count() == 300
    for r in index.limit(20).collect():
        with open(r.file.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            record = gzip.decompress(f.read(r.length))
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
    chosen = index.where("CAST(page_id AS BIGINT) % 7 = 0")
    got = {r.page_id: r for r in warc.read(spark, chosen, folder, with_payload=True).collect()}
    assert set(got) == set(range(0, 300, 7))
    assert all(bytes(r.payload).decode() == rows[i][2] for i, r in got.items() if r.record_type == "response")
    assert warc.coalesced(chosen).count() <= index.select("file").distinct().count()
    assert warc.coalesced(chosen, gap=-1).count() == chosen.count()
    assert max(r.stop - r.start for r in warc.coalesced(index, most=2000).collect()) < 2000 + 1000


def test_archives_are_whole_gzip_files(spark, tmp_path):
    warc.write(pages(spark), f"file://{tmp_path}")
    blob = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "archive").glob("*.warc.gz"))
    found = [f["WARC-Type"] for _, _, f, _ in warc._records(blob)]
    assert len(found) == len(ROWS) and found.count("revisit") == 4


def test_read_tasks_grow_with_the_archive(spark):
    ranges = lambda n, size: spark.range(n).select(F.lit("f").alias("file"), (F.col("id") * size).alias("start"), ((F.col("id") + 1) * size).alias("stop"))
    assert warc.read_tasks(ranges(4000, 8 << 20)) == 2000
    assert warc.read_tasks(ranges(40, 1000)) == spark.sparkContext.defaultParallelism
    assert warc.read_tasks(ranges(2, 1000)) == 2 and warc.read_tasks(ranges(0, 1)) == 1


def test_many_ranges_are_read_by_many_tasks(spark, tmp_path):
    rows = [(k, f"http://x/{k}", f"page {k} " * 30) for k in range(200)]
    warc.write(pages(spark, rows).repartition(3), f"file://{tmp_path}")
    read = warc.read(spark, warc.index(spark, f"file://{tmp_path}"), f"file://{tmp_path}", most=1000)
    assert read.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and read.count() == 200


def test_plain_path_agrees(spark, tmp_path, monkeypatch):
    ranged = warc.round_trip(pages(spark), folder=f"file://{tmp_path}/a")
    ranged = sorted(map(str, ranged.collect()))
    monkeypatch.setattr(warc, "RANGE_SCHEMES", set())
    assert sorted(map(str, warc.round_trip(pages(spark), folder=f"file://{tmp_path}/b").collect())) == ranged
