"""WARC archives: written with their index, read back by coalesced byte ranges.

Writing: pages with equal payloads (compared by length, SHA-1 and SHA-256) of at least `least` bytes are grouped; the
largest page_id's record is the response and carries the payload, the others are revisit records of headers alone.
A task writes its records, each a gzip member of its own, to a file of its own in the shared folder and gives Spark the
index rows: file, offset, length, url, digest, page_id, record type. Spark commits the index as a table, so that a lost or repeated
task leaves at most a file that no index row names.

Reading: the selected index rows are ordered by file and offset, neighbours at most `gap` bytes apart are joined to
ranges of at most `most` bytes, and each range is read at once and cut into its records.

Files are written and read through pyarrow's file systems. Where the folder's scheme is not one of RANGE_SCHEMES, Spark's
text writer makes the archives instead (CRLF CRLF as line separator makes its part files plain WARC), whole part files
are read by Spark, and the same kind of index is made by walking over them.

Memory: one range, or one record, per task. Defined cases: a null html is an empty payload; a null url leaves out the target
URI; rows that repeat a page_id and payload are records of their own, of which one is the response; a null page_id loses to any
other and is written as empty; an empty table gives an empty archive and result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import cut, drop, shared_folder

END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
RANGE_SCHEMES = {"", "file", "hdfs", "s3", "gs"}
GAP, MOST = 64 * 1024, 8 * 1024 * 1024
#: Archive bytes that a reading task takes, about.
TASK_BYTES = 16 * 1024 * 1024
#: Bytes after which a task begins another archive, and the effort of compression.
ROLL, LEVEL = 1 << 30, 6
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
INDEX = "file string, offset long, length long, url string, digest string, page_id string, record_type string, refers_to string"


def base32(hex_digest: Column) -> Column:
    """A SHA-1 in hex as base32: five hex digits are four letters."""
    letters = []
    for k in range(0, 40, 5):
        n = F.conv(F.substring(hex_digest, k + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _rows(found: list) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])


def _header(*lines: Column) -> Column:
    return F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("\r\n"))


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str = "url", least: int = 0) -> DataFrame:
    """One row per page: its record (value) without the closing CRLF CRLF, and url, digest, page_id, record_type, refers_to."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    sha1 = F.sha1(html)
    rows = pages.select(
        F.col(id_col).alias("id"),
        F.regexp_replace(F.col(url_col).cast("string"), r"[\x00-\x20\x7f]", "%20").alias("url"),
        F.octet_length(html).cast("long").alias("bytes"),
        base32(sha1).alias("digest"),
        F.sha2(html, 256).alias("content"),
        html.alias("html"),
    )
    keys = ["bytes", "digest", "content"]
    # narrow rows only: which record of a payload carries it
    narrow = cut(rows.drop("html"))
    place = F.struct(F.col("id").isNotNull().alias("named"), F.col("id").alias("id"), F.coalesce("url", F.lit("")).alias("url"))
    kept = narrow.where(F.col("bytes") >= least).groupBy(*keys).agg(F.max(place).alias("keep"), F.max("id").alias("top"))
    same = F.coalesce(F.col("id"), F.lit(0).cast(pages.schema[id_col].dataType)).alias("same")
    judged = narrow.join(kept, keys, "left").withColumn("first", F.col("keep").isNull() | place.eqNullSafe(F.col("keep")))
    # rows equal in everything are told apart by a number; only those of the kept id meet here
    number = Window.partitionBy("digest", "content", same, F.coalesce("url", F.lit(""))).orderBy("bytes")
    firsts = judged.where("first").withColumn("n", F.row_number().over(number)).withColumn("response", F.col("keep").isNull() | (F.col("n") == 1))
    revisits = judged.where(~F.col("first")).select("id", "url", "bytes", "digest", "top")
    revisits = revisits.unionByName(firsts.where(~F.col("response")).select("id", "url", "bytes", "digest", "top"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    record = lambda c: F.concat(F.lit("<urn:page:"), text(c), F.lit(">"))
    about = lambda kind, refers: ["url", "digest", text("id").alias("page_id"), F.lit(kind).alias("record_type"), refers.alias("refers_to")]
    common = [_line("WARC-Record-ID", record("id")), _line("WARC-Date", F.lit(DATE)), _line("WARC-Target-URI", F.col("url"))]
    digest = _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    size = _line("X-Payload-Length", F.col("bytes").cast("string"))
    headers = F.concat(F.lit(HTTP), F.col("bytes").cast("string"), F.lit(END))
    again = revisits.select(
        _header(
            _line("WARC-Type", F.lit("revisit")), *common, digest, size,
            _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            _line("WARC-Refers-To", record("top")), _line("Content-Type", F.lit("application/http;msgtype=response")),
            _line("Content-Length", F.octet_length(headers).cast("string")),
        ).alias("head"), headers.alias("body"), *about("revisit", text("top")),
    )
    # the payloads: one html per response, joined on the row's own identity, which has no hot key
    whole = rows.select("id", "url", *keys, "html")
    if not firsts.where("n > 1").isEmpty():  # rows that are equal in everything
        whole = whole.dropDuplicates(["id", "url", *keys])
    chosen = firsts.where("response").groupBy(F.col("id").alias("r_id"), F.col("url").alias("r_url"), *[F.col(k).alias(f"r_{k}") for k in keys]).agg(F.count("*").alias("r_times"))
    match = whole["id"].eqNullSafe(chosen["r_id"]) & whole["url"].eqNullSafe(chosen["r_url"])
    for k in keys:
        match = match & (whole[k] == chosen[f"r_{k}"])
    full = chosen.join(whole, match).withColumn("r_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("r_times")))).select(
        _header(
            _line("WARC-Type", F.lit("response")), *common, digest, size, _line("Content-Type", F.lit("application/http;msgtype=response")),
            _line("Content-Length", (F.octet_length(headers) + F.col("bytes")).cast("string")),
        ).alias("head"), F.concat(headers, F.col("html")).alias("body"), *about("response", F.lit(None).cast("string")),
    )
    both = full.unionByName(again)
    return both.select(F.concat("head", "body").alias("value"), "url", "digest", "page_id", "record_type", "refers_to")


def write(pages: DataFrame, folder: str, html_col: str = "html", id_col: str = "page_id", url_col: str = "url", least: int = 0) -> None:
    """Write folder/archive and folder/index."""
    spark, rows = pages.sparkSession, records(pages, html_col, id_col, url_col, least)
    if not by_ranges(folder):
        rows.select("value").write.option("lineSep", END).text(f"{folder}/archive")
        walked(spark, f"{folder}/archive").write.parquet(f"{folder}/index")
        return
    archive = _uri(f"{folder}/archive")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(archive)
        file, path, at = None, "", 0
        for batch in batches:
            found = []
            for value, *about in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file is None or at > ROLL:
                    if file is not None:
                        file.close()
                    system.create_dir(inner, recursive=True)
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    file, path, at = system.open_output_stream(f"{inner}/{name}", compression=None), f"{archive}/{name}", 0
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = packer.compress(value + END.encode()) + packer.flush()
                file.write(member)
                found.append((path, at, len(member), *about))
                at += len(member)
            if found:
                file.flush()
                yield _rows(found)
        if file is not None:
            file.close()

    packed = rows.select(F.col("value").cast("binary").alias("value"), "url", "digest", "page_id", "record_type", "refers_to")
    packed.mapInArrow(task, INDEX).write.parquet(f"{folder}/index")


def _records(blob: bytes, at: int = 0) -> Iterator[tuple[int, int, dict, int]]:
    """Offset, length (with the closing CRLF CRLF), headers and where the block begins, of every whole record in blob."""
    while at < len(blob):
        head = blob.find(b"\r\n\r\n", at)
        if head < 0:
            return
        fields = {}
        for line in blob[at:head].split(b"\r\n")[1:]:
            name, _, value = line.partition(b": ")
            fields[name.decode()] = value.decode()
        block = head + 4
        end = block + int(fields["Content-Length"]) + 4
        if end > len(blob):
            return
        yield at, end - at, fields, block
        at = end


def _described(fields: dict) -> tuple:
    bare = lambda v: v[len("<urn:page:") : -1] if v else None
    return fields.get("WARC-Target-URI"), fields["WARC-Payload-Digest"][5:], bare(fields["WARC-Record-ID"]), fields["WARC-Type"], bare(fields.get("WARC-Refers-To"))


def _opened(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _uri(path: str) -> str:
    """Hadoop writes file:/x where others read file:///x."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def by_ranges(folder: str) -> bool:
    return urlparse(folder).scheme in RANGE_SCHEMES


def index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/index")


def walked(spark: SparkSession, archive: str) -> DataFrame:
    """The index of plain archives, from header to header of whole part files."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if found := [(path, o, n, *_described(f)) for o, n, f, _ in _records(blob.as_py())]:
                    yield _rows(found)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(archive).select("path", "content").mapInArrow(walk, INDEX)


def coalesced(selected: DataFrame, gap: int = GAP, most: int = MOST) -> DataFrame:
    """Index rows -> file, start, stop, records: ranges of neighbours, none longer than most unless one record is."""
    order = Window.partitionBy("file").orderBy("offset")
    apart = F.coalesce(F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(order) > gap, F.lit(True))
    block = F.floor(F.col("offset") / most)
    new = apart | ~block.eqNullSafe(F.lag(block).over(order))
    islands = selected.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(order))
    record = F.struct("offset", "length")
    return islands.groupBy("file", "island").agg(
        F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"), F.array_sort(F.collect_list(record)).alias("records")
    )


def read_tasks(ranges: DataFrame) -> int:
    """Tasks that read the ranges: by their bytes, and as many as run at once where there are ranges enough."""
    count, size = ranges.agg(F.count("*"), F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0))).first()
    return max(1, math.ceil(size / TASK_BYTES), min(count, ranges.sparkSession.sparkContext.defaultParallelism))


def read(spark: SparkSession, selected: DataFrame, folder: str, id_type: str = "bigint", with_payload: bool = False, gap: int = GAP, most: int = MOST) -> DataFrame:
    """Records of the selected index rows: page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload].

    A response's size and digest are computed from the payload that was read and must agree with its headers.
    """

    def cut_out(blob: bytes, at: int, length: int) -> tuple:
        record = blob[at : at + length]
        record = zlib.decompress(record, 31) if record[:2] == b"\x1f\x8b" else record
        _, _, fields, block = next(_records(record))
        url, digest, page, kind, refers = _described(fields)
        size, payload = int(fields["X-Payload-Length"]), None
        if kind == "response":
            body = record[block : block + int(fields["Content-Length"])]
            payload = body[body.index(b"\r\n\r\n") + 4 :]
            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != size:
                raise ValueError(f"the payload of page {page} does not agree with its digest")
        return page, url, size, digest, kind, refers, payload if with_payload else None

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def batch_of(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _opened(row["file"]) as file:
                    blob = file.read_at(row["stop"] - row["start"], row["start"])
                yield batch_of([cut_out(blob, r["offset"] - row["start"], r["length"]) for r in row["records"]])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield batch_of([cut_out(row["content"], r["offset"], r["length"]) for r in row["records"]])

    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"
    joined = coalesced(selected, gap, most)
    if by_ranges(folder):
        joined = cut(joined.select("file", "start", "stop", "records"))
        made = joined.repartition(read_tasks(joined), F.col("file"), F.col("start")).mapInArrow(ranges, schema)
    else:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/archive")
        made = files.join(joined, files.path == joined.file).select("content", "records").mapInArrow(whole, schema)
    typed = made.select(
        F.expr(f"try_cast(page_id AS {id_type})").alias("page_id"), "url", "payload_bytes", "payload_digest", "record_type", F.expr(f"try_cast(refers_to AS {id_type})").alias("refers_to"), "payload"
    )
    return typed if with_payload else typed.drop("payload")


def round_trip(pages: DataFrame, least: int = 0, folder: str | None = None, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Write the archives and their index, then read every record back.

    Without a folder they go to one in the shared folder, which is removed once the rows are checkpointed; a given folder
    stays.
    """
    spark = pages.sparkSession
    place = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, place, html_col, id_col, url_col, least)
    rows = read(spark, index(spark, place), place, pages.schema[id_col].dataType.simpleString())
    if folder is None:
        rows = cut(rows)
        drop(spark, place)
    return rows
