"""WARC archives: a writer with revisit records, and a reader that verifies the chain of records.

Writing. Rows with equal payloads (same SHA-1, same SHA-256) of at least `least_bytes` bytes share
one response, the row with the largest page_id; the others are revisit records that refer to it.
Records are lines of Spark's text writer whose line separator is the record terminator, so archives
go to any store that Spark can write to. Payloads are not shuffled while the table of repeated
payloads is small enough to be broadcast by its size on disk.

Reading. Spark's text reader cuts the files at every ``CR LF CR LF WARC/1.``, wherever a split
ends. That also cuts inside payloads that hold this string, so each cut is only a candidate. Tasks
emit for each candidate its offset and, from its Content-Length, its successor's. Inside a split
the chains are shortened to the first offset beyond the split; between splits pointer jumping from
the start of the file doubles the distance with each round; then each split marks the records that
its entry reaches. What is not reached was part of a payload. Reached records that were cut apart
are read once more and put together.

Defined cases: null html is an empty payload; a null page_id is written as such, and is a revisit
if the same payload has a page_id; rows with the same page_id and payload are all responses if that
page_id is the largest; null url has no target header; line breaks and blanks in an url are percent-encoded;
an empty table makes no records; other columns are ignored. A record that ends beyond its file is
left out, and what follows a record that has no successor is left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from equiweave.llm.shared import materialize

# Fixed values of the format.
MAGIC = "WARC/1."
BLANK = "\r\n\r\n"
CUT = BLANK + MAGIC
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def base32(hex_digest: Column) -> Column:
    """Base 32 of 40 hexadecimal digits: ten at a time make eight characters."""

    def part(k: int) -> Column:
        digits = F.lpad(F.conv(F.substring(hex_digest, 10 * k + 1, 10), 16, 32), 8, "0")
        return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)

    return F.concat(*map(part, range(4)))


def _named(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit(""))


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One string column: each page's record without its terminator."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"),
        F.sha1(payload).alias("sha1"), F.sha2(payload, 256).alias("sha256"), F.octet_length(payload).cast("long").alias("bytes"),
    )
    repeated = rows.where(F.col("bytes") >= least_bytes).groupBy("sha1", "sha256").agg(F.count("*").alias("n"), F.max("page_id").alias("last"))
    repeated = materialize(repeated.where("n > 1 and last is not null").select("sha1", "sha256", "last"), "warc-repeated")
    rows = rows.join(repeated, ["sha1", "sha256"], "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    url = F.replace(F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(" "), F.lit("%20"))
    return rows.select(
        F.concat(
            F.lit(f"{MAGIC}1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
            _header("WARC-Record-ID", _named(F.col("page_id"))),
            F.lit(f"\r\nWARC-Date: {DATE}"),
            _header("WARC-Target-URI", url),
            _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
            F.when(revisit, _header("WARC-Refers-To", _named(F.col("last")))).otherwise(""),
            F.when(revisit, _header("WARC-Profile", F.lit(PROFILE))).otherwise(""),
            F.when(revisit, _header("X-Payload-Length", F.col("bytes").cast("string"))).otherwise(""),
            F.lit("\r\nContent-Type: text/html; charset=utf-8"),
            _header("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
            F.lit(BLANK), F.when(revisit, "").otherwise(F.col("payload")),
        ).alias("value")
    )


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write pages as uncompressed archives into the folder `path`."""
    records(pages, least_bytes).write.option("lineSep", BLANK).text(path)


# ---------------------------------------------------------------- reading

_FIELD = re.compile(rb"\r\n([^:\r\n]+):[ \t]*([^\r\n]*)")
_KEY = ["file", "block", "local"]
_SEGMENT = "file string, block long, local long"
_CANDIDATE = f"{_SEGMENT}, first boolean, length long, span long, whole boolean, head long, body long, kind string, page_id long, refers_to long, declared string, declared_bytes long, digest string"


def _cut_files(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", CUT).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """file, block, the offset from where the block's first line starts, and the bytes of each line of a task."""
    now, at = None, 0
    for batch in batches:
        for file, block, value in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            if (file, block) != now:
                now, at = (file, block), 0
            yield file, block, at, value
            at += len(value) + len(CUT)


def _page(value: bytes | None) -> int | None:
    found = re.fullmatch(rb"<urn:x-page:(-?\d+)>", value or b"")
    return int(found[1]) if found else None


def _parse(first: bool, value: bytes) -> tuple:
    """span (bytes from the record's start to its successor's; null if there is no readable header), whether the
    payload lies in this piece whole, bytes before the payload, payload bytes, then what the header says."""
    if first and not value.startswith(MAGIC.encode()):
        return (None, False, 0, 0, None, None, None, None, None, None)
    lead = 0 if first else len(MAGIC)  # bytes of the record before this piece
    end = value.find(BLANK.encode())
    fields = {k.strip().lower(): v.strip() for k, v in _FIELD.findall(value[: max(end, 0)])}
    size = fields.get(b"content-length", b"")
    if end < 0 or not size.isdigit():
        return (None, False, 0, 0, None, None, None, None, None, None)
    head, body = end + len(BLANK), int(size)
    whole = head + body <= len(value)
    digest = base64.b32encode(hashlib.sha1(value[head : head + body]).digest()).decode() if whole else None
    text = fields.get(b"warc-payload-digest", b"").decode("utf-8", "replace").removeprefix("sha1:")
    length = fields.get(b"x-payload-length", b"")
    return (
        lead + head + body + len(BLANK), whole, head, body, fields.get(b"warc-type", b"").decode("utf-8", "replace"), _page(fields.get(b"warc-record-id")),
        _page(fields.get(b"warc-refers-to")), text, int(length) if length.isdigit() else None, digest,
    )


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Each piece between cuts with what its header says; local offsets."""
    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in _CANDIDATE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
            rows.clear()
            return out

        for file, block, local, value in _located(batches):
            first = block == 0 and local == 0
            rows.append((file, block, local, first, len(value), *_parse(first, value)))
            if len(rows) == 5000:
                yield flush()
        yield flush()

    return _cut_files(spark, path).mapInArrow(run, _CANDIDATE)


def _blocks(found: DataFrame) -> DataFrame:
    """file, block, base (file offset of the block's first line) and total (of the file, with one cut too many)."""
    sizes = found.groupBy("file", "block").agg(F.sum(F.col("length") + len(CUT)).alias("size"))
    order = Window.partitionBy("file").orderBy("block")
    return sizes.select(
        "file", "block",
        F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        (F.sum("size").over(Window.partitionBy("file")) - len(CUT)).alias("total"),
    )


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[n].to_numpy() for n in names]


def _shorten(table: pa.Table) -> pa.Table:
    """For each candidate of one block, the first offset beyond the block that its chain comes to."""
    table = table.sort_by("at")
    at, after = _columns(table, "at", "after")
    place = {int(a): i for i, a in enumerate(at)}
    leaves = after.copy()
    for i in range(len(at) - 1, -1, -1):  # successors lie behind
        j = place.get(int(after[i]))
        if j is not None and j > i:
            leaves[i] = leaves[j]
    return pa.table({"file": table["file"], "at": table["at"], "jump": pa.array(leaves)})


def pointer_jumping(jumps: DataFrame, starts: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(file, at) of all nodes of jumps (file, at, jump) that starts (file, at) reach, starts included.

    Each round adds what the reached nodes jump to and doubles every jump.
    """
    jumps, reached = materialize(jumps, "warc-jumps"), materialize(starts, "warc-reached")
    nodes, size = jumps.select("file", "at"), reached.count()
    for _ in range(most_rounds):
        more = reached.join(jumps, ["file", "at"]).select("file", F.col("jump").alias("at")).join(nodes, ["file", "at"], "left_semi")
        reached = materialize(reached.unionByName(more).distinct(), "warc-reached")
        if (now := reached.count()) == size:
            return reached
        size = now
        far = jumps.select("file", F.col("at").alias("jump"), F.col("jump").alias("far"))
        jumps = materialize(jumps.join(far, ["file", "jump"]).select("file", "at", F.col("far").alias("jump")), "warc-jumps")
    raise RuntimeError("the chains of records did not end")


def _mark(table: pa.Table) -> pa.Table:
    """The candidates of one block that its entries reach inside it."""
    table = table.sort_by("at")
    at, after, entry = _columns(table, "at", "after", "entry")
    good = entry.copy()
    place = {int(a): i for i, a in enumerate(at)}
    for i in range(len(at)):
        if good[i] and (j := place.get(int(after[i]))) is not None and j > i:
            good[j] = True
    return table.select(["file", "at"]).filter(pa.array(good))


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, file and offset of each record of the archives."""
    found = materialize(candidates(spark, path), "warc-candidates")
    blocks = materialize(_blocks(found), "warc-blocks")
    placed = found.join(blocks, ["file", "block"]).withColumn("begin", F.col("base") + F.col("local"))
    placed = placed.withColumn("at", F.when(F.col("first"), F.col("begin")).otherwise(F.col("begin") - len(MAGIC)))
    placed = materialize(placed.withColumn("after", F.col("at") + F.col("span")).drop("base", "length"), "warc-placed")
    ends = placed.where("after <= total").select("file", "block", "at", "after")
    jumps = ends.groupBy("file", "block").applyInArrow(_shorten, "file string, at long, jump long")
    entries = pointer_jumping(jumps, ends.where("at = 0").select("file", "at"))
    marked = ends.join(entries.withColumn("entry", F.lit(True)), ["file", "at"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    good = marked.groupBy("file", "block").applyInArrow(_mark, "file string, at long")
    whole = materialize(placed.join(good, ["file", "at"], "left_semi"), "warc-good")
    cut = whole.where("not whole")
    if not cut.isEmpty():
        whole = whole.where("whole").unionByName(whole.where("not whole").drop("digest").join(_rejoined(spark, path, placed, cut), ["file", "at"]))
    revisit = F.col("kind") == "revisit"
    return whole.select(
        "page_id",
        F.when(revisit, F.coalesce("declared_bytes", "body")).otherwise(F.col("body")).alias("payload_bytes"),
        F.when(revisit, F.col("declared")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.when(revisit, F.col("refers_to")).alias("refers_to"),
        "file", F.col("at").alias("offset"),
    )


def _rejoined(spark: SparkSession, path: str, placed: DataFrame, cut: DataFrame) -> DataFrame:
    """file, at and digest of the records that cuts inside their payloads took apart."""
    owners = cut.select("file", F.col("at").alias("owner"), F.col("after").alias("until"), "head", "body")
    files = owners.select("file").distinct()
    pieces = placed.join(files, "file", "left_semi").select(*_KEY, "at", "begin")
    start = owners.select("file", F.col("owner").alias("at"), F.struct("owner", "until", "head", "body").alias("of"))
    order = Window.partitionBy("file").orderBy("at")  # one file's offsets, no payloads
    owned = pieces.join(start, ["file", "at"], "left").withColumn("of", F.last("of", ignorenulls=True).over(order))
    owned = materialize(owned.where("begin < of.until").select(*_KEY, "begin", "of.*"), "warc-owned")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        located = _located(batches)
        while rows := list(islice(located, 64)):
            columns = zip(rows_of(rows), (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], [*_KEY, "value"])

    def rows_of(rows: list[tuple]) -> list[list]:
        return [list(c) for c in zip(*rows, strict=True)]

    parts = _cut_files(spark, path).mapInArrow(run, f"{_SEGMENT}, value binary").join(owned, _KEY)

    def digest(table: pa.Table) -> pa.Table:
        table = table.sort_by("begin")
        data = CUT.encode().join(table["value"].to_pylist())
        head, body = table["head"][0].as_py(), table["body"][0].as_py()
        value = base64.b32encode(hashlib.sha1(data[head : head + body]).digest()).decode()
        return pa.table({"file": [table["file"][0].as_py()], "at": [table["owner"][0].as_py()], "digest": [value]})

    return parts.groupBy("file", "owner").applyInArrow(digest, "file string, at long, digest string")
