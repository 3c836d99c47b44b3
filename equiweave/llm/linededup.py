"""Line dedup with content-defined chunks of lines.

Every MIN_LINES lines with a word that follow each other, and the lines without a word between
them, are a chunk; it begins and ends where its own lines do, whatever stands around it. A line of
LONG_WORDS words or more is a chunk besides, since it is a passage by itself. Chunks overlap, so a
repeated run of lines is repeated chunks from its first word to its last: it is found whole.

Chunks whose 128-bit hash occurs more than once anywhere are read again and compared byte by byte:
the smallest and largest text of a hash must be equal, else all of that hash stay. Of a repeated
chunk the first occurrence stays, by doc_id (nulls last), text hash and place; the lines of the
others are removed. The first occurrence of a line is in no later occurrence of a chunk, so of
every line one stays.

What moves: one small row for each chunk, about one for each line; the bytes of chunks that a Bloom filter, sized by
the number of repeated hashes, takes for repeated; and, to apply the removals, each text once. Where the filter would
have more than MOST_BITS bits, the repeated chunks' places are joined to the documents instead. The aggregations are combined
before the shuffle, so a chunk that a third of all documents have is one row for each task.

Defined cases: null and empty texts have no chunks and stay as they are; a text all of whose lines
go becomes empty; rows with equal doc_id and text are one document and lose the same lines; other
columns are kept as they came.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiweave.llm.shared import fresh, materialize, rows_at_once, small_batches

MIN_LINES, LONG_WORDS = 2, 50
#: The filter of repeated chunk hashes: bits for each hash, probes, and the most bits that are broadcast (16 MB).
HASH_BITS, PROBES, MOST_BITS = 16, 3, 1 << 27


def chunks(text: bytes) -> Iterator[tuple[int, int, bool]]:
    """First line, end line and whether it counts, of each chunk of a text; all count.

    The first line of a long line's chunk is counted from the end (below 0), so that first lines
    tell a text's chunks apart. Both are places for a slice.
    """
    lines, worded = text.split(b"\n"), []
    for i, line in enumerate(lines):
        words = len(line.split())
        if words:
            worded.append(i)
            if len(worded) >= MIN_LINES:
                yield worded[-MIN_LINES], i + 1, True
            if words >= LONG_WORDS:
                yield i - len(lines), i + 1, True


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _hashed(text: bytes) -> Iterator[tuple[int, int, bytes]]:
    """First line, 128-bit hash and bytes of each counting chunk."""
    lines = text.split(b"\n")
    for a, b, counts in chunks(text):
        if counts:
            part = b"\n".join(lines[a:b])
            yield a, xxhash.xxh3_128_intdigest(part), part


def _halves(hashes: list[int]) -> np.ndarray:
    return np.array([divmod(h, 1 << 64) for h in hashes], dtype=np.uint64).reshape(-1, 2).view(np.int64)


def chunk_table(docs: DataFrame) -> DataFrame:
    """doc, th, place (first line), h1, h2 of each counting chunk of docs (doc, th, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_at_once(batches):
            rows, places, hashes = [], [], []
            for row, text in enumerate(_texts(batch.column(2))):
                for place, h, _ in _hashed(text):
                    rows.append(row)
                    places.append(place)
                    hashes.append(h)
            at, pairs = pa.array(rows, pa.int64()), _halves(hashes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(places, pa.int32()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])],
                ["doc", "th", "place", "h1", "h2"],
            )

    return docs.mapInArrow(run, "doc long, th long, place int, h1 long, h2 long")


def _probe(h1: np.ndarray, h2: np.ndarray, k: int, bits: int) -> np.ndarray:
    return (h1 % bits + k * (h2 % bits)) % bits


def hash_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """The Bloom filter of hashes (h1, h2), as 32-bit words."""
    size = F.lit(bits)
    places = hashes.select(F.explode(F.array(*[F.pmod(F.pmod("h1", size) + F.lit(k) * F.pmod("h2", size), size) for k in range(PROBES)])).alias("p"))
    bit = F.expr("shiftleft(1L, cast(pmod(p, 32) AS int))")
    found = places.groupBy(F.shiftright("p", 5).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    words = np.zeros(bits // 32, dtype=np.uint32)
    words[found.column(0).to_numpy()] = found.column(1).to_numpy().astype(np.uint32)
    return words


BYTES = "doc long, th long, place int, h1 long, h2 long, bytes binary"


def _chosen(batches: Iterator[pa.RecordBatch], hit: Callable[[int, pa.RecordBatch, list[int], np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """chunk_table's columns and the bytes of the chunks that `hit` (row, batch, places, hashes) chooses."""
    for batch in rows_at_once(batches):
        rows, places, hashes, parts = [], [], [], []
        for row, text in enumerate(_texts(batch.column(2))):
            own = list(_hashed(text))
            for (place, h, part), yes in zip(own, hit(row, batch, [x for x, _, _ in own], _halves([h for _, h, _ in own])), strict=True):
                if yes:
                    rows.append(row)
                    places.append(place)
                    hashes.append(h)
                    parts.append(part)
        at, pairs = pa.array(rows, pa.int64()), _halves(hashes)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), pa.array(places, pa.int32()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(parts, pa.binary())],
            ["doc", "th", "place", "h1", "h2", "bytes"],
        )


def filtered_bytes(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """chunk_table's columns and the bytes, of the chunks that the filter takes for repeated."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value

        def hit(row: int, batch: pa.RecordBatch, places: list[int], pairs: np.ndarray) -> np.ndarray:
            out = np.ones(len(pairs), dtype=bool)
            for k in range(PROBES):
                at = _probe(pairs[:, 0], pairs[:, 1], k, 32 * len(bits))
                out &= (bits[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)
            return out

        return _chosen(batches, hit)

    return docs.mapInArrow(run, BYTES)


def joined_bytes(docs: DataFrame, table: DataFrame, again: DataFrame) -> DataFrame:
    """The same for the repeated chunks themselves, whose places are joined to the documents instead of filtered."""
    wanted = table.join(again, ["h1", "h2"]).groupBy(F.col("doc").alias("_d"), F.col("th").alias("_t")).agg(F.collect_set("place").alias("places"))
    own = docs.join(wanted.hint("shuffle_hash"), F.col("doc").eqNullSafe(F.col("_d")) & F.col("th").eqNullSafe(F.col("_t"))).select("doc", "th", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _chosen(batches, lambda row, batch, places, pairs: np.isin(places, batch.column(3)[row].as_py()))

    return own.mapInArrow(run, BYTES)


def removals(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """doc, th and places (first lines of the chunks to remove) of the documents that lose lines."""
    small_batches(docs.sparkSession)
    table = materialize(chunk_table(docs), "lines-chunks")
    again = table.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    again = materialize(again, "lines-again", table.count() // 2)
    bits = 1 << max(20, (HASH_BITS * again.count() - 1).bit_length())
    read = filtered_bytes(docs, hash_filter(again, bits)) if bits <= most_bits else joined_bytes(docs, table, again)
    order = F.struct(F.col("doc").isNull().alias("last"), "doc", "th", "place")
    groups = read.groupBy("h1", "h2").agg(
        F.count("*").alias("n"), F.min("bytes").alias("low"), F.max("bytes").alias("high"), F.min(order).alias("first")
    )
    groups = materialize(groups.where("n > 1 and low = high").select("h1", "h2", "first"), "lines-groups", again.count())
    return table.join(groups, ["h1", "h2"]).where(order != F.col("first")).groupBy("doc", "th").agg(F.collect_set("place").alias("places"))


def _without(text: bytes, places: set[int]) -> bytes:
    lines, gone = text.split(b"\n"), set()
    for a, b, _ in chunks(text):
        if a in places:
            gone.update(range(a % len(lines), b))
    return b"\n".join(x for i, x in enumerate(lines) if i not in gone)


def _cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, places in batches:
        yield pd.Series([None if t is None else _without(t.encode("utf-8", "surrogatepass"), set(p)).decode("utf-8", "surrogatepass") for t, p in zip(texts, places, strict=True)])


def dedup_lines(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with repeated chunks cut from text, and the name of an added column: lines removed or not.

    The added column holds the number of repeated chunks, whose lines went, null where none did.
    """
    doc, th, cut = fresh(docs, "doc", "th", "cut")
    text = F.col("text").cast("string")
    keyed = docs.withColumns({doc: F.col("doc_id").cast("long"), th: F.xxhash64(text)})
    gone = removals(keyed.select(F.col(doc).alias("doc"), F.col(th).alias("th"), text.alias("text")))
    gone = gone.select(F.col("doc").alias("_d"), F.col("th").alias("_t"), F.col("places").alias("_p")).select(F.struct("_d", "_t", "_p").alias(cut))
    # Texts stream past the removals of their partition; neither side is sorted.
    out = keyed.join(gone.hint("shuffle_hash"), F.col(doc).eqNullSafe(F.col(f"{cut}._d")) & (F.col(th) == F.col(f"{cut}._t")), "left")
    left = F.pandas_udf(_cut, "string")(F.when(F.col(cut).isNotNull(), text), F.col(f"{cut}._p"))
    columns = [F.when(F.col(cut).isNull(), text).otherwise(left).alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return out.select(*columns, F.size(F.col(f"{cut}._p")).alias(cut)), cut


def report(docs: DataFrame) -> DataFrame:
    """doc_id, chunks_removed, lines_before, lines_after, chars_after and text_sha256 of each row."""
    out, cut = dedup_lines(docs.select("doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("lines_before")))
    return out.select(
        "doc_id",
        F.greatest(F.coalesce(cut, F.lit(0)), F.lit(0)).cast("long").alias("chunks_removed"),
        F.col("lines_before").cast("long").alias("lines_before"),
        F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("lines_after"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars_after"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


def drop_repeated(docs: DataFrame) -> DataFrame:
    """docs, all columns as they came, without repeated chunks; rows that lose all their words go."""
    out, cut = dedup_lines(docs)
    return out.where(F.col(cut).isNull() | (F.col(cut) < 1) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop(cut)
