"""What the corpus operators share: scratch tables, names and byte-level text kernels.

Text kernels work on the raw UTF-8 of an Arrow batch with numpy, so that no Python object is made
for each word. Words are ``[^\\x20\\x09-\\x0D]+``; in UTF-8 these separators never occur inside
another character, so bytes give the same words as code points do.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 20
#: Bytes hashed at once.
PIECE = 1 << 22
#: Rows of an Arrow batch that holds whole texts.
BATCH_ROWS = 500
#: Rows of a file of a scratch table whose rows are a few numbers each.
FILE_ROWS = 1 << 20

_made: list[tuple[object, object]] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode a temporary folder."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not (conf.get("spark.master", "") or "").split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "equiweave-scratch")


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(drop_scratch)
    sc = spark.sparkContext
    _made.append((sc._jvm.org.apache.hadoop.fs.Path(path), sc._jsc.hadoopConfiguration()))
    return path


def materialize(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and outlives lost executors.

    rows: for tables of a few numbers a row that come from a shuffle, the most rows there can be; they
    are written in files of about FILE_ROWS rows, or two for each core if that is more.
    """
    path = scratch_path(df.sparkSession, tag)
    out = df if rows is None else df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    out.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing will read again."""
    gone = {str(f).rsplit("/", 1)[0].rsplit("/", 1)[-1] for t in tables for f in t.inputFiles()[:1]}
    _delete([x for x in _made if x[0].getName() in gone])


def drop_scratch() -> None:
    """Delete every scratch table of this process; results not yet written need them. Runs at exit."""
    _delete(list(_made))


def _delete(entries: list[tuple[object, object]]) -> None:
    for entry in entries:
        _made.remove(entry)
        with contextlib.suppress(Exception):  # the JVM may have ended before the process
            entry[0].getFileSystem(entry[1]).delete(entry[0], True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let Arrow batches hold `rows` rows at most: ten thousand whole texts, the default, can be
    hundreds of MB on both sides of the pipe. The session keeps the setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that no column of df has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def bounded_sample(docs: DataFrame, ids: DataFrame, rows: int, most_bytes: int) -> DataFrame:
    """key and text of at most `rows` rows of docs (key, text) whose key is in ids (key), by hash of key, key and text,
    up to the first with which there would be more than most_bytes bytes of text. Nulls are no keys."""
    order = [F.xxhash64("key"), F.col("key"), F.xxhash64("text")]
    sizes = docs.select("key", F.xxhash64("text").alias("th"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), *[c.alias(f"o{i}") for i, c in enumerate(order)])
    sizes = sizes.join(ids.distinct(), "key").orderBy("o0", "o1", "o2").limit(rows)
    total = F.sum("bytes").over(Window.orderBy("o0", "o1", "o2").rowsBetween(Window.unboundedPreceding, 0))  # at most `rows` rows
    chosen = sizes.withColumn("total", total).where(F.col("total") <= most_bytes).select("key", "th").distinct()
    found = docs.withColumn("th", F.xxhash64("text")).join(F.broadcast(chosen), ["key", "th"])  # at most `rows` rows
    return found.orderBy(*order).limit(rows).select("key", "text")


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def rows_at_once(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches in pieces, so that what is made for each row stays small; frees memory after the last.

    A worker process serves many tasks one after the other; what one leaves allocated would add to
    what the next needs.
    """
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.slice(k, rows)
    release_memory()


def release_memory() -> None:
    """Give free memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


# ---------------------------------------------------------------- byte-level kernels

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call unless there are far more than usual."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 2 * PIECE:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches each output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, places, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if places is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, at - at[0]


def slices(flat: np.ndarray, at: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `most` bytes: first row, end row, their bytes and offsets."""
    first = 0
    while first < len(at) - 1:
        end = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, end, flat[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def lower_ascii(flat: np.ndarray) -> np.ndarray:
    return _LOWER[flat]


def word_spans(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and n + 1 offsets of each text's words."""
    inside = ~_SPACE[flat]
    begins = np.zeros(len(flat) + 1, dtype=bool)
    begins[at] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | begins[1 : len(flat)]
    closes[:-1] &= ~inside[1:] | begins[1 : len(flat)]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, at)


def hash_spans(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from prefix sums of one polynomial; spans ascend and do not overlap.

    Works on runs of spans of about PIECE bytes, so that a very long text needs no longer tables.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        low = int(starts[first])
        end = max(first + 1, int(np.searchsorted(ends, low + PIECE, "right")))
        part, a, b = flat[low : int(ends[end - 1])], starts[first:end] - low, ends[first:end] - low
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, len(part) + 1)[: len(part)], out=sums[1:])
        value = (sums[b] - sums[a]) * _power_table(_BASE_INVERSE, len(part) + 1)[a]
        out[first:end] = mix(value ^ ((b - a).astype(np.uint64) << np.uint64(40)))
        first = end
    return out


def window_hashes(words: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `width` words inside each text, and the offsets of each text's runs.

    Texts with fewer words have none.
    """
    counts = np.diff(at)
    runs = np.maximum(counts - width + 1, 0)
    out_at = np.concatenate([[0], np.cumsum(runs)])
    if not len(words) or out_at[-1] == 0:
        return np.zeros(0, np.uint64), out_at
    total = np.zeros(max(len(words) - width + 1, 0), dtype=np.uint64)
    for k, factor in enumerate(_power_table(0xD6E8FEB86659FD93, width)):
        total += words[k : len(words) - width + 1 + k] * factor
    place = np.arange(out_at[-1]) - np.repeat(out_at[:-1], runs) + np.repeat(at[:-1], runs)
    return mix(total[place]), out_at


def shingle_sets(flat: np.ndarray, at: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z lower-cased.

    With fewer words than `width` the whole sequence is the one shingle; without words the set is empty.
    """
    flat = lower_ascii(flat)
    starts, ends, words_at = word_spans(flat, at)
    words = hash_spans(flat, starts, ends)
    runs, runs_at = window_hashes(words, words_at, width)
    factors = _power_table(0xA24BAED4963EE407, width)
    out = []
    for i in range(len(at) - 1):
        if runs_at[i + 1] > runs_at[i]:
            out.append(np.unique(runs[runs_at[i] : runs_at[i + 1]]))
        else:
            few = words[words_at[i] : words_at[i + 1]]
            whole = mix((few * factors[: len(few)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(few)))
            out.append(whole if len(few) else few)
    return out
