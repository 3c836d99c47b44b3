"""Exact top-k inner products without random access.

Candidates are dealt into blocks. In a block each coordinate has a sorted list of the block's
values. A query reads its lists from the top for its positive coordinates and from the bottom for
its negative ones, all to one depth, in rounds that go deeper. What it has read of a candidate is
the candidate's partial sum, to which a round adds newly read entries only. The rest lies between
two bounds: by the lists, a coordinate not yet read is at most the last value read; by length, the
unread part is at most |unread query| * |unread candidate|, where the candidate's whole length is
one more list. Both give an upper bound, the second a lower bound of the score. Candidates whose
upper bound is below the k-th highest lower bound cannot qualify; a query stops when at most RESOLVE
are left, or at its lists' ends, and the scores of those left are then resolved in full, exactly.
Queries that read to the same depth share a round as matrix products; candidates that none of the
queries still reading has left are dropped from the next one.

The blocks' answers for a query, k each, are merged by rank. Queries are few against all rows, in
blocks: each pair of a query block and a candidate block is one task group of bounded size.

Bounds are float32 with a slack; where partial sums could pass 2**53, every score of the block is
computed with Python integers instead, which raise OverflowError beyond 64 bits.

Defined cases: vectors that are null or hold a null or non-finite component take no part, neither
as queries nor as candidates; vectors of other lengths are padded with zeros; an empty vector
scores 0; ties go to the smaller vec_id; a query is not its own candidate, nor are other rows with
its vec_id; repeated candidates are repeated rows; repeated queries with one vec_id are answered
once, for the row with the largest vector; a null vec_id takes no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from equiweave.llm.shared import materialize

K = 5
SCALE = 256
BLOCK_ROWS, BLOCK_QUERIES = 4096, 2048
#: Share of every list that has been read after each round; after the last, everything is read.
DEPTHS = (0.5, 0.75, 0.875)
#: Candidates whose scores are worth resolving instead of reading on.
RESOLVE = 128
#: Queries whose bounds are held at once.
BATCH = 256


def quantized(vector: Column) -> Column:
    """floor(SCALE * x) of every component, as long."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * SCALE).cast("long"))


def usable(vector: Column) -> Column:
    plain = F.forall(vector.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(plain, F.lit(False))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list<long> column, padded with zeros."""
    flat = column.combine_chunks()
    sizes = np.diff(flat.offsets.to_numpy())
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat.flatten().to_numpy()
    return out


class Block:
    """Sorted lists of a block of candidates x (rows sorted by name)."""

    def __init__(self, x: np.ndarray):
        self.x, self.n = x.astype(np.float32), len(x)
        order = np.argsort(x, axis=0, kind="stable")
        self.rank = np.empty(x.shape, dtype=np.int32)
        np.put_along_axis(self.rank, order, np.arange(self.n, dtype=np.int32)[:, None], 0)
        self.lists = np.take_along_axis(self.x, order, 0)
        self.length = (x.astype(np.float64) ** 2).sum(axis=1).astype(np.float32)

    def survivors(self, queries: np.ndarray, mine: np.ndarray, k: int = K, resolve: int = RESOLVE, depths: tuple[float, ...] = DEPTHS) -> list[tuple[np.ndarray, float]]:
        """For each query, the rows that can still be among its k best, and the share of its lists that was read.

        mine: queries x rows, rows that are no candidates of a query.
        """
        out = [(np.flatnonzero(~m), 0.0) for m in mine]
        live = np.array([i for i, (left, _) in enumerate(out) if len(left) > max(k, resolve)], dtype=np.int64)
        n, rows = self.n, np.arange(self.n)
        known = np.zeros((len(live), n), dtype=np.float32)
        seen, before = np.zeros_like(known), 0
        for share in depths:
            depth = min(n, max(1, round(share * n)))
            if not len(live) or depth == n:
                break
            q, rank, x = queries[live].astype(np.float32), self.rank[rows], self.x[rows]
            both = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1)  # what reads from the top, what from the bottom
            new = np.concatenate([np.where((rank >= n - depth) & (rank < n - before), x, 0), np.where((rank < depth) & (rank >= before), x, 0)], axis=1)
            known += both @ new.T
            seen += (both != 0).astype(np.float32) @ (new * new).T
            unread = np.concatenate([rank < n - depth, rank >= depth], axis=1).astype(np.float32)
            front = both * np.concatenate([self.lists[n - depth], self.lists[depth - 1]])
            # Sums of float32 are off by some millionths of their terms' sizes.
            slack = (1e-5 * np.abs(both) @ np.tile(np.abs(self.lists[[0, -1]]).max(axis=0), 2) + 1)[:, None]
            by_length = np.sqrt(np.maximum(self.length[rows] * np.float32(1 + 1e-5) - seen, 0) * ((both * both) @ unread.T)) * np.float32(1 + 1e-5)
            others = ~mine[np.ix_(live, rows)]
            upper = np.where(others, known + np.minimum(front @ unread.T, by_length) + slack, -np.inf)
            lower = np.where(others, known - by_length - slack, -np.inf)
            edge = np.partition(lower, len(rows) - k, axis=1)[:, len(rows) - k] if len(rows) > k else np.full(len(live), -np.inf)
            stay = others & (upper >= edge[:, None])
            for i, line in zip(live, stay, strict=True):
                out[i] = (rows[line], depth / n)
            reading = stay.sum(axis=1) > max(k, resolve)
            some = stay[reading].any(axis=0)
            live, rows, known, seen, before = live[reading], rows[some], known[reading][:, some], seen[reading][:, some], depth
        for i in live:
            out[i] = (out[i][0], 1.0)
        return out


def top_of_block(x: np.ndarray, names: np.ndarray, q: np.ndarray, q_names: np.ndarray, k: int = K, resolve: int = RESOLVE) -> list[tuple[int, int, int, float]]:
    """(query, candidate, score, share of the lists read) of each query's k best candidates in the block.

    x: candidates sorted by name; q: queries.
    """
    out: list[tuple[int, int, int, float]] = []
    if not len(x) or not len(q):
        return out
    peak = int(np.abs(x).max(initial=0)) * int(np.abs(q).max(initial=0)) * max(x.shape[1], 1)
    if peak >= 1 << 63:
        raise OverflowError("scores beyond 64 bits")
    exact = peak >= 1 << 53
    block, kind = (None, object) if exact else (Block(x), np.float64)
    full = x.astype(kind)
    for a in range(0, len(q), BATCH):
        mine = q_names[a : a + BATCH, None] == names[None, :]
        found = [(np.flatnonzero(~m), 1.0) for m in mine] if exact else block.survivors(q[a : a + BATCH], mine, k, resolve)
        for row, name, (left, share) in zip(q[a : a + BATCH], q_names[a : a + BATCH], found, strict=True):
            scores = (full[left] @ row.astype(kind)).astype(np.int64)
            best = np.lexsort((names[left], -scores))[:k]
            out += [(int(name), int(names[left[b]]), int(scores[b]), share) for b in best]
    return out


def answers(table: DataFrame, queries: Column, k: int = K, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, vec_id, score and read (the share of the block's lists that was read): each query's k best of every block."""
    name = F.col("vec_id").cast("long")
    rows = table.where(name.isNotNull() & usable(F.col("embedding"))).select(
        name.alias("vec_id"), quantized(F.col("embedding")).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")
    )
    rows = materialize(rows, "topk-vectors")
    n, asking, width = rows.agg(F.count("*"), F.count_if("asks"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    blocks, parts = max(1, -(-n // block_rows)), max(1, -(-asking // block_queries))
    # Names of their own: the two sides come from one table, whose attributes a cogroup can mix up.
    asked = rows.where("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.max("v").alias("q"))
    left = rows.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    right = asked.select("query_id", "q", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def answer(candidates: pa.Table, asks: pa.Table) -> pa.Table:
        found = []
        if candidates.num_rows and asks.num_rows:  # a side without rows may come without columns
            names, q_names = candidates["vec_id"].to_numpy(), asks["query_id"].to_numpy()
            order = np.argsort(names, kind="stable")
            found = top_of_block(matrix(candidates["v"], width)[order], names[order], matrix(asks["q"], width), q_names, k)
        columns = [pa.array([f[i] for f in found], pa.int64() if i < 3 else pa.float64()) for i in range(4)]
        return pa.Table.from_arrays(columns, ["query_id", "vec_id", "score", "read"])

    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(answer, "query_id long, vec_id long, score long, read double")


def search(table: DataFrame, queries: Column, k: int = K, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k best candidates of each row where `queries` holds.

    table: vec_id and embedding, arrays of numbers.
    """
    local = answers(table, queries, k, block_rows, block_queries)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
