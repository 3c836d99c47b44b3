"""Mixing sources to target weights over a multivariate-hypergeometric splitting tree.

Sizes are words. Sources by code point, null last, weigh 1, 2, 3, 1, ... and share the total; what
a source's target exceeds COPIES times its size by is shared again by weight.

A source's documents are hashed into blocks of about BLOCK words (more where there would be over
MOST_BLOCKS blocks). A seeded bijection permutes the blocks. A target of w whole sizes and a rest
draws every block w times and then, in permuted order, the blocks that the rest reaches: that is
the source's exact block quota. A splitting tree divides the quotas of all sources among the
shards: a node gives its left half the half's share of its draws, drawn multivariate-
hypergeometrically from the node's quotas. Shard j takes the run of draws that the tree gave it,
so shards are disjoint, and every draw is in one. What a document gives to the mix is what the
shards' draws hold of its block, so a draw that the tree loses is a loss of words.

Of the one block that a rest reaches only in part, documents come in hashed order up to the rest.
The copy at its end comes or stays out whole, whichever is nearer; only where that would miss the
target by more than TOLERANCE of it, it is cut to its first words. Inside a shard, copies are
shuffled by hash.

What moves: one small row for each document and each block; the mix itself moves each text twice.
Running sums over blocks go by groups of blocks, so a hot source is many tasks. The driver holds
one row for each source, the top of the tree; subtrees are split by the executors. Reruns agree:
hashes and draws are seeded, and a tree node's draw depends on its place in the tree only.

Defined cases: null text and text without words have size 0 and are never drawn; a null source is
a source, the last; a null doc_id is a document; rows of equal doc_id, source and text are treated
alike; an empty table gives an empty mix; other columns come along unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from equiweave.llm.shared import WORD_PATTERN, materialize, small_batches, word_count

WEIGHTS = (1, 2, 3)
COPIES = 3
BLOCK = 1024
#: numpy draws hypergeometrically from less than 10**9 in all; a block may be drawn COPIES times.
MOST_BLOCKS = 1 << 28
SHARD_WORDS = 1 << 21
TOLERANCE = 0.005
#: Neighbouring places of the permuted blocks whose running sums one task makes.
GROUP = 4096
#: Subtrees that the driver hands to the executors, and the bytes of a table that may be broadcast.
SUBTREES, BROADCAST = 256, 16 << 20
SEED = 11


def targets(totals: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, copies: int = COPIES) -> list[float]:
    """The target of each source of totals (source, size), which are in any order."""
    order = sorted(range(len(totals)), key=lambda i: (totals[i][0] is None, totals[i][0] or ""))
    weight = {i: float(weights[k % len(weights)]) for k, i in enumerate(order)}
    out = dict.fromkeys(order, 0.0)
    left, open_ = float(sum(n for _, n in totals)), list(order)
    while open_:
        unit = left / sum(weight[i] for i in open_)
        over = [i for i in open_ if weight[i] * unit > copies * totals[i][1]]
        if not over:
            for i in open_:
                out[i] = weight[i] * unit
            break
        for i in over:
            out[i] = float(copies * totals[i][1])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return [out[i] for i in range(len(totals))]


# ---------------------------------------------------------------- the splitting tree


def split(quotas: np.ndarray, first: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Quotas of the left shards // 2 shards and of the others, for the node of shards first to first + shards."""
    total = int(quotas.sum())
    rng = np.random.default_rng([SEED, first, shards])
    share = total * (shards // 2) // shards
    left = rng.multivariate_hypergeometric(quotas, share, method="marginals") if total else quotas * 0
    return left, quotas - left


def subtrees(quotas: np.ndarray, shards: int, most: int = SUBTREES) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first shard, shards, quotas, draws before) of about `most` nodes that cover all shards, in order."""
    nodes = [(0, shards, quotas, quotas * 0)]
    while len(nodes) < most and any(n > 1 for _, n, _, _ in nodes):
        below = []
        for first, n, own, before in nodes:
            if n == 1:
                below.append((first, n, own, before))
                continue
            left, right = split(own, first, n)
            below += [(first, n // 2, left, before), (first + n // 2, n - n // 2, right, before + left)]
        nodes = below
    return nodes


def leaves(first: int, shards: int, quotas: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, quotas, draws before) of each shard of a node, in order."""
    if shards == 1:
        yield first, quotas, before
        return
    left, right = split(quotas, first, shards)
    yield from leaves(first, shards // 2, left, before)
    yield from leaves(first + shards // 2, shards - shards // 2, right, before + left)


def dealt(spark: SparkSession, quotas: np.ndarray, shards: int) -> DataFrame:
    """sid, shard, first and last: the run of draws of each source that each shard takes."""
    nodes = pd.DataFrame([(f, n, q.tolist(), b.tolist()) for f, n, q, b in subtrees(quotas, shards)], columns=["first", "shards", "quotas", "before"])

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                for shard, own, before in leaves(row.first, row.shards, np.array(row.quotas, dtype=np.int64), np.array(row.before, dtype=np.int64)):
                    some = np.flatnonzero(own)
                    yield pd.DataFrame({"sid": some.astype(np.int32), "shard": np.int32(shard), "first": before[some], "last": before[some] + own[some] - 1})

    table = spark.createDataFrame(nodes, "first int, shards int, quotas array<long>, before array<long>")
    return table.repartition(max(1, min(len(nodes), 2 * spark.sparkContext.defaultParallelism)), "first").mapInPandas(expand, "sid int, shard int, first long, last long")


# ---------------------------------------------------------------- blocks and draws


def _multiplier(n: int, rng: np.random.Generator) -> int:
    """A number near n times the golden section that has no common divisor with n."""
    start = max(1, int(n * (0.6 + 0.05 * rng.random())))
    return next(m for m in range(start, start + n + 1) if np.gcd(m, n) == 1)


PLAN_SCHEMA = "sid int, source string, source_size long, target double, whole int, rest long, blocks long, factor long, shift long"


def plan(totals: list[tuple[str | None, int]]) -> pd.DataFrame:
    """One row for each source of totals (source, size): its target as whole sizes and a rest, and its blocks' permutation."""
    order = sorted(range(len(totals)), key=lambda i: (totals[i][0] is None, totals[i][0] or ""))
    rng, goal = np.random.default_rng(SEED), targets(totals)
    block = max(BLOCK, -(-sum(n for _, n in totals) // MOST_BLOCKS))
    rows = []
    for sid, i in enumerate(order):
        source, size = totals[i]
        whole, rest = divmod(round(goal[i]), size) if size else (0, 0)
        n = max(1, -(-size // block))
        rows.append((sid, source, size, goal[i], whole, rest, n, _multiplier(n, rng), int(rng.integers(0, n))))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in PLAN_SCHEMA.split(", ")])


def _sources(spark: SparkSession, planned: pd.DataFrame) -> DataFrame:
    table = spark.createDataFrame(planned, PLAN_SCHEMA) if len(planned) else spark.createDataFrame([], PLAN_SCHEMA)
    small = 100 * len(planned) + sum(4 * len(s or "") for s in planned["source"]) <= BROADCAST
    return F.broadcast(table) if small else table


def placed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows (doc_id, source, tie, any others) with the columns of their source, block and h, a document's hash."""
    out = rows.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    out = out.withColumn("h", F.xxhash64(F.lit(SEED), "doc_id", "tie"))
    return out.withColumn("block", F.pmod("h", F.col("blocks")))


def ordered_blocks(sizes: DataFrame) -> DataFrame:
    """sid, block, nth (from 0, in permuted order), start (words before it), words and the source's whole and rest, of each block."""
    place = F.pmod(F.col("block") * F.col("factor") + F.col("shift"), F.col("blocks"))  # below 2**57
    blocks = sizes.where("size > 0").groupBy("sid", "block", "whole", "rest", place.alias("place")).agg(F.sum("size").alias("words"))
    blocks = materialize(blocks.withColumn("part", F.floor(F.col("place") / GROUP)), "mix-blocks")
    per = blocks.groupBy("sid", "part").agg(F.sum("words").alias("w"), F.count("*").alias("n"))
    before = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("sid", "part", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("sid", "part").orderBy("place")
    start = F.col("w0") + F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    return blocks.join(per, ["sid", "part"]).select("sid", "block", (F.col("n0") + F.row_number().over(inside) - 1).alias("nth"), start.alias("start"), "words", "whole", "rest")


def partial_words(sizes: DataFrame, blocks: DataFrame) -> DataFrame:
    """sid, block, h and part: the words of the documents that give fewer than all to the rest, in blocks that a rest reaches in part."""
    reached = blocks.where("start < rest and start + words > rest").select("sid", "block", (F.col("rest") - F.col("start")).alias("room"))
    docs = sizes.where("size > 0").join(reached, ["sid", "block"]).groupBy("sid", "block", "h", "room", "target").agg(F.max("size").alias("size"), F.count("*").alias("rows"))
    start = F.sum(F.col("size") * F.col("rows")).over(Window.partitionBy("sid", "block").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") * F.col("rows")
    docs = docs.withColumn("left", F.greatest(F.lit(0), F.col("room") - start)).withColumn("each", F.least(F.col("size"), F.expr("left div rows")))
    miss = F.col("each") * F.col("rows"), (F.col("size") - F.col("each")) * F.col("rows")
    near = F.when(F.least(*miss) > F.col("target") * TOLERANCE, F.col("each")).when(miss[0] < miss[1], F.lit(0)).otherwise(F.col("size"))
    given = F.when(F.col("each") == F.col("size"), F.col("size")).when(F.col("left") == 0, 0).otherwise(near)
    return docs.where(given < F.col("size")).select("sid", "block", "h", given.alias("part"))


def draws(sizes: DataFrame, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sources' plan; (sid, block, drawn): the shards' draws of each block, structs of shard, copy and rest; and partial_words.

    sizes: doc_id, source, size, tie.
    """
    spark = sizes.sparkSession
    planned = plan([tuple(r) for r in sizes.groupBy("source").agg(F.sum("size")).collect()])
    sources = _sources(spark, planned)
    sizes = placed(sizes, sources)
    blocks = materialize(ordered_blocks(sizes), "mix-places")
    # A draw is a copy of a block: all blocks `whole` times, then those that the rest reaches.
    counts = {r[0]: r[1:] for r in blocks.groupBy("sid").agg(F.count("*"), F.count_if(F.col("start") < F.col("rest"))).collect()}
    quotas = np.array([w * counts[s][0] + counts[s][1] if s in counts else 0 for s, w in zip(planned["sid"], planned["whole"], strict=True)], dtype=np.int64)
    words = round(sum(planned["target"]))
    shards = max(1, -(-words // shard_words))
    held = spark.createDataFrame([(s, int(n)) for s, (n, _) in counts.items()], "sid int, n long")
    copies = F.sequence(F.lit(0), F.col("whole") - F.when(F.col("start") < F.col("rest"), 0).otherwise(1))
    some = blocks.where("whole > 0 or start < rest").join(held, "sid").select("sid", "block", "whole", "n", "nth", F.explode(copies).alias("copy"))
    some = some.select("sid", "block", "copy", (F.col("copy") == F.col("whole")).alias("rest"), (F.col("copy") * F.col("n") + F.col("nth")).alias("draw"))
    runs = dealt(spark, quotas, shards).select("sid", "shard", F.explode(F.sequence("first", "last")).alias("draw"))
    drawn = some.join(runs, ["sid", "draw"]).groupBy("sid", "block").agg(F.array_sort(F.collect_list(F.struct("copy", "shard", "rest"))).alias("drawn"))
    parts = materialize(partial_words(sizes, blocks), "mix-parts")
    return sources, materialize(drawn, "mix-draws"), parts


def with_takes(rows: DataFrame, sources: DataFrame, drawn: DataFrame, parts: DataFrame, size: Column) -> DataFrame:
    """rows (doc_id, source, tie, any others) with source_size, target and takes, an array of struct(shard, copy, words)."""
    own = placed(rows, sources).drop("whole", "rest", "blocks", "factor", "shift")
    own = own.join(drawn.hint("shuffle_hash"), ["sid", "block"], "left").join(parts, ["sid", "block", "h"], "left")
    takes = F.transform("drawn", lambda t: F.struct(t["shard"].alias("shard"), t["copy"].alias("copy"), F.when(t["rest"], F.coalesce("part", size)).otherwise(size).alias("words")))
    takes = F.coalesce(F.filter(takes, lambda t: t["words"] > 0), F.array().cast("array<struct<shard:int,copy:int,words:long>>"))
    return own.withColumn("takes", takes).drop("sid", "block", "h", "drawn", "part")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and tie of docs."""
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("tie"))


def word_report(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and shards (of the copies, ascending) of each row of docs."""
    rows = materialize(sized(docs), "mix-sizes")
    out = with_takes(rows, *draws(rows, shard_words), F.col("size"))
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda total, t: total + t["words"])
    return out.select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"), F.size("takes").alias("copies"), F.array_sort(F.transform("takes", lambda t: t["shard"])).alias("shards")
    )


def _first_words(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    word = re.compile(WORD_PATTERN)
    for texts, counts in batches:
        yield pd.Series([None if t is None else t[: next(islice(word.finditer(t), int(n) - 1, None)).end()] for t, n in zip(texts, counts, strict=True)], dtype=object)


def mix(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The mix: docs' columns, one row for each copy taken, dealt into shards and shuffled in each.

    A copy that is cut holds the first words of its text.
    """
    small_batches(docs.sparkSession)
    sources, drawn, parts = draws(materialize(sized(docs), "mix-sizes"), shard_words)
    text = F.col("row.text").cast("string")
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    packed = packed.select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.source").cast("string").alias("source"), F.xxhash64(text).alias("tie"))
    # Documents of no words have no block that counts; a whole copy's words need not be counted again.
    whole = F.when(text.rlike(WORD_PATTERN), F.lit(1 << 62)).otherwise(F.lit(0))
    copies = with_takes(packed, sources, drawn, parts, whole).select("row", "doc_id", "tie", F.explode("takes").alias("take"))
    cut = F.col("take.words") < F.lit(1 << 62)
    first = F.pandas_udf(_first_words, "string")(F.when(cut, F.col("row.text").cast("string")), F.when(cut, F.col("take.words")))
    copies = copies.withColumn("cut", first)
    dealt_ = copies.repartition(F.col("take.shard")).sortWithinPartitions("take.shard", F.xxhash64(F.lit(SEED + 1), "doc_id", "tie", "take.copy"))
    columns = [F.coalesce("cut", F.col("row.text").cast("string")).alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return dealt_.select(*columns)
