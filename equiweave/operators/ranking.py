"""Re-ranking of candidates by vectors, and what is read off ranked lists.

A ranked table is (condition, pair, s, t, score, rank) with rank from 1, best first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LIST = ["condition", "pair", "s"]


def dot(a: Column, b: Column) -> Column:
    """Inner product in double, rounded to nine places so that ties do not hang on summation order."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.round(F.aggregate(products, F.lit(0.0), lambda total, x: total + x), 9)


def by_score(scored: DataFrame) -> DataFrame:
    """Rank (condition, pair, s, t, score) by score, ties by ascending target."""
    order = Window.partitionBy(*LIST).orderBy(F.desc("score"), "t")
    return scored.withColumn("rank", F.row_number().over(order).cast("int"))


def rerank(candidates: DataFrame, vectors: DataFrame) -> DataFrame:
    """candidates (condition, pair, s, t) ranked by the inner product of vectors (role, uri, vec).

    Two equi-joins; sources without candidates do not appear.
    """
    source = vectors.where("role = 'source'").select(F.col("uri").alias("s"), F.col("vec").alias("v"))
    target = vectors.where("role = 'candidate'").select(F.col("uri").alias("t"), F.col("vec").alias("w"))
    scored = candidates.join(source, "s").join(target, "t").select(*LIST, "t", dot(F.col("v"), F.col("w")).alias("score"))
    return by_score(scored)


def similarity_matrix(left: DataFrame, right: DataFrame, top_k: int, block: int = 1024) -> DataFrame:
    """s, t, score, rank: the top_k of right (t, vec) for each row of left (s, vec), as block matrix products.

    Both sides are dealt into blocks, each pair of blocks is one bounded group, and only top_k of a
    block leave it; no pair table is made.
    """
    import numpy as np
    import pyarrow as pa

    rows, columns = max(1, -(-left.count() // block)), max(1, -(-right.count() // block))
    a = left.select("s", "vec", F.pmod(F.xxhash64("s"), F.lit(rows)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("j"))
    b = right.select("t", "vec", F.pmod(F.xxhash64("t"), F.lit(columns)).cast("int").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("i"))

    def product(x: pa.Table, y: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(x) and len(y):
            y = y.sort_by("t")
            u, v = (np.array(z["vec"].to_pylist(), dtype=np.float64) for z in (x, y))
            scores = np.round(u @ v.T, 9)
            best = np.argsort(-scores, axis=1, kind="stable")[:, :top_k]
            names, targets = x["s"].to_pylist(), y["t"].to_pylist()
            out = [(names[r], targets[c], float(scores[r, c])) for r in range(len(names)) for c in best[r]]
        kinds = (x.schema.field("s").type, y.schema.field("t").type, pa.float64())
        return pa.table({n: pa.array([o[k] for o in out], kind) for k, (n, kind) in enumerate(zip("s t score".split(), kinds, strict=True))})

    kinds = f"s {left.schema['s'].dataType.simpleString()}, t {right.schema['t'].dataType.simpleString()}, score double"
    local = a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(product, kinds)
    order = Window.partitionBy("s").orderBy(F.desc("score"), "t")
    return local.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= top_k)


def top_one(ranked: DataFrame) -> DataFrame:
    return ranked.where("rank = 1").drop("rank")


def gold_ranks(ranked: DataFrame, refs: DataFrame) -> DataFrame:
    """condition, pair, s, ranked, gold_targets, gold_ranks (null where unlisted), best_gold_rank of each reference source.

    refs: condition, pair, s, t; repeated rows count once.
    """
    gold = refs.select(*LIST, "t").distinct().join(ranked.select(*LIST, "t", "rank"), [*LIST, "t"], "left")
    run = F.array_sort(F.collect_list(F.struct("t", "rank")))
    per = gold.groupBy(*LIST).agg(run.alias("run"), F.min("rank").alias("best_gold_rank"))
    listed = ranked.select(*LIST).distinct().withColumn("ranked", F.lit(True))
    return per.join(listed, LIST, "left").select(
        *LIST, F.coalesce("ranked", F.lit(False)).alias("ranked"),
        F.transform("run", lambda x: x["t"]).alias("gold_targets"), F.transform("run", lambda x: x["rank"]).alias("gold_ranks"), "best_gold_rank",
    )


def predictions(ranked: DataFrame, refs: DataFrame, threshold: Column) -> DataFrame:
    """The first target of each source: score, predicted (score at least threshold) and correct."""
    gold = refs.select("condition", "pair", "s", "t").distinct().withColumn("gold", F.lit(True))
    first = top_one(ranked).join(gold, [*LIST, "t"], "left")
    return first.select(*LIST, "t", "score", (F.col("score") >= threshold).alias("predicted"), F.coalesce("gold", F.lit(False)).alias("correct"))


def rank_histogram(best: DataFrame) -> DataFrame:
    """condition, pair, bucket, n of best_gold_rank: 1, 2-5, 6-10, 11-20, >20, unranked."""
    r = F.col("best_gold_rank")
    bucket = F.when(r.isNull(), "unranked").when(r == 1, "1").when(r <= 5, "2-5").when(r <= 10, "6-10").when(r <= 20, "11-20").otherwise(">20")
    return best.groupBy("condition", "pair", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def top_candidates(ranked: DataFrame, k: int = 4) -> DataFrame:
    """condition, pair, s, top array<struct<rank, t, score>> with scores rounded to six places."""
    first = ranked.where(F.col("rank") <= k).withColumn("score", F.bround("score", 6))
    return first.groupBy(*LIST).agg(F.array_sort(F.collect_list(F.struct("rank", "t", "score"))).alias("top"))


def order_mismatches(ranked: DataFrame, stored: DataFrame) -> DataFrame:
    """Sources whose list differs from the stored one, either missing included."""
    def lists(table: DataFrame, name: str) -> DataFrame:
        return table.groupBy(*LIST).agg(F.array_sort(F.collect_list(F.struct("rank", "t"))).alias(name))

    return lists(ranked, "a").join(lists(stored, "b"), LIST, "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(*LIST)


def best_over_floor(scored: DataFrame) -> DataFrame:
    """Drop exact repeats of (condition, pair, s, t), keeping the best score."""
    return scored.groupBy(*LIST, "t").agg(F.max("score").alias("score"))
