"""Alignment metrics of ranked lists, for all conditions and pairs in one pass each.

ranked: condition, pair, s, t, score, rank. refs: condition, pair, s, t. MRR and Hits@k count
distinct reference sources, Recall@k reference rows with repeats, F1 sets of pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from equiweave.operators.ranking import LIST, gold_ranks, top_one

GROUP = ["condition", "pair"]
GRID = [round(k / 100, 2) for k in range(10, 100)]


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def harmonic(p: Column, r: Column) -> Column:
    return ratio(F.lit(2.0) * p * r, p + r)


def mrr(ranked: DataFrame, refs: DataFrame) -> DataFrame:
    best = gold_ranks(ranked, refs)
    return best.groupBy(*GROUP).agg(F.avg(F.coalesce(1.0 / F.col("best_gold_rank"), F.lit(0.0))).alias("mrr"), F.count("*").alias("n_sources"))


def hits_at(ranked: DataFrame, refs: DataFrame, *ks: int) -> DataFrame:
    best = gold_ranks(ranked, refs)
    return best.groupBy(*GROUP).agg(*[F.avg(F.coalesce((F.col("best_gold_rank") <= k).cast("double"), F.lit(0.0))).alias(f"hits_at_{k}") for k in ks])


def recall_at(ranked: DataFrame, refs: DataFrame, *ks: int) -> DataFrame:
    rows = refs.select(*LIST, "t").join(ranked.select(*LIST, "t", "rank"), [*LIST, "t"], "left")
    return rows.groupBy(*GROUP).agg(*[F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias(f"recall_at_{k}") for k in ks])


def count_sources(refs: DataFrame) -> DataFrame:
    return refs.groupBy(*GROUP).agg(F.countDistinct("s").alias("n_sources"))


def f1_at(predicted: DataFrame, refs: DataFrame, threshold: Column) -> DataFrame:
    """Set precision, recall and F1 of predicted (condition, pair, s, t, score [, threshold]) at score >= threshold."""
    chosen = predicted.where(F.col("score") >= threshold).select(*LIST, "t").distinct().withColumn("p", F.lit(1))
    gold = refs.select(*LIST, "t").distinct().withColumn("g", F.lit(1))
    both = gold.join(chosen, [*LIST, "t"], "full_outer")
    counts = both.groupBy(*GROUP).agg(
        F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).cast("int").alias("tp"),
        F.count_if(F.col("p").isNotNull() & F.col("g").isNull()).cast("int").alias("fp"),
        F.count_if(F.col("p").isNull() & F.col("g").isNotNull()).cast("int").alias("fn"),
    )
    return with_scores(counts)


def with_scores(counts: DataFrame) -> DataFrame:
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", harmonic(F.col("precision"), F.col("recall")))


def hits_from_recall(recall_at_1: Column, n_refs: Column, n_sources: Column) -> Column:
    """Hits@1 of older results; null unless the hit count is whole within 1e-6."""
    hits = recall_at_1 * n_refs
    return F.when(F.abs(hits - F.round(hits)) <= 1e-6, F.round(hits) / n_sources)


def tune_threshold(ranked: DataFrame, refs: DataFrame, grid: list[float] = GRID) -> DataFrame:
    """condition, pair, threshold, f1: the grid value with the best F1 of first targets; of ties the lower median.

    Each prediction counts once, at its own grid step; counts at a threshold are running sums over
    the steps, so rows do not multiply with the grid.
    """
    if not grid:
        raise ValueError("the grid is empty")
    steps = F.array(*map(F.lit, sorted(grid)))
    gold = refs.select(*LIST, "t").distinct()
    n_gold = gold.groupBy(*GROUP).agg(F.count("*").alias("n_gold"))
    first = top_one(ranked).select(*LIST, "t", "score").join(gold.withColumn("g", F.lit(1)), [*LIST, "t"], "left")
    passed = F.size(F.filter(steps, lambda x: x <= F.col("score")))  # how many grid values this score passes
    tally = first.groupBy(*GROUP, passed.alias("k")).agg(F.count("*").alias("n"), F.count("g").alias("hit"))
    points = n_gold.select(*GROUP, "n_gold", F.posexplode(steps).alias("pos", "threshold"))
    at = points.join(tally, [*points.columns[:2]], "left").groupBy(*GROUP, "pos", "threshold", "n_gold").agg(
        F.coalesce(F.sum(F.when(F.col("k") > F.col("pos"), F.col("n"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("k") > F.col("pos"), F.col("hit"))), F.lit(0)).alias("tp"),
    )
    scored = with_scores(at.withColumn("fp", F.col("n") - F.col("tp")).withColumn("fn", F.col("n_gold") - F.col("tp")))
    best = scored.withColumn("r", F.rank().over(Window.partitionBy(*GROUP).orderBy(F.desc("f1")))).where("r = 1")
    ties = F.array_sort(F.collect_list("threshold"))
    return best.groupBy(*GROUP).agg(F.max("f1").alias("f1"), ties.alias("ties")).select(*GROUP, F.expr("element_at(ties, cast((size(ties) + 1) div 2 AS int))").alias("threshold"), "f1")


def resolve_threshold(tuned: DataFrame, groups: DataFrame) -> DataFrame:
    """groups with the tuned threshold, 0.5 where nothing was tuned."""
    return groups.join(tuned.select(*GROUP, "threshold"), GROUP, "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.5)))


def all_metrics(ranked: DataFrame, refs: DataFrame, thresholds: DataFrame) -> DataFrame:
    """The fourteen metrics of each (condition, pair): thresholds holds one row for each."""
    first = top_one(ranked).join(thresholds, GROUP)
    f1 = f1_at(first, refs, F.col("threshold"))
    out = refs.select(*GROUP).distinct().join(thresholds, GROUP, "left").join(f1, GROUP, "left")
    best = gold_ranks(ranked, refs).groupBy(*GROUP).agg(
        F.avg(F.coalesce(1.0 / F.col("best_gold_rank"), F.lit(0.0))).alias("mrr"),
        *[F.avg(F.coalesce((F.col("best_gold_rank") <= k).cast("double"), F.lit(0.0))).alias(f"hits_at_{k}") for k in (1, 5, 10)],
    )
    out = out.join(best, GROUP, "left").join(recall_at(ranked, refs, 1, 5, 10), GROUP, "left")
    names = "f1 precision recall threshold mrr hits_at_1 hits_at_5 hits_at_10 recall_at_1 recall_at_5 recall_at_10".split()
    return out.select(*GROUP, *names, "tp", "fp", "fn")


def by_entity_type(ranked: DataFrame, refs: DataFrame, val_ranked: DataFrame, val_refs: DataFrame, least: int = 3) -> DataFrame:
    """all_metrics of each entity_type bucket with `least` test references; own threshold, else the pair's, else 0.5.

    All four tables carry entity_type (of the source).
    """
    def keyed(table: DataFrame) -> DataFrame:
        return table.withColumn("pair", F.struct("pair", "entity_type")).drop("entity_type")

    sizes = refs.groupBy(*GROUP, "entity_type").agg(F.count("*").cast("int").alias("n_refs")).where(F.col("n_refs") >= least)
    own = tune_threshold(keyed(val_ranked), keyed(val_refs)).select("condition", "pair", F.col("threshold").alias("own"))
    whole = tune_threshold(val_ranked.drop("entity_type"), val_refs.drop("entity_type")).select("condition", "pair", F.col("threshold").alias("whole"))
    thresholds = sizes.join(whole, GROUP, "left").withColumn("p", F.struct("pair", "entity_type"))
    thresholds = thresholds.join(own.withColumnRenamed("pair", "p"), ["condition", "p"], "left")
    thresholds = thresholds.select("condition", F.col("p").alias("pair"), F.coalesce("own", "whole", F.lit(0.5)).alias("threshold"))
    buckets = all_metrics(keyed(ranked), keyed(refs.join(sizes, [*GROUP, "entity_type"], "left_semi")), thresholds)
    buckets = buckets.withColumn("entity_type", F.col("pair.entity_type")).withColumn("pair", F.col("pair.pair"))
    return buckets.join(sizes, [*GROUP, "entity_type"])
