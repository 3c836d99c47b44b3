"""Pivots, strict means, tallies and the small tables of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from equiweave.operators.metrics import ratio

METRIC_NAMES = ("f1", "precision", "recall", "mrr", "hits_at_1", "hits_at_5", "hits_at_10", "recall_at_1", "recall_at_5", "recall_at_10")
STRICT = ("hits_at_1",)


def strict_mean(value: Column) -> Column:
    """The mean; null if a value is null."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.avg(value))


def breakdown(results: DataFrame, metric: str, datasets: list[str], key: str = "condition_id") -> DataFrame:
    """condition by dataset: means rounded half-even to four places, strict where the metric asks for it."""
    if metric not in METRIC_NAMES:
        raise ValueError(f"unknown metric {metric!r}")
    mean = strict_mean(F.col(metric)) if metric in STRICT else F.avg(metric)
    return results.groupBy(key).pivot("dataset_id", datasets).agg(F.bround(mean, 4))


def column_means(results: DataFrame, metrics: tuple[str, ...] = ("mrr", "f1", "hits_at_1")) -> DataFrame:
    return results.groupBy("condition_id", "dataset_id").agg(*[(strict_mean(F.col(m)) if m in STRICT else F.avg(m)).alias(m) for m in metrics])


def summary(results: DataFrame) -> DataFrame:
    """Means over columns of means over pairs, with population deviations of MRR and F1, at four places."""
    columns = column_means(results)
    return columns.groupBy("condition_id").agg(
        F.bround(F.avg("mrr"), 4).alias("mean_mrr"), F.bround(F.stddev_pop("mrr"), 4).alias("std_mrr"), F.bround(F.avg("f1"), 4).alias("mean_f1"),
        F.bround(F.stddev_pop("f1"), 4).alias("std_f1"), F.bround(strict_mean(F.col("hits_at_1")), 4).alias("mean_hits_at_1"), F.count("*").alias("n_columns"),
    )


def tied_best(columns: DataFrame, metric: str) -> DataFrame:
    """dataset_id, condition_id of all conditions at a column's best value, at four places."""
    rows = columns.withColumn("v", F.bround(metric, 4)).where("v is not null")
    return rows.withColumn("r", F.rank().over(Window.partitionBy("dataset_id").orderBy(F.desc("v")))).where("r = 1").select("dataset_id", "condition_id", F.col("v").alias("best"))


def rank_conditions(columns: DataFrame) -> DataFrame:
    """dataset_id, place, condition_id by descending MRR, ties by name."""
    order = Window.partitionBy("dataset_id").orderBy(F.desc_nulls_last("mrr"), "condition_id")
    return columns.select("dataset_id", F.row_number().over(order).alias("place"), "condition_id", "mrr")


def micro_f1(results: DataFrame, *by: str) -> DataFrame:
    return results.groupBy(*by).agg(ratio(2 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn")).alias("micro_f1"))


def micro_recall(rows: DataFrame) -> DataFrame:
    """Recall weighted by references."""
    return rows.agg(ratio(F.sum(F.col("recall") * F.col("n_refs")), F.sum("n_refs")).alias("micro_recall"))


def complete_mean(columns: DataFrame, metric: str, n_columns: int) -> DataFrame:
    """The mean over columns, null unless all are there."""
    return columns.groupBy("condition_id").agg(F.when(F.countDistinct(F.when(F.col(metric).isNotNull(), F.col("dataset_id"))) == n_columns, F.avg(metric)).alias(metric))


def entity_type_summary(buckets: DataFrame) -> DataFrame:
    """condition_id, and n_pairs, n_refs, macro MRR and F1 and micro F1 of classes and predicates, and their gaps."""
    rows = buckets.where(F.col("entity_type").isin("class", "predicate")).groupBy("condition_id").pivot("entity_type", ["class", "predicate"]).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.sum("n_refs").alias("n_refs"), strict_mean(F.col("mrr")).alias("mrr"), strict_mean(F.col("f1")).alias("f1"),
        ratio(2 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn")).alias("micro_f1"),
    )
    for m in ("mrr", "f1", "micro_f1"):
        rows = rows.withColumn(f"gap_{m}", F.col(f"class_{m}") - F.col(f"predicate_{m}"))
    return rows


def mean_contrast(rows: DataFrame, a: str, b: str) -> DataFrame:
    """mean_a, mean_b, gap over rows that have both."""
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.agg(F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), (F.avg(a) - F.avg(b)).alias("gap"))


def count_or_range(values: Column) -> Column:
    """One number if all agree, else min-max."""
    low, high = F.min(values).cast("string"), F.max(values).cast("string")
    return F.when(low == high, low).otherwise(F.concat(low, F.lit("–"), high))


def tally(columns: DataFrame, baseline: str, metric: str) -> DataFrame:
    """dataset_id, above, below, equal: conditions against the baseline."""
    base = columns.where(F.col("condition_id") == baseline).select("dataset_id", F.col(metric).alias("base"))
    rows = columns.where(F.col("condition_id") != baseline).join(base, "dataset_id")
    d = F.bround(F.col(metric), 4) - F.bround("base", 4)
    return rows.groupBy("dataset_id").agg(F.count_if(d > 0).alias("above"), F.count_if(d < 0).alias("below"), F.count_if(d == 0).alias("equal"))


def baseline_summary(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """dataset, metric, cells, tested, above, below, gains, losses of tests against the baseline."""
    sure = F.coalesce(F.col("p_adjusted") < alpha, F.lit(False))
    return tests.groupBy("dataset", "metric").agg(
        F.count("*").alias("cells"), F.count("p_value").alias("tested"), F.count_if(F.col("delta") > 0).alias("above"), F.count_if(F.col("delta") < 0).alias("below"),
        F.count_if((F.col("delta") > 0) & sure).alias("gains"), F.count_if((F.col("delta") < 0) & sure).alias("losses"),
    )


def cardinality(refs: DataFrame) -> DataFrame:
    """pair, kind (1:1, 1:N, N:1, N:M), n of distinct reference pairs by the degrees of their ends."""
    rows = refs.select("pair", "s", "t").distinct()
    out = F.count("*").over(Window.partitionBy("pair", "s")) > 1
    into = F.count("*").over(Window.partitionBy("pair", "t")) > 1
    kind = F.when(out & into, "N:M").when(out, "1:N").when(into, "N:1").otherwise("1:1")
    return rows.select("pair", kind.alias("kind")).groupBy("pair", "kind").agg(F.count("*").alias("n"))


def gold_per_source(refs: DataFrame) -> DataFrame:
    """pair, bucket (1, 2, 3+), n sources by distinct gold targets."""
    per = refs.groupBy("pair", "s").agg(F.countDistinct("t").alias("k"))
    return per.groupBy("pair", F.when(F.col("k") >= 3, "3+").otherwise(F.col("k").cast("string")).alias("bucket")).agg(F.count("*").alias("n"))


def overlaps(files: DataFrame) -> DataFrame:
    """a, b, shared_pairs, shared_sources of each two files (file, s, t): joined on what they share."""
    rows = files.select("file", "s", "t").distinct()
    def by(*keys: str) -> DataFrame:
        u = rows.select("file", *keys).distinct()
        return u.select(F.col("file").alias("a"), *keys).join(u.select(F.col("file").alias("b"), *keys), list(keys)).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))

    names = rows.select("file").distinct()
    every = names.select(F.col("file").alias("a")).join(names.select(F.col("file").alias("b")), F.col("a") < F.col("b"))
    pairs, sources = by("s", "t").withColumnRenamed("n", "p"), by("s").withColumnRenamed("n", "q")
    out = every.join(pairs, ["a", "b"], "left").join(sources, ["a", "b"], "left")
    return out.select("a", "b", F.coalesce("p", F.lit(0)).alias("shared_pairs"), F.coalesce("q", F.lit(0)).alias("shared_sources"))


def partitions_whole(splits: DataFrame, whole: DataFrame) -> DataFrame:
    """n_splits, n_whole, equal: whether the splits' links are the full set, each once."""
    a, b = splits.select("s", "t"), whole.select("s", "t").distinct()
    gaps = a.exceptAll(b).unionByName(b.exceptAll(a)).agg((F.count("*") == 0).alias("equal"))
    return a.agg(F.count("*").alias("n_splits")).crossJoin(b.agg(F.count("*").alias("n_whole"))).crossJoin(gaps)


def compare_alignments(a: DataFrame, b: DataFrame) -> DataFrame:
    """verdict of two cell tables (ord, s, t, relation, measure): same order, same cells, or different."""
    columns = ["s", "t", "relation", "measure"]

    def placed(x: DataFrame, name: str) -> DataFrame:
        """Cells with their place; the sort spills, and no row holds a table."""
        place = F.row_number().over(Window.orderBy("ord", *columns))
        return x.select(place.alias("k"), F.struct(*columns).alias(name))

    gaps = a.select(*columns).exceptAll(b.select(*columns)).unionByName(b.select(*columns).exceptAll(a.select(*columns))).agg(F.count("*").alias("gaps"))
    moved = placed(a, "x").join(placed(b, "y"), "k", "full_outer").agg(F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("moved"))
    verdict = F.when(F.col("moved") == 0, "same cells in order").when(F.col("gaps") == 0, "same cells").otherwise("different cells")
    return moved.crossJoin(gaps).select(verdict.alias("verdict"))


def mismatches(results: DataFrame, baseline: DataFrame, fields: list[str]) -> DataFrame:
    """dataset_id, pair_name, condition_id, reasons: fields in which a result differs from the baseline's, null-safe."""
    base = baseline.select("dataset_id", "pair_name", F.struct(*fields).alias("base"), F.lit(True).alias("found"))
    rows = results.join(base, ["dataset_id", "pair_name"], "left")
    differing = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"base.{f}")), F.lit(f)) for f in fields]))
    return rows.select("dataset_id", "pair_name", "condition_id", F.when(F.col("found"), differing).otherwise(F.array(F.lit("no baseline"))).alias("reasons"))


def change_counts(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """added, removed, changed, same of keyed values."""
    a = old.select(*keys, F.col(value).alias("x"), F.lit(True).alias("in_a"))
    b = new.select(*keys, F.col(value).alias("y"), F.lit(True).alias("in_b"))
    rows = a.join(b, keys, "full_outer")
    return rows.agg(
        F.count_if(F.col("in_a").isNull()).alias("added"), F.count_if(F.col("in_b").isNull()).alias("removed"),
        F.count_if(F.col("in_a") & F.col("in_b") & ~F.col("x").eqNullSafe(F.col("y"))).alias("changed"), F.count_if(F.col("in_a") & F.col("in_b") & F.col("x").eqNullSafe(F.col("y"))).alias("same"),
    )


def consistent(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose rows disagree on a value: none in a consistent set."""
    return rows.groupBy(key).agg(F.countDistinct(value).alias("n")).where("n > 1")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def pending(wanted: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """What has no result yet."""
    return wanted.join(done.select(*keys).distinct(), list(keys), "left_anti")


def coverage_matrix(registry: DataFrame, results: DataFrame, datasets: list[str]) -> DataFrame:
    """condition_id by dataset: number of results, 0 not run, null by design. registry: condition_id, dataset_id."""
    have = results.groupBy("condition_id", "dataset_id").agg(F.count("*").alias("n"))
    rows = registry.join(have, ["condition_id", "dataset_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.groupBy("condition_id").pivot("dataset_id", datasets).agg(F.max("n"))


def costs(runs: DataFrame) -> DataFrame:
    """condition_id, seconds (median of repeats), low, high, times_cheapest of runs (condition_id, seconds)."""
    per = runs.groupBy("condition_id").agg(F.percentile("seconds", F.lit(0.5)).alias("median_s"), F.min("seconds").alias("low_s"), F.max("seconds").alias("high_s"))
    return per.withColumn("times_cheapest", F.col("median_s") / F.min("median_s").over(Window.partitionBy()))


def length_summary(lengths: DataFrame, limit: int, budget: int | None = None, *by: str) -> DataFrame:
    """Token lengths (n): count, mean, median, p95, max, totals, truncated texts and tokens, over budget."""
    n = F.col("n")
    return lengths.groupBy(*by).agg(
        F.count("*").alias("texts"), F.avg(n).alias("mean"), F.percentile(n, F.lit(0.5)).alias("median"), F.percentile(n, F.lit(0.95)).alias("p95"), F.max(n).alias("longest"),
        F.sum(F.least(n, F.lit(limit))).alias("read"), F.count_if(n > limit).alias("truncated"), F.sum(F.greatest(n - limit, F.lit(0))).alias("discarded"),
        F.count_if(n > (budget if budget is not None else limit)).alias("over_budget"),
    )


def degree_bins(rows: DataFrame, edges: list[int]) -> DataFrame:
    """bin, n, mrr of sources (degree, rr) by degree."""
    case = F.lit(f">={edges[-1]}")
    for low, high in reversed(list(zip([0, *edges[:-1]], edges, strict=True))):
        case = F.when(F.col("degree") < high, f"{low}-{high - 1}").otherwise(case)
    return rows.groupBy(case.alias("bin")).agg(F.count("*").alias("n"), F.avg("rr").alias("mrr"))


def signatures(runs: DataFrame, fields: list[str]) -> DataFrame:
    """signature, runs, n: runs that may be compared, largest group first; source sets by digest."""
    return runs.groupBy(F.sha2(F.to_json(F.struct(*fields)), 256).alias("signature")).agg(F.array_sort(F.collect_list("label")).alias("runs"), F.count("*").alias("n"), (F.countDistinct("label") < F.count("*")).alias("repeated")).orderBy(F.desc("n"), "signature")


def source_digest(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.sha2(F.to_json(F.array_sort(F.collect_set("s"))), 256).alias("source_set"))


def extremes(rows: DataFrame, k: int) -> DataFrame:
    """The k largest movers in each direction: direction, place, unit, delta."""
    up, down = Window.orderBy(F.desc("delta"), "unit"), Window.orderBy("delta", "unit")
    largest = rows.orderBy(F.desc("delta"), "unit").limit(k).select(F.lit("up").alias("direction"), F.row_number().over(up).alias("place"), "unit", "delta")
    smallest = rows.orderBy("delta", "unit").limit(k).select(F.lit("down").alias("direction"), F.row_number().over(down).alias("place"), "unit", "delta")
    return largest.unionByName(smallest)


# ---------------------------------------------------------------- renderings of small collected tables


def markdown(table: DataFrame) -> str:
    """A Markdown table of a small result, four decimals."""
    def cell(x: object) -> str:
        return "N/A" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)

    rows = [table.columns, ["---"] * len(table.columns), *[[cell(x) for x in r] for r in table.collect()]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows) + "\n"


def latex(table: DataFrame, best: dict[str, float]) -> list[str]:
    """Rows of a LaTeX table; values equal to a column's best, at four places, in bold."""
    out = []
    for r in table.collect():
        cells = []
        for name, x in zip(table.columns, r, strict=True):
            text = "---" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)
            top = name in best and isinstance(x, float) and round(x, 4) == round(best[name], 4)
            cells.append(f"\\textbf{{{text}}}" if top else text)
        out.append(" & ".join(cells) + r" \\")
    return out


def report(sections: list[tuple[str, DataFrame]], path: str) -> str:
    """Sections in their order as one Markdown file, byte for byte the same for the same tables."""
    text = "".join(f"## {title}\n\n{markdown(table)}\n" for title, table in sections)
    with open(path, "w", encoding="utf-8") as file:
        file.write(text)
    return text
