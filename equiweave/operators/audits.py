"""Audits of graphs, references, runs and stored results: ceilings, densities, strata, gates and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiweave import schema
from equiweave.functions.text import estimate_tokens
from equiweave.operators import stats
from equiweave.operators.metrics import ratio
from equiweave.operators.stats import paired_means
from equiweave.vocabulary import LABEL, LABELS_D, TYPE, expand

# The predicates whose presence makes an entity's annotation density.
DENSITY = [expand(p) for p in (
    "rdfs:label", "rdfs:comment", "skos:prefLabel", "skos:altLabel", "skos:definition", "owl:equivalentClass", "owl:equivalentProperty",
)]
# Types and hierarchy predicates of the entities that are counted.
DENSE_TYPES = [expand("owl:Class"), expand("owl:ObjectProperty")]
HIERARCHY = [expand("rdfs:subClassOf"), expand("rdfs:subPropertyOf")]
# An opaque identifier, and a literal with its datatype inlined.
OPAQUE = r"\b[EQ]\d{3,}\b"
INLINED = r'(?s)^".*"\^\^<([^>]*)>$'
XSD = "http://www.w3.org/2001/XMLSchema#"


# ---------------------------------------------------------------- references and candidates


def ceilings(ranked: DataFrame, refs: DataFrame) -> DataFrame:
    """pair, n_refs, n_sources, n_multi_target, n_gold_listed, n_refs_listed, ranking_ceiling, candidate_recall, f1_recall_ceiling.

    What the best order of the listed candidates could reach. refs: pair, s, t; repeated rows count in n_refs.
    """
    listed = ranked.select("pair", "s", "t").distinct().withColumn("listed", F.lit(1))
    rows = refs.select("pair", "s", "t").join(listed, ["pair", "s", "t"], "left")
    per = rows.groupBy("pair", "s").agg(F.count("*").alias("n"), F.countDistinct("t").alias("k"), F.count("listed").alias("hits"))
    out = per.groupBy("pair").agg(
        F.sum("n").alias("n_refs"), F.count("*").alias("n_sources"), F.count_if(F.col("k") > 1).alias("n_multi_target"),
        F.count_if(F.col("hits") > 0).alias("n_gold_listed"), F.sum("hits").alias("n_refs_listed"),
    )
    return out.select(
        "*", ratio(F.col("n_gold_listed"), F.col("n_sources")).alias("ranking_ceiling"), ratio(F.col("n_refs_listed"), F.col("n_refs")).alias("candidate_recall"),
        ratio(F.col("n_gold_listed"), F.col("n_refs")).alias("f1_recall_ceiling"),
    )


def column_ceilings(ceilings_: DataFrame, columns: DataFrame) -> DataFrame:
    """dataset, ranking_ceiling, f1_recall_ceiling: means over the pairs of each column (dataset, pair)."""
    rows = ceilings_.join(columns.select("dataset", "pair"), "pair")
    return rows.groupBy("dataset").agg(F.avg("ranking_ceiling").alias("ranking_ceiling"), F.avg("f1_recall_ceiling").alias("f1_recall_ceiling"))


def validation_lists(lists: DataFrame, refs: DataFrame) -> DataFrame:
    """Rows (pair, s) of lists whose source is a validation reference source; one that is also a test source fails.

    A semi join, so what is encoded or ranked afterwards is that of validation sources only.
    """
    levels = refs.groupBy("pair", "s").agg(F.bool_or(F.col("split") == "val").alias("val"), F.bool_or(F.col("split") == "test").alias("test"))
    fault = F.raise_error(F.concat(F.lit("a validation source is also a test source: "), "s")).cast("boolean")
    wanted = levels.where("val").where(~F.col("test") | fault).select("pair", "s")
    return lists.join(wanted, ["pair", "s"], "left_semi")


# ---------------------------------------------------------------- graphs


def annotation_density(triples: DataFrame) -> DataFrame:
    """graph_id, n_entities, density, label_coverage: mean distinct annotation predicates, and share with a label, of classes and object properties."""
    counted = ((F.col("p") == TYPE) & F.col("o").isin(DENSE_TYPES)) | F.col("p").isin(HIERARCHY)
    rows = triples.where("s_kind = 'uri'").groupBy("graph_id", "s").agg(
        F.bool_or(counted).alias("counts"), F.countDistinct(F.when(F.col("p").isin(DENSITY), F.col("p"))).alias("n"),
        F.bool_or(F.col("p").isin(LABELS_D)).cast("double").alias("labelled"),
    )
    return rows.where("counts").groupBy("graph_id").agg(F.count("*").alias("n_entities"), F.avg("n").alias("density"), F.avg("labelled").alias("label_coverage"))


def sparsity_rows(pairs: DataFrame, densities: DataFrame, scores: DataFrame, a: str, b: str) -> DataFrame:
    """pair, min_density, max_density, score_a, score_b, gap of pairs (pair, source, target) that have everything, sparsest first.

    densities: annotation_density; scores: condition, pair, value.
    """
    def side(name: str) -> DataFrame:
        return densities.select(F.col("graph_id").alias(name), F.col("density").alias(f"{name}_density"))

    def score(condition: str, name: str) -> DataFrame:
        return scores.where(F.col("condition") == condition).select("pair", F.col("value").alias(name))

    rows = pairs.join(side("source"), "source").join(side("target"), "target").join(score(a, "score_a"), "pair").join(score(b, "score_b"), "pair")
    low, high = F.least("source_density", "target_density"), F.greatest("source_density", "target_density")
    return rows.select("pair", low.alias("min_density"), high.alias("max_density"), "score_a", "score_b", (F.col("score_a") - F.col("score_b")).alias("gap")).orderBy("min_density", "pair")


def shared_identifiers(triples: DataFrame, source: str, target: str) -> DataFrame:
    """source, target, shared: distinct last path segments of the objects of two graphs."""
    names = triples.where((F.col("o_kind") == "uri") & F.col("graph_id").isin(source, target)).select(F.regexp_extract("o", "([^/]*)$", 1).alias("name"), "graph_id")
    per = names.groupBy("name").agg(F.bool_or(F.col("graph_id") == source).alias("a"), F.bool_or(F.col("graph_id") == target).alias("b"))
    return per.agg(F.count_if("a").alias("source"), F.count_if("b").alias("target"), F.count_if(F.col("a") & F.col("b")).alias("shared"))


def opaque_share(texts: DataFrame, tokens=estimate_tokens) -> DataFrame:
    """tokens, id_tokens, id_token_share, texts_with_id_share of opaque identifiers in texts (text)."""
    whole, without = tokens(F.col("text")), tokens(F.regexp_replace("text", OPAQUE, ""))
    return texts.agg(
        F.sum(whole).alias("tokens"), F.sum(whole - without).alias("id_tokens"), (F.sum(whole - without) / F.greatest(F.sum(whole), F.lit(1))).alias("id_token_share"),
        F.avg(F.regexp_like("text", F.lit(OPAQUE)).cast("double")).alias("texts_with_id_share"),
    )


def unit_datatypes(triples: DataFrame) -> DataFrame:
    """datatype, n of the inlined datatypes outside XML Schema, by their last path segment, most frequent first."""
    uri = F.regexp_extract("o", INLINED, 1)
    rows = triples.where((F.col("o_kind") == "lit") & F.regexp_like("o", F.lit(INLINED))).where(~uri.startswith(XSD))
    return rows.groupBy(F.regexp_extract(uri, "([^/]*)$", 1).alias("datatype")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "datatype")


def label_retention(items: DataFrame, kept: DataFrame) -> DataFrame:
    """n_entities, n_with_label, n_label_kept, label_retention, median_label_offset, share_label_first.

    items and kept: graph_id, uri, items (structs of predicate and text), before and after a budget;
    the offset is the estimated tokens before the first label item of what was kept.
    """
    def is_label(x: Column) -> Column:
        return x["predicate"] == LABEL

    have = items.select("graph_id", "uri", F.exists("items", is_label).alias("has"))
    place = F.array_position(F.transform("items", is_label), F.lit(True)).cast("int")
    before = F.aggregate(F.slice("items", F.lit(1), F.greatest(place - 1, F.lit(0))), F.lit(0), lambda total, x: total + estimate_tokens(x["text"]))
    found = kept.select("graph_id", "uri", F.when(place > 0, before).alias("offset"))
    rows = have.join(found, ["graph_id", "uri"], "left")
    return rows.agg(
        F.count("*").alias("n_entities"), F.count_if("has").alias("n_with_label"), F.count("offset").alias("n_label_kept"),
        F.try_divide(F.count("offset").cast("double"), F.count_if("has").cast("double")).alias("label_retention"), F.percentile("offset", F.lit(0.5)).alias("median_label_offset"),
        F.try_divide(F.count_if(F.col("offset") == 0).cast("double"), F.count("offset").cast("double")).alias("share_label_first"),
    )


# ---------------------------------------------------------------- comparisons


def strata(a: DataFrame, b: DataFrame, outcomes: DataFrame) -> DataFrame:
    """stratum (all, changed, unchanged) and unit of outcomes (unit): a unit is changed if the texts of a and b (unit, text) differ.

    A unit whose own text and whose candidates' texts agree in both runs is unchanged; texts holds one row for each of them.
    """
    x, y = a.select("unit", F.col("text").alias("x")), b.select("unit", F.col("text").alias("y"))
    differing = x.join(y, "unit", "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select("unit").distinct().withColumn("differs", F.lit(True))
    rows = outcomes.select("unit").distinct().join(differing, "unit", "left")
    kind = F.when(F.coalesce("differs", F.lit(False)), "changed").otherwise("unchanged")
    return rows.select(F.explode(F.array(F.lit("all"), kind)).alias("stratum"), "unit")


def stratum_contrasts(units: DataFrame, strata_: DataFrame, replicates: int = 2_000) -> DataFrame:
    """stratum, delta, ci_low, ci_high, n of the mean of b - a of units (unit, a, b); all replicates come from the stratum's own seed."""
    rows = strata_.join(units, "unit").select(F.col("stratum").alias("comparison"), "unit", "a", "b")
    return paired_means(rows, replicates).withColumnRenamed("comparison", "stratum")


def comparison_rows(comparisons: DataFrame, units: DataFrame, metrics: tuple[str, ...] = ("mrr", "hits_at_1", "f1"), replicates: int = stats.REPLICATES) -> DataFrame:
    """One row for each registered comparison (comparison, a, b, dataset) and metric: tested, the reason if not, and the test's numbers.

    A comparison is untestable where a condition has no units on the column, or where the two
    describe other pairs or reference sources; that never stops the others.
    """
    wanted = comparisons.select("comparison", "a", "b", "dataset", F.explode(F.array(*map(F.lit, metrics))).alias("metric"))
    described = units.where("metric = 'mrr'").groupBy("condition", "dataset").agg(F.sha2(F.to_json(F.array_sort(F.collect_set(F.struct("pair", "unit")))), 256).alias("digest"))

    def side(letter: str) -> DataFrame:
        return described.select(F.col("condition").alias(letter), "dataset", F.col("digest").alias(f"digest_{letter}"))

    rows = wanted.join(side("a"), ["a", "dataset"], "left").join(side("b"), ["b", "dataset"], "left")
    reason = (
        F.when(F.col("digest_a").isNull(), F.concat(F.lit("no results of "), "a")).when(F.col("digest_b").isNull(), F.concat(F.lit("no results of "), "b"))
        .when(F.col("digest_a") != F.col("digest_b"), "other references")
    )
    rows = rows.withColumn("reason", reason).drop("digest_a", "digest_b")
    testable = rows.where("reason is null").select("comparison", "a", "b", "dataset").distinct()
    key = ["comparison", "dataset", "metric", "pair", "unit"]

    def values(letter: str) -> DataFrame:
        own = units.join(testable.select("comparison", "dataset", F.col(letter).alias("condition")), ["condition", "dataset"])
        return own.select(*key, *[F.col(f"c{i}").alias(f"{letter}{i}") for i in (1, 2, 3)])

    both = values("a").join(values("b"), key, "full_outer").select(*key, *[F.coalesce(f"{x}{i}", F.lit(0.0)).alias(f"{x}{i}") for x in "ab" for i in (1, 2, 3)])
    tests = stats.paired_tests(both.where(F.col("metric").isin(list(metrics))), replicates)
    return rows.join(tests, ["comparison", "dataset", "metric"], "left").withColumn("tested", F.col("reason").isNull() & F.col("p_value").isNotNull())


def against_baseline(units: DataFrame, conditions: DataFrame, baseline: str, replicates: int = stats.REPLICATES) -> DataFrame:
    """comparison_rows of every condition (condition, dataset) against the baseline, MRR rows with Holm's adjustment by column; untested cells count in their family."""
    wanted = conditions.where(F.col("condition") != baseline).select(F.col("condition").alias("comparison"), F.lit(baseline).alias("a"), F.col("condition").alias("b"), "dataset")
    rows = comparison_rows(wanted, units, replicates=replicates)
    adjusted = stats.holm(rows.where("metric = 'mrr'"), ["dataset"], "comparison", complete=True)
    return rows.where("metric <> 'mrr'").withColumn("p_adjusted", F.lit(None).cast("double")).unionByName(adjusted.withColumn("p_adjusted", F.when(F.col("tested"), F.col("p_adjusted"))))


def condition_rows(columns: DataFrame, a: str, b: str, metric: str) -> DataFrame:
    """dataset_id, a, b, delta of two conditions' column means, where both are there."""
    def side(condition: str, name: str) -> DataFrame:
        return columns.where(F.col("condition_id") == condition).select("dataset_id", F.col(metric).alias(name))

    return side(a, "a").join(side(b, "b"), "dataset_id").withColumn("delta", F.col("b") - F.col("a"))


def reproduction(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """n, n_equal, reproduced: whether all rows of two tables agree in all fields exactly, none missing."""
    x = old.select(*keys, F.struct(*fields).alias("x"))
    y = new.select(*keys, F.struct(*fields).alias("y"))
    rows = x.join(y, keys, "full_outer")
    same = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("x").eqNullSafe(F.col("y"))
    return rows.agg(F.count("*").alias("n"), F.count_if(same).alias("n_equal"), (F.count_if(same) == F.count("*")).alias("reproduced"))


# ---------------------------------------------------------------- gates and provenance


def identity_gate(a: DataFrame, b: DataFrame, value: str, limit: int | None = None) -> DataFrame:
    """n, n_missing, n_different, n_over, passed: whether two runs (uri, value [, n_tokens]) hold the same value of each entity, all within the limit."""
    x = a.select("uri", F.col(value).alias("x"), F.lit(True).alias("in_a"), *([F.col("n_tokens")] if limit is not None else []))
    y = b.select("uri", F.col(value).alias("y"), F.lit(True).alias("in_b"))
    rows = x.join(y, "uri", "full_outer")
    missing = F.col("in_a").isNull() | F.col("in_b").isNull()
    over = F.col("n_tokens") > limit if limit is not None else F.lit(False)
    out = rows.agg(F.count("*").alias("n"), F.count_if(missing).alias("n_missing"), F.count_if(~missing & ~F.col("x").eqNullSafe(F.col("y"))).alias("n_different"), F.count_if(over).alias("n_over"))
    return out.withColumn("passed", (F.col("n_missing") + F.col("n_different") + F.col("n_over")) == 0)


def provenance_flags(results: DataFrame, known_pairs: dict[str, int]) -> DataFrame:
    """results' keys and reasons why one cannot be combined with current results; an empty list if it can.

    results: condition_id, dataset_id, pair_name, git_dirty, evaluation_protocol, n_train_refs, candidates_sha256.
    """
    hashes = results.groupBy("dataset_id", "pair_name").agg(F.countDistinct(F.coalesce("candidates_sha256", F.lit(""))).alias("n_hashes"))
    needed = F.lit(None).cast("int")
    for dataset, n in known_pairs.items():
        needed = F.when(F.col("dataset_id") == dataset, n).otherwise(needed)
    reasons = F.array(
        F.when(F.coalesce("git_dirty", F.lit(True)), "dirty or unknown tree"),
        F.when(~F.col("evaluation_protocol").eqNullSafe(F.lit(schema.PROTOCOL)), F.concat(F.lit("protocol "), F.coalesce(F.col("evaluation_protocol").cast("string"), F.lit("none")))),
        F.when(needed.isNotNull() & ~F.col("n_train_refs").eqNullSafe(needed), "other known pairs"),
        F.when(F.col("n_hashes") > 1, "candidate hash differs within the pair"),
    )
    return results.join(hashes, ["dataset_id", "pair_name"]).select("condition_id", "dataset_id", "pair_name", F.array_compact(reasons).alias("reasons"))


def provenance_groups(results: DataFrame, fields: list[str]) -> DataFrame:
    """fields, n, conditions of results that were made alike."""
    return results.groupBy(*fields).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("condition_id")), ",").alias("conditions"))

