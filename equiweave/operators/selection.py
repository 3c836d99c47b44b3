"""Selection policies over eligible items (graph_id, uri, items array<struct<n, predicate, text>>)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiweave import schema
from equiweave.functions.budget import Counter, count_input, greedy_select, shuffled, tier_sample
from equiweave.functions.text import estimate_tokens
from equiweave.operators.labels import cost_text, star
from equiweave.operators.verbalise import tier_of
from equiweave.vocabulary import LABEL, RENDER_ORDERS, ROLE_ORDER, ROLES_V1, TIERS, VOCABULARIES

ORDER_MODES = ("full", "ppas", "deterministic", "random", "core_first", "label_first", "role_priority")
SEPARATOR = " | "


def covered_filter(items: Column, vocabulary: str, mode: str) -> Column:
    """Items whose predicate the vocabulary covers (mode covered) or all."""
    if mode not in ("all", "covered"):
        raise ValueError(f"unknown filter mode {mode!r}")
    return items if mode == "all" else F.filter(items, lambda x: x["predicate"].isin(sorted(VOCABULARIES[vocabulary].covered)))


def coverage(items: Column, kept: Column) -> Column:
    """Share of distinct predicates that are kept; 1 without items."""
    def distinct(x: Column) -> Column:
        return F.size(F.array_distinct(F.transform(x, lambda y: y["predicate"])))

    return F.coalesce(F.try_divide(distinct(kept).cast("double"), distinct(items).cast("double")), F.lit(1.0))


def count_covered(items: Column, vocabulary: str) -> Column:
    return F.size(covered_filter(items, vocabulary, "covered"))


def count_tiered(items: Column, entity_type: Column, tiers: dict[str, list[list[str]]] = TIERS) -> Column:
    return F.size(F.filter(items, lambda x: tier_of(x["predicate"], entity_type, tiers) < 99))


def role_of(predicate: Column) -> Column:
    """Role in the role map; an unmapped predicate raises, even if it would be kept."""
    roles = F.create_map(*[F.lit(x) for pair in ROLES_V1.items() for x in pair])
    found = F.element_at(roles, predicate)
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("no role for predicate "), predicate)).cast("string"))


def role_filter(items: Column, excluded: list[str]) -> Column:
    """Items outside the excluded roles."""
    return F.filter(items, lambda x: ~role_of(x["predicate"]).isin(excluded)) if excluded else items


def serial_group(predicate: Column, order: str) -> Column:
    """Group of a predicate in a render order: uri has one group, core and label two, role ten."""
    if order == "uri":
        return F.lit(0)
    if order == "label":
        return (predicate != LABEL).cast("int")
    if order == "core":
        return (role_of(predicate) != "core").cast("int")
    if order != "role":
        raise ValueError(f"unknown order {order!r}; expected one of {RENDER_ORDERS}")
    cases = F.lit(None).cast("int")
    for k, name in reversed(list(enumerate(ROLE_ORDER))):
        cases = F.when(predicate == name if ":" in name else role_of(predicate) == name, k).otherwise(cases)
    return cases


def ordered(items: Column, group: Callable[[Column], Column]) -> Column:
    """Items by group, canonical order inside."""
    keyed = F.transform(items, lambda x: F.struct(group(x["predicate"]).alias("g"), x["n"].alias("n"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda y: y["x"])


def tier_order(items: Column, entity_type: Column, tiers: dict[str, list[list[str]]] = TIERS) -> Column:
    return ordered(items, lambda p: tier_of(p, entity_type, tiers))


def core_first(items: Column) -> Column:
    return ordered(items, lambda p: serial_group(p, "core"))


def check_mode(order_mode: str, tokens: int | None, seed: int | None) -> None:
    if order_mode not in ORDER_MODES:
        raise ValueError(f"unknown order mode {order_mode!r}")
    if (order_mode == "full") != (tokens is None):
        raise ValueError("only the full policy has no budget")
    if (order_mode == "random") != (seed is not None):
        raise ValueError("only the random policy has a seed")
    if tokens is not None and tokens <= 0:
        raise ValueError("the budget must be positive")


def select(
    entities: DataFrame, order_mode: str, tokens: int | None = None, seed: int | None = None, filter_mode: str = "all", vocabulary: str = "base",
    excluded_roles: list[str] | None = None, render_order: str = "uri", counter: Counter = count_input,
) -> DataFrame:
    """entities (graph_id, uri, entity_type, items) with the selection struct: text and its accounting.

    Filters and orders are column functions; one Arrow UDF counts tokens and takes items greedily.
    A text that fits whole is never sampled, so all policies agree there.
    """
    check_mode(order_mode, tokens, seed)
    words = VOCABULARIES[vocabulary]
    kept = entities.withColumn("covered", covered_filter(F.col("items"), vocabulary, filter_mode))
    kept = kept.withColumn("kept", role_filter(F.col("covered"), excluded_roles or []))
    visiting = {
        "ppas": lambda x: tier_order(x, F.col("entity_type"), words.tiers),
        "core_first": core_first,
        "label_first": lambda x: ordered(x, lambda p: serial_group(p, "label")),
        "role_priority": lambda x: ordered(x, lambda p: serial_group(p, "role")),
    }.get(order_mode, lambda x: x)(F.col("kept"))
    written = ordered(F.col("kept"), lambda p: serial_group(p, render_order)) if render_order != "uri" else F.col("kept")
    def places(column: Column) -> Column:
        return F.transform(column, lambda x: F.array_position(F.transform("kept", lambda y: y["n"]), x["n"]).cast("int") - 1)

    def run(uris: pd.Series, texts: pd.Series, orders: pd.Series, renders: pd.Series) -> pd.DataFrame:
        rows = []
        for uri, t, order, render in zip(uris, texts, orders, renders, strict=True):
            t, order, render = list(t), list(order), list(render)
            whole = SEPARATOR.join(t[i] for i in render)
            n = counter(whole)
            if tokens is None or n <= tokens:
                rows.append((whole, list(range(len(t))), len(t), n, False, 0))
                continue
            taken = set(greedy_select(t, shuffled(len(t), seed, uri) if order_mode == "random" else order, tokens, counter))
            text = SEPARATOR.join(t[i] for i in render if i in taken)
            rows.append((text, sorted(taken), len(t), counter(text), True, sum(counter(x) > tokens for x in t)))
        return pd.DataFrame(rows, columns=["text", "selected", "n_items", "n_tokens", "truncated", "n_oversized"])

    kind = schema.SELECTION.split(", filter_mode")[0]
    texts = F.transform("kept", lambda x: x["text"])
    made = kept.withColumn("chosen", F.pandas_udf(run, kind)("uri", texts, places(visiting), places(written)))
    return made.select(
        "graph_id", "uri", "entity_type", "chosen.*", F.lit(filter_mode).alias("filter_mode"), F.lit(order_mode).alias("order_mode"), F.lit(vocabulary).alias("predicate_config_name"),
        count_covered(F.col("items"), vocabulary).alias("n_covered_items"), count_tiered(F.col("kept"), F.col("entity_type"), words.tiers).alias("n_tiered_items"),
        (F.size("items") - F.size("covered")).alias("n_filtered_items"), coverage(F.col("items"), F.col("covered")).alias("predicate_coverage"),
        (F.size("covered") - F.size("kept")).alias("n_role_removed_items"),
    )


def sample_triples(triples: DataFrame, entities: DataFrame, tokens: int) -> DataFrame:
    """graph_id, uri, taken array<int>: canonical places taken tier by tier at estimated costs."""
    rows = star(triples).withColumnRenamed("s", "uri").join(entities, ["graph_id", "uri"])
    rows = rows.withColumn("tier", tier_of(F.col("p"), F.col("entity_type"))).withColumn("cost", estimate_tokens(cost_text(rows)))
    run_ = F.array_sort(F.collect_list(F.struct("n", "tier", "cost")))

    def run(runs: pd.Series) -> pd.Series:
        return pd.Series([[x[i]["n"] for i in tier_sample([y["cost"] for y in x], [y["tier"] for y in x], tokens, 6)] for x in runs])

    lists = rows.groupBy("graph_id", "uri").agg(run_.alias("run"))
    return lists.select("graph_id", "uri", F.pandas_udf(run, "array<int>")("run").alias("taken"))


def summary(selections: DataFrame, limit: int, *by: str) -> DataFrame:
    """Counts, means, medians, 90th percentiles, maxima and totals of selections, truncation and utilisation."""
    def spread(column: str) -> list[Column]:
        c = F.col(column).cast("double")
        return [F.avg(c).alias(f"mean_{column}"), F.percentile(c, F.lit(0.5)).alias(f"median_{column}"), F.percentile(c, F.lit(0.9)).alias(f"p90_{column}"), F.max(column).alias(f"max_{column}"), F.sum(column).alias(f"total_{column}")]

    n = F.col("n_tokens")
    return selections.groupBy(*by).agg(
        F.count("*").alias("n_entities"), *spread("n_tokens"), *spread("n_items"),
        F.count_if("truncated").alias("n_sampled"), F.sum("n_oversized").alias("n_oversized"),
        F.count_if(n > limit).alias("n_over_limit"), F.sum(F.greatest(n - limit, F.lit(0))).alias("tokens_over_limit"),
        (F.sum(F.least(n, F.lit(limit))) / (F.count("*") * limit)).alias("utilisation"),
    )


def removed_by_role(entities: DataFrame, excluded: list[str], tokens: Callable[[Column], Column] = estimate_tokens) -> DataFrame:
    """role, n_items, n_entities, n_tokens of the items that a role filter removes."""
    rows = entities.select("graph_id", "uri", F.explode("items").alias("x")).withColumn("role", role_of(F.col("x.predicate"))).where(F.col("role").isin(excluded))
    return rows.groupBy("role").agg(F.count("*").alias("n_items"), F.countDistinct("graph_id", "uri").alias("n_entities"), F.sum(tokens(F.col("x.text"))).alias("n_tokens"))


def role_inventory(entities: DataFrame) -> DataFrame:
    """role, n_items, n_entities, token_share."""
    rows = entities.select("graph_id", "uri", F.explode("items").alias("x")).select("graph_id", "uri", role_of(F.col("x.predicate")).alias("role"), estimate_tokens(F.col("x.text")).alias("tokens"))
    per = rows.groupBy("role").agg(F.count("*").alias("n_items"), F.countDistinct("graph_id", "uri").alias("n_entities"), F.sum("tokens").alias("tokens"))
    from pyspark.sql.window import Window

    return per.select("role", "n_items", "n_entities", (F.col("tokens") / F.sum("tokens").over(Window.partitionBy())).alias("token_share"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """graph_id, uri, lost, gained: texts of two item tables that differ."""
    def texts(table: DataFrame, name: str) -> DataFrame:
        return table.select("graph_id", "uri", F.transform("items", lambda x: x["text"]).alias(name))

    both = texts(before, "a").join(texts(after, "b"), ["graph_id", "uri"], "full_outer")
    both = both.select("graph_id", "uri", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("a", "b")])
    return both.select("graph_id", "uri", F.array_except("a", "b").alias("lost"), F.array_except("b", "a").alias("gained")).where("size(lost) > 0 or size(gained) > 0")
