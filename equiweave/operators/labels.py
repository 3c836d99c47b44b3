"""Choices of a label among literals. The rules differ on purpose; each is one grouped aggregation.

"First" is the smallest `ord`, which the readers carry; it never depends on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiweave.functions.text import literal_text, local_name_a, local_name_b, local_name_c, or_else, plain_literal_text
from equiweave.operators.entities import entities
from equiweave.vocabulary import DEFINITIONS, LABEL, LABELS_ABC, LABELS_D, PREF_LABEL, SAME_AS, SYNONYMS, TYPE


def _place(predicates: list[str]) -> Column:
    """Position of p in the list, null outside."""
    return F.nullif(F.array_position(F.array(*map(F.lit, predicates)), F.col("p")), F.lit(0))


def _literals(triples: DataFrame, predicates: list[str]) -> DataFrame:
    return triples.where((F.col("o_kind") == "lit") & F.col("p").isin(predicates))


def _english_or_plain() -> Column:
    return F.coalesce(F.lower("o_lang"), F.lit("en")) == "en"


def label_a(triples: DataFrame) -> DataFrame:
    """graph_id, uri, label of every entity: literal tagged en, else untagged, else any; rdfs:label, else skos:prefLabel, else the local name."""
    rank = F.when(F.lower("o_lang") == "en", 0).when(F.col("o_lang").isNull(), 1).otherwise(2)
    chosen = _literals(triples, LABELS_D).groupBy("graph_id", F.col("s").alias("uri")).agg(
        *[F.min_by(F.when(F.col("p") == p, F.col("o")), F.when(F.col("p") == p, F.struct(rank, F.col("ord")))).alias(name) for p, name in ((LABEL, "l1"), (PREF_LABEL, "l2"))]
    )
    return entities(triples).join(chosen, ["graph_id", "uri"], "left").select("graph_id", "uri", F.coalesce("l1", "l2", local_name_a(F.col("uri"))).alias("label"))


def attribute_text(triples: DataFrame, most: int = 10, shortest: int = 3, longest: int = 200) -> DataFrame:
    """graph_id, uri, attr: an entity's literal values by (predicate, text), without bare quantities, dates excepted."""
    text = literal_text(F.col("o"))
    quantity = text.rlike(r"^[+-]?[\d.,]+(?:[eE][+-]?\d+)?$") & ~text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    rows = triples.where("o_kind = 'lit'").select("graph_id", F.col("s").alias("uri"), "p", text.alias("x"), quantity.alias("bare"))
    rows = rows.where(F.length("x").between(shortest, longest) & ~F.col("bare"))
    values = F.slice(F.array_sort(F.collect_list(F.struct("p", "x"))), 1, most)
    return rows.groupBy("graph_id", "uri").agg(F.array_join(F.transform(values, lambda v: v["x"]), " ").alias("attr"))


def label_b(triples: DataFrame, uris: DataFrame | None = None) -> DataFrame:
    """graph_id, uri, label: first English or untagged literal of rdfs:label, then skos:prefLabel; else the local
    name, for which an opaque id (E or Q and digits) gives way to attribute text."""
    uris = entities(triples) if uris is None else uris
    first = _literals(triples, LABELS_D).where(_english_or_plain()).groupBy("graph_id", F.col("s").alias("uri")).agg(
        F.min_by("o", F.struct(_place(LABELS_D), "ord")).alias("first"),
        F.min_by(F.when(F.col("p") == PREF_LABEL, F.col("o")), F.when(F.col("p") == PREF_LABEL, F.col("ord"))).alias("second"),
    )
    name = local_name_b(F.col("uri"))
    fallback = F.when(name.rlike(r"^[EQ]\d+$"), or_else(F.col("attr"), name)).otherwise(name)
    joined = uris.join(first, ["graph_id", "uri"], "left").join(attribute_text(triples), ["graph_id", "uri"], "left")
    return joined.select("graph_id", "uri", or_else(F.col("first"), F.col("second"), fallback).alias("label"))


def _english_first(triples: DataFrame, predicates: list[str], name: str) -> DataFrame:
    """English literals of all predicates before untagged ones; other languages never."""
    rows = _literals(triples, predicates).where("o_lang is null or o_lang = 'en'")
    value = plain_literal_text(F.col("o"), F.col("o_lang"), F.col("o_dtype"))
    key = F.struct(F.col("o_lang").isNull().cast("int"), _place(predicates), F.col("ord"))
    return rows.groupBy("graph_id", F.col("s").alias("uri")).agg(F.min_by(value, key).alias(name))


def label_c_of_group() -> Column:
    """Label C as an aggregate over all of a subject's triples."""
    ours = (F.col("o_kind") == "lit") & F.col("p").isin(LABELS_ABC) & (F.col("o_lang").isNull() | (F.col("o_lang") == "en"))
    value = plain_literal_text(F.col("o"), F.col("o_lang"), F.col("o_dtype"))
    return F.min_by(F.when(ours, value), F.when(ours, F.struct(F.col("o_lang").isNull().cast("int"), _place(LABELS_ABC), F.col("ord"))))


def label_c(triples: DataFrame) -> DataFrame:
    """graph_id, uri, label where there is one: over rdfs:label, skos:prefLabel, skos:altLabel."""
    return _english_first(triples, LABELS_ABC, "label")


def label_d(triples: DataFrame) -> DataFrame:
    """As label_c, without skos:altLabel."""
    return _english_first(triples, LABELS_D, "label")


def predicate_labels(triples: DataFrame) -> DataFrame:
    """graph_id, p, p_label of each subject with an rdfs:label tagged exactly en or untagged: the first."""
    rows = _literals(triples, [LABEL]).where("o_lang is null or o_lang = 'en'")
    return rows.groupBy("graph_id", F.col("s").alias("p")).agg(F.min_by("o", "ord").alias("p_label"))


def label_e(triples: DataFrame) -> DataFrame:
    """graph_id, p, label of each predicate in use: first rdfs:label tagged exactly en or untagged, else the local name."""
    used = triples.select("graph_id", "p").distinct()
    return used.join(predicate_labels(triples), ["graph_id", "p"], "left").select("graph_id", "p", F.coalesce("p_label", local_name_c(F.col("p"))).alias("label"))


def label_or_local(triples: DataFrame, uris: DataFrame) -> DataFrame:
    """graph_id, uri, label: label C, where empty or missing the local name."""
    return uris.join(label_c(triples).hint("merge"), ["graph_id", "uri"], "left").select("graph_id", "uri", or_else(F.col("label"), local_name_c(F.col("uri"))).alias("label"))


def labels_cd(triples: DataFrame) -> DataFrame:
    """graph_id, uri, c, d: label C and label D of each entity that has one, in one pass."""
    rows = _literals(triples, LABELS_ABC).where("o_lang is null or o_lang = 'en'")
    value, tagged = plain_literal_text(F.col("o"), F.col("o_lang"), F.col("o_dtype")), F.col("o_lang").isNull().cast("int")
    own = F.col("p").isin(LABELS_D)
    return rows.groupBy("graph_id", F.col("s").alias("uri")).agg(
        F.min_by(value, F.struct(tagged, _place(LABELS_ABC), F.col("ord"))).alias("c"),
        F.min_by(F.when(own, value), F.when(own, F.struct(tagged, _place(LABELS_D), F.col("ord")))).alias("d"),
    )


def labelled(triples: DataFrame, rows: DataFrame, column: str, name: str = "label") -> DataFrame:
    """rows with label C of the URI in a column, where empty or missing its local name; rows are not read twice for it."""
    own = label_c(triples).select("graph_id", F.col("uri").alias(column), F.col("label").alias("_label"))
    return rows.join(own, ["graph_id", column], "left").withColumn(name, or_else(F.col("_label"), local_name_c(F.col(column)))).drop("_label")


def _distinct_in_order(rows: DataFrame) -> DataFrame:
    """graph_id, uri, vals of rows (graph_id, uri, k1, k2, k3, value): first occurrences in key order."""
    run = F.array_sort(F.collect_list(F.struct("k1", "k2", "k3", "value")))
    return rows.groupBy("graph_id", "uri").agg(F.array_distinct(F.transform(run, lambda x: x["value"])).alias("vals"))


def all_literals(triples: DataFrame, predicates: list[str]) -> DataFrame:
    """graph_id, uri, vals: distinct literals tagged exactly en or untagged, by predicate and order."""
    rows = _literals(triples, predicates).where("o_lang is null or o_lang = 'en'")
    value = plain_literal_text(F.col("o"), F.col("o_lang"), F.col("o_dtype"))
    return _distinct_in_order(rows.select("graph_id", F.col("s").alias("uri"), _place(predicates).alias("k1"), F.col("ord").alias("k2"), F.lit(0).alias("k3"), value.alias("value")))


def annotation_lists(triples: DataFrame, **groups: list[str]) -> DataFrame:
    """graph_id, uri and for each group of predicates the array of its values; see annotation_values.

    One pass for all groups. Literals and the nodes that have them meet by merging, as either may be as
    many as the triples, which the planner does not see from the files' sizes.
    """
    wanted = sorted({p for predicates in groups.values() for p in predicates})
    allowed = F.col("o_lang").isNull() | (F.lower("o_lang") == "en") | F.lower("o_lang").startswith("en-")
    value = plain_literal_text(F.col("o"), F.col("o_lang"), F.col("o_dtype"))
    own = _literals(triples, wanted).where(allowed).select(
        "graph_id", F.col("s").alias("uri"), "p", F.col("ord").alias("k2"), F.lit(0).cast("bigint").alias("k3"), value.alias("value")
    )
    nodes = triples.where((F.col("o_kind") != "lit") & F.col("p").isin(wanted)).select("graph_id", F.col("s").alias("uri"), "p", F.col("ord").alias("k2"), F.col("o").alias("node"))
    labels = _literals(triples, [LABEL]).where(allowed).select("graph_id", F.col("s").alias("node"), F.col("ord").alias("k3"), value.alias("value"))
    reified = nodes.join(labels.hint("merge"), ["graph_id", "node"]).select("graph_id", "uri", "p", "k2", "k3", "value")

    def values(predicates: list[str]) -> Column:
        run = F.array_sort(F.collect_list(F.when(F.col("p").isin(predicates), F.struct(_place(predicates).alias("k1"), "k2", "k3", "value"))))
        return F.array_distinct(F.transform(run, lambda x: x["value"]))

    return own.unionByName(reified).groupBy("graph_id", "uri").agg(*[values(predicates).alias(name) for name, predicates in groups.items()])


def annotation_values(triples: DataFrame, predicates: list[str]) -> DataFrame:
    """graph_id, uri, vals: literals tagged en, en-* or untagged; other objects give their own rdfs:label literals."""
    return annotation_lists(triples, vals=predicates)


def synonyms(triples: DataFrame) -> DataFrame:
    return annotation_values(triples, SYNONYMS)


def definitions(triples: DataFrame) -> DataFrame:
    """graph_id, uri, definition: the first annotation value of the definition predicates."""
    return annotation_values(triples, DEFINITIONS).select("graph_id", "uri", F.get("vals", F.lit(0)).alias("definition"))


def star(triples: DataFrame) -> DataFrame:
    """Triples of entity stars with place n (from 0) in canonical order (p, o): no owl:sameAs, blank objects or reflexive triples."""
    from pyspark.sql.window import Window

    kept = triples.where((F.col("p") != SAME_AS) & (F.col("o_kind") != "bnode") & ~((F.col("o_kind") == "uri") & (F.col("o") == F.col("s"))))
    order = Window.partitionBy("graph_id", "s").orderBy("p", "o", F.coalesce("o_lang", F.lit("")), F.coalesce("o_dtype", F.lit("")), "ord")
    return kept.withColumn("n", F.row_number().over(order) - 1)


def rendered(triples: DataFrame) -> DataFrame:
    """star(triples) with text `key: value` of each triple. Labels are joined to it; their fallbacks need no table of names."""
    own = label_c(triples).select("graph_id", F.col("uri").alias("o"), F.lit("uri").alias("o_kind"), F.col("label").alias("o_label"))
    joined = star(triples).join(predicate_labels(triples), ["graph_id", "p"], "left").join(own, ["graph_id", "o", "o_kind"], "left")
    key = F.when(F.col("p") == TYPE, "type").otherwise(F.coalesce("p_label", local_name_c(F.col("p"))))
    value = F.when(F.col("o_kind") == "lit", literal_text(F.col("o"))).when(F.col("o_kind") == "uri", or_else(F.col("o_label"), local_name_c(F.col("o"))))
    return joined.withColumn("value", value).withColumn("text", F.concat_ws(": ", key, F.col("value")))


def cost_text(stars: DataFrame) -> Column:
    """The cheap rendering that token costs are estimated from."""
    value = F.when(F.col("o_kind") == "lit", F.col("o")).otherwise(local_name_c(F.col("o")))
    return F.concat_ws(": ", local_name_c(F.col("p")), value)


def eligible_items(triples: DataFrame) -> DataFrame:
    """graph_id, uri, items array<struct<n, predicate, text>>: distinct non-empty rendered triples in canonical order."""
    from pyspark.sql.window import Window

    first = Window.partitionBy("graph_id", "s", "text").orderBy("n")
    rows = rendered(triples).where("text <> '' and value <> ''").withColumn("k", F.row_number().over(first)).where("k = 1")
    run = F.array_sort(F.collect_list(F.struct("n", F.col("p").alias("predicate"), "text")))
    return rows.groupBy("graph_id", F.col("s").alias("uri")).agg(run.alias("items"))
