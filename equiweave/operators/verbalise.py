"""Text strategies V1 to V8 and their composites, for all entities of a triple table at once.

Each strategy takes triples and entities (graph_id, uri, entity_type) and gives graph_id, uri, text.
A strategy's parts (its text, items in their order, ancestors and siblings) are joins and column
functions. Without a budget they are joined by column functions too; with one, an Arrow UDF fits
them, a composite's components one after the other, each to what the ones before it left.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiweave.functions.budget import Budget, cut_text, fit_items, fit_prefix, joined
from equiweave.functions.text import join_parts, local_name_c, or_else, plain_literal_text
from equiweave.operators import graph
from equiweave.operators.labels import annotation_lists, annotation_values, label_or_local, labelled, labels_cd, predicate_labels, rendered, star
from equiweave.vocabulary import DATATYPE_SENTENCE, DEFINITIONS, OTHER_SENTENCE, SENTENCES, SYNONYMS, TIERS, expand

KEY = ["graph_id", "uri"]
UNCAPPED = Budget(None)
TRIGGER = 20


def check_types(entities: DataFrame) -> DataFrame:
    """entities, failing on an unknown entity type."""
    known = F.col("entity_type").isin(list(TIERS))
    return entities.where(F.coalesce(known, F.lit(False)) | F.raise_error(F.concat(F.lit("unsupported entity type: "), F.coalesce("entity_type", F.lit("null")))).cast("boolean"))


def names(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """graph_id, uri, name: label D, else C, else the local name."""
    rows = entities.select(*KEY).distinct().join(labels_cd(triples).hint("merge"), KEY, "left")
    return rows.select(*KEY, or_else(F.col("d"), F.col("c"), local_name_c(F.col("uri"))).alias("name"))


def v1(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """label ; synonym ; synonym"""
    rows = names(triples, entities).join(annotation_values(triples, SYNONYMS), KEY, "left")
    parts = F.concat(F.array("name"), F.coalesce("vals", F.array().cast("array<string>")))
    return rows.select(*KEY, F.trim(F.array_join(parts, " ; ")).alias("text"))


def v2(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Label: a. Definition: b. Synonyms: c; d."""
    rows = names(triples, entities).join(annotation_lists(triples, definitions=DEFINITIONS, synonyms=SYNONYMS).hint("merge"), KEY, "left")

    def field(name: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}: "), value, F.lit(".")))

    return rows.select(*KEY, F.concat_ws(" ", field("Label", F.col("name")), field("Definition", F.get("definitions", F.lit(0))), field("Synonyms", F.array_join("synonyms", "; "))).alias("text"))


def tier_of(predicate: Column, entity_type: Column, tiers: dict[str, list[list[str]]] = TIERS) -> Column:
    """Tier of a predicate for the entity type; 99 outside all tiers. The first tier that has it counts."""
    cases = F.lit(99)
    for kind, lists in tiers.items():
        inner = None
        for k, members in enumerate(lists):
            if members:
                test = predicate.isin(members)
                inner = F.when(test, k) if inner is None else inner.when(test, k)
        cases = F.when(entity_type == kind, inner.otherwise(99)).otherwise(cases)
    return cases


def _ordered(rows: DataFrame, *keys: str) -> DataFrame:
    """graph_id, uri, items array<string> of rows (…, text) in key order."""
    run = F.array_sort(F.collect_list(F.struct(*keys, "text")))
    return rows.groupBy(*KEY).agg(F.transform(run, lambda x: x["text"]).alias("items"), F.count("*").alias("n_items"))


def _with_items(entities: DataFrame, items: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return entities.join(items, KEY, "left").withColumn("items", F.coalesce("items", none))


def v3_parts(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """items: sentences in tier order; literals tagged anything but exactly en are left out."""
    entities = check_types(entities)
    stars = star(triples).withColumnRenamed("s", "uri").join(entities, KEY)
    stars = stars.where("o_kind <> 'lit' or o_lang is null or o_lang = 'en'")
    rows = labelled(triples, labelled(triples, stars, "uri", "entity"), "o", "o_label")
    rows = rows.join(predicate_labels(triples), ["graph_id", "p"], "left").withColumn("p_label", F.coalesce("p_label", local_name_c(F.col("p"))))
    value = F.when(F.col("o_kind") == "lit", plain_literal_text(F.col("o"), F.col("o_lang"), F.col("o_dtype"))).otherwise(F.col("o_label"))

    def filled(template: str) -> Column:
        out: list[Column] = []
        for part in template.replace("}", "{").split("{"):
            out.append({"entity": F.col("entity"), "object": value, "predicate": F.col("p_label")}.get(part, F.lit(part)))
        return F.concat(*out)

    text = F.when(F.col("o_kind") == "lit", filled(DATATYPE_SENTENCE)).otherwise(filled(OTHER_SENTENCE))
    for predicate, template in SENTENCES.items():
        text = F.when(F.col("p") == predicate, filled(template)).otherwise(text)
    rows = rows.withColumn("text", text).withColumn("tier", tier_of(F.col("p"), F.col("entity_type"))).where("text <> ''")
    return _with_items(entities, _ordered(rows, "tier", "n")).select(*KEY, "items")


def _pairs(triples: DataFrame, entities: DataFrame) -> DataFrame:
    return rendered(triples).withColumnRenamed("s", "uri").join(entities, KEY).where("text <> ''")


def v4_parts(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """items: key: value pairs in canonical order; tiered: the same in instance tier order, which large or overlong entities use under a budget."""
    rows = _pairs(triples, entities).withColumn("tier", tier_of(F.col("p"), F.lit("instance")))
    run = F.collect_list(F.struct("tier", "n", "text"))
    both = rows.groupBy(*KEY).agg(
        F.transform(F.array_sort(F.transform(run, lambda x: F.struct(x["n"], x["text"]))), lambda x: x["text"]).alias("items"), F.transform(F.array_sort(run), lambda x: x["text"]).alias("tiered")
    )
    return _with_items(entities, both).select(*KEY, "items", F.coalesce("tiered", "items").alias("tiered"))


def v5_parts(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """items: walks; text: the label, for entities without a step."""
    rows = entities.select(*KEY, F.coalesce("entity_type", F.lit("")).alias("entity_type"))
    start = label_or_local(triples, entities.select(*KEY).distinct()).withColumnRenamed("label", "text")
    rows = rows.join(start.hint("merge"), KEY).join(graph.walk_texts(triples, rows).hint("merge"), [*KEY, "entity_type"], "left")
    items = F.transform("items", lambda x: F.concat_ws(" ", "text", x))
    return rows.select(*KEY, F.coalesce(items, F.array().cast("array<string>")).alias("items"), "text")


def v6_parts(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """items: key: value pairs in the tier order of the entity type."""
    entities = check_types(entities)
    rows = _pairs(triples, entities).withColumn("tier", tier_of(F.col("p"), F.col("entity_type")))
    return _with_items(entities, _ordered(rows, "tier", "n")).select(*KEY, "items")


def v7_parts(triples: DataFrame, entities: DataFrame, annotation: bool = True) -> DataFrame:
    """text: V2, or empty; items: labels of the ancestors, nearest first; siblings: their labels."""
    rows = check_types(entities)
    rows = rows.join(v2(triples, entities).hint("merge"), KEY, "left") if annotation else rows.withColumn("text", F.lit(""))
    return graph.with_kin(triples, rows).select(*KEY, "items", "siblings", F.coalesce("text", F.lit("")).alias("text"))


def v8(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Outgoing and incoming relationships; predicates get a property header."""
    entities = check_types(entities)
    rows = entities.join(graph.signatures(triples), KEY, "left")
    rows = labelled(triples, rows, "uri")
    rows = rows.join(graph.first_comments(triples), KEY, "left")
    for name, predicate in (("domain", "rdfs:domain"), ("range", "rdfs:range")):
        rows = rows.join(graph.schema_labels(triples, expand(predicate)).withColumnRenamed("labels", name), KEY, "left")
    def line(name: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}: "), value, F.lit(".")))

    def relations(name: str, column: str) -> Column:
        listed = F.when(F.size(F.coalesce(column, F.array().cast("array<string>"))) == 0, F.lit("none")).otherwise(F.array_join(column, ", "))
        return F.concat(F.lit(f"{name} relationships: "), listed, F.lit("."))

    header = [F.when(F.col("entity_type") == "predicate", x) for x in (
        line("Property", F.col("label")), line("Definition", F.col("comment")), line("Domain", F.col("domain")), line("Range", F.col("range")))]
    return rows.select(*KEY, F.concat_ws("\n", *header, relations("Outgoing", "outgoing"), relations("Incoming", "incoming")).alias("text"))


def hierarchy(head: str, above: list[str], beside: list[str]) -> str:
    """V7's text: the head, an empty line, then a line of parents and a line of siblings where there are any."""
    tail = "\n".join([f"Parents: {' -> '.join(above)}."] * bool(above) + [f"Related types include: {', '.join(beside)}."] * bool(beside))
    return f"{head}\n\n{tail}" if head and tail else head or tail


def _fit_pairs(part: dict[str, Any], budget: Budget, before: str) -> str:
    return " | ".join(fit_items(part["items"], " | ", budget, before))


def _fit_sentences(part: dict[str, Any], budget: Budget, before: str) -> str:
    return " ".join(fit_items(part["items"], " ", budget, before))


def _fit_star(part: dict[str, Any], budget: Budget, before: str) -> str:
    """Tier order only for entities with many pairs or more than fit."""
    items = part["items"]
    turn = len(items) > TRIGGER or not budget.fits(" | ".join(items), before)
    return " | ".join(fit_items(part["tiered"] if turn else items, " | ", budget, before))


def _fit_walks(part: dict[str, Any], budget: Budget, before: str) -> str:
    return " | ".join(fit_prefix(part["items"], " | ", budget, before)) if len(part["items"]) else part["text"]


def _fit_hierarchy(part: dict[str, Any], budget: Budget, before: str) -> str:
    """Siblings go first, then ancestors from the farthest on; the head stays."""
    above, beside = list(part["items"]), list(part["siblings"])
    shorter = [(above, beside), *((above[:n], []) for n in range(len(above), 0, -1))]
    texts = (hierarchy(part["text"], a, b) for a, b in shorter)
    return next((t for t in texts if budget.fits(t, before)), part["text"])


def _plain_hierarchy() -> Column:
    up = F.when(F.size("items") > 0, F.concat(F.lit("Parents: "), F.array_join("items", " -> "), F.lit(".")))
    side = F.when(F.size("siblings") > 0, F.concat(F.lit("Related types include: "), F.array_join("siblings", ", "), F.lit(".")))
    return F.concat_ws("\n\n", F.nullif(F.col("text"), F.lit("")), F.nullif(F.concat_ws("\n", up, side), F.lit("")))


Parts = Callable[..., DataFrame]
#: Components that are held to a budget: their parts, how they are fitted, and their text without a budget.
BUDGETED: dict[str, tuple[Parts, Callable[[dict[str, Any], Budget, str], str], Callable[[], Column]]] = {
    "V3": (v3_parts, _fit_sentences, lambda: F.array_join("items", " ")),
    "V4": (v4_parts, _fit_star, lambda: F.array_join("items", " | ")),
    "V5": (v5_parts, _fit_walks, lambda: F.when(F.size("items") == 0, F.col("text")).otherwise(F.array_join("items", " | "))),
    "V6": (v6_parts, _fit_pairs, lambda: F.array_join("items", " | ")),
    "V7": (v7_parts, _fit_hierarchy, _plain_hierarchy),
}
PLAIN: dict[str, Parts] = {"V1": v1, "V2": v2, "V8": v8}
STRATEGIES = ("V1", "V2", "V3", "V4", "V5", "V6", "V7", "V8", "V2+V6", "V2+V8", "V2+V7", "V2+V8+V7", "V6+V3", "V4+V6", "V8+V6")


def uses_budget(strategy: str, budget: Budget) -> bool:
    return budget.tokens is not None and any(name in BUDGETED for name in strategy.split("+"))


def verbalise(strategy: str, triples: DataFrame, entities: DataFrame, budget: Budget = UNCAPPED, whole: bool = False) -> DataFrame:
    """graph_id, uri, text. In a composite each component fits what its predecessors left; the whole is cut at last.

    whole: an added column with the text before that last cut.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; expected one of {STRATEGIES}")
    names_ = strategy.split("+")
    capped, made = uses_budget(strategy, budget), []
    for k, name in enumerate(names_):
        if name in PLAIN:
            rows = PLAIN[name](triples, entities).select(*KEY, F.struct("text").alias(f"part{k}") if capped else F.col("text").alias(f"part{k}"))
        else:
            parts, _, plain = BUDGETED[name]
            rows = parts(triples, entities, annotation="V2" not in names_) if name == "V7" else parts(triples, entities)
            rows = rows.select(*KEY, (F.struct(*[c for c in rows.columns if c not in KEY]) if capped else plain()).alias(f"part{k}"))
        made.append(rows)
    rows = reduce(lambda a, b: a.join(b, KEY), made)
    columns = [F.col(f"part{k}") for k in range(len(made))]
    if not capped:
        text = columns[0] if len(columns) == 1 else join_parts(*columns)
        return rows.select(*KEY, text.alias("text"), *([text.alias("whole")] if whole else []))
    rows = rows.select(*KEY, F.pandas_udf(_fitted(names_, budget), "string")(F.struct(*columns)).alias("whole"))
    return rows.select(*KEY, cut_text(F.col("whole"), budget).alias("text"), *(["whole"] if whole else []))


def _fitted(names_: list[str], budget: Budget) -> Callable[[pd.DataFrame], pd.Series]:
    """The text of each row of component parts, each component fitted after the ones before it."""

    def text_of(name: str, part: dict[str, Any], before: str) -> str:
        return BUDGETED[name][1](part, budget, before) if name in BUDGETED else part["text"] or ""

    def run(rows: pd.DataFrame) -> pd.Series:
        def one(parts: tuple) -> str:
            texts = [text_of(names_[0], parts[0], "")]
            for name, part in zip(names_[1:], parts[1:], strict=True):
                texts.append(text_of(name, part, joined(*texts)))
            return texts[0] if len(texts) == 1 else joined(*texts)

        return pd.Series([one(x) for x in rows.itertuples(index=False, name=None)], dtype=object)

    run.__annotations__ = {"rows": pd.DataFrame, "return": pd.Series}
    return run
