"""Entities of a triple table (graph_id, ord, s, s_kind, p, o, o_kind, o_lang, o_dtype)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiweave.vocabulary import CLASS_TYPES, PREDICATE_TYPES, RESOLVED_CLASS_TYPES, TYPE


def entities(triples: DataFrame) -> DataFrame:
    """graph_id, uri: URI subjects and URI objects."""
    subjects = triples.where("s_kind = 'uri'").select("graph_id", F.col("s").alias("uri"))
    objects = triples.where("o_kind = 'uri'").select("graph_id", F.col("o").alias("uri"))
    return subjects.union(objects).distinct()


def typed_subjects(triples: DataFrame, types: list[str]) -> DataFrame:
    found = triples.where((F.col("s_kind") == "uri") & (F.col("p") == TYPE) & F.col("o").isin(types))
    return found.select("graph_id", F.col("s").alias("uri")).distinct()


def classes(triples: DataFrame) -> DataFrame:
    return typed_subjects(triples, CLASS_TYPES)


def predicates(triples: DataFrame) -> DataFrame:
    return typed_subjects(triples, PREDICATE_TYPES)


def mixed(triples: DataFrame) -> DataFrame:
    """Classes and predicates."""
    return classes(triples).union(predicates(triples)).distinct()


def instances(triples: DataFrame) -> DataFrame:
    """URI subjects that are neither class nor predicate."""
    subjects = triples.where("s_kind = 'uri'").select("graph_id", F.col("s").alias("uri")).distinct()
    return subjects.join(mixed(triples), ["graph_id", "uri"], "left_anti")


def extract(triples: DataFrame, entity_type: str) -> DataFrame:
    kinds = {"class": classes, "predicate": predicates, "instance": instances, "mixed": mixed}
    if entity_type not in kinds:
        raise ValueError(f"unsupported entity type {entity_type!r}; expected one of {sorted(kinds)}")
    return kinds[entity_type](triples)


def resolved_types(triples: DataFrame) -> DataFrame:
    """graph_id, uri, entity_type of each URI subject; skos:Concept is an instance here."""
    own = F.when(F.col("p") == TYPE, F.col("o"))
    return (
        triples.where("s_kind = 'uri'").groupBy("graph_id", F.col("s").alias("uri"))
        .agg(
            F.when(F.coalesce(F.bool_or(own.isin(RESOLVED_CLASS_TYPES)), F.lit(False)), "class")
            .when(F.coalesce(F.bool_or(own.isin(PREDICATE_TYPES)), F.lit(False)), "predicate")
            .otherwise("instance").alias("entity_type")
        )
    )


def type_for(pair_type: Column, resolved: Column) -> Column:
    """The resolved type in mixed pairs, else the pair's."""
    return F.when(pair_type == "mixed", F.coalesce(resolved, F.lit("instance"))).otherwise(pair_type)
