"""Walks, ancestors, siblings and relational signatures of a triple table."""

from __future__ import annotations

import random
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from equiweave.functions.text import local_name_c, or_else
from equiweave.operators.labels import label_c_of_group, label_or_local, labelled
from equiweave.vocabulary import EXCLUDED, PARENTS, SAME_AS, TYPE, expand

WALKS, HOPS, SEED = 10, 4, 42
DEPTH, SIBLINGS = 3, 5


def first_parents(triples: DataFrame, predicate: str) -> DataFrame:
    """graph_id, uri, parent: the smallest named object of the predicate."""
    rows = triples.where((F.col("p") == predicate) & (F.col("o_kind") == "uri"))
    return rows.groupBy("graph_id", F.col("s").alias("uri")).agg(F.min("o").alias("parent"))


def ancestors(triples: DataFrame, entities: DataFrame, depth: int = DEPTH) -> DataFrame:
    """graph_id, uri, entity_type, chain array<string>: parents, nearest first, up to depth; a repeated node ends it.

    One join for each level over the table of first parents; nothing iterates over entities.
    """
    def hop(kind: int) -> DataFrame:
        parts = [first_parents(triples, PARENTS[t][kind]).withColumn("entity_type", F.lit(t)) for t in PARENTS]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    first, climb = hop(0), hop(1)
    out = entities.join(first, ["graph_id", "uri", "entity_type"], "left")
    fresh = F.col("parent").isNotNull() & (F.col("parent") != F.col("uri"))
    out = out.withColumn("chain", F.when(fresh, F.array("parent")).otherwise(F.array().cast("array<string>"))).drop("parent")
    for level in range(1, depth):
        step = climb.select("graph_id", F.col("uri").alias("last"), "entity_type", "parent")
        out = out.withColumn("last", F.when(F.size("chain") == level, F.element_at("chain", -1)))
        out = out.join(step, ["graph_id", "last", "entity_type"], "left")
        more = F.col("parent").isNotNull() & (F.col("parent") != F.col("uri")) & ~F.array_contains("chain", F.coalesce("parent", F.lit("")))
        out = out.withColumn("chain", F.when(more, F.concat("chain", F.array("parent"))).otherwise(F.col("chain"))).drop("parent", "last")
    return out


def siblings(triples: DataFrame, entities: DataFrame, most: int = SIBLINGS) -> DataFrame:
    """graph_id, uri, siblings array<string>: labels of up to `most` other subjects with the same first parent, by (label, uri).

    Only the first most + 1 children of a parent are kept before the join, so a parent with very
    many children makes a bounded list, not all pairs of them.
    """
    parts = []
    for kind, (predicate, _) in PARENTS.items():
        first = first_parents(triples, predicate)
        children = triples.where((F.col("p") == predicate) & (F.col("o_kind") == "uri") & (F.col("s_kind") == "uri"))
        children = children.select("graph_id", F.col("o").alias("parent"), F.col("s").alias("uri")).distinct()
        named = labelled(triples, children, "uri")
        order = Window.partitionBy("graph_id", "parent").orderBy("label", "uri")
        few = named.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most + 1)
        lists = few.groupBy("graph_id", "parent").agg(F.array_sort(F.collect_list(F.struct("k", "label", "uri"))).alias("run"))
        own = entities.where(F.col("entity_type") == kind).join(first, ["graph_id", "uri"]).join(lists, ["graph_id", "parent"])
        others = F.slice(F.filter("run", lambda x: x["uri"] != F.col("uri")), 1, most)
        parts.append(own.select("graph_id", "uri", F.transform(others, lambda x: x["label"]).alias("siblings")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def with_kin(triples: DataFrame, entities: DataFrame, depth: int = DEPTH, most: int = SIBLINGS) -> DataFrame:
    """entities (graph_id, uri, entity_type, ...) with items array<string>, the labels of ancestors(), and siblings array<string>, those of siblings().

    Ancestors and first children are found once for each parent, and then joined to the entities. All joins
    merge: file sizes make tables of subjects or parents look small, and a broadcast of one fills the driver.
    """
    named = F.col("o_kind") == "uri"

    def has(predicates: set[str]) -> Column:
        return named & F.col("p").isin(sorted(predicates))

    first, climb = ({steps[k] for steps in PARENTS.values()} for k in (0, 1))

    def by_kind(names: dict[str, str]) -> Column:
        return F.coalesce(*[F.when(F.col("entity_type") == kind, F.col(name)) for kind, name in names.items()])

    def smallest(place: int) -> list[Column]:
        return [F.min(F.when(named & (F.col("p") == steps[place]), F.col("o"))).alias(f"_{kind}") for kind, steps in PARENTS.items()]

    picked = by_kind({kind: f"_{kind}" for kind in PARENTS})
    subjects = triples.where(has(first) | (F.col("o_kind") == "lit")).groupBy("graph_id", F.col("s").alias("uri")).agg(
        label_c_of_group().alias("label"), F.collect_set(F.when(has(first), F.struct("p", F.col("o").alias("parent"), (F.col("s_kind") == "uri").alias("named")))).alias("edges")
    )
    children = subjects.select("graph_id", "uri", or_else(F.col("label"), local_name_c(F.col("uri"))).alias("label"), F.explode("edges").alias("x")).select("graph_id", "uri", "label", "x.*")
    kinds = F.array_compact(F.array(*[F.when(F.col("p") == steps[0], kind) for kind, steps in PARENTS.items()]))
    order = Window.partitionBy("graph_id", "entity_type", "parent", "named").orderBy("label", "uri")
    few = children.withColumn("entity_type", F.explode(kinds)).withColumn("k", F.row_number().over(order)).where(F.col("k") <= most + 1)
    parents = few.groupBy("graph_id", "entity_type", "parent").agg(F.array_sort(F.collect_list(F.when(F.col("named"), F.struct("k", "label", "uri")))).alias("run"))

    nodes = triples.where(has(climb) | (F.col("o_kind") == "lit")).groupBy("graph_id", F.col("s").alias("node")).agg(label_c_of_group().alias("label"), *smallest(1))
    parents = parents.withColumn("node", F.col("parent")).withColumn("path", F.array().cast("array<struct<uri:string,label:string>>"))
    for _ in range(depth):
        parents = parents.join(nodes.hint("merge"), ["graph_id", "node"], "left")
        here = F.struct(F.col("node").alias("uri"), or_else(F.col("label"), local_name_c(F.col("node"))).alias("label"))
        parents = parents.withColumn("path", F.when(F.col("node").isNotNull(), F.concat("path", F.array(here))).otherwise(F.col("path"))).withColumn("next", picked)
        fresh = ~F.exists("path", lambda x: x["uri"] == F.col("next"))
        parents = parents.select("graph_id", "entity_type", "parent", "run", "path", F.when(fresh, F.col("next")).alias("node"))

    own = triples.where(has(first)).groupBy("graph_id", F.col("s").alias("uri")).agg(*smallest(0))
    rows = entities.join(own.hint("merge"), ["graph_id", "uri"], "left").select(*entities.columns, picked.alias("parent"))
    rows = rows.join(parents.drop("node").hint("merge"), ["graph_id", "entity_type", "parent"], "left")
    none = F.array().cast("array<string>")
    turn = F.array_position(F.transform("path", lambda x: x["uri"]), F.col("uri"))
    above = F.transform(F.slice("path", F.lit(1), F.when(turn > 0, turn - 1).otherwise(F.size("path")).cast("int")), lambda x: x["label"])
    beside = F.transform(F.slice(F.filter("run", lambda x: x["uri"] != F.col("uri")), 1, most), lambda x: x["label"])
    return rows.select(*entities.columns, F.coalesce(above, none).alias("items"), F.coalesce(beside, none).alias("siblings"))


def exclusion_family(predicate: Column) -> Column:
    """The first family that leaves the predicate out, else null."""
    cases = None
    for name, members in EXCLUDED.items():
        cases = F.when(predicate.isin(members), name) if cases is None else cases.when(predicate.isin(members), name)
    return cases


def signatures(triples: DataFrame) -> DataFrame:
    """graph_id, uri, outgoing, incoming: sorted distinct lower-cased labels of kept predicates."""
    kept = triples.where(exclusion_family(F.col("p")).isNull())
    edges = kept.select("graph_id", F.col("s").alias("uri"), "p", F.lit("out").alias("way")).union(
        kept.where("o_kind <> 'lit'").select("graph_id", F.col("o").alias("uri"), "p", F.lit("in").alias("way"))
    ).distinct()
    named = labelled(triples, edges, "p").withColumn("label", F.lower("label"))
    def labels(way: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("way") == way, F.col("label"))))

    return named.groupBy("graph_id", "uri").agg(labels("out").alias("outgoing"), labels("in").alias("incoming"))


def schema_labels(triples: DataFrame, predicate: str) -> DataFrame:
    """graph_id, uri, labels: sorted labels of the named objects of a predicate, joined with commas."""
    rows = triples.where((F.col("p") == predicate) & (F.col("o_kind") == "uri")).select("graph_id", F.col("s").alias("uri"), "o").distinct()
    return labelled(triples, rows, "o").groupBy("graph_id", "uri").agg(F.array_join(F.array_sort(F.collect_list("label")), ", ").alias("labels"))


def first_comments(triples: DataFrame) -> DataFrame:
    rows = triples.where((F.col("p") == expand("rdfs:comment")) & (F.col("o_kind") == "lit"))
    return rows.groupBy("graph_id", F.col("s").alias("uri")).agg(F.min_by("o", "ord").alias("comment"))


def adjacency(triples: DataFrame) -> DataFrame:
    """graph_id, node, steps array<struct<p, o>>: named steps in (p, o) order, without sameAs and disjointness."""
    kept = triples.where((F.col("o_kind") == "uri") & ~F.col("p").isin(SAME_AS, expand("owl:disjointWith")))
    return kept.groupBy("graph_id", F.col("s").alias("node")).agg(F.array_sort(F.collect_set(F.struct("p", "o"))).alias("steps"))


def _near(entities: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """entities with near array<struct<node, steps>>: the steps of each node that is reached in fewer than `hops` steps; none: no row.

    All joins merge: an aggregate of triples looks small by file sizes, and a broadcast of it fills the driver.
    """
    key = entities.columns
    seen = entities.withColumn("node", F.col("uri"))
    for _ in range(hops - 1):
        nodes = F.concat(F.array("node"), F.coalesce(F.transform("steps", lambda x: x["o"]), F.array().cast("array<string>")))
        seen = seen.join(edges.hint("merge"), ["graph_id", "node"], "left").select(*key, F.explode(F.array_distinct(nodes)).alias("node")).distinct()
    return seen.join(edges.hint("merge"), ["graph_id", "node"]).groupBy(*key).agg(F.collect_list(F.struct("node", "steps")).alias("near"))


def _walker(n_walks: int, hops: int, seed: int) -> Callable[[pd.Series, pd.Series, pd.Series], list[list[list]]]:
    """A function to the walks of each entity, lists of steps. It is local, so that tasks need not import this module."""

    def paths(uris: pd.Series, types: pd.Series, nears: pd.Series) -> list[list[list]]:
        out = []
        for uri, kind, near in zip(uris, types, nears, strict=True):
            steps = {x["node"]: [y for y in x["steps"] if kind != "class" or y["p"] != TYPE] for x in near}
            rng, made = random.Random(seed + zlib.crc32(uri.encode())), []
            for _ in range(n_walks):
                node, path = uri, []
                while len(path) < hops and (options := steps.get(node)):
                    path.append(options[rng.choice(range(len(options)))])
                    node = path[-1]["o"]
                made.append(path)
            out.append(made)
        return out

    return paths


def walks(triples: DataFrame, entities: DataFrame, n_walks: int = WALKS, hops: int = HOPS, seed: int = SEED) -> DataFrame:
    """graph_id, uri, walk (from 0), hop (from 1), p, o: seeded uniform walks over the sorted steps.

    All walks of an entity share one generator, and a draw is made only where a step exists, so an
    entity's walks are one call, over the steps that it reaches within `hops`, gathered by joins.
    """
    near, paths = _near(entities.select("graph_id", "uri", "entity_type"), adjacency(triples), hops), _walker(n_walks, hops, seed)

    def run(uris: pd.Series, types: pd.Series, nears: pd.Series) -> pd.Series:
        return pd.Series([[{"walk": w, "hop": h, "p": x["p"], "o": x["o"]} for w, path in enumerate(made) for h, x in enumerate(path, 1)] for made in paths(uris, types, nears)])

    walked = F.pandas_udf(run, "array<struct<walk:int,hop:int,p:string,o:string>>")
    return near.select("graph_id", "uri", F.explode(walked("uri", "entity_type", "near")).alias("x")).select("graph_id", "uri", "x.*")


def walk_texts(triples: DataFrame, entities: DataFrame, n_walks: int = WALKS, hops: int = HOPS, seed: int = SEED) -> DataFrame:
    """graph_id, uri, entity_type, items array<string>: the texts `[p] B [q] C` of walks() in their order, without the start's label; no step: no row.

    Steps get their labels before the walks, where a step is one row and not one for each walk over it.
    Only labels of predicates may be broadcast: they are few, and most steps have the same one.
    """
    kept = triples.where((F.col("o_kind") == "uri") & ~F.col("p").isin(SAME_AS, expand("owl:disjointWith"))).select("graph_id", F.col("s").alias("node"), "p", "o").distinct()
    for column in ("p", "o"):
        named = label_or_local(triples, kept.select("graph_id", F.col(column).alias("uri")).distinct()).select("graph_id", F.col("uri").alias(column), F.col("label").alias(f"{column}_label"))
        kept = kept.join(named.hint("merge") if column == "o" else named, ["graph_id", column], "left")
    text = F.concat(F.lit("["), "p_label", F.lit("] "), "o_label").alias("text")
    edges = kept.groupBy("graph_id", "node").agg(F.array_sort(F.collect_list(F.struct("p", "o", text))).alias("steps"))
    paths = _walker(n_walks, hops, seed)

    def run(uris: pd.Series, types: pd.Series, nears: pd.Series) -> pd.Series:
        return pd.Series([[" ".join(x["text"] for x in path) for path in made if path] for made in paths(uris, types, nears)])

    walked = F.pandas_udf(run, "array<string>")
    near = _near(entities.select("graph_id", "uri", "entity_type"), edges, hops)
    return near.select("graph_id", "uri", "entity_type", walked("uri", "entity_type", "near").alias("items"))
