"""Alignment pairs of the five dataset layouts, as keyed tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equiweave.operators.entities import extract, resolved_types
from equiweave.operators.population import split_by_row, split_by_source
from equiweave.sources.alignments import read_alignment, read_links, read_tsv_triples
from equiweave.sources.rdf import DataError, read_graphs


@dataclass
class Pair:
    """triples of both sides (graph_id source or target), source entities (uri), refs (split, ord, s, t)."""

    dataset: str
    name: str
    entity_type: str
    triples: DataFrame
    sources: DataFrame
    refs: DataFrame
    reference_complete: bool = True

    def graph(self, side: str) -> DataFrame:
        return self.triples.where(F.col("graph_id") == side)


Split = Callable[[DataFrame], DataFrame]


def _graphs(spark: SparkSession, source: str, target: str) -> DataFrame:
    return read_graphs(spark, {"source": source, "target": target}, "xml")


def rdf_pair(spark: SparkSession, folder: str, dataset: str, name: str, entity_type: str, split: Split = split_by_row) -> Pair:
    """A folder with source.rdf, target.rdf and reference.rdf."""
    triples = _graphs(spark, f"{folder}/source.rdf", f"{folder}/target.rdf").persist()
    sources = extract(triples.where("graph_id = 'source'"), entity_type).select("uri").persist()
    return Pair(dataset, name, entity_type, triples, sources, split(read_alignment(spark, f"{folder}/reference.rdf")))


def with_known(pair: Pair, known: DataFrame) -> Pair:
    """Known pairs as train references; one that is also a reference fails."""
    shared = known.join(pair.refs, ["s", "t"], "left_semi")
    if not shared.isEmpty():
        raise DataError(f"a known pair of {pair.name} is also a reference")
    pair.refs = pair.refs.unionByName(known.select("ord", "s", "t").withColumn("split", F.lit("train")))
    return pair


def load_d1(spark: SparkSession, root: str) -> list[Pair]:
    folder = f"{root}/d1_snomed_fma"
    return [with_known(rdf_pair(spark, folder, "D1", "d1_snomed_fma", "class", split_by_source), read_alignment(spark, f"{folder}/input.rdf"))]


def load_d2(spark: SparkSession, root: str) -> list[Pair]:
    return [rdf_pair(spark, f"{root}/d2_anatomy", "D2", "d2_anatomy", "class", split_by_source)]


def _folders(spark: SparkSession, path: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return sorted(x.getPath().getName() for x in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at) if x.isDirectory())


def load_d3(spark: SparkSession, root: str) -> list[Pair]:
    """Every folder a-b is a pair; others are passed over."""
    folder = f"{root}/d3_conference"
    return [rdf_pair(spark, f"{folder}/{n}", "D3", n, "mixed", split_by_source) for n in _folders(spark, folder) if "-" in n]


def load_d4(spark: SparkSession, root: str) -> list[Pair]:
    """One pair of graphs; references go to the schema or the instance pair by their source's type."""
    folder = f"{root}/d4_kgtrack"
    triples = _graphs(spark, f"{folder}/ontologies/memoryalpha.rdf", f"{folder}/ontologies/stexpanded.rdf").persist()
    refs = read_alignment(spark, f"{folder}/references/memoryalpha-stexpanded.rdf")
    types = resolved_types(triples.where("graph_id = 'source'")).select(F.col("uri").alias("s"), "entity_type")
    routed = refs.join(types, "s", "left").withColumn("schema", F.coalesce(F.col("entity_type").isin("class", "predicate"), F.lit(False)))
    out = []
    for dataset, kind, wanted in (("D4_schema", "mixed", True), ("D4_instance", "instance", False)):
        own = routed.where(F.col("schema") == wanted).select("ord", "s", "t")
        sources = extract(triples.where("graph_id = 'source'"), kind).select("uri")
        out.append(Pair(dataset, dataset.lower(), kind, triples, sources, split_by_source(own), False))
    return out


def load_d5(spark: SparkSession, root: str) -> list[Pair]:
    """Tab-separated triples with published links; nothing is split again."""
    folder = f"{root}/d5_openea/D_W_15K_V2"
    sides = [read_tsv_triples(spark, f"{folder}/rel_triples_{k}", f"{folder}/attr_triples_{k}", g) for k, g in ((1, "source"), (2, "target"))]
    triples = sides[0].unionByName(sides[1])
    links = [read_links(spark, f"{folder}/721_5fold/1/{f}_links").withColumn("split", F.lit(s)) for f, s in (("train", "train"), ("valid", "val"), ("test", "test"))]
    sources = extract(triples.where("graph_id = 'source'"), "instance").select("uri")
    return [Pair("D5", "d5_openea", "instance", triples, sources, reduce(DataFrame.unionByName, links))]


LOADERS: dict[str, Callable[[SparkSession, str], list[Pair]]] = {"D1": load_d1, "D2": load_d2, "D3": load_d3, "D4": load_d4, "D5": load_d5}


def load(spark: SparkSession, dataset: str, root: str = "data") -> list[Pair]:
    if dataset not in LOADERS:
        raise DataError(f"unknown dataset {dataset!r}; expected one of {sorted(LOADERS)}")
    return LOADERS[dataset](spark, root)
