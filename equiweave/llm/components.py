"""Connected components of a link table, without moving the links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiweave.llm.shared import discard, materialize


def components(links: DataFrame, tag: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of links (a, b); component is the smallest node it reaches.

    Alternating large-star and small-star rounds: each node points its larger (or smaller-or-own)
    neighbours at the smallest neighbour, until nothing changes. Each round is two aggregations
    and two joins over the links only; a hub's rows are pre-aggregated and its join may be split
    as skewed. Every round is written to the shared folder. Self-links and nulls are ignored.
    """
    edges = (
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    edges = materialize(edges, f"{tag}-links")
    most = 2 * edges.count()
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{tag}-low", most)
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a != b").distinct(), f"{tag}-large", most)
        lowest = materialize(large.groupBy("a").agg(F.min("b").alias("m")), f"{tag}-low", most)
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(lowest.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        old, edges = edges, materialize(small, f"{tag}-links", most)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(old, low, large, lowest)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
