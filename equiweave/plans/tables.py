"""Graphs, labels, ranked lists and results derived from relational tables, and the same in SQL.

The tables stand in for graph files, which are not at hand everywhere: parts, suppliers, nations
and regions become a triple table, vectors become ranked lists, line items a results table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equiweave.operators import ranking
from equiweave.vocabulary import ALT_LABEL, LABEL, OWL, PREF_LABEL, RDFS, SUBCLASS, TYPE

NS = "http://ex.org/"
SIZE, XSD_INT = f"{NS}prop#sizeOf", "http://www.w3.org/2001/XMLSchema#int"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sources and targets (uri, label): every tenth part against the others."""
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("uri"), F.col("p_name").alias("label"))
    return rows.where("p_partkey % 10 = 0").select("uri", "label"), rows.where("p_partkey % 10 <> 0").select("uri", "label")


PARTS_SQL = """
src AS (SELECT 'part/' || p_partkey AS uri, p_name AS label FROM part WHERE p_partkey % 10 = 0),
tgt AS (SELECT 'part/' || p_partkey AS uri, p_name AS label FROM part WHERE p_partkey % 10 <> 0)
"""


def numbered_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """As parts, with the key in the label, so that no two labels are the same; every fourth part is a source."""
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("uri"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("label"))
    return rows.where("p_partkey % 4 = 0").select("uri", "label"), rows.where("p_partkey % 4 <> 0").select("uri", "label")


NUMBERED_SQL = """
src AS (SELECT 'part/' || p_partkey AS uri, p_name || ' ' || p_partkey AS label FROM part WHERE p_partkey % 4 = 0),
tgt AS (SELECT 'part/' || p_partkey AS uri, p_name || ' ' || p_partkey AS label FROM part WHERE p_partkey % 4 <> 0)
"""


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(table: DataFrame, base: int, key: str, s: Column, *facts: tuple) -> list[DataFrame]:
        """One scan of a table; each row is exploded into its facts."""
        made = F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), lang.cast("string").alias("o_lang"), dtype.cast("string").alias("o_dtype")) for p, o, kind, lang, dtype in facts])
        each = table.select((F.lit(base) + F.col(key).cast("bigint") * 10).alias("first"), s.alias("s"), F.posexplode(made).alias("k", "x"))
        return [each.select(F.lit("g").alias("graph_id"), (F.col("first") + F.col("k")).alias("ord"), "s", F.lit("uri").alias("s_kind"), "x.p", "x.o", "x.o_kind", "x.o_lang", "x.o_dtype")]

    null = F.lit(None)
    k = F.col("p_partkey")
    uri = lambda prefix, column: F.concat(F.lit(NS + prefix), F.col(column).cast("string"))
    part = rows(
        read(spark, sf_dir, "part"), 1_000_000, "p_partkey", uri("part#P", "p_partkey"),
        (LABEL, F.col("p_name"), "lit", F.when(k % 4 == 0, "en").when(k % 4 == 2, "de").when(k % 4 == 3, "en-GB"), null),
        (PREF_LABEL, F.col("p_brand"), "lit", F.when(k % 3 == 0, null).otherwise("en"), null),
        (ALT_LABEL, F.col("p_type"), "lit", F.when(k % 2 == 0, "en"), null),
        (TYPE, F.concat(F.lit(f"{NS}class#B"), F.expr("right(p_brand, 2)")), "uri", null, null),
        (SIZE, F.concat(F.lit('"'), F.col("p_size").cast("string"), F.lit(f'"^^<{XSD_INT}>')), "lit", null, null),
    )
    nation = rows(
        read(spark, sf_dir, "nation"), 1_000, "n_nationkey", uri("nation#N", "n_nationkey"),
        (TYPE, F.lit(f"{OWL}Class"), "uri", null, null), (LABEL, F.col("n_name"), "lit", F.lit("en"), null), (SUBCLASS, uri("region#R", "n_regionkey"), "uri", null, null),
        (f"{RDFS}comment", F.lit("A nation."), "lit", null, null),
    )
    region = rows(read(spark, sf_dir, "region"), 100, "r_regionkey", uri("region#R", "r_regionkey"), (TYPE, F.lit(f"{OWL}Class"), "uri", null, null), (LABEL, F.col("r_name"), "lit", null, null))
    supplier = rows(read(spark, sf_dir, "supplier"), 100_000_000, "s_suppkey", uri("supplier/S_", "s_suppkey"), (TYPE, uri("nation#N", "s_nationkey"), "uri", null, null), (LABEL, F.col("s_name"), "lit", null, null))
    one = spark.range(1).withColumnRenamed("id", "z")
    prop = rows(one, 0, "z", F.lit(SIZE), (TYPE, F.lit(f"{OWL}DatatypeProperty"), "uri", null, null))
    return reduce(DataFrame.unionByName, [*part, *nation, *region, *supplier, *prop])


def _facts_sql(table: str, base: int, key: str, s: str, *facts: tuple[str, str, str, str]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT {base} + CAST({key} AS BIGINT) * 10 + {k} AS ord, {s} AS s, '{p}' AS p, {o} AS o, '{kind}' AS o_kind, CAST({lang} AS VARCHAR) AS o_lang FROM {table}"
        for k, (p, o, kind, lang) in enumerate(facts)
    )


TRIPLES_SQL = "tr AS (" + "\nUNION ALL ".join([
    _facts_sql(
        "part", 1_000_000, "p_partkey", f"'{NS}part#P' || p_partkey",
        (LABEL, "p_name", "lit", "CASE p_partkey % 4 WHEN 0 THEN 'en' WHEN 2 THEN 'de' WHEN 3 THEN 'en-GB' END"),
        (PREF_LABEL, "p_brand", "lit", "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'en' END"), (ALT_LABEL, "p_type", "lit", "CASE WHEN p_partkey % 2 = 0 THEN 'en' END"),
        (TYPE, f"'{NS}class#B' || right(p_brand, 2)", "uri", "NULL"), (SIZE, f"'\"' || p_size || '\"^^<{XSD_INT}>'", "lit", "NULL"),
    ),
    _facts_sql(
        "nation", 1_000, "n_nationkey", f"'{NS}nation#N' || n_nationkey", (TYPE, f"'{OWL}Class'", "uri", "NULL"), (LABEL, "n_name", "lit", "'en'"),
        (SUBCLASS, f"'{NS}region#R' || n_regionkey", "uri", "NULL"), (f"{RDFS}comment", "'A nation.'", "lit", "NULL"),
    ),
    _facts_sql("region", 100, "r_regionkey", f"'{NS}region#R' || r_regionkey", (TYPE, f"'{OWL}Class'", "uri", "NULL"), (LABEL, "r_name", "lit", "NULL")),
    _facts_sql("supplier", 100_000_000, "s_suppkey", f"'{NS}supplier/S_' || s_suppkey", (TYPE, f"'{NS}nation#N' || s_nationkey", "uri", "NULL"), (LABEL, "s_name", "lit", "NULL")),
    _facts_sql("(SELECT 0 AS z)", 0, "z", f"'{SIZE}'", (TYPE, f"'{OWL}DatatypeProperty'", "uri", "NULL")),
]) + ")"


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sources (s, vec) and targets (t, vec): every fifth vector against the others."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("uri"), F.col("embedding").alias("vec"))
    return rows.where("vec_id % 5 = 0").select(F.col("uri").alias("s"), "vec"), rows.where("vec_id % 5 <> 0").select(F.col("uri").alias("t"), "vec")


def ranked(spark: SparkSession, sf_dir: str, top_k: int = 20) -> DataFrame:
    """condition, pair, s, t, score, rank of the vectors' lists."""
    s, t = vectors(spark, sf_dir)
    return ranking.similarity_matrix(s, t, top_k).select(F.lit("E").alias("condition"), F.lit("p").alias("pair"), "s", "t", "score", "rank")


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """condition, pair, split, s, t: same label, and a fixed residue of the ids."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    a = rows.where("vec_id % 5 = 0").select(F.col("vec_id").alias("a"), "label")
    b = rows.where("vec_id % 5 <> 0").select(F.col("vec_id").alias("b"), "label")
    gold = a.join(b, "label").where((13 * F.col("a") + F.col("b")) % 41 == 0)
    name = lambda c: F.concat(F.lit("v"), F.col(c).cast("string"))
    return gold.select(F.lit("E").alias("condition"), F.lit("p").alias("pair"), F.when(F.col("a") % 25 == 0, "val").otherwise("test").alias("split"), name("a").alias("s"), name("b").alias("t"))


RANKED_SQL = """
sv AS (SELECT vec_id AS a, 'v' || vec_id AS s, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id % 5 = 0),
tv AS (SELECT vec_id AS b, 'v' || vec_id AS t, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS w FROM embeddings WHERE vec_id % 5 <> 0),
dots AS (SELECT s, t, round(list_dot_product(v, w), 9) AS score FROM sv, tv),
ranked AS (SELECT * FROM (SELECT s, t, score, CAST(row_number() OVER (PARTITION BY s ORDER BY score DESC, t) AS INTEGER) AS rank FROM dots) WHERE rank <= 20),
refs AS (SELECT CASE WHEN a.vec_id % 25 = 0 THEN 'val' ELSE 'test' END AS split, 'v' || a.vec_id AS s, 'v' || b.vec_id AS t
  FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0 AND (13 * a.vec_id + b.vec_id) % 41 = 0),
gold AS (SELECT g.s, g.t, r.rank, r.score FROM (SELECT DISTINCT s, t FROM refs WHERE split = 'test') g LEFT JOIN ranked r ON r.s = g.s AND r.t = g.t),
best AS (SELECT s, min(rank) AS best FROM gold GROUP BY s)
"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A results table: condition, dataset, pair, metrics and counts from groups of line items."""
    rows = read(spark, sf_dir, "lineitem")
    n = F.count("*").cast("double")
    share = lambda test: F.count_if(test).cast("double") / n
    pair = F.col("l_suppkey") % 4
    grouped = rows.groupBy(
        F.concat("l_returnflag", "l_linestatus").alias("condition_id"), F.concat(F.lit("D"), F.col("l_linenumber").cast("string")).alias("dataset_id"), F.concat(F.lit("p"), pair.cast("string")).alias("pair_name")
    ).agg(
        share(F.col("l_discount") >= 0.05).alias("f1"), share(F.col("l_tax") >= 0.04).alias("mrr"), share(F.col("l_quantity") > 25).alias("h"),
        F.count_if(F.col("l_quantity") > 25).alias("tp"), F.count_if(F.col("l_discount") >= 0.05).alias("fp"), F.count_if(F.col("l_tax") >= 0.04).alias("fn"),
    )
    hits = F.when((F.col("dataset_id") == "D7") & (F.col("pair_name") == "p3"), F.lit(None)).otherwise(F.col("h"))
    return grouped.withColumn("hits_at_1", hits).drop("h")


RESULTS_SQL = """
res AS (SELECT condition_id, dataset_id, pair_name, f1, mrr, CASE WHEN dataset_id = 'D7' AND pair_name = 'p3' THEN NULL ELSE h END AS hits_at_1, tp, fp, fn FROM (
  SELECT l_returnflag || l_linestatus AS condition_id, 'D' || l_linenumber AS dataset_id, 'p' || (l_suppkey % 4) AS pair_name,
    count(*) FILTER (WHERE l_discount >= 0.05) / CAST(count(*) AS DOUBLE) AS f1, count(*) FILTER (WHERE l_tax >= 0.04) / CAST(count(*) AS DOUBLE) AS mrr,
    count(*) FILTER (WHERE l_quantity > 25) / CAST(count(*) AS DOUBLE) AS h, count(*) FILTER (WHERE l_quantity > 25) AS tp,
    count(*) FILTER (WHERE l_discount >= 0.05) AS fp, count(*) FILTER (WHERE l_tax >= 0.04) AS fn
  FROM lineitem GROUP BY 1, 2, 3)),
cols AS (SELECT condition_id, dataset_id, avg(mrr) AS mrr, avg(f1) AS f1, CASE WHEN count(hits_at_1) = count(*) THEN avg(hits_at_1) END AS hits_at_1 FROM res GROUP BY 1, 2)
"""


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    """Doubles at a fixed number of places, so that summation order does not show."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
