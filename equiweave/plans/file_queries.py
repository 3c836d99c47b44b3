"""Queries over files: each writes a fixture made of the tables, with the sinks or as text, and reads it back.

Files go to a folder of their own under spark.checkpoint.dir, or in local mode a temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equiweave.operators import labels, metrics, ranking, reports
from equiweave.plans import tables as T
from equiweave.plans.registry import query
from equiweave.plans.tables import RANKED_SQL, RESULTS_SQL, TRIPLES_SQL
from equiweave.sources import alignments, rdf, results
from equiweave.vocabulary import LABEL


def folder(spark: SparkSession) -> str:
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (conf.get("spark.master", "") or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp()}"
    return f"{root.rstrip('/')}/files-{uuid.uuid4().hex}"


def written(lines: DataFrame) -> str:
    """The path of a text file of lines (value), in their order."""
    path = folder(lines.sparkSession)
    lines.select("value").coalesce(1).write.text(path)
    return path


def wrapped(spark: SparkSession, head: str, lines: DataFrame, tail: str) -> DataFrame:
    """lines (value) between a head and a tail."""
    ends = spark.createDataFrame([(0, head), (2, tail)], "k int, value string")
    return lines.select(F.lit(1).alias("k"), "value").unionByName(ends).orderBy("k").select("value")


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def _xml(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def _statements(triples: DataFrame) -> DataFrame:
    lang = F.coalesce(F.concat(F.lit("@"), "o_lang"), F.lit(""))
    o = F.when(F.col("o_kind") == "uri", F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'), lang))
    return triples.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), o, F.lit(" .")).alias("value"))


_STATEMENTS = f"WITH {TRIPLES_SQL} SELECT DISTINCT s, p, o, o_kind, o_lang FROM tr"
_FIELDS = ["s", "p", "o", "o_kind", "o_lang"]


@query(_STATEMENTS)
def scan_ntriples(spark, sf_dir):
    return rdf.read_ntriples(spark, written(_statements(T.triples(spark, sf_dir))), "g").select(*_FIELDS)


@query(_STATEMENTS)
def scan_graph_file(spark, sf_dir):
    return rdf.read_graphs(spark, {"g": written(_statements(T.triples(spark, sf_dir)))}, "turtle").select(*_FIELDS)


@query(_STATEMENTS)
def scan_rdf_xml(spark, sf_dir):
    rows = T.triples(spark, sf_dir)
    space, name = F.regexp_extract("p", "^(.*[#/])", 1), F.regexp_extract("p", "([^#/]*)$", 1)
    head = F.concat(F.lit('<rdf:Description rdf:about="'), _xml(F.col("s")), F.lit('"><n:'), name, F.lit(' xmlns:n="'), space, F.lit('"'))
    link = F.concat(F.lit(' rdf:resource="'), _xml(F.col("o")), F.lit('"/>'))
    lang = F.coalesce(F.concat(F.lit(' xml:lang="'), "o_lang", F.lit('"')), F.lit(""))
    text = F.concat(lang, F.lit(">"), _xml(F.col("o")), F.lit("</n:"), name, F.lit(">"))
    lines = rows.select(F.concat(head, F.when(F.col("o_kind") == "uri", link).otherwise(text), F.lit("</rdf:Description>")).alias("value"))
    path = written(wrapped(spark, '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">', lines, "</rdf:RDF>"))
    return rdf.read_graphs(spark, {"g": path}, "xml").select(*_FIELDS)


@query(f"WITH {TRIPLES_SQL} SELECT DISTINCT s, p, o, o_kind FROM tr")
def scan_tsv_triples(spark, sf_dir):
    rows = T.triples(spark, sf_dir)
    relations, attributes = (written(rows.where(F.col("o_kind") == kind).select(F.concat_ws("\t", "s", "p", "o").alias("value"))) for kind in ("uri", "lit"))
    return alignments.read_tsv_triples(spark, relations, attributes, "g").select("s", "p", "o", "o_kind")


@query(f"WITH {RANKED_SQL} SELECT s, t FROM refs")
def scan_links(spark, sf_dir):
    return alignments.read_links(spark, written(T.refs(spark, sf_dir).select(F.concat_ws("\t", "s", "t").alias("value")))).select("s", "t")


def _alignment_file(spark: SparkSession, sf_dir: str) -> str:
    """Cells of all references: validation ones with another relation and half the measure."""
    val = F.col("split") == "val"
    cell = F.concat(
        F.lit('<map><Cell><entity1 rdf:resource="'), "s", F.lit('"/><entity2 rdf:resource="'), "t", F.lit('"/><relation>'), F.when(val, "&lt;").otherwise("="),
        F.lit("</relation><measure>"), F.when(val, "0.5").otherwise("1.0"), F.lit("</measure></Cell></map>"),
    )
    head = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://knowledgeweb.semanticweb.org/heterogeneity/alignment#"><Alignment>'
    return written(wrapped(spark, head, T.refs(spark, sf_dir).select(cell.alias("value")), "</Alignment></rdf:RDF>"))


@query(f"WITH {RANKED_SQL} SELECT s, t FROM refs WHERE split = 'test'")
def scan_alignment(spark, sf_dir):
    return alignments.read_alignment(spark, _alignment_file(spark, sf_dir)).select("s", "t")


@query(f"WITH {RANKED_SQL} SELECT s, t, CASE split WHEN 'val' THEN '<' ELSE '=' END AS relation, CASE split WHEN 'val' THEN 0.5::DOUBLE ELSE 1::DOUBLE END AS measure FROM refs")
def scan_cells_splittable(spark, sf_dir):
    return alignments.read_cells_splittable(spark, _alignment_file(spark, sf_dir)).select("s", "t", "relation", "measure")


@query(f"""WITH {RANKED_SQL} SELECT count(*) AS n_cells, count(*) FILTER (WHERE split = 'test') AS n_equivalence, count(DISTINCT CASE WHEN split = 'test' THEN s || ' ' || t END) AS n_distinct,
count(*) FILTER (WHERE split = 'val') AS n_below_one, CAST(0 AS BIGINT) AS n_malformed FROM refs""")
def alignment_audit(spark, sf_dir):
    return alignments.audit(alignments.read_cells(spark, _alignment_file(spark, sf_dir))).drop("relations")


@query(f"WITH {RANKED_SQL} SELECT 'same cells' AS verdict")
def compare_alignments(spark, sf_dir):
    cells = alignments.read_cells(spark, _alignment_file(spark, sf_dir))
    return reports.compare_alignments(cells, cells.withColumn("ord", -F.col("ord")))


@query(f"WITH {RANKED_SQL} SELECT s, t, rank FROM ranked")
def candidate_round_trip(spark, sf_dir):
    path = folder(spark)
    results.candidate_json(T.ranked(spark, sf_dir)).coalesce(1).write.text(path)
    return results.read_candidates(spark, path)


@query(f"WITH {RANKED_SQL} SELECT s AS source_uri, t AS target_uri, score, rank FROM ranked")
def candidate_table(spark, sf_dir):
    return results.candidate_table(T.ranked(spark, sf_dir))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.results(spark, sf_dir)
    bucket = F.struct("f1", F.col("hits_at_1").alias("precision"), F.col("f1").alias("recall"), "mrr", F.col("tp").cast("int").alias("tp"))
    return rows.select(
        "condition_id", "dataset_id", "pair_name", F.lit("V1").alias("strategy"), F.lit("M1").alias("model_key"), F.struct("f1", "mrr", "hits_at_1", F.lit(0.5).alias("threshold")).alias("metrics"),
        F.struct(*[F.col(c).cast("int").alias(c) for c in ("tp", "fp", "fn")]).alias("counts"), F.create_map(F.lit("class"), bucket).alias("per_entity_type"),
        F.when(F.col("dataset_id") == "D1", 1).otherwise(2).alias("evaluation_protocol"), F.lit("abc").alias("candidates_sha256"),
    )


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written twice, of which the second time finds nothing to write, and read back."""
    path, rows = folder(spark), _results(spark, sf_dir)
    results.write_results(rows.where("dataset_id <> 'D3'"), path)
    results.write_results(rows, path)
    results.write_results(rows, path)
    return results.read_results(spark, path)


@query(f"WITH {RESULTS_SQL} SELECT condition_id, dataset_id, pair_name, round(f1, 9) AS f1, round(mrr, 9) AS mrr, round(hits_at_1, 9) AS hits_at_1, CAST(tp AS INTEGER) AS tp, CAST(fn AS INTEGER) AS fn FROM res")
def result_round_trip(spark, sf_dir):
    return results.flat(_stored(spark, sf_dir)).select("condition_id", "dataset_id", "pair_name", "f1", "mrr", "hits_at_1", "tp", "fn")


@query(f"WITH {RESULTS_SQL} SELECT count(*) AS files, count(*) AS results FROM res")
def result_files(spark, sf_dir):
    path, rows = folder(spark), _results(spark, sf_dir)
    for _ in range(2):
        results.write_results(rows, path)
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").format("binaryFile").load(path).select("path")
    return files.agg(F.count("*").alias("files")).crossJoin(results.read_results(spark, path).agg(F.count("*").alias("results")))


@query(f"WITH {RESULTS_SQL} SELECT condition_id, dataset_id, pair_name FROM res WHERE dataset_id <> 'D1'")
def current_protocol(spark, sf_dir):
    return results.current(_stored(spark, sf_dir)).select("condition_id", "dataset_id", "pair_name")


@query(f"WITH {RESULTS_SQL} SELECT condition_id, dataset_id, pair_name, 'class' AS entity_type, round(mrr, 9) AS mrr, CAST(tp AS INTEGER) AS tp FROM res WHERE hits_at_1 IS NOT NULL")
def result_buckets(spark, sf_dir):
    return results.buckets(_stored(spark, sf_dir)).select("condition_id", "dataset_id", "pair_name", "entity_type", "mrr", "tp")


@query(f"WITH {RESULTS_SQL} SELECT pair_name, round(f1, 9) AS f1 FROM res WHERE condition_id = 'AF' AND dataset_id = 'D2'")
def one_condition(spark, sf_dir):
    return results.one_condition(_stored(spark, sf_dir), "AF", "D2").select("pair_name", F.col("metrics.f1").alias("f1"))


def _sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = T.ranked(spark, sf_dir)
    gold = T.refs(spark, sf_dir).where("split = 'test'").drop("split")
    best = ranking.gold_ranks(lists, gold).select(F.col("s").alias("source"), "ranked", "gold_targets", "gold_ranks", "best_gold_rank")
    said = ranking.predictions(lists, gold, F.lit(0.3)).select(F.col("s").alias("source"), F.col("t").alias("target"), "score", "predicted", "correct")
    one = best.agg(F.array_sort(F.collect_list(F.struct("*"))).alias("test_sources")).crossJoin(said.agg(F.array_sort(F.collect_list(F.struct("*"))).alias("predictions")))
    n = gold.agg(F.count("*").cast("int").alias("n_test_refs"))
    made = one.crossJoin(n).select(F.lit(0.3).alias("threshold"), "n_test_refs", "test_sources", "predictions", F.struct(F.lit("abc").alias("candidates_sha256")).alias("result"))
    path = folder(spark)
    made.write.json(path)
    return results.read_sidecars(spark, path).withColumn("key", F.lit("E"))


@query(f"WITH {RANKED_SQL} SELECT 'E' AS key, s AS source, round(coalesce(1.0 / best, 0), 9) AS rr, CASE WHEN best <= 1 THEN 1 ELSE 0 END AS hit1 FROM best")
def sidecar_outcomes(spark, sf_dir):
    return results.outcome_rows(_sidecars(spark, sf_dir))


@query("SELECT k AS key, r AS reason FROM (VALUES ('F', 'no sidecar')) x(k, r)")
def sidecar_faults(spark, sf_dir):
    """A sidecar agrees with the result that the same lists give; a result without one is a fault."""
    lists = T.ranked(spark, sf_dir)
    gold = T.refs(spark, sf_dir).where("split = 'test'").drop("split")
    measured = metrics.f1_at(ranking.top_one(lists), gold, F.lit(0.3)).crossJoin(gold.agg(F.count("*").cast("int").alias("n_test_refs")))
    rows = measured.select(
        F.explode(F.array(F.lit("E"), F.lit("F"))).alias("key"), F.struct(F.lit(0.3).alias("threshold")).alias("metrics"), F.struct("tp", "fp").alias("counts"),
        F.struct("n_test_refs").alias("population"), F.lit("abc").alias("candidates_sha256"),
    )
    return results.sidecar_faults(_sidecars(spark, sf_dir), rows)


@query(f"WITH {RESULTS_SQL} SELECT condition_id, dataset_id, pair_name, CAST(tp AS BIGINT) AS tp FROM res")
def gzip_csv_round_trip(spark, sf_dir):
    path = folder(spark)
    results.write_gzip_csv(T.results(spark, sf_dir).select("condition_id", "dataset_id", "pair_name", "tp"), path)
    return results.read_csv(spark, path, "condition_id string, dataset_id string, pair_name string, tp bigint")


@query(f"WITH {RESULTS_SQL} SELECT dataset_id, pair_name, CAST(tp AS INTEGER) AS n_refs FROM res WHERE condition_id = 'AF'")
def reference_counts(spark, sf_dir):
    rows = T.results(spark, sf_dir).where("condition_id = 'AF'").select("dataset_id", "pair_name", F.col("tp").cast("int").alias("n_refs"))
    path = folder(spark)
    rows.agg(F.collect_list(F.struct("dataset_id", "pair_name", "n_refs")).alias("pairs")).write.json(path)
    return results.reference_counts(spark, path, "n_refs: int")


@query("SELECT sha256(string_agg(CAST(n_nationkey AS VARCHAR) || chr(10), '' ORDER BY n_nationkey)) AS sha256, true AS missing_is_null FROM nation")
def file_digests(spark, sf_dir):
    path = written(T.read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_nationkey").cast("string").alias("value")).orderBy("n_nationkey"))
    files = [r.path for r in spark.read.format("binaryFile").load(f"{path}/part-*").select(F.regexp_replace("path", "^file:/*", "/").alias("path")).collect()]
    rows = results.file_digests(spark, [*files, files[0] + ".none"])
    return rows.agg(F.max("sha256").alias("sha256"), (F.count_if(F.col("sha256").isNull()) == 1).alias("missing_is_null"))


@query("SELECT DISTINCT doc_id AS path FROM documents JOIN benchmark ON contains(documents.text, benchmark.text) WHERE len(benchmark.text) >= 12")
def files_with_text(spark, sf_dir):
    files = T.read(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return results.files_with_text(files, T.read(spark, sf_dir, "benchmark").where("text is not null").select("text"))


@query(f"WITH {TRIPLES_SQL} SELECT s AS uri, string_agg(o, ';' ORDER BY ord) AS vals FROM tr WHERE o_kind = 'lit' AND p = '{LABEL}' AND (o_lang IS NULL OR o_lang = 'en') GROUP BY s")
def all_literals(spark, sf_dir):
    path = written(_statements(T.triples(spark, sf_dir)))
    return labels.all_literals(rdf.read_ntriples(spark, path, "g"), [LABEL]).select("uri", F.array_join("vals", ";").alias("vals"))
