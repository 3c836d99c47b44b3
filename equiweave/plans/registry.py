"""Registered queries by name, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equiweave.functions import text as X
from equiweave.functions.hashes import draw
from equiweave.operators import candidates as C
from equiweave.operators import entities as E
from equiweave.operators import graph, labels, metrics, population, ranking, reports, selection, stats, verbalise
from equiweave.plans import tables as T
from equiweave.plans.tables import NUMBERED_SQL, PARTS_SQL, RANKED_SQL, RESULTS_SQL, TRIPLES_SQL
from equiweave.vocabulary import SUBCLASS, SYNONYMS, TYPE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: T.rounded(f(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- text

_NORM = "regexp_replace(regexp_replace(trim(lower(label)), '\\s+', ' ', 'g'), '[^\\p{L}\\p{N}_\\s]', '', 'g')"
_GRAMS = f"""
lab AS (SELECT uri, {_NORM} AS x FROM (SELECT * FROM src UNION ALL SELECT * FROM tgt)),
g AS (SELECT uri, unnest(CASE WHEN len(x) < 3 THEN [x] ELSE list_transform(range(1, len(x) - 1), lambda i: substr(x, i, 3)) END) AS gram FROM lab WHERE x <> ''),
tf AS (SELECT uri, gram, count(*) AS tf FROM g GROUP BY 1, 2),
nm AS (SELECT uri, sqrt(sum(tf * tf)) AS norm, count(*) AS n_distinct FROM tf GROUP BY 1)
"""


def _all_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = T.parts(spark, sf_dir)
    return s.unionByName(t).withColumnRenamed("uri", "key")


@query(f"WITH {PARTS_SQL}, {_GRAMS} SELECT uri, x AS normalized FROM lab")
def normalize_text(spark, sf_dir):
    return _all_parts(spark, sf_dir).select(F.col("key").alias("uri"), X.normalize(F.col("label")).alias("normalized"))


@query(f"WITH {PARTS_SQL}, {_GRAMS} SELECT uri, gram, tf FROM tf")
def ngram_tokens(spark, sf_dir):
    return C.grams(_all_parts(spark, sf_dir)).withColumnRenamed("key", "uri")


@query(f"WITH {PARTS_SQL}, {_GRAMS} SELECT uri, round(norm, 9) AS norm, n_distinct FROM nm")
def ngram_norms(spark, sf_dir):
    return C.norms(C.grams(_all_parts(spark, sf_dir))).withColumnRenamed("key", "uri")


# Every pair through a grouped SQL join; labels repeat, so it goes by distinct label.
_SCORED = f"""
WITH {PARTS_SQL}, {_GRAMS},
rep AS (SELECT x, min(uri) AS uri FROM lab GROUP BY x),
pr AS (SELECT a.uri AS a, b.uri AS b, sum(p.tf * q.tf) AS dot, count(*) AS common FROM rep a JOIN tf p ON p.uri = a.uri JOIN tf q ON q.gram = p.gram JOIN rep b ON b.uri = q.uri GROUP BY 1, 2),
sc AS (SELECT ra.x AS xa, rb.x AS xb, dot / (na.norm * nb.norm) AS cosine, common / CAST(na.n_distinct + nb.n_distinct - common AS DOUBLE) AS jaccard
  FROM pr JOIN rep ra ON ra.uri = pr.a JOIN rep rb ON rb.uri = pr.b JOIN nm na ON na.uri = pr.a JOIN nm nb ON nb.uri = pr.b),
few AS (SELECT x, uri, row_number() OVER (PARTITION BY x ORDER BY uri) AS r FROM lab WHERE uri IN (SELECT uri FROM tgt)),
"""


def _topk_sql(metric: str) -> str:
    return _SCORED + f"""
byl AS (SELECT xa, f.uri AS t, {metric} AS score, row_number() OVER (PARTITION BY xa ORDER BY {metric} DESC, f.uri) AS rank FROM sc JOIN few f ON f.x = sc.xb AND f.r <= 20),
cand AS (SELECT l.uri AS s, t, score, CAST(rank AS INTEGER) AS rank FROM lab l JOIN byl ON byl.xa = l.x WHERE rank <= 20 AND l.uri IN (SELECT uri FROM src))
"""


@query(_topk_sql("cosine") + "SELECT s, t, round(score, 9) AS score, rank FROM cand")
def ngram_cosine_topk(spark, sf_dir):
    return C.candidates(*T.parts(spark, sf_dir))


@query(_topk_sql("jaccard") + "SELECT s, t, round(score, 9) AS score, rank FROM cand")
def ngram_jaccard_topk(spark, sf_dir):
    return C.candidates(*T.parts(spark, sf_dir), metric="jaccard")


def _distinct_topk(metric: str) -> str:
    return _topk_sql(metric).replace(PARTS_SQL, NUMBERED_SQL) + "SELECT s, t, round(score, 9) AS score, rank FROM cand"


@query(_distinct_topk("cosine"))
def ngram_cosine_topk_distinct(spark, sf_dir):
    return C.candidates(*T.numbered_parts(spark, sf_dir))


@query(_distinct_topk("jaccard"))
def ngram_jaccard_topk_distinct(spark, sf_dir):
    return C.candidates(*T.numbered_parts(spark, sf_dir), metric="jaccard")


@query(_topk_sql("cosine") + "SELECT DISTINCT t FROM cand")
def candidate_targets(spark, sf_dir):
    s, t = T.parts(spark, sf_dir)
    return C.distinct_targets(C.candidates(s, t), s.select(F.col("uri").alias("s")))


@query(_topk_sql("cosine") + """, short AS (SELECT src.uri AS s, count(cand.t) AS n FROM src LEFT JOIN cand ON cand.s = src.uri GROUP BY 1 HAVING count(cand.t) < 20),
more AS (SELECT short.s, tgt.uri AS t, n + row_number() OVER (PARTITION BY short.s ORDER BY tgt.uri) AS rank FROM short CROSS JOIN tgt LEFT JOIN cand ON cand.s = short.s AND cand.t = tgt.uri WHERE cand.t IS NULL)
SELECT s, t, round(score, 9) AS score, rank FROM cand UNION ALL SELECT s, t, CAST(0 AS DOUBLE), CAST(rank AS INTEGER) FROM more WHERE rank <= 20""")
def ngram_topk_padded(spark, sf_dir):
    return C.candidates(*T.parts(spark, sf_dir), padded=True)


# ---------------------------------------------------------------- ranked lists and metrics


def _test_refs(spark: SparkSession, sf_dir: str, split: str = "test") -> DataFrame:
    return T.refs(spark, sf_dir).where(F.col("split") == split).drop("split")


@query(f"WITH {RANKED_SQL} SELECT 'E' AS condition, 'p' AS pair, s, t, score, rank FROM ranked")
def vector_topk(spark, sf_dir):
    return T.ranked(spark, sf_dir)


@query(f"""WITH {RANKED_SQL}, c AS (SELECT s, t FROM ranked WHERE rank % 2 = 0)
SELECT 'E' AS condition, 'p' AS pair, c.s, c.t, score, CAST(row_number() OVER (PARTITION BY c.s ORDER BY score DESC, c.t) AS INTEGER) AS rank FROM c JOIN dots ON dots.s = c.s AND dots.t = c.t""")
def vector_rerank(spark, sf_dir):
    s, t = T.vectors(spark, sf_dir)
    vectors = s.select(F.lit("source").alias("role"), F.col("s").alias("uri"), "vec").unionByName(t.select(F.lit("candidate").alias("role"), F.col("t").alias("uri"), "vec"))
    return ranking.rerank(T.ranked(spark, sf_dir).where("rank % 2 = 0").select("condition", "pair", "s", "t"), vectors)


@query(f"WITH {RANKED_SQL} SELECT 'E' AS condition, 'p' AS pair, s, t, score FROM ranked WHERE rank = 1")
def vector_top1(spark, sf_dir):
    return ranking.top_one(T.ranked(spark, sf_dir))


@query(f"WITH {RANKED_SQL} SELECT 'E' AS condition, 'p' AS pair, round(avg(coalesce(1.0 / best, 0)), 9) AS mrr, count(*) AS n_sources FROM best")
def mrr(spark, sf_dir):
    return metrics.mrr(T.ranked(spark, sf_dir), _test_refs(spark, sf_dir))


@query(f"""WITH {RANKED_SQL} SELECT 'E' AS condition, 'p' AS pair, round(avg(CASE WHEN best <= 1 THEN 1.0 ELSE 0 END), 9) AS hits_at_1,
round(avg(CASE WHEN best <= 5 THEN 1.0 ELSE 0 END), 9) AS hits_at_5, round(avg(CASE WHEN best <= 10 THEN 1.0 ELSE 0 END), 9) AS hits_at_10 FROM best""")
def hits_at_k(spark, sf_dir):
    return metrics.hits_at(T.ranked(spark, sf_dir), _test_refs(spark, sf_dir), 1, 5, 10)


@query(f"""WITH {RANKED_SQL}, r AS (SELECT rank FROM refs LEFT JOIN ranked USING (s, t) WHERE split = 'test')
SELECT 'E' AS condition, 'p' AS pair, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 9) AS recall_at_1,
round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 9) AS recall_at_10 FROM r""")
def recall_at_k(spark, sf_dir):
    return metrics.recall_at(T.ranked(spark, sf_dir), _test_refs(spark, sf_dir), 1, 10)


@query(f"WITH {RANKED_SQL}, r AS (SELECT rank FROM refs LEFT JOIN ranked USING (s, t)) SELECT round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1 END), 9) AS recall, count(*) AS n_refs FROM r")
def candidate_recall_at_20(spark, sf_dir):
    return C.recall_at(T.ranked(spark, sf_dir), T.refs(spark, sf_dir).select("s", "t"))


@query(f"WITH {RANKED_SQL} SELECT 'E' AS condition, 'p' AS pair, count(DISTINCT s) AS n_sources FROM refs WHERE split = 'test'")
def reference_sources(spark, sf_dir):
    return metrics.count_sources(_test_refs(spark, sf_dir))


def _f1_sql(split: str, at: str) -> str:
    return f"""
first AS (SELECT s, t, score FROM ranked WHERE rank = 1), gs AS (SELECT DISTINCT s, t FROM refs WHERE split = '{split}'),
grid AS (SELECT unnest(list_transform(range(10, 100), lambda k: k / 100.0)) AS threshold),
cnt AS (SELECT threshold, (SELECT count(*) FROM first WHERE score >= threshold) AS n, (SELECT count(*) FROM first JOIN gs USING (s, t) WHERE score >= threshold) AS tp,
  (SELECT count(*) FROM gs) AS ng FROM {at}),
pr AS (SELECT threshold, tp, n - tp AS fp, ng - tp AS fn, CASE WHEN n = 0 THEN 0 ELSE tp / CAST(n AS DOUBLE) END AS p, CASE WHEN ng = 0 THEN 0 ELSE tp / CAST(ng AS DOUBLE) END AS r FROM cnt),
f AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2.0 * p * r / (p + r) END AS f1 FROM pr)"""


@query(f"""WITH {RANKED_SQL}, {_f1_sql("test", "(SELECT 0.5 AS threshold)")}
SELECT 'E' AS condition, 'p' AS pair, CAST(tp AS INTEGER) AS tp, CAST(fp AS INTEGER) AS fp, CAST(fn AS INTEGER) AS fn, round(p, 9) AS precision, round(r, 9) AS recall, round(f1, 9) AS f1 FROM f""")
def f1_at_threshold(spark, sf_dir):
    return metrics.f1_at(ranking.top_one(T.ranked(spark, sf_dir)), _test_refs(spark, sf_dir), F.lit(0.5))


@query(f"""WITH {RANKED_SQL}, {_f1_sql("val", "grid")}, m AS (SELECT max(f1) AS b FROM f), tie AS (SELECT list(threshold ORDER BY threshold) AS l, max(f1) AS f1 FROM f, m WHERE f1 = b)
SELECT 'E' AS condition, 'p' AS pair, round(l[(len(l) + 1) // 2], 9) AS threshold, round(f1, 9) AS f1 FROM tie""")
def tune_threshold(spark, sf_dir):
    return metrics.tune_threshold(T.ranked(spark, sf_dir), _test_refs(spark, sf_dir, "val"))


@query(f"""WITH {RANKED_SQL}, {_f1_sql("test", "(SELECT 0.3 AS threshold)")}, rr AS (SELECT rank FROM refs LEFT JOIN ranked USING (s, t) WHERE split = 'test')
SELECT 'E' AS condition, 'p' AS pair, round(f1, 9) AS f1, round(p, 9) AS precision, round(r, 9) AS recall, 0.3::DOUBLE AS threshold,
(SELECT round(avg(coalesce(1.0 / best, 0)), 9) FROM best) AS mrr, (SELECT round(avg(CASE WHEN best <= 1 THEN 1.0 ELSE 0 END), 9) FROM best) AS hits_at_1,
(SELECT round(avg(CASE WHEN best <= 5 THEN 1.0 ELSE 0 END), 9) FROM best) AS hits_at_5, (SELECT round(avg(CASE WHEN best <= 10 THEN 1.0 ELSE 0 END), 9) FROM best) AS hits_at_10,
(SELECT round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 9) FROM rr) AS recall_at_1, (SELECT round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 9) FROM rr) AS recall_at_5,
(SELECT round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 9) FROM rr) AS recall_at_10, CAST(tp AS INTEGER) AS tp, CAST(fp AS INTEGER) AS fp, CAST(fn AS INTEGER) AS fn FROM f""")
def all_metrics(spark, sf_dir):
    thresholds = spark.createDataFrame([("E", "p", 0.3)], "condition string, pair string, threshold double")
    return metrics.all_metrics(T.ranked(spark, sf_dir), _test_refs(spark, sf_dir), thresholds)


_TYPED = "CASE CAST(substr(s, 2) AS BIGINT) % 2 WHEN 0 THEN 'class' ELSE 'predicate' END"


@query(f"""WITH {RANKED_SQL}, b AS (SELECT {_TYPED} AS entity_type, best FROM best),
n AS (SELECT {_TYPED} AS entity_type, count(*) AS n FROM refs WHERE split = 'test' GROUP BY 1)
SELECT 'E' AS condition, 'p' AS pair, entity_type, CAST(n AS INTEGER) AS n_refs, round(avg(coalesce(1.0 / best, 0)), 9) AS mrr FROM b JOIN n USING (entity_type) WHERE n >= 3 GROUP BY entity_type, n""")
def entity_type_mrr(spark, sf_dir):
    kind = F.when(F.substring("s", 2, 20).cast("bigint") % 2 == 0, "class").otherwise("predicate")
    lists, all_refs = T.ranked(spark, sf_dir).withColumn("entity_type", kind), T.refs(spark, sf_dir).withColumn("entity_type", kind)
    split = lambda x: all_refs.where(F.col("split") == x).drop("split")
    return metrics.by_entity_type(lists, split("test"), lists, split("val")).select("condition", "pair", "entity_type", "n_refs", "mrr")


@query(f"""WITH {RANKED_SQL} SELECT 'E' AS condition, 'p' AS pair, g.s, g.s IN (SELECT s FROM ranked) AS ranked, string_agg(g.t, ',' ORDER BY g.t) AS gold,
string_agg(coalesce(CAST(g.rank AS VARCHAR), '-'), ',' ORDER BY g.t) AS ranks, coalesce(min(g.rank), 0) AS best_gold_rank FROM gold g GROUP BY g.s""")
def gold_ranks(spark, sf_dir):
    rows = ranking.gold_ranks(T.ranked(spark, sf_dir), _test_refs(spark, sf_dir))
    ranks = F.array_join(F.transform("gold_ranks", lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",")
    return rows.select("condition", "pair", "s", "ranked", F.array_join("gold_targets", ",").alias("gold"), ranks.alias("ranks"), F.coalesce("best_gold_rank", F.lit(0)).alias("best_gold_rank"))


@query(f"""WITH {RANKED_SQL}, gs AS (SELECT DISTINCT s, t FROM refs WHERE split = 'test') SELECT 'E' AS condition, 'p' AS pair, r.s, r.t, r.score, r.score >= 0.3 AS predicted, g.s IS NOT NULL AS correct
FROM ranked r LEFT JOIN gs g ON g.s = r.s AND g.t = r.t WHERE rank = 1""")
def predictions(spark, sf_dir):
    return ranking.predictions(T.ranked(spark, sf_dir), _test_refs(spark, sf_dir), F.lit(0.3))


@query(f"""WITH {RANKED_SQL} SELECT 'E' AS condition, 'p' AS pair, CASE WHEN best IS NULL THEN 'unranked' WHEN best = 1 THEN '1' WHEN best <= 5 THEN '2-5' WHEN best <= 10 THEN '6-10'
WHEN best <= 20 THEN '11-20' ELSE '>20' END AS bucket, count(*) AS n FROM best GROUP BY 3""")
def rank_histogram(spark, sf_dir):
    return ranking.rank_histogram(ranking.gold_ranks(T.ranked(spark, sf_dir), _test_refs(spark, sf_dir)))


@query(f"""WITH {RANKED_SQL}, r4 AS (SELECT s, t, rank, round_even(score, 6) AS score FROM ranked WHERE rank <= 4)
SELECT 'E' AS condition, 'p' AS pair, s, string_agg(t, ',' ORDER BY rank) AS targets, round(sum(score), 6) AS total FROM r4 GROUP BY s""")
def top_candidates(spark, sf_dir):
    rows = ranking.top_candidates(T.ranked(spark, sf_dir))
    total = F.aggregate("top", F.lit(0.0), lambda a, x: a + x["score"])
    return rows.select("condition", "pair", "s", F.array_join(F.transform("top", lambda x: x["t"]), ",").alias("targets"), F.round(total, 6).alias("total"))


# ---------------------------------------------------------------- populations


_POP = """
srcs AS (SELECT DISTINCT 'v' || vec_id AS s FROM embeddings WHERE vec_id % 5 = 0),
lev AS (SELECT s, max(CASE split WHEN 'test' THEN 3 WHEN 'val' THEN 2 ELSE 1 END) AS l FROM refs GROUP BY s),
pop AS (SELECT s, ['known', 'val', 'test'][l] AS slice FROM lev UNION ALL SELECT s, 'unmatched' FROM srcs WHERE s NOT IN (SELECT s FROM lev))
"""


def _populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = T.vectors(spark, sf_dir)[0].select(F.lit("p").alias("pair"), "s")
    return population.populations(sources, T.refs(spark, sf_dir))


@query(f"WITH {RANKED_SQL}, {_POP} SELECT 'p' AS pair, s, slice FROM pop")
def population_assign(spark, sf_dir):
    rows = _populations(spark, sf_dir)
    return rows.withColumn("slice", F.when(F.col("slice").startswith("unmatched"), "unmatched").otherwise(F.col("slice")))


#: crc32 of an ASCII string s, bit by bit.
_CRC = """xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(1, len(s) + 1), lambda i: CAST(ascii(substr(s, i, 1)) AS BIGINT)),
lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1)))), CAST(4294967295 AS BIGINT))"""


@query(f"WITH d AS (SELECT DISTINCT 'v' || vec_id AS s FROM embeddings WHERE vec_id % 5 = 0) SELECT s, round({_CRC} / 4294967296.0, 9) AS draw FROM d")
def population_draws(spark, sf_dir):
    return T.vectors(spark, sf_dir)[0].select("s", draw(F.col("s")).alias("draw"))


@query(f"""WITH {RANKED_SQL}, k AS (SELECT s, t FROM ranked WHERE rank = 2), w AS (SELECT r.* FROM ranked r ANTI JOIN k ON k.s = r.s AND k.t = r.t)
SELECT 'E' AS condition, 'p' AS pair, s, t, score, CAST(row_number() OVER (PARTITION BY s ORDER BY rank) AS INTEGER) AS rank FROM w""")
def known_pair_removal(spark, sf_dir):
    lists = T.ranked(spark, sf_dir)
    return population.without_known(lists, lists.where("rank = 2").select("pair", "s", "t"))


@query(f"""WITH {RANKED_SQL}, k AS (SELECT s, t FROM ranked WHERE rank = 2), w AS (SELECT r.* FROM ranked r ANTI JOIN k ON k.s = r.s AND k.t = r.t),
l AS (SELECT s, t, score, CAST(row_number() OVER (PARTITION BY s ORDER BY rank) AS INTEGER) AS rank FROM w),
ok AS (SELECT DISTINCT s FROM l WHERE s IN (SELECT s FROM refs) OR (rank = 1 AND t IN (SELECT t FROM refs)))
SELECT 'E' AS condition, 'p' AS pair, s, t, score, rank FROM l WHERE s IN (SELECT s FROM ok)""")
def judgeable_lists(spark, sf_dir):
    lists = T.ranked(spark, sf_dir)
    pairs = spark.createDataFrame([("p", False)], "pair string, reference_complete boolean")
    rows = population.judgeable(lists, T.refs(spark, sf_dir), lists.where("rank = 2").select("pair", "s", "t"), pairs)
    return rows.select("condition", "pair", "s", "t", "score", "rank")


@query(f"WITH {RANKED_SQL}, {_POP} SELECT 'E' AS condition, 'p' AS pair, s, t, score, rank FROM ranked WHERE s IN (SELECT s FROM pop WHERE slice = 'test')")
def restrict_population(spark, sf_dir):
    return population.restrict(T.ranked(spark, sf_dir), _populations(spark, sf_dir).where("slice = 'test'")).select("condition", "pair", "s", "t", "score", "rank")


# ---------------------------------------------------------------- entities, labels, texts


def _entity_sql(body: str) -> str:
    return f"WITH {TRIPLES_SQL}, ty AS (SELECT DISTINCT s, o FROM tr WHERE p = '{TYPE}'), cl AS (SELECT DISTINCT s FROM ty WHERE o = 'http://www.w3.org/2002/07/owl#Class'), " \
        f"pd AS (SELECT DISTINCT s FROM ty WHERE o = 'http://www.w3.org/2002/07/owl#DatatypeProperty') {body}"


@query(_entity_sql("SELECT s AS uri FROM cl"))
def entity_extract_class(spark, sf_dir):
    return E.extract(T.triples(spark, sf_dir), "class").select("uri")


@query(_entity_sql("SELECT s AS uri FROM pd"))
def entity_extract_predicate(spark, sf_dir):
    return E.extract(T.triples(spark, sf_dir), "predicate").select("uri")


@query(_entity_sql("SELECT s AS uri FROM cl UNION SELECT s FROM pd"))
def entity_extract_mixed(spark, sf_dir):
    return E.extract(T.triples(spark, sf_dir), "mixed").select("uri")


@query(_entity_sql("SELECT DISTINCT s AS uri FROM tr WHERE s NOT IN (SELECT s FROM cl) AND s NOT IN (SELECT s FROM pd)"))
def entity_extract_instance(spark, sf_dir):
    return E.extract(T.triples(spark, sf_dir), "instance").select("uri")


@query(_entity_sql("SELECT s AS uri FROM tr UNION SELECT o FROM tr WHERE o_kind = 'uri'"))
def entity_all(spark, sf_dir):
    return E.entities(T.triples(spark, sf_dir)).select("uri")


@query(_entity_sql("SELECT DISTINCT s AS uri, CASE WHEN s IN (SELECT s FROM cl) THEN 'class' WHEN s IN (SELECT s FROM pd) THEN 'predicate' ELSE 'instance' END AS entity_type FROM tr"))
def entity_resolve_type(spark, sf_dir):
    return E.resolved_types(T.triples(spark, sf_dir)).select("uri", "entity_type")


_LOCAL_A = "CASE WHEN contains(uri, '#') THEN regexp_extract(uri, '([^#]*)$', 1) ELSE regexp_extract(uri, '([^/]*)$', 1) END"
_LOCAL_C = "regexp_replace(replace(regexp_extract(uri, '([^#/]*)$', 1), '_', ' '), '([a-z])([A-Z])', '\\1 \\2', 'g')"
_ENT = "ent AS (SELECT s AS uri FROM tr UNION SELECT o FROM tr WHERE o_kind = 'uri')"
_LABEL_C = f"""
lc AS (SELECT s AS uri, o AS label, row_number() OVER (PARTITION BY s ORDER BY o_lang IS NULL, CASE p WHEN 'http://www.w3.org/2000/01/rdf-schema#label' THEN 1
  WHEN 'http://www.w3.org/2004/02/skos/core#prefLabel' THEN 2 ELSE 3 END, ord) AS k FROM tr
  WHERE o_kind = 'lit' AND (o_lang IS NULL OR o_lang = 'en') AND p IN ('http://www.w3.org/2000/01/rdf-schema#label', 'http://www.w3.org/2004/02/skos/core#prefLabel', 'http://www.w3.org/2004/02/skos/core#altLabel')),
lol AS (SELECT e.uri, coalesce(nullif(label, ''), {_LOCAL_C.replace('uri', 'e.uri')}) AS label FROM (SELECT uri FROM ent UNION SELECT DISTINCT p FROM tr) e LEFT JOIN lc ON lc.uri = e.uri AND k = 1)
"""


@query(f"WITH {TRIPLES_SQL}, {_ENT} SELECT uri, {_LOCAL_A} AS a, replace({_LOCAL_A}, '_', ' ') AS b, {_LOCAL_C} AS c FROM ent")
def local_names(spark, sf_dir):
    u = F.col("uri")
    return E.entities(T.triples(spark, sf_dir)).select("uri", X.local_name_a(u).alias("a"), X.local_name_b(u).alias("b"), X.local_name_c(u).alias("c"))


def _ranked_label(p: str) -> str:
    return f"(SELECT s, o, row_number() OVER (PARTITION BY s ORDER BY CASE WHEN lower(o_lang) = 'en' THEN 0 WHEN o_lang IS NULL THEN 1 ELSE 2 END, ord) AS k FROM tr WHERE o_kind = 'lit' AND p = '{p}')"


@query(f"""WITH {TRIPLES_SQL}, {_ENT} SELECT e.uri, coalesce(a.o, b.o, {_LOCAL_A.replace("uri", "e.uri")}) AS label FROM ent e
LEFT JOIN {_ranked_label("http://www.w3.org/2000/01/rdf-schema#label")} a ON a.s = e.uri AND a.k = 1 LEFT JOIN {_ranked_label("http://www.w3.org/2004/02/skos/core#prefLabel")} b ON b.s = e.uri AND b.k = 1""")
def label_choice_a(spark, sf_dir):
    return labels.label_a(T.triples(spark, sf_dir)).select("uri", "label")


@query(f"""WITH {TRIPLES_SQL}, {_ENT}, f AS (SELECT s, o, row_number() OVER (PARTITION BY s ORDER BY CASE WHEN p = 'http://www.w3.org/2000/01/rdf-schema#label' THEN 1 ELSE 2 END, ord) AS k FROM tr
WHERE o_kind = 'lit' AND lower(coalesce(o_lang, 'en')) = 'en' AND p IN ('http://www.w3.org/2000/01/rdf-schema#label', 'http://www.w3.org/2004/02/skos/core#prefLabel'))
SELECT e.uri, coalesce(f.o, replace({_LOCAL_A.replace("uri", "e.uri")}, '_', ' ')) AS label FROM ent e LEFT JOIN f ON f.s = e.uri AND f.k = 1""")
def label_choice_b(spark, sf_dir):
    return labels.label_b(T.triples(spark, sf_dir)).select("uri", "label")


@query(f"WITH {TRIPLES_SQL}, {_ENT}, {_LABEL_C} SELECT uri, label FROM lc WHERE k = 1")
def label_choice_c(spark, sf_dir):
    return labels.label_c(T.triples(spark, sf_dir)).select("uri", "label")


@query(f"""WITH {TRIPLES_SQL}, d AS (SELECT s AS uri, o AS label, row_number() OVER (PARTITION BY s ORDER BY o_lang IS NULL, CASE WHEN p = 'http://www.w3.org/2000/01/rdf-schema#label' THEN 1 ELSE 2 END, ord) AS k
FROM tr WHERE o_kind = 'lit' AND (o_lang IS NULL OR o_lang = 'en') AND p IN ('http://www.w3.org/2000/01/rdf-schema#label', 'http://www.w3.org/2004/02/skos/core#prefLabel')) SELECT uri, label FROM d WHERE k = 1""")
def label_choice_d(spark, sf_dir):
    return labels.label_d(T.triples(spark, sf_dir)).select("uri", "label")


@query(f"WITH {TRIPLES_SQL}, u AS (SELECT DISTINCT p AS uri FROM tr) SELECT uri AS p, {_LOCAL_C} AS label FROM u")
def label_choice_e(spark, sf_dir):
    return labels.label_e(T.triples(spark, sf_dir)).select("p", "label")


@query(f"WITH {TRIPLES_SQL}, {_ENT}, {_LABEL_C} SELECT uri, label FROM lol WHERE uri IN (SELECT uri FROM ent)")
def label_or_local(spark, sf_dir):
    t = T.triples(spark, sf_dir)
    return labels.label_or_local(t, E.entities(t)).select("uri", "label")


_SYN = ", ".join(f"'{p}'" for p in SYNONYMS)
_VALUES = "(o_lang IS NULL OR lower(o_lang) = 'en' OR starts_with(lower(o_lang), 'en-'))"


@query(f"WITH {TRIPLES_SQL} SELECT s AS uri, string_agg(o, ';' ORDER BY ord) AS vals FROM tr WHERE o_kind = 'lit' AND p IN ({_SYN}) AND {_VALUES} GROUP BY s")
def annotation_values(spark, sf_dir):
    return labels.annotation_values(T.triples(spark, sf_dir), SYNONYMS).select("uri", F.array_join("vals", ";").alias("vals"))


_STAR = """
st AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p, o, coalesce(o_lang, ''), ord) - 1 AS n FROM tr WHERE p <> 'http://www.w3.org/2002/07/owl#sameAs' AND NOT (o_kind = 'uri' AND o = s)),
tx AS (SELECT st.s, st.n, st.p, st.o, st.o_kind, st.o_lang, CASE WHEN o_kind = 'lit' THEN trim(regexp_replace(o, '^"(.*)"\\^\\^<[^>]*>$', '\\1')) ELSE ol.label END AS v,
  CASE WHEN p = 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' THEN 'type' ELSE """ + _LOCAL_C.replace("uri", "p") + """ END AS k FROM st LEFT JOIN lol ol ON ol.uri = st.o)
"""


@query(f"WITH {TRIPLES_SQL} , st AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p, o, coalesce(o_lang, ''), ord) - 1 AS n FROM tr) SELECT s, CAST(n AS INTEGER) AS n, p, o FROM st")
def star_scan(spark, sf_dir):
    return labels.star(T.triples(spark, sf_dir)).select("s", "n", "p", "o")


_ITEM_RUN = "it AS (SELECT s, n, p, k || ': ' || v AS text, row_number() OVER (PARTITION BY s, k || ': ' || v ORDER BY n) AS d FROM tx)"


@query(f"WITH {TRIPLES_SQL}, {_ENT}, {_LABEL_C}, {_STAR}, {_ITEM_RUN} SELECT s AS uri, string_agg(text, ' | ' ORDER BY n) AS items, count(*) AS n FROM it WHERE d = 1 GROUP BY s")
def eligible_items(spark, sf_dir):
    rows = labels.eligible_items(T.triples(spark, sf_dir))
    return rows.select("uri", F.array_join(F.transform("items", lambda x: x["text"]), " | ").alias("items"), F.size("items").cast("bigint").alias("n"))


def _kinds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = T.triples(spark, sf_dir)
    return t, E.resolved_types(t)


def _strategy(name: str) -> Query:
    def run(spark, sf_dir):
        t, e = _kinds(spark, sf_dir)
        return verbalise.verbalise(name, t, e).select("uri", "text")

    return run


_SUBJECTS = "sj AS (SELECT DISTINCT s FROM tr)"
_NAME_D = """nd AS (SELECT s, o, row_number() OVER (PARTITION BY s ORDER BY o_lang IS NULL, CASE WHEN p = 'http://www.w3.org/2000/01/rdf-schema#label' THEN 1 ELSE 2 END, ord) AS k FROM tr
WHERE o_kind = 'lit' AND (o_lang IS NULL OR o_lang = 'en') AND p IN ('http://www.w3.org/2000/01/rdf-schema#label', 'http://www.w3.org/2004/02/skos/core#prefLabel')),
nm AS (SELECT sj.s, coalesce(nd.o, lol.label) AS name FROM sj LEFT JOIN nd ON nd.s = sj.s AND nd.k = 1 LEFT JOIN lol ON lol.uri = sj.s),
sy AS (SELECT s, string_agg(o, ' ; ' ORDER BY ord) AS a, string_agg(o, '; ' ORDER BY ord) AS b FROM tr WHERE o_kind = 'lit' AND p IN (""" + _SYN + f") AND {_VALUES} GROUP BY s)," \
    + "df AS (SELECT s, min(o) AS d FROM tr WHERE p = 'http://www.w3.org/2000/01/rdf-schema#comment' GROUP BY s)"
_ORDERED = f"WITH {TRIPLES_SQL}, {_ENT}, {_LABEL_C}, {_STAR}, {_SUBJECTS}, {_NAME_D} "


def _register(name: str, strategy: str, sql: str | None) -> None:
    run = _strategy(strategy)
    run.__name__ = name
    query(sql)(run)


_V2 = """SELECT nm.s AS uri, concat_ws(' ', 'Label: ' || name || '.', 'Definition: ' || d || '.', 'Synonyms: ' || b || '.') AS text FROM nm LEFT JOIN sy ON sy.s = nm.s LEFT JOIN df ON df.s = nm.s"""
_register("v1_text", "V1", _ORDERED + "SELECT nm.s AS uri, trim(concat_ws(' ; ', name, a)) AS text FROM nm LEFT JOIN sy ON sy.s = nm.s")
_register("v2_text", "V2", _ORDERED + _V2)
_register("v4_text", "V4", _ORDERED + "SELECT s AS uri, string_agg(k || ': ' || v, ' | ' ORDER BY n) AS text FROM tx GROUP BY s")
_TIER6 = """CASE WHEN s LIKE 'http://ex.org/nation%' OR s LIKE 'http://ex.org/region%' THEN CASE WHEN p LIKE '%#label' OR p LIKE '%#comment' THEN 0 WHEN p LIKE '%#type' OR p LIKE '%#subClassOf' THEN 1 ELSE 99 END
WHEN s LIKE 'http://ex.org/prop%' THEN 99 ELSE CASE WHEN p LIKE '%#type' OR p LIKE '%#label' OR p LIKE '%#prefLabel' THEN 0 ELSE 99 END END"""
_register("v6_text", "V6", _ORDERED + f"SELECT s AS uri, string_agg(k || ': ' || v, ' | ' ORDER BY {_TIER6}, n) AS text FROM tx GROUP BY s")
_V3_TEXT = f"""CASE WHEN p LIKE '%#subClassOf' THEN e.label || ' is a subclass of ' || val || '.' WHEN p LIKE '%#type' THEN e.label || ' is a ' || val || '.'
WHEN p LIKE '%rdf-schema#label' THEN e.label || ' is called ' || val || '.' WHEN p LIKE '%#comment' THEN e.label || ': ' || val || '.'
WHEN o_kind = 'lit' THEN e.label || ' has ' || {_LOCAL_C.replace("uri", "p")} || ' ' || val || '.' ELSE e.label || ' ' || {_LOCAL_C.replace("uri", "p")} || ' ' || val || '.' END"""
_register("v3_text", "V3", _ORDERED + f""", x3 AS (SELECT *, CASE WHEN o_kind = 'lit' THEN CASE WHEN o_lang IS NULL THEN regexp_replace(o, '^"(.*)"\\^\\^<[^>]*>$', '\\1') ELSE o END ELSE v END AS val
FROM tx WHERE o_kind <> 'lit' OR o_lang IS NULL OR o_lang = 'en'), y3 AS (SELECT x3.s, string_agg({_V3_TEXT}, ' ' ORDER BY {_TIER6.replace(" s LIKE", " x3.s LIKE")}, n) AS text FROM x3 JOIN lol e ON e.uri = x3.s GROUP BY x3.s)
SELECT sj.s AS uri, coalesce(text, '') AS text FROM sj LEFT JOIN y3 USING (s)""")
_V8_EDGES = f"""ed AS (SELECT DISTINCT s AS u, p, 'out' AS w FROM tr WHERE p = '{SUBCLASS}' OR p LIKE 'http://ex.org/prop%' UNION SELECT DISTINCT o, p, 'in' FROM tr WHERE o_kind = 'uri' AND p = '{SUBCLASS}'),
sg AS (SELECT u, string_agg(DISTINCT lower({_LOCAL_C.replace("uri", "p")}), ', ') FILTER (WHERE w = 'out') AS o1, string_agg(DISTINCT lower({_LOCAL_C.replace("uri", "p")}), ', ') FILTER (WHERE w = 'in') AS i1 FROM ed GROUP BY u)"""
_V8 = f"""SELECT sj.s AS uri, CASE WHEN sj.s LIKE '%prop#%' THEN 'Property: ' || lol.label || '.' || chr(10) ELSE '' END || 'Outgoing relationships: ' || coalesce(o1, 'none') || '.' || chr(10) || 'Incoming relationships: ' || coalesce(i1, 'none') || '.' AS text
FROM sj JOIN lol ON lol.uri = sj.s LEFT JOIN sg ON sg.u = sj.s"""
_register("v8_text", "V8", _ORDERED + f", {_V8_EDGES} {_V8}")
_register("composite_text", "V2+V8", _ORDERED + f", {_V8_EDGES}, a AS ({_V2}), b AS ({_V8}) SELECT uri, a.text || chr(10) || b.text AS text FROM a JOIN b USING (uri)")
_PARENT = f"""pa AS (SELECT s, min(o) FILTER (WHERE p = '{SUBCLASS}') AS sub, min(o) FILTER (WHERE p = '{TYPE}') AS ty FROM tr WHERE o_kind = 'uri' GROUP BY s),
kd AS (SELECT s, CASE WHEN s LIKE 'http://ex.org/nation%' OR s LIKE 'http://ex.org/region%' THEN 'class' WHEN s LIKE '%prop#%' THEN 'predicate' ELSE 'instance' END AS kind FROM sj),
c1 AS (SELECT kd.s, kind, CASE kind WHEN 'class' THEN sub WHEN 'instance' THEN ty END AS p1 FROM kd LEFT JOIN pa ON pa.s = kd.s),
c2 AS (SELECT c1.*, b.sub AS p2 FROM c1 LEFT JOIN pa b ON b.s = p1),
c3 AS (SELECT c2.*, b.sub AS p3 FROM c2 LEFT JOIN pa b ON b.s = p2)"""


@query(f"WITH {TRIPLES_SQL}, {_SUBJECTS}, {_PARENT} SELECT s AS uri, concat_ws(' -> ', p1, p2, p3) AS chain FROM c3")
def ancestors_3(spark, sf_dir):
    t, e = _kinds(spark, sf_dir)
    return graph.ancestors(t, e).select("uri", F.array_join("chain", " -> ").alias("chain"))


@query(f"""WITH {TRIPLES_SQL}, {_ENT}, {_LABEL_C}, {_SUBJECTS}, {_PARENT},
ch AS (SELECT DISTINCT '{SUBCLASS}' AS p, s, o FROM tr WHERE p = '{SUBCLASS}' UNION SELECT DISTINCT '{TYPE}', s, o FROM tr WHERE p = '{TYPE}'),
sb AS (SELECT c1.s, lol.label, ch.s AS u, row_number() OVER (PARTITION BY c1.s ORDER BY lol.label, ch.s) AS k FROM c1
  JOIN (SELECT *, row_number() OVER (PARTITION BY p, o ORDER BY (SELECT label FROM lol l2 WHERE l2.uri = ch.s), ch.s) AS r FROM ch) ch ON ch.r <= 6 AND ch.o = c1.p1 AND ch.p = CASE kind WHEN 'class' THEN '{SUBCLASS}' ELSE '{TYPE}' END AND ch.s <> c1.s
  JOIN lol ON lol.uri = ch.s)
SELECT c1.s AS uri, coalesce(string_agg(label, ', ' ORDER BY label, u) FILTER (WHERE k <= 5), '') AS siblings FROM c1 LEFT JOIN sb ON sb.s = c1.s WHERE p1 IS NOT NULL GROUP BY c1.s""")
def siblings_5(spark, sf_dir):
    t, e = _kinds(spark, sf_dir)
    return graph.siblings(t, e).select("uri", F.array_join("siblings", ", ").alias("siblings"))


@query(f"WITH {TRIPLES_SQL}, {_V8_EDGES} SELECT u AS uri, coalesce(o1, '') AS outgoing, coalesce(i1, '') AS incoming FROM sg")
def relational_signature(spark, sf_dir):
    rows = graph.signatures(T.triples(spark, sf_dir))
    return rows.select("uri", F.array_join("outgoing", ", ").alias("outgoing"), F.array_join("incoming", ", ").alias("incoming"))


@query()
def random_walks(spark, sf_dir):
    t, e = _kinds(spark, sf_dir)
    return graph.walks(t, e).select("uri", "walk", "hop", "p", "o")


_register("v5_text", "V5", None)
_register("v7_text", "V7", None)


# ---------------------------------------------------------------- selection


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, e = _kinds(spark, sf_dir)
    return labels.eligible_items(t).join(e, ["graph_id", "uri"])


_KEPT = "p NOT LIKE 'http://ex.org/%'"


@query(f"WITH {TRIPLES_SQL}, {_ENT}, {_LABEL_C}, {_STAR}, {_ITEM_RUN} SELECT s AS uri, count(*) FILTER (WHERE {_KEPT}) AS kept, round(count(DISTINCT CASE WHEN {_KEPT} THEN p END) / CAST(count(DISTINCT p) AS DOUBLE), 9) AS coverage FROM it WHERE d = 1 GROUP BY s")
def covered_filter(spark, sf_dir):
    rows = _items(spark, sf_dir).withColumn("k", selection.covered_filter(F.col("items"), "base", "covered"))
    return rows.select("uri", F.size("k").cast("bigint").alias("kept"), selection.coverage(F.col("items"), F.col("k")).alias("coverage"))


@query(f"WITH {TRIPLES_SQL}, {_ENT}, {_LABEL_C}, {_STAR}, {_ITEM_RUN} SELECT s AS uri, string_agg(text, ' | ' ORDER BY {_TIER6}, n) AS items FROM it WHERE d = 1 GROUP BY s")
def tier_order(spark, sf_dir):
    rows = _items(spark, sf_dir)
    return rows.select("uri", F.array_join(F.transform(selection.tier_order(F.col("items"), F.col("entity_type")), lambda x: x["text"]), " | ").alias("items"))


_NO_SIZE = "p NOT LIKE 'http://ex.org/%'"


def _role_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _items(spark, sf_dir)
    return rows.withColumn("items", F.filter("items", lambda x: ~x["predicate"].startswith(T.NS))).where("size(items) > 0")


_ROLE = "CASE WHEN p LIKE '%rdf-schema#label' THEN 0 WHEN p LIKE '%#prefLabel' THEN 1 WHEN p LIKE '%#altLabel' THEN 2 WHEN p LIKE '%#comment' THEN 3 WHEN p LIKE '%#subClassOf' THEN 4 ELSE 5 END"
_CORE = "CASE WHEN p LIKE '%rdf-schema#label' OR p LIKE '%#type' OR p LIKE '%#subClassOf' THEN 0 ELSE 1 END"


@query(f"""WITH {TRIPLES_SQL}, {_ENT}, {_LABEL_C}, {_STAR}, {_ITEM_RUN} SELECT s AS uri, string_agg(text, ' | ' ORDER BY {_ROLE}, n) AS role, string_agg(text, ' | ' ORDER BY {_CORE}, n) AS core,
string_agg(text, ' | ' ORDER BY p NOT LIKE '%rdf-schema#label', n) AS label FROM it WHERE d = 1 AND {_NO_SIZE} GROUP BY s""")
def serialization_orders(spark, sf_dir):
    rows = _role_items(spark, sf_dir)
    text = lambda o: F.array_join(F.transform(selection.ordered(F.col("items"), lambda p: selection.serial_group(p, o)), lambda x: x["text"]), " | ")
    return rows.select("uri", text("role").alias("role"), text("core").alias("core"), text("label").alias("label"))


@query(f"""WITH {TRIPLES_SQL}, {_ENT}, {_LABEL_C}, {_STAR}, {_ITEM_RUN} SELECT 'synonym' AS role, count(*) AS n_items, count(DISTINCT s) AS n_entities,
CAST(sum(CAST(ceil(len(string_split_regex(trim(text), '\\s+')) * 1.3) AS BIGINT)) AS BIGINT) AS n_tokens FROM it WHERE d = 1 AND p LIKE '%#altLabel'""")
def role_filter(spark, sf_dir):
    return selection.removed_by_role(_role_items(spark, sf_dir), ["synonym"])


@query(f"""WITH {TRIPLES_SQL}, {_ENT}, {_LABEL_C}, {_STAR}, {_ITEM_RUN}, w AS (SELECT s, sum(len(string_split_regex(trim(text), '\\s+'))) + count(*) - 1 + 2 AS n, count(*) AS c FROM it WHERE d = 1 GROUP BY s)
SELECT count(*) AS n_entities, round(avg(n), 9) AS mean_n_tokens, quantile_cont(n, 0.5) AS median_n_tokens, quantile_cont(n, 0.9) AS p90_n_tokens, CAST(max(n) AS INTEGER) AS max_n_tokens, CAST(sum(n) AS BIGINT) AS total_n_tokens,
CAST(sum(c) AS BIGINT) AS total_n_items FROM w""")
def selection_accounting(spark, sf_dir):
    made = selection.select(_items(spark, sf_dir), "full")
    return selection.summary(made, 512).select("n_entities", "mean_n_tokens", "median_n_tokens", "p90_n_tokens", "max_n_tokens", "total_n_tokens", "total_n_items")


@query()
def selection_policies(spark, sf_dir):
    rows = _items(spark, sf_dir)
    made = [selection.select(rows, mode, 16, 0 if mode == "random" else None) for mode in ("ppas", "deterministic", "random")]
    return made[0].unionByName(made[1]).unionByName(made[2]).select("uri", "order_mode", "text", "n_tokens", "truncated")


# ---------------------------------------------------------------- results, tests, reports

_DATASETS = [f"D{k}" for k in range(1, 8)]
_PIVOT = ", ".join(f"round_even(max(v) FILTER (WHERE dataset_id = '{d}'), 4) AS {d}" for d in _DATASETS)


@query(f"WITH {RESULTS_SQL} SELECT condition_id, {_PIVOT} FROM (SELECT condition_id, dataset_id, f1 AS v FROM cols) GROUP BY condition_id")
def condition_pivot(spark, sf_dir):
    return reports.breakdown(T.results(spark, sf_dir), "f1", _DATASETS)


@query(f"WITH {RESULTS_SQL} SELECT condition_id, {_PIVOT} FROM (SELECT condition_id, dataset_id, hits_at_1 AS v FROM cols) GROUP BY condition_id")
def strict_mean_pivot(spark, sf_dir):
    return reports.breakdown(T.results(spark, sf_dir), "hits_at_1", _DATASETS)


@query(f"""WITH {RESULTS_SQL} SELECT condition_id, round_even(avg(mrr), 4) AS mean_mrr, round_even(stddev_pop(mrr), 4) AS std_mrr, round_even(avg(f1), 4) AS mean_f1, round_even(stddev_pop(f1), 4) AS std_f1,
CASE WHEN count(hits_at_1) = count(*) THEN round_even(avg(hits_at_1), 4) END AS mean_hits_at_1, count(*) AS n_columns FROM cols GROUP BY condition_id""")
def summary_two_level(spark, sf_dir):
    return reports.summary(T.results(spark, sf_dir))


@query(f"WITH {RESULTS_SQL}, v AS (SELECT dataset_id, condition_id, round_even(f1, 4) AS best FROM cols), r AS (SELECT *, rank() OVER (PARTITION BY dataset_id ORDER BY best DESC) AS k FROM v) SELECT dataset_id, condition_id, best FROM r WHERE k = 1")
def tied_best(spark, sf_dir):
    return reports.tied_best(reports.column_means(T.results(spark, sf_dir)), "f1")


@query(f"WITH {RESULTS_SQL} SELECT dataset_id, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY mrr DESC, condition_id) AS INTEGER) AS place, condition_id, round(mrr, 9) AS mrr FROM cols")
def condition_ranking(spark, sf_dir):
    return reports.rank_conditions(reports.column_means(T.results(spark, sf_dir)))


@query(f"WITH {RESULTS_SQL} SELECT condition_id, round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) AS micro_f1 FROM res GROUP BY condition_id")
def micro_f1(spark, sf_dir):
    return reports.micro_f1(T.results(spark, sf_dir), "condition_id")


_COMPARE = [("AF-NO", "AF", "NO"), ("RF-NO", "RF", "NO"), ("AF-RF", "AF", "RF")]
_PAIRS_SQL = "cmp(comparison, x, y) AS (VALUES " + ", ".join(f"('{c}', '{a}', '{b}')" for c, a, b in _COMPARE) + f"), {RESULTS_SQL.strip()}, un AS (SELECT comparison, a.dataset_id AS unit, a.f1 AS a, b.f1 AS b FROM cmp JOIN cols a ON a.condition_id = x JOIN cols b ON b.condition_id = y AND b.dataset_id = a.dataset_id)"


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = reports.column_means(T.results(spark, sf_dir))
    compare = spark.createDataFrame(_COMPARE, "comparison string, x string, y string")
    a = columns.select(F.col("condition_id").alias("x"), F.col("dataset_id").alias("unit"), F.col("f1").alias("a"))
    b = columns.select(F.col("condition_id").alias("y"), F.col("dataset_id").alias("unit"), F.col("f1").alias("b"))
    return compare.join(a, "x").join(b, ["y", "unit"]).select("comparison", "unit", "a", "b")


@query(f"""WITH {_PAIRS_SQL}, d AS (SELECT *, round_even(b - a, 12) AS d FROM un) SELECT comparison, count(*) FILTER (WHERE d > 0) AS wins, count(*) FILTER (WHERE d = 0) AS ties, count(*) FILTER (WHERE d < 0) AS losses,
round(avg(a), 9) AS mean_a, round(avg(b), 9) AS mean_b, round(avg(b) - avg(a), 9) AS delta FROM d GROUP BY comparison""")
def win_tie_loss(spark, sf_dir):
    return stats.outcomes(_units(spark, sf_dir))


_SIGNED = f"""WITH {_PAIRS_SQL}, d AS (SELECT *, round_even(b - a, 12) AS d FROM un), nz AS (SELECT comparison, count(*) AS n_units, count(*) FILTER (WHERE d <> 0) AS n_nonzero FROM d GROUP BY 1),
rk AS (SELECT comparison, d, rank() OVER (PARTITION BY comparison ORDER BY abs(d)) + (count(*) OVER (PARTITION BY comparison, abs(d)) - 1) / 2.0 AS r FROM d WHERE d <> 0),
w AS (SELECT comparison, coalesce(sum(r) FILTER (WHERE d > 0), 0) AS wp, coalesce(sum(r) FILTER (WHERE d < 0), 0) AS wm, list(CAST(r AS DOUBLE)) AS l FROM rk GROUP BY 1),
fl AS (SELECT comparison, wp, wm, l, unnest(range(0, CAST(pow(2, len(l)) AS BIGINT))) AS bits FROM w),
ft AS (SELECT comparison, wp, wm, list_sum(l) AS whole, coalesce(list_sum(list_transform(range(0, len(l)), lambda i: CASE WHEN (bits >> i) & 1 = 1 THEN l[i + 1] ELSE 0 END)), 0) AS t FROM fl),
pv AS (SELECT comparison, avg(CASE WHEN least(t, whole - t) <= least(wp, wm) + 1e-9 THEN 1.0 ELSE 0 END) AS p FROM ft GROUP BY 1)"""


@query(_SIGNED + """ SELECT comparison, n_units, n_nonzero, CAST(wp AS DOUBLE) AS w_plus, CAST(wm AS DOUBLE) AS w_minus, CASE WHEN n_units >= 5 THEN round(p, 9) END AS p_value, round((wp - wm) / (wp + wm), 9) AS effect_r,
round(least(1.0, 2.0 / pow(2, n_nonzero)), 9) AS min_attainable_p FROM nz JOIN w USING (comparison) JOIN pv USING (comparison)""")
def wilcoxon_signflip(spark, sf_dir):
    return stats.signed_rank(_units(spark, sf_dir))


@query(f"""WITH {RESULTS_SQL}, t AS (SELECT dataset_id, condition_id, CASE WHEN condition_id = 'NF' THEN NULL ELSE round(mrr / 10, 9) END AS p_value FROM cols),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY p_value NULLS LAST, condition_id) AS k, count(p_value) OVER (PARTITION BY dataset_id) AS m FROM t)
SELECT dataset_id, condition_id, p_value, CASE WHEN p_value IS NOT NULL THEN round(max(least(1.0, (m - k + 1) * p_value)) OVER (PARTITION BY dataset_id ORDER BY k ROWS UNBOUNDED PRECEDING), 9) END AS p_adjusted FROM r""")
def holm_adjust(spark, sf_dir):
    rows = reports.column_means(T.results(spark, sf_dir))
    tests = rows.select("dataset_id", "condition_id", F.when(F.col("condition_id") == "NF", F.lit(None)).otherwise(F.round(F.col("mrr") / 10, 9)).alias("p_value"))
    return stats.holm(tests, ["dataset_id"], "condition_id")


@query(_SIGNED + """, b AS (SELECT comparison, CASE WHEN n_units >= 5 THEN p END AS p, least(1.0, 2.0 / pow(2, n_nonzero)) AS m FROM nz JOIN pv USING (comparison))
SELECT comparison, round(0.05 / count(*) OVER (), 9) AS corrected_alpha, coalesce(p < 0.05 / count(*) OVER (), false) AS significant, coalesce(m >= 0.05 / count(*) OVER (), true) AS underpowered FROM b""")
def bonferroni(spark, sf_dir):
    rows = stats.signed_rank(_units(spark, sf_dir)).withColumn("family", F.lit("x"))
    return stats.bonferroni(rows, ["family"]).select("comparison", "corrected_alpha", "significant", "underpowered")


@query(f"""WITH {RESULTS_SQL}, r AS (SELECT dataset_id, rank() OVER (PARTITION BY dataset_id ORDER BY mrr) + (count(*) OVER (PARTITION BY dataset_id, mrr) - 1) / 2.0 AS rx,
rank() OVER (PARTITION BY dataset_id ORDER BY f1) + (count(*) OVER (PARTITION BY dataset_id, f1) - 1) / 2.0 AS ry FROM res) SELECT dataset_id, round(corr(rx, ry), 9) AS rho, count(*) AS n FROM r GROUP BY dataset_id""")
def spearman(spark, sf_dir):
    rows = T.results(spark, sf_dir).select("dataset_id", F.col("mrr").alias("x"), F.col("f1").alias("y"))
    return stats.spearman(rows, "dataset_id")


def _unit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists, gold = T.ranked(spark, sf_dir), _test_refs(spark, sf_dir)
    def units(table: DataFrame, name: str) -> DataFrame:
        best = ranking.gold_ranks(table, gold)
        return stats.unit_values(best, ranking.predictions(table, gold, F.lit(0.3)), gold).withColumn("condition", F.lit(name)).withColumn("dataset", F.lit("D"))

    return units(lists, "E").unionByName(units(population.reranked(lists.where("rank % 3 <> 0")), "F"))


_UNITS_SQL = f"""WITH {RANKED_SQL}, gs AS (SELECT DISTINCT s, t FROM refs WHERE split = 'test'), r2 AS (SELECT s, t, score, row_number() OVER (PARTITION BY s ORDER BY rank) AS rank FROM ranked WHERE rank % 3 <> 0),
two AS (SELECT 'E' AS c, s, t, score, rank FROM ranked UNION ALL SELECT 'F', s, t, score, rank FROM r2),
bs AS (SELECT c, g.s, min(rank) AS best FROM (SELECT DISTINCT c FROM two) CROSS JOIN gs g LEFT JOIN two USING (c, s, t) GROUP BY 1, 2),
pd AS (SELECT c, s, EXISTS (SELECT 1 FROM gs WHERE gs.s = two.s AND gs.t = two.t) AS ok FROM two WHERE rank = 1 AND score >= 0.3),
ng AS (SELECT c, s, count(*) AS n FROM (SELECT DISTINCT c FROM two) CROSS JOIN gs GROUP BY 1, 2),
uv AS (SELECT c, 'mrr' AS metric, s AS unit, coalesce(1.0 / best, 0) AS c1, 1.0 AS c2, 0.0 AS c3 FROM bs UNION ALL SELECT c, 'hits_at_1', s, CASE WHEN best <= 1 THEN 1.0 ELSE 0 END, 1.0, 0.0 FROM bs
  UNION ALL SELECT coalesce(ng.c, pd.c), 'f1', coalesce(ng.s, pd.s), CASE WHEN ok THEN 1.0 ELSE 0 END, CASE WHEN NOT ok THEN 1.0 ELSE 0 END, coalesce(n, 0) - CASE WHEN ok THEN 1.0 ELSE 0 END FROM ng FULL JOIN pd ON pd.c = ng.c AND pd.s = ng.s)"""


@query(_UNITS_SQL + " SELECT c AS condition, 'D' AS dataset, 'p' AS pair, metric, unit, round(CAST(c1 AS DOUBLE), 9) AS c1, CAST(c2 AS DOUBLE) AS c2, CAST(c3 AS DOUBLE) AS c3 FROM uv")
def unit_values(spark, sf_dir):
    return _unit_rows(spark, sf_dir).select("condition", "dataset", "pair", "metric", "unit", "c1", "c2", "c3")


@query(_UNITS_SQL + """ SELECT c AS condition, 'D' AS dataset, metric, round(CASE WHEN metric = 'f1' THEN CASE WHEN 2 * sum(c1) + sum(c2) + sum(c3) = 0 THEN 0 ELSE 2 * sum(c1) / (2 * sum(c1) + sum(c2) + sum(c3)) END
ELSE sum(c1) / sum(c2) END, 9) AS value, CAST(1 AS BIGINT) AS n_pairs FROM uv GROUP BY c, metric""")
def paired_observed(spark, sf_dir):
    return stats.column_values(_unit_rows(spark, sf_dir))


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.aligned(_unit_rows(spark, sf_dir), spark.createDataFrame([("E-F", "E", "F")], "comparison string, a string, b string"))


@query(_UNITS_SQL + """ SELECT 'E-F' AS comparison, coalesce(a.metric, b.metric) AS metric, coalesce(a.unit, b.unit) AS unit, round(CAST(coalesce(a.c1, 0) AS DOUBLE), 9) AS a1, round(CAST(coalesce(b.c1, 0) AS DOUBLE), 9) AS b1
FROM (SELECT * FROM uv WHERE c = 'E') a FULL JOIN (SELECT * FROM uv WHERE c = 'F') b ON a.metric = b.metric AND a.unit = b.unit""")
def unit_align(spark, sf_dir):
    return _aligned(spark, sf_dir).select("comparison", "metric", "unit", "a1", "b1")


@query()
def bootstrap_tests(spark, sf_dir):
    return stats.paired_tests(_aligned(spark, sf_dir))


@query(f"""WITH {RANKED_SQL}, d AS (SELECT DISTINCT s, t FROM refs), k AS (SELECT count(*) OVER (PARTITION BY s) > 1 AS o, count(*) OVER (PARTITION BY t) > 1 AS i FROM d)
SELECT 'p' AS pair, CASE WHEN o AND i THEN 'N:M' WHEN o THEN '1:N' WHEN i THEN 'N:1' ELSE '1:1' END AS kind, count(*) AS n FROM k GROUP BY 2""")
def reference_cardinality(spark, sf_dir):
    return reports.cardinality(T.refs(spark, sf_dir))


@query(f"WITH {RANKED_SQL}, k AS (SELECT s, count(DISTINCT t) AS k FROM refs GROUP BY s) SELECT 'p' AS pair, CASE WHEN k >= 3 THEN '3+' ELSE CAST(k AS VARCHAR) END AS bucket, count(*) AS n FROM k GROUP BY 2")
def gold_per_source(spark, sf_dir):
    return reports.gold_per_source(T.refs(spark, sf_dir))


@query(f"""WITH {RANKED_SQL}, f AS (SELECT split AS file, s, t FROM refs UNION ALL SELECT 'all', s, t FROM refs), u AS (SELECT DISTINCT file, s, t FROM f), n AS (SELECT DISTINCT file FROM u),
e AS (SELECT a.file AS a, b.file AS b FROM n a JOIN n b ON a.file < b.file)
SELECT e.a, e.b, (SELECT count(*) FROM u x JOIN u y USING (s, t) WHERE x.file = e.a AND y.file = e.b) AS shared_pairs,
(SELECT count(*) FROM (SELECT DISTINCT file, s FROM u) x JOIN (SELECT DISTINCT file, s FROM u) y USING (s) WHERE x.file = e.a AND y.file = e.b) AS shared_sources FROM e""")
def split_overlap(spark, sf_dir):
    rows = T.refs(spark, sf_dir)
    return reports.overlaps(rows.select(F.col("split").alias("file"), "s", "t").unionByName(rows.select(F.lit("all").alias("file"), "s", "t")))


@query(f"WITH {RANKED_SQL} SELECT count(*) AS n_splits, (SELECT count(*) FROM (SELECT DISTINCT s, t FROM refs)) AS n_whole, true AS equal FROM refs")
def split_union(spark, sf_dir):
    rows = T.refs(spark, sf_dir)
    return reports.partitions_whole(rows, rows)


@query(f"""WITH {RESULTS_SQL}, b AS (SELECT dataset_id, f1 AS base FROM cols WHERE condition_id = 'AF'), d AS (SELECT dataset_id, round_even(f1, 4) - round_even(base, 4) AS d FROM cols JOIN b USING (dataset_id) WHERE condition_id <> 'AF')
SELECT dataset_id, count(*) FILTER (WHERE d > 0) AS above, count(*) FILTER (WHERE d < 0) AS below, count(*) FILTER (WHERE d = 0) AS equal FROM d GROUP BY dataset_id""")
def baseline_tally(spark, sf_dir):
    return reports.tally(reports.column_means(T.results(spark, sf_dir)), "AF", "f1")


@query(f"""WITH {RESULTS_SQL}, b AS (SELECT * FROM res WHERE condition_id = 'AF') SELECT r.dataset_id, r.pair_name, r.condition_id, CASE WHEN b.pair_name IS NULL THEN 'no baseline'
ELSE concat_ws(',', CASE WHEN r.tp IS DISTINCT FROM b.tp THEN 'tp' END, CASE WHEN r.hits_at_1 IS DISTINCT FROM b.hits_at_1 THEN 'hits_at_1' END) END AS reasons
FROM res r LEFT JOIN b ON b.dataset_id = r.dataset_id AND b.pair_name = r.pair_name""")
def baseline_mismatch(spark, sf_dir):
    rows = T.results(spark, sf_dir)
    return reports.mismatches(rows, rows.where("condition_id = 'AF'"), ["tp", "hits_at_1"]).withColumn("reasons", F.array_join("reasons", ","))


@query(f"WITH {RANKED_SQL} SELECT 'E' AS condition, 'p' AS pair, s FROM ranked GROUP BY s HAVING count(*) FILTER (WHERE rank = 20 AND CAST(substr(s, 2) AS BIGINT) % 2 = 0) > 0")
def order_mismatch(spark, sf_dir):
    lists = T.ranked(spark, sf_dir)
    return ranking.order_mismatches(lists, lists.where(~((F.col("rank") == 20) & (F.substring("s", 2, 20).cast("bigint") % 2 == 0))))


_DOC_TOKENS = "d AS (SELECT doc_id, CAST(ceil(len(list_filter(string_split_regex(coalesce(text, ''), '[\\s\\x0B]+'), lambda x: x <> '')) * 1.3) AS INTEGER) AS n FROM documents)"


@query(f"""WITH {_DOC_TOKENS} SELECT count(*) AS texts, round(avg(n), 9) AS mean, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.95) AS p95, max(n) AS longest, CAST(sum(least(n, 512)) AS BIGINT) AS read,
count(*) FILTER (WHERE n > 512) AS truncated, CAST(sum(greatest(n - 512, 0)) AS BIGINT) AS discarded, count(*) FILTER (WHERE n > 420) AS over_budget FROM d""")
def token_length_summary(spark, sf_dir):
    rows = T.read(spark, sf_dir, "documents").select(X.estimate_tokens(F.coalesce("text", F.lit(""))).alias("n"))
    return reports.length_summary(rows, 512, 420)


@query(f"WITH {_DOC_TOKENS} SELECT CAST(floor(quantile_cont(n, 0.5) / 8) * 8 AS INTEGER) AS budget FROM d")
def stress_budget(spark, sf_dir):
    from equiweave.functions.budget import stress_budget as floored

    rows = T.read(spark, sf_dir, "documents").select(X.estimate_tokens(F.coalesce("text", F.lit(""))).alias("n"))
    return rows.agg(floored(F.percentile("n", F.lit(0.5))).alias("budget"))


@query("SELECT doc_id, substr(sha1(text), 1, 16) AS fingerprint FROM documents WHERE text IS NOT NULL")
def text_fingerprints(spark, sf_dir):
    from equiweave.functions.hashes import fingerprint

    return T.read(spark, sf_dir, "documents").where("text is not null").select("doc_id", fingerprint(F.col("text")).alias("fingerprint"))


@query(f"""WITH {RESULTS_SQL}, e AS (SELECT *, CASE WHEN condition_id IN ('AF', 'NO') THEN 'class' ELSE 'predicate' END AS et FROM res),
a AS (SELECT pair_name AS condition_id, et, count(*) AS n_pairs, avg(f1) AS f1, 2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS micro FROM e GROUP BY 1, 2)
SELECT c.condition_id, c.n_pairs AS class_n_pairs, p.n_pairs AS predicate_n_pairs, round(c.f1 - p.f1, 9) AS gap_f1, round(c.micro - p.micro, 9) AS gap_micro_f1 FROM a c JOIN a p USING (condition_id) WHERE c.et = 'class' AND p.et = 'predicate'""")
def entity_type_summary(spark, sf_dir):
    rows = T.results(spark, sf_dir)
    rows = rows.select(F.col("pair_name").alias("condition_id"), F.when(F.col("condition_id").isin("AF", "NO"), "class").otherwise("predicate").alias("entity_type"), "f1", "mrr", "tp", "fp", "fn", F.lit(1).alias("n_refs"))
    return reports.entity_type_summary(rows).select("condition_id", "class_n_pairs", "predicate_n_pairs", "gap_f1", "gap_micro_f1")


@query(f"WITH {RESULTS_SQL} SELECT DISTINCT condition_id, dataset_id FROM res r WHERE NOT EXISTS (SELECT 1 FROM res d WHERE d.condition_id = r.condition_id AND d.dataset_id = r.dataset_id AND d.f1 > 0.6)")
def skip_existing(spark, sf_dir):
    rows = T.results(spark, sf_dir)
    return reports.pending(rows.select("condition_id", "dataset_id").distinct(), rows.where("f1 > 0.6"), "condition_id", "dataset_id")


@query(f"""WITH {RESULTS_SQL}, w(condition_id, weight) AS (VALUES ('AF', 1.0), ('NO', -1.0), ('RF', -1.0), ('NF', 1.0)), j AS (SELECT dataset_id AS unit, CAST(weight AS DOUBLE) * f1 AS v FROM cols JOIN w USING (condition_id))
SELECT unit, round(sum(v), 9) AS did FROM j GROUP BY unit HAVING count(*) = 4""")
def difference_in_differences(spark, sf_dir):
    rows = reports.column_means(T.results(spark, sf_dir)).select(F.col("condition_id").alias("condition"), F.col("dataset_id").alias("unit"), F.col("f1").alias("value"))
    return stats.did(rows, "AF", "NO", "RF", "NF")


