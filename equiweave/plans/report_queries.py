"""Queries of texts under a budget, splits, tests, reports and registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equiweave import conditions
from equiweave.functions import budget, text
from equiweave.functions.hashes import item_set_fingerprint
from equiweave.operators import entities as E
from equiweave.operators import audits, graph, labels, metrics, population, ranking, reports, selection, stats, verbalise
from equiweave.plans import registry as R
from equiweave.plans import tables as T
from equiweave.plans.registry import query
from equiweave.plans.tables import RANKED_SQL, RESULTS_SQL, TRIPLES_SQL
from equiweave.vocabulary import LABEL, SUBCLASS, TYPE

# ---------------------------------------------------------------- texts

_HIERARCHY = f"""{R._PARENT},
ch AS (SELECT DISTINCT '{SUBCLASS}' AS p, s, o FROM tr WHERE p = '{SUBCLASS}' UNION SELECT DISTINCT '{TYPE}', s, o FROM tr WHERE p = '{TYPE}'),
sb AS (SELECT c1.s, lol.label, ch.s AS u, row_number() OVER (PARTITION BY c1.s ORDER BY lol.label, ch.s) AS k FROM c1
  JOIN (SELECT ch.*, row_number() OVER (PARTITION BY p, o ORDER BY lol.label, ch.s) AS r FROM ch JOIN lol ON lol.uri = ch.s) ch ON ch.r <= 6 AND ch.o = c1.p1
    AND ch.p = CASE kind WHEN 'class' THEN '{SUBCLASS}' ELSE '{TYPE}' END AND ch.s <> c1.s
  JOIN lol ON lol.uri = ch.s),
si AS (SELECT s, string_agg(label, ', ' ORDER BY label, u) AS si FROM sb WHERE k <= 5 GROUP BY s),
v2 AS ({R._V2}),
hi AS (SELECT c3.s, v2.text AS head, si, l1.label AS l1, l2.label AS l2, l3.label AS l3 FROM c3 JOIN v2 ON v2.uri = c3.s LEFT JOIN si ON si.s = c3.s
  LEFT JOIN lol l1 ON l1.uri = p1 LEFT JOIN lol l2 ON l2.uri = p2 LEFT JOIN lol l3 ON l3.uri = p3)"""
_UP = "'Parents: ' || concat_ws(' -> ', l1, l2, l3) || '.'"
_SIDE = "'Related types include: ' || si || '.'"
_BREAK = "chr(10)"

R.ORACLES["v7_text"] = R._ORDERED + f""", {_HIERARCHY} SELECT s AS uri, concat_ws({_BREAK} || {_BREAK}, head, nullif(concat_ws({_BREAK}, CASE WHEN l1 IS NOT NULL THEN {_UP} END, {_SIDE}), '')) AS text FROM hi"""


def _n(column: str) -> str:
    """Words of a SQL text."""
    return f"len(list_filter(string_split_regex({column}, '\\s+'), lambda w: w <> ''))"


def _greedy(name: str, items: str, before: str, gap: int, most: int) -> str:
    """CTEs that take items (s, i from 1, text) in order while their words fit after `before` (s, text)."""
    return f"""{name}_g AS (SELECT s, CAST(0 AS BIGINT) AS i, CAST({_n("text")} + 2 AS BIGINT) AS used, CAST(NULL AS VARCHAR) AS kept FROM {before}
  UNION ALL SELECT g.s, t.i, CASE WHEN used + {_n("t.text")} + CASE WHEN kept IS NULL THEN 0 ELSE {gap} END <= {most} THEN used + {_n("t.text")} + CASE WHEN kept IS NULL THEN 0 ELSE {gap} END ELSE used END,
    CASE WHEN used + {_n("t.text")} + CASE WHEN kept IS NULL THEN 0 ELSE {gap} END <= {most} THEN concat_ws('{" | " if gap else " "}', kept, t.text) ELSE kept END
  FROM {name}_g g JOIN {items} t ON t.s = g.s AND t.i = g.i + 1),
{name} AS (SELECT s, coalesce(arg_max(kept, i), '') AS text FROM {name}_g GROUP BY s)"""


_TIER4 = "CASE WHEN p LIKE '%#type' OR p LIKE '%rdf-schema#label' OR p LIKE '%#prefLabel' THEN 0 ELSE 99 END"
_X3 = f"""x3 AS (SELECT *, CASE WHEN o_kind = 'lit' THEN CASE WHEN o_lang IS NULL THEN regexp_replace(o, '^"(.*)"\\^\\^<[^>]*>$', '\\1') ELSE o END ELSE v END AS val FROM tx WHERE o_kind <> 'lit' OR o_lang IS NULL OR o_lang = 'en'),
i3 AS (SELECT x3.s, row_number() OVER (PARTITION BY x3.s ORDER BY {R._TIER6.replace(" s LIKE", " x3.s LIKE")}, n) AS i, {R._V3_TEXT} AS text FROM x3 JOIN lol e ON e.uri = x3.s)"""
_I6 = f"i6 AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY {R._TIER6}, n) AS i, k || ': ' || v AS text FROM tx)"
_NONE = "e0 AS (SELECT s, '' AS text FROM sj)"
_RECURSIVE = R._ORDERED.replace("WITH ", "WITH RECURSIVE ", 1)


def _composed(a: str, b: str) -> str:
    return f"SELECT {a}.s AS uri, concat_ws({_BREAK}, nullif(trim({a}.text), ''), nullif(trim({b}.text), '')) AS text FROM {a} JOIN {b} USING (s)"


def _budgeted(strategy: str, tokens: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        triples, kinds = R._kinds(spark, sf_dir)
        return verbalise.verbalise(strategy, triples, kinds, verbalise.Budget(tokens)).select("uri", "text")

    return run


def _register(name: str, strategy: str, tokens: int, sql: str) -> None:
    run = _budgeted(strategy, tokens)
    run.__name__ = name
    query(sql)(run)


_register("v6_budgeted", "V6", 12, _RECURSIVE + f", {_NONE}, {_I6}, {_greedy('a', 'i6', 'e0', 1, 12)} SELECT s AS uri, text FROM a")
_register("v3_budgeted", "V3", 16, _RECURSIVE + f", {_NONE}, {_X3}, {_greedy('a', 'i3', 'e0', 0, 16)} SELECT s AS uri, text FROM a")
_register("v6_v3_budgeted", "V6+V3", 28, _RECURSIVE + f", {_NONE}, {_I6}, {_X3}, {_greedy('a', 'i6', 'e0', 1, 28)}, {_greedy('b', 'i3', 'a', 0, 28)} {_composed('a', 'b')}")
_register("v4_v6_budgeted", "V4+V6", 26, _RECURSIVE + f""", {_NONE}, {_I6},
w4 AS (SELECT s, sum({_n("k || ': ' || v")}) + count(*) - 1 + 2 > 26 AS over FROM tx GROUP BY s),
i4 AS (SELECT tx.s, row_number() OVER (PARTITION BY tx.s ORDER BY CASE WHEN over THEN {_TIER4} ELSE 0 END, n) AS i, k || ': ' || v AS text FROM tx JOIN w4 USING (s)),
{_greedy('a', 'i4', 'e0', 1, 26)}, {_greedy('b', 'i6', 'a', 1, 26)} {_composed('a', 'b')}""")
_STEPS = f"""st7 AS (SELECT s, head, unnest([concat_ws({_BREAK}, CASE WHEN l1 IS NOT NULL THEN {_UP} END, {_SIDE}), CASE WHEN l3 IS NOT NULL THEN {_UP} END,
  CASE WHEN l2 IS NOT NULL THEN 'Parents: ' || concat_ws(' -> ', l1, l2) || '.' END, CASE WHEN l1 IS NOT NULL THEN 'Parents: ' || l1 || '.' END, '']) AS tail, generate_subscripts([1, 2, 3, 4, 5], 1) AS k FROM hi),
fi7 AS (SELECT s, head, arg_min(tail, k) AS tail FROM st7 WHERE tail IS NOT NULL AND ({_n("head")} + {_n("tail")} + 2 <= 14 OR k = 5) GROUP BY s, head),
tx7 AS (SELECT s, concat_ws({_BREAK}, head, nullif(tail, '')) AS text FROM fi7)"""
_register("v2_v7_budgeted", "V2+V7", 14, R._ORDERED + f""", {_HIERARCHY}, {_STEPS}
SELECT s AS uri, CASE WHEN {_n("text")} <= 12 THEN text ELSE regexp_extract(text, '^(\\S+\\s+){{11}}\\S+') END AS text FROM tx7""")


@query(f"""WITH d AS (SELECT doc_id, {_n("text")} AS n FROM documents WHERE text IS NOT NULL) SELECT count(*) FILTER (WHERE n > 98) AS n_cut, CAST(coalesce(sum(n - 98) FILTER (WHERE n > 98), 0) AS BIGINT) AS tokens_cut FROM d""")
def budget_cut(spark, sf_dir):
    rows = T.read(spark, sf_dir, "documents").where("text is not null").select(F.regexp_replace("text", r"\s+", " ").alias("text"))
    kept = budget.cut_text(F.col("text"), budget.Budget(100))
    rows = rows.select(F.trim("text").alias("text")).select("text", kept.alias("kept"))
    n, tokens = budget.cut_counts(F.col("text"), F.col("kept"))
    return rows.agg(n.alias("n_cut"), tokens.cast("bigint").alias("tokens_cut"))


@query(f"SELECT doc_id, CAST({_n('text')} + 2 AS INTEGER) AS n_tokens FROM documents WHERE text IS NOT NULL")
def input_lengths(spark, sf_dir):
    return T.read(spark, sf_dir, "documents").where("text is not null").select("doc_id", budget.token_count(F.regexp_replace("text", r"\s+", " ")).alias("n_tokens"))


@query(f"WITH {TRIPLES_SQL}, {R._ENT}, {R._LABEL_C}, sl AS (SELECT s, string_agg(l, ', ' ORDER BY l) AS labels FROM (SELECT DISTINCT tr.s, tr.o, lol.label AS l FROM tr JOIN lol ON lol.uri = tr.o WHERE p = '{SUBCLASS}' AND o_kind = 'uri') GROUP BY s) SELECT s AS uri, labels FROM sl")
def schema_labels(spark, sf_dir):
    return graph.schema_labels(T.triples(spark, sf_dir), SUBCLASS).select("uri", "labels")


@query(f"WITH {TRIPLES_SQL} SELECT s AS uri, o AS comment FROM tr WHERE p LIKE '%rdf-schema#comment'")
def first_comments(spark, sf_dir):
    return graph.first_comments(T.triples(spark, sf_dir)).select("uri", "comment")


@query(f"""WITH {TRIPLES_SQL}, v AS (SELECT s, p, trim(regexp_replace(o, '^"(.*)"\\^\\^<[^>]*>$', '\\1')) AS x FROM tr WHERE o_kind = 'lit') SELECT s AS uri, string_agg(x, ' ' ORDER BY p, x) AS attr FROM v
WHERE len(x) BETWEEN 3 AND 200 AND NOT regexp_matches(x, '^[+-]?[\\d.,]+([eE][+-]?\\d+)?$') GROUP BY s""")
def attribute_text(spark, sf_dir):
    return labels.attribute_text(T.triples(spark, sf_dir)).select("uri", "attr")


@query(R._entity_sql(f", {R._ENT} SELECT s AS uri, CASE WHEN CAST(hash(s) AS VARCHAR) = '' THEN '' WHEN s IN (SELECT s FROM cl) THEN 'class' WHEN s IN (SELECT s FROM pd) THEN 'predicate' ELSE 'instance' END AS mixed, 'class' AS plain FROM (SELECT DISTINCT s FROM tr)"))
def type_for_pair(spark, sf_dir):
    rows = E.resolved_types(T.triples(spark, sf_dir))
    return rows.select("uri", E.type_for(F.lit("mixed"), F.col("entity_type")).alias("mixed"), E.type_for(F.lit("class"), F.col("entity_type")).alias("plain"))


@query(f"""WITH {TRIPLES_SQL}, {R._ENT}, {R._LABEL_C}, {R._STAR} SELECT s AS uri, CAST(n AS INTEGER) AS n, {R._LOCAL_C.replace("uri", "p")} || ': ' || CASE WHEN o_kind = 'lit' THEN o ELSE {R._LOCAL_C.replace("uri", "o")} END AS text FROM st""")
def cost_rendering(spark, sf_dir):
    stars = labels.star(T.triples(spark, sf_dir))
    return stars.select(F.col("s").alias("uri"), "n", labels.cost_text(stars).alias("text"))


_CHOSEN = f"{_RECURSIVE}, {R._ITEM_RUN}, {_NONE}, io AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY n) AS i, text FROM it WHERE d = 1), {_greedy('a', 'io', 'e0', 1, 16)}"


@query(_CHOSEN + f", c AS (SELECT s, sum({_n('text')}) + count(*) + 1 > 16 AS truncated FROM io GROUP BY s) SELECT a.s AS uri, text, CAST({_n('text')} + 2 AS INTEGER) AS n_tokens, truncated FROM a JOIN c USING (s)")
def selection_deterministic(spark, sf_dir):
    return selection.select(R._items(spark, sf_dir), "deterministic", 16).select("uri", "text", "n_tokens", "truncated")


@query(f"""WITH {TRIPLES_SQL}, {R._ENT}, {R._LABEL_C}, {R._STAR}, {R._ITEM_RUN}, b AS (SELECT s, string_agg(text, ' | ' ORDER BY n) FILTER (WHERE k2 % 2 = 1) AS text FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY n) AS k2 FROM it WHERE d = 1) GROUP BY s) SELECT s AS uri, text FROM b""")
def join_items(spark, sf_dir):
    rows = R._items(spark, sf_dir)
    every_other = F.filter(F.sequence(F.lit(0), F.size("items") - 1), lambda i: i % 2 == 0)
    return rows.select("uri", text.join_items(F.transform("items", lambda x: x["text"]), F.reverse(every_other)).alias("text"))


@query(f"""WITH {TRIPLES_SQL}, {R._ENT}, {R._LABEL_C}, {R._STAR}, {R._ITEM_RUN}, r AS (SELECT s, {_n("text")} AS w FROM it WHERE d = 1 AND p LIKE '%#altLabel')
SELECT s AS uri, 1 AS lost, 0 AS gained FROM r""")
def selection_changes(spark, sf_dir):
    rows = R._items(spark, sf_dir).select("graph_id", "uri", "items")
    after = rows.withColumn("items", F.filter("items", lambda x: ~x["predicate"].endswith("#altLabel")))
    return selection.changes(rows, after).select("uri", F.size("lost").alias("lost"), F.size("gained").alias("gained"))


@query(f"""WITH {TRIPLES_SQL}, {R._ENT}, {R._LABEL_C}, {R._STAR}, {R._ITEM_RUN} SELECT s AS uri, CAST(count(*) FILTER (WHERE {R._KEPT}) AS INTEGER) AS n_covered,
CAST(count(*) FILTER (WHERE {R._TIER6} < 99) AS INTEGER) AS n_tiered FROM it WHERE d = 1 GROUP BY s""")
def covered_and_tiered(spark, sf_dir):
    rows = R._items(spark, sf_dir)
    return rows.select("uri", selection.count_covered(F.col("items"), "base").alias("n_covered"), selection.count_tiered(F.col("items"), F.col("entity_type")).alias("n_tiered"))


@query(f"""WITH {TRIPLES_SQL}, {R._ENT}, {R._LABEL_C}, {R._STAR}, {R._ITEM_RUN} SELECT count(*) AS entities, count(*) AS same FROM (SELECT DISTINCT s FROM it)""")
def item_set_fingerprints(spark, sf_dir):
    """A set's fingerprint does not depend on its order."""
    texts = F.transform("items", lambda x: x["text"])
    rows = R._items(spark, sf_dir).select(item_set_fingerprint(texts).alias("a"), item_set_fingerprint(F.reverse(texts)).alias("b"))
    return rows.agg(F.count("*").alias("entities"), F.count_if(F.col("a") == F.col("b")).alias("same"))


# ---------------------------------------------------------------- splits and samples


@query(f"""WITH {RANKED_SQL}, n AS (SELECT count(DISTINCT s) AS n, count(*) AS rows FROM refs) SELECT greatest(1, CAST(floor(0.2 * n) AS BIGINT)) AS n_val, n - greatest(1, CAST(floor(0.2 * n) AS BIGINT)) AS n_test, CAST(0 AS BIGINT) AS both, rows FROM n""")
def split_by_source(spark, sf_dir):
    rows = population.split_by_source(T.refs(spark, sf_dir).select("s", "t"))
    per = rows.groupBy("s").agg(F.countDistinct("split").alias("k"), F.min("split").alias("split"), F.count("*").alias("rows"))
    return per.agg(F.count_if(F.col("split") == "val").alias("n_val"), F.count_if(F.col("split") == "test").alias("n_test"), F.count_if(F.col("k") > 1).alias("both"), F.sum("rows").alias("rows"))


@query(f"WITH {RANKED_SQL}, n AS (SELECT count(*) AS n FROM refs) SELECT CAST(floor(0.8 * n) AS BIGINT) AS train, CAST(floor(0.1 * n) AS BIGINT) AS val, n - CAST(floor(0.8 * n) AS BIGINT) - CAST(floor(0.1 * n) AS BIGINT) AS test FROM n")
def split_by_row(spark, sf_dir):
    rows = population.split_by_row(T.refs(spark, sf_dir).select(F.monotonically_increasing_id().alias("ord"), "s", "t"))
    return rows.agg(*[F.count_if(F.col("split") == x).alias(x) for x in ("train", "val", "test")])


@query(f"WITH {RANKED_SQL}, o AS (SELECT s, t, row_number() OVER (ORDER BY s || ' ' || t) - 1 AS n, count(*) OVER () AS c FROM (SELECT DISTINCT s, t FROM refs)) SELECT s, t FROM o WHERE n % greatest(1, c // 10) = 0 AND n < greatest(1, c // 10) * 10")
def systematic_sample(spark, sf_dir):
    rows = T.refs(spark, sf_dir).select("s", "t").distinct().withColumn("k", F.concat_ws(" ", "s", "t"))
    return population.systematic_sample(rows, "k", 10).select("s", "t")


@query(f"""WITH {RANKED_SQL}, {R._POP} SELECT 'p' AS pair, CAST(0 AS INTEGER) AS n_train_refs, CAST(count(*) FILTER (WHERE split = 'val') AS INTEGER) AS n_val_refs, CAST(count(*) FILTER (WHERE split = 'test') AS INTEGER) AS n_test_refs,
(SELECT CAST(count(*) AS INTEGER) FROM pop WHERE slice = 'unmatched') AS n_unmatched, (SELECT CAST(count(*) AS INTEGER) FROM pop WHERE s IN (SELECT s FROM ranked)) AS n_ranked FROM refs""")
def population_counts(spark, sf_dir):
    pairs = spark.createDataFrame([("p",)], "pair string")
    rows = population.population_counts(R._populations(spark, sf_dir), T.refs(spark, sf_dir), T.ranked(spark, sf_dir), pairs)
    both = lambda name: (F.col(f"n_val_{name}") + F.col(f"n_test_{name}")).cast("int")
    return rows.select("pair", "n_train_refs", "n_val_refs", "n_test_refs", both("unmatched_sources").alias("n_unmatched"), both("ranked_sources").alias("n_ranked"))


@query(f"WITH {RANKED_SQL} SELECT count(*) AS n_splits, (SELECT count(*) FROM (SELECT DISTINCT s, t FROM refs)) AS n_whole, count(*) = (SELECT count(*) FROM (SELECT DISTINCT s, t FROM refs)) AS equal FROM (SELECT s, t FROM refs WHERE split = 'test' UNION ALL SELECT s, t FROM refs WHERE split = 'val' AND s <> 'v0')")
def split_union_partial(spark, sf_dir):
    rows = T.refs(spark, sf_dir)
    parts = rows.where("split = 'test'").unionByName(rows.where("split = 'val' and s <> 'v0'"))
    return reports.partitions_whole(parts, rows)


@query(f"WITH {RANKED_SQL}, a AS (SELECT DISTINCT s FROM refs WHERE split = 'val'), b AS (SELECT DISTINCT s FROM ranked) SELECT s, 'b' AS side FROM b WHERE s NOT IN (SELECT s FROM a) UNION ALL SELECT s, 'a' FROM a WHERE s NOT IN (SELECT s FROM b)")
def unmatched_keys(spark, sf_dir):
    return stats.unmatched_keys(T.refs(spark, sf_dir).where("split = 'val'"), T.ranked(spark, sf_dir), "s")


# ---------------------------------------------------------------- metrics and tests


@query(f"""WITH {RANKED_SQL}, {R._f1_sql("val", "grid")}, m AS (SELECT max(f1) AS b FROM f), tie AS (SELECT list(threshold ORDER BY threshold) AS l FROM f, m WHERE f1 = b)
SELECT 'E' AS condition, 'p' AS pair, round(l[(len(l) + 1) // 2], 9) AS threshold FROM tie UNION ALL SELECT 'E', 'q', 0.5""")
def resolve_threshold(spark, sf_dir):
    tuned = metrics.tune_threshold(T.ranked(spark, sf_dir), R._test_refs(spark, sf_dir, "val"))
    return metrics.resolve_threshold(tuned, spark.createDataFrame([("E", "p"), ("E", "q")], "condition string, pair string"))


@query(f"WITH {RESULTS_SQL} SELECT condition_id, dataset_id, pair_name, CASE WHEN abs(f1 * (tp + fn) - round(f1 * (tp + fn))) <= 1e-6 THEN round(round(f1 * (tp + fn)) / (tp + 1), 9) END AS hits FROM res")
def hits_from_recall(spark, sf_dir):
    rows = T.results(spark, sf_dir)
    return rows.select("condition_id", "dataset_id", "pair_name", metrics.hits_from_recall(F.col("f1"), F.col("tp") + F.col("fn"), F.col("tp") + 1).alias("hits"))


@query(f"WITH {RESULTS_SQL} SELECT round(sum(f1 * tp) / sum(tp), 9) AS micro_recall FROM res")
def micro_recall(spark, sf_dir):
    return reports.micro_recall(T.results(spark, sf_dir).select(F.col("f1").alias("recall"), F.col("tp").alias("n_refs")))


@query(f"WITH {RESULTS_SQL} SELECT condition_id, CASE WHEN count(hits_at_1) = 7 THEN round(avg(hits_at_1), 9) END AS hits_at_1 FROM cols GROUP BY condition_id")
def complete_mean(spark, sf_dir):
    return reports.complete_mean(reports.column_means(T.results(spark, sf_dir)), "hits_at_1", 7)


@query(f"WITH {RESULTS_SQL} SELECT round(avg(f1), 9) AS mean_a, round(avg(hits_at_1), 9) AS mean_b, round(avg(f1) - avg(hits_at_1), 9) AS gap FROM res WHERE hits_at_1 IS NOT NULL")
def mean_contrast(spark, sf_dir):
    return reports.mean_contrast(T.results(spark, sf_dir), "f1", "hits_at_1")


@query(f"WITH {RESULTS_SQL} SELECT condition_id, CASE WHEN min(tp) = max(tp) THEN CAST(min(tp) AS VARCHAR) ELSE min(tp) || '–' || max(tp) END AS n FROM res GROUP BY condition_id")
def count_or_range(spark, sf_dir):
    return T.results(spark, sf_dir).groupBy("condition_id").agg(reports.count_or_range(F.col("tp")).alias("n"))


_TESTS = f"""WITH {RESULTS_SQL}, b AS (SELECT dataset_id, f1 AS base FROM cols WHERE condition_id = 'AF'),
t AS (SELECT dataset_id AS dataset, 'f1' AS metric, condition_id AS name, f1 - base AS delta, CASE WHEN condition_id = 'NF' AND dataset_id = 'D2' THEN NULL ELSE round(mrr / 20, 9) END AS p_value FROM cols JOIN b USING (dataset_id) WHERE condition_id <> 'AF')"""


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.column_means(T.results(spark, sf_dir))
    base = rows.where("condition_id = 'AF'").select("dataset_id", F.col("f1").alias("base"))
    p = F.when((F.col("condition_id") == "NF") & (F.col("dataset_id") == "D2"), F.lit(None)).otherwise(F.round(F.col("mrr") / 20, 9))
    out = rows.where("condition_id <> 'AF'").join(base, "dataset_id")
    return out.select(F.col("dataset_id").alias("dataset"), F.lit("f1").alias("metric"), F.col("condition_id").alias("name"), (F.col("f1") - F.col("base")).alias("delta"), p.alias("p_value"))


_HOLM = """, r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY p_value NULLS LAST, name) AS k, count(p_value) OVER (PARTITION BY dataset) AS m FROM t),
h AS (SELECT *, CASE WHEN p_value IS NOT NULL THEN max(least(1.0, (m - k + 1) * p_value)) OVER (PARTITION BY dataset ORDER BY k ROWS UNBOUNDED PRECEDING) END AS p_adjusted FROM r)"""


@query(_TESTS + _HOLM + """ SELECT dataset, metric, count(*) AS cells, count(p_value) AS tested, count(*) FILTER (WHERE delta > 0) AS above, count(*) FILTER (WHERE delta < 0) AS below,
count(*) FILTER (WHERE delta > 0 AND coalesce(p_adjusted < 0.05, false)) AS gains, count(*) FILTER (WHERE delta < 0 AND coalesce(p_adjusted < 0.05, false)) AS losses FROM h GROUP BY dataset, metric""")
def baseline_summary(spark, sf_dir):
    return reports.baseline_summary(stats.holm(_tests(spark, sf_dir), ["dataset"], "name"))


@query(_TESTS + _HOLM + " SELECT dataset, name, CASE WHEN dataset <> 'D2' THEN round(p_adjusted, 9) END AS p_adjusted FROM h")
def holm_or_nothing(spark, sf_dir):
    return stats.holm_or_nothing(_tests(spark, sf_dir), ["dataset"], "name").select("dataset", "name", "p_adjusted")


@query(f"WITH {RESULTS_SQL}, w(effect, condition_id, weight) AS (VALUES ('x', 'AF', 1.0), ('x', 'NO', -1.0), ('y', 'RF', 1.0), ('y', 'none', -1.0)), j AS (SELECT effect, dataset_id AS unit, CAST(weight AS DOUBLE) * f1 AS v FROM cols JOIN w USING (condition_id)) SELECT effect, unit, round(sum(v), 9) AS value FROM j GROUP BY effect, unit HAVING count(*) = 2")
def named_effects(spark, sf_dir):
    rows = reports.column_means(T.results(spark, sf_dir)).select(F.col("condition_id").alias("condition"), F.col("dataset_id").alias("unit"), F.col("f1").alias("value"))
    terms = spark.createDataFrame([("x", "AF", 1.0), ("x", "NO", -1.0), ("y", "RF", 1.0), ("y", "none", -1.0)], "effect string, condition string, weight double")
    return stats.effects(rows, terms)


@query(f"""WITH {RESULTS_SQL}, i AS (SELECT condition_id AS name, avg(f1) AS mean, min(f1) - avg(f1) AS ci_low FROM cols GROUP BY 1)
SELECT (SELECT min(name) FROM i WHERE ci_low <= 0) AS chosen, (SELECT arg_max(name, mean) FROM i) AS best""")
def choose_order(spark, sf_dir):
    rows = reports.column_means(T.results(spark, sf_dir)).groupBy(F.col("condition_id").alias("name")).agg(F.avg("f1").alias("mean"), (F.min("f1") - F.avg("f1")).alias("ci_low"))
    return stats.choose_order(rows, ["AF", "NF", "NO", "RF"])


@query(f"WITH {RESULTS_SQL} SELECT bool_and(f1 - 0.4 > 0) AS adopt FROM cols")
def decision_rule(spark, sf_dir):
    return stats.decide(reports.column_means(T.results(spark, sf_dir)).select((F.col("f1") - 0.4).alias("ci_low")))


@query("WITH g AS (SELECT list_max(list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT round(max(d), 9) AS max_drift, round(quantile_cont(d, 0.99), 9) AS p99_drift FROM g")
def vector_drift(spark, sf_dir):
    rows = T.read(spark, sf_dir, "embeddings")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return stats.drift(rows.select("vec_id", F.col("embedding").alias("a")).join(after, "vec_id"))


@query(f"WITH {RESULTS_SQL} SELECT condition_id AS condition, round(avg(f1), 9) AS mean, round(avg(f1) - 2.5 * stddev_samp(f1) / sqrt(count(*)), 9) AS low, round(avg(f1) + 2.5 * stddev_samp(f1) / sqrt(count(*)), 9) AS high FROM cols GROUP BY 1")
def seed_interval(spark, sf_dir):
    rows = reports.column_means(T.results(spark, sf_dir))
    return stats.seed_interval(rows.select(F.col("condition_id").alias("condition"), F.col("f1").alias("value")), 2.5)


# ---------------------------------------------------------------- reports


@query(f"WITH {RESULTS_SQL}, a AS (SELECT dataset_id, pair_name, tp FROM res WHERE condition_id = 'AF'), b AS (SELECT dataset_id, pair_name, tp FROM res WHERE condition_id = 'RF') SELECT count(*) FILTER (WHERE a.pair_name IS NULL) AS added, count(*) FILTER (WHERE b.pair_name IS NULL) AS removed, count(*) FILTER (WHERE a.tp <> b.tp) AS changed, count(*) FILTER (WHERE a.tp = b.tp) AS same FROM a FULL JOIN b ON a.dataset_id = b.dataset_id AND a.pair_name = b.pair_name")
def change_counts(spark, sf_dir):
    rows = T.results(spark, sf_dir)
    return reports.change_counts(rows.where("condition_id = 'AF'"), rows.where("condition_id = 'RF'"), ["dataset_id", "pair_name"], "tp")


@query(f"WITH {RESULTS_SQL}, {', '.join(['x AS (SELECT 1)'])} SELECT condition_id, {', '.join(f'''count(*) FILTER (WHERE dataset_id = '{d}') AS {d}''' for d in R._DATASETS)} FROM res GROUP BY condition_id UNION ALL SELECT 'none', {', '.join('0' if d == 'D1' else 'NULL' for d in R._DATASETS)}")
def coverage_matrix(spark, sf_dir):
    rows = T.results(spark, sf_dir)
    wanted = rows.select("condition_id", "dataset_id").distinct().unionByName(spark.createDataFrame([("none", "D1")], "condition_id string, dataset_id string"))
    return reports.coverage_matrix(wanted, rows, R._DATASETS)


@query(f"WITH {RESULTS_SQL}, c AS (SELECT condition_id, quantile_cont(f1, 0.5) AS m, min(f1) AS low_s, max(f1) AS high_s FROM res GROUP BY 1) SELECT condition_id, round(m, 9) AS median_s, round(low_s, 9) AS low_s, round(high_s, 9) AS high_s, round(m / min(m) OVER (), 9) AS times_cheapest FROM c")
def cost_rows(spark, sf_dir):
    return reports.costs(T.results(spark, sf_dir).select("condition_id", F.col("f1").alias("seconds")))


@query(f"WITH {RESULTS_SQL}, g AS (SELECT pair_name, dataset_id = 'D1' AS d, string_agg(condition_id || dataset_id, ',' ORDER BY condition_id || dataset_id) AS runs, count(*) AS n FROM res GROUP BY 1, 2) SELECT runs, n, false AS repeated FROM g")
def comparability_signatures(spark, sf_dir):
    rows = T.results(spark, sf_dir).select("pair_name", (F.col("dataset_id") == "D1").alias("d"), F.concat("condition_id", "dataset_id").alias("label"))
    return reports.signatures(rows, ["pair_name", "d"]).select(F.array_join("runs", ",").alias("runs"), "n", "repeated")


@query(f"WITH {RESULTS_SQL}, d AS (SELECT condition_id || dataset_id AS unit, round(f1 - mrr, 9) AS delta FROM cols), r AS (SELECT *, row_number() OVER (ORDER BY delta DESC, unit) AS up, row_number() OVER (ORDER BY delta, unit) AS down FROM d) SELECT 'up' AS direction, CAST(up AS INTEGER) AS place, unit, delta FROM r WHERE up <= 3 UNION ALL SELECT 'down', CAST(down AS INTEGER), unit, delta FROM r WHERE down <= 3")
def extreme_movers(spark, sf_dir):
    rows = reports.column_means(T.results(spark, sf_dir))
    return reports.extremes(rows.select(F.concat("condition_id", "dataset_id").alias("unit"), F.round(F.col("f1") - F.col("mrr"), 9).alias("delta")), 3)


@query(f"WITH {RANKED_SQL}, g AS (SELECT s, count(DISTINCT t) AS degree FROM refs WHERE split = 'test' GROUP BY s), j AS (SELECT degree, coalesce(1.0 / best, 0) AS rr FROM g JOIN best USING (s)) SELECT CASE WHEN degree < 2 THEN '0-1' WHEN degree < 4 THEN '2-3' ELSE '>=4' END AS bin, count(*) AS n, round(avg(rr), 9) AS mrr FROM j GROUP BY 1")
def degree_bins(spark, sf_dir):
    gold = R._test_refs(spark, sf_dir)
    degrees = gold.groupBy("s").agg(F.countDistinct("t").alias("degree"))
    best = ranking.gold_ranks(T.ranked(spark, sf_dir), gold).select("s", F.coalesce(1.0 / F.col("best_gold_rank"), F.lit(0.0)).alias("rr"))
    return reports.degree_bins(degrees.join(best, "s"), [2, 4])


@query(f"WITH {RESULTS_SQL} SELECT pair_name, count(DISTINCT tp) AS n FROM res GROUP BY 1 HAVING count(DISTINCT tp) > 1")
def consistency_guard(spark, sf_dir):
    return reports.consistent(T.results(spark, sf_dir), "pair_name", "tp")


@query(f"WITH {RESULTS_SQL} SELECT condition_id, dataset_id, count(*) AS n FROM res GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return reports.duplicates(T.results(spark, sf_dir), "condition_id", "dataset_id")


@query(f"WITH {RESULTS_SQL} SELECT condition_id, dataset_id, coalesce(printf('%.4f', round(hits_at_1, 2)), 'N/A') AS a, coalesce(printf('%+.3f', round(f1 - 0.5, 2)), 'N/A') AS b FROM cols")
def number_formats(spark, sf_dir):
    rows = reports.column_means(T.results(spark, sf_dir))
    return rows.select("condition_id", "dataset_id", text.format4(F.round("hits_at_1", 2)).alias("a"), text.signed3(F.round(F.col("f1") - 0.5, 2)).alias("b"))


_IDS = [c.id for c in conditions.CONDITIONS]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', {k})" for k, c in enumerate(_IDS)) + ") x(id, place)")
def condition_registry(spark, sf_dir):
    return spark.createDataFrame([(c.id, k) for k, c in enumerate(conditions.CONDITIONS)], "id string, place int")


@query(f"WITH {TRIPLES_SQL}, {R._ENT} SELECT s AS uri, min(o) FILTER (WHERE p = '{LABEL}' AND o_kind = 'lit' AND o_lang IS NULL) AS label FROM tr GROUP BY s HAVING label IS NOT NULL")
def predicate_label_table(spark, sf_dir):
    rows = T.triples(spark, sf_dir).where("o_lang is null")
    return labels.predicate_labels(rows).select(F.col("p").alias("uri"), F.col("p_label").alias("label"))


# ---------------------------------------------------------------- audits

_LISTED = f"""WITH {RANKED_SQL}, j AS (SELECT f.s, f.t, r.s IS NOT NULL AS listed FROM refs f LEFT JOIN ranked r ON r.s = f.s AND r.t = f.t WHERE split = 'test'),
p AS (SELECT s, count(*) AS n, count(DISTINCT t) AS k, count(*) FILTER (WHERE listed) AS hits FROM j GROUP BY s),
c AS (SELECT CAST(sum(n) AS BIGINT) AS n_refs, count(*) AS n_sources, count(*) FILTER (WHERE k > 1) AS n_multi_target, count(*) FILTER (WHERE hits > 0) AS n_gold_listed, CAST(sum(hits) AS BIGINT) AS n_refs_listed FROM p)"""


@query(_LISTED + " SELECT 'p' AS pair, *, round(n_gold_listed / n_sources, 9) AS ranking_ceiling, round(n_refs_listed / n_refs, 9) AS candidate_recall, round(n_gold_listed / n_refs, 9) AS f1_recall_ceiling FROM c")
def candidate_ceilings(spark, sf_dir):
    return audits.ceilings(T.ranked(spark, sf_dir), R._test_refs(spark, sf_dir))


@query(_LISTED + " SELECT 'D' AS dataset, round(n_gold_listed / n_sources, 9) AS ranking_ceiling, round(n_gold_listed / n_refs, 9) AS f1_recall_ceiling FROM c")
def column_ceilings(spark, sf_dir):
    return audits.column_ceilings(audits.ceilings(T.ranked(spark, sf_dir), R._test_refs(spark, sf_dir)), spark.createDataFrame([("D", "p")], "dataset string, pair string"))


@query(f"WITH {RANKED_SQL} SELECT s, t, rank FROM ranked WHERE s IN (SELECT s FROM refs WHERE split = 'val')")
def validation_lists(spark, sf_dir):
    return audits.validation_lists(T.ranked(spark, sf_dir), T.refs(spark, sf_dir)).select("s", "t", "rank")


_DENSE = f"""WITH {TRIPLES_SQL}, e AS (SELECT s, bool_or((p = '{TYPE}' AND o LIKE '%owl#Class') OR p = '{SUBCLASS}') AS c,
count(DISTINCT CASE WHEN p LIKE '%rdf-schema#label' OR p LIKE '%rdf-schema#comment' OR p LIKE '%core#prefLabel' OR p LIKE '%core#altLabel' THEN p END) AS n,
bool_or(p LIKE '%rdf-schema#label' OR p LIKE '%core#prefLabel') AS l FROM tr GROUP BY s), d AS (SELECT count(*) AS n_entities, avg(n) AS density, avg(CASE WHEN l THEN 1.0 ELSE 0 END) AS label_coverage FROM e WHERE c)"""


@query(_DENSE + " SELECT 'g' AS graph_id, n_entities, round(density, 9) AS density, round(label_coverage, 9) AS label_coverage FROM d")
def annotation_density(spark, sf_dir):
    return audits.annotation_density(T.triples(spark, sf_dir))


@query(_DENSE + f""", {RESULTS_SQL.strip()}, s AS (SELECT dataset_id, max(f1) FILTER (WHERE condition_id = 'AF') AS a, max(f1) FILTER (WHERE condition_id = 'RF') AS b FROM cols GROUP BY 1)
SELECT dataset_id AS pair, round(density, 9) AS min_density, round(density, 9) AS max_density, round(a, 9) AS score_a, round(b, 9) AS score_b, round(a - b, 9) AS gap FROM s, d WHERE dataset_id <> 'D7'""")
def sparsity_join(spark, sf_dir):
    columns = reports.column_means(T.results(spark, sf_dir)).select(F.col("condition_id").alias("condition"), F.col("dataset_id").alias("pair"), F.col("f1").alias("value"))
    pairs = columns.select("pair", F.lit("g").alias("source"), F.when(F.col("pair") == "D7", "missing").otherwise("g").alias("target")).distinct()
    return audits.sparsity_rows(pairs, audits.annotation_density(T.triples(spark, sf_dir)), columns, "AF", "RF")


@query(f"""WITH {TRIPLES_SQL}, n AS (SELECT regexp_extract(o, '([^/]*)$', 1) AS x, s LIKE '%part#%' AS part FROM tr WHERE o_kind = 'uri')
SELECT count(DISTINCT x) FILTER (WHERE part) AS source, count(DISTINCT x) FILTER (WHERE NOT part) AS target, (SELECT count(*) FROM (SELECT x FROM n WHERE part INTERSECT SELECT x FROM n WHERE NOT part)) AS shared FROM n""")
def shared_identifiers(spark, sf_dir):
    rows = T.triples(spark, sf_dir).withColumn("graph_id", F.when(F.contains("s", F.lit("part#")), "source").otherwise("target"))
    return audits.shared_identifiers(rows, "source", "target")


_EST = "CAST(ceil(len(list_filter(string_split_regex({}, '[\\s\\x0B]+'), lambda x: x <> '')) * 1.3) AS INTEGER)"


@query(f"""WITH t AS (SELECT 'E' || (100 * doc_id) || ' ' || text AS x FROM documents WHERE text IS NOT NULL), c AS (SELECT {_EST.format("x")} AS w, {_EST.format("regexp_replace(x, '" + audits.OPAQUE + "', '', 'g')")} AS o, regexp_matches(x, '{audits.OPAQUE}') AS has FROM t)
SELECT CAST(sum(w) AS BIGINT) AS tokens, CAST(sum(w - o) AS BIGINT) AS id_tokens, round(sum(w - o) / sum(w), 9) AS id_token_share, round(avg(CASE WHEN has THEN 1.0 ELSE 0 END), 9) AS texts_with_id_share FROM c""")
def opaque_share(spark, sf_dir):
    rows = T.read(spark, sf_dir, "documents").where("text is not null")
    return audits.opaque_share(rows.select(F.concat(F.lit("E"), (F.col("doc_id") * 100).cast("string"), F.lit(" "), "text").alias("text")))


@query("SELECT CAST(p_size % 3 AS VARCHAR) AS datatype, count(*) AS n FROM part WHERE p_size % 3 > 0 GROUP BY 1")
def unit_datatypes(spark, sf_dir):
    rows = T.read(spark, sf_dir, "part")
    uri = F.when(F.col("p_size") % 3 == 0, "http://www.w3.org/2001/XMLSchema#int").otherwise(F.concat(F.lit("http://ex.org/unit/"), (F.col("p_size") % 3).cast("string")))
    return audits.unit_datatypes(rows.select(F.lit("lit").alias("o_kind"), F.concat(F.lit('"'), F.col("p_size").cast("string"), F.lit('"^^<'), uri, F.lit(">")).alias("o")))


@query(f"""WITH {TRIPLES_SQL}, {R._ENT}, {R._LABEL_C}, {R._STAR}, {R._ITEM_RUN}, i AS (SELECT s, n, p, {_EST.format("text")} AS w FROM it WHERE d = 1), h AS (SELECT s, bool_or(p = '{LABEL}') AS has FROM i GROUP BY s),
k AS (SELECT s, p, w, row_number() OVER (PARTITION BY s ORDER BY n DESC) AS k FROM i WHERE p NOT LIKE '%#altLabel' AND (s NOT LIKE '%nation%' OR p <> '{LABEL}')),
o AS (SELECT x.s, (SELECT coalesce(sum(w), 0) FROM k y WHERE y.s = x.s AND y.k < x.k) AS o FROM k x WHERE p = '{LABEL}')
SELECT (SELECT count(*) FROM h) AS n_entities, (SELECT count(*) FROM h WHERE has) AS n_with_label, count(*) AS n_label_kept, round(count(*) / (SELECT count(*) FROM h WHERE has), 9) AS label_retention,
quantile_cont(o, 0.5) AS median_label_offset, round(avg(CASE WHEN o = 0 THEN 1.0 ELSE 0 END), 9) AS share_label_first FROM o""")
def label_retention(spark, sf_dir):
    rows = R._items(spark, sf_dir).select("graph_id", "uri", "items")
    gone = lambda x: x["predicate"].endswith("#altLabel") | (F.contains(F.col("uri"), F.lit("nation")) & (x["predicate"] == LABEL))
    return audits.label_retention(rows, rows.withColumn("items", F.reverse(F.filter("items", lambda x: ~gone(x)))))


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts of two runs, which differ for every third document, and their outcomes."""
    rows = T.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("unit"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    other = rows.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return rows, other, rows.select("unit", (F.col("doc_id") % 7 / 7.0).alias("a"), (F.col("doc_id") % 5 / 5.0).alias("b"))


_STRATA = "WITH u AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS unit FROM documents), st AS (SELECT 'all' AS stratum, unit, doc_id FROM u UNION ALL SELECT CASE WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'unchanged' END, unit, doc_id FROM u)"


@query(_STRATA + " SELECT stratum, unit FROM st")
def strata(spark, sf_dir):
    return audits.strata(*_runs(spark, sf_dir))


@query(_STRATA + " SELECT stratum, round(avg((doc_id % 5) / 5.0 - (doc_id % 7) / 7.0), 9) AS delta, count(*) AS n, true AS inside FROM st GROUP BY stratum")
def stratum_contrasts(spark, sf_dir):
    a, b, units = _runs(spark, sf_dir)
    rows = audits.stratum_contrasts(units, audits.strata(a, b, units))
    return rows.select("stratum", "delta", "n", F.col("delta").between(F.col("ci_low"), F.col("ci_high")).alias("inside"))


_REGISTERED = "w(comparison, a, b, dataset) AS (VALUES ('x', 'E', 'F', 'D'), ('y', 'E', 'G', 'D'), ('z', 'E', 'F', 'other')), m(metric) AS (VALUES ('mrr'), ('hits_at_1'), ('f1'))"


@query(R._UNITS_SQL.replace("WITH ", f"WITH {_REGISTERED}, ", 1) + """, v AS (SELECT c, metric, CASE WHEN metric = 'f1' THEN 2 * sum(c1) / (2 * sum(c1) + sum(c2) + sum(c3)) ELSE sum(c1) / sum(c2) END AS value FROM uv GROUP BY c, metric)
SELECT comparison, dataset, m.metric, dataset = 'D' AND b = 'F' AS tested, CASE WHEN dataset <> 'D' THEN 'no results of E' WHEN b = 'G' THEN 'no results of G' END AS reason,
CASE WHEN dataset = 'D' AND b = 'F' THEN round(y.value - x.value, 9) END AS delta, CASE WHEN dataset = 'D' AND b = 'F' THEN true END AS inside FROM w, m JOIN v x ON x.c = 'E' AND x.metric = m.metric JOIN v y ON y.c = 'F' AND y.metric = m.metric""")
def registered_comparisons(spark, sf_dir):
    wanted = spark.createDataFrame([("x", "E", "F", "D"), ("y", "E", "G", "D"), ("z", "E", "F", "other")], "comparison string, a string, b string, dataset string")
    rows = audits.comparison_rows(wanted, R._unit_rows(spark, sf_dir))
    return rows.select("comparison", "dataset", "metric", "tested", "reason", "delta", F.col("delta").between(F.col("ci_low") - 1e-9, F.col("ci_high") + 1e-9).alias("inside"))


@query("SELECT * FROM (VALUES ('F', 'f1', true, false), ('F', 'hits_at_1', true, false), ('F', 'mrr', true, true), ('G', 'f1', false, false), ('G', 'hits_at_1', false, false), ('G', 'mrr', false, false)) x(comparison, metric, tested, adjusted)")
def against_baseline(spark, sf_dir):
    """Holm's adjusted p is at least the p it adjusts, at most twice it in a family of two."""
    wanted = spark.createDataFrame([("E", "D"), ("F", "D"), ("G", "D")], "condition string, dataset string")
    rows = audits.against_baseline(R._unit_rows(spark, sf_dir), wanted, "E")
    return rows.select("comparison", "metric", "tested", F.coalesce(F.col("p_adjusted").between(F.col("p_value"), F.col("p_value") * 2), F.lit(False)).alias("adjusted"))


@query(f"WITH {RESULTS_SQL} SELECT dataset_id, round(x.f1, 9) AS a, round(y.f1, 9) AS b, round(y.f1 - x.f1, 9) AS delta FROM cols x JOIN cols y USING (dataset_id) WHERE x.condition_id = 'AF' AND y.condition_id = 'RF'")
def two_conditions(spark, sf_dir):
    return audits.condition_rows(reports.column_means(T.results(spark, sf_dir)), "AF", "RF", "f1")


@query(f"WITH {RESULTS_SQL} SELECT count(*) AS n, count(*) FILTER (WHERE condition_id <> 'AF') AS n_equal, false AS reproduced FROM res")
def reproduction_check(spark, sf_dir):
    rows = T.results(spark, sf_dir)
    again = rows.withColumn("tp", F.when(F.col("condition_id") == "AF", F.col("tp") + 1).otherwise(F.col("tp")))
    return audits.reproduction(rows, again, ["condition_id", "dataset_id", "pair_name"], ["tp", "hits_at_1"])


@query(f"SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_missing, count(*) FILTER (WHERE doc_id % 3 = 0) AS n_different, count(*) FILTER (WHERE {_n('text')} + 2 > 512) AS n_over, false AS passed FROM documents")
def identity_gate(spark, sf_dir):
    a, b, _ = _runs(spark, sf_dir)
    named = lambda t: t.select(F.col("unit").alias("uri"), "text", budget.token_count(F.regexp_replace("text", r"\s+", " ")).alias("n_tokens"))
    return audits.identity_gate(named(a), named(b), "text", 512)


@query(f"""WITH {RESULTS_SQL} SELECT condition_id, dataset_id, pair_name, concat_ws(';', CASE WHEN condition_id = 'AF' THEN 'dirty or unknown tree' END, CASE WHEN dataset_id = 'D2' THEN 'protocol 1' END,
CASE WHEN dataset_id = 'D1' THEN 'other known pairs' END, CASE WHEN pair_name = 'p1' THEN 'candidate hash differs within the pair' END) AS reasons FROM res""")
def provenance_flags(spark, sf_dir):
    rows = T.results(spark, sf_dir).select(
        "condition_id", "dataset_id", "pair_name", F.when(F.col("condition_id") != "AF", F.lit(False)).alias("git_dirty"), F.when(F.col("dataset_id") == "D2", 1).otherwise(2).alias("evaluation_protocol"),
        F.lit(0).alias("n_train_refs"), F.when(F.col("pair_name") == "p1", F.col("condition_id")).otherwise(F.lit("x")).alias("candidates_sha256"),
    )
    return audits.provenance_flags(rows, {"D1": 5}).withColumn("reasons", F.array_join("reasons", ";"))


@query(f"WITH {RESULTS_SQL} SELECT pair_name, count(*) AS n, string_agg(DISTINCT condition_id, ',' ORDER BY condition_id) AS conditions FROM res GROUP BY pair_name")
def provenance_groups(spark, sf_dir):
    return audits.provenance_groups(T.results(spark, sf_dir), ["pair_name"])
