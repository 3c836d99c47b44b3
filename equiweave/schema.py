"""Schemas of the engine's tables. Everything is keyed; nothing is aligned by position."""

from __future__ import annotations

from pyspark.sql import types as T

TRIPLES = "graph_id string, ord bigint, s string, s_kind string, p string, o string, o_kind string, o_lang string, o_dtype string"
ENTITIES = "pair string, side string, ord int, uri string, entity_type string"
REFS = "pair string, split string, ord bigint, s string, t string"
CANDIDATES = "pair string, s string, t string, score double, rank int"
RANKED = "condition string, pair string, s string, t string, score double, rank int"
ITEMS = "uri string, ord int, predicate string, text string"
VECTORS = "role string, uri string, vec array<float>"

METRICS = (
    "f1 double, precision double, recall double, threshold double, mrr double, hits_at_1 double, hits_at_5 double, hits_at_10 double, "
    "recall_at_1 double, recall_at_5 double, recall_at_10 double"
)
COUNTS = "tp int, fp int, fn int"
POPULATION = (
    "n_train_refs int, n_val_refs int, n_test_refs int, n_val_ranked_sources int, n_test_ranked_sources int, "
    "n_val_unmatched_sources int, n_test_unmatched_sources int, reference_complete boolean"
)
RESULT = (
    "condition_id string, dataset_id string, pair_name string, strategy string, model_key string, model_id string, token_budget int, "
    f"metrics struct<{METRICS.replace(' ', ': ').replace(',: ', ', ')}>, counts struct<{COUNTS.replace(' ', ': ').replace(',: ', ', ')}>, "
    f"per_entity_type map<string, struct<{(METRICS + ', ' + COUNTS + ', n_refs int').replace(' ', ': ').replace(',: ', ', ')}>>, "
    f"population struct<{POPULATION.replace(' ', ': ').replace(',: ', ', ')}>, "
    "n_source_entities int, n_candidates_per_entity int, candidates_sha256 string, evaluation_protocol int"
)
SIDECAR = (
    "threshold double, n_test_refs int, "
    "test_sources array<struct<source: string, ranked: boolean, gold_targets: array<string>, gold_ranks: array<int>, best_gold_rank: int>>, "
    "predictions array<struct<source: string, target: string, score: double, predicted: boolean, correct: boolean>>, "
    "result struct<run_timestamp: string, candidates_sha256: string, git_commit: string>"
)
#: The version of the evaluation rules that results carry.
PROTOCOL = 2

SELECTION = (
    "text string, selected array<int>, n_items int, n_tokens int, truncated boolean, n_oversized int, filter_mode string, order_mode string, "
    "predicate_config_name string, n_covered_items int, n_tiered_items int, n_filtered_items int, predicate_coverage double, n_role_removed_items int"
)


def struct(ddl: str) -> T.StructType:
    """The StructType of a DDL string; needs an active session."""
    return T.StructType.fromDDL(ddl)
