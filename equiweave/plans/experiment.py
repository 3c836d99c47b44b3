"""Runs: candidates, texts, vectors, ranking and evaluation of alignment pairs.

Everything is evaluated for all conditions of a pair in one chain of DataFrames; a pair that fails
is reported as a row and the others go on.
"""

from __future__ import annotations

import logging
import math
import platform
import subprocess
import zlib
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equiweave.conditions import BASELINE, CONDITIONS, MODELS, Condition
from equiweave.functions.budget import Budget, Counter, count_input, count_words
from equiweave.operators import metrics, population, ranking
from equiweave.operators.candidates import candidates as lexical
from equiweave.operators.candidates import recall_at
from equiweave.operators.entities import extract, resolved_types
from equiweave.operators.labels import label_b
from equiweave.operators.verbalise import verbalise
from equiweave.schema import PROTOCOL
from equiweave.sources.datasets import Pair
from equiweave.sources.results import stored_keys, write_results

log = logging.getLogger(__name__)
#: Text and role (source or candidate) to a vector column.
Encoder = Callable[[DataFrame, str], DataFrame]


class Kept(list):
    """Cached tables of a run, freed together."""

    def keep(self, table: DataFrame) -> DataFrame:
        self.append(table.persist())
        return self[-1]

    def free(self) -> None:
        while self:
            self.pop().unpersist()


def hashing_encoder(width: int = 256) -> Encoder:
    """A stand-in without a model: signed counts of hashed character trigrams, scaled to unit length."""
    def one(text: str) -> list[float]:
        v = [0.0] * width
        for k in range(max(1, len(text) - 2)):
            h = zlib.crc32(text[k : k + 3].encode())
            v[(h >> 1) % width] += 1.0 if h & 1 else -1.0
        n = math.sqrt(sum(x * x for x in v)) or 1.0
        return [x / n for x in v]

    def run(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(one)

    def encode(texts: DataFrame, role: str) -> DataFrame:
        return texts.withColumn("vec", F.pandas_udf(run, "array<float>")("text"))

    return encode


def stage_one(pair: Pair, top_k: int = 20, padded: bool = True) -> DataFrame:
    """s, t, score, rank: the lexical candidates of a pair."""
    labels = label_b(pair.triples)
    sources = pair.sources.join(labels.where("graph_id = 'source'").select("uri", "label"), "uri")
    targets = extract(pair.graph("target"), pair.entity_type).join(labels.where("graph_id = 'target'").select("uri", "label"), "uri").select("uri", "label")
    return lexical(sources.select("uri", "label"), targets, top_k=top_k, padded=padded)


def typed(pair: Pair, side: str, uris: DataFrame) -> DataFrame:
    """graph_id, uri, entity_type; resolved one by one in mixed pairs."""
    own = uris.select(F.lit(side).alias("graph_id"), "uri").distinct()
    if pair.entity_type != "mixed":
        return own.withColumn("entity_type", F.lit(pair.entity_type))
    return own.join(resolved_types(pair.triples), ["graph_id", "uri"], "left").fillna("instance", ["entity_type"])


def texts(pair: Pair, condition: Condition, found: DataFrame, whole: Counter = count_input, piece: Counter = count_words) -> DataFrame:
    """role, uri, text of the sources and of every listed candidate, each once."""
    budget = Budget(MODELS[condition.model].tokens, whole, piece)
    source = verbalise(condition.strategy, pair.graph("source"), typed(pair, "source", found.select(F.col("s").alias("uri"))), budget)
    target = verbalise(condition.strategy, pair.graph("target"), typed(pair, "target", found.select(F.col("t").alias("uri"))), budget)
    return source.select(F.lit("source").alias("role"), "uri", "text").unionByName(target.select(F.lit("candidate").alias("role"), "uri", "text"))


def vectors(rendered: DataFrame, encode: Encoder) -> DataFrame:
    """role, uri, vec; a text that several entities share is encoded once."""
    out, rendered = [], rendered.persist()
    for role in ("source", "candidate"):
        mine = rendered.where(F.col("role") == role)
        out.append(mine.join(encode(mine.select("text").distinct(), role), "text").select("role", "uri", "vec"))
    return out[0].unionByName(out[1])


def evaluate(pair: Pair, ranked: DataFrame, kept: Kept | None = None) -> DataFrame:
    """condition, pair and the fourteen metrics: tuned on the validation population, scored on the test population."""
    keep = (Kept() if kept is None else kept).keep
    refs = keep(pair.refs.withColumn("pair", F.lit(pair.name)))
    known = refs.where("split = 'train'")
    pairs = ranked.sparkSession.createDataFrame([(pair.name, pair.reference_complete)], "pair string, reference_complete boolean")
    # Each list is read many times below: kept, not made again for every metric.
    lists = keep(population.judgeable(ranked, refs.where("split <> 'train'"), known, pairs))
    parts = keep(population.evaluation_slices(population.populations(pair.sources.select(F.lit(pair.name).alias("pair"), F.col("uri").alias("s")), refs)))
    own = {p: population.reranked(population.restrict(lists, parts.where(F.col("part") == p))) for p in ("val", "test")}
    own = {p: keep(rows) for p, rows in own.items()}
    names = ranked.select("condition", "pair").distinct()
    gold = {p: refs.where(F.col("split") == p).select("pair", "s", "t").join(names, "pair").select("condition", "pair", "s", "t") for p in ("val", "test")}
    tuned = keep(metrics.tune_threshold(own["val"], gold["val"]))
    return metrics.all_metrics(own["test"], gold["test"], metrics.resolve_threshold(tuned, gold["test"].select("condition", "pair").distinct()))


def run_pair(pair: Pair, conditions: list[Condition], encode: Encoder, whole: Counter = count_input, piece: Counter = count_words, kept: Kept | None = None) -> DataFrame:
    """Metrics of the conditions on one pair."""
    kept = Kept() if kept is None else kept
    found = kept.keep(stage_one(pair))
    lists = None
    for c in conditions:
        listed = found.select(F.lit(c.id).alias("condition"), F.lit(pair.name).alias("pair"), "s", "t")
        one = ranking.rerank(listed, vectors(texts(pair, c, found, whole, piece), encode))
        lists = one if lists is None else lists.unionByName(one)
    return evaluate(pair, kept.keep(lists), kept)


def run_baseline(pair: Pair, kept: Kept | None = None) -> DataFrame:
    """Metrics of the lexical order itself, with its candidate recall."""
    kept = Kept() if kept is None else kept
    found = kept.keep(stage_one(pair))
    ranked = found.select(F.lit(BASELINE).alias("condition"), F.lit(pair.name).alias("pair"), "s", "t", "score", "rank")
    recall = recall_at(found, pair.refs.where("split = 'test'").select("s", "t")).select(F.col("recall").alias("candidate_recall_at_20"))
    return evaluate(pair, ranked, kept).crossJoin(recall)  # one row


def provenance(spark: SparkSession) -> Column:
    """How results were made: versions, the commit of this code and whether it was changed, and the time in UTC."""
    def git(*words: str) -> str | None:
        made = subprocess.run(["git", *words], cwd=Path(__file__).parent, capture_output=True, text=True)
        return made.stdout.strip() if made.returncode == 0 else None

    changed = git("status", "--porcelain")
    fields = {
        "run_timestamp": datetime.now(UTC).isoformat(timespec="seconds"), "git_commit": git("rev-parse", "HEAD"), "git_dirty": None if changed is None else bool(changed),
        "python": platform.python_version(), "spark": spark.version,
    }
    return F.struct(*[F.lit(v).cast("boolean" if k == "git_dirty" else "string").alias(k) for k, v in fields.items()])


NAMES = "f1 precision recall threshold mrr hits_at_1 hits_at_5 hits_at_10 recall_at_1 recall_at_5 recall_at_10".split()


def result_rows(measured: DataFrame, pair: Pair, condition: Condition | None) -> DataFrame:
    """Result records as they are stored; no condition is the lexical baseline, which has no model."""
    name = condition.id if condition else BASELINE
    model = MODELS[condition.model] if condition else None
    text = {"strategy": condition.strategy if condition else None, "model_key": condition.model if condition else None, "model_id": model.name if model else None}
    return measured.where(F.col("condition") == name).select(
        F.lit(name).alias("condition_id"), F.lit(pair.dataset).alias("dataset_id"), F.lit(pair.name).alias("pair_name"), *[F.lit(v).cast("string").alias(k) for k, v in text.items()],
        F.lit(model.tokens if model else None).cast("int").alias("token_budget"), F.struct(*NAMES).alias("metrics"), F.struct("tp", "fp", "fn").alias("counts"),
        F.lit(PROTOCOL).alias("evaluation_protocol"), provenance(measured.sparkSession).alias("provenance"), *([] if condition else ["candidate_recall_at_20"]),
    )


def run(spark: SparkSession, pairs: list[Pair], encode: Encoder, ids: list[str] | None = None, out: str | None = None) -> list[tuple[str, str]]:
    """Run registered conditions (and the baseline, if `ids` is not given or names it) on pairs; the failures as (pair, message).

    Results go to the folder `out`; what has a result there is neither run nor written again.
    """
    done = {tuple(r) for r in stored_keys(spark, out).collect()} if out else set()  # at most conditions x pairs
    failures = []
    for pair in pairs:
        todo: list[Condition | None] = [c for c in CONDITIONS if (ids is None or c.id in ids) and pair.dataset.split("_")[0] in c.datasets]
        if ids is None or BASELINE in ids:
            todo.append(None)
        todo = [c for c in todo if (c.id if c else BASELINE, pair.dataset, pair.name) not in done]
        kept = Kept()
        try:
            models = [c for c in todo if c]
            measured = kept.keep(run_pair(pair, models, encode, kept=kept)) if models else None
            for c in todo:
                rows = result_rows(measured, pair, c) if c else result_rows(run_baseline(pair, kept), pair, None)
                if out:
                    write_results(rows, out)
                else:
                    rows.show(truncate=False)
        except Exception as error:  # one pair's failure must not lose the others
            log.exception("pair %s failed", pair.name)
            failures.append((pair.name, str(error)))
        finally:
            kept.free()
    return failures
