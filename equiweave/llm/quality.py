"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Tokens are runs of one kind of byte: letters and digits (with all bytes of other characters) or
other signs. Each token is hashed to one of BUCKETS rows. A row's index vector has SEEDS signs at
hashed places of DIM; its word vector adds the index vectors of the tokens that stood next to it
in the training sample, scaled to unit length. A document is pooled as the mean word vector, the
mean product of neighbours' index vectors (large where tokens repeat), the share of tokens in
capitals and of sign tokens, and the log of the token count, each as a mean over the whole text
and as the largest and least mean among PARTS stretches of it. A network of two layers, trained with numpy,
gives a logit; one temperature, fitted on part of the sample that the network has not seen, turns
it into a probability.

The sample: SAMPLE labelled rows and SAMPLE_BYTES bytes of text at most, the ones with the smallest
hash of doc_id, never from the held-out fold crc32(doc_id as text) mod FOLDS = 0. Everything else covers all rows. The model
(about 4 MB, whatever the corpus) is fitted on the driver and broadcast.

Defined cases: null text is empty; text without tokens gets the score of an empty document; a
null doc_id is never held out and never learnt from; labels that are null, repeated or for other
documents are skipped, the larger of a document's labels counts; without labels of both kinds the
score is the share of label 1 (0.5 without any). Repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiweave.llm.shared import bounded_sample, hash_spans, lower_ascii, release_memory, slices, small_batches, utf8

FOLDS = 5
SAMPLE, SAMPLE_BYTES = 8_000, 64 << 20
THRESHOLD = 0.3
BUCKETS, DIM, SEEDS = 1 << 15, 64, 4
PARTS = 6
HIDDEN = 32
#: Bytes of the texts pooled at once, so that their rows stay in cache.
SLICE = 1 << 18

_KIND = np.full(256, 2, dtype=np.uint8)  # 0 blank, 1 letters and digits, 2 signs
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True
_SMALL = np.zeros(256, dtype=bool)
_SMALL[ord("a") : ord("z") + 1] = True


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def tokens(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, capitals flag and sign flag of each token, and the offsets of each text's tokens."""
    kind = _KIND[flat]
    edge = np.ones(len(flat) + 1, dtype=bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[at] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    real = (kind[starts] > 0) & (starts < ends) if len(flat) else np.zeros(0, bool)
    starts, ends = starts[: len(real)][real], ends[: len(real)][real]
    bucket = (hash_spans(lower_ascii(flat), starts, ends) % np.uint64(BUCKETS)).astype(np.int64)
    up = np.cumsum(np.append(0, _CAPITAL[flat]))
    low = np.cumsum(np.append(0, _SMALL[flat]))
    capital = (up[ends] - up[starts] > 1) & (low[ends] == low[starts])
    return bucket, capital, kind[starts] == 2, np.searchsorted(starts, at)


def index_vectors() -> np.ndarray:
    """The fixed sparse sign vectors of all buckets."""
    made = np.random.default_rng(20_240_501)
    out = np.zeros((BUCKETS, DIM), dtype=np.float32)
    for _ in range(SEEDS):
        out[np.arange(BUCKETS), made.integers(0, DIM, BUCKETS)] += made.choice(np.array([-1, 1], np.float32), BUCKETS)
    return out


@dataclass
class Model:
    """Word vectors, scaling, the two layers and the temperature; constant instead if it cannot be fitted."""

    words: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    constant: float | None = None


def word_vectors(texts: pa.Array, index: np.ndarray) -> np.ndarray:
    words = index.copy()
    flat, at = utf8(texts)
    for _, _, part, part_at in slices(flat, at, SLICE):
        bucket, _, _, tokens_at = tokens(part, part_at)
        near = np.ones(max(len(bucket) - 1, 0), dtype=bool)
        inner = tokens_at[(tokens_at > 0) & (tokens_at < len(bucket))]
        near[inner - 1] = False
        a, b = bucket[:-1][near], bucket[1:][near]
        np.add.at(words, a, index[b])
        np.add.at(words, b, index[a])
    return (words / np.maximum(np.linalg.norm(words, axis=1, keepdims=True), 1e-6)).astype(np.float32)


def pooled(flat: np.ndarray, at: np.ndarray, words: np.ndarray, index: np.ndarray) -> np.ndarray:
    """One feature row for each text."""
    bucket, capital, sign, tokens_at = tokens(flat, at)
    n, width = len(at) - 1, 2 * DIM + 2
    counts = np.diff(tokens_at)
    # Stretches: token k of a text with c tokens is in stretch k * PARTS // c.
    owner = np.repeat(np.arange(n), counts)
    place = np.arange(len(bucket)) - np.repeat(tokens_at[:-1], counts)
    cell = owner * PARTS + place * PARTS // np.maximum(np.repeat(counts, counts), 1)
    sums = np.zeros((n * PARTS, width), dtype=np.float32)
    sizes = np.bincount(cell, minlength=n * PARTS).astype(np.float32)
    if len(bucket):
        begins = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        after = np.append(bucket[1:], bucket[-1])
        last = np.append(owner[1:] != owner[:-1], True)
        rows = np.empty((len(bucket), 2 * DIM), dtype=np.float32)
        rows[:, :DIM] = words[bucket]
        rows[:, DIM:] = index[bucket] * index[after]
        rows[last, DIM:] = 0
        ones = np.ones(int(sizes.max()), dtype=np.float32)
        for k, a, b in zip(cell[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(bucket)], strict=True):
            np.dot(ones[: b - a], rows[a:b], out=sums[k, : 2 * DIM])  # far faster than reduceat along rows
        sums[:, 2 * DIM] = np.bincount(cell, capital, n * PARTS)
        sums[:, 2 * DIM + 1] = np.bincount(cell, sign, n * PARTS)
    sums, sizes = sums.reshape(n, PARTS, width), sizes.reshape(n, PARTS, 1)
    whole = sums.sum(axis=1) / np.maximum(sizes.sum(axis=1), 1)
    parts = np.where(sizes > 0, sums / np.maximum(sizes, 1), whole[:, None, :])
    return np.concatenate([whole, parts.max(axis=1), parts.min(axis=1), np.log1p(counts)[:, None]], axis=1).astype(np.float32)


def logits(x: np.ndarray, layers: list[np.ndarray]) -> np.ndarray:
    w1, b1, w2, b2 = layers
    return np.tanh(x @ w1 + b1) @ w2 + b2


def train(x: np.ndarray, y: np.ndarray, seed: int = 7, epochs: int = 30, batch: int = 128, rate: float = 3e-3, decay: float = 1e-3) -> list[np.ndarray]:
    """Two layers by Adam on the log loss."""
    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    first, second, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), batch):
            rows = order[k : k + batch]
            hidden = np.tanh(x[rows] @ layers[0] + layers[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ layers[2] + layers[3], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(error, layers[2]) * (1 - hidden**2)
            grads = [x[rows].T @ back + decay * layers[0], back.sum(0), hidden.T @ error + decay * layers[2], error.sum()]
            step += 1
            pace = rate * (1 - epoch / epochs) + 1e-5
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                layers[i] = layers[i] - pace * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return layers


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, from a grid of powers."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 80))
    losses = [np.mean(np.logaddexp(0, np.where(y > 0, -1, 1) * z / t)) for t in grid]
    return float(grid[int(np.argmin(losses))])


def fit(texts: pa.Array, y: np.ndarray) -> Model:
    """Fit on sample rows in their given order; every fifth serves the temperature and nothing else."""
    y = y.astype(np.float64)
    if not 0 < y.sum() < len(y) or len(y) < 20:
        share = float(y.mean()) if len(y) else 0.5
        return Model(np.zeros((0, DIM), np.float32), np.zeros(0), np.ones(0), [], 1.0, share)
    last = np.arange(len(y)) % 5 == 4
    index = index_vectors()
    words = word_vectors(texts.filter(pa.array(~last)), index)
    flat, at = utf8(texts)
    x = np.concatenate([pooled(part, part_at, words, index) for _, _, part, part_at in slices(flat, at, SLICE)])
    mean, scale = x[~last].mean(0, dtype=np.float64), x[~last].std(0, dtype=np.float64) + 1e-4
    x -= mean.astype(np.float32)
    x /= scale.astype(np.float32)
    layers = train(x[~last], y[~last])
    return Model(words.astype(np.float16), mean, scale, layers, temperature(logits(x[last], layers), y[last]))


def predict(model: Model, texts: pa.Array, index: np.ndarray, words: np.ndarray) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    flat, at = utf8(texts)
    out = [np.zeros(0)]
    for _, _, part, part_at in slices(flat, at, SLICE):
        x = (pooled(part, part_at, words, index) - model.mean) / model.scale
        out.append(1 / (1 + np.exp(-np.clip(logits(x, model.layers) / model.temperature, -30, 30))))
    return np.concatenate(out)


def training_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """text and quality of the labelled rows to learn from, in hash order."""
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.groupBy(F.col("doc_id").alias("key")).agg(F.max("quality").cast("int").alias("_quality"))
    rows = docs.select(F.col("doc_id").alias("key"), F.col("text").cast("string").alias("text"))
    found = bounded_sample(rows, marked.select("key"), size, most_bytes)
    return found.join(marked, "key").orderBy(F.xxhash64("key"), "key", F.xxhash64("text")).select("text", "_quality")


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with its columns packed as struct `row`, and the score of its text."""
    spark = docs.sparkSession
    small_batches(spark)
    learnt = training_sample(docs, labels, sample).toArrow()
    texts, marks = learnt.column(0).combine_chunks(), learnt.column(1).to_numpy()
    del learnt
    model = spark.sparkContext.broadcast(fit(texts, marks))
    del texts
    release_memory()

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = model.value
        index, words = index_vectors(), own.words.astype(np.float32)
        for texts in batches:
            yield pa.array(predict(own, texts, index, words))
        release_memory()

    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), scored(F.col("text").cast("string")).alias("score"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs."""
    return score(docs.select("doc_id", "text"), labels).select(
        F.col("row.doc_id").alias("doc_id"),
        held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject, all columns as they came."""
    return score(docs, labels).where(F.col("score") >= THRESHOLD).select("row.*")
