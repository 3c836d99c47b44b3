"""Language of web pages by Bayesian evidence fusion.

The posterior of a language is the product of four factors:
* the text: likelihoods of byte trigrams of the page's visible text, from the counts of all labelled
  documents; a text counts as EVIDENCE trigrams at most, as trigrams of one text
  are not independent (all of the text is read, its mean log-likelihood is scaled);
* the declared markup language, by how often pages of each language declare it;
* the address suffix (top-level domain, and the first path segment if it is a language code), by
  how often pages of each language have it;
* a host prior: the host's own share of the language, smoothed towards its domain's, smoothed
  towards the corpus's.
The last three come from sums of the text posteriors over all pages, grouped by value, host and
domain. A page's own posterior is taken out of the sums before they are used for it.

What moves: each task's trigram counts by language, whose sums (at most BUCKETS for each language)
are the model that the driver holds; a row of strings and probabilities for each page; sums are
combined before the shuffle and joined back, where a hot host may be split as skewed.

Defined cases: null html is an empty text, which says nothing; no declared language, no host and
no suffix are values like others (the empty string); a null page_id is a page; repeated rows are
pages of their own; without any labelled document the language is null and its probability 0;
other columns are ignored.
"""

from __future__ import annotations

import html as html_text
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiweave.llm.shared import lower_ascii, materialize, mix, rows_at_once, slices, small_batches, utf8

BUCKETS = 1 << 14
EVIDENCE = 60
#: Pages that the next wider level counts as, when a narrower one is smoothed towards it.
STRENGTH = 8.0
#: Languages whose likelihoods are looked up at once: bounds memory, not the number of languages.
COLUMNS = 16

_HIDDEN = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")
_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,8})", re.I)


def visible(html: str) -> str:
    return html_text.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", html)))


def declared(html: str) -> str:
    """Primary subtag of the html element's lang attribute, lower case; empty without one."""
    found = _DECLARED.search(html)
    return found[1].lower() if found else ""


def address(url: str | None) -> tuple[str, str, str, str]:
    """Host, domain (last two labels), suffix (last label) and first path segment, lower case; empty without."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").rstrip(".").lower()
    except ValueError:
        return "", "", "", ""
    labels = host.split(".")
    return host, ".".join(labels[-2:]), labels[-1], parts.path.strip("/").split("/")[0].lower()


@dataclass
class TextModel:
    languages: list[str]
    table: np.ndarray  # log-probability of each trigram bucket in each language


def trigrams(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each run of three bytes inside a text, and each text's offsets; ASCII lower case."""
    flat = lower_ascii(flat).astype(np.uint64)
    sizes = np.maximum(np.diff(at) - 2, 0)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    if len(flat) < 3:
        return np.zeros(0, np.int64), ends
    code = mix(flat[:-2] | flat[1:-1] << np.uint64(8) | flat[2:] << np.uint64(16)) % np.uint64(BUCKETS)
    place = np.arange(ends[-1]) - np.repeat(ends[:-1], sizes) + np.repeat(at[:-1], sizes)
    return code[place].astype(np.int64), ends


def trigram_counts(docs: DataFrame) -> DataFrame:
    """lang, bucket and n of all texts of docs (text, lang), summed by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in rows_at_once(batches):
            flat, at = utf8(batch.column(0))
            languages = batch.column(1).to_pylist()
            for first, end, part, part_at in slices(flat, at):
                code, ends = trigrams(part, part_at)
                own = languages[first:end]
                known = {x: i for i, x in enumerate(dict.fromkeys(own))}
                which = np.repeat([known[x] for x in own], np.diff(ends))
                counts = np.bincount(which * BUCKETS + code, minlength=len(known) * BUCKETS).reshape(-1, BUCKETS)
                for x, i in known.items():
                    sums[x] = sums.get(x, 0) + counts[i]
        for x, counts in sums.items():
            some = np.flatnonzero(counts)
            # A language of texts without trigrams is known all the same.
            some = some if len(some) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(counts[some].astype(np.int64))], ["lang", "bucket", "n"])

    return docs.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> TextModel:
    """The model of docs (text, lang), neither null."""
    found = trigram_counts(docs).toArrow()
    languages = found["lang"].to_pylist()
    known = sorted(set(languages))
    column = {x: i for i, x in enumerate(known)}
    counts = np.full((BUCKETS, len(known)), 0.5)
    np.add.at(counts, (found["bucket"].to_numpy(), np.array([column[x] for x in languages], dtype=np.int64)), found["n"].to_numpy())
    return TextModel(known, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def text_posteriors(model: TextModel, texts: list[str]) -> np.ndarray:
    """Posterior of each language given the text alone, all languages alike before."""
    flat, at = utf8(pa.array(texts, pa.large_string()))
    out = np.zeros((len(texts), len(model.languages)))
    for first, end, part, part_at in slices(flat, at):
        code, ends = trigrams(part, part_at)
        sizes = np.diff(ends)
        filled = np.flatnonzero(sizes)
        if len(filled):
            n = sizes[filled][:, None]
            for k in range(0, len(model.languages), COLUMNS):
                sums = np.add.reduceat(model.table[:, k : k + COLUMNS][code], ends[filled], axis=0, dtype=np.float64)
                out[first + filled, k : k + COLUMNS] = sums / n * np.minimum(n, EVIDENCE)
    out -= out.max(axis=1, keepdims=True, initial=-np.inf)
    weights = np.exp(out)
    return weights / weights.sum(axis=1, keepdims=True)


def evidence(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, host, domain, suffix, markup and p (text posteriors) of each page."""
    languages = set(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 500):
                part = batch.slice(k, 500)
                htmls = [x or "" for x in part.column(2).to_pylist()]
                p = text_posteriors(model, [visible(x) for x in htmls])
                places = [address(u) for u in part.column(1).to_pylist()]
                ends = np.arange(0, p.size + 1, p.shape[1] or 1, dtype=np.int32)[: len(htmls) + 1]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        *[pa.array([x[i] for x in places], pa.string()) for i in range(2)],
                        pa.array([x[2] + ("/" + x[3]) * (x[3] in languages) for x in places], pa.string()),
                        pa.array([declared(x) for x in htmls], pa.string()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(p.ravel())),
                    ],
                    ["page_id", "host", "domain", "suffix", "markup", "p"],
                )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, host string, domain string, suffix string, markup string, p array<double>")


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang, probability, text_lang, markup and host of each page; docs (text, lang) are labelled."""
    small_batches(docs.sparkSession)
    model = fit(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    if not model.languages:
        empty = F.lit(None).cast("string")
        return pages.select(F.col("page_id").cast("long").alias("page_id"), empty.alias("lang"), F.lit(0.0).alias("probability"), empty.alias("text_lang"), empty.alias("markup"), empty.alias("host"))
    rows = materialize(evidence(pages, model), "lang-evidence")
    known = range(len(model.languages))

    def sums(key: str, tag: str) -> DataFrame:
        total = F.array(*[F.sum(F.col("p")[i]) for i in known])
        return materialize(rows.groupBy(F.col(key).alias(f"{tag}_key")).agg(total.alias(tag)), f"lang-{tag}")

    levels = [("host", "by_host"), ("domain", "by_domain"), ("suffix", "by_suffix"), ("markup", "by_markup")]
    whole = rows.agg(F.count("*"), *[F.coalesce(F.sum(F.col("p")[i]), F.lit(0.0)) for i in known]).first()
    n, overall = whole[0], list(whole[1:])
    for key, tag in levels:
        table = sums(key, tag)
        rows = rows.join(table, F.col(key) == F.col(f"{tag}_key")).drop(f"{tag}_key")

    # Each sum is a column of its own: written out for each language, the plan would grow with their square.
    for tag in (t for _, t in levels):
        others = F.zip_with(tag, "p", lambda total, own: F.greatest(total - own, F.lit(0.0)))
        rows = rows.withColumn(tag, others).withColumn(f"{tag}_size", F.aggregate(tag, F.lit(0.0), lambda total, x: total + x))

    def score(own: Column, i: Column) -> Column:
        rest = F.get(F.array(*map(F.lit, overall)), i) - own
        corpus = (rest + 1.0) / F.lit(float(n - 1 + len(known)))
        domain = (F.get("by_domain", i) + STRENGTH * corpus) / (F.col("by_domain_size") + STRENGTH)
        host = (F.get("by_host", i) + STRENGTH * domain) / (F.col("by_host_size") + STRENGTH)
        logs = F.ln(own + 1e-30) + F.ln(host)
        for tag in ("by_suffix", "by_markup"):
            share = (F.col(f"{tag}_size") + 1.0) / F.lit(float(n + 1))
            logs = logs + F.ln((F.get(tag, i) + STRENGTH * share) / (rest + STRENGTH))
        return logs

    rows = rows.withColumn("scores", F.transform("p", score))
    best = F.array_max(F.transform("scores", lambda s, i: F.struct(s.alias("s"), (-i).alias("k"))))
    names = F.array(*map(F.lit, model.languages))
    rows = rows.withColumn("best", best)
    weight = F.aggregate("scores", F.lit(0.0), lambda total, s: total + F.exp(s - F.col("best.s")))
    first = F.array_position("p", F.array_max("p")).cast("int")
    return rows.select(
        "page_id", F.element_at(names, 1 - F.col("best.k")).alias("lang"), (1 / weight).alias("probability"),
        F.element_at(names, first).alias("text_lang"), "markup", "host",
    )
