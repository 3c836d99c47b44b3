"""Quality rules as a short-circuit cascade, cheapest rejection first.

Base counts of a whole text: words, code points in words, characters of ``[#*$%&|<>]``, lines with
a word that equal an earlier line, and words inside 8-word windows that occur twice or more. A base
failure (too few or too often repeated words) ends the cascade; what is left goes through RULES in
the order of rejection per cost. Both are estimated on at most SAMPLE rows and SAMPLE_BYTES bytes of
text, those with the smallest hash of doc_id: cost is the measured time of a rule on the sample, rejection its share of rejected texts.
A rule sees only the texts that no earlier rule rejected. The order changes the work, never the
verdict, which is the conjunction of all rules, so reruns agree although times differ.

Defined cases: null text is empty and fails for its few words; rows repeat their verdict; other
columns are ignored. Nothing is shuffled but the sample's ids.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiweave.llm.shared import bounded_sample, hash_spans, rows_at_once, slices, small_batches, utf8, window_hashes, word_spans

SAMPLE, SAMPLE_BYTES = 1_000, 16 << 20
WINDOW = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30
# Signs that count as symbols.
SYMBOLS = "#*$%&|<>"

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


class Counts:
    """Base counts of a slice of texts, as arrays by row."""

    def __init__(self, flat: np.ndarray, at: np.ndarray):
        starts, ends, words_at = word_spans(flat, at)
        rows = np.arange(len(at) - 1)
        self.n_words = np.diff(words_at)
        # Code points: bytes that do not continue a character.
        heads = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
        long = np.concatenate([[0], np.cumsum(heads[ends] - heads[starts])])
        self.word_chars = np.diff(long[words_at])
        signs = np.concatenate([[0], np.cumsum(_SYMBOL[flat])])
        self.n_symbols = np.diff(signs[at])
        self.n_repeat_words = repeated_words(hash_spans(flat, starts, ends), words_at)
        self.n_lines, self.n_dup_lines = duplicate_lines(flat, at, starts)
        self.rows = rows


def _first_of_each(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place: whether an earlier place has the same owner and value, and the size of its group."""
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    new = np.append(True, (o[1:] != o[:-1]) | (v[1:] != v[:-1])) if len(o) else np.zeros(0, bool)
    begins = np.flatnonzero(new)
    sizes = np.diff(np.append(begins, len(o)))
    later, size = np.zeros(len(o), bool), np.zeros(len(o), np.int64)
    later[order], size[order] = ~new, np.repeat(sizes, sizes)
    return later, size


def repeated_words(words: np.ndarray, at: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Words of each text that lie in a window of `width` words which the text has twice or more."""
    runs, runs_at = window_hashes(words, at, width)
    counts = np.diff(runs_at)
    owner = np.repeat(np.arange(len(counts)), counts)
    # Sorted by hash alone; equal hashes of two texts are told apart by their owners.
    order = np.argsort(runs, kind="stable")
    h, o = runs[order], owner[order]
    same = (h[1:] == h[:-1]) & (o[1:] == o[:-1]) if len(h) else np.zeros(0, bool)
    double = np.zeros(len(runs), dtype=bool)
    double[order[1:][same]] = True
    double[order[:-1][same]] = True
    place = np.flatnonzero(double)
    first = place - runs_at[owner[place]] + at[owner[place]]
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + width, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(change)[: len(words)] > 0)])
    return np.diff(covered[at])


def duplicate_lines(flat: np.ndarray, at: np.ndarray, word_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word of each text, and how many of them equal an earlier one."""
    breaks = np.flatnonzero(flat == 0x0A)
    text_of = np.searchsorted(at, breaks, "right") - 1
    starts = np.sort(np.concatenate([at[:-1], breaks + 1]), kind="stable")
    owner = np.sort(np.concatenate([np.arange(len(at) - 1), text_of]), kind="stable")
    ends = np.empty_like(starts)
    ends[:-1] = np.where(owner[1:] == owner[:-1], starts[1:] - 1, at[owner[:-1] + 1])
    ends[-1:] = at[-1]
    worded = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends, owner = starts[worded], ends[worded], owner[worded]
    later, _ = _first_of_each(owner, hash_spans(flat, starts, ends))
    n = len(at) - 1
    return np.bincount(owner, minlength=n), np.bincount(owner[later], minlength=n)


# ---------------------------------------------------------------- the cascade's rules: True rejects


def symbol_heavy(text: str, c: Counts, row: int) -> bool:
    """More than a symbol for every ten characters of words."""
    return 10 * c.n_symbols[row] > c.word_chars[row]


def line_repeats(text: str, c: Counts, row: int) -> bool:
    """More than three in ten lines repeat an earlier one."""
    return 10 * c.n_dup_lines[row] > 3 * c.n_lines[row]


def odd_word_length(text: str, c: Counts, row: int) -> bool:
    """Words of less than two or more than twenty code points on average."""
    return not 2 * c.n_words[row] <= c.word_chars[row] <= 20 * c.n_words[row]


def shouting(text: str, c: Counts, row: int) -> bool:
    """Letters that are nearly all capitals."""
    upper = sum(map(str.isupper, text))
    return 10 * upper > 7 * sum(map(str.isalpha, text))


_TABLE = re.compile(r"(?:[^\n|]*\|){5}")


def table_like(text: str, c: Counts, row: int) -> bool:
    """Half of the lines at least have five bars."""
    lines = [x for x in text.split("\n") if x.strip()]
    return 2 * sum(bool(_TABLE.match(x)) for x in lines) >= len(lines) > 0


Rule = Callable[[str, Counts, int], bool]
RULES: dict[str, Rule] = {f.__name__: f for f in (symbol_heavy, line_repeats, odd_word_length, shouting, table_like)}


def order_rules(texts: list[str], rules: dict[str, Rule] = RULES, clock: Callable[[], float] = time.perf_counter) -> list[str]:
    """Rule names by rejection per cost on these texts, best first; ties by name."""
    if not texts:
        return sorted(rules)
    flat, at = utf8(pa.array(texts, pa.large_string()))
    parts = list(slices(flat, at))
    counted = [(first, Counts(part, part_at)) for first, _, part, part_at in parts]
    gain = {}
    for name, rule in rules.items():
        began, rejected = clock(), 0
        for first, c in counted:
            rejected += sum(bool(rule(texts[first + k], c, k)) for k in range(len(c.n_words)))
        gain[name] = (rejected / len(texts)) / max(clock() - began, 1e-9)
    return sorted(rules, key=lambda k: (-gain[k], k))


def _verdicts(texts: pa.Array, order: list[str]) -> pa.RecordBatch:
    flat, at = utf8(texts)
    out: list[list[np.ndarray]] = []
    for first, end, part, part_at in slices(flat, at):
        c = Counts(part, part_at)
        failed = (c.n_words < LEAST_WORDS) | (100 * c.n_repeat_words > REPEAT_PERCENT * c.n_words)
        kept = ~failed
        rows = np.flatnonzero(kept)
        plain = dict(zip(rows.tolist(), texts.slice(first, end - first).take(pa.array(rows)).to_pylist(), strict=True))
        for name in order:
            rule = RULES[name]
            rows = [r for r in rows if not rule(plain[int(r)], c, int(r))]
        kept[:] = False
        kept[list(rows)] = True
        out.append([c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, failed, kept])
    columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5 + [np.zeros(0, bool)] * 2
    return [pa.array(x.astype(np.int64)) for x in columns[:5]] + [pa.array(x.astype(bool)) for x in columns[5:]]


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def judge(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of each row of docs."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    keyed = rows.select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    ids = keyed.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(sample)
    texts = [r.text for r in bounded_sample(keyed, ids, sample, SAMPLE_BYTES).collect()]
    order = order_rules(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_at_once(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), *_verdicts(batch.column(1).fill_null(""), order)], ["doc_id", *NAMES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in NAMES[:5]) + ", base_failed boolean, kept boolean")
