"""BPE encoding and decoding by batched numpy merge rounds.

All distinct words of a batch that the worker has not seen lie in one flat symbol array. In each
round every word merges its lowest-ranked neighbour pair; ranks come from a binary search over the
sorted keys ``left * vocabulary + right``. A word ends when none of its pairs has a rank. A piece of
more than LONG bytes is merged alone, rank by rank: its symbols are a linked list, places wait under
the rank of their pair, and a round takes all places of the lowest rank and looks up the pairs next
to them only, so that a piece of n bytes takes about n log n steps.

Reads a tokenizers JSON file of this kind: NFC, white space to blanks, lower case; a split pattern
whose matches are the pieces; byte-level symbols; BPE with an end-of-word suffix; no decoder, so
decoding joins the tokens with blanks. Other settings raise ValueError.

Defined cases: null text is encoded as empty; empty text has no ids and decodes to empty; special
tokens' own strings in a text become their ids; a repeated row is encoded again; input columns
besides the ones named are ignored. Memory of a worker: the vocabulary, one slice of texts and a
word cache of CACHE_WORDS entries and CACHE_IDS ids, emptied when full. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiweave.llm.shared import release_memory, rows_at_once, small_batches

CACHE_WORDS, CACHE_IDS = 150_000, 1 << 22
#: Bytes from which a piece is merged by itself.
LONG = 256
SLICE_CHARS = 1 << 20
# The code points of Unicode's White_Space property.
WHITE = "\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


def lower_each(text: str) -> str:
    """Lower case by character: a capital sigma does not look at its neighbours."""
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


class BatchBpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, config: dict):
        model = config["model"]
        kinds = [x["type"] for x in config["normalizer"]["normalizers"]]
        steps = config["pre_tokenizer"]["pretokenizers"]
        split, level = steps[0], steps[1]
        known = (
            model["type"] == "BPE"
            and kinds == ["NFC", "Replace", "Lowercase"]
            and (split["behavior"], split["invert"]) == ("Removed", True)
            and (level["type"], level["add_prefix_space"], level["use_regex"]) == ("ByteLevel", False, False)
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            and config.get("decoder") is None
            and config.get("post_processor") is None
        )
        if not known:
            raise ValueError("this tokenizer file has settings that are not supported")
        import regex

        self.pieces = regex.compile(split["pattern"]["Regex"]).findall
        self.blank = re.compile(f"[{WHITE}]+")
        vocab: dict[str, int] = model["vocab"]
        special = {x["content"]: x["id"] for x in config["added_tokens"]}
        self.special = special
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        self.marks = tuple(special)
        self.width = 1 + max([*vocab.values(), *special.values()])
        self.tokens = np.array([""] * self.width, dtype=object)
        for token, i in [*vocab.items(), *special.items()]:
            self.tokens[i] = token

        suffix = model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], dtype=np.int64)
        self.final = np.array([vocab[c + suffix] for c in symbols], dtype=np.int64)

        keys, made = [], []
        for left, right in model["merges"]:
            keys.append(vocab[left] * self.width + vocab[right])
            made.append(vocab[left + right])
        keys_by_rank, made_by_rank = np.array(keys, dtype=np.int64), np.array(made, dtype=np.int64)
        order = np.argsort(keys_by_rank, kind="stable")
        self.keys, self.ranks, self.made = keys_by_rank[order], order, made_by_rank
        self.left, self.right = keys_by_rank // self.width, keys_by_rank % self.width
        # A merge may be done at all places of a word in one round unless what it makes takes part in an earlier merge.
        first_use = np.full(self.width, len(keys), dtype=np.int64)
        ranks = np.arange(len(keys))
        np.minimum.at(first_use, keys_by_rank // self.width, ranks)
        np.minimum.at(first_use, keys_by_rank % self.width, ranks)
        self.one_by_one = first_use[made_by_rank] < ranks
        self.cache: dict[str, int] = {}
        self.forget()

    @classmethod
    def from_file(cls, path: str) -> BatchBpe:
        with open(path, encoding="utf-8") as file:
            return cls(json.load(file))

    def forget(self) -> None:
        """Empty the word cache."""
        self.cache.clear()
        self.flat, self.at = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the offsets of each word's."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(sizes)[sizes > 0]
        symbols[ends - 1] = self.final[data[ends - 1]]
        owner = np.repeat(np.arange(len(words)), sizes)
        none = len(self.made)
        done_symbols, done_owner = [], []
        while len(symbols):
            pair = symbols[:-1] * self.width + symbols[1:]
            where = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where((self.keys[where] == pair) & (owner[:-1] == owner[1:]), self.ranks[where], none)
            rank = np.append(rank, none)
            begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(rank, begins)
            counts = np.diff(np.append(begins, len(owner)))
            live = np.repeat(lowest < none, counts)
            if not live.all():
                done_symbols.append(symbols[~live])
                done_owner.append(owner[~live])
                symbols, owner, rank = symbols[live], owner[live], rank[live]
                lowest, counts = lowest[lowest < none], counts[lowest < none]
                if not len(symbols):
                    break
            best = np.repeat(lowest, counts)
            hit = np.flatnonzero(rank == best)
            # Left to right: of touching places only every second one merges; some merges take the first place only.
            run = np.cumsum(np.append(True, np.diff(hit) != 1))
            place = np.arange(len(hit)) - np.flatnonzero(np.append(True, np.diff(run) != 0))[run - 1]
            first = np.append(True, owner[hit[1:]] != owner[hit[:-1]])
            hit = hit[np.where(self.one_by_one[best[hit]], first, place % 2 == 0)]
            symbols[hit] = self.made[rank[hit]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[hit + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        symbols, owner = np.concatenate([np.zeros(0, np.int64), *done_symbols]), np.concatenate([np.zeros(0, np.int64), *done_owner])
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.searchsorted(owner[order], np.arange(len(words) + 1))

    def _merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one word."""
        data = np.frombuffer(word, dtype=np.uint8)
        symbols = self.inner[data]
        symbols[-1] = self.final[data[-1]]
        n, none = len(symbols), len(self.made)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # n and -1 are outside
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(at: np.ndarray) -> None:
            """Put each place under the rank of the pair that begins there."""
            at = at[after[at] < n]
            pair = symbols[at] * self.width + symbols[after[at]]
            where = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where(self.keys[where] == pair, self.ranks[where], none)
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            cuts = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])) if len(rank) else rank
            for a, b, r in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rank)], rank[cuts].tolist(), strict=True):
                if r < none:
                    if r not in waiting:
                        waiting[r] = []
                        heapq.heappush(heap, r)
                    waiting[r].append(at[a:b])

        wait(np.arange(n - 1))
        while heap:
            rank = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(rank)))
            at = at[(symbols[at] == self.left[rank]) & (after[at] < n)]
            at = at[symbols[after[at]] == self.right[rank]]  # places whose pair has gone meanwhile drop out
            if not len(at):
                continue
            if self.one_by_one[rank] and len(at) > 1:
                waiting[rank] = [at[1:]]
                heapq.heappush(heap, rank)
                at = at[:1]
            # Left to right: of touching places only every second one merges.
            new = np.append(True, after[at[:-1]] != at[1:])
            at = at[(np.arange(len(at)) - np.flatnonzero(new)[np.cumsum(new) - 1]) % 2 == 0]
            gone = after[at]
            symbols[at], symbols[gone] = self.made[rank], -1
            after[at] = after[gone]
            inside = after[at] < n
            before[after[at][inside]] = at[inside]
            near = before[at]
            wait(np.unique(np.concatenate([at, near[near >= 0]])))
        return symbols[symbols >= 0]

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the offsets of each word's."""
        long = [len(w) > LONG for w in words]
        if not any(long):
            return self._merge(words)
        ids, at = self._merge([b"" if x else w for w, x in zip(words, long, strict=True)])
        parts = [self._merge_long(w) if x else ids[a:b] for w, x, a, b in zip(words, long, at[:-1], at[1:], strict=True)]
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def _learn(self, words: set[str]) -> None:
        """Add words (runs without white space, or special tokens) to the cache."""
        if len(self.cache) + len(words) > CACHE_WORDS:
            self.forget()
        plain = [w for w in words if w not in self.special]
        special = [w for w in words if w in self.special]
        distinct: dict[str, int] = {}
        owned: list[int] = []
        counts: list[int] = []
        for word in plain:
            pieces = self.pieces(word.lower() if word.isascii() else lower_each(unicodedata.normalize("NFC", word)))
            counts.append(len(pieces))
            for piece in pieces:
                owned.append(distinct.setdefault(piece, len(distinct)))
        ids, at = self._merged([p.encode("utf-8", "surrogatepass") for p in distinct]) if distinct else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        own = np.array(owned, dtype=np.int64)
        lengths = at[own + 1] - at[own] if len(own) else own
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        flat = ids[np.arange(total) + np.repeat(at[own] - (ends - lengths), lengths)]
        bounds = np.concatenate([[0], ends])[np.cumsum(counts, dtype=np.int64)] if counts else np.zeros(0, np.int64)
        marks = np.array([self.special[w] for w in special], dtype=np.int64)
        first = self.at[-1]
        self.at = np.concatenate([self.at, first + bounds, first + total + 1 + np.arange(len(marks))])
        self.flat = np.concatenate([self.flat, flat, marks])
        known = len(self.cache)
        self.cache.update(zip([*plain, *special], range(known, known + len(words)), strict=True))

    def _words(self, text: str) -> list[str]:
        if any(m in text for m in self.marks):
            out: list[str] = []
            for k, part in enumerate(self.special_split(text)):
                out += [part] if k % 2 else filter(None, self.blank.split(part))
            return out
        return [w for w in self.blank.split(text) if w]

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = []
        first = 0
        while first < len(texts):
            end, size = first, 0
            while end < len(texts) and (end == first or size < SLICE_CHARS):
                size += len(texts[end] or "")
                end += 1
            words = [self._words(t or "") for t in texts[first:end]]
            flat = [w for x in words for w in x]
            distinct = set(flat)
            if not self.cache.keys() >= distinct:
                if len(self.cache) + len(distinct) > CACHE_WORDS or len(self.flat) > CACHE_IDS:
                    self.forget()
                self._learn(distinct - self.cache.keys())
            index = np.fromiter(map(self.cache.__getitem__, flat), dtype=np.int64, count=len(flat))
            sizes = self.at[index + 1] - self.at[index]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            ids = self.flat[np.arange(total) + np.repeat(self.at[index] - (ends - sizes), sizes)]
            bounds = np.concatenate([[0], ends])[np.cumsum([0, *map(len, words)])]
            out += [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            first = end
        return out

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(self.tokens[ids].tolist())


_loaded: dict[str, BatchBpe] = {}


def encode(docs: DataFrame, vocabulary: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """The columns `keep`, then n_tokens, ids (array<int>, if with_ids), ids_sha256 and decoded_sha256 of each row's text.

    vocabulary: a tokenizers JSON file that every executor can open by this path; by default the
    one of the installed public_tokenizers package.
    """
    small_batches(docs.sparkSession)
    out = docs.select(*keep, F.col(text).alias("_text"))
    own = out.select(*keep).schema
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + ", n_tokens long, " + "ids array<int>, " * with_ids + "ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (path := vocabulary):
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        bpe = _loaded.get(path) or _loaded.setdefault(path, BatchBpe.from_file(path))
        for part in rows_at_once(batches, 500):
            ids = bpe.encode_batch(part.column(len(keep)).to_pylist())
            small = [x.astype("<u4") for x in ids]
            columns = [part.column(i) for i in range(len(keep))]
            columns.append(pa.array([len(x) for x in ids], pa.int64()))
            if with_ids:
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(small).astype(np.int32) if small else [], pa.int32())))
            columns.append(pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in small], pa.string()))
            columns.append(pa.array([hashlib.sha256(bpe.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*keep, "n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256"])
        bpe.forget()
        release_memory()

    return out.mapInArrow(run, kind)
