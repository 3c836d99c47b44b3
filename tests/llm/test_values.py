"""Collected values for nulls, empty, long, tied and repeated rows, empty tables and clashing names, against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from test_edges import DOCS, LONG, PAGES, TURNS, brute_chat, brute_components, brute_counts, brute_top, expected  # noqa: E402

from equiweave.llm import bpe, chat, langid, linededup, minhash, mixing, quality, rules, shared, topk, warc  # noqa: E402
from equiweave.llm.shared import read_table  # noqa: E402

TWICE = "same text here to see twice\nand a second line of it"
ROWS = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (5, LONG, "b"), (6, TWICE, "c"), (7, TWICE, "c"), (7, TWICE, "c"), (None, "no id but words enough to count", "c"),
        (8, "ÀÉ 中文 🎉\x0bword\x0cend", "\U0001F600"), (9, "x" * 70_000, "b"), (None, None, None)]
CLASHING = ("size", "takes", "kept", "score", "component_id", "row", "cut", "_gone", "hash", "key", "th", "bytes", "_quality", "signature", "node", "h", "block", "sid", "part")


def documents(spark, rows, extra):
    df = spark.createDataFrame([(d, t, "en", s, 0) for d, t, s in rows], DOCS)
    for name in CLASHING if extra else ():
        df = df.withColumn(name, F.lit(1))
    return df


@pytest.fixture(scope="module", params=[False, True], ids=["plain", "clashing"])
def docs(spark, request):
    return documents(spark, ROWS, request.param)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_op1_values(docs):
    got = Counter((r.doc_id, r["size"]) for r in mixing.word_report(docs).collect())
    assert got == Counter((d, len(words(t))) for d, t, _ in ROWS)
    rows = mixing.word_report(docs).collect()
    sizes = Counter()
    for _, t, s in ROWS:
        sizes[s] += len(words(t))
    want = dict(zip(sizes, mixing.targets(list(sizes.items())), strict=True))
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"] and math.isclose(sum(want.values()), sum(sizes.values()))
        assert r.target in want.values() and (r["size"] or not r.copies)
    mixed = mixing.mix(docs).collect()
    assert Counter(len(words(r.text)) for r in mixed)[0] == 0
    assert sum(len(words(r.text)) for r in mixed) == sum(r.taken for r in rows)


def plain_dedup(rows):
    """Texts after removal: every two neighbouring worded lines, and every line of 50 words, that came before in another place."""
    found = defaultdict(list)
    keys = sorted({(d is None, d or 0, t) for d, t in rows if t}, key=lambda x: (x[0], x[1]))
    for key in keys:
        lines = key[2].split("\n")
        worded = [i for i, x in enumerate(lines) if words(x)]
        for i, j in zip(worded, worded[1:], strict=False):
            found["\n".join(lines[i : j + 1])].append((key, i, j + 1))
        for i in worded:
            if len(words(lines[i])) >= 50:
                found[lines[i]].append((key, i, i + 1))
    gone = defaultdict(set)
    for places in found.values():
        for key, a, b in places[1:]:
            gone[key].update(range(a, b))
    return {k: "\n".join(x for i, x in enumerate(k[2].split("\n")) if i not in gone[k]) for k in keys}


def test_op2_values(docs):
    left = plain_dedup([(d, t) for d, t, _ in ROWS])
    want = Counter((d, "" if not t else left[(d is None, d or 0, t)]) for d, t, _ in ROWS)
    got = linededup.report(docs).collect()
    assert Counter((r.doc_id, r.text_sha256) for r in got) == Counter({(d, hashlib.sha256(t.encode()).hexdigest()): n for (d, t), n in want.items()})
    kept = linededup.drop_repeated(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((d, t if not t else left[(d is None, d or 0, t)]) for d, t, _ in ROWS if not t or words(left[(d is None, d or 0, t)]) or t == " \n\t ")


def test_op2_equals_an_independent_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in read_table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    left = plain_dedup(rows)
    for most_bits in (linededup.MOST_BITS, 0):  # by the filter, and by joined places
        docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.xxhash64("text").alias("th"))
        gone = {(r.doc, p) for r in linededup.removals(docs.select(F.col("doc_id").alias("doc"), "th", "text"), most_bits).collect() for p in r.places}
        if most_bits:
            first = gone
        assert gone == first
    got = {r.doc_id: r.text_sha256 for r in linededup.report(read_table(spark, sf_dir, "documents")).collect()}
    assert got == {d: hashlib.sha256((left[(False, d, t)] if t else "").encode()).hexdigest() for d, t in rows}


def test_op6_values(spark, docs):
    labels = spark.createDataFrame([(d, d % 2, 0) for d in range(1, 9)] + [(5, None, 0), (99, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _, _ in ROWS)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert len({r.score for r in got if r.doc_id == 7}) == 1
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1  # null is empty
    assert sorted(map(str, (r.doc_id for r in quality.keep_good(docs, labels).collect()))) == sorted(str(r.doc_id) for r in got if r.score >= 0.3)


def test_op6_with_a_fitted_model_scores_every_kind_of_text(spark, docs):
    rnd = random.Random(1)
    good = [(100 + i, " ".join(rnd.choices("the cat sat on a mat and saw that dogs run".split(), k=40)), "s") for i in range(80)]
    bad = [(300 + i, " ".join(rnd.choices("$$$ BUY !!! %% WIN ### NOW".split(), k=40)), "s") for i in range(80)]
    labels = spark.createDataFrame([(d, 1, 0) for d, _, _ in good] + [(d, 0, 0) for d, _, _ in bad], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(documents(spark, good + bad + ROWS, False), labels).collect()}
    held = [d for d in got if d and d >= 100 and got[d].held_out]
    assert held and all(got[d].predicted == (d < 300) for d in held)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1].score == got[2].score


def test_op7_values(docs):
    named = [(d, t) for d, t, _ in ROWS if d is not None]
    want = brute_components(list(dict(named).items()))
    got = minhash.near_duplicates(docs).collect()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == want[r.doc_id]
    assert Counter(r.doc_id for r in got) == Counter(d for d, _, _ in ROWS)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and 7 not in {r.doc_id for r in kept.collect()}


def test_op8_values(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((d, tuple(library.encode(t or "", add_special_tokens=False).ids)) for d, t, _ in ROWS)
    got = bpe.encode(docs).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    for r in got:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(r.ids, skip_special_tokens=False).encode()).hexdigest()


def test_op9_values(docs):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.judge(docs).collect())
    assert got == Counter((d, *brute_counts(t or "")) for d, t, _ in ROWS)
    assert all(r.kept is False for r in rules.judge(docs).collect() if r.base_failed)


def test_ops_3_5_10_take_clashing_columns(spark):
    rows = [(1, "http://h/1", "<p>a"), (2, None, None), (3, "u", "<p>a"), (None, "u", "x"), (3, "u", "<p>a")]
    pages = spark.createDataFrame(rows, PAGES)
    for name in ("file", "offset", "record_type", "payload", "payload_digest", "value", "refers_to", "hash", "n"):
        pages = pages.withColumn(name, F.lit(1))
    path = shared.scratch_path(spark, "warc-clash")
    warc.write(pages, path)
    assert sorted((tuple(r) for r in warc.read(spark, path).drop("file", "offset").collect()), key=str) == sorted(expected(rows), key=str)
    r = np.random.default_rng(0)
    vectors = [(i, [float(x) for x in r.normal(size=4)]) for i in range(90)] + [(50, [9.0, 0.0, 0.0, 0.0]), (1, None)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    for name in ("v", "q", "asks", "query_id", "block", "part", "rank", "score"):
        table = table.withColumn(name, F.lit(1))
    top = {(a, b): d for a, b, _, d in brute_top(vectors[:90], 50, 5)}
    got = topk.search(table, F.col("vec_id") % 50 == 0)
    assert {(x.query_id, x["rank"]) for x in got.collect()} == set(top)
    turns = [(c, t, ("user", "assistant")[t % 2], f"text {t}") for c in (1, None) for t in range(4)] + [(1, 1, "assistant", "text 1")]
    table = spark.createDataFrame(turns, TURNS)
    for name in ("seq", "piece", "start", "loss_start", "lead", "body", "chars", "run", "c", "r"):
        table = table.withColumn(name, F.lit(1))
    assert {tuple(x)[:5] for x in chat.read_back(shared.materialize(chat.formatted(table), "chat-clash")).collect()} == set(brute_chat(turns))


def plain_bayes(pages, docs):
    """page -> (language, probability) by loops over dictionaries; only the hash of a trigram is the module's."""

    def codes(text):
        flat, at = shared.utf8(pa.array([text], pa.large_string()))
        return langid.trigrams(flat, at)[0].tolist()

    counts = defaultdict(lambda: defaultdict(float))
    for text, lang in docs:
        counts[lang]
        for c in codes(text):
            counts[lang][c] += 1
    langs = sorted(counts)
    sizes = {x: sum(counts[x].values()) + 0.5 * langid.BUCKETS for x in langs}
    own = []
    for _, _, html in pages:
        seen = codes(langid.visible(html or ""))
        logs = [sum(math.log((counts[x][c] + 0.5) / sizes[x]) for c in seen) / len(seen) * min(len(seen), langid.EVIDENCE) if seen else 0.0 for x in langs]
        shares = [math.exp(v - max(logs)) for v in logs]
        own.append([v / sum(shares) for v in shares])
    keys = []
    for _, url, html in pages:
        host, domain, suffix, first = langid.address(url)
        keys.append({"host": host, "domain": domain, "suffix": suffix + ("/" + first if first in langs else ""), "markup": langid.declared(html or "")})
    sums = {level: defaultdict(lambda: [0.0] * len(langs)) for level in ("host", "domain", "suffix", "markup")}
    for key, p in zip(keys, own, strict=True):
        for level in sums:
            sums[level][key[level]] = [a + b for a, b in zip(sums[level][key[level]], p, strict=True)]
    overall, n, out = [sum(p[i] for p in own) for i in range(len(langs))], len(pages), []
    for key, p in zip(keys, own, strict=True):
        other = {level: [max(a - b, 0.0) for a, b in zip(sums[level][key[level]], p, strict=True)] for level in sums}
        scores = []
        for i in range(len(langs)):
            rest = overall[i] - p[i]
            corpus = (rest + 1) / (n - 1 + len(langs))
            domain = (other["domain"][i] + 8 * corpus) / (sum(other["domain"]) + 8)
            host = (other["host"][i] + 8 * domain) / (sum(other["host"]) + 8)
            score = math.log(p[i] + 1e-30) + math.log(host)
            for level in ("suffix", "markup"):
                score += math.log((other[level][i] + 8 * (sum(other[level]) + 1) / (n + 1)) / (rest + 8))
            scores.append(score)
        weights = [math.exp(v - max(scores)) for v in scores]
        out.append((langs[weights.index(max(weights))], max(weights) / sum(weights)))
    return out


def test_op4_equals_plain_bayes(spark, sf_dir):
    pages = [(r.page_id, r.url, r.html) for r in read_table(spark, sf_dir, "pages").collect()]
    docs = [(r.text, r.lang) for r in read_table(spark, sf_dir, "documents").collect() if r.text is not None and r.lang is not None]
    pages += [(10_000, None, None), (10_001, "http://[bad", ""), (10_002, "http://x.de/de/1", "<html lang='de'>")]
    want = dict(zip([p[0] for p in pages], plain_bayes(pages, docs), strict=True))
    table = spark.createDataFrame(pages, PAGES)
    for name in ("lang", "p", "host", "scores", "best", "by_host"):
        table = table.withColumn(name, F.lit(1))
    got = {r.page_id: r for r in langid.identify(table, read_table(spark, sf_dir, "documents")).collect()}
    assert set(got) == set(want)
    for page, (lang, probability) in want.items():
        assert got[page].lang == lang and abs(got[page].probability - probability) < 1e-6


def test_op4_names_the_language_without_its_markup(spark):
    pages = read_table(spark, "/root/testdata/sf0.01", "pages")
    said = {r.page_id: langid.declared(r.html or "") for r in pages.collect()}
    masked = pages.withColumn("html", F.regexp_replace("html", r"(?i)<html\b[^>]*>", "<html>"))
    got = langid.identify(masked, read_table(spark, "/root/testdata/sf0.01", "documents")).collect()
    known = [(r.lang, said[r.page_id]) for r in got if said[r.page_id]]
    assert {r.markup for r in got} == {""} and len(known) > 100
    assert sum(a == b for a, b in known) / len(known) > 0.9


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.collect() == [] and "ids_sha256" in out.columns


def test_scratch_is_deleted(spark):
    made = shared.materialize(spark.range(5), "gone")
    path = Path(made.inputFiles()[0].removeprefix("file://")).parent
    assert path.exists()
    shared.discard(made)
    assert not path.exists()
    other = Path(shared.materialize(spark.range(5), "gone").inputFiles()[0].removeprefix("file://")).parent
    keep = list(shared._made)
    shared._made[:] = [x for x in keep if x[0].getName() == other.name]
    shared.drop_scratch()
    assert not other.exists()
    shared._made[:] = [x for x in keep if x[0].getName() != other.name]
