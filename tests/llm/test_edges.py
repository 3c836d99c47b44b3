"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from equiweave.llm import bpe, chat, components, langid, linededup, minhash, mixing, quality, rules, shared, topk, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word and other words " * 20_000


def documents(spark, rows, extra=False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(d, t, "en", s, 0) for d, t, s in rows], DOCS)
    for name in ("size", "takes", "kept", "score", "component_id", "row", "cut", "_gone", "hash") if extra else ():
        df = df.withColumn(name, F.lit(1))
    return df


ODD = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (5, LONG, "b"), (6, "same text here to see twice\nand a second line of it", "c"),
       (7, "same text here to see twice\nand a second line of it", "c"), (7, "same text here to see twice\nand a second line of it", "c"), (None, "no id but words enough to count", "c")]


@pytest.mark.parametrize("extra", [False, True])
def test_every_document_operator_takes_odd_rows(spark, extra):
    docs = documents(spark, ODD, extra)
    labels = spark.createDataFrame([(4, 1, 0), (5, None, 0), (5, 0, 0), (99, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for rows in (
        mixing.word_report(docs), linededup.report(docs), quality.classify(docs, labels), minhash.near_duplicates(docs), bpe.encode(docs), rules.judge(docs),
    ):
        assert rows.count() == len(ODD)
    for out in (linededup.drop_repeated(docs), minhash.keep_one(docs), quality.keep_good(docs, labels), mixing.mix(docs)):
        assert out.columns == docs.columns
        out.collect()


def test_every_document_operator_takes_an_empty_table(spark):
    docs, labels = documents(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for rows in (
        mixing.word_report(docs), linededup.report(docs), quality.classify(docs, labels), minhash.near_duplicates(docs), bpe.encode(docs), rules.judge(docs),
        linededup.drop_repeated(docs), minhash.keep_one(docs), quality.keep_good(docs, labels), mixing.mix(docs),
    ):
        assert rows.count() == 0


# ---------------------------------------------------------------- op 1


def test_shards_get_exact_disjoint_quotas():
    quotas = np.array([7, 0, 130, 41])
    for most in (1, 3, 256):
        nodes = mixing.subtrees(quotas, 5, most)
        tree = [leaf for f, n, own, before in nodes for leaf in mixing.leaves(f, n, own, before)]
        assert [shard for shard, _, _ in tree] == list(range(5))
        owns = np.array([own for _, own, _ in tree])
        assert (owns.sum(axis=0) == quotas).all() and (owns >= 0).all()
        assert max(owns.sum(axis=1)) - min(owns.sum(axis=1)) <= 3
        assert all((before == owns[:k].sum(axis=0)).all() for k, (_, _, before) in enumerate(tree))
        if most == 1:
            first = owns
        assert (owns == first).all()


MIXED = [(i, " ".join(f"w{k}" for k in range(1 + i % 40)), f"s{i % 3}") for i in range(120)] + [(200, "x " * 50, None), (201, "", "s1"), (202, None, "s2"), (None, "no id here", "s0")]


def test_copies_of_the_mix_add_up(spark):
    docs = documents(spark, MIXED + [MIXED[7], MIXED[7]])
    words, shares = Counter(), Counter()
    for r in mixing.word_report(docs, shard_words=200).collect():
        words[r.doc_id] += r.taken
        shares[r.doc_id] += r.copies
        assert len(r.shards) == r.copies and r.taken <= 3 * r["size"]
    got, copies = Counter(), Counter()
    for r in mixing.mix(docs, shard_words=200).collect():
        got[r.doc_id] += len(r.text.split())
        copies[r.doc_id] += 1
    assert +words == got and +shares == copies
    assert words[201] == words[202] == 0


def test_taken_words_come_from_the_tree_and_the_permutation(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 40)
    docs = documents(spark, [x for x in MIXED if x[0] is not None])

    def report():
        return {r.doc_id: r for r in mixing.word_report(docs, shard_words=150).collect()}

    real, whole = report(), mixing.split
    assert len({s for r in real.values() for s in r.shards}) > 5
    monkeypatch.setattr(mixing, "split", lambda quotas, first, shards: (quotas, quotas * 0))  # all blocks to shard 0
    assert {d: r.shards for d, r in report().items()} != {d: r.shards for d, r in real.items()}
    monkeypatch.setattr(mixing, "split", lambda quotas, first, shards: (quotas // 3, quotas // 3))  # a tree that loses blocks
    assert sum(r.taken for r in report().values()) < 0.8 * sum(r.taken for r in real.values())
    monkeypatch.setattr(mixing, "split", whole)
    monkeypatch.setattr(mixing, "_multiplier", lambda n, rng: 1)  # no permutation
    assert {d: r.taken for d, r in report().items()} != {d: r.taken for d, r in real.items()}


def test_a_rest_is_met_nearly_and_its_last_copy_whole_where_it_can(spark):
    rows = [(i, f"text {i} " * 40, "ab"[i % 2]) for i in range(400)] + [(900, "long " * 3000, "c")]
    report = mixing.word_report(documents(spark, rows)).toPandas()
    names = {d: s for d, _, s in rows}
    by = report.assign(source=[names[d] for d in report.doc_id]).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by.taken - by.target) <= mixing.TOLERANCE * by.target + 1).all()
    assert not (report[report.doc_id < 900].taken % 80).any()


# ---------------------------------------------------------------- op 2


def test_chunk_boundaries_survive_an_inserted_line():
    rnd = random.Random(4)
    lines = [f"line {rnd.random()} of text" for _ in range(200)]
    def parts(text):
        split = text.encode().split(b"\n")
        return {b"\n".join(split[a:b]) for a, b, _ in linededup.chunks(text.encode())}

    a, b = parts("\n".join(lines)), parts("\n".join(["new line"] + lines[:90] + ["another"] + lines[90:]))
    assert len(a & b) > 0.85 * len(a)


def test_a_repeated_long_line_and_passage_go_once(spark):
    passage = "\n".join(f"the shared passage has this line number {k} with words" for k in range(12))
    line = " ".join(f"long{k}" for k in range(60))
    rows = [(i, f"own start {i}\nmore {i}\n{passage}\n{line}\nown end {i}", "s") for i in range(40)]
    got = {r.doc_id: r for r in linededup.drop_repeated(documents(spark, rows)).collect()}
    assert got[0].text == rows[0][1]
    for i in range(1, 40):
        assert line not in got[i].text and f"own start {i}" in got[i].text and f"own end {i}" in got[i].text
        assert sum("shared passage" in x for x in got[i].text.split("\n")) <= 6


@pytest.mark.parametrize("n", range(3, 13))
def test_repeated_passages_of_short_lines_go_whole(spark, n):
    rnd, rows, own = random.Random(n), [], {}
    per = -(-51 // n)
    for k in range(30):
        passage = [" ".join(f"p{k}x{j}y{w}" for w in range(per + rnd.randrange(2))) for j in range(n)]
        for d in (2 * k, 2 * k + 1):
            around = [[f"own {d} {side} {j} {rnd.random()}" for j in range(rnd.randrange(1, 6))] for side in "ab"]
            rows.append((d, "\n".join(around[0] + passage + around[1]), "s"))
            own[d] = "\n".join(around[0] + passage * (d % 2 == 0) + around[1])
    assert {r.doc_id: r.text for r in linededup.drop_repeated(documents(spark, rows)).collect()} == own


def test_a_run_of_long_and_short_lines_goes_whole(spark):
    line = " ".join(f"long{k}" for k in range(60))
    runs = [f"{line}\nshort one", f"short two\n\n{line} x", f"{line} y"]
    rows = [(10 * k + d, f"own {k} {d}\n{run}\nend {k} {d}", "s") for k, run in enumerate(runs) for d in range(2)]
    got = {r.doc_id: r.text for r in linededup.drop_repeated(documents(spark, rows)).collect()}
    assert got == {10 * k + d: f"own {k} {d}\nend {k} {d}" if d else f"own {k} {d}\n{run}\nend {k} {d}" for k, run in enumerate(runs) for d in range(2)}


def test_clean_documents_are_left_alone(spark):
    rows = [(i, "\n".join(f"only {i} {k} here" for k in range(9)), "s") for i in range(30)]
    assert sorted((r.doc_id, r.text) for r in linededup.drop_repeated(documents(spark, rows)).collect()) == [(i, t) for i, t, _ in rows]


# ---------------------------------------------------------------- op 3


PAGES = "page_id long, url string, html string"


def expected(rows):
    groups: dict[str, list] = {}
    for i, _, h in rows:
        groups.setdefault(h or "", []).append(i)
    for i, _, h in rows:
        data, ids = (h or "").encode(), [x for x in groups[h or ""] if x is not None]
        last = max(ids) if ids and len(groups[h or ""]) > 1 else None
        again = last is not None and i != last
        yield (i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", last if again else None)


def test_records_inside_payloads_are_rejected(spark):
    evil = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:5>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * i) for i in range(40)]
    rows += [(900, "http://a\r\nb c WARC/1.1", evil), (901, None, None), (902, "u", ""), (903, "u", "dup"), (904, "u", "dup"), (904, "u", "dup"), (None, "u", "dup"), (None, "u", "only"),
             (905, "u", evil + "WARC/1.1\r\n"), (906, "u", "\r\n\r\n"), (907, "u", "\r\n\r\nWARC/1."), (908, "u", "\r\n\r\nWARC/1.é\r\n\r\nWARC/1.0\r\n\r\n\r\n"), (909, "u", "x" * 5000 + evil * 50)]
    random.Random(2).shuffle(rows)
    path = shared.scratch_path(spark, "warc-test")
    warc.write(spark.createDataFrame(rows, PAGES).coalesce(2), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "3k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = [tuple(r) for r in warc.read(spark, path).drop("file", "offset").collect()]
            assert sorted(got, key=str) == sorted(expected(rows), key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_no_pages_make_no_records(spark):
    path = shared.scratch_path(spark, "warc-empty")
    warc.write(spark.createDataFrame([], PAGES), path)
    assert warc.read(spark, path).count() == 0


def test_small_payloads_are_all_responses(spark):
    path = shared.scratch_path(spark, "warc-small")
    warc.write(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], PAGES), path, least_bytes=3)
    assert {r.record_type for r in warc.read(spark, path).collect()} == {"response"}


# ---------------------------------------------------------------- op 4


def test_languages_of_odd_pages(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "x", None)], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(1, None, None), (2, "http://x.de/de/1", '<html lang="de"><p>der hund und die katze'), (None, "", ""), (2, "http://x.de/de/1", "<p>the dog")], PAGES)
    got = langid.identify(pages.withColumnRenamed("html", "html"), docs).collect()
    assert len(got) == 4 and all(0 <= r.probability <= 1.0 + 1e-9 for r in got)
    assert [r.lang for r in got if r.markup == "de"] == ["de"]
    assert langid.identify(pages.limit(0), docs).count() == 0
    assert {r.lang for r in langid.identify(pages, docs.limit(0)).collect()} == {None}


def test_more_languages_than_64(spark):
    names = [f"{a}{b}" for a in "abcdefghij" for b in "qrstuvwx"]
    rnd = random.Random(3)
    words = {x: ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(12)] for x in names}
    docs = spark.createDataFrame([(i, " ".join(rnd.choices(words[x], k=30)), x) for i, x in enumerate(names * 2)], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(i, f"http://h{i}.org/", "<p>" + " ".join(rnd.choices(words[x], k=30))) for i, x in enumerate(names)], PAGES)
    got = {r.page_id: r for r in langid.identify(pages, docs).collect()}
    assert len(names) == 80 and {i: got[i].lang for i in got} == dict(enumerate(names))
    assert all(r.text_lang == r.lang and 0 < r.probability <= 1 + 1e-9 for r in got.values())


# ---------------------------------------------------------------- op 5


def brute_top(rows, step, k):
    vectors = [(i, np.floor(256 * np.array(v, dtype=np.float64)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for i, v in vectors:
        if i % step == 0:
            scored = sorted((-int(v @ w), j) for j, w in vectors if j != i)[:k]
            yield from ((i, n + 1, j, -s) for n, (s, j) in enumerate(scored))


def test_top_k_with_ties_and_odd_vectors(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(0)
    rows = [(i, [float(x) for x in (r.normal(size=6) if i % 4 else np.ones(6))]) for i in range(300)]
    rows += [(400, None), (401, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, [1.0] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(0))
    want = sorted(brute_top(rows, 50, 5))
    for block in (4096, 37):
        got = topk.search(table, F.col("vec_id") % 50 == 0, block_rows=block, block_queries=3)
        assert sorted(map(tuple, got.collect())) == want
    assert topk.search(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.search(table.limit(3), F.col("vec_id") % 50 == 0).count() <= 2


@pytest.mark.parametrize("scale", [1, 1 << 18, 1 << 22])
def test_bounds_stop_with_exact_scores(scale):
    r = np.random.default_rng(5)
    x = np.floor(r.normal(size=(500, 8)) * 50).astype(np.int64) * scale
    q, names = x[:20], np.arange(500)
    got: dict[int, list] = {}
    for a, b, s, _ in topk.top_of_block(x, names, q, names[:20]):
        got.setdefault(a, []).append((-s, b))
    for i in range(20):
        want = sorted((-int(sum(int(a) * int(b) for a, b in zip(x[i], x[j], strict=True))), j) for j in range(500) if j != i)[:5]
        assert got[i] == want


def test_outsiders_are_dropped_before_the_lists_end_and_never_wrongly():
    r = np.random.default_rng(9)
    x = np.floor(r.normal(size=(3000, 64)) * 32).astype(np.int64)
    block, nobody = topk.Block(x), np.zeros((30, 3000), bool)
    # Each round's bounds hold: whoever is dropped has a lower score than the k-th best.
    for depths, resolve in (((0.25,), 5), ((0.5,), 5), ((0.5, 0.75), 5), ((0.9,), 5), (topk.DEPTHS, topk.RESOLVE)):
        for q, (left, _) in zip(x[:30], block.survivors(x[:30], nobody, 5, resolve, depths), strict=True):
            scores = x @ q
            assert set(np.flatnonzero(scores >= np.sort(scores)[-5])) <= set(left)
    found = block.survivors(x[:30], nobody)
    assert all(share < 1 and len(left) <= topk.RESOLVE for left, share in found)
    # Where few coordinates matter, half of the lists is enough.
    few = x * np.array([40, 20, 10] + [1] * 61)
    assert {share for _, share in topk.Block(few).survivors(few[:30], nobody)} == {0.5}


def test_wrong_bounds_would_be_noticed(monkeypatch):
    r = np.random.default_rng(2)
    x = np.floor(r.normal(size=(800, 16)) * 40).astype(np.int64)
    names = np.arange(800)
    want = topk.top_of_block(x, names, x[:40], names[:40])
    real = topk.Block.__init__

    def shorter(self, rows):
        real(self, rows)
        self.length = self.length * 0.05

    monkeypatch.setattr(topk.Block, "__init__", shorter)
    assert [f[:3] for f in topk.top_of_block(x, names, x[:40], names[:40])] != [f[:3] for f in want]


# ---------------------------------------------------------------- op 6


def test_labels_of_one_kind_give_a_constant(spark):
    docs = documents(spark, [(i, f"text {i}", "s") for i in range(30)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify(docs, labels).collect()} == {1.0}


def test_held_out_rows_are_never_learnt(spark):
    docs = documents(spark, [(i, f"text {i}", "s") for i in range(200)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    import zlib

    learnt = {r.text for r in quality.training_sample(docs, labels).collect()}
    assert learnt == {f"text {i}" for i in range(200) if zlib.crc32(str(i).encode()) % 5}
    assert quality.training_sample(docs, labels, 7).count() == 7


# ---------------------------------------------------------------- op 7


def brute_components(rows, percent=75):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}
    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and top(a) != top(b):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def test_large_groups_of_near_copies(spark):
    rnd = random.Random(1)
    base = [f"w{rnd.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(420):
        words = list(base)
        for _ in range(rnd.randrange(0, 7)):
            words[rnd.randrange(120)] = f"x{rnd.randrange(9999)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"v{rnd.randrange(9999)}" for _ in range(60))) for i in range(30)] + [(2000 + i, "Exact copy OF one text with words") for i in range(40)]
    rows += [(3000, "Few words"), (3001, "few WORDS"), (3002, ""), (3003, None), (3004, "É few words here now"), (3005, "é few words here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute_components(rows)


def template_texts(n, seed, keep=0.93, words=120):
    """Texts of one template, each word kept with probability `keep`: similarities of 0.3 to 0.6."""
    rnd = random.Random(seed)
    base = [f"t{rnd.randrange(9999)}" for _ in range(words)]
    return [" ".join(w if rnd.random() < keep else f"y{rnd.randrange(10**9)}" for w in base) for _ in range(n)]


@pytest.mark.parametrize("n", [300, 900])
def test_texts_of_one_template_are_not_compared_with_each_other(spark, monkeypatch, n):
    """Members of candidate chains at lower similarity: signatures settle them, few texts are compared."""
    texts = template_texts(n, 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counted = []
    real = minhash.confirmed_links

    def counting(texts_, groups, *more):
        counted.append(minhash.block_pairs(groups, minhash.BLOCK).groupBy("component", "i", "j").count().agg({"count": "sum"}).first()[0] or 0)
        return real(texts_, groups, *more)

    monkeypatch.setattr(minhash, "confirmed_links", counting)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute_components(list(enumerate(texts)))
    assert counted[0] < 4 * n


def test_links_that_no_bucket_hub_has_are_found(spark):
    """Chains: neighbours are near, ends are not; the smallest document of a bucket is near few of its members."""
    rnd = random.Random(8)
    rows = []
    for c in range(6):
        words = [f"c{c}w{rnd.randrange(9999)}" for _ in range(150)]
        for k in range(60):
            rows.append((c * 1000 + rnd.randrange(900), " ".join(words)))
            words[rnd.randrange(150)] = f"z{rnd.randrange(10**9)}"
            if k % 2:
                words[rnd.randrange(150)] = f"z{rnd.randrange(10**9)}"
    rows = list(dict(rows).items())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute_components(rows)


def test_sketches_fill_and_estimate():
    rnd = np.random.default_rng(3)
    a = np.unique(rnd.integers(0, 1 << 62, 400, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:300], rnd.integers(0, 1 << 62, 100, dtype=np.uint64)]))
    s = minhash.sketch([a, b, a[:1], a[:0]], 250)
    assert (s[:3] != np.iinfo(np.uint64).max).all() and (s[3] == np.iinfo(np.uint64).max).all()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((s[0] == s[1]).mean() - true) < 0.12
    assert (minhash.sketch([a], 250) == s[:1]).all()


def test_components_of_paths_and_hubs(spark):
    path = [(i, i + 1) for i in range(60)]
    hub = [(1000, 1000 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(path + hub + [(5, 5)], "a long, b long"), "t").collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1050), 1000)}
    assert components.components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


# ---------------------------------------------------------------- op 8


def test_bpe_equals_the_library_on_odd_strings():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own, rnd = Tokenizer.from_file(path), bpe.BatchBpe.from_file(path), random.Random(5)
    pool = list("aAbBcCéÉΣσßİı'sSd'll 've\t\n\r\x0b\x0c\x1c\x1e\x85\xa0123½٣中文한국어🎉ﬁǅ\x00") + [chr(c) for c in (0x2003, 0x2009, 0x3000, 0x200B, 0x327, 0x301, 0xFEFF)]
    pool += ["<|endoftext|>", "<|startoftext|>", "'ll", "'RE", "aaaaaaaaaaaaaaa", " "]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    texts += ["", " ", "a" * 5000, "ab" * 3000, "!?" * 2000, "th" * 999 + "e", "\n"]
    for text, mine, theirs in zip(texts, own.encode_batch(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert list(mine) == theirs.ids, repr(text)
        assert own.decode(mine) == library.decode(theirs.ids, skip_special_tokens=False)
    assert len(own.encode_batch([None])[0]) == 0


def test_words_of_a_million_letters_take_seconds():
    import time

    import public_tokenizers
    from tokenizers import Tokenizer

    path, rnd = public_tokenizers.path("word_bpe_49k.json"), random.Random(11)
    library, own = Tokenizer.from_file(path), bpe.BatchBpe.from_file(path)
    texts = ["".join(rnd.choices("etaoinshrdlucmfwypvbgkjqxz", k=1_000_000)), "".join(chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(300_000))]
    texts += ["a" * 300_001, "ab" * 100_000 + "c", "".join(rnd.choices("aab", k=50_000)), "!?" * 5_000 + " " + "the" * 700]
    texts += ["".join(rnd.choices("etaoin", k=n)) for n in (255, 256, 257, 258, 300)]
    for text in texts:
        began = time.perf_counter()
        (mine,) = own.encode_batch([text])
        assert time.perf_counter() - began < 20
        assert list(mine) == library.encode(text, add_special_tokens=False).ids


def test_the_word_cache_may_overflow(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    monkeypatch.setattr(bpe, "SLICE_CHARS", 200)
    own = bpe.BatchBpe.from_file(public_tokenizers.path("word_bpe_49k.json"))
    fresh = bpe.BatchBpe.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [f"word{i} other{i % 7} {'many words of all kinds ' * (i % 5)}" for i in range(300)]
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    a = own.encode_batch(texts)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 10**9)
    assert [list(x) for x in a] == [list(x) for x in fresh.encode_batch(texts)]


def test_other_tokenizer_settings_are_refused():
    import json

    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        config = json.load(file)
    config["model"]["byte_fallback"] = True
    with pytest.raises(ValueError):
        bpe.BatchBpe(config)


# ---------------------------------------------------------------- op 9


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for k in range(8)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in rules.SYMBOLS for c in text), dups, len(covered)


def test_base_counts_equal_brute_force():
    rnd = random.Random(8)
    texts = ["", " ", "\n\n", "a\na\n a\n\na", "é# é|<>&%$* ü", "x " * 30, "a b c d e f g h a b c d e f g h i", "\n".join(["same line"] * 5)]
    texts += ["".join(rnd.choice(["a ", "b ", "c\n", "#", "é ", "\t"]) for _ in range(rnd.randrange(200))) for _ in range(200)]
    flat, at = shared.utf8(pa.array(texts))
    c = rules.Counts(flat, at)
    got = list(zip(c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, strict=True))
    assert [tuple(map(int, g)) for g in got] == [brute_counts(t) for t in texts]


def test_rules_go_by_rejection_per_cost():
    ticks = iter(range(1000))
    slow = {"a": lambda t, c, r: True, "b": lambda t, c, r: False}
    assert rules.order_rules(["x y z"], slow, lambda: next(ticks)) == ["a", "b"]
    assert rules.order_rules([], slow) == ["a", "b"]


# ---------------------------------------------------------------- op 10


TURNS = "conv_id long, turn long, role string, text string"


def brute_chat(rows):
    convs: dict = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    for c, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        yield c, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_round_trip_with_control_strings(spark):
    rnd = random.Random(6)
    pool = [*chat.CONTROLS, "\\", "\\\\", "<", "[", "<\\s>", "\n", "é🎉", "[INST[INST]", "<<s>", "\\n", "n"]
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, "as\\n\nsistant", "<s>"]), rnd.choice([None, "", "".join(rnd.choices(pool, k=9))])) for c in range(40) for t in range(c % 9)]
    rows += [(6, 3, "user", "<a"), (6, 3, "user", "<s>"), (6, 3, "assistant", "[INST]"), (6, 3, "assistant", "[I"), (88, 5000, "assistant", "late"), (88, 1023, "user", "b"), (88, 1024, "user", "c"), (88, -7, "user", "a")]
    rows += [(None, None, "assistant", "x"), (5, None, "user", "early"), (77, 0, "assistant", "a"), (77, 0, "assistant", "a")]
    table = spark.createDataFrame(rows, TURNS)
    stored = shared.materialize(chat.formatted(table), "chat-test")
    got = {tuple(r)[:5] for r in chat.read_back(stored).collect()}
    assert got == set(brute_chat(rows))
    for r in stored.collect():
        inner = r.piece[len(chat.OPEN) : -len(chat.CLOSE)]
        assert not any(c in inner for c in chat.CONTROLS)
    assert chat.read_back(chat.formatted(table.limit(0))).count() == 0


def test_examples_hold_all_turns_before_and_one_target(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"text {k}") for k in range(6)]
    pieces = shared.materialize(chat.formatted(spark.createDataFrame(rows, TURNS)), "chat-examples")
    made = {r.seq: r for r in chat.example_texts(pieces, chat.examples(pieces).select("conv_id", "seq", "loss_start", "loss_end")).collect()}
    assert sorted(made) == [1, 3, 5]
    for k, r in made.items():
        assert r.text[r.loss_start : r.loss_end] == f"text {k}" and r.text.count(chat.OPEN) == k + 1


def test_digests_come_from_the_examples(spark):
    from pyspark.sql import functions as F

    rows = [(c, k, ("user", "assistant")[k % 2], f"text {k}") for c in (1, None) for k in range(6)]
    pieces = shared.materialize(chat.formatted(spark.createDataFrame(rows, TURNS)), "chat-digests")
    made = chat.examples(pieces)
    assert sorted(map(str, chat.read_back(pieces, made).collect())) == sorted(map(str, chat.read_back(pieces).collect()))
    assert {r.loss_chars for r in chat.read_back(pieces, made).collect()} == {18}
    assert {r.loss_chars for r in chat.read_back(pieces, made.where("seq > 1")).collect()} == {12}
    with pytest.raises(Exception, match="context of an example"):
        chat.read_back(pieces, made.withColumn("context_end", F.col("context_end") - 1)).collect()
