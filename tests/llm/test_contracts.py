"""The corpus queries against their SQL, and the ones without SQL against brute force or labels."""

from __future__ import annotations

import hashlib
import math
import sys
import zlib
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from oracle import compare  # noqa: E402

from equiweave.llm import bpe, langid, linededup, minhash, mixing, quality, queries, rules  # noqa: E402
from equiweave.llm.shared import read_table  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    compare(spark, sf_dir, queries.QUERIES[name], queries.ORACLES[name])


def test_op1_meets_targets_and_repeats(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source").toPandas()
    got = queries.op1_mixing(spark, sf_dir).toPandas().merge(docs, on="doc_id")
    assert (got.taken <= 3 * got["size"]).all()
    per = got.groupby("source").agg(size=("size", "sum"), whole=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (per["size"] == per.whole).all()
    assert (abs(per.taken - per.target) <= mixing.TOLERANCE * per.target + 1).all()
    want = dict(zip(per.index, mixing.targets(list(zip(per.index, per["size"], strict=True))), strict=True))
    assert all(math.isclose(want[s], t) for s, t in per.target.items())
    assert math.isclose(per.target.sum(), got["size"].sum())
    again = queries.op1_mixing(spark, sf_dir).toPandas()
    assert sorted(map(str, again.values.tolist())) == sorted(map(str, got.drop(columns="source").values.tolist()))
    assert (got.shards.map(len) == got.copies).all() and got.taken.sum() > 0


def test_op1_targets_share_the_excess():
    assert mixing.targets([("a", 10), ("b", 1), ("c", 1)]) == [6.0, 3.0, 3.0]
    assert mixing.targets([]) == []
    assert mixing.targets([(None, 5)]) == [5.0]
    assert sum(mixing.targets([("x", 0), ("y", 7), (None, 9)])) == 16.0


def brute_lines(rows):
    """Repeated chunks, found by comparing all chunk bytes of all rows."""
    seen: dict[bytes, tuple] = {}
    places = []
    for doc, text in rows:
        lines = text.encode().split(b"\n")
        for a, b, counts in linededup.chunks(text.encode()):
            if counts:
                places.append((doc, a, b"\n".join(lines[a:b])))
    for doc, a, part in places:
        seen[part] = min(seen.get(part, (doc, a)), (doc, a))
    return {(doc, a) for doc, a, part in places if seen[part] != (doc, a)}


def test_op2_equals_brute_force(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    gone = brute_lines(rows)
    per: dict[int, set] = {}
    for doc, a in gone:
        per.setdefault(doc, set()).add(a)
    want = {d: hashlib.sha256(linededup._without(t.encode(), per.get(d, set()))).hexdigest() for d, t in rows}
    got = {r.doc_id: r for r in queries.op2_line_dedup(spark, sf_dir).collect()}
    assert {d: r.text_sha256 for d, r in got.items()} == want
    assert sum(r.chunks_removed for r in got.values()) == len(gone) > 0


def test_op4_agrees_with_the_pages_language(spark, sf_dir):
    got = queries.op4_language(spark, sf_dir).toPandas()
    assert len(got) == read_table(spark, sf_dir, "pages").count()
    assert (got.lang == got.markup).mean() > 0.95
    assert got.probability.between(0, 1 + 1e-9).all()


def test_op6_separates_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op6_quality(spark, sf).toPandas().set_index("doc_id")
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.index]).all()
    labels = read_table(spark, sf, "labels").toPandas().set_index("doc_id").join(got, how="inner")
    held = labels[labels.held_out]
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.97
    assert (held.predicted == held.quality).mean() > 0.95
    assert (got.predicted == (got.score >= quality.THRESHOLD).astype(int)).all() and got.score.between(0, 1).all()


def test_op8_equals_the_library_and_round_trips(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(r.doc_id, r.text or "") for r in read_table(spark, sf_dir, "documents").collect()]
    got = {r.doc_id: r for r in queries.op8_bpe(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for (doc, _), e in zip(rows, library.encode_batch([t for _, t in rows], add_special_tokens=False), strict=True):
        ids = b"".join(i.to_bytes(4, "little") for i in e.ids)
        assert (got[doc].n_tokens, got[doc].ids_sha256) == (len(e.ids), hashlib.sha256(ids).hexdigest())
        assert got[doc].decoded_sha256 == hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def test_op9_order_does_not_change_the_verdict(spark, sf_dir):
    import pyarrow as pa

    texts = pa.array([r.text for r in read_table(spark, sf_dir, "documents").collect()]).fill_null("")
    one, other = (rules._verdicts(texts, o)[-1].to_pylist() for o in (sorted(rules.RULES), sorted(rules.RULES, reverse=True)))
    assert one == other


def test_pipeline_is_its_stages(spark, sf_dir):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "source_mixing", "bpe"]
    docs = read_table(spark, sf_dir, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        rows = [r.asDict() for r in docs.collect()]
        out = stage(spark, docs, sf_dir)
        if name != "bpe":
            assert out.columns == columns
            docs = spark.createDataFrame(out.collect(), out.schema)
            counts.append(docs.count())
        if name == "quality_classifier":
            keep = {r.doc_id for r in quality.classify(spark.createDataFrame(rows, docs.schema), read_table(spark, sf_dir, "labels")).where("predicted = 1").collect()}
            assert sorted(r["doc_id"] for r in rows if r["doc_id"] in keep) == sorted(r.doc_id for r in docs.collect())
        elif name == "minhash_near_dedup":
            kept = {r.doc_id for r in minhash.near_duplicates(spark.createDataFrame(rows, docs.schema)).where("kept").collect()}
            assert sorted(kept) == sorted(r.doc_id for r in docs.collect())
    assert counts[0] > counts[1] >= counts[2] > counts[3] > 0
    encoded = bpe.encode(docs).collect()
    staged = sorted((r.doc_id, r.ids_sha256) for r in encoded)
    assert staged == sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect())


def test_langid_reads_markup_and_addresses():
    assert langid.declared('<html lang="pt-BR">') == "pt" and langid.declared("<p>") == ""
    assert langid.address("https://A.b.Example.org:80/en/x") == ("a.b.example.org", "example.org", "org", "en")
    assert langid.address(None) == ("", "", "", "") and langid.address("http://[bad") == ("", "", "", "")
    assert "hidden" not in langid.visible("<script>hidden</script><p>a &amp; b</p><!-- hidden -->")
