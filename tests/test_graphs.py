"""Readers, dataset layouts, label rules, text strategies and selection on files written here."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from equiweave import conditions, schema
from equiweave.operators import entities, graph, labels, selection, verbalise
from equiweave.functions.budget import Budget
from equiweave.plans import experiment, registry
from equiweave.sources import alignments, datasets, rdf, results
from equiweave.vocabulary import VOCABULARIES, expand

HEAD = '<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:skos="http://www.w3.org/2004/02/skos/core#">'


def ontology(names, prefix):
    body = "".join(
        f'<owl:Class rdf:about="http://{prefix}#{k}"><rdfs:label xml:lang="en">{n}</rdfs:label>' + (f'<rdfs:subClassOf rdf:resource="http://{prefix}#{names[0][0]}"/>' if k != names[0][0] else "") + "</owl:Class>"
        for k, n in names
    )
    return f"{HEAD}{body}</rdf:RDF>"


def alignment(rows):
    cells = "".join(f'<map><Cell><entity1 rdf:resource="{s}"/><entity2 rdf:resource="{t}"/><relation> {r.replace("<", "&lt;")} </relation><measure>{m}</measure></Cell></map>' for s, t, r, m in rows)
    return f'<?xml version="1.0"?><rdf:RDF xmlns="http://knowledgeweb.semanticweb.org/heterogeneity/alignment" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><Alignment>{cells}</Alignment></rdf:RDF>'


WORDS = "organ heart lung kidney spleen liver artery vein nerve muscle".split()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("d2")
    base = root / "d2_anatomy"
    base.mkdir()
    (base / "source.rdf").write_text(ontology([(f"s{i}", f"left {w}") for i, w in enumerate(WORDS)], "a"))
    (base / "target.rdf").write_text(ontology([(f"t{i}", f"{w} left") for i, w in enumerate(WORDS)], "b"))
    (base / "reference.rdf").write_text(alignment([(f"http://a#s{i}", f"http://b#t{i}", "=", "1.0") for i in range(10)] + [("http://a#s0", "http://b#t1", "<", "1.0")]))
    return root


def test_rdf_xml_forms():
    text = HEAD + """<rdf:Description rdf:about="http://x#a"><rdf:type rdf:resource="http://x#T"/><rdfs:label xml:lang="de">Ä</rdfs:label><rdfs:comment rdf:datatype="http://x#s">c</rdfs:comment>
    <owl:p rdf:parseType="Resource"><owl:q>in</owl:q></owl:p><owl:l rdf:parseType="Collection"><owl:Class rdf:about="http://x#b"/></owl:l><owl:n><owl:Class rdf:about="http://x#c"/></owl:n></rdf:Description>
    <rdf:Description rdf:about="http://x#a"><rdfs:label xml:lang="de">Ä</rdfs:label></rdf:Description></rdf:RDF>"""
    got = rdf.parse(text.encode(), "xml")
    a = "http://x#a"
    assert (a, "uri", f"{rdf.RDF}type", "http://x#T", "uri", None, None) in got
    assert got.count((a, "uri", expand("rdfs:label"), "Ä", "lit", "de", None)) == 1
    assert (a, "uri", expand("rdfs:comment"), "c", "lit", None, "http://x#s") in got
    assert ("http://x#c", "uri", f"{rdf.RDF}type", expand("owl:Class"), "uri", None, None) in got
    assert any(t[2] == f"{rdf.RDF}first" and t[3] == "http://x#b" for t in got) and any(t[1] == "bnode" and t[3] == "in" for t in got)
    with pytest.raises(rdf.DataError):
        rdf.parse(b"<rdf", "xml")
    with pytest.raises(rdf.DataError):
        rdf.format_of("graph.csv")


def test_turtle_forms():
    text = '''@prefix : <http://x#> . PREFIX r: <http://r/>
:a a :T ; :p "x\\n\\u00e9"@en-GB , """long "q" text""" , 5 , 1.5e3 , true ; r:q [ :in "deep" ] , (:one "two") . # done
<http://x#b> :p 'y'^^r:type .'''
    got = rdf.parse(text.encode(), "turtle")
    assert ("http://x#a", "uri", "http://x#p", "x\né", "lit", "en-GB", None) in got
    assert ("http://x#a", "uri", "http://x#p", 'long "q" text', "lit", None, None) in got
    assert ("http://x#b", "uri", "http://x#p", "y", "lit", None, "http://r/type") in got
    assert sum(t[2] == f"{rdf.RDF}first" for t in got) == 2 and any(t[3] == "deep" and t[1] == "bnode" for t in got)
    with pytest.raises(rdf.DataError):
        rdf.parse(b":a :b :c .", "turtle")


def test_files_of_triples_links_and_cells(spark, tmp_path):
    (tmp_path / "g.nt").write_text('<http://a> <http://p> "v"@en .\n<http://a> <http://p> <http://b> .\nbroken\n')
    assert {(r.o, r.o_kind, r.o_lang) for r in rdf.read_ntriples(spark, str(tmp_path / "g.nt"), "g").collect()} == {("v", "lit", "en"), ("http://b", "uri", None)}
    (tmp_path / "r").write_text("a\tp\tb\na\tp\tb\nbad\tline\n")
    (tmp_path / "t").write_text('a\tq\thttp://c\na\tq\thttp://c d\na\tq\t"1"^^<http://t>\n')
    kinds = {(r.o, r.o_kind) for r in alignments.read_tsv_triples(spark, str(tmp_path / "r"), str(tmp_path / "t"), "g").collect()}
    assert kinds == {("b", "uri"), ("http://c", "uri"), ("http://c d", "lit"), ('"1"^^<http://t>', "lit")}
    (tmp_path / "links").write_text("a  b c\n\nx\nd\te\nd\te\n")
    assert [(r.s, r.t) for r in alignments.read_links(spark, str(tmp_path / "links")).orderBy("ord").collect()] == [("a", "b"), ("d", "e"), ("d", "e")]
    (tmp_path / "ref.rdf").write_text(alignment([("a", "b", "=", "1.0"), ("a", "b", "=", "0.5"), ("c", "d", "<", "1"), ("", "e", "=", "x")]))
    cells = alignments.read_cells(spark, str(tmp_path / "ref.rdf"))
    assert [(r.s, r.t) for r in alignments.read_alignment(spark, str(tmp_path / "ref.rdf")).orderBy("ord").collect()] == [("a", "b"), ("a", "b")]
    audit = alignments.audit(cells).first()
    assert (audit.n_cells, audit.n_equivalence, audit.n_distinct, audit.n_below_one, audit.n_malformed) == (4, 2, 1, 1, 1) and audit.relations == {"=": 3, "<": 1}
    split = alignments.read_cells_splittable(spark, str(tmp_path / "ref.rdf"))
    assert sorted(map(str, split.drop("ord").collect())) == sorted(map(str, cells.drop("ord").collect()))


def test_candidate_files_round_trip(spark, tmp_path):
    path = str(tmp_path / "c.json")
    (tmp_path / "c.json").write_text(json.dumps({"candidates": {"s2": ["tX", "t2"], "s1": ['q"t'], "s3": []}}))
    rows = results.read_candidates(spark, path)
    assert sorted(map(tuple, rows.collect())) == [("s1", 'q"t', 1), ("s2", "t2", 2), ("s2", "tX", 1)]
    text = "\n".join(r.value for r in results.candidate_json(rows).collect())
    assert json.loads(text) == {"candidates": {"s1": ['q"t'], "s2": ["tX", "t2"]}}
    (tmp_path / "bad.json").write_text("[1, 2")
    with pytest.raises(Exception, match="not a candidate file|Malformed|CORRUPT|malformed"):
        results.read_candidates(spark, str(tmp_path / "bad.json")).collect()


def test_result_files(spark, tmp_path):
    def put(name, **fields):
        base = {"condition_id": "C1", "dataset_id": "D1", "pair_name": "p", "metrics": {"f1": 0.5}, "counts": {"tp": 1, "fp": 0, "fn": 1}, "evaluation_protocol": 2}
        (tmp_path / name).write_text(json.dumps(base | fields))

    put("a_results.json")
    put("b_results.json", metrics={"f1": 0.9})
    put("c_results.json", condition_id="XX")
    put("d_results.json", pair_name=None)
    put("e_results.json", pair_name="old", evaluation_protocol=1, per_entity_type={"class": {"f1": 0.1, "precision": 0.1, "recall": 0.1, "mrr": 0.2}, "predicate": {"f1": 0.1}})
    (tmp_path / "f_results.json").write_text("{broken")
    rows = results.read_results(spark, str(tmp_path), ["C1"], "*_results.json").cache()
    assert sorted((r.pair_name, r.metrics.f1) for r in rows.collect()) == [("old", 0.5), ("p", 0.5)]
    assert [r.pair_name for r in results.current(rows).collect()] == ["p"]
    assert [(r.entity_type, r.mrr) for r in results.buckets(rows).collect()] == [("class", 0.2)]
    assert results.one_condition(rows, "C1", "D1").count() == 2
    with pytest.raises(Exception, match="missing or repeated"):
        results.one_condition(rows.unionByName(rows), "C1", "D1").collect()
    digests = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in results.file_digests(spark, [str(tmp_path / "a_results.json"), str(tmp_path / "none.json")]).collect()}
    assert digests["none.json"] is None and len(digests["a_results.json"]) == 64


def test_sidecar_faults(spark):
    side = {"threshold": 0.5, "n_test_refs": 1, "test_sources": [], "predictions": [{"source": "s", "target": "t", "score": 0.9, "predicted": True, "correct": True}], "result": {"candidates_sha256": "h"}}
    res = {"metrics": {"threshold": 0.5}, "counts": {"tp": 1, "fp": 0, "fn": 0}, "population": {"n_test_refs": 1}, "candidates_sha256": "h"}
    def frame(ddl, rows):
        parsed = spark.createDataFrame([(k, json.dumps(v)) for k, v in rows], "key string, j string")
        return parsed.select("key", F.from_json("j", ddl).alias("x")).select("key", "x.*")

    sidecars = frame(schema.SIDECAR, [("ok", side), ("t", side | {"threshold": 0.4}), ("c", side | {"predictions": []}), ("alone", side)])
    found = frame(schema.RESULT, [("ok", res), ("t", res), ("c", res), ("missing", res)])
    assert {r.key: r.reason for r in results.sidecar_faults(sidecars, found).collect()} == {"t": "threshold", "c": "counts", "alone": "no result", "missing": "no sidecar"}


def triples(spark, *rows):
    full = [("g", k, *(r + (None,) * (7 - len(r)))) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, schema.TRIPLES)


def uri(s, p, o):
    return (s, "uri", expand(p), o, "uri")


def lit(s, p, o, lang=None):
    return (s, "uri", expand(p), o, "lit", lang)


def test_label_rules_differ(spark):
    t = triples(spark, lit("http://x/E1", "rdfs:label", "deutsch", "de"), lit("http://x/E1", "rdfs:label", "british", "en-GB"), lit("http://x/E1", "skos:altLabel", "alt", "en"), lit("http://x/E1", "skos:prefLabel", "plain"),
                lit("http://x/Q5", "skos:definition", "Ada Lovelace"), lit("http://x/Q5", "rdfs:comment", "12.5"), lit("http://x/Q5", "rdfs:comment", "1815-12-10"))
    def got(f):
        return {r.uri: r.label for r in f(t).collect()}

    assert got(labels.label_a) == {"http://x/E1": "deutsch", "http://x/Q5": "Q5"}
    assert got(labels.label_b) == {"http://x/E1": "plain", "http://x/Q5": "1815-12-10 Ada Lovelace"}
    assert got(labels.label_c) == {"http://x/E1": "alt"}
    assert got(labels.label_d) == {"http://x/E1": "plain"}


def test_reified_annotation_values(spark):
    t = triples(spark, lit("a", "skos:altLabel", "one", "en-US"), ("a", "uri", expand("skos:altLabel"), "_:b", "bnode"), ("_:b", "bnode", expand("rdfs:label"), "two", "lit"), lit("a", "skos:altLabel", "drei", "de"), lit("a", "skos:altLabel", "one", "en"))
    assert labels.annotation_values(t, [expand("skos:altLabel")]).first().vals == ["one", "two"]


def test_concepts_are_classes_only_when_extracted(spark):
    t = triples(spark, uri("http://c", "rdf:type", expand("skos:Concept")), uri("http://p", "rdf:type", expand("rdf:Property")), uri("http://i", "rdf:type", "http://c"))
    assert [r.uri for r in entities.extract(t, "class").collect()] == ["http://c"]
    assert {r.uri: r.entity_type for r in entities.resolved_types(t).collect()} == {"http://c": "instance", "http://p": "predicate", "http://i": "instance"}
    assert [r.uri for r in entities.extract(t, "instance").collect()] == ["http://i"]
    with pytest.raises(ValueError):
        entities.extract(t, "thing")


def test_stars_leave_out_and_merge(spark):
    t = triples(spark, lit("a", "rdfs:label", "same"), lit("a", "rdfs:label", "same", "en"), uri("a", "owl:sameAs", "z"), ("a", "uri", expand("owl:equivalentClass"), "_:b", "bnode"), uri("a", "rdfs:subClassOf", "a"))
    assert [[x.text for x in r["items"]] for r in labels.eligible_items(t).collect()] == [["label: same"]]


HEART = ("http://x#Heart", "http://x#Body", "http://x#Aorta")


def organs(spark):
    heart, body, aorta = HEART
    return triples(spark, lit(heart, "rdfs:label", "heart", "en"), lit(heart, "skos:altLabel", "cor", "en"), lit(heart, "rdfs:comment", "pumps"), ("http://x#Heart", "uri", "http://x#partOf", body, "uri"), (aorta, "uri", "http://x#connectsTo", heart, "uri"),
                   uri(heart, "rdfs:subClassOf", body), uri(aorta, "rdfs:subClassOf", body), uri(body, "rdfs:subClassOf", heart))


def test_text_strategies(spark):
    t = organs(spark)
    e = spark.createDataFrame([("g", HEART[0], "class")], "graph_id string, uri string, entity_type string")
    def text(name, budget=verbalise.UNCAPPED):
        return verbalise.verbalise(name, t, e, budget).first().text

    assert text("V1") == "heart ; cor"
    assert text("V2") == "Label: heart. Definition: pumps. Synonyms: cor."
    assert text("V3") == "heart: pumps. heart is called heart. heart has alt Label cor. heart is a subclass of Body. heart part Of Body."
    assert text("V6").split(" | ") == ["comment: pumps", "label: heart", "alt Label: cor", "sub Class Of: Body", "part Of: Body"]
    assert text("V8") == "Outgoing relationships: part of, sub class of.\nIncoming relationships: connects to, sub class of."
    assert text("V7") == "Label: heart. Definition: pumps. Synonyms: cor.\n\nParents: Body.\nRelated types include: Aorta."
    assert text("V2+V8").split("\n")[0] == text("V2")
    assert text("V6", Budget(7)) == "comment: pumps | label: heart"
    assert text("V7", Budget(11)).endswith("Parents: Body.") and text("V7", Budget(9)) == text("V2")
    assert len(text("V2+V6", Budget(10)).split()) + 2 <= 10
    assert text("V5").startswith("heart [")
    assert set(verbalise.STRATEGIES) == {s for s in verbalise.STRATEGIES if text(s)}
    with pytest.raises(ValueError):
        verbalise.verbalise("V9", t, e)
    with pytest.raises(Exception, match="unsupported entity type"):
        verbalise.verbalise("V6", t, e.withColumn("entity_type", F.lit("thing"))).collect()


def knots(spark):
    """Classes that are their own parent, in rings and under two parents, instances of them, properties, a blank child."""
    sub, kind, prop, label = (expand(x) for x in ("rdfs:subClassOf", "rdf:type", "rdfs:subPropertyOf", "rdfs:label"))
    edges = [("a", sub, "b"), ("b", sub, "c"), ("c", sub, "a"), ("d", sub, "d"), ("e", sub, "d"), ("f", sub, "e"), ("g", sub, "f"), ("g", sub, "zz"), ("h", sub, "g"), ("c", sub, "e"), ("_:x", sub, "d")]
    edges += [(f"i{k}", kind, "h" if k % 3 else "c") for k in range(9)] + [("i9", kind, "i9"), ("i8", kind, "lost"), ("p", prop, "q"), ("q", prop, "p"), ("r", prop, "q")]
    uri = lambda x: x if x[0] == "_" else f"http://k#{x}"
    rows = [("g", n, uri(s), "bnode" if s[0] == "_" else "uri", p, uri(o), "uri", None, None) for n, (s, p, o) in enumerate(edges)]
    rows += [("g", 100 + n, uri(s), "uri", label, f"name {n % 4}", "lit", "en" if n % 2 else None, None) for n, s in enumerate(("a", "d", "i1", "i2", "i4", "i5", "q"))]
    kinds = {"a": "class", "i": "instance", "p": "predicate"} | dict.fromkeys("bcdefgh", "class") | {"q": "predicate", "r": "predicate"}
    e = [("g", uri(s), kinds[s[0]]) for s in sorted({s for s, _, _ in edges if s[0] != "_"})] + [("g", uri("nowhere"), "class")]
    return spark.createDataFrame(rows, schema.TRIPLES), spark.createDataFrame(e, "graph_id string, uri string, entity_type string")


def test_kin_are_the_labels_of_ancestors_and_siblings(spark):
    t, e = knots(spark)
    names = {r.uri: r.label for r in labels.label_or_local(t, entities.entities(t)).collect()}
    up = {r.uri: [names[x] for x in r.chain] for r in graph.ancestors(t, e).collect()}
    beside = {r.uri: r.siblings for r in graph.siblings(t, e).collect()}
    got = {r.uri: r for r in graph.with_kin(t, e).collect()}
    assert {k: r["items"] for k, r in got.items()} == up
    assert {k: r.siblings for k, r in got.items()} == {k: beside.get(k, []) for k in up}
    assert sorted({len(x) for x in up.values()}) == [0, 1, 2, 3] and max(map(len, beside.values())) == 5


def test_annotations_of_several_groups(spark):
    definition, synonym, label = expand("skos:definition"), expand("skos:altLabel"), expand("rdfs:label")
    rows = [("g", 0, "u", "uri", synonym, "b", "lit", None, None), ("g", 1, "u", "uri", synonym, "_:n", "bnode", None, None), ("g", 2, "_:n", "bnode", label, "c", "lit", "en-GB", None), ("g", 3, "_:n", "bnode", label, "b", "lit", "en", None)]
    rows += [("g", 4, "u", "uri", synonym, "d", "lit", "fr", None), ("g", 5, "v", "uri", definition, "e", "lit", "EN", None)]
    got = labels.annotation_lists(spark.createDataFrame(rows, schema.TRIPLES), definitions=[definition], both=[definition, synonym]).collect()
    assert {r.uri: (r.definitions, r.both) for r in got} == {"u": ([], ["b", "c"]), "v": (["e"], ["e"])}


@pytest.mark.parametrize("name", ["v5_text", "v7_text"])
def test_large_tables_are_not_broadcast_by_file_size(spark, sf_dir, name):
    """All but labels of predicates, which are few and on the right of a left join."""
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan
    assert all(re.search(r"\[graph_id#\d+, p#\d+\], LeftOuter, BuildRight", x) for x in plan.split("\n") if "BroadcastHashJoin" in x)


def test_walks_repeat_and_follow_edges(spark):
    t, e = organs(spark), spark.createDataFrame([("g", HEART[0], "class"), ("g", HEART[2], "class")], "graph_id string, uri string, entity_type string")
    a, b = (sorted(map(tuple, graph.walks(t, e).collect())) for _ in range(2))
    assert a == b and {r[2] for r in a} == set(range(10)) and max(r[3] for r in a) == 4
    edges = {(r.s, r.p, r.o) for r in t.where("o_kind = 'uri'").collect()}
    for _, start, walk, hop, p, o in a:
        before = start if hop == 1 else next(x[5] for x in a if x[1] == start and x[2] == walk and x[3] == hop - 1)
        assert (before, p, o) in edges


def items(spark):
    rows = [("g", "u", "class", [(0, expand("rdfs:comment"), "c one two"), (1, expand("rdfs:label"), "l one"), (2, expand("rdfs:subClassOf"), "s x y"), (3, expand("oboInOwl:hasDbXref"), "i 7")])]
    return spark.createDataFrame(rows, "graph_id string, uri string, entity_type string, items array<struct<n: int, predicate: string, text: string>>")


@pytest.mark.parametrize("mode, tokens, want", [
    ("full", None, "c one two | l one | s x y | i 7"), ("deterministic", 9, "c one two | l one"), ("ppas", 6, "c one two"), ("core_first", 9, "l one | s x y"), ("label_first", 7, "l one | i 7"), ("role_priority", 9, "c one two | l one"),
])
def test_policies(spark, mode, tokens, want):
    got = selection.select(items(spark), mode, tokens).first()
    assert got.text == want and got.n_tokens == len(want.split()) + 2 and got.truncated == (tokens is not None)
    assert got.n_covered_items == 3 and got.predicate_coverage == 1.0


def test_filters_roles_and_guards(spark):
    got = selection.select(items(spark), "full", filter_mode="covered", excluded_roles=["definition"], render_order="role").first()
    assert got.text == "l one | s x y" and got.predicate_coverage == 0.75 and (got.n_filtered_items, got.n_role_removed_items) == (1, 1)
    random = [selection.select(items(spark), "random", 9, seed).first().text for seed in (1, 1)]
    assert random[0] == random[1]
    for bad in (("full", 9, None), ("random", 9, None), ("ppas", 9, 1), ("ppas", 0, None), ("odd", 9, None)):
        with pytest.raises(ValueError):
            selection.check_mode(*bad)
    with pytest.raises(Exception, match="no role"):
        odd = items(spark).withColumn("items", F.transform("items", lambda x: F.struct(x["n"].alias("n"), F.lit("http://odd").alias("predicate"), x["text"].alias("text"))))
        selection.select(odd, "full", excluded_roles=["synonym"]).collect()


def test_registries_fit_together(spark):
    conditions.check()
    assert len(conditions.CONDITIONS) == 19 and len(conditions.LOGICAL) == 62 and len(conditions.executions()) == 57
    assert conditions.expand_columns(("D4", "D5")) == ["D4_schema", "D4_instance", "D5"]
    assert {v.name for v in VOCABULARIES.values() if v.covered >= VOCABULARIES["base"].covered} == {"base", "fma_extended", "obo_extended"}
    for t in (conditions.conditions_table, conditions.comparisons_table, conditions.ablations_table, conditions.logical_table):
        assert t(spark).count() > 0
    assert conditions.execution(conditions.LOGICAL[-1]).order_mode == "role_priority"


def test_a_pair_runs_end_to_end(spark, folder):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        (pair,) = datasets.load(spark, "D2", str(folder))
        assert {r.split: r["count"] for r in pair.refs.groupBy("split").count().collect()} == {"val": 2, "test": 8}
        found = experiment.stage_one(pair)
        rendered = experiment.texts(pair, conditions.CONDITIONS[0], found)
        assert rendered.where("role = 'source'").count() == 10 and "left heart" in {r.text for r in rendered.collect()}
        out = f"{folder}/runs"
        ids = [conditions.BASELINE]
        for _ in range(2):  # the second time finds everything done
            assert experiment.run(spark, [pair], experiment.hashing_encoder(), ids, out) == []
        stored = {r.condition_id: r for r in results.read_results(spark, out).collect()}
        assert sorted(stored) == sorted(ids) and stored[conditions.BASELINE].metrics.mrr == 1.0 and stored[conditions.BASELINE].model_key is None
        raw = spark.read.option("recursiveFileLookup", True).json(out)
        assert raw.count() == 1 and raw.where("provenance.spark is not null and provenance.run_timestamp is not null").count() == 1
        assert raw.where("candidate_recall_at_20 = 1.0").count() == 1
        with pytest.raises(rdf.DataError):
            datasets.load(spark, "D9")
        with pytest.raises(rdf.DataError):
            datasets.with_known(pair, pair.refs.select("ord", "s", "t").limit(1))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
