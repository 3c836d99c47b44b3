from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from equiweave.functions import budget as B
from equiweave.functions import hashes as H
from equiweave.functions import text as X


def one(spark, expression, **columns):
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns)) if columns else spark.range(1)
    return df.select(expression.alias("x")).first().x


def test_normal_form_keeps_unicode_words(spark):
    assert one(spark, X.normalize(F.col("a")), a="  Café-Öl\t α  (x) ") == "caféöl α x"
    assert one(spark, X.normalize(F.col("a"), False), a=" A  b-C ") == "a b-c"


@pytest.mark.parametrize("n, want", [(2, ["ab", "bc", "cd"]), (3, ["abc", "bcd"]), (4, ["abcd"]), (5, ["abcd"])])
def test_ngrams(spark, n, want):
    assert one(spark, X.char_ngrams(F.col("a"), n), a="abcd") == want


def test_ngrams_of_nothing_and_bad_n(spark):
    assert one(spark, X.char_ngrams(F.col("a"), 3), a="") == []
    with pytest.raises(ValueError):
        X.char_ngrams(F.col("a"), 0)


@pytest.mark.parametrize("uri, a, b, c", [
    ("http://x.org/a#Left_lung", "Left_lung", "Left lung", "Left lung"),
    ("http://x.org/p/isPartOf", "isPartOf", "isPartOf", "is Part Of"),
    ("http://x.org/a%20b+c", "a b+c", "a%20b+c", "a%20b+c"),
    ("http://x.org/p/end/", "end", "end", ""),
])
def test_local_names(spark, uri, a, b, c):
    assert [one(spark, f(F.col("u")), u=uri) for f in (X.local_name_a, X.local_name_b, X.local_name_c)] == [a, b, c]


def test_literals_and_parts(spark):
    typed = '"5 kg "^^<http://x#t>'
    assert one(spark, X.literal_text(F.col("a")), a=typed) == "5 kg"
    assert one(spark, X.plain_literal_text(F.col("a"), F.lit(None), F.lit(None)), a=typed) == "5 kg "
    assert one(spark, X.plain_literal_text(F.col("a"), F.lit("en"), F.lit(None)), a=typed) == typed
    assert one(spark, X.join_parts(F.col("a"), F.col("b"), F.lit(None).cast("string")), a=" x ", b=" ") == "x"
    assert one(spark, X.estimate_tokens(F.col("a")), a=" one two  three ") == 4
    assert one(spark, X.format4(F.lit(None).cast("double"))) == "N/A" and one(spark, X.signed3(F.lit(0.5))) == "+0.500"


def test_draws_and_fingerprints(spark):
    import hashlib
    import zlib

    assert one(spark, H.draw(F.col("a")), a="http://é") == zlib.crc32("http://é".encode()) / 2**32
    assert one(spark, H.fingerprint(F.col("a")), a="x") == hashlib.sha1(b"x").hexdigest()[:16]
    sets = [F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a"), F.lit("b"))]
    assert one(spark, H.item_set_fingerprint(sets[0])) == one(spark, H.item_set_fingerprint(sets[1]))
    assert H.canonical_digest({"b": 1, "a": 2}) == H.canonical_digest({"a": 2, "b": 1})


def test_fits():
    budget = B.Budget(6)  # words and two more
    assert B.fit_items(["a b c", "d e f", "g"], " ", budget) == ["a b c", "g"]
    assert B.fit_prefix(["a b c", "d e f", "g"], " ", budget) == ["a b c"]
    assert B.fit_items(["a", "b"], " ", B.Budget(None)) == ["a", "b"]
    assert B.cut("one two  three four five", budget) == "one two  three four" and B.cut("one", budget) == "one"
    assert B.cut("one two three", B.Budget(2)) == ""
    assert B.fit_items(["a b"], " ", budget, "p q r") == []


def test_greedy_and_tier_selection():
    texts = ["a b c", "d e", "f", "g h"]
    assert B.greedy_select(texts, [0, 1, 2, 3], 8) == [0, 1]
    assert B.greedy_select(texts, [3, 2, 1, 0], 8) == [2, 3]
    assert B.tier_sample([3, 2, 2], [1, 0, 99], 4, 2) == [1]
    assert B.tier_sample([3], [0], 0, 2) == [] and B.tier_sample([3], [0], 9, 0) == []
    assert sorted(B.shuffled(9, 3, "u")) == list(range(9)) and B.shuffled(9, 3, "u") == B.shuffled(9, 3, "u") != B.shuffled(9, 4, "u")


def test_token_udfs(spark):
    assert one(spark, B.token_count(F.col("a")), a="x y") == 4
    assert B.fit_items(["a b", "c d", "e"], " ", B.Budget(5)) == ["a b", "e"]
    assert one(spark, B.cut_text(F.col("a"), B.Budget(4)), a="a b c") == "a b"
