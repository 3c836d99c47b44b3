"""Text columns: normal forms, n-grams, names, literals. All are built-in functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize(text: Column, strip_punctuation: bool = True) -> Column:
    """Lower case, stripped, white space runs to one blank, and without what is neither word nor space."""
    out = F.regexp_replace(strip(F.lower(text)), r"(?U)\s+", " ")
    return F.regexp_replace(out, r"(?U)[^\w\s]", "") if strip_punctuation else out


def char_ngrams(text: Column, n: int) -> Column:
    """Character n-grams; a shorter text is its own n-gram, an empty one has none."""
    if n <= 0:
        raise ValueError(f"n must be positive, not {n}")
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.length(text) < n, F.array(text)).otherwise(grams)


def _after_last(text: Column, *marks: str) -> Column:
    return F.regexp_extract(text, f"([^{''.join(marks)}]*)$", 1)


def local_name_a(uri: Column) -> Column:
    """After the last #, else the last path segment; percent-decoded, plus signs kept."""
    tail = F.when(F.contains(uri, F.lit("#")), _after_last(uri, "#")).otherwise(_after_last(F.regexp_replace(uri, "/+$", ""), "/"))
    return F.coalesce(F.try_url_decode(F.replace(tail, F.lit("+"), F.lit("%2B"))), tail)


def local_name_b(uri: Column) -> Column:
    """After the last #, else after the last / of the URI without closing slashes; underscores to blanks."""
    tail = F.when(F.contains(uri, F.lit("#")), _after_last(uri, "#")).otherwise(_after_last(F.regexp_replace(uri, "/+$", ""), "/"))
    return F.translate(tail, "_", " ")


def local_name_c(uri: Column) -> Column:
    """After the last # or /; underscores to blanks; a blank between a small and a capital letter."""
    return F.regexp_replace(F.translate(_after_last(uri, "#", "/"), "_", " "), "([a-z])([A-Z])", "$1 $2")


def without_datatype(text: Column) -> Column:
    """The value of an inlined ``"value"^^<datatype>`` literal; any other text as it is."""
    pattern = r'(?s)^"(.*)"\^\^<[^>]*>$'
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, 1)).otherwise(text)


def literal_text(text: Column) -> Column:
    """Datatype suffix and outer white space removed, from any literal."""
    return strip(without_datatype(text))


def plain_literal_text(text: Column, lang: Column, dtype: Column) -> Column:
    """Datatype suffix removed from literals with neither language nor datatype; nothing stripped."""
    return F.when(lang.isNull() & dtype.isNull(), without_datatype(text)).otherwise(text)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def estimate_tokens(text: Column) -> Column:
    """1.3 tokens for each word, rounded up."""
    return F.ceil(F.size(words(text)) * F.lit(1.3)).cast("int")


def join_parts(*parts: Column) -> Column:
    """Stripped parts, empty ones left out, one for each line."""
    return F.array_join(F.filter(F.array(*[F.coalesce(strip(p), F.lit("")) for p in parts]), lambda x: x != ""), "\n")


def join_items(texts: Column, chosen: Column) -> Column:
    """The chosen items (positions from 0) in canonical order."""
    return F.array_join(F.transform(F.array_sort(chosen), lambda i: F.get(texts, i)), " | ")


def or_else(first: Column, *others: Column) -> Column:
    """The first that is neither null nor empty."""
    return reduce(lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b), others, first)


def format4(value: Column) -> Column:
    """Four decimals, N/A for null."""
    return F.when(value.isNull(), "N/A").otherwise(F.format_string("%.4f", value))


def signed3(value: Column) -> Column:
    return F.when(value.isNull(), "N/A").otherwise(F.format_string("%+.3f", value))
