"""Stable draws and fingerprints."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(uri: Column) -> Column:
    """crc32 of the UTF-8 bytes as a share of 2**32."""
    return F.crc32(uri.cast("binary")) / F.lit(4294967296.0)


def draws_validation(uri: Column, share: Column) -> Column:
    return draw(uri) < share


def fingerprint(text: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-1."""
    return F.substring(F.sha1(text), 1, 16)


def item_set_fingerprint(items: Column) -> Column:
    """Fingerprint of an array of strings, whatever their order."""
    return fingerprint(F.to_json(F.array_sort(items)))


def texts_digest(texts: Column) -> Column:
    """SHA-256 of an array of texts in its order."""
    return F.sha2(F.to_json(texts), 256)


def canonical_digest(value: object) -> str:
    """SHA-256 of a value's compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
