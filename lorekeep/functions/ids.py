"""Identifiers and hashes as Spark expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dashed(hex_: Column) -> Column:
    part = lambda a, n: F.substring(hex_, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))


def uuid5(namespace: Column, name: Column) -> Column:
    """Version-5 UUID of a name in a namespace (both text)."""
    raw = F.unhex(F.replace(namespace, F.lit("-"), F.lit("")))
    digest = F.sha1(F.concat(raw, F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return _dashed(F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15)))


def memory_id(explicit: Column, path: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """The stated id, else one derived from the path (SNK-20)."""
    return F.coalesce(explicit, uuid5(F.lit(str(namespace)), path))


def content_hash(raw: Column, tag: str = "projection-v2") -> Column:
    """SHA-256 of a version tag, NUL and the text."""
    return F.sha2(F.concat(F.lit(tag).cast("binary"), F.unhex(F.lit("00")), F.encode(raw, "UTF-8")), 256)


def chunk_id(memory: Column, hash_: Column, ordinal: Column) -> Column:
    return uuid5(memory, F.concat_ws(":", hash_, ordinal.cast("string")))


def chunk_label(path: Column, headings: Column, index: Column) -> Column:
    """Twelve hex digits of path, headings and index."""
    return F.substring(F.sha2(F.concat_ws("::", path, F.array_join(headings, "|"), index.cast("string")), 256), 1, 12)


def point_id(chunk: Column) -> Column:
    """MD5 of a chunk id in UUID form."""
    return _dashed(F.md5(chunk))


def evidence_id(memory: Column, revision: Column, chunk: Column) -> Column:
    return F.concat_ws(":", memory, revision, chunk)


def cache_key(endpoint: Column, sorted_json: Column) -> Column:
    return F.md5(F.concat_ws(":", endpoint, sorted_json))
