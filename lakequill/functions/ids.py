"""Identities and stable picks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: uuid.NAMESPACE_URL, a fixed value of RFC 9562.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def crc(s: Column) -> Column:
    return F.crc32(s.cast("string").cast("binary"))


def chunk_id(page: Column, size: Column, n: Column) -> Column:
    return F.concat_ws(":", page.cast("string"), size.cast("string"), n.cast("string"))


def page_of_chunk(chunk: Column) -> Column:
    """Page ids may hold colons; size and number don't."""
    return F.regexp_extract(chunk, r"^(.*):[^:]*:[^:]*$", 1)


def question_id(page: Column, kind: Column, n: Column) -> Column:
    return F.concat_ws(":", page.cast("string"), kind.cast("string"), n.cast("string"))


def stable_order(key: Column) -> Column:
    return F.sha1(key.cast("string").cast("binary"))


def cache_key(provider: Column, model: Column, kind: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("\0", provider, model, kind, text), 256)


def split_of(place: Column) -> Column:
    """A fifth is dev, the rest test; all rows of a place fall in one."""
    return F.when(crc(place) % 5 == 0, F.lit("dev")).otherwise(F.lit("test"))


def pick(options: Column, key: Column) -> Column:
    """The option that the key's hash names; null if there is none."""
    return F.get(options, (F.pmod(crc(key), F.nullif(F.size(options), F.lit(0)))).cast("int"))


def qrel_key(page: Column, question: Column) -> Column:
    return F.concat(page.cast("string"), F.lit("|"), F.lower(F.lpad(F.hex(crc(question)), 8, "0")))


def uuid5_url(url: Column) -> Column:
    """RFC 9562 version 5 in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL)), url.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("long").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))
