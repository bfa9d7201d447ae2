"""Content-addressed and time-ordered ids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def claim_id(user: Column, text: Column, prefix: str = "clm_") -> Column:
    return F.concat(F.lit(prefix), F.md5(F.concat(user, F.lit("\x00"), F.lower(stripped(text))).cast("binary")))


def fragment_id(user: Column, episode: Column, start: Column, end: Column) -> Column:
    key = F.concat(user, F.lit("\x00"), episode, F.lit("\x00"), start.cast("string"), F.lit("-"), end.cast("string"))
    return F.concat(F.lit("frg_"), F.substring(F.md5(key.cast("binary")), 1, 24))


def ulid(millis: Column, seed: Column, prefix: str = "") -> Column:
    """26 characters of Crockford's base 32: 48 bits of time, then 80 bits that ``seed`` determines, so that a rerun agrees."""
    digit = lambda v, i: F.substring(F.lit(CROCKFORD), (F.shiftright(v, 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
    time = [digit(millis.cast("long"), i) for i in range(9, -1, -1)]
    high, low = F.xxhash64(seed), F.xxhash64(seed, F.lit(1))
    return F.concat(F.lit(prefix), *time, *[digit(high, i) for i in range(8)], *[digit(low, i) for i in range(8)])
