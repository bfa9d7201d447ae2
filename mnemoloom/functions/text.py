"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ABBREVIATIONS = ("Mr", "Mrs", "Dr", "Prof", "etc", "e.g", "i.e")
CLAUSES = r"(?i)\s*(?:,|;|\band\b|\bor\b|\bvs\b|\bversus\b|\bacross\b|\bbetween\b|\babout\b|\bregarding\b)\s*"
_DOT = "\x01"


def sentences(text: Column, min_chars: int = 40) -> Column:
    """Sentences end in . ! or ? before white space and a capital; dots of abbreviations don't count."""
    held = F.regexp_replace(text, rf"\b({'|'.join(a.replace('.', '[.]') for a in ABBREVIATIONS)})\.", f"$1{_DOT}")
    parts = F.transform(F.split(held, r"(?<=[.!?])\s+(?=[A-Z])", -1), lambda s: F.trim(F.replace(s, F.lit(_DOT), F.lit("."))))
    return F.filter(parts, lambda s: F.length(s) >= min_chars)


def clauses(text: Column) -> Column:
    """Clauses of a query; none unless at least two are long enough."""
    kept = F.filter(F.split(text, CLAUSES, -1), lambda c: ((F.length(c) >= 4) & F.contains(c, F.lit(" "))) | (F.length(c) >= 8))
    return F.when(F.size(kept) >= 2, kept).otherwise(F.array().cast("array<string>"))


def windows_of_two(parts: Column) -> Column:
    """The parts and each two adjacent ones together."""
    n = F.size(parts)
    two = F.zip_with(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(parts, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(parts, two)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def normal_label(label: Column) -> Column:
    return F.coalesce(F.nullif(F.translate(F.lower(F.trim(label)), " ", "_"), F.lit("")), F.lit("leads_to"))


def essence(summary: Column, raw: Column) -> Column:
    """A summary, else the first 120 characters on one line."""
    return F.coalesce(F.nullif(summary, F.lit("")), F.translate(F.substring(raw, 1, 120), "\n", " "))


def first_json_object(reply: Column) -> Column:
    return F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit(""))
