"""Scalar functions of the engine as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word of a query or claim (fixed value).
TOKEN = r"[A-Za-z][A-Za-z0-9_-]+"


def strip(x: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(x, r"^[\s\x0B]+|[\s\x0B]+$", "")


def content_hash(x: Column) -> Column:
    return F.sha2(strip(x), 256)


def chunk_id(path: Column, key: Column) -> Column:
    return F.substring(F.sha1(F.concat(path, F.lit("\u0000"), key)), 1, 32)


def normal_prompt(x: Column) -> Column:
    """Trimmed, lower case, white space collapsed, the first 160 characters."""
    return F.substring(F.regexp_replace(F.lower(strip(x)), r"[\s\x0B]+", " "), 1, 160)


def tokens(x: Column) -> Column:
    """The distinct words of a text in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(TOKEN.replace("A-Z", "")), F.lit(0)))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def kebab(x: Column) -> Column:
    """A predicate in kebab case: without outer white space, in lower case, '-' for each blank."""
    return F.replace(F.lower(strip(x)), F.lit(" "), F.lit("-"))


def last_identifier(x: Column) -> Column:
    """The last part of a dotted or backslashed name; null if it ends in a bracket."""
    last = F.element_at(F.split(F.replace(x, F.lit("\\"), F.lit(".")), r"\."), -1)
    return F.when(~last.rlike(r"[\])]$"), last)


def version_key(x: Column) -> Column:
    """Four numbers of a version, each from the digits its part begins with, for ordering."""
    parts = F.split(x, r"\.")
    return F.array(*[F.coalesce(F.regexp_extract(F.get(parts, F.lit(i)), r"^\d+", 0).try_cast("int"), F.lit(0)) for i in range(4)])


def letters(x: Column) -> Column:
    """How often each of the 26 letters is in a text: a vector without a model, for tests and as a stand-in."""
    low = F.lower(F.coalesce(x, F.lit("")))
    return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in "abcdefghijklmnopqrstuvwxyz"])


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, added up in DOUBLE; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def duration_seconds(text: str) -> float:
    """Seconds of '30d', '12h', '45m', '900s', '2w' or a bare number."""
    text = text.strip().lower()
    unit = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}.get(text[-1:])
    value = float(text[:-1] if unit else text)
    if value < 0:
        raise ValueError("a duration can't be negative")
    return value * (unit or 1)
