"""Text and path functions: filters, fallback chains, names, virtual paths, fractions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches_any(text: Column, tokens: Sequence[str]) -> Column:
    """Whether the text has one of the tokens, small and capital letters alike. No tokens match everything; an empty text matches no token."""
    wanted = [t.strip().lower() for t in tokens if t.strip()]
    if not wanted:
        return F.lit(True)
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*map(F.lit, wanted)), lambda t: F.contains(low, t))


def first_text(*texts: Column) -> Column:
    """The first text that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(t), F.lit("")) for t in texts])


def slug(text: Column) -> Column:
    """Small letters and digits, joined by single dashes."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def words_of_name(name: Column) -> Column:
    """A name with underscores and dashes as a phrase."""
    return F.trim(F.regexp_replace(F.translate(name, "_-", "  "), r"\s+", " "))


def after_marker(text: Column, marker: str) -> Column:
    """What follows a marker, trimmed; the trimmed text without it."""
    at = F.instr(F.lower(text), marker.lower())
    return F.trim(F.when(at > 0, F.substring(text, at + len(marker), F.length(text))).otherwise(text))


def without_affixes(text: Column, prefix: str = "", suffix: str = "") -> Column:
    out = F.when(F.startswith(text, F.lit(prefix)), F.substring(text, F.lit(len(prefix) + 1), F.length(text))).otherwise(text) if prefix else text
    return F.when(F.endswith(out, F.lit(suffix)), F.substring(out, F.lit(1), F.length(out) - len(suffix))).otherwise(out) if suffix else out


def virtual_path(container: Column, inner: Column) -> Column:
    return F.concat_ws("::", container, inner)


def split_virtual(path: Column) -> tuple[Column, Column]:
    """Container and inner path; the inner one is null without the separator."""
    parts = F.split(path, "::", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def rate(text: Column) -> Column:
    """A rate written as a/b or a number; null for 0/0, division by zero or other text."""
    parts = F.split(text, "/", 2)
    top, under = (F.get(parts, F.lit(i)).try_cast("double") for i in range(2))
    value = F.when(F.contains(text, F.lit("/")), F.try_divide(top, under)).otherwise(top)
    return F.when(value > 0, value)


def first_key(json: Column, keys: Sequence[str]) -> Column:
    """The value of the first key that a JSON object has."""
    return F.coalesce(*[F.get_json_object(json, f"$.{k}") for k in keys])


def quantised_depth(metres: Column) -> Column:
    """Whole millimetres in 16 bits: NaN is 0, beyond the range is its end, halves go to even."""
    mm = F.rint(metres * 1000)
    return F.when(metres.isNull() | F.isnan(metres), 0).otherwise(F.least(F.greatest(mm, F.lit(0.0)), F.lit(65535.0))).cast("int")
