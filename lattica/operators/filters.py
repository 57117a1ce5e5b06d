"""Predicates over notes: tags, types, times, values and schemaless metadata."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.model import DEFAULT_VALUE

ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
COMPARE = {">=": Column.__ge__, ">": Column.__gt__, "<=": Column.__le__, "<": Column.__lt__}


class FilterError(ValueError):
    """A filter expression that says nothing."""


def has_tag(tags: Column, wanted: list[str]) -> Column:
    """Any of the wanted tags."""
    return F.arrays_overlap(tags, F.array(*map(F.lit, wanted)))


def equivalent_tags(tag: str, aliases: dict[str, str]) -> list[str]:
    """The tag, its canonical form and that form's other aliases, one level deep."""
    canonical = aliases.get(tag, tag)
    return list(dict.fromkeys([tag, canonical, *(a for a, c in aliases.items() if c == canonical)]))


def since(created: Column, start: datetime) -> Column:
    """Created at the time or later; an unknown time fails."""
    return F.coalesce(created >= F.lit(start), F.lit(False))


def min_value(value: Column, least: int) -> Column:
    """Value, taken as the default where it is unset, of at least so much."""
    return F.coalesce(value, F.lit(DEFAULT_VALUE)) >= least


def parse_min_value(text: str) -> int:
    """A bound from 0 to 100."""
    n = int(text)
    if not 0 <= n <= 100:
        raise FilterError(f"{text} is not from 0 to 100")
    return n


def hide_compacted(notes: DataFrame, compacts: DataFrame) -> DataFrame:
    """Notes that no digest stands for."""
    return notes.join(compacts.select(F.col("source_id").alias("id")), "id", "left_anti")


def _present(custom: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(custom), key), F.lit(False))


def _at(custom: Column, key: str) -> tuple[Column, Column]:
    """A key's type name and its text."""
    path = "$['" + key.replace("'", "\\'") + "']"
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(custom), path, "variant"))
    return kind, F.try_variant_get(F.try_parse_json(custom), path, "string")


def custom_filter(custom: Column, expression: str) -> Column:
    """`!key`, `key`, `key=value` or `key<op>value` over a JSON object.

    Without a comparison sign, equality holds for strings, numbers and booleans by their text. Comparisons split at the
    first of >=, >, <=, < in this order; against an ISO date strings compare as text, else numbers, numeric strings and
    booleans as numbers. Other types never match.
    """
    text = expression.strip()
    if text.startswith("!"):
        if not text[1:].strip():
            raise FilterError("no key after !")
        return ~_present(custom, text[1:].strip())
    sign = next((s for s in (">=", ">", "<=", "<") if s in text), None)
    if sign is None and "=" not in text:
        if not text:
            raise FilterError("an empty expression")
        return _present(custom, text)
    key, _, value = (x.strip() for x in text.partition(sign or "="))
    if not key or not value:
        raise FilterError(f"a key or value is missing in {expression!r}")
    kind, actual = _at(custom, key)
    plain = ~kind.rlike("^(ARRAY|OBJECT|VOID)")
    if sign is None:
        return F.coalesce(plain & (actual == value), F.lit(False))
    if re.match(ISO_DATE, value):
        return F.coalesce((kind == "STRING") & COMPARE[sign](actual, F.lit(value)), F.lit(False))
    try:
        bound = float(value)
    except ValueError:
        raise FilterError(f"{value!r} is neither a number nor a date") from None
    number = F.when(kind == "BOOLEAN", F.when(actual == "true", 1.0).otherwise(0.0)).otherwise(actual.try_cast("double"))
    return F.coalesce(plain & COMPARE[sign](number, F.lit(bound)), F.lit(False))


def lenient_custom_filter(custom: Column, expression: str) -> Column:
    """Like custom_filter, but an expression that doesn't parse matches nothing."""
    try:
        return custom_filter(custom, expression)
    except FilterError:
        return F.lit(False)


def note_filter(tags: list[str] | None = None, kind: str | None = None, start: datetime | None = None, least: int | None = None, custom: str | None = None) -> Column:
    """All of the given conditions, on the columns of notes (and custom)."""
    parts = [F.lit(True)]
    if tags:
        parts.append(has_tag(F.col("tags"), tags))
    if kind:
        parts.append(F.col("type") == kind.lower())
    if start:
        parts.append(since(F.col("created"), start))
    if least is not None:
        parts.append(min_value(F.col("value"), least))
    if custom:
        parts.append(lenient_custom_filter(F.col("custom"), custom))
    return reduce(and_, parts)


def parse_time(text: str, now: datetime) -> datetime:
    """`N units ago`, an RFC 3339 time, a local time or a day."""
    if m := re.fullmatch(r"(\d+)\s+(second|minute|hour|day|week|month|year)s?\s+ago", text.strip(), re.I):
        seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400, "month": 30 * 86400, "year": 365 * 86400}
        return now - timedelta(seconds=int(m[1]) * seconds[m[2].lower()])
    try:
        at = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    except ValueError:
        raise FilterError(f"{text!r} is not a time") from None
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def edge_filter(edges: DataFrame, typed_only: bool = False, inline_only: bool = False, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Edges of the wanted provenance and types."""
    if typed_only:
        edges = edges.filter(~F.col("inline"))
    if inline_only:
        edges = edges.filter("inline")
    if include:
        edges = edges.filter(F.col("link_type").isin(include))
    if exclude:
        edges = edges.filter(~F.col("link_type").isin(exclude))
    return edges


def contains(notes: DataFrame, query: str) -> DataFrame:
    """Notes with the string, case and all, in title or body."""
    return notes.filter(F.col("title").contains(query) | F.col("body").contains(query))


def inbox(notes: DataFrame, edges: DataFrame, compacts: DataFrame, exclude_linked: bool = False) -> DataFrame:
    """Fleeting and literature notes that no digest stands for and, if so wished, no collection links to."""
    out = hide_compacted(notes.filter(F.col("type").isin("fleeting", "literature")), compacts)
    if exclude_linked:
        mocs = notes.filter("type = 'moc'").select(F.col("id").alias("src"))
        out = out.join(edges.join(mocs, "src", "left_semi").select(F.col("dst").alias("id")), "id", "left_anti")
    return out
