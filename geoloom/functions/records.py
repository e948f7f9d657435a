"""Stable text forms, identities and codes of records, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(fields: Column) -> Column:
    """A map of strings as JSON without spaces, keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields))))


def _quoted(text: Column) -> Column:
    listed = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(listed, F.lit(2), F.length(listed) - 2))


def normalised_record(texts: dict[str, Column], numbers: dict[str, Column], zero_is_default: tuple[str, ...] = ()) -> Column:
    """JSON of a record's fields by name: nulls and the named zeros dropped, whole numbers without a fraction."""
    parts = {k: _quoted(v) for k, v in texts.items()}
    for k, v in numbers.items():
        shown = F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))
        parts[k] = F.when((v != 0) if k in zero_is_default else v.isNotNull(), shown)
    named = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in sorted(parts.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *named), F.lit("}"))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def stable_id(namespace: Column, index: Column, part: Column | None = None) -> Column:
    """An identity that depends on nothing but the place of a record in its source."""
    parts = [namespace, index.cast("string")] + ([part.cast("string")] if part is not None else [])
    whole = F.concat_ws("-", *parts)
    return F.concat(whole, F.lit("-"), F.substring(digest(whole), 1, 12))


def iso_country(level: Column, alpha2: Column, plain: Column, subdivision: Column) -> tuple[Column, Column]:
    """(code, basis): a country boundary's own code, else the first half of a subdivision's."""
    own = F.coalesce(F.nullif(alpha2, F.lit("")), plain)
    boundary = F.coalesce((level == "2") & own.rlike("^[A-Z]{2}$"), F.lit(False))
    part = F.coalesce(subdivision.rlike("^[A-Z]{2}-.+$"), F.lit(False))
    return F.when(boundary, own).when(part, F.substring(subdivision, 1, 2)), F.when(boundary, "boundary").when(part, "subdivision")
