"""Row functions: drift, typed casts, late arrival, calendar, value maps. All are column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _aliases(aliases: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else F.create_map().cast("map<string,string>")


def canonical(payload: Column, expected: Sequence[str], aliases: Mapping[str, str]) -> Column:
    """The payload under canonical names; unrecognised keys are dropped."""
    known = F.array(*[F.lit(c) for c in expected])
    kept = F.map_filter(payload, lambda k, _: F.array_contains(known, k) | (F.map_contains_key(_aliases(aliases), k) if aliases else F.lit(False)))
    if not aliases:
        return kept
    # a row with both a name and its alias keeps the name's value
    own = F.map_filter(kept, lambda k, _: F.array_contains(known, k))
    other = F.map_filter(kept, lambda k, _: ~F.array_contains(known, k))
    renamed = F.transform_keys(other, lambda k, _: _aliases(aliases)[k])
    return F.map_concat(own, F.map_filter(renamed, lambda k, _: ~F.map_contains_key(own, k)))


def drifted(payload: Column, expected: Sequence[str]) -> Column:
    """True if a key isn't an expected one (an alias counts); a missing key is no drift."""
    return F.size(F.array_except(F.map_keys(payload), F.array(*[F.lit(c) for c in expected]))) > 0


def unrecognised(payload: Column, expected: Sequence[str], aliases: Mapping[str, str]) -> Column:
    return F.array_except(F.map_keys(payload), F.array(*[F.lit(c) for c in [*expected, *aliases]]))


def late(source_file: Column, event_date: Column, pattern: str, threshold_days: int) -> Column:
    """True if the delivery date in the file name is more than ``threshold_days`` after the event; a name that doesn't match is an error."""
    found = F.regexp_extract(source_file, pattern, 1)
    day = F.when(found != "", F.to_date(found, "yyyyMMdd")).otherwise(F.raise_error(F.concat(F.lit("no delivery date in file name "), source_file)).cast("date"))
    return F.datediff(day, event_date) > threshold_days


def calendar(day: Column) -> dict[str, Column]:
    dow = F.weekday(day) + 1
    return {"date_key": F.date_format(day, "yyyyMMdd").cast("int"), "full_date": day, "day_of_week": dow, "day_name": F.date_format(day, "EEEE"), "month": F.month(day), "month_name": F.date_format(day, "MMMM"), "quarter": F.quarter(day), "year": F.year(day), "is_weekend": dow >= 6}


def mapped(value: Column, values: Mapping[str, str], what: str) -> Column:
    """Look ``value`` up; one that isn't mapped is an error that names it."""
    got = _aliases(values)[value]
    return F.when(got.isNotNull(), got).otherwise(F.raise_error(F.concat(F.lit(f"{what}: no mapping for "), F.coalesce(value, F.lit("null")))).cast("string"))


def surrogate_key(*columns: Column) -> Column:
    """A deterministic key: reloads give the same, so facts need no repointing."""
    return F.xxhash64(*columns)
