"""Column helpers for keys, durations and tolerant parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = (("d", 86_400_000), ("h", 3_600_000), ("m", 60_000), ("s", 1_000), ("ms", 1))


def human_duration(ms: Column) -> Column:
    """A duration by the largest unit that divides it: 7d, 12h, 90s, 250ms; 0 is 0ms, null is null."""
    out = F.concat(ms.cast("string"), F.lit("ms"))
    for unit, size in reversed(UNITS[:-1]):
        out = F.when((ms != 0) & (ms % size == 0), F.concat((ms / size).cast("long").cast("string"), F.lit(unit))).otherwise(out)
    return F.when(ms.isNotNull(), out)


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def subject_prefix(subject: Column, custom: Column) -> Column:
    """``Subject:`` or ``Custom:name:``, the head of a state key."""
    return F.concat(subject, F.lit(":"), F.when(custom.isNotNull(), F.concat(custom, F.lit(":"))).otherwise(F.lit("")))


def state_key(subject: Column, custom: Column, key: Column, window_ms: Column, fixed: Column) -> Column:
    """``Subject:[custom:][FW:]key/window``; without a window the key of the global record."""
    head = F.concat(subject_prefix(subject, custom), F.when(fixed, F.lit("FW:")).otherwise(F.lit("")), key)
    return F.concat(head, F.lit("/"), F.coalesce(window_ms.cast("string"), F.lit("GLOBAL")))


def composite_key(*parts: Column) -> Column:
    """Parts joined by ``|``; null if any part is."""
    whole = F.concat_ws("|", *parts)
    for p in parts:
        whole = F.when(p.isNotNull(), whole)
    return whole


def after_colon(text: Column) -> Column:
    """What follows the first colon, if there is one past the first place; else the text."""
    at = F.instr(text, ":")
    return F.when(at > 1, F.substr(text, at + F.lit(1))).otherwise(text)


def window_number(key: Column) -> Column:
    """The window of ``key/window`` in ms; null (global) where it is no number."""
    return F.split_part(key, F.lit("/"), F.lit(2)).try_cast("bigint")


def ruleset_parts(name: Column, separator: str = ":") -> tuple[Column, Column]:
    """(ruleset, version) of ``ruleset:version``, split at the first separator."""
    ruleset = F.substring_index(name, separator, 1)
    version = F.when(F.instr(name, separator) > 0, F.substr(name, F.instr(name, separator) + F.lit(len(separator))))
    return ruleset, version


def long_or(text: Column, default: int | None = None) -> Column:
    """A header parsed as a long, or the default."""
    parsed = F.trim(text).try_cast("bigint")
    return parsed if default is None else F.coalesce(parsed, F.lit(default))


def named_or_unknown(text: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit("unknown"))


def clean_group(text: Column) -> Column:
    """A group name with every sign but letters, digits and underscores replaced."""
    return F.regexp_replace(text, "[^A-Za-z0-9_]", "_")


def same_subject(text: Column, subject: str) -> Column:
    return F.lower(text) == subject.lower()


def without_zeros(deltas: Column) -> Column:
    """A map of named deltas without those that are zero or null."""
    return F.map_filter(deltas, lambda _, v: F.coalesce(v, F.lit(0)) != 0)
