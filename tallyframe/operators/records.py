"""Records: what the COMPUTE rules of one subject, window and name keep together.

Every rule that names a record adds to it, each by its own filter: counts, amounts and named values are summed over the rules, lists
are put together, and the last value is that of the latest row that brought one (of several rules on one row, of the
last of them). Rules that name the same record over different windows keep it in each window by itself.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import Rule, chosen, guarded, part_name, tried_cast
from .sums import MONEY, kind_of, n_parts, parts, whole


@dataclass(frozen=True)
class Measure:
    """A sum of a record: its name (count, amount, value_x), its type, and by whom it is fed."""

    name: str
    kind: str
    feeds: tuple[tuple[str, str | None], ...]  # (filter, expression) of each rule

    @property
    def slots(self) -> tuple[str, ...]:
        """Names for the sums of its parts: measures that are fed alike share them, and they stay the same when other rules change."""
        digest = hashlib.sha256(repr((self.kind, self.feeds)).encode()).hexdigest()[:16]
        return tuple(f"s{digest}_{i}" for i in range(n_parts(self.kind)))

    def columns(self) -> list[Column]:
        """What a row adds to each slot."""
        out: list[Column] | None = None
        for filter_sql, sql in self.feeds:
            mine = [F.lit(1).cast("long")] if sql is None else parts(tried_cast(sql, self.kind), self.kind)
            mine = [F.when(chosen(filter_sql), F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).cast("long") for c in mine]
            out = mine if out is None else [a + b for a, b in zip(out, mine, strict=True)]
        return out


@dataclass(frozen=True)
class Record:
    subject: str
    custom: str | None
    window_ms: int | None  # None: since the key's first row
    fixed: bool
    name: str
    rules: tuple[Rule, ...]
    measures: tuple[Measure, ...] = field(default=())

    @property
    def owner(self) -> str:
        return (self.custom or self.subject).lower()

    @property
    def part(self) -> str:
        return part_name(self.subject, self.custom, self.window_ms, self.fixed)

    def column(self, measure: str) -> str:
        return f"{self.name}_{measure}_{self.part}"

    def held(self, field_: str) -> list[Column]:
        """What each of its rules with such a field brings on a row, as text."""
        return [F.when(chosen(r.filter_sql), guarded(getattr(r, field_)).cast("string")) for r in self.rules if getattr(r, field_)]

    def texts(self) -> Column | None:
        """The texts that a row brings to the list, null if none."""
        made = self.held("arg_sql")
        some = F.array_compact(F.array(*made)) if made else None
        return None if some is None else F.when(F.size(some) > 0, some)

    def last(self) -> Column | None:
        made = self.held("last_sql")
        return F.coalesce(*reversed(made)) if made else None

    @property
    def lists(self) -> bool:
        return self.window_ms is not None and any(r.arg_sql for r in self.rules)

    @property
    def lasts(self) -> bool:
        return any(r.last_sql for r in self.rules)

    def finished(self, sums: dict[str, Column]) -> dict[str, Column]:
        """The record's columns from the sums of its slots."""
        return {self.column(m.name): whole([sums[s] for s in m.slots], m.kind) for m in self.measures}


def records(rules: list[Rule], example: DataFrame) -> list[Record]:
    """The records that the COMPUTE rules among ``rules`` keep, in the order in which they are first named."""
    groups: dict[tuple, list[Rule]] = {}
    for r in rules:
        if r.kind == "COMPUTE":
            window = None if r.scope == "global" else r.window_ms
            groups.setdefault((r.subject, (r.custom_subject or "").lower() or None, window, r.fixed and window is not None, r.record), []).append(r)
    types = value_types(rules, example)
    out = []
    for (subject, custom, window, fixed, name), own in groups.items():
        made = [Measure("count", "bigint", tuple((r.filter_sql, None) for r in own))]
        if any(r.amount_sql for r in own):
            made.append(Measure("amount", MONEY, tuple((r.filter_sql, r.amount_sql) for r in own if r.amount_sql)))
        for v in dict.fromkeys(n for r in own for n, _ in r.value_sqls):
            feeds = tuple((r.filter_sql, dict(r.value_sqls)[v]) for r in own if v in dict(r.value_sqls))
            made.append(Measure(f"value_{v}", kind_of([types[sql] for _, sql in feeds]), feeds))
        out.append(Record(subject, custom, window, fixed, name, tuple(own), tuple(made)))
    return out


def value_types(rules: list[Rule], example: DataFrame) -> dict[str, object]:
    """The type of each named value's expression on rows like example."""
    sqls = list(dict.fromkeys(sql for r in rules if r.kind == "COMPUTE" for _, sql in r.value_sqls))
    found = example.limit(0).select(*(F.expr(sql).alias(f"v{i}") for i, sql in enumerate(sqls))).schema if sqls else []
    return {sql: f.dataType for sql, f in zip(sqls, found, strict=True)}


def slot_columns(own: list[Record]) -> dict[str, Column]:
    """What a row adds to each slot of some records."""
    out = {}
    for r in own:
        for m in r.measures:
            if m.slots[0] not in out:
                out |= dict(zip(m.slots, m.columns(), strict=True))
    return out
