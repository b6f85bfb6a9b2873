"""The main path: transactions in, scored alert sets out, as one DataFrame plan.

Rules are grouped by subject, so that one pass over a subject's keys keeps the indicators
of all its windows; subjects follow one another on the same rows without a join.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import composite_key
from ..operators.alerts import alert_array, union_alerts, with_status
from ..operators.records import Record, records, slot_columns
from ..operators.rules import Rule, check, failed, failures, guarded, in_group, tried
from ..operators.state import STATE_FIELDS, State, latest, tail
from ..operators.windows import SPAN_MS, anchored_window, global_record, running_in_window, sliding_columns, sliding_last, sliding_list

#: Rows of a look-up table that is sent to every task; a larger one is met by a shuffle.
LOOKUP_ROWS = 100_000


def subject_keys(rules: list[Rule], custom: dict[str, list[str]]) -> dict[str, Column]:
    """The key of each subject that rules use, by lower-case name; a null part makes a null key. custom: SQL expressions of a key's parts."""
    keys = {}
    parts = {name.lower(): columns for name, columns in custom.items()}
    for r in rules:
        name = (r.custom_subject or r.subject).lower()
        if r.subject == "Card":
            keys[name] = F.col("card_id")
        elif r.subject == "Merchant":
            keys[name] = F.col("merchant")
        else:
            keys[name] = composite_key(*(guarded(c).cast("string") for c in parts[name]))
    return keys


def with_lookups(df: DataFrame, lookups: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """df with the columns ``name_column`` of each look-up table for use in rules. lookups: name to (table, its key column, SQL of the key in df).

    One row of a key counts, the least; a table of up to LOOKUP_ROWS rows is sent to every task.
    """
    for name, (table, key, sql) in lookups.items():
        others = [c for c in table.columns if c != key]
        one = table.dropna(subset=[key]).groupBy(F.col(key).alias(f"_{name}")).agg(F.min(F.struct(*others)).alias("_row")).select(f"_{name}", *(F.col(f"_row.{c}").alias(f"{name}_{c}") for c in others))
        found = df.withColumn(f"_{name}", guarded(sql).try_cast(table.schema[key].dataType))
        df = found.join(F.broadcast(one) if table.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS else one, f"_{name}", "left").drop(f"_{name}")
    return df


def with_indicators(df: DataFrame, rules: list[Rule], custom: dict[str, list[str]] | None = None, start: State | None = None, peers: bool = False) -> DataFrame:
    """df with a column for each measure of each record that COMPUTE rules keep, over its window or without end.

    A row whose key is null for a subject gets a key of its own there, so that it stays and loads no task. start: what earlier rows have
    left, from which df goes on; all rows of df are later. peers: sliding windows hold all rows of a key that have the row's time, not only those up to its number.
    """
    recs = records(rules, df)
    out = _kept(df, recs, custom or {}, start, peers)
    done: dict[str, Column] = {}
    for r in recs:
        done |= r.finished({s: F.col(_slot(s, r)) for m in r.measures for s in m.slots})
    mine = [c for r in recs for c in ([r.column("list"), r.column("set")] if r.lists else []) + ([r.column("last")] if r.lasts else [])]
    return out.select(*df.columns, *(c for c in out.columns if c.startswith("_key_")), *(c.alias(n) for n, c in done.items()), *mine)


def _slot(slot: str, r: Record) -> str:
    return f"_{slot}_{r.part}"


def _end(r: Record) -> str:
    return f"_end_{r.part}"


def keyed(df: DataFrame, owners: list[str], rules: list[Rule], custom: dict[str, list[str]]) -> DataFrame:
    """df with the key of each subject in owners as text."""
    keys = subject_keys(rules, custom)
    alone = F.concat(F.lit("\0"), F.col("transaction_no").cast("string"))
    return df.withColumns({f"_key_{name}": F.coalesce(keys[name].cast("string"), alone) for name in owners})


def _kept(df: DataFrame, recs: list[Record], custom: dict[str, list[str]], start: State | None, peers: bool = False) -> DataFrame:
    """df with its keys and, for each record, the sums of its slots, its list, set and last value, and the end of its fixed window.

    What slides needs the rows before, so it is found over the tail and df together; what is fixed or without end goes on from saved values, over df only.
    """
    owners = list(dict.fromkeys(r.owner for r in recs))
    rules = [x for r in recs for x in r.rules]
    if start is None:
        df = source = keyed(df, owners, rules, custom)
    else:
        both = start.tail.select(*df.columns, F.lit(False).alias("_new")).unionByName(df.withColumn("_new", F.lit(True)))
        df = source = keyed(both, owners, rules, custom)
    for name in owners:
        df = _slide(df, f"_key_{name}", [r for r in recs if r.owner == name and r.window_ms is not None and not r.fixed], source, peers)
    if start is not None:
        df, source = df.filter("_new").drop("_new"), source.filter("_new").drop("_new")
    for name in owners:
        own = [r for r in recs if r.owner == name]
        held = None if start is None else start.records
        df = _last_for_ever(df, f"_key_{name}", [r for r in own if r.window_ms is None], source, held)
        for ms in dict.fromkeys(r.window_ms for r in own if r.fixed):
            df = _fix(df, f"_key_{name}", [r for r in own if r.fixed and r.window_ms == ms], source, held)
    return df


def _slide(df: DataFrame, key: str, recs: list[Record], source: DataFrame, peers: bool) -> DataFrame:
    if not recs:
        return df
    sums = {_slot(s, r): (s, r.window_ms) for r in recs for m in r.measures for s in m.slots}
    df = sliding_columns(df, [key], sums, slot_columns(recs), source=source, peers=peers)
    for ms in dict.fromkeys(r.window_ms for r in recs):
        own = [r for r in recs if r.window_ms == ms]
        if lasts := {r.column("last"): r.last() for r in own if r.lasts}:
            df = sliding_last(df, [key], lasts, ms, source=source, peers=peers)
        for r in own:
            df = _list(df, [key], r, peers)
    return df


def _list(df: DataFrame, keys: list[str], r: Record, peers: bool = False) -> DataFrame:
    if not r.lists:
        return df
    df = sliding_list(df.withColumn("_arg", r.texts()), keys, "_arg", r.window_ms, r.column("list"), peers=peers).drop("_arg")
    return df.withColumn(r.column("set"), F.array_distinct(r.column("list")))


def _saved(df: DataFrame, key: str, recs: list[Record], held: DataFrame | None, column: Callable[[Record], dict[str, Column]]) -> DataFrame:
    """df and columns of the state of its key: name to an expression over a state's row."""
    if held is None:
        return df
    made = []
    for r in recs:
        same = (F.col("record") == r.name) & F.col("window_ms").eqNullSafe(F.lit(r.window_ms).cast("long")) & (F.coalesce("fixed", F.lit(False)) == r.fixed)
        made += [F.max(F.when(same, c)).alias(n) for n, c in column(r).items()]
    first = recs[0]
    mine = held.filter((F.col("subject") == first.subject) & F.lower("custom_subject").eqNullSafe(F.lit(first.custom).cast("string")))
    return df.join(mine.groupBy(F.col("key").alias(key)).agg(*made), key, "left")


def _before(r: Record) -> dict[str, Column]:
    """The sums and the last value that a state has of a record, under names of their own."""
    out = {f"_was{_slot(s, r)}": F.element_at(F.element_at("sums", F.lit(m.name)), i) for m in r.measures for i, s in enumerate(m.slots, 1)}
    return out | ({f"_was_{r.column('last')}": F.col("last")} if r.lasts else {})


def _last_for_ever(df: DataFrame, key: str, recs: list[Record], source: DataFrame, held: DataFrame | None) -> DataFrame:
    if not recs:
        return df
    added = slot_columns(recs)
    slots = list(dict.fromkeys(s for r in recs for m in r.measures for s in m.slots))
    df = global_record(df, [key], {f"_{s}_{recs[0].part}": added[s] for s in slots}, source=source)
    if lasts := {r.column("last"): r.last() for r in recs if r.lasts}:
        df = sliding_last(df, [key], lasts, None, source=source)
    if held is not None:
        df = _saved(df, key, recs, held, _before)
        grown = {_slot(s, r): F.col(_slot(s, r)) + F.coalesce(f"_was{_slot(s, r)}", F.lit(0)) for r in recs for m in r.measures for s in m.slots}
        df = df.withColumns(grown | {c: F.coalesce(c, f"_was_{c}") for c in lasts}).drop(*(n for r in recs for n in _before(r)))
    return df


def _fix(df: DataFrame, key: str, recs: list[Record], source: DataFrame, held: DataFrame | None) -> DataFrame:
    """Records of one fixed window. One that earlier rows have opened goes on, with its sums, list and last value."""
    ms = recs[0].window_ms
    end = f"_open_{recs[0].part}"
    opened = None
    if held is not None:
        mine = held.filter((F.col("subject") == recs[0].subject) & F.lower("custom_subject").eqNullSafe(F.lit(recs[0].custom).cast("string")) & F.col("fixed") & (F.col("window_ms") == ms))
        opened = mine.groupBy(F.col("key").alias(key)).agg(F.max("window_end").alias("_open")).filter("_open is not null")
    inside = [key, "window_start"]
    added = slot_columns(recs)
    sums = {f"_{s}_{recs[0].part}": added[s] for s in dict.fromkeys(s for r in recs for m in r.measures for s in m.slots)}
    lasts = {r.column("last"): r.last() for r in recs if r.lasts}
    df = anchored_window(df, [key], ms, source=source, opened=opened)
    if ms <= SPAN_MS:  # a task has the rows of one window of a key, for all of its records
        own = Window.partitionBy(*inside).orderBy("us", "transaction_no").rowsBetween(Window.unboundedPreceding, 0)
        lists = {r.column("list"): F.array_sort(F.flatten(F.collect_list(r.texts()).over(own))) for r in recs if r.lists}
        df = df.withColumns({c: F.sum(F.coalesce(x, F.lit(0))).over(own) for c, x in sums.items()} | {c: F.last(x, ignorenulls=True).over(own) for c, x in lasts.items()} | lists)
        df = df.withColumns({r.column("set"): F.array_distinct(r.column("list")) for r in recs if r.lists}) if lists else df
    else:
        rows = anchored_window(source, [key], ms, opened=opened)
        df = running_in_window(df, [key], sums, source=rows)
        if lasts:
            df = sliding_last(df, inside, lasts, ms, source=rows)  # a fixed window is no longer than ms, so a sliding one over its rows holds all of them
        for r in recs:
            df = _list(df, inside, r)
    df = df.withColumn(_end(recs[0]), F.col("window_end")).drop("window_start", "window_end")
    if held is not None:
        more = lambda r: {end: F.col("window_end")} | _before(r) | ({f"_was_{r.column('list')}": F.col("arg_list")} if r.lists else {})
        df = _saved(df, key, recs, held, lambda r: {n: c for n, c in more(r).items() if n != end or r is recs[0]})
        goes_on = F.coalesce(F.col(end) == F.col(_end(recs[0])), F.lit(False))
        grown = {_slot(s, r): F.col(_slot(s, r)) + F.when(goes_on, F.coalesce(f"_was{_slot(s, r)}", F.lit(0))).otherwise(F.lit(0)) for r in recs for m in r.measures for s in m.slots}
        grown |= {c: F.coalesce(c, F.when(goes_on, F.col(f"_was_{c}"))) for c in lasts}
        for r in recs:
            if r.lists:
                c = r.column("list")
                grown |= {c: F.when(goes_on & F.col(f"_was_{c}").isNotNull(), F.array_sort(F.concat(c, f"_was_{c}"))).otherwise(F.col(c))}
        df = df.withColumns(grown).drop(end, *(n for r in recs for n in more(r)))
        df = df.withColumns({r.column("set"): F.array_distinct(r.column("list")) for r in recs if r.lists}) if any(r.lists for r in recs) else df
    return df


def indicator_state(df: DataFrame, rules: list[Rule], custom: dict[str, list[str]] | None = None, start: State | None = None) -> DataFrame:
    """The state that df leaves for each key: its records after its last row, one row for each; a snapshot for state.query_indicators, and what with_indicators goes on from.

    subject, custom_subject, key, window_ms (null: unbounded), fixed, record, count, amount, values, arg_list, arg_set, last, as_of; sums (a measure to the exact sums of its
    parts), window_end (of a fixed one). start: the state before df; keys that df doesn't touch keep theirs.
    """
    recs = records(rules, df)
    rows = _kept(df, recs, custom or {}, start)
    out = None
    for name in dict.fromkeys(r.owner for r in recs):
        own = [r for r in recs if r.owner == name]
        key, columns, each = f"_key_{name}", {}, []
        take = lambda c: F.col(columns.setdefault(c, f"_v{len(columns)}"))  # noqa: E731, B023
        for r in own:
            sums = {s: take(_slot(s, r)) for m in r.measures for s in m.slots}
            each.append(state_row(r, sums, take(r.column("list")) if r.lists else None, take(r.column("last")) if r.lasts else None, take(_end(r)) if r.fixed else None))
        known = rows.filter(~F.col(key).startswith("\0")).select(F.col(key).alias("key"), "us", "transaction_no", *(F.col(c).alias(v) for c, v in columns.items()))
        held = latest(known, ["key"], list(columns.values()))
        mine = held.select(F.lit(own[0].subject).alias("subject"), F.lit(own[0].custom).cast("string").alias("custom_subject"), "key", F.explode(F.array(*each)).alias("r"), "as_of").select("subject", "custom_subject", "key", "r.*", "as_of")
        out = mine if out is None else out.unionByName(mine)
    if start is not None:
        seen = out.select("subject", F.coalesce(F.lower("custom_subject"), F.lit("")).alias("_c"), "key").distinct()
        old = start.records.withColumn("_c", F.coalesce(F.lower("custom_subject"), F.lit(""))).join(seen, ["subject", "_c", "key"], "left_anti")
        out = out.unionByName(old.select(*out.columns))
    return out


def state_row(r: Record, sums: dict[str, Column], texts: Column | None, last: Column | None, end: Column | None) -> Column:
    """A record's row of a state as a struct."""
    none = lambda kind: F.lit(None).cast(kind)
    by_name = {m.name: m for m in r.measures}
    whole_ = {m.name: c for m, c in zip(r.measures, r.finished(sums).values(), strict=True)}
    values = [m.name for m in r.measures if m.name.startswith("value_")]
    texts = none("array<string>") if texts is None else texts
    return F.struct(
        F.lit(r.window_ms).cast("long").alias("window_ms"), F.lit(r.fixed).alias("fixed"), F.lit(r.name).alias("record"), whole_["count"].alias("count"), (whole_["amount"].cast("double") if "amount" in whole_ else none("double")).alias("amount"),
        F.map_from_arrays(F.array(*(F.lit(v.removeprefix("value_")) for v in values)).cast("array<string>"), F.array(*(whole_[v].cast("double") for v in values)).cast("array<double>")).alias("values"),
        texts.alias("arg_list"), F.array_distinct(texts).alias("arg_set"), (none("string") if last is None else last).alias("last"),
        F.map_from_arrays(F.array(*(F.lit(n) for n in by_name)), F.array(*(F.array(*(sums[s] for s in m.slots)) for m in by_name.values()))).alias("sums"), (none("long") if end is None else end).alias("window_end"),
    )


def next_state(df: DataFrame, rules: list[Rule], custom: dict[str, list[str]] | None = None, start: State | None = None) -> State:
    """What df, after the rows behind start, leaves to go on from: the state of all records and the rows that sliding windows still hold."""
    longest = max((r.window_ms for r in rules if r.kind == "COMPUTE" and r.window_ms and r.scope == "window" and not r.fixed), default=0)
    rows = df if start is None else start.tail.select(*df.columns).unionByName(df)
    return State(indicator_state(df, rules, custom, start), tail(rows, longest))


def resume_indicators(df: DataFrame, earlier: DataFrame, rules: list[Rule], custom: dict[str, list[str]] | None = None, peers: bool = False) -> DataFrame:
    """df with the indicators of sliding windows that go on from earlier rows. earlier: state.tail of those, with the columns of df."""
    sliding = [r for r in rules if r.kind == "COMPUTE" and r.scope == "window" and not r.fixed]
    return with_indicators(df, sliding, custom, State(df.sparkSession.createDataFrame([], STATE_FIELDS), earlier), peers)


def evaluated(rows: DataFrame, rules: list[Rule], custom: dict[str, list[str]], example: DataFrame) -> DataFrame:
    """rows, which have the rules' indicators, with ``alerts`` of all subjects and ``rule_errors``: the titles of rules and names of custom subjects that failed there.

    A subject whose key fails, or a rule that does, drops out; the others count. example: rows with the columns of the transactions.
    """
    alerting = [r for r in rules if r.kind == "ALERT"]
    keys = subject_keys(rules, custom)
    held = {r: F.col(f"_tried_{i}") for i, r in enumerate(alerting)}
    rows = rows.withColumns({f"_tried_{i}": tried(r) for i, r in enumerate(alerting)}) if alerting else rows
    parts = {}
    for name in dict.fromkeys((r.custom_subject or r.subject).lower() for r in alerting):
        own = [r for r in alerting if (r.custom_subject or r.subject).lower() == name]
        parts[f"_alerts_{name}"] = F.when(keys[name].isNotNull(), alert_array(own, keys, held))
    rows = rows.withColumns(parts) if parts else rows
    alerts = union_alerts(*(F.col(p) for p in parts)) if parts else alert_array([], {})
    lost = [F.when(reduce(or_, (failed(c) for c in custom[name])), F.lit(name)) for name in custom if name.lower() in keys]
    errors = failures(rules, example, held)
    errors = F.concat(errors, F.array_compact(F.array(*lost))) if lost else errors
    return rows.withColumns({"alerts": alerts, "rule_errors": errors}).drop(*parts, *(f"_tried_{i}" for i in range(len(alerting))))


def in_force(rules: list[Rule], example: DataFrame, custom: dict[str, list[str]] | None) -> tuple[list[Rule], dict[str, str]]:
    """(the rules that can be evaluated, the titles of the others with the reasons)."""
    bad = check(rules, example, custom or {})
    return [r for r in rules if r.title not in bad], bad


def check_transactions(df: DataFrame, rules: list[Rule], custom: dict[str, list[str]] | None = None, group: str | None = None, lookups: dict[str, tuple[DataFrame, str, str]] | None = None, start: State | None = None, peers: bool = False) -> DataFrame:
    """transaction_no, card_id, merchant, amount, ts, us, alerts, rule_errors, alert_status and score of each transaction.

    Rules that fail their check are left out and named in the rule_errors of all rows; the score is out of the number of ALERT rules that are evaluated. group: only that group's are. start, peers: as in with_indicators.
    """
    df = with_lookups(df, lookups or {})
    if start is not None and lookups:
        start = State(start.records, with_lookups(start.tail, lookups))
    rules, bad = in_force(in_group(rules, group), df, custom)
    rows = evaluated(with_indicators(df, rules, custom, start, peers), rules, custom or {}, df)
    if bad:
        rows = rows.withColumn("rule_errors", F.concat(F.array(*(F.lit(t) for t in bad)), "rule_errors"))
    return with_status(rows.select("transaction_no", "card_id", "merchant", "amount", "ts", "us", "alerts", "rule_errors"), sum(r.kind == "ALERT" for r in rules))
