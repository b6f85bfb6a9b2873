"""Windowed indicators: sliding, distinct, frame-based, fixed and unbounded.

A sliding window of W is the closed interval [t - W, t] and holds the rows ordered at or
before (t, transaction_no); with ``peers`` all rows of time t, as SQL's RANGE frames have it. Sums and counts over it come from signed deltas: each row adds
its values at t and takes them out after t + W, so every row is touched once a window
whatever its length. Running sums are two-level: a key's time is cut into spans, the
sums of whole spans are carried over, and only the rows of one span are sorted together,
so a hot key is spread over its spans.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from .sums import MONEY  # noqa: F401

#: The time span whose rows of one key are sorted together.
SPAN_MS = 86_400_000


def _up_to(ordered: WindowSpec, peers: bool) -> WindowSpec:
    """All rows of a window up to each one, or to the last that is equal to it in order."""
    return ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow) if peers else ordered.rowsBetween(Window.unboundedPreceding, 0)


def _running(signed: DataFrame, keys: list[str], order: list[str], at: str, values: list[str], span_us: int, source: DataFrame | None = None, peers: bool = False) -> DataFrame:
    """signed with each value replaced by its running sum over keys in the given order.

    source: a cheaper plan with the same keys, times and values, from which the spans' sums are taken. peers: rows that are equal in that order count together.
    """
    span = F.floor(F.col(at) / span_us)
    spans = signed.withColumn("_span", span)
    own = _up_to(Window.partitionBy(*keys, "_span").orderBy(*order), peers)
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    totals = (spans if source is None else source.withColumn("_span", span)).groupBy(*keys, "_span").agg(*(F.sum(v).alias(v) for v in values))
    carried = totals.select(*keys, "_span", *(F.sum(v).over(before).alias(f"_before_{v}") for v in values))
    local = spans.withColumns({v: F.sum(v).over(own) for v in values})
    met = local.join(carried, [*keys, "_span"])
    zero = F.lit(0)
    return met.withColumns({v: F.coalesce(v, zero) + F.coalesce(f"_before_{v}", zero) for v in values}).drop("_span", *(f"_before_{v}" for v in values))


def sliding_sums(df: DataFrame, keys: list[str], windows: dict[str, int], measures: dict[str, Column], at: str = "us", tie: str = "transaction_no", span_ms: int = SPAN_MS, source: DataFrame | None = None, peers: bool = False) -> DataFrame:
    """df with a column ``measure_window`` for each measure and window (name to ms): its sum in the window.

    Measures are long or decimal columns; null counts as 0. Rows with a null key are left out.
    source: where df is the end of a chain of indicators, the rows that it began with. peers: all rows of one time of a key count for each of them.
    """
    return sliding_columns(df, keys, {f"{m}_{w}": (m, ms) for w, ms in windows.items() for m in measures}, measures, at, tie, span_ms, source, peers)


def sliding_columns(df: DataFrame, keys: list[str], sums: dict[str, tuple[str, int]], measures: dict[str, Column], at: str = "us", tie: str = "transaction_no", span_ms: int = SPAN_MS, source: DataFrame | None = None, peers: bool = False) -> DataFrame:
    """As sliding_sums, for any choice of measures and windows. sums: a new column to (measure, window in ms); all of them share one shuffle."""
    windows = list(dict.fromkeys(ms for _, ms in sums.values()))
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), F.lit(ms * 1000).alias("late")) for i, ms in enumerate([0, *windows])])
    names = {out: (m, windows.index(ms) + 1) for out, (m, ms) in sums.items()}

    def signed(rows: DataFrame) -> DataFrame:
        valued = rows.dropna(subset=keys).withColumns({f"_m_{m}": F.coalesce(c, F.lit(0)) for m, c in measures.items()})
        each = valued.withColumn("_k", F.explode(kinds)).withColumns({"_at": F.col(at) + F.col("_k.late"), "_kind": F.col("_k.kind")}).drop("_k")
        return each.withColumns({out: F.when(F.col("_kind") == 0, F.col(f"_m_{m}")).when(F.col("_kind") == i, -F.col(f"_m_{m}")).otherwise(F.lit(0)) for out, (m, i) in names.items()}).drop(*(f"_m_{m}" for m in measures))

    payload = [c for c in df.columns if c not in (*keys, tie)]
    rows = signed(df).withColumns({c: F.when(F.col("_kind") == 0, F.col(c)) for c in payload})
    order = ["_at", F.expr("_kind > 0"), *([] if peers else [tie])]
    summed = _running(rows, keys, order, "_at", list(names), span_ms * 1000, None if source is None else signed(source), peers)
    return summed.filter("_kind = 0").select(*df.columns, *names)


def sliding_distinct(df: DataFrame, keys: list[str], value: str, window_ms: int, out: str, at: str = "us", tie: str = "transaction_no", span_ms: int = SPAN_MS, peers: bool = False) -> DataFrame:
    """df with the number of distinct non-null values in the window, by the same signed deltas: a value enters
    when its last hit is older than the window and leaves when no next hit comes in time. peers: as in sliding_sums."""
    w = window_ms * 1000
    hits = _hits(keys, value, at, tie)
    near = df.dropna(subset=keys).withColumns({"_last": F.lag(at).over(hits), "_next": F.lead(at).over(hits)})
    present = F.col(value).isNotNull()
    enters = present & (F.col("_last").isNull() | (F.col("_last") < F.col(at) - w))
    leaves = present & (F.col("_next").isNull() | (F.col("_next") > F.col(at) + w))
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.when(enters, 1).otherwise(0).alias("step")), F.struct(F.lit(1).alias("kind"), F.when(leaves, -1).otherwise(0).alias("step")))
    each = near.withColumn("_k", F.explode(kinds)).filter("_k.kind = 0 or _k.step <> 0")
    signed = each.withColumns({"_at": F.col(at) + F.col("_k.kind") * w, "_kind": F.col("_k.kind"), out: F.col("_k.step").cast("long")}).drop("_k", "_last", "_next")
    return _running(signed, keys, ["_at", "_kind", *([] if peers else [tie])], "_at", [out], span_ms * 1000, peers=peers).filter("_kind = 0").select(*df.columns, out)


def _hits(keys: list[str], value: str, at: str, tie: str):
    """The rows of one value of a key in order; those without a value, which may be very many, have no neighbours to look for."""
    return Window.partitionBy(*keys, value, F.when(F.col(value).isNull(), F.xxhash64(at, tie))).orderBy(at, tie)


def first_in_window(df: DataFrame, keys: list[str], value: str, window_ms: int, out: str, at: str = "us", tie: str = "transaction_no") -> DataFrame:
    """df with whether a row's value is new to the window that ends there."""
    last = F.lag(at).over(_hits(keys, value, at, tie))
    return df.withColumn(out, F.col(value).isNotNull() & F.coalesce(last < F.col(at) - window_ms * 1000, F.lit(True)))


def sliding_list(df: DataFrame, keys: list[str], value: str, window_ms: int, out: str, distinct: bool = False, at: str = "us", tie: str = "transaction_no", most: int | None = None, peers: bool = False) -> DataFrame:
    """df with the sorted list (or set) of non-null values in the window; an array brings all of its values. With ``most``, a longer list is an error rather than a loss. peers: as in sliding_sums.

    A key's time is cut into stretches as long as the window. A row is sent to its own and to the next one, which is all that
    can see it, so a hot key is spread over its stretches and a task holds what two windows hold.
    """
    width = window_ms * 1000
    each = df.dropna(subset=keys).withColumn("_ahead", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_span", F.floor(F.col(at) / width) + F.col("_ahead"))
    entry = F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"), F.col(value).alias("value"))
    frame = Window.partitionBy(*keys, "_span").orderBy(at).rangeBetween(-width, 0)
    inside = F.col("_held") if peers else F.filter("_held", lambda e: (e["at"] < F.col(at)) | (e["tie"] <= F.col(tie)))
    values = F.transform(inside, lambda e: e["value"])
    values = F.array_sort(F.flatten(values) if isinstance(df.schema[value].dataType, T.ArrayType) else values)
    values = F.array_distinct(values) if distinct else values
    if most is not None:
        values = F.when(F.size(values) <= most, values).otherwise(F.raise_error(F.lit(f"more than {most} values of {value} in a window")))
    held = F.collect_list(F.when(F.col(value).isNotNull(), entry)).over(frame)
    return each.withColumn("_held", held).filter("_ahead = 0").withColumn(out, values).drop("_held", "_span", "_ahead")


def sliding_last(df: DataFrame, keys: list[str], values: dict[str, Column], window_ms: int | None, at: str = "us", tie: str = "transaction_no", span_ms: int = SPAN_MS, source: DataFrame | None = None, peers: bool = False) -> DataFrame:
    """df with the last non-null value of each name within the window (None: since the key's first row).

    The last value of all earlier rows is also the window's, unless it is older than that; it is carried over
    spans like a running sum. source, peers: as in sliding_sums.
    """
    entry = lambda c: F.when(c.isNotNull(), F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"), c.alias("value")))
    names = {n: f"_e_{i}" for i, n in enumerate(values)}
    cut = lambda rows: rows.dropna(subset=keys).withColumns({names[n]: entry(c) for n, c in values.items()}).withColumn("_span", F.floor(F.col(at) / (span_ms * 1000)))
    spans = cut(df)
    own = _up_to(Window.partitionBy(*keys, "_span").orderBy(*([at] if peers else [at, tie])), peers)
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    ends = (spans if source is None else cut(source)).groupBy(*keys, "_span").agg(*(F.max(e).alias(e) for e in names.values()))
    carried = ends.select(*keys, "_span", *(F.max(e).over(before).alias(f"{e}_before") for e in names.values()))
    met = spans.withColumns({e: F.max(e).over(own) for e in names.values()}).join(carried, [*keys, "_span"])
    held = {n: F.coalesce(e, f"{e}_before") for n, e in names.items()}
    fresh = {n: c["value"] if window_ms is None else F.when(c["at"] >= F.col(at) - window_ms * 1000, c["value"]) for n, c in held.items()}
    return met.withColumns(fresh).select(*(c for c in df.columns if c not in values), *values)


def global_record(df: DataFrame, keys: list[str], measures: dict[str, Column], at: str = "us", tie: str = "transaction_no", span_ms: int = SPAN_MS, source: DataFrame | None = None) -> DataFrame:
    """df with running sums of each measure since the key's first row. source: as in sliding_sums."""
    valued = lambda rows: rows.dropna(subset=keys).withColumns({m: F.coalesce(c, F.lit(0)) for m, c in measures.items()})
    return _running(valued(df), keys, [at, tie], at, list(measures), span_ms * 1000, None if source is None else valued(source))


#: Fixed windows that make one span of a key's time.
SPAN_WINDOWS = 8
#: The time of a mark before the rows of a span in which a window is open already.
GOES_ON = -(2**63)
#: Ways into spans that a task gathers before it sends them on.
EXITS_AT_ONCE = 100_000


def _span_exits(times: np.ndarray, first: int | None, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(last, exit) for a span of one key that begins at first: the last window of the span ends at ``exit[i]`` if its first one begins
    at a row after ``last[i - 1]`` and up to ``last[i]``; times are distinct and in order. first None: the span's earlier rows are not there."""
    after = np.searchsorted(times, times + width, "right")
    last = np.where(after < len(times), after, np.arange(len(times)))
    while (last[last] != last).any():  # a way's next windows, twice as many each time
        last = last[last]
    ends = times[last] + width
    could = len(times) if first is None else min(len(times), int(np.searchsorted(times, first + width, "right")) + 1)  # a window from before the span ends before first + width
    ends = ends[:could]
    edge = np.flatnonzero(np.append(ends[1:] != ends[:-1], True))
    return times[edge], ends[edge]


def _placed(times: np.ndarray, group: np.ndarray, entries: np.ndarray, known: np.ndarray, width: int) -> np.ndarray:
    """The window start of each row. times: in order within each group; group: 0, 1, ...; entries: the end of the window that is open where a group begins, if ``known``.

    The windows of all groups are followed together, one window of each at a time.
    """
    first = np.searchsorted(group, np.arange(len(entries)))
    until = np.append(first[1:], len(times))
    some = np.flatnonzero(first < until)
    base = np.zeros(len(entries), np.int64)
    base[some] = times[first[some]]
    room = int((times - base[group]).max(initial=0)) + 2
    line = group * room + (times - base[group]) + 1
    after = lambda g, end: np.searchsorted(line, g * room + np.clip(end - base[g] + 1, 0, room - 1), "right")
    at = np.where(known[some], after(some, entries[some]), first[some])
    opens = np.zeros(len(times), bool)
    while True:
        going = at < until[some]
        some, at = some[going], at[going]
        if not len(some):
            break
        opens[at] = True
        at = after(some, times[at] + width)
    opener = np.maximum.accumulate(np.where(opens, np.arange(len(times)), -1))
    own = opener >= first[group]
    return np.where(own, times[np.maximum(opener, 0)], entries[group] - width)


def anchored_window(df: DataFrame, keys: list[str], window_ms: int, at: str = "us", tie: str = "transaction_no", span_windows: int = SPAN_WINDOWS, source: DataFrame | None = None, opened: DataFrame | None = None) -> DataFrame:
    """df with window_start and window_end (microseconds) of fixed windows that open at a key's first row and reopen at
    the first row past their end; a row exactly at the end is inside.

    A key's time is cut into spans of span_windows windows. Each span finds out, apart from the others, how its last
    window would end for each way into it; only these short tables are walked through in the key's order, and
    tell each span the end of the window that is open at its beginning. Then every span places its rows by itself, so a hot
    key is spread over its spans. source: as in sliding_sums. opened: keys and ``_open``, the end of the window that earlier rows have opened.
    """
    width = window_ms * 1000
    span = width * span_windows
    cut = lambda rows: rows.dropna(subset=[*keys, at]).withColumn("_span", F.floor(F.col(at) / span))
    rows = cut(df)
    group = [*keys, "_span"]
    n = len(group)

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, done, size, types = None, [], [], 0, []

        def finish() -> None:
            nonlocal size
            times = np.unique(np.concatenate(held))
            goes_on = times[0] == GOES_ON
            if len(times) == goes_on:
                return
            last, ends = _span_exits(times[1:], None, width) if goes_on else _span_exits(times, now[-1] * span, width)
            done.append((*now, last, ends))
            size += len(last)

        def flat() -> pa.RecordBatch:
            nonlocal size
            *own, last, ends = zip(*done, strict=True)
            done.clear()
            size = 0
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(own, types, strict=True)), pa.array(last, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], [*group, "last", "ends"])

        for batch in batches:
            if not batch.num_rows:
                continue
            types = [c.type for c in batch.columns[:n]]
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for c in batch.columns[:n]:
                new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(new)
            times = batch.column(n).to_numpy()
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), batch.num_rows], strict=True):
                own = [batch.column(i)[a].as_py() for i in range(n)]
                if now is not None and own != now:
                    finish()
                    held = []
                    if size >= EXITS_AT_ONCE:
                        yield flat()
                now = own
                some = times[a:b]
                held.append(some[np.append(True, some[1:] != some[:-1])])
        if held:
            finish()
        if done:
            yield flat()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, end = None, None
        for batch in batches:
            entries = []
            own = list(zip(*(batch.column(i).to_pylist() for i in range(n - 1)), strict=True))
            for k, last, ends in zip(own, batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True):
                if k != now:
                    now, end = k, None
                if last is None:  # of a key that goes on
                    end = ends[0]
                entries.append(end)
                if last is None:
                    continue
                i = 0 if end is None else bisect_right(last, end)
                end = ends[i] if i < len(last) else end
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(entries, pa.int64())], [*group, "_entry"])

    plain = (rows if source is None else cut(source)).select(*group, F.col(at).alias("_at"))
    kinds = plain.schema.fields[:n]
    if opened is not None:
        plain = plain.unionByName(opened.select(*keys, F.floor((F.col("_open") - width) / span).alias("_span"), F.lit(GOES_ON).alias("_at")))
    many = T.ArrayType(T.LongType())
    steps = plain.repartition(*group).sortWithinPartitions(*group, "_at").mapInArrow(exits, T.StructType([*kinds, T.StructField("last", many), T.StructField("ends", many)]))
    if opened is not None:
        steps = steps.unionByName(opened.select(*keys, F.lit(GOES_ON).alias("_span"), F.lit(None).cast(many).alias("last"), F.array("_open").alias("ends")))
    entries = steps.repartition(*keys).sortWithinPartitions(*group).mapInArrow(walk, T.StructType([*kinds, T.StructField("_entry", T.LongType())]))
    # a span's entry goes before its rows
    both = rows.withColumn("_entry", F.lit(None).cast("long")).withColumn("_kind", F.lit(1)).unionByName(entries.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    schema = T.StructType([*df.schema.fields, T.StructField("window_start", T.LongType()), T.StructField("window_end", T.LongType())])
    size = len(df.columns)
    time, entry, kind = (both.columns.index(c) for c in (at, "_entry", "_kind"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = None
        for batch in batches:
            if not batch.num_rows:
                continue
            is_row = batch.column(kind).to_numpy() == 1
            heads, times = batch.column(entry).filter(pa.array(~is_row)), batch.column(time).filter(pa.array(is_row)).to_numpy()
            entries = np.append(0 if end is None else end, pc.fill_null(heads, 0).to_numpy())
            known = np.append(end is not None, heads.is_valid().to_numpy(zero_copy_only=False))
            group = np.cumsum(~is_row)[is_row]
            starts = _placed(times, group, entries, known, width)
            if len(group) and group[-1] == len(entries) - 1:
                end = int(starts[-1]) + width
            else:
                end = int(entries[-1]) if known[-1] else None
            begin = pa.array(starts)
            yield pa.RecordBatch.from_arrays([*(c.filter(pa.array(is_row)) for c in batch.columns[:size]), begin, pc.add(begin, width)], schema.names)

    # every group begins with its entry, so rows need no comparison of keys
    return both.repartition(*group).sortWithinPartitions(*group, "_kind", at, tie).mapInArrow(place, schema)


def epoch_window(df: DataFrame, window_ms: int, at: str = "us") -> DataFrame:
    """df with window_start and window_end of calendar-aligned windows, closed at the start and open at the end."""
    start = F.floor(F.col(at) / (window_ms * 1000)) * window_ms * 1000
    return df.withColumns({"window_start": start, "window_end": start + window_ms * 1000})


def running_in_window(df: DataFrame, keys: list[str], measures: dict[str, Column], at: str = "us", tie: str = "transaction_no", span_ms: int = SPAN_MS, source: DataFrame | None = None, window_ms: int | None = None) -> DataFrame:
    """df with running sums within each fixed window. source: as in sliding_sums, with window_start. window_ms: the length of the windows; those no
    longer than a span are summed up in one step, as a task then holds no more rows than with spans."""
    valued = lambda rows: rows.withColumns({m: F.coalesce(c, F.lit(0)) for m, c in measures.items()})
    if window_ms is not None and window_ms <= span_ms:
        own = Window.partitionBy(*keys, "window_start").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
        return valued(df).withColumns({m: F.sum(m).over(own) for m in measures})
    return _running(valued(df), [*keys, "window_start"], [at, tie], at, list(measures), span_ms * 1000, None if source is None else valued(source))


def window_long_form(df: DataFrame, windows: dict[str, int], measures: list[str]) -> DataFrame:
    """One row for each window instead of a column for each: window_ms and the measures."""
    each = F.array(*[F.struct(F.lit(ms).cast("long").alias("window_ms"), *(F.col(f"{m}_{w}").alias(m) for m in measures)) for w, ms in windows.items()])
    kept = [c for c in df.columns if c not in {f"{m}_{w}" for m in measures for w in windows}]
    return df.select(*kept, F.explode(each).alias("_w")).select(*kept, "_w.*")
