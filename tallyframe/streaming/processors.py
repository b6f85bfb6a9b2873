"""Keyed state for streams: sliding, fixed and unbounded sums, lists and last values of a key by one processor.

Rows of a key are put in order within a micro-batch. ``arrival`` order answers them at once
and lets a late row join the state as it is; ``event_time`` order keeps them until the
watermark has passed them, so that answers equal the batch's.

A key's time is cut into buckets, a fraction of its longest window. The state holds the sums of all live buckets as one value and,
apart from them, each bucket's rows, so a micro-batch reads those sums but only the rows
of the buckets that its own rows lie in and that its windows begin in. While all live rows of a key have no more than FEW_BYTES, they are that value instead
and nothing is kept by buckets (live texts: no more than FEW_TEXTS rows): each read or write of a state variable is a call from Python to Spark, and most keys have few rows. For the same reason what else a
key has is held as one value for its sliding windows, one for its fixed ones, and one that outlives both. In arrival order a key's rows of a micro-batch come as a few
Arrow tables, and its answers go as such, since Spark makes each value of a row by itself in Python. In event-time order a key has one timer: for
the first row that waits, else for the time at which its last window is empty or over and the state of its windows goes. In
arrival order a key's old buckets go when it has a new row, and all of its windows, by a timer of processing time, when it has had none for ``idle_ms``.
Where there are no timers, in arrival order without ``idle_ms``, SHARDS groups of keys share a value each (``Shards``).

Texts for lists and last values are held in buckets of their own, each with a summary: the bucket's distinct texts with their counts,
and its last text. A window's list is put together from the summaries of the buckets that lie within it and the rows
of those at its two ends, so what a micro-batch reads grows with the distinct texts of a window and not with its rows; only a
bucket that has new rows is written again. A last value without window is the one of the latest row that brought one.
"""

from __future__ import annotations

import io
import pickle
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import MapState

from ..operators.windows import _placed

#: Buckets of the longest window.
BUCKETS = 32
#: Bytes of a key's rows that are held as one value.
FEW_BYTES = 6_000
#: Rows with texts of a key that are held as one value.
FEW_TEXTS = 16
#: Where many keys share a value of the state: rows with texts of a key that are held in it, and their characters.
SHARD_TEXTS, SHARD_CHARACTERS = 64, 4_000
#: Groups of keys that share a value of the state; a job's state is laid out by them.
SHARDS = 4_096
#: Rows, and bytes, that are put in the order of their keys at once; rows of a key in one table.
PACKED_ROWS, PACKED_BYTES, TABLE_ROWS = 250_000, 64 << 20, 20_000


class Spec(NamedTuple):
    """The windows of a kind of keys, by the name of their columns' last part; sizes in ms."""

    sliding: dict[str, int]
    fixed: dict[str, int]
    unbounded: str | None
    #: The sums that are kept; empty: all.
    sums: tuple[str, ...] = ()

    @property
    def span(self) -> int:
        """Microseconds of a bucket."""
        return max(1000, max(self.sliding.values(), default=0) * 1000 // BUCKETS)

    @property
    def parts(self) -> list[str]:
        return [*self.sliding, *self.fixed, *([self.unbounded] if self.unbounded else [])]


def _packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue()


def _table(rows: pa.RecordBatch) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4" if rows.num_rows > 1_000 else None)) as writer:
        writer.write_batch(rows)
    return out.getvalue()


def _whole(tables: list[pa.Table]) -> pa.RecordBatch:
    """All rows of tables of one schema as one batch."""
    table = pa.concat_tables(tables).combine_chunks()
    return pa.RecordBatch.from_arrays([c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns], schema=table.schema)


def _read(table: bytes) -> pa.Table:
    return pa.ipc.open_stream(table).read_all()


def packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ``_rows``: the rows of each key as Arrow tables, few for each. No more than PACKED_ROWS and PACKED_BYTES are held at once."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, width = [], 0, 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size, width = size + batch.num_rows, width + batch.nbytes
            if size >= PACKED_ROWS or width >= PACKED_BYTES:
                yield from groups(held)
                held, size, width = [], 0, 0
        if size:
            yield from groups(held)

    def groups(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        every = _whole(held)
        codes = [pc.dictionary_encode(every.column(k), null_encoding="encode").indices.to_numpy() for k in keys]
        order = np.lexsort((every.column("us").to_numpy(), *codes))
        changed = np.ones(len(order), bool)
        changed[1:] = np.any([c[order][1:] != c[order][:-1] for c in codes], axis=0)
        begins = np.flatnonzero(changed)
        ends = np.append(begins[1:], len(order))
        cuts = [(i, min(i + TABLE_ROWS, j)) for b, j in zip(begins.tolist(), ends.tolist(), strict=True) for i in range(b, j, TABLE_ROWS)]
        body = every.take(pa.array(order))
        tables = pa.array([_table(body.slice(i, j - i)) for i, j in cuts], pa.binary())
        yield pa.RecordBatch.from_arrays([*body.select(keys).take(pa.array([i for i, _ in cuts])).columns, tables], [*keys, "_rows"])

    return rows.repartition(*keys).mapInArrow(pack, T.StructType([*(rows.schema[k] for k in keys), T.StructField("_rows", T.BinaryType())]))


def spread(out: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """The rows of tables that ``Records`` has packed."""
    names = [f.name for f in fields]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for table in batch.column(0):
                held.append(_read(table.as_py()).select(names))
                size += held[-1].num_rows
                if size >= TABLE_ROWS:
                    yield _whole(held)
                    held, size = [], 0
            if held:
                yield _whole(held)

    return out.mapInArrow(rows, T.StructType(fields))


LATEST = "part string, us long, sums map<string,long>, lists map<string,map<string,long>>, lasts map<string,string>, ends long"


def latest_rows(values: DataFrame) -> DataFrame:
    """subject, key and the columns of LATEST, from the values of the state ``latest`` (``held``) of these, or of shards if no subject is given."""
    counts = pa.map_(pa.string(), pa.int64())
    kinds = {"subject": pa.string(), "key": pa.string(), "part": pa.string(), "us": pa.int64(), "sums": counts, "lists": pa.map_(pa.string(), counts), "lasts": pa.map_(pa.string(), pa.string()), "ends": pa.int64()}

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for (subject, key), latest in every(batch):
                for part, (us, sums, lists, lasts, ends) in latest[0].items():
                    made.append((subject, key, part, us, list(sums.items()), [(n, list(c.items())) for n, c in lists.items()], list(lasts.items()), ends))
                if len(made) >= TABLE_ROWS:
                    yield table(made)
                    made = []
            yield table(made)

    def every(batch: pa.RecordBatch) -> Iterator[tuple[tuple, tuple]]:
        for *key, held in zip(*batch.columns, strict=True):
            if key:
                yield tuple(k.as_py() for k in key), pickle.loads(held.as_py())
            else:
                yield from ((k, pickle.loads(v)[2]) for k, v in pickle.loads(held.as_py()).items())

    def table(made: list[tuple]) -> pa.RecordBatch:
        columns = zip(*made, strict=True) if made else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))

    return values.select(*(c for c in ("subject", "key") if c in values.columns), "held").mapInArrow(unfold, f"subject string, key string, {LATEST}")


class _Kept(NamedTuple):
    """What of a key is held as three values."""

    #: Of sliding windows: names of the sums, microseconds of a bucket, totals by buckets (buckets, sums) or few rows (None, None, us, no, values), few rows with texts (us, no, values by name; None: by buckets).
    sliding: list
    #: Of fixed windows: start and sums by part; start, counts of texts and last text by name.
    fixed: tuple[dict[str, tuple], dict[str, tuple]]
    #: For good: the latest answers by part; the last texts ever by name.
    latest: tuple[dict[str, tuple], dict[str, tuple]]


def _texts(value: object) -> list[str]:
    """The texts of a row's array, none if it is null."""
    return list(value) if isinstance(value, (list, np.ndarray)) else []


def _plain(column: pd.Series) -> list:
    """A column's values, None where it has none; arrays as lists."""
    return [list(v) if isinstance(v, (list, np.ndarray)) else None if pd.isna(v) else v for v in column.tolist()]


def _latest_text(values: list) -> np.ndarray:
    """The place of the last text up to each value, -1 where there is none."""
    return np.maximum.accumulate(np.where([isinstance(v, str) for v in values], np.arange(len(values)), -1)) if values else np.zeros(0, np.int64)


def _spread(counts: dict[str, int]) -> list[str]:
    """The sorted list that has these counts of texts."""
    return [t for t in sorted(counts) for _ in range(counts[t])]


class _Texts(NamedTuple):
    """The rows of a bucket, in order."""

    us: list[int]
    no: list[int]
    values: dict[str, list]
    #: For last values, the place of the last text up to each row.
    last: dict[str, np.ndarray]


def unpacked(out: DataFrame, longs: list[str], fields: list[str]) -> DataFrame:
    """The rows of ``Records`` with the columns ``longs`` in place of the bytes that hold them. fields: their order."""
    kinds = {f.name: f for f in out.schema.fields} | {n: T.StructField(n, T.LongType()) for n in longs}
    width, marks = len(longs), (len(longs) + 7) // 8

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = np.frombuffer(b"".join(batch.column("_sums").to_pylist()), np.uint8).reshape(batch.num_rows, marks + 8 * width)
            known = np.unpackbits(held[:, :marks], axis=1)[:, :width].astype(bool)
            values = np.ascontiguousarray(held[:, marks:]).view(np.int64)
            made = {n: pa.array(np.ascontiguousarray(values[:, i]), mask=~known[:, i]) for i, n in enumerate(longs)}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n in fields], fields)

    return out.mapInArrow(unpack, T.StructType([kinds[n] for n in fields]))


class Records(StatefulProcessor):
    """For each row the sums of its key's windows after it: columns ``sum_part``; those of other kinds of keys are null. They come as the bytes that ``unpacked`` reads,
    as the sums that a row adds come as one array ``_sums``, since Spark makes each value of a row by itself in Python.

    specs: windows by the first column of the key ("": of all keys). keys, payload: columns that are handed on. sums: long columns.
    lists, lasts: columns of texts (arrays), or of one text, by the part they belong to; they come out as the sorted list, or the last one, of the values in its window.
    idle_ms: in arrival order, the time without a row after which a key's windows leave the state (None: never).
    peers: a row's sliding windows hold all rows of its time that have come up to its micro-batch, not only those up to its number.

    In arrival order rows come as ``packed`` makes them, and go as ``spread`` reads them.

    A key's state names the sums that it holds. Where a job goes on with other rules, the state of a key is put in the new
    order when the key has its next row: sums of the same name go on, new ones begin.
    """

    def __init__(self, specs: dict[str, Spec], keys: list[str], payload: list[str], sums: list[str], event_time: bool, lists: dict[str, str] | None = None, lasts: dict[str, str] | None = None, idle_ms: int | None = None, peers: bool = False):
        self.specs, self.keys, self.payload, self.every, self.event_time = specs, keys, payload, sums, event_time
        self.lists, self.lasts, self.idle_ms, self.peers = lists or {}, lasts or {}, idle_ms, peers
        self.parts = list(dict.fromkeys(p for spec in specs.values() for p in spec.parts))
        self.openings = list(dict.fromkeys(p for spec in specs.values() for p in spec.fixed))
        self.row = Row(*keys, *payload, "_sums", *self.lists, *self.lasts) if event_time else Row("_rows")

    @property
    def longs(self) -> list[str]:
        """The columns of a row's bytes."""
        return [f"{n}_{p}" for p in self.parts for n in self.every] + [f"start_{p}" for p in self.openings]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "held binary")
        self.fixed = handle.getValueState("fixed", "held binary")
        self.latest = handle.getValueState("latest", "held binary")
        self.rows = handle.getMapState("rows", "bucket long", "us binary, no binary, values binary")
        self.texts = handle.getMapState("texts", "bucket long", "rows binary")
        self.summaries = handle.getMapState("summaries", "bucket long", "counts map<string,map<string,long>>, lasts map<string,string>")
        self.waiting = handle.getListState("waiting", "rows binary")
        self.timer = handle.getValueState("timer", "ms long")

    def _spec(self, key: tuple) -> Spec:
        """The windows of a key; what follows counts its sums."""
        spec = self.specs.get("", None) or self.specs.get(key[0], Spec({}, {}, None))
        self.sums = list(spec.sums or self.every)
        return spec

    def _begin(self, spec: Spec) -> None:
        """Read a key's three values; ``known``: it has had rows."""
        read = lambda state: pickle.loads(state.get()[0]) if state.exists() else None
        latest = read(self.latest)
        self._take(spec, *((read(self.totals), read(self.fixed)) if latest is not None else (None, None)), latest)

    def _take(self, spec: Spec, sliding: list | None, fixed: tuple | None, latest: tuple | None) -> None:
        self.known = latest is not None
        few = (None, None, b"", b"", b"")
        self.kept = _Kept(sliding or [self.sums, spec.span, few, ([], [], {})], fixed or ({}, {}), latest or ({}, {}))
        if sliding is not None and (sliding[:2] != [self.sums, spec.span] or not spec.sliding):
            self._arrange(spec)

    def _end(self, spec: Spec) -> None:
        for state, held, has in ((self.totals, self.kept.sliding, spec.sliding), (self.fixed, self.kept.fixed, spec.fixed), (self.latest, self.kept.latest, spec.parts or self.known)):
            if has:
                state.update((pickle.dumps(held, 5),))

    def _arrange(self, spec: Spec) -> None:
        """Put the sliding windows that other rules have left in the order of these."""
        held = self.kept.sliding[:]
        names = list(held[0])
        known = [(i, names.index(n)) for i, n in enumerate(self.sums) if n in names]

        def moved(values: np.ndarray) -> np.ndarray:
            out = np.zeros((*values.shape[:-1], len(self.sums)), np.int64)
            for new, old in known:
                out[..., new] = values[..., old]
            return out

        kept = [v for _, v in self.rows.iterator()]
        if held[2][2] is not None:
            kept.append(held[2][2:])
        rows = [(np.frombuffer(u, np.int64), np.frombuffer(k, np.int64), moved(np.frombuffer(v, np.int64).reshape(-1, len(names)))) for u, k, v in kept]
        texts = [pa.ipc.open_stream(r[0]).read_pandas() for _, r in self.texts.iterator()]
        for state in (self.rows, self.totals, self.texts, self.summaries):
            state.clear()
        self.kept.sliding[:] = [self.sums, spec.span, (None, None, b"", b"", b""), held[3] if held[3] is not None and spec.sliding else ([], [], {})]
        if rows and spec.sliding:
            us, no, values = (np.concatenate(x) for x in zip(*rows, strict=True))
            order = np.lexsort((no, us))
            self._store(us[order], no[order], values[order], spec.span)
        if texts and spec.sliding:
            self.kept.sliding[3] = None
            every = pd.concat(texts, ignore_index=True).sort_values(["us", "no"], kind="stable")
            for b, own in every.groupby(every["us"] // spec.span):
                self._keep(int(b), own["us"].tolist(), own["no"].tolist(), {n: _plain(own[n]) for n in (*self.lists, *self.lasts) if n in own})

    # Sliding windows.

    def _load(self, bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        us, no, values = self.rows.getValue((bucket,))
        return np.frombuffer(us, np.int64), np.frombuffer(no, np.int64), np.frombuffer(values, np.int64).reshape(-1, len(self.sums))

    def _store(self, us: np.ndarray, no: np.ndarray, values: np.ndarray, span: int) -> None:
        """Write all live rows of a key, which are in order: as one value if they are few, else by buckets."""
        if len(us) * 8 * (2 + len(self.sums)) <= FEW_BYTES:
            self.kept.sliding[2] = (None, None, us.tobytes(), no.tobytes(), np.ascontiguousarray(values).tobytes())
            return
        known, first = np.unique(us // span, return_index=True)
        for b, i, j in zip(known.tolist(), first.tolist(), [*first[1:].tolist(), len(us)], strict=True):
            self.rows.updateValue((b,), (us[i:j].tobytes(), no[i:j].tobytes(), np.ascontiguousarray(values[i:j]).tobytes()))
        self.kept.sliding[2] = (known.tobytes(), np.ascontiguousarray(np.add.reduceat(values, first, axis=0)).tobytes(), None, None, None)

    def _sliding(self, spec: Spec, us: np.ndarray, no: np.ndarray, values: np.ndarray) -> dict[str, np.ndarray]:
        held = self.kept.sliding[2]
        if held[2] is None:
            known = np.frombuffer(held[0], np.int64).tolist()
            return self._sliding_by_buckets(spec, us, no, values, dict(zip(known, np.frombuffer(held[1], np.int64).reshape(len(known), -1), strict=True)))
        before = np.frombuffer(held[2], np.int64)
        newest = int(before.max()) // spec.span * spec.span if len(before) else 0
        if len(before):
            every, numbers, all_values = np.append(before, us), np.append(np.frombuffer(held[3], np.int64), no), np.concatenate([np.frombuffer(held[4], np.int64).reshape(len(before), -1), values])
            order = np.lexsort((numbers, every))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            every, numbers, all_values, at = every[order], numbers[order], all_values[order], place[len(before) :]
        else:
            every, numbers, all_values, at = us, no, values, np.arange(len(us))
        running = np.concatenate([np.zeros((1, len(self.sums)), np.int64), np.cumsum(all_values, axis=0)])
        upto = running[np.searchsorted(every, us, "right") if self.peers else at + 1]
        out = {part: upto - running[np.searchsorted(every, us - ms * 1000, "left")] for part, ms in spec.sliding.items()}
        gone = (max(int(us.max()), newest) - max(spec.sliding.values()) * 1000) // spec.span  # buckets before it are in no window to come
        live = int(np.searchsorted(every, gone * spec.span, "left"))
        self._store(every[live:], numbers[live:], all_values[live:], spec.span)
        return out

    def _sliding_by_buckets(self, spec: Spec, us: np.ndarray, no: np.ndarray, values: np.ndarray, totals: dict[int, np.ndarray]) -> dict[str, np.ndarray]:
        longest = max(spec.sliding.values()) * 1000
        span = spec.span
        stored, none = set(totals), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(self.sums)), np.int64))
        own = us // span
        edges = {int(b) for ms in spec.sliding.values() for b in np.unique((us - ms * 1000) // span)} & stored
        fresh = {int(b) for b in np.unique(own)}
        gone = (max(int(us.max()), max(stored | fresh) * span) - longest) // span  # buckets before it are in no window to come
        held_us, held_values, at, begins, size = [], [], np.empty(len(us), np.int64), {}, 0
        for b in sorted(edges | fresh):
            u, k, v = self._load(b) if b in stored else none
            if b in fresh:
                mine = own == b
                u, k, v = np.append(u, us[mine]), np.append(k, no[mine]), np.concatenate([v, values[mine]])
                order = np.lexsort((k, u))
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                u, k, v = u[order], k[order], v[order]
                at[mine] = size + (np.searchsorted(u, us[mine], "right") - 1 if self.peers else place[len(order) - mine.sum() :])
                totals[b] = v.sum(axis=0)
                if b >= gone:
                    self.rows.updateValue((b,), (u.tobytes(), k.tobytes(), np.ascontiguousarray(v).tobytes()))
            begins[b] = size
            size += len(u)
            held_us.append(u)
            held_values.append(v)
        every = np.concatenate(held_us)
        running = np.concatenate([np.zeros((1, len(self.sums)), np.int64), np.cumsum(np.concatenate(held_values), axis=0)])
        known = np.array(sorted(totals), np.int64)
        each = np.array([totals[b] for b in known.tolist()], np.int64)
        before = np.concatenate([np.zeros((1, len(self.sums)), np.int64), np.cumsum(each, axis=0)])
        start = lambda b: np.array([begins.get(int(x), -1) for x in b], np.int64)
        upto = before[np.searchsorted(known, own)] + running[at + 1] - running[start(own)]
        out = {}
        for part, ms in spec.sliding.items():
            edge = us - ms * 1000
            bucket = edge // span
            first = start(bucket)
            inside = np.where(first >= 0, np.searchsorted(every, edge, "left"), 0)
            out[part] = upto - before[np.searchsorted(known, bucket)] - (running[inside] - running[np.maximum(first, 0)])
        live = known >= gone
        self.kept.sliding[2] = (known[live].tobytes(), np.ascontiguousarray(each[live]).tobytes(), None, None, None)
        for b in stored:
            if b < gone:
                self.rows.removeKey((b,))
        return out

    # Lists and last values.

    def _keep(self, bucket: int, us: list[int], no: list[int], values: dict[str, list]) -> tuple[dict, dict]:
        """Write a bucket's rows, which are in order, and its summary, which is given back."""
        kinds = {n: pa.list_(pa.string()) if n in self.lists else pa.string() for n in values}
        batch = pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(no, pa.int64()), *(pa.array(v, kinds[n]) for n, v in values.items())], ["us", "no", *values])
        out = io.BytesIO()
        with pa.ipc.new_stream(out, batch.schema) as writer:
            writer.write_batch(batch)
        held = self._summary(values)
        self.texts.updateValue((bucket,), (out.getvalue(),))
        self.summaries.updateValue((bucket,), held)
        return held

    def _summary(self, values: dict[str, list]) -> tuple[dict, dict]:
        counts, lasts = {}, {}
        for n, held in values.items():
            if n in self.lists:
                counts[n] = dict(Counter(t for v in held if v is not None for t in v))
            else:
                lasts[n] = next((v for v in reversed(held) if v is not None), None)
        return counts, lasts

    def _held(self, spec: Spec, names: list[str], us: np.ndarray, no: np.ndarray, fresh: dict[str, list]) -> dict[str, list]:
        """Lists and last values of sliding windows at each row. fresh: the rows' texts by name, without NaN."""
        if self.kept.sliding[3] is not None:
            return self._held_few(spec, names, us, no, fresh, *self.kept.sliding[3])
        span = spec.span
        summaries = {k[0]: tuple(v) for k, v in self.summaries.iterator()} if self.known else {}
        known = set(summaries)
        own, edges = us // span, {n: us - spec.sliding[self.lists.get(n) or self.lasts[n]] * 1000 for n in names}
        gone = (max(int(us.max()), max(known, default=0) * span) - max(spec.sliding.values()) * 1000) // span  # buckets before it are in no window to come
        times, numbers, buckets = us.tolist(), no.tolist(), own.tolist()
        coming: dict[int, list[int]] = {}
        for i, b in enumerate(buckets):
            if any(fresh[n][i] is not None for n in names):
                coming.setdefault(b, []).append(i)
        near: dict[int, _Texts] = {}
        for b in sorted(({int(x) for e in edges.values() for x in np.unique(e // span)} | set(buckets)) & known | set(coming)):
            at = coming.get(b, [])
            u, k, values = [times[i] for i in at], [numbers[i] for i in at], {n: [fresh[n][i] for i in at] for n in names}
            if b in known:
                held = pa.ipc.open_stream(self.texts.getValue((b,))[0]).read_all().to_pydict()
                before = len(held["us"])
                u, k = held["us"] + u, held["no"] + k
                values = {n: held.get(n, [None] * before) + v for n, v in values.items()}
                if at:
                    order = sorted(range(len(u)), key=lambda i: (u[i], k[i]))  # noqa: B023
                    u, k, values = [u[i] for i in order], [k[i] for i in order], {n: [v[i] for i in order] for n, v in values.items()}
            if at:
                summaries[b] = self._keep(b, u, k, values) if b >= gone else self._summary(values)
            near[b] = _Texts(u, k, values, {n: _latest_text(values[n]) for n in names if n in self.lasts})
        for b in known:
            if b < gone:
                self.summaries.removeKey((b,))
                self.texts.removeKey((b,))
        none = _Texts([], [], {n: [] for n in names}, {n: np.zeros(0, np.int64) for n in names})
        every = sorted(summaries)
        out = {}
        for n in names:
            out[n], between, inner = [], None, None
            for t, number, edge, b in zip(times, numbers, edges[n].tolist(), buckets, strict=True):
                first, end, begin = edge // span, near.get(b, none), near.get(edge // span, none)
                upto, start = bisect_right(end.us, t), bisect_left(begin.us, edge)
                if not self.peers:
                    upto = bisect_right(end.no, number, bisect_left(end.us, t), upto)
                inside = bisect_right(every, first), bisect_left(every, b)
                if inside != between:
                    between = inside
                    if n in self.lists:
                        sums: dict[str, int] = {}
                        for x in every[slice(*inside)]:
                            for text, count in summaries[x][0].get(n, {}).items():
                                sums[text] = sums.get(text, 0) + count
                        inner = _spread(sums)
                    else:
                        inner = next((v for x in reversed(every[slice(*inside)]) if (v := summaries[x][1].get(n)) is not None), None)
                if n in self.lists:
                    ends = end.values[n][start:upto] if first == b else begin.values[n][start:] + end.values[n][:upto]
                    out[n].append(sorted(inner + [t for v in ends if v is not None for t in v]))
                    continue
                found = end.last[n][upto - 1] if upto else -1
                if found >= (start if first == b else 0):
                    out[n].append(end.values[n][found])
                elif inner is not None or first == b or not len(begin.us) or begin.last[n][-1] < start:
                    out[n].append(inner)
                else:
                    out[n].append(begin.values[n][begin.last[n][-1]])
        return out

    def _held_few(self, spec: Spec, names: list[str], us: np.ndarray, no: np.ndarray, fresh: dict[str, list], held_us: list[int], held_no: list[int], held: dict[str, list]) -> dict[str, list]:
        """The same while all live texts are held as one value: windows move over the rows in order."""
        mine = [i for i in range(len(us)) if any(fresh[n][i] is not None for n in names)]
        every, numbers = np.append(np.array(held_us, np.int64), us[mine]), np.append(np.array(held_no, np.int64), no[mine])
        order = np.lexsort((numbers, every))
        every, numbers, places = every[order], numbers[order], order.tolist()
        if self.peers:
            upto = np.searchsorted(every, us, "right")
        else:
            at = list(zip(every.tolist(), numbers.tolist(), strict=True))
            upto = np.array([bisect_right(at, x) for x in zip(us.tolist(), no.tolist(), strict=True)], np.int64)
        out, values = {}, {}
        for n in names:
            both = held.get(n, [None] * len(held_us)) + [fresh[n][i] for i in mine]
            values[n] = both = [both[i] for i in places]
            start = np.searchsorted(every, us - spec.sliding[self.lists.get(n) or self.lasts[n]] * 1000, "left")
            if n in self.lasts:
                found = np.append(_latest_text(both), -1)[upto - 1]
                out[n] = [both[i] if i >= first else None for i, first in zip(found.tolist(), start.tolist(), strict=True)]
                continue
            out[n], inside, begin, end = [], [], 0, 0
            for first, last in zip(start.tolist(), upto.tolist(), strict=True):
                for v in both[end:last]:
                    for t in v or ():
                        insort(inside, t)
                for v in both[begin:first]:
                    for t in v or ():
                        del inside[bisect_left(inside, t)]
                begin, end = first, last
                out[n].append(inside[:])
        span = spec.span
        newest = max(held_us) // span * span if held_us else 0
        gone = (max(int(us.max()), newest) - max(spec.sliding.values()) * 1000) // span
        live = int(np.searchsorted(every, gone * span, "left"))
        every, numbers, values = every[live:].tolist(), numbers[live:].tolist(), {n: v[live:] for n, v in values.items()}
        few = self._few(values, len(every))
        self.kept.sliding[3] = (every, numbers, values) if few else None
        if not few:
            buckets = np.array(every, np.int64) // span
            known, begins = np.unique(buckets, return_index=True)
            for b, i, j in zip(known.tolist(), begins.tolist(), [*begins[1:].tolist(), len(every)], strict=True):
                self._keep(b, every[i:j], numbers[i:j], {n: v[i:j] for n, v in values.items()})
        return out

    def _few(self, values: dict[str, list], size: int) -> bool:
        """Are texts few enough to be held as one value?"""
        return size <= FEW_TEXTS

    def _held_in_open(self, name: str, starts: np.ndarray, values: list) -> list:
        """The list or last value of a fixed window at each row. starts: of its windows."""
        start, counts, last = self.kept.fixed[1].get(name, (None, {}, None))
        texts, out = _spread(counts or {}), []
        for now, v in zip(starts.tolist(), values, strict=True):
            if now != start:
                start, texts, last = now, [], None
            if name in self.lists:
                for t in _texts(v):
                    insort(texts, t)
            elif isinstance(v, str):
                last = v
            out.append(list(texts) if name in self.lists else last)
        self.kept.fixed[1][name] = (int(start), dict(Counter(texts)), last)
        return out

    def _last_ever(self, name: str, us: np.ndarray, no: np.ndarray, values: list) -> list:
        """The text of the latest row so far that brought one, at each row."""
        *at, value = self.kept.latest[1].get(name, (-(2**63), -(2**63), None))
        after = (us > at[0]) | (us == at[0]) & (no >= at[1])
        found = _latest_text([v if later else None for v, later in zip(values, after, strict=True)])
        if len(found) and found[-1] >= 0:
            self.kept.latest[1][name] = (int(us[found[-1]]), int(no[found[-1]]), values[found[-1]])
        return [values[i] if i >= 0 else value for i in found]

    def _fixed(self, part: str, ms: int, us: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, sums) of the window at each row: rows up to the end of the open one go on with its sums; then windows follow one another."""
        start, held = self.kept.fixed[0].get(part, (None, {}))
        running = np.concatenate([np.zeros((1, len(self.sums)), np.int64), np.cumsum(values, axis=0)])
        at = 0 if start is None else int(np.searchsorted(us, start + ms * 1000, "right"))
        opens = [] if at == 0 else [(0, start)]
        sums = np.array([held.get(n, 0) for n in self.sums], np.int64)
        while at < len(us):
            opens.append((at, int(us[at])))
            at = int(np.searchsorted(us, us[at] + ms * 1000, "right"))
        first, begins = (np.array(x, np.int64) for x in zip(*opens, strict=True))
        own = np.searchsorted(first, np.arange(len(us)), "right") - 1
        out = running[1:] - running[first[own]]
        if start is not None and opens[0][1] == start:
            out[own == 0] += sums
        self.kept.fixed[0][part] = (int(begins[-1]), dict(zip(self.sums, out[-1].tolist(), strict=True)))
        return begins[own], out

    def _step(self, key: tuple, us: np.ndarray, no: np.ndarray, values: np.ndarray, fresh: dict[str, list]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], dict[str, list]]:
        """Take rows of a key, which are in order, into its state: (sums by part, starts of fixed windows by part, texts by name). values: what rows add to all sums."""
        spec = self._spec(key)
        self._begin(spec)
        values = values if self.sums == self.every else values[:, [self.every.index(n) for n in self.sums]]
        found = self._sliding(spec, us, no, values) if spec.sliding else {}
        starts = {}
        for part, ms in spec.fixed.items():
            starts[part], found[part] = self._fixed(part, ms, us, values)
        latest = self.kept.latest[0]
        if spec.unbounded:
            held = latest[spec.unbounded][1] if spec.unbounded in latest else {}
            found[spec.unbounded] = np.array([held.get(n, 0) for n in self.sums], np.int64) + np.cumsum(values, axis=0)
        names = [n for n, p in (self.lists | self.lasts).items() if p in spec.sliding]
        texts = self._held(spec, names, us, no, fresh) if names else {}
        texts |= {n: self._last_ever(n, us, no, fresh[n]) for n, p in self.lasts.items() if p == spec.unbounded}
        texts |= {n: self._held_in_open(n, starts[p], fresh[n]) for n, p in (self.lists | self.lasts).items() if p in spec.fixed}
        for part in spec.parts:
            if part == spec.unbounded or part not in latest or latest[part][0] <= us[-1]:
                now = [{n: dict(Counter(texts[n][-1])) for n, p in self.lists.items() if p == part}, {n: texts[n][-1] for n, p in self.lasts.items() if p == part}]
                end = int(starts[part][-1]) + spec.fixed[part] * 1000 if part in spec.fixed else None
                latest[part] = (int(us[-1]), dict(zip(self.sums, found[part][-1].tolist(), strict=True)), *now, end)
        self._end(spec)
        return found, starts, texts

    def _answers(self, key: tuple, fresh: pd.DataFrame) -> pd.DataFrame:
        """Rows of a key with what its state has after each."""
        fresh = fresh.sort_values(["us", "transaction_no"], kind="stable", na_position="first").reset_index(drop=True)
        us, no = fresh["us"].to_numpy(np.int64), fresh["transaction_no"].fillna(-1).to_numpy(np.int64)
        found, starts, texts = self._step(key, us, no, fresh[self.every].to_numpy(np.int64), {n: _plain(fresh[n]) for n in self.lists | self.lasts})
        out = {k: [v] * len(us) for k, v in zip(self.keys, key, strict=True)} | {c: _plain(fresh[c]) for c in self.payload}
        out["_sums"] = self._bytes(found, starts, len(us))
        return pd.DataFrame(out | {n: pd.Series(texts.get(n, [None] * len(us)), dtype=object) for n in self.lists | self.lasts})

    def _bytes(self, found: dict[str, np.ndarray], starts: dict[str, np.ndarray], size: int) -> list[bytes]:
        """For each row which of the long columns are there, and their values."""
        held, known, at = np.zeros((size, len(self.longs)), np.int64), np.zeros(len(self.longs), bool), 0
        own = [self.every.index(n) for n in self.sums]
        for part in self.parts:
            if part in found:
                held[:, [at + i for i in own]] = found[part]
                known[[at + i for i in own]] = True
            at += len(self.every)
        for i, part in enumerate(self.openings, at):
            if part in starts:
                held[:, i], known[i] = starts[part], True
        marks, values, width = np.packbits(known).tobytes(), held.tobytes(), 8 * held.shape[1]
        return [marks + values[i * width : (i + 1) * width] for i in range(size)]

    def _tables(self, key: tuple, fresh: pa.RecordBatch) -> Iterator[Row]:
        """The same from rows of a key as one table, to tables."""
        us, no = fresh.column("us").to_numpy(), fresh.column("transaction_no").fill_null(-1).to_numpy()
        order = np.lexsort((no, us))
        if (order[1:] < order[:-1]).any():
            us, no, fresh = us[order], no[order], fresh.take(pa.array(order))
        values = fresh.column("_sums").flatten().to_numpy().reshape(len(us), -1)
        found, starts, texts = self._step(key, us, no, values, {n: fresh.column(n).to_pylist() for n in self.lists | self.lasts})
        size = len(us)
        out = {c: fresh.column(c) for c in (*self.keys, *self.payload)}
        for part in self.parts:
            sums = {n: np.ascontiguousarray(found[part][:, i]) for i, n in enumerate(self.sums)} if part in found else {}
            out |= {f"{n}_{part}": pa.array(sums[n]) if n in sums else pa.nulls(size, pa.int64()) for n in self.every}
        out |= {f"start_{p}": pa.array(starts[p]) if p in starts else pa.nulls(size, pa.int64()) for p in self.openings}
        for n in self.lists | self.lasts:
            k = pa.list_(pa.string()) if n in self.lists else pa.string()
            out[n] = pa.array(texts[n], k) if n in texts else pa.nulls(size, k)
        whole = pa.RecordBatch.from_pydict(out)
        yield from (self.row(_table(whole.slice(i, TABLE_ROWS))) for i in range(0, size, TABLE_ROWS))

    def _rows(self, answers: pd.DataFrame) -> Iterator[Row]:
        yield from (self.row(*r) for r in zip(*(answers[c].tolist() for c in (*self.keys, *self.payload, "_sums", *self.lists, *self.lasts)), strict=True))

    # Time.

    def _remind(self, ms: int) -> None:
        """Make this the key's only timer."""
        if self.timer.exists() and (old := self.timer.get()[0]) != ms:
            self.handle.deleteTimer(old)
        elif self.timer.exists():
            return
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def _idle(self, key: tuple, fresh: pd.DataFrame) -> None:
        spec = self._spec(key)
        if windows := [*spec.sliding.values(), *spec.fixed.values()]:
            self._remind(int(fresh["us"].max()) // 1000 + max(windows) + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = list(rows)
        fields = rows[0].__fields__
        if not self.event_time:
            if self.idle_ms is not None:
                self._remind(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
            yield from self._tables(key, _whole([_read(r[fields.index("_rows")]) for r in rows]))
            return
        fresh = pd.DataFrame(rows, columns=fields)
        fresh = pd.concat([fresh.drop(columns="_sums"), pd.DataFrame(fresh["_sums"].tolist(), columns=self.every)], axis=1)
        self.waiting.appendValue((_packed(fresh),))
        due = int(fresh["us"].min()) // 1000 + 1
        # an earlier timer stays: it may be for rows that wait already
        if not self.timer.exists() or self.timer.get()[0] > due:
            self._remind(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.timer.clear()
        ready = pd.DataFrame()
        if self.event_time:
            limit = timerValues.getCurrentWatermarkInMs() * 1000
            held = [pa.ipc.open_stream(r[0]).read_pandas() for r in self.waiting.get()]
            waiting = pd.concat(held, ignore_index=True) if held else pd.DataFrame({"us": []})
            missing = [c for c in [*self.every, *self.lists, *self.lasts] if c not in waiting]  # of rules that are newer than the rows
            waiting = waiting.reindex(columns=[*waiting.columns, *missing]).fillna({n: 0 for n in self.every})
            ready, left = waiting[waiting["us"] <= limit], waiting[waiting["us"] > limit]
            if len(ready):
                self.waiting.clear()
                if len(left):
                    self.waiting.put([(_packed(left),)])
            if len(left):
                self._remind(int(left["us"].min()) // 1000 + 1)
            elif len(ready):
                self._idle(key, ready)
        if len(ready):
            yield from self._rows(self._answers(key, ready))
        elif not self.timer.exists():  # idle for its longest window, or for idle_ms: nothing in it any more, and the next row opens new fixed ones
            for held in (self.totals, self.rows, self.texts, self.summaries, self.fixed):
                held.clear()


class _Buckets:
    """A key's part of a map of the state that many keys share. known: its buckets."""

    def __init__(self, state: MapState | None, name: str, known: set[int]):
        self.state, self.name, self.known = state, name, known

    def getValue(self, bucket: tuple[int]) -> tuple:
        return self.state.getValue((self.name, *bucket))

    def updateValue(self, bucket: tuple[int], value: tuple) -> None:
        self.state.updateValue((self.name, *bucket), value)
        self.known.add(bucket[0])

    def removeKey(self, bucket: tuple[int]) -> None:
        self.state.removeKey((self.name, *bucket))
        self.known.discard(bucket[0])

    def iterator(self) -> Iterator[tuple[tuple[int], tuple]]:
        return (((b,), self.getValue((b,))) for b in sorted(self.known))

    def clear(self) -> None:
        for b in sorted(self.known):
            self.removeKey((b,))


class Shards(Records):
    """Records in arrival order without timers, for groups of keys: Spark groups rows by ``_shard``, and what few rows leave of all keys of a shard is one value.

    So a micro-batch costs two calls to the state for each shard and not several for each key; it reads and writes again the small values of the other
    keys of the shards that it touches, some hundred bytes to some kilobytes each. What of a key is held by buckets lies apart from them, by key and bucket.
    Keys are texts or whole numbers. wanted: the columns ``sum_part`` that are handed out.
    """

    wanted: frozenset[str] | None = None

    @property
    def longs(self) -> list[str]:
        return [c for c in super().longs if self.wanted is None or c in self.wanted or c.startswith("start_")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "held binary")
        self.maps = {"rows": handle.getMapState("rows", "name string, bucket long", "us binary, no binary, values binary"), "texts": handle.getMapState("texts", "name string, bucket long", "rows binary"), "summaries": handle.getMapState("summaries", "name string, bucket long", "counts map<string,map<string,long>>, lasts map<string,string>")}
        self.totals = _Buckets(None, "", set())  # a key's are in its shard's value

    def _begin(self, spec: Spec) -> None:
        held = self.shard.get(self.key)
        *kept, self.buckets = (None, None, None, {}) if held is None else pickle.loads(held)
        self.rows, self.texts, self.summaries = (_Buckets(state, repr(self.key), self.buckets.setdefault(n, set())) for n, state in self.maps.items())
        self._take(spec, *kept)

    def _end(self, spec: Spec) -> None:
        if spec.parts or self.known:
            self.shard[self.key] = pickle.dumps((self.kept.sliding if spec.sliding else None, self.kept.fixed, self.kept.latest, {n: b for n, b in self.buckets.items() if b}), 5)

    def _few(self, values: dict[str, list], size: int) -> bool:
        return size <= SHARD_TEXTS and sum(len(t) for v in values.values() for texts in v if texts for t in ([texts] if isinstance(texts, str) else texts) if t) <= SHARD_CHARACTERS

    def handleInputRows(self, shard, rows, timerValues) -> Iterator[Row]:
        held = self.latest.get()
        self.shard = pickle.loads(held[0]) if held else {}
        yield from self._keys(_whole([_read(r["_rows"]) for r in rows]))
        self.latest.update((pickle.dumps(self.shard, 5),))

    def _keys(self, fresh: pa.RecordBatch) -> Iterator[Row]:
        """Take the rows of a shard into the state of their keys, one key after the other."""
        us, no = fresh.column("us").to_numpy(), fresh.column("transaction_no").fill_null(-1).to_numpy()
        codes = [pc.dictionary_encode(fresh.column(k), null_encoding="encode").indices.to_numpy() for k in self.keys]
        order = np.lexsort((no, us, *reversed(codes)))  # keys of one kind lie together
        us, no, fresh, codes = us[order], no[order], fresh.take(pa.array(order)), [c[order] for c in codes]
        changed = np.any([c[1:] != c[:-1] for c in codes], axis=0)
        begins = [0, *(np.flatnonzero(changed) + 1).tolist()]
        values = fresh.column("_sums").flatten().to_numpy().reshape(len(us), -1)
        texts = {n: fresh.column(n).to_pylist() for n in self.lists | self.lasts}
        names = list(zip(*(fresh.column(k).take(pa.array(begins)).to_pylist() for k in self.keys), strict=True))
        done, first = [], 0
        for i, j, found in self._steps(names, [*begins, len(us)], us, no, values, texts):
            for b in range(i, j, TABLE_ROWS):
                e = min(b + TABLE_ROWS, j)
                done.append((self.sums, e - b, *({n: v[b - i : e - i] for n, v in kind.items()} for kind in found)))
                if e - first >= TABLE_ROWS:
                    yield self._built(fresh.slice(first, e - first), done)
                    done, first = [], e
        if done:
            yield self._built(fresh.slice(first), done)

    def _steps(self, names: list[tuple], cuts: list[int], us: np.ndarray, no: np.ndarray, values: np.ndarray, texts: dict[str, list]) -> Iterator[tuple[int, int, tuple]]:
        """(first row, end, what ``_step`` gives): keys of one kind in one step, as far as they have no texts and nothing by buckets; the others one by one. cuts: where keys begin, and the end."""
        at = 0
        while at < len(names):
            spec, end, states = self._spec(names[at]), at, []
            plain = spec.parts and not any(p in spec.parts for p in (self.lists | self.lasts).values())
            while plain and end < len(names) and ("" in self.specs or names[end][0] == names[at][0]):
                held = self.shard.get(names[end])
                state = (None, None, None, {}) if held is None else pickle.loads(held)
                sliding, _, _, buckets = state
                if buckets or sliding is not None and (not spec.sliding or sliding[:2] != [self.sums, spec.span]):
                    break
                states.append(state)
                end += 1
            i, j = cuts[at], cuts[end]
            found = self._step_of_many(spec, names[at:end], states, np.array(cuts[at : end + 1], np.int64) - i, us[i:j], no[i:j], values[i:j]) if end > at else None
            if found is not None:
                yield i, j, found
                at = end
                continue
            for k in range(at, max(end, at + 1)):
                i, j = cuts[k], cuts[k + 1]
                self.key = names[k]
                yield i, j, self._step(self.key, us[i:j], no[i:j], values[i:j], {n: t[i:j] for n, t in texts.items()})
            at = max(end, at + 1)

    def _step_of_many(self, spec: Spec, names: list[tuple], states: list[tuple], cuts: np.ndarray, us: np.ndarray, no: np.ndarray, values: np.ndarray) -> tuple[dict, dict, dict] | None:
        """``_step`` for the rows of many keys of one kind without texts, whose live rows are held in their shard; None if their times are too far apart to be put in one line."""
        sums = self.sums
        values = values if sums == self.every else values[:, [self.every.index(n) for n in sums]]
        rows = [(s[0][2][2:] if s[0] else (b"", b"", b"")) for s in states]
        old_us, old_no, old_values = (np.frombuffer(b"".join(r[x] for r in rows), np.int64) for x in range(3))
        low, high = int(min(us.min(), old_us.min(initial=us[0]))), int(max(us.max(), old_us.max(initial=us[0])))
        if (high - low + 2) * len(names) >= 1 << 62:
            return None
        first, last = cuts[:-1], cuts[1:] - 1
        group = np.repeat(np.arange(len(names)), np.diff(cuts))
        running = np.concatenate([np.zeros((1, len(sums)), np.int64), np.cumsum(values, axis=0)])
        of_state = lambda held: np.array([[h.get(n, 0) for n in sums] for h in held], np.int64).reshape(len(names), len(sums))
        latest = [s[2] or ({}, {}) for s in states]
        fixed = [s[1] or ({}, {}) for s in states]
        found, starts, sliding = {}, {}, [None] * len(names)
        if spec.sliding:
            # the rows of all keys on one line, those of a key in their order
            n_old = np.array([len(r[0]) // 8 for r in rows], np.int64)
            whose = np.concatenate([np.repeat(np.arange(len(names)), n_old), group])
            every, numbers, all_values = np.append(old_us, us), np.append(old_no, no), np.concatenate([old_values.reshape(len(old_us), len(sums)), values])
            order = np.lexsort((numbers, every, whose))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            every, numbers, all_values, at = every[order], numbers[order], all_values[order], place[len(old_us) :]
            room = high - low + 2
            line = whose[order] * room + (every - low)
            on_line = lambda g, t: g * room + np.clip(t - low, 0, room - 1)
            summed = np.concatenate([np.zeros((1, len(sums)), np.int64), np.cumsum(all_values, axis=0)])
            upto = summed[np.searchsorted(line, on_line(group, us), "right") if self.peers else at + 1]
            found = {part: upto - summed[np.searchsorted(line, on_line(group, us - ms * 1000), "left")] for part, ms in spec.sliding.items()}
            newest = us[last]
            known = n_old > 0
            newest[known] = np.maximum(newest[known], old_us[np.cumsum(n_old)[known] - 1] // spec.span * spec.span)
            gone = (newest - max(spec.sliding.values()) * 1000) // spec.span  # buckets before it are in no window to come
            live = np.searchsorted(line, on_line(np.arange(len(names)), gone * spec.span), "left").tolist()
            ends = np.cumsum(n_old + np.diff(cuts)).tolist()
            for k, (name, state, i, j) in enumerate(zip(names, states, live, ends, strict=True)):
                sliding[k] = [sums, spec.span, (None, None, b"", b"", b""), state[0][3] if state[0] else ([], [], {})]
                self.kept = _Kept(sliding[k], fixed[k], latest[k])
                self.rows = _Buckets(self.maps["rows"], repr(name), state[3].setdefault("rows", set()))
                self._store(every[i:j], numbers[i:j], all_values[i:j], spec.span)
        for part, ms in spec.fixed.items():
            held = [f[0].get(part) for f in fixed]
            known = np.array([h is not None for h in held])
            open_at = np.array([h[0] if h else 0 for h in held], np.int64)
            begin = _placed(us, group, open_at + ms * 1000, known, ms * 1000)
            opens = np.append(True, (begin[1:] != begin[:-1]) | (group[1:] != group[:-1]))
            out = running[1:] - running[np.maximum.accumulate(np.where(opens, np.arange(len(us)), 0))]
            goes_on = known[group] & (begin == open_at[group])
            out[goes_on] += of_state([h[1] if h else {} for h in held])[group[goes_on]]
            found[part], starts[part] = out, begin
            for f, start, own in zip(fixed, begin[last].tolist(), out[last].tolist(), strict=True):
                f[0][part] = (start, dict(zip(sums, own, strict=True)))
        if spec.unbounded:
            before = of_state([x[0][spec.unbounded][1] if spec.unbounded in x[0] else {} for x in latest])
            found[spec.unbounded] = (before - running[first])[group] + running[1:]
        at_end = us[last].tolist()
        for part in spec.parts:
            ends = (starts[part][last] + spec.fixed[part] * 1000).tolist() if part in spec.fixed else [None] * len(names)
            for (own, _), t, held, end in zip(latest, at_end, found[part][last].tolist(), ends, strict=True):
                if part == spec.unbounded or part not in own or own[part][0] <= t:
                    own[part] = (t, dict(zip(sums, held, strict=True)), {}, {}, end)
        for name, slid, f, x, state in zip(names, sliding, fixed, latest, states, strict=True):
            self.shard[name] = pickle.dumps((slid, f, x, {n: b for n, b in state[3].items() if b}), 5)
        return found, starts, {}

    def _built(self, rows: pa.RecordBatch, done: list[tuple]) -> Row:
        """The answers to rows. done: for each of their keys the names of its sums, its rows, and what ``_step`` gave."""
        size, at, place = rows.num_rows, 0, {c: i for i, c in enumerate(self.longs)}
        held, known = np.zeros((len(place), size), np.int64), np.zeros((len(place), size), bool)
        texts = {n: [] for n in self.lists | self.lasts}
        columns: dict[tuple, tuple] = {}
        for sums, n_rows, found, starts, held_texts in done:
            for p, v in found.items():
                if (p, *sums) not in columns:
                    here = [(place[c], i) for i, n in enumerate(sums) if (c := f"{n}_{p}") in place]
                    columns[p, *sums] = [x for x, _ in here], [i for _, i in here]
                to, of = columns[p, *sums]
                held[to, at : at + n_rows] = v.T[of]
                known[to, at : at + n_rows] = True
            for p, v in starts.items():
                held[place[f"start_{p}"], at : at + n_rows] = v
                known[place[f"start_{p}"], at : at + n_rows] = True
            for n, v in texts.items():
                v += held_texts.get(n) or [None] * n_rows
            at += n_rows
        out = {c: rows.column(c) for c in (*self.keys, *self.payload)} | {n: pa.array(v, mask=~k) for n, v, k in zip(place, held, known, strict=True)}
        return self.row(_table(pa.RecordBatch.from_pydict(out | {n: pa.array(v, pa.list_(pa.string()) if n in self.lists else pa.string()) for n, v in texts.items()})))
