"""Keys that share a value of the state: the same answers as a state for each key, by fewer calls."""

import random

import pyarrow as pa
import pytest

from tallyframe.operators import rules as R
from tallyframe.streaming import jobs
from tallyframe.streaming.processors import Records, Shards, Spec, _read, _table

from .test_operators import stream

S = 1_000_000
OLD, NEW = Spec({"long": 64_000, "short": 1_500}, {"f": 9_000}, "ever", ("n", "a")), Spec({"long": 64_000, "new": 5_000}, {"f": 9_000}, "ever", ("a", "n", "b"))
LISTS, LASTS = {"l": "long", "lf": "f"}, {"v": "long", "e": "ever"}


class Held:
    def __init__(self, calls, name):
        self.held, self.calls, self.name = {}, calls, name

    def _call(self, value=None):
        self.calls.append(self.name)
        return value

    def exists(self):
        return self._call(() in self.held)

    def get(self):
        return self._call(self.held.get(()))

    def update(self, value):
        self.held[()] = self._call(value)

    def getValue(self, key):
        return self._call(self.held[key])

    def updateValue(self, key, value):
        self.held[key] = self._call(value)

    def removeKey(self, key):
        self._call(self.held.pop(key, None))

    def iterator(self):
        return iter(self._call(list(self.held.items())))

    def clear(self):
        self._call(self.held.clear())


class Handle:
    """The state of one group; a processor that is made anew finds it again."""

    def __init__(self):
        self.calls, self.states = [], {}

    def getMapState(self, name, *_):
        return self.states.setdefault(name, Held(self.calls, name))

    getListState = getValueState = getMapState


def table(rows, names):
    """rows: (subject, key, number, us, text or None)."""
    every = {"subject": [x[0] for x in rows], "key": [x[1] for x in rows], "transaction_no": pa.array([x[2] for x in rows], pa.int64()), "us": pa.array([x[3] for x in rows], pa.int64())}
    sums = pa.array([[{"n": 1, "a": x[2] % 7, "b": x[2]}[n] for n in names] for x in rows], pa.list_(pa.int64()))
    texts = [x[4] for x in rows]
    lists = pa.array([None if t is None else t.split() for t in texts], pa.list_(pa.string()))
    return pa.RecordBatch.from_pydict(every | {"_sums": sums} | {n: lists for n in LISTS} | {n: pa.array(texts, pa.string()) for n in LASTS})


def answers(made, handle, key, rows):
    made.init(handle)
    out = [_read(r["_rows"]).to_pylist() for r in made.handleInputRows(key, iter([_Row(_table(table(rows, made.every)))]), None)]
    return {(r["subject"], r["key"], r["transaction_no"]): r for t in out for r in t}


class _Row(tuple):
    __fields__ = ["_rows"]

    def __new__(cls, value):
        return super().__new__(cls, (value,))

    def __getitem__(self, name):
        return super().__getitem__(0 if name == "_rows" else name)


def both(spec, names):
    specs = {"card": spec, "shop": Spec({"short": 1_500}, {}, None, ("n",))}
    return [kind(specs, ["subject", "key"], ["transaction_no", "us"], names, False, LISTS, LASTS) for kind in (Shards, Records)]


@pytest.mark.parametrize("seed", range(4))
def test_keys_of_a_shard_have_the_answers_of_keys_by_themselves(seed):
    """Keys with few rows and with many, which are held by buckets; after a while by other rules."""
    r = random.Random(seed)
    (shards, alone), names, number = both(OLD, ["n", "a"]), ["n", "a"], 0
    one, each = Handle(), {}
    for step in range(24):
        if step == 12:
            shards, alone = both(NEW, ["a", "n", "b"])
        rows = []
        for k in ("a", "b", None, "many", "ä|1"):
            for subject in ("card", "shop"):
                for _ in range(r.randint(0, 60 if k == "many" else 3)):
                    number += 1
                    rows.append((subject, k, number, max(0, step * 5 * S + r.randint(-20, 9) * S // r.choice([1, 2])), r.choice([None, "a b", "b", "c a a", "", "z" * 200])))
        r.shuffle(rows)
        if not rows:
            continue
        got, want = answers(shards, one, (0,), rows), {}
        for key in {x[:2] for x in rows}:
            want |= answers(alone, each.setdefault(key, Handle()), key, [x for x in rows if x[:2] == key])
        assert got == want
    assert {k[0] for k in one.states["texts"].held} == {repr(("card", "many"))}
    assert one.states["rows"].held


@pytest.mark.parametrize(("seed", "peers", "unit"), [(0, False, S), (1, True, S), (2, False, S), (3, True, 2 * 10**16)])
def test_keys_without_texts_take_one_step_with_the_answers_of_keys_by_themselves(seed, peers, unit, monkeypatch):
    """New and known keys, few rows and many (by buckets), late rows and ties, other rules after a while; with times that are far apart too. Before, each key took a step by itself."""
    r = random.Random(seed)
    made = lambda spec, names: [kind({"card": spec, "shop": Spec({"short": 1_500}, {}, None, ("n",)), "open": Spec({}, {"f": 9_000}, "ever")}, ["subject", "key"], ["transaction_no", "us"], names, False, peers=peers) for kind in (Shards, Records)]
    (shards, alone), number, alone_in_shard = made(OLD, ["n", "a"]), 0, []
    step_of_one = Shards._step
    monkeypatch.setattr(Shards, "_step", lambda self, key, *rest: (alone_in_shard.append(key), step_of_one(self, key, *rest))[1])
    one, each = Handle(), {}
    for step in range(20):
        if step == 10:
            shards, alone = made(NEW, ["a", "n", "b"])
            alone_in_shard.clear()
        rows = []
        for k in ("a", "b", None, "many", "c|1"):
            for subject in ("card", "shop", "open"):
                for _ in range(r.randint(0, 120 if k == "many" else 3)):
                    number += 1
                    rows.append((subject, k, number, max(0, step * 5 * unit + r.randint(-20, 9) * unit // r.choice([1, 2])), None))
        r.shuffle(rows)
        got, want = answers(shards, one, (0,), rows), {}
        for key in {x[:2] for x in rows}:
            want |= answers(alone, each.setdefault(key, Handle()), key, [x for x in rows if x[:2] == key])
        drop = lambda found: {k: {c: v for c, v in x.items() if c not in (*LISTS, *LASTS)} for k, x in found.items()}
        assert drop(got) == drop(want)
        if step < 2 and unit == S:
            assert not alone_in_shard
    if unit == S:
        assert one.states["rows"].held and ("open", "many") not in alone_in_shard


def test_a_shard_takes_two_calls_for_all_of_its_keys():
    """Before, a new key took four calls and a known one more."""
    (shards, _), handle = both(OLD, ["n", "a"]), Handle()
    for step in range(3):
        handle.calls.clear()
        found = answers(shards, handle, (0,), [("card", f"k{k}", step * 200 + k, step * S + k, "t") for k in range(200)])
        assert len(found) == 200 and {(r["n_ever"], len(r["l"])) for r in found.values()} == {(step + 1, step + 1)}
        assert len(handle.calls) == 2


def test_only_wanted_sums_come_out():
    (shards, _), handle = both(OLD, ["n", "a"]), Handle()
    shards.wanted = frozenset({"n_long", "a_ever"})
    (row,) = answers(shards, handle, (0,), [("card", "k", 5, S, "t")]).values()
    assert {c for c in row if c[:2] in ("n_", "a_")} == {"n_long", "a_ever"} and (row["n_long"], row["a_ever"], row["start_f"]) == (1, 5, S)


def test_rows_of_one_time_count_together_in_a_job(spark, tmp_path):
    rows = [(i, "c", "x", 1.0, S) for i in (1, 2, 3)]
    kept = [R.Rule("c", "COMPUTE", "Card", 10_000, record="tx")]
    job = jobs.Job(spark, f"file://{tmp_path}/job").start(stream(spark, tmp_path, [rows]), kept, lambda: [R.Rule("all", "ALERT", "Card", 10_000, condition_sql="tx.count = 3")], peers=True).wait()
    assert {r.transaction_no: r.alert_status for r in job.answers().collect()} == dict.fromkeys((1, 2, 3), "ALERT")
