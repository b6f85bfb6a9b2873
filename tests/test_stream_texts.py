"""Texts of stream windows: what a micro-batch reads of the state, and lists and last values against a plain recount."""

import random

import numpy as np
import pandas as pd
import pytest

from tallyframe.streaming.processors import Records, Spec

S = 1_000_000


def size(x):
    """Bytes of a value of the state, roughly."""
    if isinstance(x, dict):
        return sum(size(k) + size(v) for k, v in x.items())
    return sum(map(size, x)) if isinstance(x, (tuple, list)) else len(x) if isinstance(x, (bytes, str)) else 8


class Held:
    """A state variable in memory that counts the bytes read and written."""

    def __init__(self, counts):
        self.held, self.counts = {}, counts

    def _read(self, value):
        self.counts["read"] += size(value)
        return value

    def getValue(self, key):
        return self._read(self.held.get(key))

    def containsKey(self, key):
        return key in self.held

    def updateValue(self, key, value):
        self.counts["written"] += size(value)
        self.held[key] = value

    def removeKey(self, key):
        self.held.pop(key, None)

    def iterator(self):
        return iter([(k, self._read(v)) for k, v in self.held.items()])

    def clear(self):
        self.held.clear()

    def exists(self):
        return () in self.held

    def get(self):
        return self._read(self.held[()])

    def update(self, value):
        self.updateValue((), value)


class Handle:
    def __init__(self):
        self.counts = {"read": 0, "written": 0}

    def getMapState(self, *_):
        return Held(self.counts)

    getListState = getValueState = getMapState


def processor(spec, lists, lasts):
    made = Records({"": spec}, ["k"], ["transaction_no"], ["n"], False, lists, lasts)
    made.init(Handle())
    return made


def batch(rows):
    """rows: (number, us, text or None)."""
    texts = [x[2] for x in rows]
    return pd.DataFrame({"transaction_no": [x[0] for x in rows], "us": [x[1] for x in rows], "n": 1, "l": pd.Series([None if t is None else np.array(t.split(), object) for t in texts], dtype=object), "s": pd.Series([None if t is None else np.array([t], object) for t in texts], dtype=object), "v": pd.Series(texts, dtype=object)})


@pytest.mark.parametrize("seed", range(6))
def test_texts_equal_a_recount_with_late_rows_and_several_windows(seed):
    r = random.Random(seed)
    made = processor(Spec({"long": 64_000, "short": 1_500}, {}, "ever"), {"l": "long", "s": "short"}, {"v": "long"})
    seen, number, checked = [], 0, 0
    for step in range(25):
        rows = []
        for _ in range(r.randint(1, 12)):
            number += 1
            rows.append((number, max(0, step * 5 * S + r.randint(-20, 9) * S // r.choice([1, 2])), r.choice([None, "a b", "b", "c a a", "", "z"])))
        r.shuffle(rows)
        seen += rows
        latest = max(x[1] for x in seen)
        for got in made._answers(("k",), batch(rows)).itertuples():
            us = next(x[1] for x in seen if x[0] == got.transaction_no)

            def inside(ms, at=(us, got.transaction_no)):
                return sorted((x[1], x[0], x[2]) for x in seen if at[0] - ms * 1000 <= x[1] and (x[1], x[0]) <= at and x[2] is not None)

            assert got.s == sorted(x for *_, x in inside(1_500))
            if us == latest or latest < 64 * S:  # nothing of its long window has left the state
                checked += 1
                assert got.l == sorted(t for *_, x in inside(64_000) for t in x.split())
                assert got.v == (inside(64_000)[-1][2] if inside(64_000) else None)
    assert checked > 40


@pytest.mark.parametrize("each", [10, 160])
def test_what_a_batch_reads_does_not_grow_with_the_rows_of_its_window(each):
    """32 buckets of many or few rows with the same texts; then one row."""
    made = processor(Spec({"w": 32_000}, {"f": 10**9}, None), {"l": "w", "s": "f"}, {"v": "w"})
    for b in range(32):
        made._answers(("k",), batch([(b * each + i, b * S + i * (S // each), f"text {i % 10}") for i in range(each)]))
    rows = 32 * each
    made.handle.counts.update(read=0, written=0)
    last = made._answers(("k",), batch([(rows, 33 * S, "text 0")]))
    assert len(last.l[0]) == 2 * (31 * each + 1)
    # summaries of ten texts and the rows of one bucket, of which a row is some 100 bytes
    assert made.handle.counts["read"] < 32 * 1_000 + each * 150
    assert made.handle.counts["written"] < 12_000


def test_a_row_in_the_newest_bucket_writes_only_that():
    made = processor(Spec({"w": 32_000}, {}, None), {"l": "w"}, {})
    for b in range(32):
        made._answers(("k",), batch([(b, b * S, "t")]))
    before = {k: v for k, v in made.texts.held.items()}
    made._answers(("k",), batch([(99, 31 * S + 5, "u")]))
    assert {k for k, v in made.texts.held.items() if before.get(k) != v} == {(31,)}
    assert {k[0] for k in made.summaries.held} == {k[0] for k in made.texts.held}


def test_a_key_with_few_rows_reads_and_writes_few_values():
    """A new key writes what it has by three values at most, a known one reads no more."""
    made = processor(Spec({"w": 32_000}, {"f": 5_000}, "ever"), {"l": "w", "s": "f"}, {"v": "w"})
    calls = []
    for state in (made.totals, made.fixed, made.latest, made.rows, made.texts, made.summaries):
        for name in ("getValue", "containsKey", "updateValue", "removeKey", "iterator", "exists", "get", "update"):
            setattr(state, name, lambda *a, _f=getattr(state, name), _n=name: (calls.append(_n), _f(*a))[1])
    made._answers(("k",), batch([(i, i * S, "t u") for i in range(9)]))
    assert calls.count("update") == 3 and len([c for c in calls if c != "updateValue"]) == 4
    calls.clear()
    last = made._answers(("k",), batch([(9, 9 * S, "t")]))
    assert last.l[0] == ["t"] * 10 + ["u"] * 9
    assert len([c for c in calls if c != "updateValue"]) == 9
