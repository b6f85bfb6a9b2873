"""Hard negatives, vector codes and source mixing against brute force, with the rows that each must take."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import hard_negatives as H
from tallyframe.llm import mixing as M
from tallyframe.llm import vector_codes as V
from tests.llm.edges import CLASHES

NAN, INF = float("nan"), float("inf")


def clashing(df):
    return df.select("*", *(F.lit(f"x{c}").alias(c) for c in [*CLASHES, "rank", "id", "code", "error", "copies", "_source", "v", "vector", "anchor"]))


def vector_rows(seed=1, n=60, dims=16):
    r = np.random.default_rng(seed)
    rows = [(i, (r.integers(-9, 9, dims) / 8).tolist(), int(r.integers(0, 4))) for i in range(n)]
    rows += [(n, rows[3][1], 1), (n, rows[3][1], 1), (n + 1, rows[3][1], 2), (n + 2, [0.5] * 3, 1), (n + 3, [], 1), (-7, rows[5][1], 2)]
    return rows + [(n + 4, None, 1), (n + 5, [0.1, None] * 8, 1), (n + 6, [NAN] * dims, 1), (n + 7, [INF] * dims, 2), (n + 8, rows[1][1], None), (None, rows[2][1], 3)]


SCHEMA = "vec_id long, embedding array<double>, label int"


def scaled(vector, scale):
    return None if vector is None or any(x is None or not math.isfinite(x) for x in vector) else [math.floor(scale * x) for x in vector]


def mined(rows, every, positives=5, negatives=5, low=80, high=100, scale=256):
    kept = [(i, scaled(v, scale), label) for i, v, label in rows if i is not None and label is not None and scaled(v, scale) is not None]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    heads = {}
    for i, v, label in sorted(kept, key=lambda x: (x[0], x[2], x[1])):
        if i % every == 0:
            heads.setdefault(i, (label, v))
    out = []
    for i, (label, v) in heads.items():
        best = sorted(((dot(v, w), -j) for j, w, y in kept if y == label and j != i), reverse=True)[:positives]
        for s, p in best:
            near = sorted(((dot(v, w), -j) for j, w, y in kept if y != label and j != i and low * s <= 100 * dot(v, w) <= high * s), reverse=True)[:negatives]
            out += [(i, -p, rank, -j, s, t) for rank, (t, j) in enumerate(near, 1)]
    return sorted(out)


def mine(df, every, **more):
    return sorted(map(tuple, H.mine(df, F.col("vec_id") % every == 0, F.col("vec_id"), F.col("label"), F.col("embedding"), **more).collect()))


@pytest.mark.parametrize("scale", [1, 256, 2**12, 2**28, 2**36])  # fields of doubles, of 64 bits and of any width
def test_hard_negatives_equal_brute_force(spark, scale):
    rows = vector_rows()
    df = clashing(spark.createDataFrame(rows, SCHEMA)).repartition(3)
    if scale == 2**36:
        with pytest.raises(Exception, match="beyond 64 bits"):
            mine(df, 5, scale=scale)
        return
    assert mine(df, 5, scale=scale) == mined(rows, 5, scale=scale)


def test_hard_negatives_in_chunks_and_bounds(spark):
    rows = vector_rows(2, 90)
    df = spark.createDataFrame(rows, SCHEMA)
    want = mined(rows, 3, 2, 7, -50, 130)
    assert want and mine(df, 3, positives=2, negatives=7, low=-50, high=130, chunk_bytes=16 * 8 * 4) == want


def test_hard_negatives_edge_tables(spark):
    assert mine(spark.createDataFrame([], SCHEMA), 5) == []
    assert mine(spark.createDataFrame([(0, None, 1), (5, [NAN], 1)], SCHEMA), 5) == []
    assert mine(spark.createDataFrame([(0, [1.0], 1), (5, [1.0], 2)], SCHEMA), 5) == []
    assert mine(spark.createDataFrame([(0, [1.0], 1)] + [(7, [1.0], 1)] * 6 + [(9, [1.0], 2)] * 9, SCHEMA), 5) == sorted((0, 7, rank, 9, 65536, 65536) for rank in range(1, 6) for _ in range(5))


def test_packed_products_are_exact():
    r = np.random.default_rng(3)
    for top, kind in ((3, np.float64), (2**10, np.float64), (2**12, np.uint64), (2**27, object)):
        a, b = r.integers(-top, top, (9, 20)), r.integers(-top, top + 1, (23, 20))
        bias = max(0, -int(a.min()))
        held = H.packed(b, H._norm(a + bias))
        assert held.words.dtype == kind and held.fields > 1
        want = a.astype(object) @ b.astype(object).T
        if max(abs(want.ravel())) < 2**63:
            assert (H.unpacked(a + bias, bias, held) == want).all()


def coded(rows, parts=V.PARTS, entries=V.ENTRIES, rounds=V.ROUNDS, scale=V.SCALE):
    kept = [(i, scaled(v, scale), label) for i, v, label in rows if scaled(v, scale) is not None]
    dims = -(-max(1, max(len(v) for _, v, _ in kept)) // parts) * parts
    width = dims // parts
    kept = [(i, v + [0] * (dims - len(v)), label) for i, v, label in kept]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda x: (x[0] is None, x[0] or 0, x[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, v, _ in kept:
                own[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[p])]
    out = []
    for i, v, label in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    total = defaultdict(int)
    for _, label, _, e in out:
        total[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, code, e, total[label]) for i, label, code, e in out), key=str), digest


@pytest.mark.parametrize("scale", [1, 4096, 2**33])
def test_vector_codes_equal_brute_force(spark, scale):
    rows = vector_rows(4) + [(500 + i, [i % 3 / 4] * 16, 9) for i in range(40)]
    df = clashing(spark.createDataFrame(rows, SCHEMA)).repartition(3)
    if scale == 2**33:  # squares beyond 64 bits
        with pytest.raises(Exception, match="Python int too large|not fit|out of"):
            V.encode(df, "embedding", V.train(df, "vec_id", "embedding", scale=scale)).collect()
        return
    books = V.train(df, "vec_id", "embedding", scale=scale)
    got = V.encode(df, "embedding", books)
    assert got.columns == [*df.columns, "code", "error"]
    whole = V.with_group_error(got.select(*(F.col(f"`{c}`") for c in ["vec_id", "label"])).limit(0).withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")}), F.col("label"), "label_error", "vec_id")
    assert whole.count() == 0
    plain = V.encode(df.select("vec_id", "embedding", "label"), "embedding", books)
    found = V.with_group_error(plain, F.col("label"), "label_error", "vec_id").select("vec_id", "code", "error", "label_error")
    want, digest = coded(rows, scale=scale)
    assert sorted(map(tuple, found.collect()), key=str) == want
    assert books.sha256() == digest


def test_vector_codes_of_few_rows(spark):
    none = spark.createDataFrame([(1, None, 1)], SCHEMA)
    assert V.encode(none, "embedding", V.train(none, "vec_id", "embedding")).count() == 0
    few = spark.createDataFrame([(1, [0.5, 2.0], 1), (2, [], None)], SCHEMA)
    books = V.train(few, "vec_id", "embedding")
    assert [tuple(r)[3:] for r in V.encode(few, "embedding", books).orderBy("vec_id").collect()] == [("00" * 8, 0), ("0101" + "00" * 6, 0)]
    with pytest.raises(ValueError, match="hexadecimal"):
        V.train(few, "vec_id", "embedding", entries=257)


def test_orchard_search_finds_the_nearest():
    r = np.random.default_rng(5)
    for k, width, top in ((1, 3, 5), (16, 1, 4), (16, 8, 6), (40, 4, 3), (16, 8, 3000)):
        book = V.Book(r.integers(-top, top, (k, width)))
        x = r.integers(-top, top, (500, width))
        d = ((x[:, None, :] - book.entries[None]) ** 2).sum(axis=2)
        code, best = book.nearest(x)
        assert (best == d.min(axis=1)).all() and (code == d.argmin(axis=1)).all()


def mixed(rows, weights=M.WEIGHTS, share=M.SHARE, epochs=M.EPOCHS, seed=M.SEED):
    """(source, row) to (size, source size, target, copies), by the words of the contract: limits one after another, then a sort."""
    sizes = [len([w for w in "".join(" " if c in "\x20\x09\x0a\x0b\x0c\x0d" else c for c in t or "").split(" ") if w]) for _, t, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(sizes, rows, strict=True) if r[2] == s) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        open_ = [s for s in names if s not in full]
        rest = share * sum(total.values()) - sum(epochs * total[s] for s in full)
        target = {s: epochs * total[s] if s in full else rest * weight[s] / sum(weight[o] for o in open_) for s in names}
        over = {s for s in open_ if target[s] > epochs * total[s]}
        if not over:
            break
        full |= over
    keys = []
    for i, t, _ in rows:
        t = t or ""
        u = (int(hashlib.md5(f"{seed}:{'' if i is None else i}:{t}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        w = 1 / (1 + M.SIGNS_AGAINST * sum(33 <= ord(c) < 127 and not c.isalnum() for c in t) / max(1, len(t)))
        keys.append(-math.log(u) / w)
    out = [None] * len(rows)
    for s in names:
        whole = int(target[s] // total[s]) if total[s] else 0
        budget, upto = target[s] - whole * total[s], 0
        own = defaultdict(list)
        for j, r in enumerate(rows):
            if r[2] == s:
                own[keys[j]].append(j)
        for key in sorted(own):
            n = sum(sizes[j] for j in own[key])
            upto += n
            for j in own[key]:
                out[j] = (sizes[j], total[s], round(target[s], 6), whole + (budget > 0 and upto - n / 2 <= budget))
    return out


def mix_rows(seed=6):
    r = np.random.default_rng(seed)
    text = lambda: " ".join("ab" * int(x) for x in r.integers(1, 4, int(r.integers(1, 40))))
    rows = [(i, text(), ["a", "b", "B", "é", "z"][int(r.integers(0, 5) * r.random())]) for i in range(300)]
    return rows + [(900, "x!! ?? -- \x0b y", None), (901, None, None), (902, "", "none"), (None, "one two", "a"), (None, "one two", "a"), (5, " ".join(["long"] * 50_000), "z"), (7, text(), ""), (7, "é 日本\x1c語", "a")]


def test_mix_equals_brute_force(spark):
    rows = mix_rows()
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string")).repartition(3)
    got = M.mix(df)
    assert got.columns == [*df.columns, "copies"]
    want = sorted(((i, t, s, c) for (i, t, s), (*_, c) in zip(rows, mixed(rows), strict=True)), key=str)
    assert sorted(((r[0], r[1], r[2], r[-1]) for r in got.collect()), key=str) == want
    assert sorted(((r[0], r[1], r[2], r[-1]) for r in M.mix(df.repartition(5)).collect()), key=str) == want  # reruns agree


def test_mix_targets_are_met(spark):
    rows = [r for r in mix_rows(7) if r[0] != 5]
    sums = defaultdict(lambda: [0, 0, 0])
    for (_, _, s), (n, whole, target, copies) in zip(rows, mixed(rows), strict=True):
        assert copies <= 2
        sums[s] = [sums[s][0] + n * copies, target, max(sums[s][2], n)]
    assert all(abs(taken - target) <= most for taken, target, most in sums.values())


def test_mix_edge_tables(spark, monkeypatch):
    schema = "doc_id long, text string, source string"
    assert M.mix(spark.createDataFrame([], schema)).count() == 0
    none = M.mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], schema)).collect()
    assert len(none) == 2
    same = [(1, "a b c", "s")] * 40 + [(2, "d e", "s"), (3, "f", "t")]
    df = spark.createDataFrame(same, schema)
    want = sorted((i, c) for (i, *_), (*_, c) in zip(same, mixed(same), strict=True))
    assert sorted((r.doc_id, r.copies) for r in M.mix(df).collect()) == want
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 1)  # the salted way
    assert sorted((r.doc_id, r.copies) for r in M.mix(df).collect()) == want


def test_mix_is_native(spark, sf):

    plan = M.mix(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
