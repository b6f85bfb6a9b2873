"""Exact, near and substring dedup against brute force, and their defined edge results."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import components, exact_dedup, fm_index, fuse_filter, jaccard_join, substring_dedup

from . import edges

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(x):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), x or "")


def shingles(x):
    w = WORD.findall(lower(x))
    return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def near_components(rows):
    sets = {i: shingles(x) for i, x in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = {}
    for i in sorted(sets):
        met = Counter(j for t in sets[i] for j in lists.get(t, ()))
        for t in sets[i]:
            lists.setdefault(t, []).append(i)
        for j, both in met.items():
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_rows(seed):
    r = random.Random(seed)
    out = []
    for _ in range(120):  # light sets
        w = edges.words(r.random(), r.randint(0, 22))
        for _ in range(r.randint(1, 4)):
            v = list(w)
            if v and r.random() < 0.7:
                v[r.choice([0, -1])] = r.choice("xyzw")
            out.append((len(out), " ".join(v + (["Q"] if r.random() < 0.3 else []))))
    for _ in range(40):  # heavy sets
        w = edges.words(r.random(), r.randint(30, 250), "abcdefghijklmnopqrstuvwxyz")
        for _ in range(r.randint(1, 6)):
            v = list(w)
            for _ in range(r.randint(0, max(1, len(v) // 30))):
                v[r.randrange(len(v))] = "zz"
            out.append((len(out), " ".join(v)))
    return out


@pytest.mark.parametrize("seed", [1])
def test_jaccard_components_equal_brute_force(spark, seed):
    rows = near_rows(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()}
    assert got == near_components(rows)


def test_jaccard_pairs_equal_brute_force(spark):
    rows = near_rows(3)
    pairs, members = jaccard_join.jaccard_pairs(spark.createDataFrame(rows, "doc_id long, text string"))
    sets = {i: shingles(x) for i, x in rows}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    own = {i: first[s] if s else i for i, s in sets.items()}
    assert {r.doc_id: r.class_id for r in members.collect()} == own
    reps = sorted(i for i, c in own.items() if i == c and sets[i])
    want = {(a, b) for n, a in enumerate(reps) for b in reps[n + 1 :] if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in pairs.collect()} == want and len(want) > 50


def test_jaccard_large_group_of_near_copies(spark):
    base = edges.words(7, 200)
    rows = []
    for i in range(400):
        v = list(base)
        v[i % 200] = f"edit{i}"
        rows.append((i, " ".join(v)))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}

def test_jaccard_keeps_a_pair_whose_shingles_collide(spark):
    w = [f"w41x{i}" for i in range(20_004)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:15_004])), (3, " ".join(w[:15_003]))]  # 15,000 of 20,000 shingles: a link; 14,999 of them: with 2 only
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1}
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame([rows[0], rows[2]], "doc_id long, text string")).collect()}
    assert got == {1: 1, 3: 3}


def test_shingles_that_fall_together_in_the_screen_count_as_shared():
    # with one part the place is the upper half: 10 and 11 can't be told apart, 2**40 can
    batch = jaccard_join.screen_rows(np.array([7], np.int64), [np.array([10, 11, 2**40], np.uint64)], 1)
    own = [r for r in batch.to_pylist() if r["part"] < 0]
    assert [np.frombuffer(r["counts"], np.uint32).tolist() for r in own] == [[1]]
    assert sum(len(r["shingles"]) // 4 for r in batch.to_pylist() if r["part"] >= 0) == 2


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=50), st.integers(1, 2**31))
@settings(max_examples=60, deadline=None)
def test_parts_keep_the_order_of_hashes(values, parts):
    x = np.sort(np.array(values, np.uint64))
    part, place = jaccard_join.dealt(x, parts)
    assert part.tolist() == [v * parts >> 64 for v in x.tolist()]
    assert place.tolist() == [(v * parts >> 32) & 0xFFFFFFFF for v in x.tolist()]


def test_long_lists_give_the_same_pairs_in_blocks(spark):
    r = random.Random(5)
    rows = [(r.randrange(3), i, r.randint(20, 24), r.randint(0, 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "key long, rep long, n int, place int")
    pairs = [{(x.a, x.b) for x in jaccard_join._candidates(df, block=b).collect()} for b in (4, 1000)]
    assert pairs[0] == pairs[1] and pairs[0]


def test_light_boundary_follows_the_cost():
    assert jaccard_join.light_boundary([(4, 10, 1000), (8, 10, 5000), (12, 10, 10)], 10**6) == 8
    assert jaccard_join.light_boundary([(4, 10, 1000), (8, 10, 5000)], 100) == 4  # no more keys than the screen has shuffled
    assert jaccard_join.light_boundary([], 0) == 0


def test_jaccard_very_long_and_repeated_rows(spark):
    long = " ".join(edges.words(11, 150_000, "abcdefghijklmnopqrstuvwxyz"))
    rows = [(1, long), (2, long + " end"), (2, long + " end"), (3, None), (None, long), (4, "")]
    got = sorted((r.doc_id or -1, r.component_id) for r in jaccard_join.jaccard_components(edges.table(spark, rows)).collect())
    assert got == [(-1, 1), (1, 1), (2, 1), (2, 1), (3, 3), (4, 4)]


def test_jaccard_edges(spark):
    got = jaccard_join.jaccard_components(edges.table(spark)).collect()
    assert len(got) == len(edges.rows())
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].component_id == by[2].component_id == by[3].component_id == by[4].component_id == 1
    assert by[5].component_id == -3 and by[10].component_id == 9 and by[12].component_id == 11
    assert (by[6].n_shingles, by[6].component_id) == (0, 6) and by[8].n_shingles == 0
    assert {r.component_id for r in got if r.doc_id is None} == {-3, None}
    assert jaccard_join.jaccard_components(edges.empty(spark)).count() == 0
    kept = jaccard_join.keep_one(edges.table(spark))
    assert kept.columns == edges.table(spark).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [-3, 1, 6, 7, 8, 9, 11, 13, 2**62]


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(500, 500)]
    got = {r.v: r.label for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_dedup_edges(spark):
    got = exact_dedup.exact_dedup(edges.table(spark), keys_per_filter=3).collect()
    assert len(got) == len(edges.rows())
    by = {(r.doc_id, bytes(r.digest)): r for r in got}
    for doc_id, text in edges.rows():
        digest = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).digest()
        same = [i for i, x in edges.rows() if re.sub(r"[\x20\x09-\x0D]+", " ", x or "") == re.sub(r"[\x20\x09-\x0D]+", " ", text or "")]
        keep = min((i for i in same if i is not None), default=None)
        r = by[(doc_id, digest)]
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(same), doc_id == keep)
    left = exact_dedup.drop_duplicates(edges.table(spark))
    assert left.columns == edges.table(spark).columns
    assert Counter(r.doc_id for r in left.collect()) == Counter([1, 4, 5, -3, 6, 8, 9, 10, 11, 12, None, 13, 14, 2**62])
    assert exact_dedup.exact_dedup(edges.empty(spark)).count() == 0


def test_exact_dedup_against_a_given_snapshot(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "a"), (2, "b"), (10, "a"), (11, "c"), (12, "c"), (13, None), (14, "")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(df, F.col("doc_id") < 10).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 10: (1, 2), 11: (11, 2), 12: (11, 2), 13: (13, 2), 14: (13, 2)}


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 4000), st.integers(0, 2**32))
def test_fuse_filter_has_no_false_negatives(n, seed):
    r = np.random.default_rng(seed)
    keys = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
    built = fuse_filter.build(keys)
    assert fuse_filter.contains(keys, *built).all()
    others = np.setdiff1d(r.integers(0, 2**64, 4000, dtype=np.uint64), keys)
    assert fuse_filter.contains(others, *built).mean() < 0.03


def test_fuse_filter_size():
    keys = np.random.default_rng(1).integers(0, 2**64, 200_000, dtype=np.uint64)
    assert len(fuse_filter.build(keys)[2]) < 1.25 * len(keys)


def removed(rows):
    first, words = {}, {i: WORD.findall(x or "") for i, x in rows}
    for i in sorted(words):
        for j in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][j : j + 50]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - 49):
            if first[tuple(w[j : j + 50])] < i:
                gone[j : j + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize(("seed", "most_segments"), [(1, 20_000), (2, 3), (3, 1)])
def test_substring_dedup_equals_brute_force(spark, seed, most_segments):
    r = random.Random(seed)
    passages = [edges.words(r.random(), r.randint(49, 160)) for _ in range(8)]
    rows = []
    for i in range(200):
        w = []
        for _ in range(r.randint(0, 4)):
            w += r.choice(passages) if r.random() < 0.5 else edges.words(r.random(), r.randint(1, 90))
        rows.append((3 * i, r.choice([" ", "\n"]).join(w)))
    rows += [(1000, None), (1001, ""), (1002, "x " * 300), (1003, "x " * 200 + "y")]
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), index_words=2000, most_segments=most_segments).collect()}
    assert got == removed(rows)


def test_a_passage_of_many_near_copies_is_split_over_indexes(spark):
    base, rows = edges.words(9, 130), []
    for i in range(150):
        w = list(base)
        w[(7 * i) % 130] = f"edit{i}"
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join([*base[20:64], *edges.words(i, 30)])) for i in range(150, 200)]  # a common beginning of windows that all differ
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = removed(rows)
    for most in (1, 20):
        got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring_dedup.substring_dedup(df, index_words=500, most_segments=most).collect()}
        assert got == want


def test_least_places_of_more_than_a_piece(monkeypatch):
    grams = np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64)
    whole = substring_dedup.least_places(grams, 43)
    monkeypatch.setattr(substring_dedup, "_PIECE", 97)
    assert substring_dedup.least_places(grams, 43).tolist() == whole.tolist()
    assert whole.tolist() == [i + int(np.argmin(grams[i : i + 43] >> np.uint64(24))) for i in range(len(grams) - 42)]


def test_substring_dedup_edges(spark):
    got = substring_dedup.substring_dedup(edges.table(spark)).collect()
    assert len(got) == len(edges.rows())
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert (by[1].n_removed, by[2].n_removed, by[3].n_removed, by[4].n_removed) == (0, 120, 120, 120)
    assert (by[11].n_removed, by[12].n_removed, by[12].n_words) == (0, 60_000, 60_001)
    assert by[5].n_removed == 90 and by[-3].n_removed == 0 and by[14].n_removed == 120 and by[6].n_words == 0
    assert all(r.n_removed == 0 for r in got if r.doc_id is None)
    assert substring_dedup.substring_dedup(edges.empty(spark)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=6, max_size=30), min_size=1, max_size=8), st.integers(2, 6))
def test_fm_index_finds_the_least_label(parts, depth):
    segments = [np.array(p, np.int64) for p in parts]
    labels = np.arange(len(parts))[::-1].copy()
    least = {}
    for p, label in zip(parts, labels, strict=True):
        for i in range(len(p) - depth + 1):
            t = tuple(p[i : i + depth])
            least[t] = min(label, least.get(t, label))
    for p, found in zip(parts, fm_index.FMIndex(segments, labels, depth).stream(segments), strict=True):
        assert found.tolist() == [least[tuple(p[i : i + depth])] for i in range(len(p) - depth + 1)]
