"""N-gram Jaccard self-join: size-aware heavy and light sets.

Documents with the same shingle set are one class, stood for by its least doc_id.
A set of n shingles with a partner of likeness J >= threshold shares at least
ceil(threshold * n) of them, which serves three times:

* Screen: shingles whose hash lies in a fixed half of the hash space are dealt out by
  hash, packed in large binary rows, and each set learns how many of them another set has
  too. A set that lacks more than n - ceil(threshold * n) of them has no partner. What sets
  of one block share is counted there, and a block sends each shingle once, so a shingle
  that a third of all documents have loads no task. A shingle travels as its part and 32
  bits of its place there; those that fall together within a set count as shared, so
  chance can let a set pass but never stop it.
* Light sets (n <= boundary): every subset of each possible overlap size is a key; two
  small sets are partners only if they share a key.
* Heavy sets: shingles (whole 64-bit hashes) are ordered from rare to common, and only the
  first n - ceil(threshold * n) + 1 of them enter the inverted lists.

The boundary is the largest size at which enumerating subsets costs less than scanning
the inverted lists, by their measured lengths. Lists are linked in two rounds: first each member is compared with
the first of its list, then the remaining pairs between different components only, so a
group of g near copies costs about g comparisons; a long list is dealt out in blocks, each
pair of blocks being a task of its own. Every comparison is exact on the
whole sets. Links between sets that a first-round path already joins need no test.

Defined results: texts without words have no set, and doc_id as component_id; rows of
one doc_id and set are one class; a row without doc_id links with nothing
(component_id null) unless its set has another row; an empty table gives no rows;
a very long text counts with all of its shingles, which are dealt out like those of others; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import discard, map_batches, partitions, salted_lookup, written
from .textops import mix, shingle_sets

U = np.uint64
WORDS = 5
#: The threshold as a fraction.
NUMERATOR, DENOMINATOR = 75, 100
#: Shingles that a part of the first and of the second screen has at most, about; a task holds a part at a time.
SCREENED_PER_PART = 4_000_000
SHINGLES_PER_PART = 1_000_000
#: Sizes whose cost as light sets is looked at; a larger set has over 10**14 subsets of the sizes in question.
SMALL = 64
#: Subset keys that a task gathers before it sends them on.
KEYS_AT_ONCE = 500_000
#: Entries of a list that make one block of its comparisons.
LIST_BLOCK = 2_000


def least_overlap(a: int, b: int) -> int:
    """The smallest intersection that links sets of a and b shingles."""
    return -(-NUMERATOR * (a + b) // (NUMERATOR + DENOMINATOR))


def needed(n):
    """The smallest intersection with any partner, for an int or an array."""
    return -(-NUMERATOR * n // DENOMINATOR)


def set_name(shingles: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums that name a set."""
    one, two = mix(shingles ^ U(0xA0761D6478BD642F)).sum(dtype=np.uint64), mix(shingles ^ U(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def shingle_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, half, one, two): the size of each document's set, its part in the half that is screened, and its name."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            sizes, halves, names = [], [], []
            for s in shingle_sets(batch.column(1), WORDS):
                sizes.append(len(s))
                halves.append(int(np.searchsorted(s, U(1 << 63))))
                names.append(set_name(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(halves, pa.int64()), pa.array([x[0] for x in names], pa.int64()), pa.array([x[1] for x in names], pa.int64())], ["doc_id", "n_shingles", "half", "one", "two"])

        return step

    return map_batches(_plain(docs, id_col, text_col), make, "doc_id long, n_shingles long, half long, one long, two long")


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")


# Packed rows: shingles of many sets dealt out by hash.

PACKED = "part int, names binary, counts binary, shingles binary"
#: The name under which a block sends a shingle that several of its sets have, which have counted it.
SEVERAL = 0x5DEECE66D1CE5EED


def dealt(shingles: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, place within it in 32 bits) of 64-bit numbers; both keep their order."""
    high, low = (shingles >> U(32)) * U(parts), (shingles & U(0xFFFFFFFF)) * U(parts)
    return (high + (low >> U(32))) >> U(32), (shingles * U(parts) >> U(32)).astype(np.uint32)


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where a new run of equal rows begins."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _rows(names: np.ndarray, owner: np.ndarray, part: np.ndarray, values: np.ndarray) -> list[tuple[int, bytes, bytes, bytes]]:
    """One row for each part: names of the owners, how many values each has there, and the values."""
    order = np.argsort(part, kind="stable")
    part, owner, values = part[order].astype(np.int64), owner[order], values[order]
    new = _edges(part, owner)
    runs, run_part, run_name = np.diff(np.append(new, len(part))).astype(np.uint32), part[new], names[owner[new]]
    cut = _edges(run_part)
    stop = np.append(cut, len(new))[1:]
    ends = np.append(new, len(part))
    return [(int(run_part[a]), run_name[a:b].tobytes(), runs[a:b].tobytes(), values[ends[a] : ends[b]].tobytes()) for a, b in zip(cut, stop, strict=True)]


def _batch(rows: list[tuple], names: str = PACKED) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], [x.split()[0] for x in names.split(", ")])


def screen_rows(names: np.ndarray, sets: list[np.ndarray], parts: int) -> pa.RecordBatch:
    """The half that is screened, dealt out: each shingle of the block once, with the set that has it or SEVERAL.

    A row of a part below 0 says how many of its shingles each set shares within the block, with those
    that can't be told from another of its own.
    """
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keep = every >> U(63) == 0
    every, owner = every[keep], owner[keep]
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    first = _edges(every)
    length = np.diff(np.append(first, len(every)))
    shared = np.bincount(owner[np.repeat(length > 1, length)], minlength=len(sets))
    every, owner = every[first], np.where(length > 1, len(sets), owner[first])
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    part, place = dealt(every[order] << U(1), parts)
    new = np.zeros(len(owner), bool)
    new[_edges(owner, part, place)] = True
    shared = (shared + np.bincount(owner[~new], minlength=len(sets) + 1)[: len(sets)]).astype(np.uint32)
    some = np.flatnonzero(shared)
    within = [(-1 - int(names[some[0]] % parts), names[some].tobytes(), shared[some].tobytes(), b"")] if len(some) else []
    return _batch(within + _rows(np.append(names, np.int64(SEVERAL)), owner[new], part[new], place[new]))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, name of each) for each part of a task; rows come sorted by part."""
    now, held = None, []

    def whole():
        names = np.concatenate([np.repeat(np.frombuffer(n, np.int64), np.frombuffer(c, np.uint32)) for n, c, _ in held])
        return np.concatenate([np.frombuffer(s, np.uint32) for _, _, s in held]), names

    for batch in batches:
        for part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part != now and held:
                yield whole()
                held = []
            now = part
            held.append(row)
    if held:
        yield whole()


def _owners(shingles: np.ndarray, names: np.ndarray) -> np.ndarray:
    """A set's name for each distinct shingle of it that another set has too."""
    order = np.argsort(shingles, kind="stable")
    s, n = shingles[order], names[order]
    first = _edges(s)
    if not len(first):
        return n
    many = np.minimum.reduceat(n, first) != np.maximum.reduceat(n, first)
    keep = np.repeat(many, np.diff(np.append(first, len(s))))
    s, n = s[keep], n[keep]
    order = np.lexsort((n, s))
    s, n = s[order], n[order]
    return n[_edges(s, n)]


def screened(docs: DataFrame, names: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The classes that may have a partner."""
    spark = docs.sparkSession
    n_tasks = partitions(spark)
    parts = max(4 * n_tasks, (names.agg(F.sum("half")).first()[0] or 0) // SCREENED_PER_PART + 1)

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            names, sets, held, met = [], [], 0, set()
            for s in shingle_sets(batch.column(1), WORDS):
                one = set_name(s)[0]
                if len(s) and one not in met:
                    met.add(one)
                    names.append(one)
                    sets.append(s)
                    held += len(s)
                if held > 1_000_000:
                    yield screen_rows(np.array(names, np.int64), sets, parts)
                    names, sets, held = [], [], 0
            if sets:
                yield screen_rows(np.array(names, np.int64), sets, parts)

        return step

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        within: list[tuple[bytes, bytes]] = []

        def between() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                below = pc.less(batch.column(0), 0)
                within.extend(zip(batch.column(1).filter(below).to_pylist(), batch.column(2).filter(below).to_pylist(), strict=True))
                yield batch.filter(pc.invert(below))

        for places, names in _parts(between()):
            own, m = np.unique(_owners(places, names), return_counts=True)
            other = own != SEVERAL
            yield pa.RecordBatch.from_arrays([pa.array(own[other]), pa.array(m[other])], ["one", "m"])
        for own, m in within:
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(own, np.int64)), pa.array(np.frombuffer(m, np.uint32).astype(np.int64))], ["one", "m"])

    rows = map_batches(_plain(docs, id_col, text_col), make, PACKED)
    met = rows.repartition(n_tasks, "part").sortWithinPartitions("part").mapInArrow(count, "one long, m long")
    met = met.groupBy("one").agg(F.sum("m").alias("m"))
    alone = F.col("half") - F.coalesce("m", F.lit(0))
    return classes.join(met.hint("shuffle_hash"), "one", "left").filter(alone <= F.col("n_shingles") - F.ceil(F.col("n_shingles") * NUMERATOR / DENOMINATOR)).drop("m")


def with_sets(docs: DataFrame, survivors: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rep, n, shingles binary of sorted uint64) of the surviving classes."""
    texts = _plain(docs, id_col, text_col)
    met = texts.hint("merge").join(survivors.select(F.col("rep").alias("doc_id"), "one").hint("merge"), "doc_id")

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows = []
            for rep, one, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingle_sets(batch.column(1), WORDS), strict=True):
                if len(s) and set_name(s)[0] == one:  # rows of one doc_id may differ in text
                    rows.append((rep, len(s), s.tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["rep", "n", "shingles"])

        return step

    return map_batches(met.select("doc_id", "text", "one"), make, "rep long, n long, shingles binary")


DEALT = "part int, kind int, names binary, counts binary, shingles binary"


def shared_shingles(sets: DataFrame) -> DataFrame:
    """(rep, n, ids, df, entries): for each set the shingles that other surviving sets have too and the lengths of
    their lists (arrays in binary: uint64 and int64), and their number.

    A block sends each of its shingles once with the number of its sets that have it (kind 0), and its sets (kind 1). A
    task adds a part's counts up, then looks the sets up row by row, so it never holds all sets of a common shingle.
    """
    spark = sets.sparkSession
    total = sets.agg(F.sum("n")).first()[0] or 0
    parts = int(total // SHINGLES_PER_PART + 1)

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            names = np.array(batch.column(0).to_pylist(), np.int64)
            own = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            every = np.concatenate(own) if own else np.zeros(0, np.uint64)
            owner = np.repeat(np.arange(len(own)), [len(s) for s in own])
            distinct, count = np.unique(every, return_counts=True)
            part = dealt(distinct, parts)[0]
            cut = _edges(part)
            counts = [(int(part[a]), 0, b"", count[a:b].astype(np.int64).tobytes(), distinct[a:b].tobytes()) for a, b in zip(cut, np.append(cut[1:], len(part)), strict=True)]
            rows = [(p, 1, *x) for p, *x in _rows(names, owner, dealt(every, parts)[0], every)]
            columns = list(zip(*(counts + rows), strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[2:])], [x.split()[0] for x in DEALT.split(", ")])

        return step

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, known, df = None, [], None, None
        for batch in batches:
            for part, kind, names, counts, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    now, held, known = part, [], None
                if kind == 0:
                    held.append((np.frombuffer(shingles, np.uint64), np.frombuffer(counts, np.int64)))
                    continue
                if known is None:
                    every, at = np.unique(np.concatenate([s for s, _ in held]), return_inverse=True)
                    sums = np.bincount(at, np.concatenate([c for _, c in held])).astype(np.int64)
                    known, df, held = every[sums > 1], sums[sums > 1], []
                yield from _found(np.frombuffer(names, np.int64), np.frombuffer(counts, np.uint32), np.frombuffer(shingles, np.uint64), known, df)

    rows = map_batches(sets.select("rep", "shingles"), make, DEALT)
    found = rows.repartition(min(parts, 4 * partitions(spark)), "part").sortWithinPartitions("part", "kind").mapInArrow(find, "rep long, ids binary, df binary")
    found = found.groupBy("rep").agg(F.collect_list(F.struct("ids", "df")).alias("p"), F.sum(F.octet_length("ids") / 8).cast("long").alias("entries"))
    whole = found.select("rep", F.expr("transform(p, x -> x.ids)").alias("ids"), F.expr("transform(p, x -> x.df)").alias("df"), "entries")
    return sets.select("rep", "n").join(whole, "rep")


def _found(names: np.ndarray, counts: np.ndarray, shingles: np.ndarray, known: np.ndarray, df: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each set of a row those of its shingles that are known, with the lengths of their lists."""
    at = np.minimum(np.searchsorted(known, shingles), max(0, len(known) - 1))
    hit = known[at] == shingles if len(known) else np.zeros(len(shingles), bool)
    owner = np.repeat(np.arange(len(names)), counts)[hit]
    ids, length = shingles[hit], df[at[hit]] if len(known) else np.zeros(0, np.int64)
    first = _edges(owner)
    stop = np.append(first[1:], len(owner))
    spans = list(zip(first, stop, strict=True))
    yield pa.RecordBatch.from_arrays([pa.array(names[owner[first]]), pa.array([ids[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([length[a:b].tobytes() for a, b in spans], pa.binary())], ["rep", "ids", "df"])


def subsets(n: int) -> int:
    """How many keys a set of n shingles has as a light one, at most."""
    return sum(comb(n, c) for c in range(needed(n), n + 1))


def list_costs(shared: DataFrame) -> DataFrame:
    """(n, sets, scanned) for the sizes of small sets: how many sets there are, and the list entries that they would scan, rare shingles first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs = []
            for n, df in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                df = np.sort(np.frombuffer(b"".join(df), np.int64))
                costs.append(int((1 + df[: max(0, len(df) - needed(n) + 1)]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs, pa.int64())], ["n", "cost"])

    each = shared.filter(F.col("n") <= SMALL).select("n", "df").mapInArrow(run, "n long, cost long")
    return each.groupBy("n").agg(F.count(F.lit(1)).alias("sets"), F.sum("cost").alias("scanned"))


def light_boundary(costs: list[tuple[int, int, int]], most_keys: int) -> int:
    """The largest n at which subsets are fewer than the list entries to scan, while all subsets up to it are no more than most_keys.

    costs: list_costs; most_keys: the shared shingles of all sets, which have been shuffled already.
    """
    best = keys = 0
    for n, sets, scanned in sorted(costs):
        keys += sets * subsets(n)
        if keys > most_keys:
            break
        if sets * subsets(n) <= scanned:
            best = n
    return best


def list_entries(shared: DataFrame, boundary: int) -> DataFrame:
    """(key, rep, n, place): subsets of light sets (place -1) and rare-first shingles of the heavy and of the light that may meet one."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            held, size = [], 0

            def add(keys: np.ndarray, rep: int, n: int, places: np.ndarray) -> None:
                nonlocal size
                held.append((keys, np.full(len(keys), rep), np.full(len(keys), n), places))
                size += len(keys)

            def flat() -> pa.RecordBatch:
                columns = [np.concatenate(c) for c in zip(*held, strict=True)] if held else [np.zeros(0, np.uint64)] * 4
                return pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, (np.int64, np.int64, np.int32, np.int32), strict=True)], ["key", "rep", "n", "place"])

            for rep, n, ids, df in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, df = np.frombuffer(b"".join(ids), np.uint64), np.frombuffer(b"".join(df), np.int64)
                alone = n - len(ids)
                if len(ids) < needed(n):
                    continue
                if n <= boundary:
                    mixed = mix(np.sort(ids))
                    for c in range(needed(n), len(ids) + 1):
                        some = combinations(range(len(ids)), c)
                        while part := list(islice(some, KEYS_AT_ONCE // c)):
                            sums = mixed[np.array(part)].sum(axis=1, dtype=np.uint64)
                            add(mix(sums + mix(np.array([c], np.uint64))), rep, n, np.full(len(sums), -1))
                            if size >= KEYS_AT_ONCE:
                                yield flat()
                                held, size = [], 0
                if DENOMINATOR * n > NUMERATOR * boundary:
                    order = np.lexsort((mix(ids), df))[: n - needed(n) + 1 - alone]
                    add(mix(ids[order] ^ U(0x1D8E4E27C47D124F)), rep, n, np.arange(alone, alone + len(order)))
            yield flat()

        return step

    return map_batches(shared.select("rep", "n", "ids", "df"), make, "key long, rep long, n int, place int")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links, by whole sets."""
    side = lambda c: sets.select(F.col("rep").alias(c), F.col("shingles").alias(f"s{c}"))
    met = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(q, p)
                both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                ok.append(DENOMINATOR * both >= NUMERATOR * (len(p) + len(q) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def _near_size(a: str, b: str) -> str:
    return f"{DENOMINATOR} * least({a}, {b}) >= {NUMERATOR} * greatest({a}, {b})"


def _candidates(rows: DataFrame, condition: str = "true", block: int = LIST_BLOCK) -> DataFrame:
    """Distinct pairs (a, b) of sets that meet in a list, are near in size and may still share enough shingles.

    A list of more than ``block`` entries is cut into blocks; an entry goes to the cells of its block with each
    other one, so that a hot list is as many keys of the join as it has pairs of blocks.
    """
    names = [c for c in rows.columns if c != "key"]
    sized = salted_lookup(rows, rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block), "key", "rep")
    blocks = F.coalesce(F.ceil(F.col("_n") / block), F.lit(1)).cast("int")
    cut = written(sized.withColumn("_blocks", blocks).withColumn("_block", F.pmod(F.xxhash64("rep"), F.col("_blocks")).cast("int")).drop("_n"), "list-blocks")
    side = lambda s, first, last: cut.withColumn("_other", F.explode(F.sequence(first, last))).select("key", F.least("_block", "_other").alias("lo"), F.greatest("_block", "_other").alias("hi"), *(F.col(c).alias(f"{c}_{s}") for c in names))
    x, y = side("x", F.col("_block"), F.col("_blocks") - 1), side("y", F.lit(0), F.col("_block"))
    bound = "1 + least(n_x - place_x - 1, n_y - place_y - 1)"
    fits = f"(lo < hi or rep_x < rep_y) and rep_x <> rep_y and {condition} and {_near_size('n_x', 'n_y')} and ((place_x < 0 and place_y < 0) or (place_x >= 0 and place_y >= 0 and {NUMERATOR + DENOMINATOR} * ({bound}) >= {NUMERATOR} * (n_x + n_y)))"
    return x.hint("merge").join(y, ["key", "lo", "hi"]).filter(fits).select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b")).distinct()


def links(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) whose components are those of all links."""
    heads = entries.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("head"), F.max("rep").alias("last")).filter("head.rep <> last")
    heads = heads.select("key", F.col("head.rep").alias("h"), F.col("head.n").alias("hn"))
    long_lists = written(salted_lookup(entries, heads, "key", "rep").filter("h is not null"), "lists")
    stars = long_lists.filter(f"h <> rep and {_near_size('n', 'hn')}").select(F.col("h").alias("a"), F.col("rep").alias("b")).distinct()
    first = written(verified(stars, sets), "first-links")
    joined = components(first)
    own = long_lists.select("key", "rep", "n", "place").join(joined.withColumnsRenamed({"v": "rep", "label": "comp"}), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    own = written(own, "lists-by-component")
    mixed = own.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key", F.lit(True).alias("mixed"))
    rest = written(salted_lookup(own, mixed, "key", "rep").filter("mixed").drop("mixed"), "mixed-lists")
    second = written(verified(_candidates(rest, "comp_x <> comp_y"), sets), "second-links")
    discard(long_lists, own, rest)
    return first.unionByName(second)


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(names of all rows, classes, sets that passed the screen, their list entries)."""
    names = written(shingle_names(docs, id_col, text_col), "names")
    classes = written(names.filter("n_shingles > 0").groupBy("one", "two", "n_shingles", "half").agg(F.min("doc_id").alias("rep")), "classes")
    able = classes.filter("rep is not null")
    survivors = written(screened(docs, names, able, id_col, text_col).select("rep", "one"), "survivors")
    sets = written(with_sets(docs, survivors, id_col, text_col), "sets")
    shared = written(shared_shingles(sets), "shared")
    boundary = light_boundary([tuple(r) for r in list_costs(shared).collect()], shared.agg(F.sum("entries")).first()[0] or 0)
    entries = written(list_entries(shared, boundary), "entries")
    discard(survivors, shared)
    return names, classes, sets, entries


def jaccard_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(links (a, b) between class representatives, membership (doc_id, class_id)).

    Every link between different sets is a row, so a group of g near copies gives up to g * g / 2 of them;
    where the groups alone are wanted, jaccard_components gives them without.
    """
    names, classes, sets, entries = _prepared(docs, id_col, text_col)
    name = F.concat_ws(":", "one", "two", "n_shingles")
    members = salted_lookup(names.withColumn("name", name), classes.select(name.alias("name"), F.col("rep").alias("class_id")), "name", "doc_id")
    return verified(_candidates(entries), sets), members.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) for every row of docs."""
    names, classes, sets, entries = _prepared(docs, id_col, text_col)
    found = links(entries, sets)
    labels = components(found)
    discard(sets, entries)
    name = F.concat_ws(":", "one", "two", "n_shingles")
    owners = classes.join(labels.withColumnsRenamed({"v": "rep", "label": "component_id"}), "rep", "left").select(name.alias("name"), F.col("rep").alias("class_id"), F.coalesce("component_id", "rep").alias("component_id"))
    out = salted_lookup(names.withColumn("name", name), owners, "name", "doc_id")
    return out.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose component has a smaller doc_id; rows without doc_id stay."""
    drop = jaccard_components(docs, id_col, text_col).filter("doc_id <> component_id").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(drop, docs[id_col].cast("long") == drop["__id"], "left_anti")


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Pairs and their closure by brute force: for small tables only.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: array_to_string(words[i:i + 4], ' ')))) END AS grams FROM w
), c AS (
  SELECT doc_id, len(grams) AS n, min(doc_id) OVER (PARTITION BY md5(array_to_string(grams, chr(10)))) AS rep FROM s
), g AS (
  SELECT s.doc_id, c.n, unnest(s.grams) AS gram FROM s JOIN c USING (doc_id) WHERE c.n > 0 AND s.doc_id = c.rep
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), r(v, reached) AS (
  SELECT rep, rep FROM c WHERE n > 0 GROUP BY 1 UNION SELECT r.v, l.b FROM r JOIN l ON r.reached = l.a
), m AS (SELECT v, min(reached) AS component_id FROM r GROUP BY 1)
SELECT c.doc_id, c.n AS n_shingles, CASE WHEN c.n = 0 THEN c.doc_id ELSE c.rep END AS class_id, coalesce(m.component_id, c.doc_id) AS component_id
FROM c LEFT JOIN m ON c.n > 0 AND c.rep = m.v
"""
