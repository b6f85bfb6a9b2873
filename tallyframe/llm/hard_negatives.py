"""Hard-negative mining: exact integer inner products of every anchor with every row, by packed multiplication.

Components become whole numbers (floor(scale * x)). Several candidates' components, made
non-negative by a bias, stand in separate fields of one wide number (``packed``); one multiplication for each
component of an anchor adds to the sums of all of them, and ``unpacked`` takes the exact scores out of the
fields and the bias out of the scores. The fields are as wide as the norms of the vectors at hand demand. Up to 53
bits the wide number is a double, whose products and sums of whole numbers below 2^53 are exact in any order, so that a matrix
product does the work; up to 64 bits it is an unsigned integer, beyond that one of Python's.

Anchors are read in chunks of at most ``CHUNK`` bytes, sent to all tasks; the rows stay
where they are and are read twice for each chunk: for each anchor's best rows of its own label, and,
when these positives and so the bounds of the negatives' scores are known, for each positive's best
rows of other labels. A task keeps only the best of each anchor so far, and sends those on when it ends, so what
is shuffled depends on the number of tasks and anchors and not on that of pairs.

Defined results: rows without id, label or vector, or with a component that is null, infinite or no number, take no part;
shorter vectors go on with zeros; an anchor's positives and negatives never have its id; other
rows that repeat an id, or a whole row, count each for itself, and an id that is an anchor more than once counts once, as its
least (label, vector); of equal scores the smaller id comes first; an anchor without positives, or a positive
without negatives, gives no row; an empty table gives none; other columns are ignored, whatever their names. A score
beyond 64 bits is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import discard, shared_folder, written
from .vectors import finite, longest, whole

#: Bytes of anchors that are sent to every task at a time, as doubles.
CHUNK = 32 << 20
#: Anchors and rows whose scores a task has in memory together.
ANCHORS, ROWS = 256, 8192
LEAST = np.iinfo(np.int64).min
FIELDS = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class Packed(NamedTuple):
    words: np.ndarray  # (words, dims): each holds ``fields`` rows
    rows: int
    bits: int
    fields: int
    bias: int
    sums: np.ndarray  # of each row's components


def _norm(x: np.ndarray) -> int:
    """No less than the greatest Euclidean norm of rows of whole numbers."""
    if x.dtype == object:
        return isqrt(max((x * x).sum(axis=1), default=0)) + 1
    y = x.astype(np.float64)
    return int(np.sqrt((y * y).sum(axis=1)).max(initial=0) * (1 + 1e-9)) + 1


def packed(rows: np.ndarray, against: int) -> Packed:
    """Rows of whole numbers in the fields of wide ones, for products with biased anchors of a norm of at most ``against``."""
    bias = max(0, -int(rows.min(initial=0)))
    up = rows + bias
    bits = max(1, (against * _norm(up)).bit_length())  # of the greatest sum in a field, by Cauchy and Schwarz
    kind, room = (np.float64, 53) if 2 * bits <= 53 else (np.uint64, 64) if 2 * bits <= 64 else (object, 8 * bits)
    fields = room // bits
    n = -(-len(rows) // fields)
    words = np.zeros((n, rows.shape[1]), kind)
    for f in range(fields):
        part = up[f::fields].astype(kind)
        words[: len(part)] += part * (1 << f * bits if kind is object else kind(1 << f * bits))
    return Packed(words, len(rows), bits, fields, bias, rows.sum(axis=1))


def unpacked(anchors: np.ndarray, bias: int, held: Packed) -> np.ndarray:
    """(anchors, rows): the exact inner products. anchors: whole numbers plus bias, none negative."""
    product = anchors.astype(held.words.dtype) @ held.words.T
    product = product.astype(np.int64) if product.dtype == np.float64 else product
    shift, mask = (int, (1 << held.bits) - 1) if product.dtype == object else (product.dtype.type, product.dtype.type((1 << held.bits) - 1))
    out = np.empty((len(anchors), held.words.shape[0] * held.fields), object if product.dtype == object else np.int64)
    for f in range(held.fields):
        out[:, f :: held.fields] = product >> shift(f * held.bits) & mask
    dims = anchors.shape[1]
    # (a + x)(c + y) = ac + y(a + x) + xc, summed over components
    out = out[:, : held.rows] - (anchors.sum(axis=1) * held.bias)[:, None] - (held.sums * bias)[None, :]
    if dims and out.dtype == object and out.size and max(abs(int(out.max())), abs(int(out.min()))) >= 2**63:
        raise OverflowError("a score is beyond 64 bits")
    return out.astype(np.int64)


class Chunk(NamedTuple):
    """Anchors, sorted by id; bounds: for each anchor and positive the least and the greatest score of a negative."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    bounds: tuple[np.ndarray, np.ndarray] | None = None


def _best(who: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``most`` entries of each ``who``, by falling score and rising id."""
    order = np.lexsort((ids, -score, who))
    who, score, ids = who[order], score[order], ids[order]
    first = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.zeros(0, np.int64)
    place = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
    keep = place < most
    return who[keep], score[keep], ids[keep]


class Kept:
    """The best entries of each slot so far, and the score that a new entry must reach."""

    def __init__(self, slots: int, most: int):
        self.most, self.floor = most, np.full(slots, LEAST)
        self.held = (np.zeros(0, np.int64),) * 3

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.held = _best(*(np.concatenate(x) for x in zip(self.held, (slot, score, ids), strict=True)), self.most)
        n = np.bincount(self.held[0], minlength=len(self.floor))
        last = np.cumsum(n)[n == self.most] - 1
        self.floor[n == self.most] = self.held[1][last]


def _positives(chunk: Chunk, most: int) -> Callable:
    """step(ids, labels, vectors) for blocks of rows, and the kept entries: each anchor's best rows of its label."""
    kept = [Kept(len(chunk.ids[a : a + ANCHORS]), most) for a in range(0, len(chunk.ids), ANCHORS)]
    bias = max(0, -int(chunk.vectors.min(initial=0)))
    up = chunk.vectors + bias
    norm = _norm(up)

    def step(ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(labels, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(labels[order]) != 0))
        for at, end in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            own = order[at:end]
            mine = np.flatnonzero(chunk.labels == labels[own[0]])
            if not len(mine):
                continue
            held = packed(rows[own], norm)
            for block in np.unique(mine // ANCHORS):
                some = mine[mine // ANCHORS == block]
                score = unpacked(up[some], bias, held)
                slot = some - block * ANCHORS
                other = chunk.ids[some][:, None] != ids[own][None, :]
                floor = kept[block].floor[slot]
                if len(own) > most:
                    floor = np.maximum(floor, np.partition(np.where(other, score, LEAST), len(own) - most, axis=1)[:, len(own) - most])
                i, j = np.nonzero(other & (score >= floor[:, None]))
                kept[block].add(slot[i], score[i, j], ids[own[j]])

    return step, lambda: [(block * ANCHORS + k.held[0], np.zeros(len(k.held[0]), np.int64), k.held[1], k.held[2]) for block, k in enumerate(kept)]


def _negatives(chunk: Chunk, most: int) -> Callable:
    """As _positives: for each anchor and positive the best rows of other labels whose scores are within the bounds."""
    least, greatest = chunk.bounds
    kept = [[Kept(len(chunk.ids[a : a + ANCHORS]), most) for _ in range(least.shape[1])] for a in range(0, len(chunk.ids), ANCHORS)]
    bias = max(0, -int(chunk.vectors.min(initial=0)))
    up = chunk.vectors + bias
    norm = _norm(up)
    top = greatest.max(axis=1, initial=LEAST)

    def step(ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        held = packed(rows, norm)
        for block, own in enumerate(kept):
            some = slice(block * ANCHORS, (block + 1) * ANCHORS)
            score = unpacked(up[some], bias, held)
            # no positive has a use for what is below its bound and its last kept entry
            low = np.min([np.where(least[some, r] <= greatest[some, r], np.maximum(least[some, r], k.floor), np.iinfo(np.int64).max) for r, k in enumerate(own)], axis=0)
            i, j = np.nonzero((score >= low[:, None]) & (score <= top[some][:, None]) & (chunk.labels[some][:, None] != labels[None, :]))
            s = score[i, j]
            fresh = chunk.ids[some][i] != ids[j]
            for r, k in enumerate(own):
                use = fresh & (s >= np.maximum(least[some, r], k.floor)[i]) & (s <= greatest[some, r][i])
                if use.any():
                    k.add(i[use], s[use], ids[j[use]])

    return step, lambda: [(block * ANCHORS + k.held[0], np.full(len(k.held[0]), r), k.held[1], k.held[2]) for block, own in enumerate(kept) for r, k in enumerate(own)]


def _searched(rows: DataFrame, chunk: Chunk, make: Callable, most: int, dims: int, scale: int) -> DataFrame:
    """anchor_id, place, score, id: the best entries of each anchor and place over all rows."""
    held = rows.sparkSession.sparkContext.broadcast(tuple(chunk))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Chunk(*held.value)
        step, ends = make(own, most)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                step(part.column(0).to_numpy(), part.column(1).to_numpy(), whole(part.column(2), dims, scale))
        for slot, place, score, ids in ends():
            if len(slot):
                yield pa.RecordBatch.from_arrays([pa.array(own.ids[slot]), pa.array(place), pa.array(score), pa.array(ids)], ["anchor_id", "place", "score", "id"])

    found = rows.mapInArrow(run, "anchor_id long, place long, score long, id long")
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def mine(df: DataFrame, anchors: Column, id_col: Column, label: Column, vector: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, chunk_bytes: int = CHUNK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each of an anchor's first ``positives`` rows of its label the first
    ``negatives`` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.

    anchors: which rows are anchors. id_col, label: longs. The tables of chunks are written to the shared folder; the result reads them.
    """
    spark = df.sparkSession
    rows = df.select(id_col.cast("long").alias("id"), label.cast("long").alias("label"), vector.cast("array<double>").alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vector")))
    dims = longest(rows, "vector")
    plain = rows.select("id", "label", "vector")
    heads = written(plain.filter(rows["anchor"]).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.*"), "anchors")
    most = max(1, chunk_bytes // (8 * max(1, dims)))
    base, after, n = f"{shared_folder(spark)}/negatives-{uuid.uuid4().hex}", None, 0
    while True:
        part = heads if after is None else heads.filter(F.col("id") > after)
        got = part.orderBy("id").limit(most).toArrow()  # of at most chunk_bytes
        if not got.num_rows:
            break
        got = got.combine_chunks()
        chunk = Chunk(got["id"].to_numpy(), got["label"].to_numpy(), whole(got["vector"].chunk(0), dims, scale))
        after = int(chunk.ids[-1])
        near = _searched(plain, chunk, _positives, positives, dims, scale).toArrow()
        at, rank = np.searchsorted(chunk.ids, near["anchor_id"].to_numpy()), near["rank"].to_numpy() - 1
        least, greatest = np.ones((len(chunk.ids), positives), np.int64), np.zeros((len(chunk.ids), positives), np.int64)
        who, score = np.zeros_like(least), np.zeros_like(least)
        who[at, rank], score[at, rank] = near["id"].to_numpy(), near["score"].to_numpy()
        bound = lambda part, up: [(-(-int(s) * part // 100) if up else int(s) * part // 100) for s in near["score"].to_numpy()]  # noqa: E731, B023
        least[at, rank], greatest[at, rank] = bound(low, True), bound(high, False)
        found = _searched(plain, chunk._replace(bounds=(least, greatest)), _negatives, negatives, dims, scale)
        known = spark.createDataFrame(pa.table({"anchor_id": chunk.ids[at], "place": rank.astype(np.int64), "positive_id": who[at, rank], "positive_score": score[at, rank]}))
        met = found.join(known, ["anchor_id", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        met.write.mode("overwrite").parquet(f"{base}/chunk={n}")
        n += 1
    discard(heads)
    if not n:
        return spark.createDataFrame([], FIELDS)
    return spark.read.schema(FIELDS).parquet(*(f"{base}/chunk={i}" for i in range(n)))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    return mine(df, F.col("vec_id") % 100 == 0, F.col("vec_id"), label, F.col("embedding"))


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS a, c.vec_id AS c, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS s FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
  p AS (SELECT a, c, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, c) <= 5)
SELECT p.a AS anchor_id, p.c AS positive_id, (row_number() OVER n)::INTEGER AS rank, s.c AS negative_id, p.s AS positive_score, s.s AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.s <= 100 * s.s AND 100 * s.s <= 100 * p.s
WINDOW n AS (PARTITION BY p.a, p.c ORDER BY s.s DESC, s.c) QUALIFY row_number() OVER n <= 5"""
