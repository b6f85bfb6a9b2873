"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A bounded sample of labelled documents (``SAMPLE`` of each class, the least by a hash of
doc_id) is turned into term vectors: hashed byte trigrams and a few measures of shape
(repeated words and lines, signs, capitals, digits). Inverse document frequencies and a
truncated singular value decomposition of the sample give the latent space. The sample's
unit vectors, their labels and the projection are the whole model, of fixed size
whatever the corpus, and go to every task. Each document is projected, its exact cosines
with all labelled vectors are computed in blocks, and the ``NEIGHBOURS`` nearest vote
with their similarity as weight.

Defined results: null and empty texts are scored like any other by their (empty) shape;
a text without similarity to any labelled one gets the share of label 1; without a
labelled document of both classes every score is that share, or 0.5; labels without
quality or doc_id are left out; a doc_id labelled more than once keeps its greatest
label; cosines count to six places, and of equal ones those with the labelled documents
of smaller doc_id are nearer; equal texts have equal scores; a row without doc_id is scored
and not held out; an empty table gives no rows; a very long text is scored whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import row_blocks, text_buffers, word_bounds, word_hashes

#: Labelled documents of each class that the model is fit on, at most.
SAMPLE = 1500
TRIGRAMS = 1024
SHAPES = 14
DIMENSIONS = 48
NEIGHBOURS = 25
KEEP_FROM = 0.3
#: Documents that are compared at a time; cosines are whole numbers of 1 / ROUNDED.
BLOCK = 256
ROUNDED = 1_000_000
#: Weight of a full measure of shape against the trigrams' unit vector.
SHAPE_WEIGHT = 1.5

_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower case, 2 capital, 3 digit, 4 sign, 5 blank, 6 above ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 6
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'"]] = 4
_CLASS[[9, 10, 11, 12, 13, 32]] = 5


def _per_row(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values between edges."""
    total = np.append(0, np.cumsum(values))
    return total[edges[1:]] - total[edges[:-1]]


def features(column: pa.Array) -> np.ndarray:
    """(rows, TRIGRAMS + SHAPES) float32: damped counts of hashed trigrams, then measures of shape in 0..1."""
    raw, offsets = text_buffers(column)
    out = [_block(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in row_blocks(offsets, 1 << 20)]
    return np.concatenate(out) if out else np.zeros((0, TRIGRAMS + SHAPES), np.float32)


def _block(raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
    n = len(edges) - 1
    size = np.diff(edges)
    out = np.zeros((n, TRIGRAMS + SHAPES), np.float32)
    row = np.repeat(np.arange(n), size)
    if len(raw) > 2:
        wide = raw.astype(np.uint32)
        code = (wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA77) + wide[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(12)
        code = (code ^ code >> np.uint32(10)) % TRIGRAMS
        inside = row[:-2] == row[2:]
        counts = np.bincount(row[:-2][inside] * TRIGRAMS + code[inside], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
        out[:, :TRIGRAMS] = np.log1p(counts)
    shape = out[:, TRIGRAMS:]
    some = np.maximum(size, 1)
    kinds = np.bincount(row * 7 + _CLASS[raw], minlength=7 * n).reshape(n, 7) / some[:, None]
    starts, ends, first = word_bounds(raw, edges)
    words = word_hashes(raw, starts, ends, False)
    n_words = np.diff(first)
    many = np.maximum(n_words, 1)
    shape[:, 0] = np.minimum(1, kinds[:, 4] * 4)
    shape[:, 1] = np.minimum(1, kinds[:, 2] * 2)
    shape[:, 2] = np.minimum(1, kinds[:, 3] * 4)
    shape[:, 3] = np.minimum(1, kinds[:, 0] * 4)
    for k, step in ((4, 1), (5, 2), (6, 4)):  # words that repeat a near one
        if len(words) > step:
            same = np.append(words[step:] == words[:-step], np.zeros(step, bool))
            word_row = np.repeat(np.arange(n), n_words)
            same[:-step] &= word_row[:-step] == word_row[step:]
            shape[:, k] = _per_row(same, first) / many
    shape[:, 7] = np.minimum(1, (ends - starts).sum() and _per_row(ends - starts, first) / many / 16)
    signs = _CLASS[raw] == 4
    pairs = np.append(signs[1:] & signs[:-1], False) if len(raw) else signs
    shape[:, 8] = np.minimum(1, _per_row(pairs, edges) / many)
    lone = (ends - starts == 1) & signs[starts] if len(starts) else np.zeros(0, bool)
    shape[:, 9] = np.minimum(1, 2 * _per_row(lone, first) / many)
    for i in range(n):
        own = words[first[i] : first[i + 1]]
        if len(own) > 1:
            shape[i, 10] = 1 - len(np.unique(own)) / len(own)
    lines = raw == 10
    shape[:, 11] = np.minimum(1, 10 * _per_row(lines, edges) / many)
    shape[:, 12] = np.exp(-n_words / 20.0)
    shape[:, 13] = n_words == 0
    return out


class Model(NamedTuple):
    weights: np.ndarray  # of each feature
    centre: np.ndarray
    axes: np.ndarray  # features to latent dimensions
    vectors: np.ndarray  # unit latent vectors of the labelled sample
    labels: np.ndarray
    share: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        return _unit((_weighted(x, self.weights) - self.centre) @ self.axes)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors."""
        if not len(self.vectors):
            return np.full(len(x), self.share)
        out = []
        n = len(self.vectors)
        for a in range(0, len(x), BLOCK):
            part = x[a : a + BLOCK]
            # blocks of one shape, so that equal texts have equal cosines whatever stands beside them
            whole = np.zeros((BLOCK, x.shape[1]), x.dtype)
            whole[: len(part)] = part
            cosines = np.rint(self.latent(whole) @ self.vectors.T * ROUNDED).astype(np.int64)[: len(part)]
            k = min(NEIGHBOURS, n)
            near = np.argpartition(np.arange(n) - cosines * n, k - 1, axis=1)[:, :k]  # of equal cosines those that come first in the sample
            near.sort(axis=1)
            w = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64) ** 4
            total = w.sum(1)
            vote = (w * self.labels[near]).sum(1)
            out.append(np.where(total > 0, vote / np.where(total > 0, total, 1), self.share))
        return np.clip(np.concatenate(out), 0, 1) if out else np.zeros(0)


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


def _weighted(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    grams = _unit(x[:, :TRIGRAMS] * weights[:TRIGRAMS])
    return np.hstack([grams, x[:, TRIGRAMS:] * weights[TRIGRAMS:]])


def fit(x: np.ndarray, labels: np.ndarray) -> Model:
    """The latent space and the labelled vectors of a sample."""
    share = float(labels.mean()) if len(labels) else 0.5
    n = TRIGRAMS + SHAPES
    if not len(labels) or labels.min() == labels.max():
        return Model(np.ones(n, np.float32), np.zeros(n, np.float32), np.zeros((n, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), share)
    idf = np.log((1 + len(x)) / (1 + (x[:, :TRIGRAMS] > 0).sum(0))) + 0.1
    spread = x[:, TRIGRAMS:].std(0)
    weights = np.concatenate([idf, SHAPE_WEIGHT / np.maximum(spread * 2, 0.1)]).astype(np.float32)
    y = _weighted(x, weights)
    centre = y.mean(0)
    z = (y - centre).astype(np.float64)
    axes = np.linalg.eigh(z.T @ z)[1][:, ::-1][:, : min(DIMENSIONS, len(y))].astype(np.float32)  # the right singular vectors
    return Model(weights, centre, axes, _unit((y - centre) @ axes), labels.astype(np.float64), share)


def fold(id_col: Column) -> Column:
    """crc32 of doc_id as text, modulo 5."""
    return F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 5


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of at most ``sample`` documents of each class: 2 * sample rows of fixed size come to the driver."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known.filter(usable) if usable is not None else known
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    ids = None
    for q in (0, 1):
        part = known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        ids = part if ids is None else ids.unionByName(part)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r.tobytes() for r in features(batch.column(1)).astype(np.float32)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], ["doc_id", "quality", "x"])

    got = picked.mapInArrow(run, "doc_id long, quality int, x binary").toArrow()
    rows = sorted(zip(*(got[c].to_pylist() for c in ("doc_id", "x", "quality")), strict=True))  # the same order in every run
    x = np.frombuffer(b"".join(r[1] for r in rows), np.float32).reshape(-1, TRIGRAMS + SHAPES)
    return x, np.array([r[2] for r in rows], np.int64)


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample: int = SAMPLE) -> Model:
    return fit(*labelled_sample(docs, labels, usable, sample))


def _scored(docs: DataFrame, model: Model, keep_from: float) -> DataFrame:
    """docs by place (c0, c1, ...), so that no name clashes, with score and predicted."""
    held = docs.sparkSession.sparkContext.broadcast(tuple(model))
    fields = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*fields)
    at = docs.columns.index("text")
    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = np.concatenate([own.score(features(batch.column(at).slice(a, BLOCK))) for a in range(0, batch.num_rows, BLOCK)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array((scores >= keep_from).astype(np.int32))], [*fields, "score", "predicted"])

    return plain.mapInArrow(run, schema)


def score_documents(docs: DataFrame, model: Model, keep_from: float = KEEP_FROM) -> DataFrame:
    """docs with score and predicted as the last two columns."""
    return _scored(docs, model, keep_from).toDF(*docs.columns, "score", "predicted")


def keep_quality(docs: DataFrame, model: Model, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of docs that the classifier doesn't reject."""
    return _scored(docs, model, keep_from).filter("predicted = 1").drop("score", "predicted").toDF(*docs.columns)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold(F.col("doc_id")) != 0)
    return score_documents(docs, model).select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
