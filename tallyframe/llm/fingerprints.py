"""Document fingerprints from prefix polynomial hashes.

A text's prefix array S holds S[i] = sum of c[j] * base**j for j < i, modulo a prime,
for two bases. Any span's hash is a difference of two entries, so span equality takes
constant time and the longest common extension of two positions a binary search.
The fingerprint is a one-permutation sketch of the hashes of all spans of ``SPAN`` code
points: the least hash in each of ``SLOTS`` ranges. The share of equal slots estimates
the Jaccard likeness of two texts' spans.

Each text meets the head of the next document in doc_id order: rows are dealt into
ranges of doc_id, sorted there, and each range is closed by a copy of the first row of
the next range, so one shuffle of the texts suffices.

Defined results: null counts as empty; rows without doc_id come last; rows of equal
doc_id are ordered by a hash of their text; a single row is its own next document;
texts shorter than a span are one span; two empty texts are alike (1.0), an empty and
another are not (0.0); a very long text is hashed whole, one at a time; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions
from .textops import mix

U = np.uint64
PRIME = (1 << 31) - 1
BASES = (1_000_003, 784_123_457)
SPAN = 16
SLOTS = 64
#: Ranges of doc_id dealt to a task by hash: several, so that tasks get about as much.
RANGES_PER_TASK = 8


class _Powers:
    """Powers of a base and of its inverse modulo PRIME, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, PRIME)
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        k = len(self.up)
        while k < n:
            self.up = np.concatenate([self.up, self.up * U(pow(self.base, k, PRIME)) % U(PRIME)])
            self.down = np.concatenate([self.down, self.down * U(pow(self.inverse, k, PRIME)) % U(PRIME)])
            k *= 2


_POWERS = tuple(_Powers(b) for b in BASES)


class PrefixHash:
    """Prefix polynomial hashes of a text, extended from another's first m code points if given."""

    def __init__(self, points: np.ndarray, head: PrefixHash | None = None, m: int = 0):
        self.points, self.n = points, len(points)
        self.sums = []
        for k, p in enumerate(_POWERS):
            p.need(self.n + 1)
            tail = (points[m:].astype(np.uint64) + U(1)) * p.up[m : self.n] % U(PRIME)
            start = head.sums[k][: m + 1] if head is not None else np.zeros(1, np.uint64)
            self.sums.append(np.concatenate([start, (np.cumsum(tail) + start[-1]) % U(PRIME)]))

    @classmethod
    def of(cls, text: str) -> PrefixHash:
        return cls(code_points(text))

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """62-bit hashes of spans, the same wherever a span lies."""
        parts = [(s[ends] + U(PRIME) - s[starts]) % U(PRIME) * p.down[starts] % U(PRIME) for s, p in zip(self.sums, _POWERS, strict=True)]
        return parts[0] << U(31) | parts[1]

    def grams(self, k: int, start: int = 0) -> np.ndarray:
        """Hashes of all spans of k code points from ``start`` on."""
        n = self.n - k + 1
        if n <= start:
            return np.zeros(0, np.uint64)
        parts = [(s[start + k :] + U(PRIME) - s[start:n]) % U(PRIME) * p.down[start:n] % U(PRIME) for s, p in zip(self.sums, _POWERS, strict=True)]
        return parts[0] << U(31) | parts[1]

    def equal(self, i: int, other: PrefixHash, j: int, length: int) -> bool:
        """Whether self[i:i+length] equals other[j:j+length]."""
        for s, t, p in zip(self.sums, other.sums, _POWERS, strict=True):
            a, b = (int(s[i + length]) - int(s[i])) % PRIME, (int(t[j + length]) - int(t[j])) % PRIME
            if a * int(p.down[i]) % PRIME != b * int(p.down[j]) % PRIME:
                return False
        return True

    def common(self, i: int, other: PrefixHash, j: int) -> int:
        """Length of the longest common extension of self[i:] and other[j:]."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(i, other, j, middle):
                low = middle
            else:
                high = middle - 1
        return low


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The least mixed hash of each slot as 16 bits; an empty slot takes its next full neighbour's, none at all gives 0 slots."""
    if not len(hashes):
        return np.zeros(0, np.uint16)
    values = np.sort(mix(hashes))
    again = values[1:] == values[:-1]
    if again.any():  # a span's n-th occurrence is an element of its own, so repeats keep their weight
        place = np.arange(len(values))
        since = place - np.maximum.accumulate(np.where(np.append(False, again), 0, place))
        values = np.sort(np.where(since, mix(values + since.astype(np.uint64) * U(0x9E3779B97F4A7C15)), values))
    edges = np.arange(SLOTS, dtype=np.uint64) << U(58)
    at = np.searchsorted(values, edges)  # the first value at or above each slot's lower edge, round the circle
    return (mix(values[at % len(values)]) >> U(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float((a == b).mean())


def spelled(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u2").tobytes().hex()


def _grams(h: PrefixHash) -> np.ndarray:
    return h.grams(SPAN) if h.n >= SPAN else h.grams(h.n) if h.n else np.zeros(0, np.uint64)


def _edit(text: str, points: PrefixHash, grams: np.ndarray, following: str) -> tuple[str, PrefixHash, np.ndarray]:
    """(edited text, its prefix hashes, its spans): only the changed end is hashed anew."""
    quarter = points.n // 4
    kept = points.n - quarter
    edited = text[:kept] + following[:quarter]
    h = PrefixHash(code_points(edited), points, kept)
    shared = kept - SPAN + 1
    own = np.concatenate([grams[:shared], h.grams(SPAN, shared)]) if shared > 0 and h.n >= SPAN else _grams(h)
    return edited, h, own


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(range_no, closing, doc_id, text) in doc_id order within each range; a closing row is the next range's first."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = RANGES_PER_TASK * partitions(spark)
    cuts = rows.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else None
    bounds = F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts or []))])
    range_no = F.when(F.col("doc_id").isNull(), n).otherwise(F.size(F.filter(bounds, lambda b: b <= F.col("doc_id")))).cast("int")
    rows = rows.withColumns({"range_no": range_no, "tie": F.xxhash64("text")})
    # one row for each range: at most n + 1
    heads = sorted((r.range_no, r.head) for r in rows.groupBy("range_no").agg(F.min("doc_id").alias("head")).collect())
    before = {at: heads[i - 1][0] for i, (at, _) in enumerate(heads)}
    small = spark.createDataFrame([(at, head, before[at]) for at, head in heads], "at int, head long, closes int")
    first = rows.join(F.broadcast(small), (F.col("range_no") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("head")))
    first = first.groupBy("closes").agg(F.min_by(F.struct("doc_id", "text"), F.struct("tie", "text")).alias("r"))
    closing = first.select(F.col("closes").alias("range_no"), F.lit(1).alias("closing"), "r.doc_id", F.lit(0).cast("long").alias("tie"), "r.text")
    return rows.select("range_no", F.lit(0).alias("closing"), "doc_id", "tie", "text").unionByName(closing).repartition(partitions(spark), "range_no").sortWithinPartitions("range_no", "closing", "doc_id", "tie", "text").select("range_no", "closing", "doc_id", "text")


SCHEMA = "doc_id long, n_chars long, fingerprint string, edited_text string, edited_sha256 string, edited_fingerprint string, near_edited double, near_next double, common_head long"


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Fingerprints of each text and of its edited text, their likeness, and the length of their common head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before, with its hashes
        for batch in batches:
            out = []
            for number, closing, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = PrefixHash.of(text)
                grams = _grams(h)
                mark = sketch(grams)
                if held is not None and held[0] == number:
                    _, prior_id, prior, ph, pg, pm = held
                    edited, eh, eg = _edit(prior, ph, pg, text)
                    em = sketch(eg)
                    out.append((prior_id, ph.n, spelled(pm), edited if with_text else None, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), spelled(em), likeness(pm, em), likeness(pm, mark), ph.common(0, eh, 0)))
                held = None if closing else (number, doc_id, text, h, grams, mark)
            columns = list(zip(*out, strict=True)) or [[]] * 9
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return in_order(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return fingerprint_documents(docs, with_text=False).drop("edited_text")
