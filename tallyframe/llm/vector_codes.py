"""Vector codes: vectors cut into parts, each replaced by the number of its nearest codebook entry, found by Orchard's search.

Components become whole numbers (floor(scale * x)), so distances and means are exact. Each part position has a
codebook of its own, which begins with the parts of the vectors of smallest id; a round assigns all
parts and puts each entry at the floor of its parts' mean. A round is one pass over the table: tasks add up their own parts,
and only the sums of parts x entries x components, a number fixed by parameters, come to the driver.

``nearest`` keeps for each entry the list of all entries sorted by their distance from it. A part starts at
some entry and goes through its list: an entry that is nearer than the present one becomes the present one, and its
list is gone through instead; entries that have been compared are marked and passed over; a list ends at the first entry beyond twice the part's
distance from the present entry, as by the triangle inequality nothing from there on is nearer. All parts of a batch take their steps together.

Defined results: rows without a vector or with a component that is null, infinite or no number are left out; an empty vector is
one of zeros, shorter vectors go on with zeros, and so do all up to a multiple of the number of parts; of equal ids the lesser vector comes first in the first codebook, a
null id last; with fewer rows than entries the codebook has as many as there are rows; of equal distances the lower
entry is nearest; an entry without parts stays; an empty table gives no rows; other columns are handed on, whatever their names. Errors beyond
64 bits are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import salted_lookup, written
from .vectors import finite, longest, whole

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows whose parts are searched together.
BLOCK = 4096
HEX = np.array([f"{i:02x}" for i in range(256)])


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


class Book:
    """A codebook with each entry's list of all entries by distance (equal distances: by number)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.between = _squared(entries[:, None, :], entries[None, :, :])
        self.lists = np.argsort(self.between, axis=1, kind="stable")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row of x: the nearest, of equal ones the lowest."""
        k = len(self.entries)
        now, best = np.zeros(len(x), np.int64), _squared(x, self.entries[0])
        seen = np.zeros((len(x), k), bool)
        seen[:, 0] = True
        at, going = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(going):
            other = self.lists[now[going], at[going]]
            # twice the distance is four times its square; at exactly that an entry can still be as near
            near = (self.between[now[going], other] <= 4 * best[going]).astype(bool)
            going, other = going[near], other[near]
            new = ~seen[going, other]
            some, entry = going[new], other[new]
            seen[some, entry] = True
            d = _squared(x[some], self.entries[entry])
            better = ((d < best[some]) | ((d == best[some]) & (entry < now[some]))).astype(bool)
            at[going] += 1
            jump = some[better]
            now[jump], best[jump], at[jump] = entry[better], d[better], 0
            going = going[at[going] < k]
        return now, best


def _exact(x: np.ndarray, most: int) -> np.ndarray:
    """x with room for squared distances between components of up to ``most``."""
    return x.astype(object) if 16 * max(1, x.shape[-1]) * most * most >= 2**62 else x


def _parts(column: pa.Array, dims: int, parts: int, scale: int, most: int) -> np.ndarray:
    """(rows, parts, width): whole components, with zeros up to a multiple of parts."""
    return _exact(whole(column, dims, scale), most).reshape(len(column), parts, dims // parts)


class Codebooks:
    """entries: (parts, entries, width) of whole numbers. most: no component is larger."""

    def __init__(self, entries: np.ndarray, scale: int, most: int):
        self.entries, self.scale, self.most = entries, scale, most

    @property
    def dims(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def books(self) -> list[Book]:
        return [Book(e) for e in self.entries]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _first(df: DataFrame, id_col: str, vector: str, parts: int, entries: int, scale: int) -> Codebooks:
    low, high = df.select(F.array_min(vector).alias("a"), F.array_max(vector).alias("b")).agg(F.min("a"), F.max("b")).first()
    most = 0 if low is None else int(max(abs(low), abs(high)) * scale) + 1
    dims = -(-max(1, longest(df, vector)) // parts) * parts
    heads = df.select(F.col(id_col), F.col(vector).cast("array<double>").alias("v")).orderBy(F.col(id_col).asc_nulls_last(), "v").limit(entries).toArrow().combine_chunks()
    if not heads.num_rows:
        return Codebooks(np.zeros((parts, 0, dims // parts), np.int64), scale, most)
    return Codebooks(_parts(heads["v"].chunk(0), dims, parts, scale, most).transpose(1, 0, 2), scale, most)


def train(df: DataFrame, id_col: str, vector: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks after ``rounds`` rounds over all usable rows of df."""
    if entries > len(HEX):
        raise ValueError(f"codes of two hexadecimal digits tell at most {len(HEX)} entries apart")
    rows = df.filter(finite(F.col(vector)))
    books = _first(rows, id_col, vector, parts, entries, scale)
    for _ in range(rounds if books.entries.shape[1] else 0):
        books = _moved(rows.select(F.col(vector).cast("array<double>").alias("v")), books)
    return books


def _moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """books with every entry at the floor of the mean of the parts that are nearest to it."""
    held = rows.sparkSession.sparkContext.broadcast((books.entries, books.scale, books.most))
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codebooks(*held.value)
        search = own.books()
        n = np.zeros((parts, entries), np.int64)
        sums = np.zeros((parts, entries, width), object)
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                x = _parts(batch.column(0).slice(a, BLOCK), own.dims, parts, own.scale, own.most)
                for p, book in enumerate(search):
                    code, _ = book.nearest(x[:, p])
                    n[p] += np.bincount(code, minlength=entries)
                    some = np.zeros((entries, width), x.dtype)
                    np.add.at(some, code, x[:, p])
                    sums[p] += some
        if n.any():
            at = np.indices(sums.shape).reshape(3, -1)
            yield pa.RecordBatch.from_arrays([*(pa.array(i, pa.int32()) for i in at), pa.array(np.repeat(n.ravel(), width)), pa.array([str(s) for s in sums.ravel()])], ["part", "entry", "place", "n", "total"])

    found = rows.mapInArrow(run, "part int, entry int, place int, n long, total string").groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = books.entries.copy()
    for part, entry, place, n, total in found.collect():  # parts x entries x components, whatever the table's size
        if n:
            out[part, entry, place] = int(total) // n
    return Codebooks(out, books.scale, books.most)


def encode(df: DataFrame, vector: str, books: Codebooks) -> DataFrame:
    """The usable rows of df with ``code`` and ``error`` (the squared distances of all parts) as the last two columns."""
    held = df.sparkSession.sparkContext.broadcast((books.entries, books.scale, books.most))
    parts = books.entries.shape[0]
    rows = df.filter(finite(F.col(vector)))
    fields = [f"c{i}" for i in range(len(df.columns))]
    at = df.columns.index(vector)
    plain = rows.toDF(*fields).withColumn("v", F.col(fields[at]).cast("array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codebooks(*held.value)
        search = own.books()
        for batch in batches:
            codes, errors = [], []
            for a in range(0, batch.num_rows, BLOCK):
                x = _parts(batch.column(len(fields)).slice(a, BLOCK), own.dims, parts, own.scale, own.most)
                near = [book.nearest(x[:, p]) for p, book in enumerate(search)]
                codes += map("".join, HEX[np.stack([c for c, _ in near], axis=1)].tolist())
                errors += sum(e.astype(object) for _, e in near).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], pa.array(codes, pa.string()), pa.array(errors, pa.int64())], [*fields, "code", "error"])

    schema = T.StructType([*plain.schema.fields[:-1], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return plain.mapInArrow(run, schema).toDF(*df.columns, "code", "error")


def with_group_error(codes: DataFrame, label: Column, out: str, spread: str) -> DataFrame:
    """codes (with error) and the error summed over rows of equal labels, nulls together. spread: a column that differs among the rows of a label."""
    keyed = codes.withColumn("_label", F.coalesce(F.concat(F.lit("="), label.cast("string")), F.lit("")))
    sums = keyed.groupBy("_label").agg(F.sum("error").alias(out))
    return salted_lookup(keyed, sums, "_label", spread).drop("_label")


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    books = train(df, "vec_id", "embedding")
    codes = written(encode(df, "embedding", books).select("vec_id", "label", "code", "error"), "codes")
    return with_group_error(codes, F.col("label"), "label_error", "vec_id").select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _oracle() -> str:
    """The rounds one after another, as SQL tables: entries as rows of (part, entry, place, value)."""
    rounds = []
    for i in range(1, ROUNDS + 2):
        rounds.append(f"""d{i} AS MATERIALIZED (SELECT x.vec_id, x.part, b.entry, sum((x.value - b.value) * (x.value - b.value))::BIGINT AS d FROM x JOIN b{i} b USING (part, place) GROUP BY ALL),
  a{i} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM d{i} GROUP BY ALL)""")
        if i <= ROUNDS:
            rounds.append(f"""b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.place, coalesce(floor(sum(x.value) / count(x.value))::BIGINT, any_value(b.value)) AS value
    FROM b{i} b LEFT JOIN a{i} a ON a.part = b.part AND a.entry = b.entry LEFT JOIN x ON x.vec_id = a.vec_id AND x.part = a.part AND x.place = b.place GROUP BY ALL)""")
    last = ROUNDS + 1
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, embedding AS e, len(embedding) // {PARTS} AS width FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  u AS (SELECT vec_id, width, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS i FROM v),
  x AS MATERIALIZED (SELECT vec_id, i // width AS part, i % width AS place, floor({SCALE} * x::DOUBLE)::BIGINT AS value FROM u),
  h AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < {ENTRIES}),
  b1 AS MATERIALIZED (SELECT part, entry, place, value FROM x JOIN h USING (vec_id)),
  {", ".join(rounds)},
  c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(value::VARCHAR, ',' ORDER BY part, entry, place)) FROM b{last}) AS codebooks_sha256 FROM c JOIN v USING (vec_id)"""


ORACLE = _oracle()
