"""Exact deduplication of an incoming batch against an immutable snapshot.

Texts are equal when identical after each run of space and 0x09-0x0D becomes one
space; null counts as empty. The snapshot's distinct digests are dealt into buckets
and each bucket gets one static binary fuse filter. Digests of the batch, grouped
among themselves first, are screened by the filter of their bucket; what passes
joins the exact snapshot digests, and the two texts are compared in full.

Defined results: an empty table gives no rows; null and empty texts are one group;
a null doc_id is a keeper only where its whole group has none; rows that repeat the
keeper's doc_id and text are all flagged kept, and ``drop_duplicates`` leaves one of
them; a very long text is normalised, hashed and compared whole, within its row; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fuse_filter
from .shared import partitions, salted_lookup, written

#: Distinct snapshot digests a filter holds: about 230 kB of slots.
KEYS_PER_FILTER = 200_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"))


def groups(rows: DataFrame, keep: str, size: str) -> DataFrame:
    """One row for each digest; copies meet in partial sums before the shuffle."""
    return rows.groupBy("digest").agg(F.min("doc_id").alias(keep), F.count(F.lit(1)).alias(size))


def _keys(column: pa.Array) -> np.ndarray:
    """The first 8 bytes of 32-byte digests."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), 4)[:, 0] if len(column) else np.zeros(0, np.uint64)


def screen(snapshot: DataFrame, incoming: DataFrame, keys_per_filter: int = KEYS_PER_FILTER) -> DataFrame:
    """The incoming digests that a filter of the snapshot's digests lets pass (all true members, 1/256 of the others)."""
    buckets = max(1, snapshot.count() // keys_per_filter + 1)
    bucket = F.pmod(F.conv(F.hex(F.substring("digest", 9, 4)), 16, 10).cast("long"), F.lit(buckets)).cast("int")
    both = snapshot.select(bucket.alias("bucket"), F.lit(0).alias("side"), "digest").unionByName(incoming.select(bucket.alias("bucket"), F.lit(1).alias("side"), "digest"))
    schema = "digest binary"

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, filt = None, [], None
        for batch in batches:
            buckets_, sides = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(buckets_) | np.diff(sides)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(buckets_)], strict=True):
                if a == b:
                    continue
                if buckets_[a] != now:
                    now, held, filt = buckets_[a], [], None
                part = batch.column(2).slice(a, b - a)
                keys = _keys(part)
                if sides[a] == 0:
                    held.append(keys)
                    continue
                if held and filt is None:
                    filt = fuse_filter.build(np.concatenate(held))
                if filt is not None:
                    yield pa.RecordBatch.from_arrays([part.filter(pa.array(fuse_filter.contains(keys, *filt)))], ["digest"])

    return both.repartition(partitions(both.sparkSession), "bucket").sortWithinPartitions("bucket", "side").mapInArrow(probe, schema)


def exact_dedup(docs: DataFrame, is_snapshot: Column | None = None, id_col: str = "doc_id", text_col: str = "text", keys_per_filter: int = KEYS_PER_FILTER) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept) for every row of docs.

    is_snapshot tells the immutable rows from the new batch by doc_id; without it the
    rows up to the median doc_id are the snapshot. A snapshot keeper wins over the batch.
    """
    rows = written(digests(docs, id_col, text_col), "digests")
    if is_snapshot is None:
        middle = rows.select(F.percentile_approx("doc_id", 0.5, 1000)).first()[0]
        is_snapshot = F.col("doc_id") <= F.lit(middle).cast("long")
    is_snapshot = F.coalesce(is_snapshot, F.lit(False))
    old = written(groups(rows.filter(is_snapshot), "old_keep", "old_size"), "snapshot")
    new = written(groups(rows.filter(~is_snapshot), "new_keep", "new_size"), "batch")
    found = written(screen(old, new, keys_per_filter).join(old, "digest").join(new, "digest"), "positives")
    # whole texts of both keepers, compared byte by byte
    keepers = found.select("digest", F.col("old_keep").alias("doc_id")).unionByName(found.select("digest", F.col("new_keep").alias("doc_id"))).filter("doc_id is not null")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("body"))
    same = (
        keepers.hint("merge").join(texts, "doc_id")
        .filter(F.unhex(F.sha2("body", 256)) == F.col("digest"))
        .groupBy("digest")
        .agg((F.min("body") == F.max("body")).alias("same"))
    )
    met = found.join(same, "digest", "left").filter(F.coalesce("same", F.lit(True))).select("digest", F.col("old_keep").alias("met_keep"), F.col("old_size").alias("met_size"))
    olds = old.join(new, "digest", "left").select("digest", F.lit(True).alias("side"), F.col("old_keep").alias("keep_id"), "old_size", F.coalesce("new_size", F.lit(0)).alias("other"))
    news = new.join(met, "digest", "left").select("digest", F.lit(False).alias("side"), F.coalesce("met_keep", "new_keep").alias("keep_id"), F.col("new_size").alias("old_size"), F.coalesce("met_size", F.lit(0)).alias("other"))
    # an old group counts the batch's rows only if the byte check held
    olds = olds.join(met.select("digest", F.lit(True).alias("held")), "digest", "left").withColumn("other", F.when(F.col("held"), F.col("other")).otherwise(0)).drop("held")
    dims = olds.unionByName(news).select(F.concat("digest", F.when(F.col("side"), F.lit(b"\x01")).otherwise(F.lit(b"\x00"))).alias("group_key"), "keep_id", (F.col("old_size") + F.col("other")).alias("group_size"))
    keyed = rows.withColumn("group_key", F.concat("digest", F.when(is_snapshot, F.lit(b"\x01")).otherwise(F.lit(b"\x00"))))
    out = salted_lookup(keyed, dims, "group_key", "doc_id").drop("group_key")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def drop_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, one of each group, with the columns of docs."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    keep = exact_dedup(docs, **options).filter("kept").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct()
    marked = docs.withColumns({"__id": F.col(id_col).cast("long"), "__digest": F.unhex(F.sha2(normalised(F.col(text_col)), 256))})
    right = keep.withColumnsRenamed({"__id": "__kept_id", "__digest": "__kept_digest"})
    stays = marked.join(right, F.col("__id").eqNullSafe(F.col("__kept_id")) & (F.col("__digest") == F.col("__kept_digest")), "left_semi")
    return stays.dropDuplicates(["__id", "__digest"]).drop("__id", "__digest")


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
