"""Small helpers that several operators use."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import discard, written  # noqa: F401


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """mapInArrow with state per task: make() is called once in each task, its result for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            yield from step(batch)

    return df.mapInArrow(run, schema)


def salted_lookup(rows: DataFrame, dims: DataFrame, key: str, spread: str, salts: int = 64) -> DataFrame:
    """rows left-joined to dims (one row a key) so that a hot key is spread over ``salts`` tasks.

    The distinct (key, salt) pairs are aggregated before their shuffle and meet dims
    at most ``salts`` times a key; rows then join on (key, salt).
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    spreads = salted.select(key, "_salt").distinct().join(dims, key)
    return salted.join(spreads, [key, "_salt"], "left").drop("_salt")
