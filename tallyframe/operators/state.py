"""Indicator state: subjects, snapshots, lookups and their clean-up."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import composite_key, human_duration

STATE_FIELDS = (
    "subject string, custom_subject string, key string, window_ms bigint, fixed boolean, record string, count bigint, amount double, values map<string,double>, arg_list array<string>, arg_set array<string>, "
    "last string, sums map<string,array<bigint>>, window_end bigint, as_of bigint"
)


class State(NamedTuple):
    """What rows leave to go on from. records: one row of each key and record (STATE_FIELDS); tail: the rows that sliding windows still hold."""

    records: DataFrame
    tail: DataFrame

    def write(self, folder: str) -> None:
        self.records.write.mode("overwrite").parquet(f"{folder}/records")
        self.tail.write.mode("overwrite").parquet(f"{folder}/tail")


def read_state(spark: SparkSession, folder: str) -> State:
    return State(spark.read.schema(STATE_FIELDS).parquet(f"{folder}/records"), spark.read.parquet(f"{folder}/tail"))


def fan_out(df: DataFrame, custom: dict[str, list[str]] | None = None) -> DataFrame:
    """One row for each subject of a transaction (subject, custom_subject, key); null keys give none."""
    kinds = [F.struct(F.lit("Card").alias("subject"), F.lit(None).cast("string").alias("custom_subject"), F.col("card_id").cast("string").alias("key")), F.struct(F.lit("Merchant").alias("subject"), F.lit(None).cast("string").alias("custom_subject"), F.col("merchant").cast("string").alias("key"))]
    for name, columns in (custom or {}).items():
        kinds.append(F.struct(F.lit("Custom").alias("subject"), F.lit(name).alias("custom_subject"), composite_key(*(F.expr(c).cast("string") for c in columns)).alias("key")))
    return df.select("*", F.explode(F.array(*kinds)).alias("_s")).select("*", "_s.*").drop("_s").filter("key is not null")


def latest(df: DataFrame, keys: list[str], values: list[str], at: str = "us", tie: str = "transaction_no") -> DataFrame:
    """The values of each key's last row, by partial aggregates."""
    row = F.max_by(F.struct(*(F.col(v) for v in values), F.col(at).alias("as_of")), F.struct(at, tie))
    return df.groupBy(*keys).agg(row.alias("_r")).select(*keys, "_r.*")


def query_indicators(requests: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Each request's indicators: those of its key with its time frame (null or 0: all), and the key's global records.

    requests: request_id, subject, custom_subject, key, timeframe. snapshot: subject, custom_subject, key, window_ms
    (null: global), record, count, amount, and where it has them values, arg_list, arg_set and last, which are answered too. A request without subject is answered by an error; one
    without indicators by a row without a name.
    """
    wrong = requests.filter("subject is null").select("request_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("count"), F.lit(None).cast("double").alias("amount"), F.lit("subject is missing").alias("error_message"))
    more = [c for c in ("values", "arg_list", "arg_set", "last") if c in snapshot.columns]
    r, s = requests.filter("subject is not null").alias("r"), snapshot.alias("s")
    same = F.expr("r.subject = s.subject and lower(coalesce(r.custom_subject, '')) = lower(coalesce(s.custom_subject, '')) and r.key = s.key")
    wanted = F.expr("s.window_ms is null or coalesce(r.timeframe, 0) = 0 or r.timeframe = s.window_ms")
    name = F.when(F.col("s.window_ms").isNull(), F.col("s.record")).otherwise(F.concat(F.col("s.record"), F.lit("-"), human_duration(F.col("s.window_ms"))))
    more += ["fixed"] if "fixed" in snapshot.columns else []
    found = r.join(s, same & wanted, "left").select("r.request_id", name.alias("name"), F.col("s.count"), F.col("s.amount"), *(F.col(f"s.{c}") for c in more), F.lit(None).cast("string").alias("error_message"))
    return found.unionByName(wrong, allowMissingColumns=True)


def purge(snapshot: DataFrame, subjects: list[str]) -> DataFrame:
    """The snapshot without the state of some subjects."""
    return snapshot.filter(~F.coalesce("custom_subject", "subject").isin(*subjects))


def tail(df: DataFrame, longest_ms: int, at: str = "us") -> DataFrame:
    """The rows that a window may still hold after the last row of df: what has to be kept to go on with sliding windows."""
    last = df.agg(F.max(at)).first()[0]
    return df.filter(F.col(at) >= (last or 0) - longest_ms * 1000)


def resume(df: DataFrame, snapshot: DataFrame, key: str, measures: dict[str, Column], at: str = "us", tie: str = "transaction_no") -> DataFrame:
    """Running totals of each key that continue from a snapshot (key and a column for each measure); new keys start at 0."""
    from .windows import global_record

    held = snapshot.select(key, *(F.col(m).alias(f"_held_{m}") for m in measures))
    out = global_record(df, [key], measures, at, tie).join(held, key, "left")
    return out.withColumns({m: F.col(m) + F.coalesce(f"_held_{m}", F.lit(0)) for m in measures}).drop(*(f"_held_{m}" for m in measures))


def new_values(df: DataFrame, keys: list[str], values: str, at: str = "us", tie: str = "transaction_no") -> DataFrame:
    """df with what its array ``values`` has that the key's row before had not: as a set, and as a list with repeats."""
    before = F.coalesce(F.lag(values).over(Window.partitionBy(*keys).orderBy(at, tie)), F.array().cast("array<string>"))
    return df.withColumn("_before", before).withColumns({"new_set": F.array_except(values, "_before"), "new_list": F.filter(values, lambda x: ~F.array_contains("_before", x))}).drop("_before")
