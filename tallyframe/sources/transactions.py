"""Transactions, rules and requests as tables; rows that can't be used go to an error output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import micros

EVENTS = T.StructType().add("event_id", "long").add("ts", "timestamp_ntz").add("user_id", "long").add("event_type", "string").add("value", "double").add("props", "string")

#: Where a transaction's fields are found in the events table.
EVENT_MAPPING = {"transaction_no": "event_id", "card_id": "user_id", "merchant": "event_type", "amount": "value", "ts": "ts", "argument": "get_json_object(props, '$.k')", "payload": "props"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normalise(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """A transaction's fields by SQL expressions, cast to their types; ``us`` is the event time in microseconds."""
    get = lambda name, kind: F.expr(mapping.get(name, "null")).cast(kind)
    plain = {"transaction_no": "long", "card_id": "string", "merchant": "string", "amount": "double", "argument": "string", "payload": "string", "topic": "string", "correlation_id": "string", "client_ts": "string", "recv_ts": "string"}
    columns = [get(n, k).alias(n) for n, k in plain.items() if n in mapping]
    time = event_time(*(F.expr(mapping[n]) for n in ("ts", "event_ts") if n in mapping))
    return df.select(*columns, time.alias("ts"), micros(time).alias("us"))


def event_time(*candidates: Column) -> Column:
    """The first time that is set, else the time of processing."""
    return F.coalesce(*(c.cast("timestamp") for c in candidates), F.current_timestamp())


def read_transactions(spark: SparkSession, sf_dir: str, streaming: bool = False, mapping: dict[str, str] | None = None) -> DataFrame:
    """Transactions from the events table, as a batch or as a stream of its files, also those that come later if it is a folder."""
    # a stream's path is a pattern, since the source takes a plain path for a folder
    df = spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events.parque[t]") if streaming else table(spark, sf_dir, "events")
    return normalise(df, mapping or EVENT_MAPPING)


def receive_delay(client_ms: Column, received_ms: Column, processed_ms: Column) -> Column:
    """Milliseconds from publishing to receiving; null if the publishing time is missing."""
    return F.coalesce(received_ms, processed_ms) - client_ms


def split_errors(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with error and error_message): the first check that a row fails is named."""
    message = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for text, ok in checks.items()))
    marked = df.withColumn("error_message", message)
    good = marked.filter("error_message is null").drop("error_message")
    return good, marked.filter("error_message is not null").withColumn("error", F.lit(True))



def transaction_checks() -> dict[str, Column]:
    return {"transaction number is missing": F.col("transaction_no").isNotNull(), "card is missing": F.col("card_id").isNotNull(), "amount is not positive": F.col("amount") > 0}


RULE_FIELDS = (
    "ruleset string, version string, rule_title string, rule_group string, rule_type string, subject string, custom_subject string, time_frame bigint, unit_ms bigint, fixed_window boolean, "
    "record string, scope string, filter_sql string, amount_sql string, value_sqls map<string,string>, arg_sql string, last_sql string, condition_sql string, message string, action string"
)


def read_rules(rules: DataFrame, ruleset: str, version: str) -> DataFrame:
    """The rules of one version of a ruleset; none at all is an error."""
    found = rules.filter((F.col("ruleset") == ruleset) & (F.col("version") == version))
    if found.isEmpty():
        raise ValueError(f"ruleset {ruleset}:{version} has no rules")
    return found
