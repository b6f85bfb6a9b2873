"""Streaming jobs: stateful indicators, tumbling windows, rule reloads, and how to run them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.alerts import alert_array, union_alerts, with_status
from ..operators.gate import deployment_gate
from ..operators.records import Record, records, slot_columns
from ..operators.rules import Rule, check, failures, from_table, part_name, tried
from ..operators.state import query_indicators
from ..operators.sums import MONEY, parts
from ..plans.engine import in_force, state_row, subject_keys
from ..sources.folders import exists, shared_folder
from ..sources.transactions import read_rules
from .processors import SHARDS, Records, Shards, Spec, latest_rows, packed, spread, unpacked

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: A row may hold the rows of a key, so batches of rows have a bound in bytes too.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    mine = {PROVIDER: ROCKSDB, BATCH_BYTES: str(64 << 20)}
    before = {k: spark.conf.get(k, None) for k in mine}
    for k, v in mine.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _cents() -> Column:
    return parts(F.coalesce(F.col("amount").try_cast(MONEY), F.lit(0).cast(MONEY)), MONEY)[0]


def kept(stream: DataFrame, keys: list[str], sums: dict[str, Column], specs: dict[str, Spec], payload: list[str], order: str = "arrival", delay: str = "0 seconds", lists: dict[str, tuple[str, Column]] | None = None, lasts: dict[str, tuple[str, Column]] | None = None, idle_ms: int | None = None, peers: bool = False, wanted: set[str] | None = None) -> DataFrame:
    """keys, payload and the sums of each row's windows after it, from keyed state. sums: long columns, null counts as 0.

    lists, lasts: name to (part, column), for the sorted list of a window's texts (arrays of them) and its last text; null brings none. idle_ms, peers: as in Records.
    wanted: columns of sums that are enough, where others cost something.
    """
    lists, lasts = lists or {}, lasts or {}
    late = order == "event_time"
    rows = stream.select(*keys, *dict.fromkeys([*payload, "us", "transaction_no"]), F.array(*(F.coalesce(c, F.lit(0)).cast("long") for c in sums.values())).alias("_sums"), *(c.alias(n) for n, (_, c) in (lists | lasts).items()), *(["ts"] if late else []))
    rows = rows.withWatermark("ts", delay) if late else rows
    shared = not late and idle_ms is None and all(rows.schema[k].dataType in (T.StringType(), T.LongType(), T.IntegerType()) for k in keys)
    held = (Shards if shared else Records)(specs, keys, payload, list(sums), late, {n: p for n, (p, _) in lists.items()}, {n: p for n, (p, _) in lasts.items()}, idle_ms, peers)
    if shared and wanted is not None:
        held.wanted = frozenset(wanted)
    if not late:
        groups = ["_shard"] if shared else keys
        rows = rows.withColumn("_shard", F.pmod(F.hash(*keys), F.lit(SHARDS))) if shared else rows
        out = packed(rows, groups).groupBy(*groups).transformWithState(held, "`_rows` binary", "Append", "None" if idle_ms is None else "ProcessingTime")
        long, texts = T.LongType(), T.StringType()
        return spread(out, [*(rows.schema[c] for c in (*keys, *payload)), *(T.StructField(n, long) for n in held.longs), *(T.StructField(n, T.ArrayType(texts)) for n in lists), *(T.StructField(n, texts) for n in lasts)])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    fields = [*(f"`{c}` {kinds[c]}" for c in [*keys, *payload]), "`_sums` binary", *(f"`{n}` array<string>" for n in lists), *(f"`{n}` string" for n in lasts)]
    out = rows.groupBy(*keys).transformWithState(held, ", ".join(fields), "Append", "EventTime")
    return unpacked(out, held.longs, [*keys, *payload, *held.longs, *lists, *lasts])


def sliding(stream: DataFrame, keys: list[str], windows: dict[str, int], order: str = "arrival", delay: str = "0 seconds", idle_ms: int | None = None) -> DataFrame:
    """Counts and amounts of each transaction's key over sliding windows (name to ms)."""
    out = kept(stream, keys, {"n": F.lit(1), "cents": _cents()}, {"": Spec(windows, {}, None)}, ["transaction_no", "us"], order, delay, idle_ms=idle_ms)
    return out.select(F.concat_ws("|", *keys).alias("key"), "transaction_no", "us", *(c for w in windows for c in (F.col(f"n_{w}"), (F.col(f"cents_{w}") / 100).alias(f"amount_{w}"))))


def fixed(stream: DataFrame, keys: list[str], window_ms: int, order: str = "arrival", delay: str = "0 seconds") -> DataFrame:
    """Running count and amount of a window that opens at a key's first row and reopens past its end."""
    out = kept(stream, keys, {"n": F.lit(1), "cents": _cents()}, {"": Spec({}, {"w": window_ms}, None)}, ["transaction_no", "us"], order, delay)
    return out.select("transaction_no", "us", F.col("start_w").alias("window_start"), F.col("n_w").alias("n"), (F.col("cents_w") / 100).alias("amount"))


def unbounded(stream: DataFrame, keys: list[str], order: str = "arrival", delay: str = "0 seconds") -> DataFrame:
    """Running count and amount since the key's first row."""
    out = kept(stream, keys, {"n": F.lit(1), "cents": _cents()}, {"": Spec({}, {}, "all")}, ["transaction_no", "us"], order, delay)
    return out.select("transaction_no", "us", F.col("n_all").alias("n"), (F.col("cents_all") / 100).alias("amount"))


SUBJECT = ["subject", "custom_subject", "key"]


def indicators(stream: DataFrame, rules: list[Rule], custom: dict[str, list[str]] | None = None, order: str = "arrival", delay: str = "0 seconds", idle_ms: int | None = None, peers: bool = False) -> DataFrame:
    """One row for each transaction and subject with the indicators of that subject's COMPUTE rules, as engine.with_indicators names them.

    Card, merchant and custom subjects, sliding, fixed and unbounded records with counts, amounts and named values, lists and sets in
    windows, and last values. A transaction without any key has one row, of subject None.
    """
    recs = records(rules, stream)
    specs = {}
    for n in dict.fromkeys(r.owner for r in recs):
        own = [r for r in recs if r.owner == n]
        slots = dict.fromkeys(s for r in own for m in r.measures for s in m.slots)
        specs[n] = Spec({r.part: r.window_ms for r in own if r.window_ms and not r.fixed}, {r.part: r.window_ms for r in own if r.fixed}, next((r.part for r in own if r.window_ms is None), None), tuple(slots))
    keys = subject_keys(rules, custom or {})
    found = F.filter(F.array(*(F.struct(F.lit(n).alias("subject"), k.cast("string").alias("key")) for n, k in keys.items())), lambda x: x["key"].isNotNull())
    alone = F.array(F.struct(F.lit("none").alias("subject"), F.concat(F.lit("\0"), F.coalesce(F.col("transaction_no").cast("string"), F.lit(""))).alias("key")))
    fanned = stream.withColumn("_s", F.explode(F.when(F.size(found) > 0, found).otherwise(alone))).select("*", "_s.*").drop("_s")
    mine = lambda r, c: (r.part, F.when(F.col("subject") == r.owner, c))
    lists = {r.column("list"): mine(r, r.texts()) for r in recs if r.lists}
    lasts = {r.column("last"): mine(r, r.last()) for r in recs if r.lasts}
    payload = [c for c in stream.columns if c not in ("ts", *SUBJECT)]
    out = kept(fanned, ["subject", "key"], slot_columns(recs), specs, payload, order, delay, lists, lasts, idle_ms, peers, wanted={f"{s}_{r.part}" for r in recs for m in r.measures for s in m.slots})
    done: dict[str, Column] = {}
    for r in recs:
        done |= r.finished({s: F.col(f"{s}_{r.part}") for m in r.measures for s in m.slots})
        if r.lists:
            done[r.column("set")] = F.array_distinct(r.column("list"))
    return out.select("subject", "key", *payload, *(c.alias(n) for n, c in done.items()), *lists, *lasts, *(c for c in out.columns if c.startswith("start_")))


def alert_sets(rows: DataFrame, rules: list[Rule], custom: dict[str, list[str]], example: DataFrame) -> DataFrame:
    """transaction_no, alerts, alert_status, score and rule_errors of the rows of ``indicators``: each subject judged by its own rules, and their alerts merged.

    A rule that fails its check is left out and named in the rule_errors of all rows. example: rows with the columns of the transactions.
    """
    rules, bad = in_force(rules, example, custom)
    alerting = [r for r in rules if r.kind == "ALERT"]
    keys = subject_keys(rules, custom)
    held = {r: F.col(f"_tried_{i}") for i, r in enumerate(alerting)}
    rows = rows.withColumns({f"_tried_{i}": F.when(F.col("subject") == (r.custom_subject or r.subject).lower(), tried(r)) for i, r in enumerate(alerting)}) if alerting else rows
    parts_, errors = [], []
    for n in dict.fromkeys((r.custom_subject or r.subject).lower() for r in rules):
        own = [r for r in alerting if (r.custom_subject or r.subject).lower() == n]
        parts_.append(F.when(F.col("subject") == n, alert_array(own, keys, held)))
        errors.append(F.when(F.col("subject") == n, failures([r for r in rules if (r.custom_subject or r.subject).lower() == n], example, held)))
    none = alert_array([], {})
    each = rows.select("transaction_no", F.coalesce(*parts_, none).alias("alerts"), F.concat(F.coalesce(*errors, F.array().cast("array<string>")), F.array(*(F.lit(t) for t in bad)).cast("array<string>")).alias("rule_errors"))
    # a transaction has one row for each subject, so its group is small
    met = each.groupBy("transaction_no").agg(F.flatten(F.collect_list("alerts")).alias("alerts"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("rule_errors")))).alias("rule_errors"))
    return with_status(met.withColumn("alerts", union_alerts(F.col("alerts"))), len(alerting)).select("transaction_no", "alerts", "alert_status", "score", "rule_errors")


ANSWERS = "transaction_no long, alerts array<struct<rule_title:string,message:string,action:string,subject:string,key:string,window_ms:bigint>>, alert_status string, score double, rule_errors array<string>"
#: Of the state and the folders of a job; a job of another layout isn't gone on with.
LAYOUT = 7


class Job:
    """The main path on a stream, in a folder of its own: checkpoint, answers, alert sets (``alerts``), and a note of what its state holds.

    The ALERT rules are asked for anew in each micro-batch, which is judged by one version. COMPUTE rules shape the state; a job
    that is started again in its folder goes on where it stopped, with other COMPUTE rules too: records that stay go on, new ones begin. A
    micro-batch writes its answers, and apart from them those with alerts, to folders of its own and then a mark; one that comes again after a
    loss finds its mark and writes nothing, or replaces what is incomplete, so every answer is there once.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.query = spark, folder.rstrip("/"), None

    def start(self, stream: DataFrame, compute: list[Rule], alerting: Callable[[], list[Rule]], custom: dict[str, list[str]] | None = None, order: str = "arrival", delay: str = "0 seconds", idle_ms: int | None = None, trigger: dict | None = None, peers: bool = False) -> Job:
        """Go on, or begin, with stream. trigger: as of DataStreamWriter.trigger; the default reads all that there is and stops. idle_ms, peers: as in Records."""
        if idle_ms is not None and (trigger or {"availableNow": True}).get("availableNow"):
            raise ValueError("idle keys leave by timers of processing time, which need a trigger that goes on")
        compute, custom = [r for r in compute if r.kind == "COMPUTE"], custom or {}
        self._note(stream, compute, custom)
        example = self.spark.createDataFrame([], stream.schema)

        def batch(df: DataFrame, number: int) -> None:
            if exists(self.spark, f"{self.folder}/done/batch={number}"):
                df.write.format("noop").mode("overwrite").save()  # the state has to take its step again
                return
            done = alert_sets(df, [*compute, *alerting()], custom, example).persist()
            done.write.mode("overwrite").parquet(f"{self.folder}/answers/batch={number}")
            done.filter(F.size("alerts") > 0).write.mode("overwrite").parquet(f"{self.folder}/alerts/batch={number}")
            done.unpersist()
            self.spark.range(1).select(F.lit(number).alias("n")).write.mode("overwrite").parquet(f"{self.folder}/done/batch={number}")

        with _rocksdb(self.spark):
            every = [*compute, *(r for r in alerting() if r.subject == "Custom" or (r.subject not in {c.subject for c in compute}))]
            every = [r for r in every if r.subject != "Custom" or r.custom_subject and r.custom_subject.lower() in {c.lower() for c in custom}]
            rows = indicators(stream, every, custom, order, delay, idle_ms, peers)
            self.query = rows.writeStream.foreachBatch(batch).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
        return self

    def wait(self) -> Job:
        self.query.awaitTermination()
        return self

    def stop(self) -> None:
        self.query.stop()

    def answers(self, name: str = "answers") -> DataFrame:
        """What all finished micro-batches have answered (``alerts``: only what has alerts), with the number of the batch."""
        done = self.spark.read.schema("n long, batch int").parquet(f"{self.folder}/done").select("batch") if exists(self.spark, f"{self.folder}/done") else self.spark.createDataFrame([], "batch int")
        if not exists(self.spark, f"{self.folder}/{name}"):
            return self.spark.createDataFrame([], f"{ANSWERS}, batch int")
        return self.spark.read.schema(f"{ANSWERS}, batch int").parquet(f"{self.folder}/{name}").join(done, "batch", "left_semi").select(*(c.split()[0] for c in ("transaction_no", "alerts", "alert_status", "score", "rule_errors", "batch")))

    def state(self, batch: int | None = None) -> DataFrame:
        """The records of all keys after the last micro-batch that the job has committed (or an earlier one that is still kept), as of each key's last
        event; read from the checkpoint, also of a job that is running, for state.query_indicators."""
        note = json.loads(self._noted()[-1])
        example = self.spark.createDataFrame([], T.StructType.fromJson(note["columns"]))
        rules = [Rule(**{k: tuple(map(tuple, v)) if k == "value_sqls" else v for k, v in r.items()}) for r in note["rules"]]
        return saved_records(self.spark, f"{self.folder}/checkpoint", records(rules, example), batch)

    def _noted(self) -> list[str]:
        path = f"{self.folder}/notes"
        return [r.value for r in self.spark.read.json(path, "n long, value string").orderBy("n").collect()] if exists(self.spark, path) else []

    def _note(self, stream: DataFrame, compute: list[Rule], custom: dict[str, list[str]]) -> None:
        """Keep the layout, the stream's columns and the COMPUTE rules; a few rows, one for each change of rules."""
        before = self._noted()
        now = json.dumps({"layout": LAYOUT, "columns": json.loads(stream.schema.json()), "rules": [asdict(r) for r in compute], "custom": custom}, sort_keys=True)
        if before and json.loads(before[-1])["layout"] != LAYOUT:
            raise ValueError(f"the job in {self.folder} has layout {json.loads(before[-1])['layout']}, not {LAYOUT}")
        if before and json.loads(before[-1])["columns"] != json.loads(now)["columns"]:
            raise ValueError(f"the job in {self.folder} reads other columns")
        if not before or before[-1] != now:
            self.spark.createDataFrame([(len(before), now)], "n long, value string").coalesce(1).write.mode("append").json(f"{self.folder}/notes")


def scored(stream: DataFrame, compute: list[Rule], alerting: Callable[[], list[Rule]], custom: dict[str, list[str]] | None = None, order: str = "arrival", delay: str = "0 seconds") -> tuple[DataFrame, DataFrame]:
    """(answers, alert sets) of all transactions that a stream's source holds now, by a Job in a folder of its own."""
    job = Job(stream.sparkSession, f"{shared_folder(stream.sparkSession)}/scored-{uuid.uuid4().hex}").start(stream, compute, alerting, custom, order, delay).wait()
    return job.answers().drop("batch"), job.answers("alerts").drop("batch")


def saved_records(spark: SparkSession, checkpoint: str, recs: list[Record], batch: int | None = None) -> DataFrame:
    """The records of all keys in a checkpoint, in the form of engine.indicator_state."""
    reader = spark.read.format("statestore").option("stateVarName", "latest")
    with _rocksdb(spark):
        held = (reader if batch is None else reader.option("batchId", batch)).load(checkpoint)
        held = held.select("value.held") if "_shard" in held.schema["key"].dataType.names else held.select("key.subject", "key.key", "value.held")
    each = []
    for r in recs:  # all records in one pass over the state
        sums = {s: F.coalesce(F.element_at("sums", F.lit(s)), F.lit(0)) for m in r.measures for s in m.slots}
        at = lambda kind, c: F.try_element_at(kind, F.lit(r.column(c)))  # noqa: E731, B023
        counted = F.array_sort(F.map_entries(at("lists", "list")))
        texts = F.flatten(F.transform(counted, lambda e: F.array_repeat(e["key"], e["value"].cast("int"))))
        row = state_row(r, sums, texts if r.lists else None, at("lasts", "last") if r.lasts else None, F.col("ends") if r.fixed else None)
        mine = (F.col("subject") == r.owner) & (F.col("part") == r.part)
        each.append(F.when(mine, F.struct(F.lit(r.subject).alias("subject"), F.lit(r.custom).cast("string").alias("custom_subject"), "key", row.alias("r"), F.col("us").alias("as_of"))))
    found = latest_rows(held).select(F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("x"))
    return found.select("x.subject", "x.custom_subject", "x.key", "x.r.*", "x.as_of")


def answered_requests(requests: DataFrame, job: Job, folder: str, trigger: dict | None = None) -> StreamingQuery:
    """A stream of requests, each micro-batch answered from the state that a job has at that time, into a folder of its own below folder/answers."""

    def batch(df: DataFrame, number: int) -> None:
        query_indicators(df, job.state()).write.mode("overwrite").parquet(f"{folder}/answers/batch={number}")

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def active_rules(rules: Callable[[], DataFrame], deployments: Callable[[], DataFrame], ruleset: str, example: DataFrame, compute: list[Rule], custom: dict[str, list[str]] | None = None) -> tuple[str, list[Rule]]:
    """(version, its ALERT rules) in force: the newest requested version that is valid and whose rules pass the check; older ones stand in for those that fail.

    rules, deployments (ruleset, version, requested_us, valid): asked for in each call, so that a reader of files sees those that have come since.
    Versions are tried from the newest on.
    """
    wanted = deployments().filter((F.col("ruleset") == ruleset) & F.col("valid")).groupBy("version").agg(F.max("requested_us").alias("at")).orderBy(F.desc("at"), F.desc("version"))
    for (version, _) in wanted.toLocalIterator():
        try:
            found = [r for r in from_table(read_rules(rules(), ruleset, version)) if r.kind == "ALERT"]
        except ValueError:
            continue
        if not check([*compute, *found], example, custom):
            return version, found
    raise ValueError(f"ruleset {ruleset} has no version that can run")


def alerted(stream: DataFrame, subject: str, key: str, rules: list[Rule], record: str = "tx") -> DataFrame:
    """transaction_no, alerts, alert_status and score by the sliding rules of one subject, on its keyed state."""
    windows = {part_name(subject, None, r.window_ms, False): r.window_ms for r in rules}
    held = sliding(stream.filter(F.col(key).isNotNull()), [key], windows)
    named = held.withColumnsRenamed({f"{short}_{w}": f"{record}_{long}_{w}" for w in windows for short, long in (("n", "count"), ("amount", "amount"))})
    alerts = alert_array([r for r in rules if r.kind == "ALERT"], {subject.lower(): F.col("key")})
    return with_status(named.select("transaction_no", alerts.alias("alerts")), sum(r.kind == "ALERT" for r in rules))


def gated(stream: DataFrame, intervals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(transactions that go on, answers to those that a deployment postpones and that leave no trace in the state)."""
    marked = deployment_gate(stream, intervals)
    postponed = marked.filter("gate_status is not null").select("transaction_no", F.col("gate_status").alias("alert_status"), F.col("gate_action").alias("action"))
    return marked.filter("gate_status is null").drop("gate_status", "gate_action"), postponed


def answered(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, alert sets): each micro-batch writes all of its answers, and apart from them those with alerts."""
    spark = answers.sparkSession
    base = f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        df.write.mode("overwrite").parquet(f"{base}/answers/batch={number}")
        df.filter(F.size("alerts") > 0).write.mode("overwrite").parquet(f"{base}/alerts/batch={number}")
        df.unpersist()

    with _rocksdb(spark):
        answers.writeStream.foreachBatch(batch).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    read = lambda name: spark.read.schema(answers.schema).parquet(f"{base}/{name}")
    return read("answers"), read("alerts")


def tumbling(stream: DataFrame, key: str, width: str, delay: str = "1 hour") -> DataFrame:
    """Counts and amounts over calendar-aligned windows, with a watermark."""
    grouped = stream.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), key)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("amount")).select(key, F.unix_micros("w.start").alias("window_start"), "n", "amount")


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream has answered once all that its source holds is read: written as Parquet in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    with _rocksdb(spark):
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
        if mode == "complete":  # the last batch holds every group
            query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")).start()
        else:
            query = writer.format("parquet").option("path", f"{base}/out").start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def drained_to_the_end(source: DataFrame, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """drained, for a job in event-time order over a source that ends: nothing waits for the watermark when it is over.

    Once the source is read, the same query goes on from its checkpoint and reads one more row from a second source, a
    sentinel of the year 2200 without transaction number, which lets the watermark pass all others; it never comes out.
    """
    spark = source.sparkSession
    base = f"{shared_folder(spark)}/ended-{uuid.uuid4().hex}"
    row = spark.range(1).select(*(F.lit("2200-01-01").cast("timestamp").alias(f.name) if f.name == "ts" else F.lit(7258118400000000 if f.name == "us" else None).cast(f.dataType).alias(f.name) for f in source.schema))
    row.limit(0).write.parquet(f"{base}/sentinel")
    stream = job(source.unionByName(spark.readStream.schema(source.schema).parquet(f"{base}/sentinel")))
    with _rocksdb(spark):
        for last in (False, True):
            if last:
                row.write.mode("append").parquet(f"{base}/sentinel")
            stream.writeStream.outputMode("append").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).format("parquet").option("path", f"{base}/out").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def live_state(spark: SparkSession, stream: DataFrame, variable: str) -> DataFrame:
    """The keyed state of a stream, read from its checkpoint after a run."""
    base = f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"
    with _rocksdb(spark):
        stream.writeStream.outputMode("append").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).format("noop").start().awaitTermination()
        return spark.read.format("statestore").option("stateVarName", variable).load(f"{base}/checkpoint")


def live_indicators(spark: SparkSession, stream: DataFrame, rules: list[Rule], custom: dict[str, list[str]] | None = None) -> DataFrame:
    """The state of a job that has read all that a stream's source holds."""
    return Job(spark, f"{shared_folder(spark)}/live-{uuid.uuid4().hex}").start(stream, rules, list, custom).wait().state()
