"""Queries of summaries, counters and rankings, and the streaming twins of the window queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import alerts as A, metrics as M, rules as R, state, windows as W
from ..sources.folders import shared_folder
from ..sources.transactions import read_transactions, split_errors, table
from ..streaming import jobs
from . import queries_alerts as Q
from .queries_rules import RELEASES, releases
from .queries_windows import ANCHORED, DAY, HOUR, MONEY, T, WEEK, _frame, receive_delays


def _quantiles(value: str, name: str) -> str:
    return f"count({value}) AS {name}_count, sum({value}::DECIMAL(24,6))::DOUBLE AS {name}_sum, max({value})::DOUBLE AS {name}_max, " + ", ".join(f"round(quantile_cont({value}, {q})::DOUBLE, 6) AS {name}_p{int(q * 100)}" for q in M.QUANTILES)


def alerts_by_rule(spark, sf):
    return A.by_rule(Q.scored(spark, sf))


def transactions_by_subject(spark, sf):
    return M.transactions_by_subject(state.fan_out(read_transactions(spark, sf), Q.CUSTOM))


def amount_summary(spark, sf):
    return M.summary(read_transactions(spark, sf), F.col("amount"), "amount")


def score_summary(spark, sf):
    return M.summary(Q.scored(spark, sf).filter(F.size("alerts") > 0), F.col("score"), "score")


def run_counters(spark, sf):
    df = read_transactions(spark, sf)
    good, bad = split_errors(df, {"small amount": F.col("amount") >= 1})
    from .engine import check_transactions

    return M.run_counters(check_transactions(good, Q.COMPUTE + Q.ALERTS, Q.CUSTOM, peers=True), bad)


def window_entries_summary(spark, sf):
    out = W.sliding_sums(read_transactions(spark, sf), ["card_id"], {"w": WEEK}, {"n": F.lit(1).cast("long")}, peers=True)
    return M.summary(out, F.col("n_w"), "entries")


def message_size_summary(spark, sf):
    return M.summary(read_transactions(spark, sf), F.octet_length("payload"), "bytes")


def delay_summary(spark, sf):
    return M.summary(receive_delays(spark, sf), F.col("delay_ms"), "delay")


def top_rules(spark, sf):
    return M.top_rules(Q.scored(spark, sf), {r.title: r.group for r in Q.ALERTS}, 3)


# Streams over the files of the events table, each run until all of it is read.


def stream_sliding(spark, sf):
    return jobs.drained(jobs.sliding(read_transactions(spark, sf, streaming=True), ["card_id"], {"day": DAY, "week": WEEK}), "append").select("transaction_no", "n_day", "n_week", F.round("amount_day", 2).alias("amount_day"))


def stream_fixed(spark, sf):
    return jobs.drained(jobs.fixed(read_transactions(spark, sf, streaming=True), ["card_id"], DAY), "append").select("transaction_no", "window_start", "n")


def stream_global(spark, sf):
    return jobs.drained(jobs.unbounded(read_transactions(spark, sf, streaming=True), ["merchant"]), "append").select("transaction_no", "n", F.round("amount", 2).alias("amount"))


def stream_late(spark, sf):
    """Event-time order: rows wait until the watermark has passed them."""
    out = jobs.drained_to_the_end(read_transactions(spark, sf, streaming=True), lambda rows: jobs.sliding(rows, ["card_id"], {"day": DAY}, order="event_time"))
    return out.select("transaction_no", "n_day")


def stream_alert_sets(spark, sf):
    """Alert sets of a stream by card and merchant rules, apart from its answers; transactions during a deployment skip rules and state."""
    open_, _ = jobs.gated(read_transactions(spark, sf, streaming=True), releases(spark, sf))
    _, alerts = jobs.scored(open_, Q.COMPUTE, lambda: Q.ALERTS)
    return alerts.select("transaction_no", "score", A.titles(F.col("alerts")).alias("alerts"))


def stream_answers(spark, sf):
    """Answers to all of a stream's transactions by rules on a fixed window and a custom subject."""
    answers, _ = jobs.scored(read_transactions(spark, sf, streaming=True), [r for r in Q.FIXED if r.kind == "COMPUTE"], lambda: [r for r in Q.FIXED if r.kind == "ALERT"], Q.CUSTOM)
    return answers.select("transaction_no", "alert_status", "score", A.titles(F.col("alerts")).alias("alerts"))


def stream_gate(spark, sf):
    """Answers to the transactions that a deployment postpones."""
    _, postponed = jobs.gated(read_transactions(spark, sf, streaming=True), releases(spark, sf))
    return jobs.drained(postponed, "append")


def stream_tumbling(spark, sf):
    out = jobs.tumbling(read_transactions(spark, sf, streaming=True), "merchant", "1 day")
    return jobs.drained(out, "complete").select("merchant", "window_start", "n", F.round("amount", 2).alias("amount"))


def stream_state_query(spark, sf):
    """Requests answered from the live state of a stream."""
    held = jobs.live_indicators(spark, read_transactions(spark, sf, streaming=True), [r for r in Q.COMPUTE if r.subject == "Card"])
    return state.query_indicators(Q.requests(spark, sf), held).drop("values", "arg_list", "arg_set", "last", "fixed")


def stream_records(spark, sf):
    """Requests answered from the live state of a stream, with named values, lists, sets and last values."""
    return Q.answered_records(spark, sf, jobs.live_indicators(spark, read_transactions(spark, sf, streaming=True), Q.RECORDS))


def stream_arguments(spark, sf):
    """Lists, sets and last values that a stream keeps for each card, after each transaction."""
    out = jobs.drained(jobs.indicators(read_transactions(spark, sf, streaming=True), Q.RECORDS), "append")
    name = lambda m, w: F.col(f"tx_{m}_card_{w}")
    return out.select("transaction_no", F.array_join(name("list", f"w{DAY}"), ",").alias("kinds"), F.size(name("set", f"w{DAY}")).alias("n_kinds"), name("last", f"w{DAY}").alias("recent"), name("last", "global").alias("large"))


class _Arriving:
    """The events table in two halves by time, each written to the folder of a stream when it is asked for."""

    def __init__(self, spark, sf):
        self.spark, self.events = spark, table(spark, sf, "events")
        self.folder = f"{shared_folder(spark)}/arriving-{uuid.uuid4().hex}"
        self.events.limit(0).write.parquet(f"{self.folder}/events.parquet")

    def stream(self):
        return read_transactions(self.spark, self.folder, streaming=True)

    def add(self, late):
        is_late = F.col("ts") >= F.lit(HALF).cast("timestamp_ntz")
        self.events.filter(is_late if late else ~is_late).write.mode("append").parquet(f"{self.folder}/events.parquet")


HALF = "2024-01-16"
_LATE = f"ts >= TIMESTAMP '{HALF}'"


def _job(spark):
    return jobs.Job(spark, f"{shared_folder(spark)}/job-{uuid.uuid4().hex}")


def stream_rule_reload(spark, sf):
    """Each micro-batch is judged by the newest version of its ruleset that can run, read anew from the tables of rules and deployments: one is deployed between the two halves,
    and one that names a record that no rule keeps."""
    compute = [r for r in Q.COMPUTE if r.subject == "Card"]
    base = f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}"

    def deploy(number, sql, valid=True):
        R.as_table(spark, [*compute, R.Rule("busy", "ALERT", "Card", DAY, condition_sql=sql)], "cards", str(number)).write.mode("append").parquet(f"{base}/rules")
        spark.createDataFrame([("cards", str(number), number, valid)], "ruleset string, version string, requested_us long, valid boolean").write.mode("append").parquet(f"{base}/deployments")

    source, job, example = _Arriving(spark, sf), _job(spark), read_transactions(spark, sf).limit(0)
    read = lambda name: lambda: spark.read.parquet(f"{base}/{name}")
    for late, versions in ((False, [(1, "tx.count > 6"), (2, "none.count > 4")]), (True, [(3, "tx.count > 4"), (4, "none.count > 4"), (5, "tx.count > 0", False)])):
        for v in versions:
            deploy(*v)
        source.add(late)
        job.start(source.stream(), compute, lambda: jobs.active_rules(read("rules"), read("deployments"), "cards", example, compute)[1]).wait()
    return job.answers().select("transaction_no", F.col("alert_status"), F.col("score"))


def stream_restart(spark, sf):
    """A job that stops after the first half of its files and goes on from its checkpoint with the second."""
    source, job = _Arriving(spark, sf), _job(spark)
    compute = [r for r in Q.COMPUTE if r.kind == "COMPUTE"]
    for late in (False, True):
        source.add(late)
        jobs.Job(spark, job.folder).start(source.stream(), compute, lambda: Q.ALERTS, Q.CUSTOM, peers=True).wait()
    return job.answers().select("transaction_no", "alert_status", "score", A.titles(F.col("alerts")).alias("alerts"))


def stream_compute_change(spark, sf):
    """COMPUTE rules that come between two runs: records of before go on, and a new one begins."""
    source, job = _Arriving(spark, sf), _job(spark)
    old = [R.Rule("day", "COMPUTE", "Card", DAY, record="tx", amount_sql="amount"), R.Rule("ever", "COMPUTE", "Card", None, record="tx", scope="global"), R.Rule("dropped", "COMPUTE", "Card", HOUR, record="gone")]
    new = [R.Rule("large", "COMPUTE", "Card", WEEK, record="large", filter_sql="amount > 20"), *old[:2], R.Rule("busy", "ALERT", "Card", DAY, condition_sql="tx.count > 4 and tx.amount > 50"), R.Rule("larger", "ALERT", "Card", WEEK, condition_sql="large.count > 2 and global.tx.count > 10")]
    for late, rules in ((False, old), (True, new)):
        source.add(late)
        job.start(source.stream(), [r for r in rules if r.kind == "COMPUTE"], lambda: [r for r in rules if r.kind == "ALERT"]).wait()  # noqa: B023
    held = job.state().groupBy("key").agg(*(F.max(F.when(F.col("record") == n, F.col("count"))).alias(f"n_{n}") for n in ("large",)))
    answers = job.answers().select("transaction_no", A.titles(F.col("alerts")).alias("alerts"))
    cards = read_transactions(spark, sf).select("transaction_no", "card_id")
    return answers.join(cards, "transaction_no").join(held.withColumnRenamed("key", "card_id"), "card_id", "left").select("transaction_no", "alerts", "n_large")


def stream_live_requests(spark, sf):
    """A stream of requests, answered from the state of a job while it runs: some come after the first half of the transactions, the same again after the second."""
    source, job, base = _Arriving(spark, sf), _job(spark), f"{shared_folder(spark)}/requests-{uuid.uuid4().hex}"
    asked = Q.requests(spark, sf)
    asked.limit(0).withColumn("step", F.lit(0)).write.parquet(f"{base}/requests")
    requests = spark.readStream.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in asked.schema)}, step int").parquet(f"{base}/requests")
    kept = [r for r in Q.COMPUTE if r.subject == "Card"] + [r for r in Q.FIXED if r.kind == "COMPUTE"]
    job.start(source.stream(), kept, list, Q.CUSTOM, trigger={"processingTime": "0 seconds"})
    try:
        for step, late in enumerate((False, True)):
            source.add(late)
            job.query.processAllAvailable()
            asked.withColumn("step", F.lit(step)).write.mode("append").parquet(f"{base}/requests")
            jobs.answered_requests(requests, job, base).awaitTermination()
    finally:
        job.stop()
    fields = "request_id long, name string, count long, amount double, fixed boolean, error_message string"
    return spark.read.schema(f"{fields}, batch int").parquet(f"{base}/answers").select("request_id", "name", "count", "amount", "fixed", "error_message", F.col("batch").cast("long").alias("step"))


def stream_shared_records(spark, sf):
    """Records that several rules keep, on a stream."""
    return Q.shared_columns(jobs.drained(jobs.indicators(read_transactions(spark, sf, streaming=True), Q.SHARED), "append"))


def stream_typed_values(spark, sf):
    out = jobs.drained(jobs.indicators(read_transactions(spark, sf, streaming=True), Q.TYPED), "append")
    at = lambda n: F.col(f"tx_value_{n}_card_w{WEEK}")
    return out.select("transaction_no", at("time").alias("time"), at("mixed").alias("mixed"), at("cents").cast("double").alias("cents"), at("wide").cast("double").alias("wide"), at("whole").alias("whole"))


_LIVE = " UNION ALL ".join(
    f"""SELECT * FROM ({ANCHORED.replace("FROM events)", f"FROM events WHERE {some})")}, x AS (SELECT *, count(*) OVER {Q._CARD_DAY} AS nd, sum({MONEY}) OVER {Q._CARD_DAY} AS ad, count(*) OVER {Q._CARD_WEEK} AS nw, sum({MONEY}) OVER {Q._CARD_WEEK} AS aw,
      count(*) OVER g AS ng, sum({MONEY}) OVER g AS ag, count(*) OVER f AS nf, sum({MONEY}) OVER f AS af, row_number() OVER (PARTITION BY card_id ORDER BY us DESC, transaction_no DESC) AS rn FROM w
      WINDOW g AS (PARTITION BY card_id ORDER BY us, transaction_no ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY card_id, window_start ORDER BY us, transaction_no ROWS UNBOUNDED PRECEDING)),
    s AS (SELECT card_id AS key, unnest([{DAY}, {WEEK}, NULL, {DAY}])::BIGINT AS window_ms, unnest(['tx-1d', 'tx-7d', 'tx', 'tx-1d']) AS name, unnest([nd, nw, ng, nf]) AS count, unnest([ad, aw, ag, af])::DOUBLE AS amount, unnest([false, false, false, true]) AS fixed FROM x WHERE rn = 1),
    q AS (SELECT c_custkey AS request_id, CASE WHEN c_custkey % 13 <> 0 THEN 'Card' END AS subject, c_custkey::VARCHAR AS key, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN {DAY} WHEN 3 THEN {WEEK} ELSE {HOUR} END AS timeframe FROM customer)
    SELECT q.request_id, s.name, s.count, s.amount, s.fixed, CASE WHEN q.subject IS NULL THEN 'subject is missing' END AS error_message, {step}::BIGINT AS step
    FROM q LEFT JOIN s ON q.subject = 'Card' AND q.key = s.key AND (s.window_ms IS NULL OR coalesce(q.timeframe, 0) = 0 OR q.timeframe = s.window_ms))"""
    for step, some in enumerate((f"NOT ({_LATE})", "true"))
)

TABLE = {
    "alerts_by_rule": (alerts_by_rule, f"{Q.SCORED} SELECT unnest(titles) AS rule_title, count(*) AS n_alerts FROM a GROUP BY 1"),
    "transactions_by_subject": (transactions_by_subject, "SELECT unnest(['Card', 'Merchant', 'pair']) AS subject, count(DISTINCT event_id) AS n_transactions FROM events GROUP BY 1"),
    "amount_summary": (amount_summary, f"SELECT {_quantiles('value', 'amount')} FROM events"),
    "score_summary": (score_summary, f"{Q.SCORED}, s AS (SELECT len(titles) / 5.0::DOUBLE AS score FROM a WHERE len(titles) > 0) SELECT {_quantiles('score', 'score')} FROM s"),
    "run_counters": (run_counters, f"{Q.SCORED.replace('FROM events)', 'FROM events WHERE value >= 1)')} SELECT count(*) AS processed, (SELECT count(*) FROM events WHERE value < 1) AS failed, count(*) FILTER (len(titles) > 0) AS alerted, sum(len(titles))::BIGINT AS alerts_generated FROM a"),
    "window_entries_summary": (window_entries_summary, f"WITH {T}, s AS (SELECT count(*) OVER {_frame('card_id', '7 DAYS')} AS n FROM t) SELECT {_quantiles('n', 'entries')} FROM s"),
    "message_size_summary": (message_size_summary, f"WITH s AS (SELECT strlen(props) AS n FROM events) SELECT {_quantiles('n', 'bytes')} FROM s"),
    "delay_summary": (delay_summary, f"WITH s AS (SELECT coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN epoch_ms(o_orderdate) + o_custkey END, epoch_ms(o_orderdate) + 60000) - CASE WHEN o_orderkey % 5 <> 0 THEN epoch_ms(o_orderdate) END AS d FROM orders) SELECT {_quantiles('d', 'delay')} FROM s"),
    "top_rules": (top_rules, f"{Q.SCORED}, c AS (SELECT unnest(titles) AS rule_title, count(*) AS n_alerts FROM a GROUP BY 1) SELECT CASE WHEN rule_title IN ('busy-day', 'busy-hour') THEN 'speed' WHEN rule_title = 'burst' THEN 'MAIN' ELSE 'amount' END AS rule_group, rule_title, n_alerts FROM c ORDER BY n_alerts DESC, rule_title LIMIT 3"),
    "stream_sliding": (stream_sliding, f"WITH {T} SELECT transaction_no, count(*) OVER {_frame('card_id', '1 DAY')} AS n_day, count(*) OVER {_frame('card_id', '7 DAYS')} AS n_week, round(CAST(sum({MONEY}) OVER {_frame('card_id', '1 DAY')} AS DOUBLE), 2) AS amount_day FROM t"),
    "stream_fixed": (stream_fixed, f"{ANCHORED} SELECT transaction_no, window_start, count(*) OVER (PARTITION BY card_id, window_start ORDER BY us, transaction_no ROWS UNBOUNDED PRECEDING) AS n FROM w"),
    "stream_global": (stream_global, f"WITH {T} SELECT transaction_no, count(*) OVER w AS n, round(CAST(sum({MONEY}) OVER w AS DOUBLE), 2) AS amount FROM t WINDOW w AS (PARTITION BY merchant ORDER BY us, transaction_no ROWS UNBOUNDED PRECEDING)"),
    "stream_late": (stream_late, f"WITH {T} SELECT transaction_no, count(*) OVER {_frame('card_id', '1 DAY')} AS n_day FROM t"),
    "stream_alert_sets": (stream_alert_sets, Q.SCORED.replace("i AS (SELECT *,", f"{RELEASES}, o AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM d WHERE us >= started_us AND us < ended_us)), i AS (SELECT *,").replace("FROM t),\n  a AS", "FROM o),\n  a AS") + " SELECT transaction_no, len(titles) / 5.0::DOUBLE AS score, array_to_string(titles, ',') AS alerts FROM a WHERE len(titles) > 0"),
    "stream_answers": (stream_answers, Q.TABLE["alert_rules_eval"][1]),
    "stream_gate": (stream_gate, f"WITH {T}, {RELEASES} SELECT transaction_no, 'ALERT_UNAVAILABLE' AS alert_status, 'POSTPONE' AS action FROM t WHERE EXISTS (SELECT 1 FROM d WHERE us >= started_us AND us < ended_us)"),
    "stream_tumbling": (stream_tumbling, f"WITH {T} SELECT merchant, epoch_us(date_trunc('day', ts)) AS window_start, count(*) AS n, round(CAST(sum({MONEY}) AS DOUBLE), 2) AS amount FROM t GROUP BY 1, 2"),
    "stream_state_query": (stream_state_query, Q.TABLE["query_indicators"][1]),
    "stream_records": (stream_records, Q.TABLE["query_records"][1]),
    "stream_arguments": (stream_arguments, f"""WITH {T}, l AS (SELECT transaction_no, list_sort(list(merchant) OVER {_frame('card_id', '1 DAY')}) AS k, last_value(CASE WHEN amount > 20 THEN merchant END IGNORE NULLS) OVER {_frame('card_id', '1 DAY')} AS recent,
        last_value(CASE WHEN amount > 50 THEN argument END IGNORE NULLS) OVER (PARTITION BY card_id ORDER BY us, transaction_no ROWS UNBOUNDED PRECEDING) AS large FROM t)
      SELECT transaction_no, array_to_string(k, ',') AS kinds, len(list_distinct(k))::INTEGER AS n_kinds, recent, large FROM l"""),
    "stream_rule_reload": (stream_rule_reload, f"WITH {T}, i AS (SELECT transaction_no, count(*) OVER {_frame('card_id', '1 DAY')} AS n, CASE WHEN {_LATE} THEN 4 ELSE 6 END AS most FROM t) SELECT transaction_no, CASE WHEN n > most THEN 'ALERT' ELSE 'NO_ALERT' END AS alert_status, CASE WHEN n > most THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM i"),
    "stream_restart": (stream_restart, Q.TABLE["check_transactions"][1]),
    "stream_compute_change": (stream_compute_change, f"""WITH {T}, i AS (SELECT *, count(*) OVER {_frame('card_id', '1 DAY')} AS n, sum({MONEY}) OVER {_frame('card_id', '1 DAY')} AS a, count(*) FILTER (amount > 20 AND {_LATE}) OVER {_frame('card_id', '7 DAYS')} AS large,
        count(*) OVER (PARTITION BY card_id ORDER BY us, transaction_no ROWS UNBOUNDED PRECEDING) AS ng FROM t),
      l AS (SELECT card_id, max_by(large, (us, transaction_no)) FILTER ({_LATE}) AS n_large FROM i GROUP BY card_id)
      SELECT transaction_no, CASE WHEN {_LATE} THEN array_to_string(list_filter([CASE WHEN n > 4 AND a > 50 THEN 'busy' END, CASE WHEN large > 2 AND ng > 10 THEN 'larger' END], lambda x: x IS NOT NULL), ',') ELSE '' END AS alerts, n_large FROM i JOIN l USING (card_id)"""),
    "stream_live_requests": (stream_live_requests, _LIVE),
    "stream_shared_records": (stream_shared_records, Q.TABLE["shared_records"][1]),
    "stream_typed_values": (stream_typed_values, Q.TABLE["typed_values"][1].replace(", CASE WHEN time > 7000000000000000 AND whole > 100 THEN 'late' ELSE '' END AS alerts", "")),
}
