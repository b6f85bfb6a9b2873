"""Queries of rule evaluation, alert sets and indicator state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import alerts as A, state, windows as W
from ..operators.rules import Rule, as_table, check, from_table
from ..sources.folders import shared_folder
from ..sources.transactions import read_rules, read_transactions, table
from . import engine
from .queries_windows import ANCHORED, DAY, HOUR, MONEY, T, WEEK, _frame

CUSTOM = {"pair": ["card_id", "merchant"]}
COMPUTE = [
    Rule("card-day", "COMPUTE", "Card", DAY, record="tx", amount_sql="amount"),
    Rule("card-week", "COMPUTE", "Card", WEEK, record="tx", amount_sql="amount"),
    Rule("card-all", "COMPUTE", "Card", None, record="tx", amount_sql="amount", scope="global"),
    Rule("merchant-hour", "COMPUTE", "Merchant", HOUR, record="tx", amount_sql="amount"),
    Rule("merchant-errors", "COMPUTE", "Merchant", HOUR, record="large", filter_sql="amount > 20"),
]
ALERTS = [
    Rule("busy-day", "ALERT", "Card", DAY, condition_sql="tx.count > 4", message="many transactions in a day", action="POSTPONE", group="speed"),
    Rule("large-week", "ALERT", "Card", WEEK, condition_sql="tx.amount > 600 and tx.count > 2", message="much spent in a week", group="amount"),
    Rule("burst", "ALERT", "Card", WEEK, condition_sql="global.tx.count > 12 and tx.count * 4 > global.tx.count * 3", message="most of all in a week"),
    Rule("busy-hour", "ALERT", "Merchant", HOUR, condition_sql="tx.count >= 8 and large.count >= 4", message="busy merchant", group="speed"),
    Rule("large-now", "ALERT", "Merchant", HOUR, condition_sql="amount > 100", message="large amount", action="POSTPONE", group="amount"),
]
FIXED = [
    Rule("pair-day", "COMPUTE", "Card", DAY, fixed=True, record="tx", amount_sql="amount"),
    Rule("pair-busy", "ALERT", "Card", DAY, fixed=True, condition_sql="tx.count >= 3 and tx.amount > 50", message="busy fixed day"),
    Rule("pair-own", "COMPUTE", "Custom", WEEK, custom_subject="pair", record="own"),
    Rule("pair-often", "ALERT", "Custom", WEEK, custom_subject="pair", condition_sql="own.count >= 4", message="same kind again"),
]

_CARD_DAY, _CARD_WEEK, _HOUR = _frame("card_id", "1 DAY"), _frame("card_id", "7 DAYS"), _frame("merchant", "1 HOUR")
SCORED = f"""WITH {T}, i AS (SELECT *, count(*) OVER {_CARD_DAY} AS nd, count(*) OVER {_CARD_WEEK} AS nw, sum({MONEY}) OVER {_CARD_WEEK} AS aw,
  count(*) OVER (PARTITION BY card_id ORDER BY us, transaction_no ROWS UNBOUNDED PRECEDING) AS ng,
  count(*) OVER {_HOUR} AS nh, count(*) FILTER (amount > 20) OVER {_HOUR} AS lh FROM t),
  a AS (SELECT *, list_sort(list_filter([CASE WHEN nd > 4 THEN 'busy-day' END, CASE WHEN aw > 600 AND nw > 2 THEN 'large-week' END, CASE WHEN ng > 12 AND nw * 4 > ng * 3 THEN 'burst' END,
    CASE WHEN nh >= 8 AND lh >= 4 THEN 'busy-hour' END, CASE WHEN amount > 100 THEN 'large-now' END], lambda x: x IS NOT NULL)) AS titles FROM i)"""


def scored(spark, sf):
    return engine.check_transactions(read_transactions(spark, sf), COMPUTE + ALERTS, CUSTOM, peers=True)


def check_transactions(spark, sf):
    return scored(spark, sf).select("transaction_no", "alert_status", "score", A.titles(F.col("alerts")).alias("alerts"))


def sink_alert_sets(spark, sf):
    return scored(spark, sf).filter(F.size("alerts") > 0).select("transaction_no", "card_id", "merchant", A.titles(F.col("alerts")).alias("alerts"), "score")


def alert_status(spark, sf):
    return scored(spark, sf).groupBy("alert_status").agg(F.count(F.lit(1)).alias("n"))


def alert_score(spark, sf):
    return scored(spark, sf).select("transaction_no", "score")


def alert_rules_eval(spark, sf):
    """ALERT rules over a fixed window and a custom subject."""
    out = engine.check_transactions(read_transactions(spark, sf), FIXED, CUSTOM, peers=True)
    return out.select("transaction_no", "alert_status", "score", A.titles(F.col("alerts")).alias("alerts"))


def compute_rules_eval(spark, sf):
    out = engine.with_indicators(read_transactions(spark, sf), COMPUTE, CUSTOM, peers=True)
    return out.select("transaction_no", F.col(f"tx_count_card_w{DAY}").alias("card_day"), F.col(f"tx_amount_card_w{WEEK}").cast("double").alias("card_week_amount"), F.col("tx_count_card_global").alias("card_all"), F.col(f"large_count_merchant_w{HOUR}").alias("merchant_large"))


def merge_alerts(spark, sf):
    """Alert sets of single subjects, one row each and one of them twice, merged by transaction."""
    rows = engine.with_indicators(read_transactions(spark, sf), COMPUTE, CUSTOM, peers=True)
    keys = engine.subject_keys(ALERTS, CUSTOM)
    sets = [A.alert_array([r for r in ALERTS if r.subject == s], keys) for s in ("Card", "Merchant", "Card")]
    out = A.merge_alerts(rows.select("transaction_no", F.explode(F.array(*sets)).alias("alerts")), len(ALERTS))
    return out.select("transaction_no", "alert_status", "score", A.titles(F.col("alerts")).alias("alerts"))


BROKEN = [Rule("typo", "ALERT", "Card", DAY, condition_sql="amuont > 1"), Rule("lost", "ALERT", "Card", DAY, condition_sql="other.count > 1"), Rule("number", "ALERT", "Card", DAY, condition_sql="amount + 1")]


def rule_check(spark, sf):
    """How many transactions each ALERT rule that passes its check alerts; rules that fail it are reported and left out."""
    df = read_transactions(spark, sf)
    bad = check([*COMPUTE, *ALERTS, *BROKEN], df)
    good = [r for r in (*COMPUTE, *ALERTS, *BROKEN) if r.title not in bad]
    n = A.by_rule(engine.check_transactions(df, good, CUSTOM, peers=True)).select(F.col("rule_title").alias("title"), F.lit(True).alias("valid"), "n_alerts")
    return n.unionByName(spark.createDataFrame([(t, False, 0) for t in bad], n.schema))


#: Rules that fail on some rows: by a division, by a cast, by the key of their subject; and one of each kind of record.
FAILING = [
    Rule("card-week", "COMPUTE", "Card", WEEK, record="tx", amount_sql="amount"),
    Rule("odd-cast", "COMPUTE", "Card", WEEK, record="odd", filter_sql="cast(merchant as int) > 0"),
    Rule("split", "ALERT", "Card", WEEK, condition_sql="amount / (tx.count - 1) > 5"),
    Rule("cast", "ALERT", "Card", WEEK, condition_sql="cast(argument as int) % (cast(argument as int) - 50) = 3"),
    Rule("busy", "ALERT", "Card", WEEK, condition_sql="tx.count >= 4"),
    Rule("band", "COMPUTE", "Custom", WEEK, custom_subject="band", record="tx"),
    Rule("same-band", "ALERT", "Custom", WEEK, custom_subject="band", condition_sql="tx.count >= 20"),
    Rule("large", "ALERT", "Card", WEEK, condition_sql="case when amount > 30 then true end"),  # has no result on most rows, by design
    Rule("stopped", "ALERT", "Card", WEEK, condition_sql="if(amount > 60, raise_error('too much'), tx.count >= 5)"),
    Rule("typo", "ALERT", "Card", WEEK, condition_sql="amuont > 1"),  # doesn't resolve
]
BAND = {"band": ["merchant", "100 div (cast(argument as int) - 50)"]}


def failing_rules(spark, sf):
    """Rules and subjects that fail on a transaction, and rules that don't resolve, are reported, and the others still alert."""
    out = engine.check_transactions(read_transactions(spark, sf), FAILING, BAND, peers=True)
    return out.select("transaction_no", A.titles(F.col("alerts")).alias("alerts"), "score", F.array_join(F.array_sort("rule_errors"), ",").alias("rule_errors"))


RECORDS = [
    Rule("kept", "COMPUTE", "Card", DAY, record="tx", amount_sql="amount", value_sqls=(("k", "cast(argument as int)"), ("share", "amount / 4")), arg_sql="merchant", last_sql="case when amount > 20 then merchant end"),
    Rule("kept-all", "COMPUTE", "Card", None, record="tx", scope="global", last_sql="case when amount > 50 then argument end"),
    Rule("values", "ALERT", "Card", DAY, condition_sql="tx.values.k > 150 and tx.values.share > 20", group="values"),
    Rule("kinds", "ALERT", "Card", DAY, condition_sql="size(tx.set) >= 3 and size(tx.list) > size(tx.set)", group="lists"),
    Rule("again", "ALERT", "Card", DAY, condition_sql="tx.last = merchant and tx.count > 2", group="lists"),
    Rule("digits", "ALERT", "Card", DAY, condition_sql="global.tx.last = argument or customer_acctbal < 0", group="lists"),
]


def rules_from_table(spark, sf):
    """Rules with named values, lists, sets and last values, read from a rules table; one group is evaluated, one rule reads a look-up table."""
    held = as_table(spark, RECORDS, "records", "1").unionByName(as_table(spark, ALERTS, "records", "2"))
    found = from_table(read_rules(held, "records", "1"))
    customers = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("acctbal"))
    out = engine.check_transactions(read_transactions(spark, sf), found, group="lists", lookups={"customer": (customers, "c_custkey", "card_id")}, peers=True)
    other = engine.check_transactions(read_transactions(spark, sf), found, group="values", peers=True).select("transaction_no", F.size("alerts").alias("n_values"))
    return out.join(other, "transaction_no").select("transaction_no", A.titles(F.col("alerts")).alias("alerts"), "score", "n_values")


def _snapshot_rows(df):
    """Long-form state: day and week windows and the global record of each card."""
    out = W.sliding_sums(df, ["card_id"], {"day": DAY, "week": WEEK}, {"n": F.lit(1).cast("long"), "amount": F.col("amount").cast(W.MONEY)})
    out = W.global_record(out, ["card_id"], {"n_all": F.lit(1).cast("long"), "amount_all": F.col("amount").cast(W.MONEY)})
    last = state.latest(out, ["card_id"], ["n_day", "amount_day", "n_week", "amount_week", "n_all", "amount_all"])
    each = F.array(*(F.struct(F.lit(ms).cast("long").alias("window_ms"), F.col(f"n_{w}").alias("count"), F.col(f"amount_{w}").cast("double").alias("amount")) for w, ms in (("day", DAY), ("week", WEEK), ("all", None))))
    return last.select(F.lit("Card").alias("subject"), F.lit(None).cast("string").alias("custom_subject"), F.col("card_id").alias("key"), "as_of", F.explode(each).alias("w")).select("subject", "custom_subject", "key", F.lit("tx").alias("record"), "w.*", "as_of")


def indicator_snapshot(spark, sf):
    return _snapshot_rows(read_transactions(spark, sf)).select("subject", "key", "record", "window_ms", "count", "amount", "as_of")


def purge_state(spark, sf):
    both = state.fan_out(read_transactions(spark, sf), CUSTOM).groupBy("subject", "custom_subject", "key").agg(F.count(F.lit(1)).alias("n"))
    return state.purge(both, ["Merchant"]).select("subject", F.coalesce("custom_subject", F.lit("")).alias("custom_subject"), "key", "n")


def requests(spark, sf):
    """A request for each customer's card: all windows, a day, a week or one that is not kept; some without subject."""
    frame = F.element_at(F.array(F.lit(None).cast("long"), F.lit(0).cast("long"), F.lit(DAY).cast("long"), F.lit(WEEK).cast("long"), F.lit(HOUR).cast("long")), (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("request_id"), F.when(F.col("c_custkey") % 13 != 0, "Card").alias("subject"), F.lit(None).cast("string").alias("custom_subject"), F.col("c_custkey").cast("string").alias("key"), frame.alias("timeframe"))


def query_indicators(spark, sf):
    return state.query_indicators(requests(spark, sf), _snapshot_rows(read_transactions(spark, sf)))


def resume_from_snapshot(spark, sf):
    """Totals of the later half of events continued from a snapshot of the earlier half."""
    df = read_transactions(spark, sf).withColumn("late", F.col("ts") >= F.lit("2024-01-16").cast("timestamp"))
    measures = {"n": F.lit(1).cast("long"), "total": F.col("amount").cast(W.MONEY)}
    early = W.global_record(df.filter("not late"), ["card_id"], measures)
    held = state.latest(early, ["card_id"], ["n", "total"]).withColumn("total", F.col("total").cast(W.MONEY))
    out = state.resume(df.filter("late"), held, "card_id", measures)
    return out.select("transaction_no", "n", F.col("total").cast("double").alias("total"))


def answered_records(spark, sf, held):
    out = state.query_indicators(requests(spark, sf), held)
    return out.select("request_id", "name", "count", "amount", F.round(F.element_at("values", "k"), 2).alias("k"), F.array_join("arg_list", ",").alias("args"), F.size("arg_set").alias("n_kinds"), "last", "error_message")


def query_records(spark, sf):
    """Requests answered with named values, lists, sets and last values too."""
    return answered_records(spark, sf, engine.indicator_state(read_transactions(spark, sf), RECORDS))


def fixed_window_arguments(spark, sf):
    """Lists, sets and last values of each card's fixed windows."""
    kept = Rule("kept", "COMPUTE", "Card", DAY, fixed=True, record="tx", arg_sql="merchant", last_sql="case when amount > 20 then merchant end")
    out = engine.with_indicators(read_transactions(spark, sf), [kept], peers=True)
    return out.select("transaction_no", F.array_join(f"tx_list_card_fw{DAY}", ",").alias("kinds"), F.size(f"tx_set_card_fw{DAY}").alias("n_kinds"), F.col(f"tx_last_card_fw{DAY}").alias("recent"))


def resume_windows(spark, sf):
    """Sliding windows of the later half of events, continued from the tail of the earlier half."""
    df = read_transactions(spark, sf)
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp")
    out = engine.resume_indicators(df.filter(late), state.tail(df.filter(~late), WEEK), COMPUTE, peers=True)
    return out.select("transaction_no", F.col(f"tx_count_card_w{WEEK}").alias("n_week"), F.col(f"tx_count_merchant_w{HOUR}").alias("n_hour"))


#: Several rules that keep one record, over one window and over two, each with its own filter.
SHARED = [
    Rule("bought", "COMPUTE", "Card", DAY, record="tx", filter_sql="merchant = 'purchase'", amount_sql="amount", value_sqls=(("x", "cast(argument as int)"),), arg_sql="merchant", last_sql="argument"),
    Rule("large", "COMPUTE", "Card", DAY, record="tx", filter_sql="amount > 20", amount_sql="amount * 2", value_sqls=(("x", "1000"), ("y", "amount")), arg_sql="argument", last_sql="merchant"),
    Rule("failed", "COMPUTE", "Card", WEEK, record="tx", filter_sql="merchant = 'error'"),
    Rule("seen", "COMPUTE", "Card", WEEK, record="tx", filter_sql="merchant = 'view'", amount_sql="amount"),
    Rule("bought-ever", "COMPUTE", "Card", None, record="tx", filter_sql="merchant = 'purchase'", scope="global"),
    Rule("large-ever", "COMPUTE", "Card", None, record="tx", filter_sql="amount > 20", amount_sql="amount", scope="global", last_sql="merchant"),
    Rule("bought-fixed", "COMPUTE", "Card", DAY, fixed=True, record="tx", filter_sql="merchant = 'purchase'", last_sql="merchant"),
    Rule("large-fixed", "COMPUTE", "Card", DAY, fixed=True, record="tx", filter_sql="amount > 20", amount_sql="amount", arg_sql="merchant"),
    Rule("often", "ALERT", "Card", DAY, condition_sql="tx.count >= 3 and tx.values.x > 1000"),
    Rule("much", "ALERT", "Card", WEEK, condition_sql="tx.count >= 3 and tx.amount > 30"),
    Rule("share", "ALERT", "Card", DAY, fixed=True, condition_sql="tx.count * 3 >= global.tx.count and size(tx.list) > 1"),
]


def shared_columns(rows):
    """The records of SHARED that a row has, sliding and fixed ones and those without end."""
    at = lambda m, w: F.col(f"tx_{m}_card_{w}")
    day, week, ever, fixed = f"w{DAY}", f"w{WEEK}", "global", f"fw{DAY}"
    return rows.select(
        "transaction_no", at("count", day).alias("n_day"), at("amount", day).cast("double").alias("total_day"), at("value_x", day).alias("x"), F.round(at("value_y", day), 6).alias("y"), F.array_join(at("list", day), ",").alias("args"), at("last", day).alias("recent"),
        at("count", week).alias("n_week"), at("amount", week).cast("double").alias("total_week"), at("count", ever).alias("n_ever"), at("amount", ever).cast("double").alias("total_ever"), at("last", ever).alias("last_ever"),
        at("count", fixed).alias("n_fixed"), at("amount", fixed).cast("double").alias("total_fixed"), F.array_join(at("list", fixed), ",").alias("args_fixed"), at("last", fixed).alias("last_fixed"),
    )


def shared_records(spark, sf):
    return shared_columns(engine.with_indicators(read_transactions(spark, sf), SHARED, peers=True))


def shared_alerts(spark, sf):
    """Alerts on records that several rules keep."""
    return engine.check_transactions(read_transactions(spark, sf), SHARED, peers=True).select("transaction_no", "score", A.titles(F.col("alerts")).alias("alerts"))


MIXED = "case when transaction_no % 3 = 0 then 1e15 + floor(amount) when transaction_no % 3 = 1 then -1e15 - floor(amount * 8) / 8 else floor(amount) / 1099511627776d end"
#: Named values of all types, large and small ones in one window.
TYPED = [
    Rule("typed", "COMPUTE", "Card", WEEK, record="tx", value_sqls=(("time", "us"), ("mixed", MIXED), ("cents", "cast(amount as decimal(18,2))"), ("wide", "cast(cast(amount as decimal(18,2)) * 1000000000000BD as decimal(38,6)) * 1000BD"), ("whole", "cast(argument as int)"))),
    Rule("late", "ALERT", "Card", WEEK, condition_sql="tx.values.time > 7000000000000000 and tx.values.whole > 100"),
]


def typed_values(spark, sf):
    """Exact sums of longs, decimals and doubles from 2^-40 to 10^15 of both signs."""
    df = read_transactions(spark, sf)
    at = lambda n: F.col(f"tx_value_{n}_card_w{WEEK}")
    out = engine.with_indicators(df, TYPED, peers=True).select("transaction_no", at("time").alias("time"), at("mixed").alias("mixed"), at("cents").cast("double").alias("cents"), at("wide").cast("double").alias("wide"), at("whole").alias("whole"))
    return out.join(engine.check_transactions(df, TYPED, peers=True).select("transaction_no", A.titles(F.col("alerts")).alias("alerts")), "transaction_no")


def _earlier(df):
    return F.col("ts") < F.lit("2024-01-16").cast("timestamp")


def resume_records(spark, sf):
    """All kinds of records of the later half of events, going on from the state that the earlier half has left, which is written and read back."""
    df = read_transactions(spark, sf)
    folder = f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"
    engine.next_state(df.filter(_earlier(df)), SHARED).write(folder)
    return shared_columns(engine.with_indicators(df.filter(~_earlier(df)), SHARED, start=state.read_state(spark, folder), peers=True))


def resume_requests(spark, sf):
    """Requests answered from a state that has grown in three steps, each from the one before."""
    df = read_transactions(spark, sf)
    day = F.dayofmonth("ts")
    held, folder = None, f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"
    for i, some in enumerate((day < 11, (day >= 11) & (day < 20), day >= 20)):
        engine.next_state(df.filter(some), RECORDS, start=held).write(f"{folder}/{i}")
        held = state.read_state(spark, f"{folder}/{i}")
    return answered_records(spark, sf, held.records)


STATE_SQL = f"""{T}, x AS (SELECT *, count(*) OVER {_CARD_DAY} AS nd, sum({MONEY}) OVER {_CARD_DAY} AS ad, count(*) OVER {_CARD_WEEK} AS nw, sum({MONEY}) OVER {_CARD_WEEK} AS aw,
  count(*) OVER g AS ng, sum({MONEY}) OVER g AS ag, row_number() OVER (PARTITION BY card_id ORDER BY us DESC, transaction_no DESC) AS rn FROM t WINDOW g AS (PARTITION BY card_id ORDER BY us, transaction_no ROWS UNBOUNDED PRECEDING)),
  s AS (SELECT 'Card' AS subject, card_id AS key, 'tx' AS record, us AS as_of, unnest([{DAY}, {WEEK}, NULL])::BIGINT AS window_ms, unnest([nd, nw, ng]) AS count, unnest([ad, aw, ag])::DOUBLE AS amount FROM x WHERE rn = 1)"""

_BOUGHT, _LARGE = "FILTER (merchant = 'purchase')", "FILTER (amount > 20)"
_TEXTS = "array_to_string(list_sort(list_concat(coalesce({0}, []), coalesce({1}, []))), ',')"
SHARED_SQL = f"""{ANCHORED}, e AS (SELECT *, try_cast(argument AS INT) AS k, {MONEY} AS money, CAST(amount * 2 AS DECIMAL(18,2)) AS twice, CASE WHEN amount > 20 THEN merchant WHEN merchant = 'purchase' THEN argument END AS brought,
      CASE WHEN merchant = 'purchase' THEN merchant END AS bought, CASE WHEN amount > 20 THEN merchant END AS large FROM w),
  s AS (SELECT transaction_no, ts, us, amount, count(*) {_BOUGHT} OVER d + count(*) {_LARGE} OVER d AS n_day, coalesce(sum(money) {_BOUGHT} OVER d, 0) + coalesce(sum(twice) {_LARGE} OVER d, 0) AS total_day,
      (coalesce(sum(k) {_BOUGHT} OVER d, 0) + 1000 * count(*) {_LARGE} OVER d)::BIGINT AS x, coalesce(sum(amount) {_LARGE} OVER d, 0) AS y, {_TEXTS.format(f"list(merchant) {_BOUGHT} OVER d", f"list(argument) {_LARGE} OVER d")} AS args, last_value(brought IGNORE NULLS) OVER d AS recent,
      count(*) FILTER (merchant IN ('error', 'view')) OVER k AS n_week, coalesce(sum(money) FILTER (merchant = 'view') OVER k, 0) AS total_week,
      count(*) {_BOUGHT} OVER g + count(*) {_LARGE} OVER g AS n_ever, coalesce(sum(money) {_LARGE} OVER g, 0) AS total_ever, last_value(large IGNORE NULLS) OVER g AS last_ever,
      count(*) {_BOUGHT} OVER f + count(*) {_LARGE} OVER f AS n_fixed, coalesce(sum(money) {_LARGE} OVER f, 0) AS total_fixed, {_TEXTS.format("NULL", f"list(merchant) {_LARGE} OVER f")} AS args_fixed, coalesce(len(list(merchant) {_LARGE} OVER f), 0) AS n_args, last_value(bought IGNORE NULLS) OVER f AS last_fixed
    FROM e WINDOW d AS {_CARD_DAY}, k AS {_CARD_WEEK}, g AS (PARTITION BY card_id ORDER BY us, transaction_no ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY card_id, window_start ORDER BY us, transaction_no ROWS UNBOUNDED PRECEDING))"""
SHARED_COLUMNS = """transaction_no, n_day, total_day::DOUBLE AS total_day, x, round(y, 6) AS y, args, recent, n_week, total_week::DOUBLE AS total_week, n_ever, total_ever::DOUBLE AS total_ever, last_ever, n_fixed, total_fixed::DOUBLE AS total_fixed, args_fixed, last_fixed"""
SHARED_ALERTS = """array_to_string(list_filter([CASE WHEN n_week >= 3 AND total_week > 30 THEN 'much' END, CASE WHEN n_day >= 3 AND x > 1000 THEN 'often' END, CASE WHEN n_fixed * 3 >= n_ever AND n_args > 1 THEN 'share' END], lambda x: x IS NOT NULL), ',')"""
_UNIT = 1 << 40

TABLE = {
    "shared_records": (shared_records, f"{SHARED_SQL} SELECT {SHARED_COLUMNS} FROM s"),
    "shared_alerts": (shared_alerts, f"{SHARED_SQL} SELECT transaction_no, (len(alerts) - len(replace(alerts, ',', '')) + (alerts <> '')::INT) / 3.0::DOUBLE AS score, alerts FROM (SELECT transaction_no, {SHARED_ALERTS} AS alerts FROM s)"),
    "resume_records": (resume_records, f"{SHARED_SQL} SELECT {SHARED_COLUMNS} FROM s WHERE ts >= TIMESTAMP '2024-01-16'"),
    "typed_values": (typed_values, f"""WITH {T}, m AS (SELECT *, CASE transaction_no % 3 WHEN 0 THEN (1000000000000000 + floor(amount)::HUGEINT) * {_UNIT} WHEN 1 THEN (-8000000000000000 - floor(amount * 8)::HUGEINT) * {_UNIT // 8} ELSE floor(amount)::HUGEINT END AS mixed, try_cast(argument AS INT) AS k FROM t),
        v AS (SELECT transaction_no, sum(us) OVER f AS time, sum(mixed) OVER f AS mixed, sum({MONEY}) OVER f AS cents, sum(k) OVER f AS whole FROM m WINDOW f AS {_CARD_WEEK})
      SELECT transaction_no, time::BIGINT AS time, floor(mixed / {_UNIT}::DOUBLE)::DOUBLE + (mixed - floor(mixed / {_UNIT}::DOUBLE)::HUGEINT * {_UNIT})::DOUBLE / {_UNIT} AS mixed, cents::DOUBLE AS cents, (cents::DECIMAL(22,2) * 1000000000000000)::DOUBLE AS wide, whole::BIGINT AS whole, CASE WHEN time > 7000000000000000 AND whole > 100 THEN 'late' ELSE '' END AS alerts FROM v"""),
    "check_transactions": (check_transactions, f"{SCORED} SELECT transaction_no, CASE WHEN len(titles) > 0 THEN 'ALERT' ELSE 'NO_ALERT' END AS alert_status, len(titles) / 5.0::DOUBLE AS score, array_to_string(titles, ',') AS alerts FROM a"),
    "sink_alert_sets": (sink_alert_sets, f"{SCORED} SELECT transaction_no, card_id, merchant, array_to_string(titles, ',') AS alerts, len(titles) / 5.0::DOUBLE AS score FROM a WHERE len(titles) > 0"),
    "alert_status": (alert_status, f"{SCORED} SELECT CASE WHEN len(titles) > 0 THEN 'ALERT' ELSE 'NO_ALERT' END AS alert_status, count(*) AS n FROM a GROUP BY 1"),
    "alert_score": (alert_score, f"{SCORED} SELECT transaction_no, len(titles) / 5.0::DOUBLE AS score FROM a"),
    "alert_rules_eval": (alert_rules_eval, f"""{ANCHORED}, f AS (SELECT transaction_no, count(*) OVER x AS n, sum({MONEY}) OVER x AS total FROM w WINDOW x AS (PARTITION BY card_id, window_start ORDER BY us, transaction_no ROWS UNBOUNDED PRECEDING)),
      o AS (SELECT transaction_no, count(*) OVER {_frame('card_id, merchant', '7 DAYS')} AS own FROM t),
      z AS (SELECT transaction_no, list_filter([CASE WHEN n >= 3 AND total > 50 THEN 'pair-busy' END, CASE WHEN own >= 4 THEN 'pair-often' END], lambda x: x IS NOT NULL) AS titles FROM f JOIN o USING (transaction_no))
      SELECT transaction_no, CASE WHEN len(titles) > 0 THEN 'ALERT' ELSE 'NO_ALERT' END AS alert_status, len(titles) / 2.0::DOUBLE AS score, array_to_string(titles, ',') AS alerts FROM z"""),
    "compute_rules_eval": (compute_rules_eval, f"{SCORED} SELECT transaction_no, nd AS card_day, aw::DOUBLE AS card_week_amount, ng AS card_all, lh AS merchant_large FROM a"),
    "merge_alerts": (merge_alerts, f"{SCORED} SELECT transaction_no, CASE WHEN len(titles) > 0 THEN 'ALERT' ELSE 'NO_ALERT' END AS alert_status, len(titles) / 5.0::DOUBLE AS score, array_to_string(titles, ',') AS alerts FROM a"),
    "rule_check": (rule_check, f"{SCORED}, c AS (SELECT unnest(titles) AS title, count(*) AS n_alerts FROM a GROUP BY 1) SELECT title, true AS valid, n_alerts FROM c UNION ALL SELECT unnest(['typo', 'lost', 'number']), false, 0"),
    "failing_rules": (failing_rules, f"""WITH {T}, i AS (SELECT *, argument::INT AS k, count(*) OVER {_CARD_WEEK} AS nw FROM t),
      b AS (SELECT *, CASE WHEN k <> 50 THEN merchant || '|' || (100 // abs(k - 50) * sign(k - 50))::INT END AS band FROM i),
      c AS (SELECT *, CASE WHEN band IS NOT NULL THEN count(*) OVER {_frame('band', '7 DAYS')} END AS nb FROM b),
      a AS (SELECT *, list_filter([CASE WHEN nw >= 4 THEN 'busy' END, CASE WHEN k <> 50 AND k % (k - 50) = 3 THEN 'cast' END, CASE WHEN amount > 30 THEN 'large' END, CASE WHEN nb >= 20 THEN 'same-band' END, CASE WHEN nw > 1 AND amount / (nw - 1) > 5 THEN 'split' END, CASE WHEN amount <= 60 AND nw >= 5 THEN 'stopped' END], lambda x: x IS NOT NULL) AS titles FROM c)
      SELECT transaction_no, array_to_string(list_sort(titles), ',') AS alerts, len(titles) / 6.0::DOUBLE AS score,
        array_to_string(list_filter([CASE WHEN k = 50 THEN 'band' END, CASE WHEN k = 50 THEN 'cast' END, 'odd-cast', CASE WHEN nw = 1 THEN 'split' END, CASE WHEN amount > 60 THEN 'stopped' END, 'typo'], lambda x: x IS NOT NULL), ',') AS rule_errors FROM a"""),
    "rules_from_table": (rules_from_table, f"""WITH {T}, i AS (SELECT *, count(*) OVER {_CARD_DAY} AS n, sum(try_cast(argument AS INT)) OVER {_CARD_DAY} AS k, sum(CAST(amount / 4 AS DECIMAL(18,6))) OVER {_CARD_DAY} AS share,
        list(merchant) OVER {_CARD_DAY} AS kinds, last_value(CASE WHEN amount > 20 THEN merchant END IGNORE NULLS) OVER {_CARD_DAY} AS recent,
        last_value(CASE WHEN amount > 50 THEN argument END IGNORE NULLS) OVER (PARTITION BY card_id ORDER BY us, transaction_no ROWS UNBOUNDED PRECEDING) AS large FROM t),
      a AS (SELECT i.*, list_filter([CASE WHEN recent = merchant AND n > 2 THEN 'again' END, CASE WHEN coalesce(large = argument, false) OR coalesce(c_acctbal < 0, false) THEN 'digits' END, CASE WHEN len(list_distinct(kinds)) >= 3 AND len(kinds) > len(list_distinct(kinds)) THEN 'kinds' END], lambda x: x IS NOT NULL) AS titles
        FROM i LEFT JOIN customer ON c_custkey::VARCHAR = card_id)
      SELECT transaction_no, array_to_string(titles, ',') AS alerts, len(titles) / 3.0::DOUBLE AS score, CASE WHEN k > 150 AND share > 20 THEN 1 ELSE 0 END AS n_values FROM a"""),
    "indicator_snapshot": (indicator_snapshot, f"WITH {STATE_SQL} SELECT subject, key, record, window_ms, count, amount, as_of FROM s"),
    "purge_state": (purge_state, f"WITH {T} SELECT 'Card' AS subject, '' AS custom_subject, card_id AS key, count(*) AS n FROM t GROUP BY card_id UNION ALL SELECT 'Custom', 'pair', card_id || '|' || merchant, count(*) FROM t GROUP BY card_id, merchant"),
    "query_indicators": (query_indicators, f"""WITH {STATE_SQL}, q AS (SELECT c_custkey AS request_id, CASE WHEN c_custkey % 13 <> 0 THEN 'Card' END AS subject, c_custkey::VARCHAR AS key, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN {DAY} WHEN 3 THEN {WEEK} ELSE {HOUR} END AS timeframe FROM customer)
      SELECT q.request_id, CASE WHEN s.record IS NULL THEN NULL WHEN s.window_ms IS NULL THEN 'tx' WHEN s.window_ms = {DAY} THEN 'tx-1d' ELSE 'tx-7d' END AS name, s.count, s.amount, CASE WHEN q.subject IS NULL THEN 'subject is missing' END AS error_message
      FROM q LEFT JOIN s ON q.subject = s.subject AND q.key = s.key AND (s.window_ms IS NULL OR coalesce(q.timeframe, 0) = 0 OR q.timeframe = s.window_ms)"""),
    "query_records": (query_records, f"""WITH {T}, x AS (SELECT *, count(*) OVER {_CARD_DAY} AS n, sum({MONEY}) OVER {_CARD_DAY} AS total, sum(try_cast(argument AS INT)) OVER {_CARD_DAY} AS k, list_sort(list(merchant) OVER {_CARD_DAY}) AS kinds,
        last_value(CASE WHEN amount > 20 THEN merchant END IGNORE NULLS) OVER {_CARD_DAY} AS recent, count(*) OVER g AS ng, last_value(CASE WHEN amount > 50 THEN argument END IGNORE NULLS) OVER g AS large,
        row_number() OVER (PARTITION BY card_id ORDER BY us DESC, transaction_no DESC) AS rn FROM t WINDOW g AS (PARTITION BY card_id ORDER BY us, transaction_no ROWS UNBOUNDED PRECEDING)),
      s AS (SELECT card_id AS key, {DAY} AS window_ms, 'tx-1d' AS name, n AS count, total::DOUBLE AS amount, k::DOUBLE AS k, array_to_string(kinds, ',') AS args, len(list_distinct(kinds))::INTEGER AS n_kinds, recent AS last FROM x WHERE rn = 1
        UNION ALL SELECT card_id, NULL, 'tx', ng, NULL, NULL, NULL, NULL, large FROM x WHERE rn = 1),
      q AS (SELECT c_custkey AS request_id, CASE WHEN c_custkey % 13 <> 0 THEN 'Card' END AS subject, c_custkey::VARCHAR AS key, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN {DAY} WHEN 3 THEN {WEEK} ELSE {HOUR} END AS timeframe FROM customer)
      SELECT q.request_id, s.name, s.count, s.amount, s.k, s.args, s.n_kinds, s.last, CASE WHEN q.subject IS NULL THEN 'subject is missing' END AS error_message
      FROM q LEFT JOIN s ON q.subject = 'Card' AND q.key = s.key AND (s.window_ms IS NULL OR coalesce(q.timeframe, 0) = 0 OR q.timeframe = s.window_ms)"""),
    "fixed_window_arguments": (fixed_window_arguments, f"""{ANCHORED}, l AS (SELECT transaction_no, list_sort(list(merchant) OVER x) AS k, last_value(CASE WHEN amount > 20 THEN merchant END IGNORE NULLS) OVER x AS recent FROM w
        WINDOW x AS (PARTITION BY card_id, window_start ORDER BY us, transaction_no ROWS UNBOUNDED PRECEDING))
      SELECT transaction_no, array_to_string(k, ',') AS kinds, len(list_distinct(k))::INTEGER AS n_kinds, recent FROM l"""),
    "resume_windows": (resume_windows, f"WITH {T}, x AS (SELECT transaction_no, ts, count(*) OVER {_CARD_WEEK} AS n_week, count(*) OVER {_HOUR} AS n_hour FROM t) SELECT transaction_no, n_week, n_hour FROM x WHERE ts >= TIMESTAMP '2024-01-16'"),
    "resume_from_snapshot": (resume_from_snapshot, f"WITH {T}, x AS (SELECT *, count(*) OVER g AS n, CAST(sum({MONEY}) OVER g AS DOUBLE) AS total FROM t WINDOW g AS (PARTITION BY card_id ORDER BY us, transaction_no ROWS UNBOUNDED PRECEDING)) SELECT transaction_no, n, total FROM x WHERE ts >= TIMESTAMP '2024-01-16'"),
}
TABLE["resume_requests"] = (resume_requests, TABLE["query_records"][1])
