"""Hand-made cases: edges of windows, ties, late rows, nulls, deployments, and second methods on random data."""

import os
import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe.functions import columns as C
from tallyframe.operators import alerts as A, gate, metrics, rules as R, state, windows as W
from tallyframe.plans import engine
from tallyframe.sources.transactions import EVENT_MAPPING, normalise, read_rules, split_errors, transaction_checks
from tallyframe.streaming import jobs

ROWS = "transaction_no long, card_id string, merchant string, amount double, us long"
S = 1_000_000


def table(spark, rows):
    return spark.createDataFrame(rows, ROWS).withColumn("ts", F.timestamp_micros("us"))


def counted(spark, rows, ms=10_000, **options):
    out = W.sliding_sums(table(spark, rows), ["card_id"], {"w": ms}, {"n": F.lit(1).cast("long"), "a": F.col("amount").cast(W.MONEY)}, **options)
    return {r.transaction_no: (r.n_w, float(r.a_w)) for r in out.collect()}


def test_window_edges_and_ties(spark):
    rows = [(1, "c", "m", 1.0, 0), (2, "c", "m", 2.0, 10 * S), (3, "c", "m", 4.0, 20 * S + 1), (5, "c", "m", 8.0, 30 * S), (4, "c", "m", 16.0, 30 * S), (6, None, "m", 1.0, 0)]
    # exactly W before is inside, a microsecond more is outside; of equal times the lower number comes first
    assert counted(spark, rows) == {1: (1, 1.0), 2: (2, 3.0), 3: (1, 4.0), 4: (2, 20.0), 5: (3, 28.0)}


@pytest.mark.parametrize("span_ms", [1, 1000, 10**9])
def test_signed_deltas_equal_a_range_frame(spark, span_ms):
    r = random.Random(3)
    times = r.sample(range(0, 60 * S), 400)
    rows = [(i, r.choice("ab"), r.choice("xyz"), r.randint(1, 500) / 100, t) for i, t in enumerate(times)]
    frame = Window.partitionBy("card_id").orderBy("us").rangeBetween(-10 * S, 0)
    df = table(spark, rows)
    want = df.select("transaction_no", F.count("*").over(frame).alias("n"), F.sum(F.col("amount").cast(W.MONEY)).over(frame).cast("double").alias("a"), F.size(F.collect_set("merchant").over(frame)).alias("d")).collect()
    assert counted(spark, rows, span_ms=span_ms) == {x.transaction_no: (x.n, x.a) for x in want}
    got = W.sliding_distinct(df, ["card_id"], "merchant", 10_000, "d", span_ms=span_ms).collect()
    assert {x.transaction_no: x.d for x in got} == {x.transaction_no: x.d for x in want}


def test_a_value_stays_while_any_event_has_it(spark):
    rows = [(1, "c", "x", 1.0, 0), (2, "c", "x", 1.0, 8 * S), (3, "c", "y", 1.0, 15 * S), (4, "c", None, 1.0, 19 * S)]
    df = table(spark, rows)
    sets = {r.transaction_no: r.v for r in W.sliding_list(df, ["card_id"], "merchant", 10_000, "v", distinct=True).collect()}
    assert sets == {1: ["x"], 2: ["x"], 3: ["x", "y"], 4: ["y"]}
    lists = {r.transaction_no: r.v for r in W.sliding_list(df, ["card_id"], "merchant", 10_000, "v").collect()}
    assert lists[2] == ["x", "x"]
    last = {r.transaction_no: r.v for r in W.sliding_last(df, ["card_id"], {"v": F.col("merchant")}, 10_000).collect()}
    assert last == {1: "x", 2: "x", 3: "y", 4: "y"}
    with pytest.raises(Exception, match="more than 1 values"):
        W.sliding_list(df, ["card_id"], "merchant", 10_000, "v", most=1).collect()


def test_ties_in_frames(spark):
    df = table(spark, [(2, "c", "y", 1.0, 5), (1, "c", "x", 1.0, 5)])
    assert {r.transaction_no: r.v for r in W.sliding_list(df, ["card_id"], "merchant", 10, "v").collect()} == {1: ["x"], 2: ["x", "y"]}
    assert {r.transaction_no: r.v for r in W.sliding_last(df, ["card_id"], {"v": F.col("merchant")}, 10).collect()} == {1: "x", 2: "y"}


def test_peers_count_all_rows_of_a_time_as_a_range_frame_does(spark):
    """Many cards of one merchant at the same times, as in tables that repeat their rows with other keys."""
    r = random.Random(5)
    rows = [(i, r.choice("abcdef"), r.choice("xy"), r.randint(1, 500) / 100, r.randint(0, 30) * S) for i in range(300)]
    df, frame = table(spark, rows), Window.partitionBy("merchant").orderBy("us").rangeBetween(-10 * S, 0)
    want = {x.transaction_no: x for x in df.select("transaction_no", F.count("*").over(frame).alias("n"), F.size(F.collect_set("card_id").over(frame)).alias("d"), F.array_sort(F.collect_list("card_id").over(frame)).alias("l")).collect()}
    for span_ms in (1000, 10**9):
        n = W.sliding_sums(df, ["merchant"], {"w": 10_000}, {"n": F.lit(1).cast("long")}, span_ms=span_ms, peers=True)
        assert {x.transaction_no: x.n_w for x in n.collect()} == {i: x.n for i, x in want.items()}
        d = W.sliding_distinct(df, ["merchant"], "card_id", 10_000, "d", span_ms=span_ms, peers=True)
        assert {x.transaction_no: x.d for x in d.collect()} == {i: x.d for i, x in want.items()}
        last = W.sliding_last(df, ["merchant"], {"v": F.col("transaction_no")}, 10_000, span_ms=span_ms, peers=True)
        assert {x.transaction_no: x.v for x in last.collect()} == {i: max((u, j) for j, _, m, _, u in rows if m == rows[i][2] and u <= rows[i][4])[1] for i in want}
    held = W.sliding_list(df, ["merchant"], "card_id", 10_000, "v", peers=True)
    assert {x.transaction_no: x.v for x in held.collect()} == {i: x.l for i, x in want.items()}
    rule = R.Rule("m", "COMPUTE", "Merchant", 10_000, record="tx", arg_sql="card_id")
    late = F.col("us") >= 15 * S
    for got in (engine.with_indicators(df, [rule], peers=True), engine.resume_indicators(df.filter(late), df.filter(~late), [rule], peers=True)):
        assert all(x.tx_count_merchant_w10000 == want[x.transaction_no].n and x.tx_list_merchant_w10000 == want[x.transaction_no].l for x in got.collect())


def test_fixed_windows_reopen_past_their_end(spark):
    rows = [(1, "c", "m", 1.0, 5 * S), (2, "c", "m", 1.0, 15 * S), (3, "c", "m", 1.0, 15 * S + 1), (4, "c", "m", 1.0, 90 * S), (5, "d", "m", 1.0, 7 * S)]
    got = W.running_in_window(W.anchored_window(table(spark, rows), ["card_id"], 10_000), ["card_id"], {"n": F.lit(1)}).collect()
    assert {r.transaction_no: (r.window_start // S, r.n) for r in got} == {1: (5, 1), 2: (5, 2), 3: (15, 1), 4: (90, 1), 5: (7, 1)}
    aligned = {r.transaction_no: (r.window_start // S, r.window_end // S) for r in W.epoch_window(table(spark, rows), 10_000).collect()}
    assert aligned[1] == (0, 10) and aligned[3] == (10, 20)


def test_empty_tables(spark):
    none = table(spark, [])
    assert W.sliding_sums(none, ["card_id"], {"w": 1}, {"n": F.lit(1)}).count() == 0
    assert W.anchored_window(none, ["card_id"], 1).count() == 0
    assert engine.check_transactions(none, [R.Rule("r", "COMPUTE", "Card", 1, record="t"), R.Rule("a", "ALERT", "Card", 1, condition_sql="t.count > 0")]).count() == 0


RULES = [
    R.Rule("c", "COMPUTE", "Card", 10_000, record="tx", amount_sql="amount"), R.Rule("m", "COMPUTE", "Merchant", 10_000, record="tx"), R.Rule("p", "COMPUTE", "Custom", 10_000, custom_subject="pair", record="tx"),
    R.Rule("busy card", "ALERT", "Card", 10_000, condition_sql="tx.count >= 2", action="POSTPONE"), R.Rule("busy merchant", "ALERT", "Merchant", 10_000, condition_sql="tx.count >= 2"),
    R.Rule("pair", "ALERT", "Custom", 10_000, custom_subject="pair", condition_sql="tx.count >= 2"), R.Rule("null", "ALERT", "Card", 10_000, condition_sql="amount / 0 > nullif(1, 1)"),
]


def test_alerts_of_all_subjects_meet_in_one_set(spark):
    rows = [(1, "c", "m", 1.0, 0), (2, "c", "m", 1.0, S), (3, None, "m", 1.0, 2 * S), (4, "d", None, 1.0, 3 * S), (5, "e", "z", 1.0, 60 * S), (6, None, None, 1.0, 61 * S)]
    got = {r.transaction_no: r for r in engine.check_transactions(table(spark, rows), RULES, {"pair": ["card_id", "merchant"]}).collect()}
    assert len(got) == 6
    assert [a.rule_title for a in got[2].alerts] == ["busy card", "busy merchant", "pair"] and got[2].score == 3 / 4
    assert [(a.rule_title, a.key) for a in got[3].alerts] == [("busy merchant", "m")]
    assert (got[4].alert_status, got[4].score) == ("NO_ALERT", 0.0) and got[6].alerts == []


def test_merge_drops_duplicates(spark):
    kind = "transaction_no long, alerts array<struct<rule_title:string,message:string,action:string,subject:string,key:string,window_ms:bigint>>"
    a, b = ("r", "m", None, "Card", "k", 1), ("s", "m", None, "Card", "k", 1)
    merged = A.merge_alerts(spark.createDataFrame([(1, [a]), (1, [b, a]), (2, []), (2, None)], kind), 4).collect()
    assert {r.transaction_no: ([x.rule_title for x in r.alerts], r.alert_status, r.score) for r in merged} == {1: (["r", "s"], "ALERT", 0.5), 2: ([], "NO_ALERT", 0.0)}


def test_rules_are_checked_and_read(spark):
    bad = R.check([*RULES, R.Rule("typo", "ALERT", "Card", 1, condition_sql="amuont > 1"), R.Rule("none", "ALERT", "Card", 1, condition_sql="other.count > 1"), R.Rule("long", "ALERT", "Card", 1, condition_sql="amount")], table(spark, []))
    assert set(bad) == {"typo", "none", "long"}
    held = R.as_table(spark, RULES, "rs", "1")
    assert read_rules(held, "rs", "1").count() == len(RULES)
    with pytest.raises(ValueError, match="no rules"):
        read_rules(held, "rs", "2")
    assert R.rule_counts(held).first().n_alert_rules == 4


def test_error_rows(spark):
    df = table(spark, [(None, "c", "m", 1.0, 0), (1, None, "m", 1.0, 0), (2, "c", "m", None, 0), (3, "c", "m", 1.0, 0)])
    good, bad = split_errors(df, transaction_checks())
    assert [r.transaction_no for r in good.collect()] == [3]
    assert sorted(r.error_message for r in bad.collect()) == ["amount is not positive", "card is missing", "transaction number is missing"]


def test_requests(spark):
    snapshot = spark.createDataFrame([("Card", None, "k", 86_400_000, "tx", 3, 1.0), ("Card", None, "k", 3_600_000, "tx", 1, 1.0), ("Card", None, "k", None, "all", 9, 9.0), ("Card", None, "kk", None, "all", 1, 1.0)], "subject string, custom_subject string, key string, window_ms long, record string, count long, amount double")
    requests = spark.createDataFrame([(1, "Card", None, "k", None), (2, "Card", None, "k", 0), (3, "Card", None, "k", 3_600_000), (4, "Card", None, "k", 5), (5, None, None, "k", None), (6, "Card", None, "q", None)], "request_id long, subject string, custom_subject string, key string, timeframe long")
    got = {}
    for r in state.query_indicators(requests, snapshot).collect():
        got.setdefault(r.request_id, set()).add(r.name or r.error_message)
    assert got == {1: {"tx-1d", "tx-1h", "all"}, 2: {"tx-1d", "tx-1h", "all"}, 3: {"tx-1h", "all"}, 4: {"all"}, 5: {"subject is missing"}, 6: {None}}
    assert state.purge(snapshot, ["Card"]).count() == 0


def test_gate_and_versions(spark):
    rows = table(spark, [(i, "c", "m", 1.0, i * S) for i in range(8)])
    intervals = spark.createDataFrame([(2 * S, 4 * S), (3 * S, 5 * S), (7 * S, None)], "started_us long, ended_us long")
    got = {r.transaction_no: r.gate_status for r in gate.deployment_gate(rows, intervals).collect()}
    assert [i for i in range(8) if got[i]] == [2, 3, 4, 7] and got[2] == "ALERT_UNAVAILABLE"
    versions = spark.createDataFrame([(2 * S, "a"), (5 * S, "b"), (-10 * 86_400 * S, "old")], "from_us long, version string")
    assert [r.version for r in gate.ruleset_asof(rows, versions).orderBy("transaction_no").collect()] == ["old", "old", "a", "a", "a", "b", "b", "b"]
    deployed = spark.createDataFrame([("r", "1", 1, True), ("r", "2", 2, True), ("r", "3", 3, False), ("q", "1", 1, False)], "ruleset string, version string, requested_us long, valid boolean")
    assert {r.ruleset: (r.requested, r.active) for r in gate.active_ruleset(deployed).collect()} == {"r": ("3", "2"), "q": ("1", None)}


@pytest.mark.parametrize("most", [0, 10**6])
def test_gate_and_versions_on_a_hot_day(spark, monkeypatch, most):
    monkeypatch.setattr(gate, "BROADCAST_POINTS", most)
    r = random.Random(8)
    times = [r.randrange(3 * 86_400 * S) if r.random() < 0.3 else 86_400 * S + r.randrange(50) for _ in range(400)]
    rows = table(spark, [(i, "c", "m", 1.0, t) for i, t in enumerate(times)])
    spans = [(a := r.choice([r.randrange(3 * 86_400 * S), 86_400 * S + r.randrange(50)]), r.choice([a + r.randrange(1, 10**9), a + r.randrange(1, 30), None if r.random() < 0.1 else a])) for _ in range(60)]
    intervals = spark.createDataFrame(spans, "started_us long, ended_us long")
    got = {x.transaction_no: x.inside for x in gate.in_intervals(rows, intervals).collect()}
    assert got == {i: any(a <= t and (b is None or t < b) for a, b in spans) for i, t in enumerate(times)}
    versions = spark.createDataFrame([(a, f"v{i:02}") for i, (a, _) in enumerate(spans)], "from_us long, version string")
    got = {x.transaction_no: x.version for x in gate.ruleset_asof(rows, versions).collect()}
    assert got == {i: max(((a, f"v{k:02}") for k, (a, _) in enumerate(spans) if a <= t), default=(0, None))[1] for i, t in enumerate(times)}
    plan = gate.in_intervals(rows.drop("ts"), intervals)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transaction_no#") and plan.count("Union") == 0
    assert gate.in_intervals(rows, intervals.limit(0)).filter("inside").count() == 0


@pytest.mark.parametrize("most", [0, 10**6])
def test_crowded_points_are_cut_again(spark, monkeypatch, most):
    monkeypatch.setattr(gate, "BROADCAST_POINTS", most)
    monkeypatch.setattr(gate, "MOST_POINTS", 4)
    r = random.Random(12)
    hour = [1_700_000_000 * S + r.randrange(3_600 * S) for _ in range(300)]
    crowd = [hour[0] + r.randrange(200) for _ in range(300)]
    points = [0, *hour, *crowd, *crowd[:20]]  # one of 1970, an hour, and in it less than a millisecond
    times = [-5, 0, 7, *(r.choice(points) + r.randrange(-3, 4) for _ in range(400)), 2_000_000_000 * S]
    rows = table(spark, [(i, "c", "m", 1.0, t) for i, t in enumerate(times)])
    versions = spark.createDataFrame([(p, f"v{i:04}") for i, p in enumerate(points)], "from_us long, version string")
    held, seen = gate._stretches, []

    def watched(kept):
        dims, crowded = held(kept)
        seen.append(dims.agg(F.max(F.size("_points"))).first()[0] or 0)
        return dims, crowded

    monkeypatch.setattr(gate, "_stretches", watched)
    got = {x.transaction_no: x.version for x in gate.ruleset_asof(rows, versions).collect()}
    order = sorted((p, f"v{i:04}") for i, p in enumerate(points))
    assert got == {i: next((v for p, v in reversed(order) if p <= t), None) for i, t in enumerate(times)}
    assert len(seen) > 1 and max(seen) <= 4


@pytest.mark.parametrize(("seed", "span_windows"), [(1, 1), (2, 3), (3, 8)])
def test_fixed_windows_equal_a_walk(spark, seed, span_windows):
    r = random.Random(seed)
    rows = [(i, r.choice("abc"), "m", 1.0, (r.randrange(4000) if r.random() < 0.8 else r.randrange(40_000)) * 1000 - 500_000) for i in range(700)]
    want, now = {}, {}
    for no, key, _, _, us in sorted(rows, key=lambda x: (x[4], x[0])):
        if key not in now or us > now[key] + 100_000:
            now[key] = us
        want[no] = now[key]
    got = W.anchored_window(table(spark, rows), ["card_id"], 100, span_windows=span_windows).collect()
    assert {x.transaction_no: x.window_start for x in got} == want and all(x.window_end == x.window_start + 100_000 for x in got)


def test_exact_quantiles(spark):
    r = random.Random(4)
    for values in ([r.lognormvariate(0, 8) for _ in range(500)], [1e-300, 5.0, 1e300], [float(r.randrange(3)) for _ in range(100)], [-2.5], []):
        got = metrics.summary(spark.createDataFrame([(v,) for v in values], "v double"), F.when(F.abs("v") < 1e17, F.col("v")), "x").first()
        kept = sorted(v for v in values if abs(v) < 1e17)
        assert got.x_count == len(kept)
        for q, x in ((0.5, got.x_p50), (0.95, got.x_p95), (0.99, got.x_p99)):
            at = (len(kept) - 1) * q
            want = kept[int(at)] + (kept[min(int(at) + 1, len(kept) - 1)] - kept[int(at)]) * (at - int(at)) if kept else None
            assert x == (None if want is None else pytest.approx(want, rel=1e-9, abs=1e-6))


def test_durations_and_keys(spark):
    df = spark.createDataFrame([(604_800_000,), (43_200_000,), (90_000,), (250,), (0,), (None,)], "ms long")
    assert [r[0] for r in df.select(C.human_duration(F.col("ms"))).collect()] == ["7d", "12h", "90s", "250ms", "0ms", None]
    df = spark.createDataFrame([("a:b:c",), (":b",), ("plain",)], "k string")
    assert [r[0] for r in df.select(C.after_colon(F.col("k"))).collect()] == ["b:c", ":b", "plain"]


def test_summaries(spark):
    df = spark.range(1, 101)
    r = metrics.summary(df, F.col("id"), "x").first()
    assert (r.x_count, r.x_sum, r.x_max, r.x_p50) == (100, 5050.0, 100.0, 50.5)
    assert metrics.summary(df, F.col("id"), "x", accuracy=1000).first().x_p50 == 50.0


def test_plans_push_down_and_share_a_shuffle(spark, sf):
    from tallyframe.sources.transactions import read_transactions

    df = read_transactions(spark, sf)
    plan = W.sliding_sums(df, ["card_id"], {"a": 1000, "b": 2000, "c": 3000}, {"n": F.lit(1).cast("long")}).select("transaction_no", "n_a", "n_b", "n_c")._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert "BroadcastNestedLoop" not in plan and "Cartesian" not in plan


def test_a_chain_of_indicators_reads_its_rows_a_few_times_for_each_rule(spark, sf):
    from tallyframe.sources.transactions import read_transactions

    def scans(n):
        rules = [R.Rule(f"r{i}", "COMPUTE", "Card", 1000 * (i + 1), fixed=i % 2 == 0, record="tx", last_sql="merchant", arg_sql="merchant") for i in range(n)]
        return engine.with_indicators(read_transactions(spark, sf), rules)._jdf.queryExecution().optimizedPlan().toString().count("Relation [")

    assert scans(6) <= 3 * scans(2)


# Streams over several files, in the order of their times.


def stream(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        path = tmp_path / f"{i}"
        if path.exists():  # there since an earlier call
            continue
        spark.createDataFrame(rows, "event_id long, user_id string, event_type string, value double, us long").withColumn("ts", F.timestamp_micros("us").cast("timestamp_ntz")).coalesce(1).write.parquet(str(path))
        for f in path.glob("*.parquet"):
            f.rename(tmp_path / f"part{i}.parquet")
            os.utime(tmp_path / f"part{i}.parquet", (time.time() - 1000 + i,) * 2)
    df = spark.readStream.schema("event_id long, user_id string, event_type string, value double, us long, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/part*.parquet")
    return normalise(df, EVENT_MAPPING | {"argument": "null", "payload": "null"})


def batches(seed, shuffled=0):
    r = random.Random(seed)
    rows = [(i, r.choice("ab"), r.choice("xy"), r.randint(1, 900) / 100, t * 1000) for i, t in enumerate(sorted(r.sample(range(120_000), 90)))]
    return [rows[:30], rows[30:60], rows[60:]]


def test_state_carries_over_micro_batches(spark, tmp_path):
    parts = batches(1)
    got = jobs.drained(jobs.sliding(stream(spark, tmp_path, parts), ["card_id"], {"w": 10_000}), "append").collect()
    want = counted(spark, [x for p in parts for x in p])
    assert {r.transaction_no: (r.n_w, round(r.amount_w, 2)) for r in got} == want


def test_event_time_order_equals_the_batch(spark, tmp_path):
    parts = batches(2)
    mixed = [sorted(p, key=lambda x: x[0] % 7) for p in parts]
    last = (999, "a", "x", 1.0, 10**12)
    got = jobs.drained(jobs.sliding(stream(spark, tmp_path, [*mixed, [last]]), ["card_id"], {"w": 10_000}, order="event_time", delay="1 second"), "append").collect()
    want = counted(spark, [x for p in parts for x in p])
    assert {r.transaction_no: (r.n_w, round(r.amount_w, 2)) for r in got} == want


def test_a_late_row_joins_the_state_in_arrival_order(spark, tmp_path):
    rows = [[(1, "c", "x", 1.0, 20 * S)], [(2, "c", "x", 1.0, 15 * S)], [(3, "c", "x", 1.0, 21 * S)]]
    got = jobs.drained(jobs.sliding(stream(spark, tmp_path, rows), ["card_id"], {"w": 10_000}), "append").collect()
    assert {r.transaction_no: r.n_w for r in got} == {1: 1, 2: 1, 3: 3}


def test_fixed_windows_over_micro_batches(spark, tmp_path):
    parts = batches(3)
    got = jobs.drained(jobs.fixed(stream(spark, tmp_path, parts), ["card_id"], 10_000), "append").collect()
    want = W.running_in_window(W.anchored_window(table(spark, [x for p in parts for x in p]), ["card_id"], 10_000), ["card_id"], {"n": F.lit(1)}).collect()
    assert {r.transaction_no: (r.window_start, r.n) for r in got} == {r.transaction_no: (r.window_start, r.n) for r in want}


def test_gated_answers_and_alert_sets(spark, tmp_path):
    parts = batches(4)
    gates = spark.createDataFrame([(10 * S, 40 * S)], "started_us long, ended_us long")
    rules = [R.Rule("busy", "ALERT", "Card", 10_000, condition_sql="tx.count >= 4")]
    open_, postponed = jobs.gated(stream(spark, tmp_path, parts), gates)
    answers, sets = jobs.answered(jobs.alerted(open_, "Card", "card_id", rules))
    rows = [x for p in parts for x in p]
    outside = [x for x in rows if not 10 * S <= x[4] < 40 * S]
    want = {i: n >= 4 for i, (n, _) in counted(spark, outside).items()}
    assert {r.transaction_no: bool(r.alerts) for r in answers.collect()} == want
    assert {r.transaction_no for r in sets.collect()} == {i for i, alert in want.items() if alert}
    assert {r.transaction_no for r in jobs.drained(postponed, "append").collect()} == {x[0] for x in rows} - set(want)


def test_alert_rules_change_between_micro_batches(spark, tmp_path):
    parts = batches(6)
    compute = [R.Rule("c", "COMPUTE", "Card", 10_000, record="tx", amount_sql="amount", value_sqls=(("x", "amount * 2"),)), R.Rule("m", "COMPUTE", "Merchant", None, record="tx", scope="global")]
    versions = [[R.Rule("first", "ALERT", "Card", 10_000, condition_sql="tx.values.x > 20")], [R.Rule("second", "ALERT", "Merchant", None, condition_sql="global.tx.count > 5")]]
    folder = tmp_path / "job"
    job = jobs.Job(spark, f"file://{folder}")
    job.start(stream(spark, tmp_path, parts), compute, lambda: versions[(folder / "done").exists()]).wait()
    answers = job.answers()
    rows = [x for p in parts for x in p]
    amounts = {i: a for i, (_, a) in counted(spark, rows).items()}
    seen, want = {}, {}
    for i, _, merchant, _, _ in rows:
        seen[merchant] = seen.get(merchant, 0) + 1
        want[i] = (["first"] if 2 * amounts[i] > 20 else []) if i in {x[0] for x in parts[0]} else (["second"] if seen[merchant] > 5 else [])
    assert {r.transaction_no: [a.rule_title for a in r.alerts] for r in answers.collect()} == want


HOLDING = [
    R.Rule("c", "COMPUTE", "Card", 10_000, record="tx", arg_sql="merchant", last_sql="if(amount > 3, merchant, null)"),
    R.Rule("big", "COMPUTE", "Card", 25_000, record="big", filter_sql="amount > 5", arg_sql="amount", last_sql="amount"),
    R.Rule("m", "COMPUTE", "Merchant", None, record="tx", scope="global", last_sql="if(amount > 7, card_id, null)"),
    R.Rule("f", "COMPUTE", "Card", 15_000, fixed=True, record="tx", arg_sql="if(amount > 2, merchant, null)", last_sql="if(amount > 6, merchant, null)"),
]
HELD = {"card": ["tx_list_card_w10000", "tx_set_card_w10000", "tx_last_card_w10000", "big_list_card_w25000", "big_set_card_w25000", "big_last_card_w25000", "tx_list_card_fw15000", "tx_set_card_fw15000", "tx_last_card_fw15000"], "merchant": ["tx_last_merchant_global"]}


def test_lists_and_last_values_in_fixed_windows(spark):
    rows = [x for p in batches(10) for x in p]
    got = {r.transaction_no: r for r in engine.with_indicators(table(spark, rows), HOLDING).collect()}
    ends, values, recent = {}, {}, {}
    for i, card, merchant, amount, us in rows:
        if us > ends.get(card, -1):
            ends[card], values[card], recent[card] = us + 15 * S, [], None
        values[card] = sorted([*values[card], *([merchant] if amount > 2 else [])])
        recent[card] = merchant if amount > 6 else recent[card]
        r = got[i]
        assert (r.tx_list_card_fw15000, r.tx_set_card_fw15000, r.tx_last_card_fw15000) == (values[card], sorted(set(values[card])), recent[card])


@pytest.mark.parametrize("order", ["arrival", "event_time"])
def test_lists_sets_and_last_values_of_a_stream_equal_the_batch(spark, tmp_path, order):
    parts = batches(8)
    mixed = parts if order == "arrival" else [*(sorted(p, key=lambda x: x[0] % 7) for p in parts), [(999, "a", "x", 1.0, 10**12)]]
    got = jobs.drained(jobs.indicators(stream(spark, tmp_path, mixed), HOLDING, order=order, delay="0 seconds" if order == "arrival" else "1 second"), "append").collect()
    want = {r.transaction_no: r for r in engine.with_indicators(table(spark, [x for p in parts for x in p]), HOLDING).collect()}
    assert len(got) == 2 * len(want)
    for r in got:
        for c in HELD[r.subject]:
            assert r[c] == want[r.transaction_no][c], (r.transaction_no, c)


def test_a_late_text_joins_the_state_in_arrival_order(spark, tmp_path):
    rows = [[(1, "c", "x", 1.0, 20 * S)], [(2, "c", "y", 9.0, 15 * S)], [(3, "c", None, 1.0, 21 * S)]]
    rules = [R.Rule("c", "COMPUTE", "Card", 10_000, record="tx", arg_sql="merchant", last_sql="merchant"), R.Rule("g", "COMPUTE", "Card", None, record="tx", scope="global", last_sql="merchant")]
    got = {r.transaction_no: r for r in jobs.drained(jobs.indicators(stream(spark, tmp_path, rows), rules), "append").collect()}
    assert {i: (r.tx_list_card_w10000, r.tx_last_card_w10000, r.tx_last_card_global) for i, r in got.items()} == {1: (["x"], "x", "x"), 2: (["y"], "y", "x"), 3: (["x", "y"], "x", "x")}


def test_live_state_holds_lists_and_last_values(spark, tmp_path):
    parts = batches(9)
    columns = ["subject", "key", "record", "window_ms", "count", "arg_list", "arg_set", "last"]
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert rows(jobs.live_indicators(spark, stream(spark, tmp_path, parts), HOLDING)) == rows(engine.indicator_state(table(spark, [x for p in parts for x in p]), HOLDING))


def test_transactions_without_any_key_are_answered(spark, tmp_path):
    rows = [[(1, None, None, 1.0, 0), (2, "c", None, 1.0, S)]]
    rules = [R.Rule("c", "COMPUTE", "Card", 10_000, record="tx"), R.Rule("a", "ALERT", "Card", 10_000, condition_sql="tx.count >= 1")]
    answers, _ = jobs.scored(stream(spark, tmp_path, rows), rules[:1], lambda: rules[1:])
    assert {r.transaction_no: r.alert_status for r in answers.collect()} == {1: "NO_ALERT", 2: "ALERT"}


def test_windows_of_idle_keys_leave_the_state(spark, tmp_path):
    rows = [[(1, "a", "x", 1.0, 0), (2, "b", "x", 1.0, S)], [(3, "b", "x", 1.0, 100 * S)], [(4, "b", "x", 1.0, 200 * S)]]
    held = jobs.live_state(spark, jobs.sliding(stream(spark, tmp_path, rows), ["card_id"], {"w": 10_000}, order="event_time"), "totals")
    assert {r[0] for r in held.select("key.card_id").distinct().collect()} <= {"b"}


def test_fixed_windows_of_idle_keys_leave_the_state(spark, tmp_path):
    rows = [[(1, "a", "x", 1.0, 0), (2, "b", "x", 1.0, S)], [(3, "b", "x", 1.0, 100 * S)], [(4, "b", "x", 1.0, 200 * S)]]
    held = jobs.live_state(spark, jobs.fixed(stream(spark, tmp_path, rows), ["card_id"], 10_000, order="event_time"), "fixed")
    assert {r[0] for r in held.select("key.card_id").distinct().collect()} <= {"b"}


def test_fixed_windows_in_event_time_order_equal_the_batch(spark, tmp_path):
    parts = batches(7)
    mixed = [*(sorted(p, key=lambda x: x[0] % 7) for p in parts), [(999, "c", "x", 1.0, 10**12)]]
    got = jobs.drained(jobs.fixed(stream(spark, tmp_path, mixed), ["card_id"], 3_000, order="event_time", delay="1 second"), "append").collect()
    want = W.running_in_window(W.anchored_window(table(spark, [x for p in parts for x in p]), ["card_id"], 3_000), ["card_id"], {"n": F.lit(1)}).collect()
    assert {r.transaction_no: (r.window_start, r.n) for r in got} == {r.transaction_no: (r.window_start, r.n) for r in want}


def test_rules_survive_their_table(spark):
    rules = [R.Rule("c", "COMPUTE", "Card", 10_000, record="tx", amount_sql="amount", value_sqls=(("k", "1"),), arg_sql="merchant", last_sql="merchant"), R.Rule("d", "ALERT", "Custom", 5, fixed=True, custom_subject="pair", group="g", condition_sql="tx.count > 1", message="m", action="POSTPONE")]
    assert R.from_table(read_rules(R.as_table(spark, rules, "rs", "1"), "rs", "1")) == rules
    with pytest.raises(ValueError, match="more than 1 rules"):
        R.from_table(R.as_table(spark, rules, "rs", "1"), most=1)


def test_counters_seen_while_another_action_runs(spark):
    rows = [(1, "c", "m", 1.0, 0), (2, "c", "m", 1.0, S)]
    answers, seen = metrics.observed(engine.check_transactions(table(spark, rows), RULES[:1] + RULES[3:4]))
    assert answers.count() == 2
    assert seen.get["processed"] == 2 and seen.get["alerted"] == 1
