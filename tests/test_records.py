"""Records of several rules, exact values, failing rules, states to go on from, and jobs that stop, go on and are asked while they run."""

import math
import random
import time
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import rules as R, state, sums, windows as W
from tallyframe.operators.records import records
from tallyframe.plans import engine
from tallyframe.sources.transactions import read_transactions
from tallyframe.streaming import jobs
from tests.test_operators import S, batches, stream, table

MIXED = [1e15, -1e15, 1e-9, -1e-9, 0.1, -0.3, 3.0, 2.0**200, -(2.0**200), 2.0**-120, 1e22, 123456789.123456789, 0.0, -7e14]


def near(got, exact):
    """Whether a double is within its last bit of an exact sum."""
    return abs(Fraction(got) - exact) <= Fraction(math.ulp(float(exact)))


def test_parts_are_exact(spark):
    values = [*MIXED, None, float("nan"), float("inf"), 1e80]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for v, *got in df.select("v", *sums.parts(F.col("v"), "double")).collect():
        want = 0 if v is None or v != v or abs(v) >= sums.BEYOND else Fraction(v)
        assert sum(Fraction(d) * Fraction(2) ** (sums.BITS * (sums.LOWEST + k)) for k, d in enumerate(got) if d is not None) == want
        assert all(d is None or abs(d) <= 2**62 for d in got)
    whole = df.select(sums.whole([F.coalesce(p, F.lit(0)) for p in sums.parts(F.col("v"), "double")], "double").alias("w"), "v").collect()
    assert all(r.w == (0 if r.v is None or r.v != r.v or abs(r.v) >= sums.BEYOND else r.v) for r in whole)
    wide = spark.createDataFrame([("12345678901234567890123.456789",), ("-99999999999999999999999999.999999",), ("0.000001",)], "v string").select(F.col("v").cast("decimal(38,6)").alias("v"))
    assert all(r.v == r.w for r in wide.select("v", sums.whole(sums.parts(F.col("v"), "decimal(38,6)"), "decimal(38,6)").alias("w")).collect())


def typed_rows(seed):
    r = random.Random(seed)
    return [(i, r.choice("ab"), "x", r.choice(MIXED) * r.choice([1, 1, r.random()]), t * 1000) for i, t in enumerate(sorted(r.sample(range(90_000), 80)))]


VALUES = [R.Rule("v", "COMPUTE", "Card", 10_000, record="tx", value_sqls=(("d", "amount"), ("n", "transaction_no * 1000000000000000"), ("m", "cast(transaction_no as decimal(20,3)) / 8")))]


def windowed(rows, ms):
    for i, card, _, amount, us in rows:
        yield i, [x for x in rows if x[1] == card and us - ms * 1000 <= x[4] <= us and (x[4], x[0]) <= (us, i)]


@pytest.mark.parametrize("way", ["batch", "stream"])
def test_values_of_all_sizes_are_summed_exactly(spark, tmp_path, way):
    rows = typed_rows(1)
    if way == "batch":
        got = engine.with_indicators(table(spark, rows), VALUES)
    else:
        got = jobs.drained(jobs.indicators(stream(spark, tmp_path, [rows[:40], rows[40:]]), VALUES), "append")
    got = {r.transaction_no: r for r in got.collect()}
    for i, inside in windowed(rows, 10_000):
        r = got[i]
        assert near(r.tx_value_d_card_w10000, sum(Fraction(x[3]) for x in inside)), i
        assert r.tx_value_n_card_w10000 == sum(x[0] for x in inside) * 10**15
        assert Fraction(r.tx_value_m_card_w10000) == sum(Fraction(x[0], 8) for x in inside)


def test_what_can_not_be_summed_fails_its_rule(spark):
    rows = [(1, "c", "m", 1e80, 0), (2, "c", "m", 5.0, S), (3, "c", "m", float("nan"), 2 * S), (4, "c", "m", None, 3 * S)]
    rules = [R.Rule("big", "COMPUTE", "Card", 10_000, record="tx", value_sqls=(("v", "amount"),)), R.Rule("money", "COMPUTE", "Card", 10_000, record="m", amount_sql="amount * 10000000000000000"), R.Rule("seen", "ALERT", "Card", 10_000, condition_sql="tx.values.v = 5 and tx.count > 1")]
    got = {r.transaction_no: r for r in engine.check_transactions(table(spark, rows), rules).collect()}
    assert {i: r.rule_errors for i, r in got.items()} == {1: ["big", "money"], 2: ["money"], 3: ["big", "money"], 4: []}
    assert sorted(i for i, r in got.items() if r.alerts) == [2, 3, 4]


SHARING = [
    R.Rule("a", "COMPUTE", "Card", 10_000, record="tx", filter_sql="merchant = 'x'", amount_sql="amount", arg_sql="merchant", last_sql="'a'"),
    R.Rule("b", "COMPUTE", "Card", 10_000, record="tx", filter_sql="amount > 4", amount_sql="amount * 2", arg_sql="cast(amount as int)", last_sql="'b'", value_sqls=(("v", "amount"),)),
    R.Rule("c", "COMPUTE", "Card", 30_000, record="tx", filter_sql="merchant = 'y'"),
    R.Rule("d", "COMPUTE", "Card", 15_000, fixed=True, record="tx", filter_sql="merchant = 'x'", arg_sql="merchant", last_sql="merchant", amount_sql="amount"),
    R.Rule("e", "COMPUTE", "Card", 15_000, fixed=True, record="tx", filter_sql="amount > 4"),
    R.Rule("f", "COMPUTE", "Merchant", None, record="tx", filter_sql="amount > 3", scope="global", value_sqls=(("v", "amount"),), last_sql="card_id"),
    R.Rule("g", "COMPUTE", "Merchant", None, record="tx", filter_sql="card_id = 'a'", scope="global", amount_sql="amount"),
    R.Rule("h", "COMPUTE", "Custom", 20_000, custom_subject="Pair", record="tx", arg_sql="amount"),
]
PAIR = {"pair": ["card_id", "merchant"]}
FIELDS = ["tx_count_card_w10000", "tx_amount_card_w10000", "tx_value_v_card_w10000", "tx_list_card_w10000", "tx_set_card_w10000", "tx_last_card_w10000", "tx_count_card_w30000", "tx_count_card_fw15000", "tx_amount_card_fw15000", "tx_list_card_fw15000", "tx_set_card_fw15000", "tx_last_card_fw15000"]
OTHERS = {"merchant": ["tx_count_merchant_global", "tx_amount_merchant_global", "tx_value_v_merchant_global", "tx_last_merchant_global"], "pair": ["tx_count_custom_pair_w20000", "tx_list_custom_pair_w20000"]}


def test_rules_that_share_a_record_add_up(spark):
    rows = [x for p in batches(21) for x in p]
    got = {r.transaction_no: r for r in engine.with_indicators(table(spark, rows), SHARING, PAIR).collect()}
    for i, inside in windowed(rows, 10_000):
        r = got[i]
        xs, large = [x for x in inside if x[2] == "x"], [x for x in inside if x[3] > 4]
        assert r.tx_count_card_w10000 == len(xs) + len(large)
        assert float(r.tx_amount_card_w10000) == pytest.approx(sum(x[3] for x in xs) + 2 * sum(x[3] for x in large))
        assert r.tx_list_card_w10000 == sorted(["x"] * len(xs) + [str(int(x[3])) for x in large])
        assert r.tx_last_card_w10000 == max(((x[4], x[0], "b" if x[3] > 4 else "a") for x in xs + large), default=(None,))[-1]
    for i, inside in windowed(rows, 30_000):
        assert got[i].tx_count_card_w30000 == sum(x[2] == "y" for x in inside)


def test_rules_that_share_a_record_in_a_stream_equal_the_batch(spark, tmp_path):
    parts = batches(22)
    want = {r.transaction_no: r for r in engine.with_indicators(table(spark, [x for p in parts for x in p]), SHARING, PAIR).collect()}
    got = jobs.drained(jobs.indicators(stream(spark, tmp_path, parts), SHARING, PAIR), "append").collect()
    assert len(got) == 3 * len(want)
    for r in got:
        for c in {"card": FIELDS, **OTHERS}[r.subject]:
            assert r[c] == want[r.transaction_no][c], (r.transaction_no, c)


def test_measures_that_are_fed_alike_share_their_sums(spark):
    one = R.Rule("1", "COMPUTE", "Card", 1000, record="tx", amount_sql="amount")
    other = R.Rule("2", "COMPUTE", "Card", 2000, record="tx", amount_sql="amount")
    a, b = records([one, other], table(spark, []))
    assert [m.slots for m in a.measures] == [m.slots for m in b.measures]


def test_failing_is_not_having_no_result(spark):
    rows = [(i, "c", m, a, i * S) for i, (m, a) in enumerate([("x", 1.0), ("7", 50.0), ("y", None), ("9", 0.0)])]
    cases = {"case when amount > 30 then true end": [], "1 / amount > 0": [3], "cast(merchant as int) = 7": [0, 2], "amount > 5": [], "if(amount > 30, raise_error('no'), true)": [1], "element_at(array(1, 2), cast(amount as int)) = 1": [1, 3], "1 / amount > 0 and amount > 30": [3]}
    rules = [R.Rule("c", "COMPUTE", "Card", 10_000, record="tx"), *(R.Rule(sql, "ALERT", "Card", 10_000, condition_sql=sql) for sql in cases)]
    got = engine.check_transactions(table(spark, rows), rules).collect()
    for sql, want in cases.items():
        assert sorted(r.transaction_no for r in got if sql in r.rule_errors) == want, sql
    assert sorted(a.rule_title for r in got if r.transaction_no == 1 for a in r.alerts) == sorted(s for s in cases if s.startswith(("case", "1 / amount", "cast", "amount")))


def test_a_condition_is_evaluated_once(spark, sf):
    """Before, alerts and failures each evaluated it, alerts twice and again for each alert of a row."""
    rules = [R.Rule("c", "COMPUTE", "Card", 10_000, record="tx"), *(R.Rule(f"r{i}", "ALERT", "Card", 10_000, condition_sql=f"tx.count + {7_770 + i} > 5 or 1 / (tx.count - 1) > 0") for i in range(2))]
    found = engine.check_transactions(read_transactions(spark, sf), rules).select("alerts", "rule_errors", "score")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(f" + {7_770 + i})") for i in range(2)] == [1, 1]


def test_rules_that_do_not_resolve_are_left_out(spark):
    rows = [(1, "c", "m", 1.0, 0)]
    bad = {
        "typo": R.Rule("typo", "ALERT", "Card", 10_000, condition_sql="amuont > 1"), "no window": R.Rule("no window", "COMPUTE", "Card", None, record="w"), "elsewhere": R.Rule("elsewhere", "ALERT", "Card", 20_000, condition_sql="tx.count > 0"),
        "keyless": R.Rule("keyless", "COMPUTE", "Custom", 10_000, custom_subject="lost", record="k"), "wrong sum": R.Rule("wrong sum", "COMPUTE", "Card", 10_000, record="s", amount_sql="nothing"),
        "of a bad one": R.Rule("of a bad one", "ALERT", "Card", 10_000, condition_sql="s.count > 0"), "kind": R.Rule("kind", "OTHER", "Card"), "text": R.Rule("text", "ALERT", "Card", 10_000, condition_sql="merchant"), "list": R.Rule("list", "COMPUTE", "Card", None, record="l", scope="global", arg_sql="merchant"),
    }
    good = [R.Rule("c", "COMPUTE", "Card", 10_000, record="tx"), R.Rule("seen", "ALERT", "Card", 10_000, condition_sql="tx.count > 0")]
    assert set(R.check([*good, *bad.values()], table(spark, []), {})) == set(bad)
    r = engine.check_transactions(table(spark, rows), [*good, *bad.values()]).first()
    assert ([a.rule_title for a in r.alerts], r.score, sorted(r.rule_errors)) == (["seen"], 1.0, sorted(bad))
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


# States to go on from.


def test_half_and_half_equals_the_whole(spark, tmp_path):
    r = random.Random(31)
    rows = [(i, r.choice(["a", "b", "c", None]), r.choice("xy"), r.randint(1, 900) / 100, t * 1000) for i, t in enumerate(sorted(r.sample(range(200_000), 150)))]
    whole = {x.transaction_no: x for x in engine.with_indicators(table(spark, rows), SHARING, PAIR).collect()}
    held = None
    for n, part in enumerate((rows[:40], rows[40:100], rows[100:])):
        for x in engine.with_indicators(table(spark, part), SHARING, PAIR, held).collect():
            for c in [*FIELDS, *(c for cs in OTHERS.values() for c in cs)]:
                assert x[c] == whole[x.transaction_no][c], (x.transaction_no, c)
        engine.next_state(table(spark, part), SHARING, PAIR, held).write(f"file://{tmp_path}/{n}")
        held = state.read_state(spark, f"file://{tmp_path}/{n}")
    rows_of = lambda df: sorted(map(str, df.select("subject", "custom_subject", "key", "window_ms", "fixed", "record", "count", "amount", "values", "arg_list", "arg_set", "last", "sums", "window_end", "as_of").collect()))
    assert rows_of(held.records) == rows_of(engine.indicator_state(table(spark, rows), SHARING, PAIR))


def test_a_fixed_window_goes_on_in_the_span_where_it_opened(spark):
    r = random.Random(5)
    rows = [(i, r.choice("ab"), "x", 1.0, t * 1000) for i, t in enumerate(sorted(r.sample(range(3000), 600)))]
    rule = [R.Rule("f", "COMPUTE", "Card", 100, fixed=True, record="tx")]
    whole = {x.transaction_no: x.tx_count_card_fw100 for x in engine.with_indicators(table(spark, rows), rule).collect()}
    for cut in (37, 300):
        held = engine.next_state(table(spark, rows[:cut]), rule)
        assert {x.transaction_no: x.tx_count_card_fw100 for x in engine.with_indicators(table(spark, rows[cut:]), rule, start=held).collect()} == {i: n for i, n in whole.items() if i >= cut}


def test_windows_of_many_groups_are_placed_together():
    import numpy as np

    r = random.Random(9)
    for _ in range(50):
        groups = [sorted(r.randrange(0, 400) for _ in range(r.randrange(0, 30))) for _ in range(r.randrange(1, 8))]
        entries = [r.choice([None, r.randrange(-50, 120)]) for _ in groups]
        want = []
        for times, end in zip(groups, entries, strict=True):
            for t in times:
                if end is None or t > end:
                    end = t + 40
                want.append(end - 40)
        times = np.array([t for g in groups for t in g], np.int64)
        group = np.array([i for i, g in enumerate(groups) for _ in g], np.int64)
        got = W._placed(times, group, np.array([e or 0 for e in entries], np.int64), np.array([e is not None for e in entries]), 40)
        assert got.tolist() == want


# Jobs.

COMPUTE = [x for x in SHARING if x.kind == "COMPUTE"]
ALERTING = [R.Rule("busy", "ALERT", "Card", 10_000, condition_sql="tx.count >= 5"), R.Rule("much", "ALERT", "Merchant", None, condition_sql="global.tx.count > 20"), R.Rule("fixed", "ALERT", "Card", 15_000, fixed=True, condition_sql="size(tx.list) > 2")]


def titles(df):
    return {r.transaction_no: [a.rule_title for a in r.alerts] for r in df.collect()}


def test_a_job_goes_on_in_another_session(spark, tmp_path):
    parts = batches(41)
    rows = [x for p in parts for x in p]
    folder = f"file://{tmp_path}/job"
    first = jobs.Job(spark, folder).start(stream(spark, tmp_path, parts[:1]), COMPUTE, lambda: ALERTING, PAIR).wait()
    assert len(titles(first.answers())) == len(parts[0])
    other = spark.newSession()
    second = jobs.Job(other, folder).start(stream(other, tmp_path, parts), COMPUTE, lambda: ALERTING, PAIR).wait()
    want = titles(engine.check_transactions(table(spark, rows), [*COMPUTE, *ALERTING], PAIR))
    assert titles(second.answers()) == want
    assert titles(second.answers("alerts")) == {i: a for i, a in want.items() if a}


def test_a_batch_that_comes_again_is_written_once(spark, tmp_path):
    import shutil

    parts = batches(42)
    folder = tmp_path / "job"
    job = jobs.Job(spark, f"file://{folder}").start(stream(spark, tmp_path, parts[:2]), COMPUTE, lambda: ALERTING, PAIR).wait()
    before = titles(job.answers())
    shutil.rmtree(folder / "done" / "batch=1")  # lost between its answers and its mark
    assert len(titles(job.answers())) == len(parts[0])
    for name in ("1", ".1.crc"):
        (folder / "checkpoint" / "commits" / name).unlink()
    jobs.Job(spark, f"file://{folder}").start(stream(spark, tmp_path, parts[:2]), COMPUTE, lambda: ALERTING, PAIR).wait()
    assert titles(job.answers()) == before
    (folder / "checkpoint" / "commits" / "1").unlink()
    (folder / "checkpoint" / "commits" / ".1.crc").unlink()
    loud = jobs.Job(spark, f"file://{folder}").start(stream(spark, tmp_path, parts[:2]), COMPUTE, lambda: [], PAIR).wait()  # its mark is there: nothing is written
    assert titles(loud.answers()) == before


def test_a_job_of_another_layout_is_refused(spark, tmp_path, monkeypatch):
    job = jobs.Job(spark, f"file://{tmp_path}/job").start(stream(spark, tmp_path, batches(43)[:1]), COMPUTE, list, PAIR).wait()
    monkeypatch.setattr(jobs, "LAYOUT", jobs.LAYOUT + 1)
    with pytest.raises(ValueError, match="layout"):
        job.start(stream(spark, tmp_path, batches(43)[:1]), COMPUTE, list, PAIR)


@pytest.mark.parametrize("order", ["arrival", "event_time"])
def test_compute_rules_change_and_the_state_stays(spark, tmp_path, order):
    parts = batches(44)
    rows = [x for p in parts for x in p]
    old = [R.Rule("o", "COMPUTE", "Card", 10_000, record="tx", amount_sql="amount", arg_sql="merchant"), R.Rule("g", "COMPUTE", "Card", None, record="tx", scope="global"), R.Rule("x", "COMPUTE", "Card", 3_000, fixed=True, record="f"), R.Rule("z", "COMPUTE", "Merchant", 5_000, record="gone")]
    new = [R.Rule("n", "COMPUTE", "Card", 40_000, record="more", filter_sql="amount > 4", last_sql="merchant"), *old[:3]]
    alerts = [R.Rule("busy", "ALERT", "Card", 10_000, condition_sql="tx.count >= 4 and size(tx.set) = 2"), R.Rule("fixed", "ALERT", "Card", 3_000, fixed=True, condition_sql="f.count >= 2"), R.Rule("ever", "ALERT", "Card", None, condition_sql="global.tx.count > 30")]
    job = jobs.Job(spark, f"file://{tmp_path}/job")
    job.start(stream(spark, tmp_path, parts[:2]), old, lambda: alerts, order=order).wait()
    end = [] if order == "arrival" else [[(999, "a", "x", 1.0, 10**12)]]
    later = [*alerts, R.Rule("more", "ALERT", "Card", 40_000, condition_sql="more.count >= 3")]
    job.start(stream(spark, tmp_path, [*parts, *end]), new, lambda: later, order=order).wait()
    want = titles(engine.check_transactions(table(spark, rows), [*old[:3], *alerts]))
    got = titles(job.answers())
    assert {i: [t for t in a if t != "more"] for i, a in got.items()} == want
    if order == "arrival":
        fresh = [x for x in rows if x[0] in {y[0] for y in parts[2]}]
        assert {i for i, a in got.items() if "more" in a} == {i for i, inside in windowed(fresh, 40_000) if sum(x[3] > 4 for x in inside) >= 3}
        assert {r.record for r in job.state().collect()} == {"tx", "more", "f"}


def test_a_running_job_is_asked(spark, tmp_path):
    parts = batches(45)
    job = jobs.Job(spark, f"file://{tmp_path}/job")
    source = stream(spark, tmp_path, parts[:1])
    job.start(source, COMPUTE, list, PAIR, trigger={"processingTime": "0 seconds"})
    columns = ["subject", "custom_subject", "key", "window_ms", "fixed", "record", "count", "amount", "values", "arg_list", "arg_set", "last", "sums", "window_end"]
    rows_of = lambda df: sorted(map(str, df.select(*columns).collect()))
    try:
        for n in (1, 2, 3):
            if n > 1:
                stream(spark, tmp_path / "more", [parts[n - 1]]) if not (tmp_path / "more").exists() else stream(spark, tmp_path / f"more{n}", [parts[n - 1]])
                here = next((tmp_path / ("more" if n == 2 else "more3")).glob("part0.parquet"))
                here.rename(tmp_path / f"part{n - 1}.parquet")
                time.sleep(0.1)
            job.query.processAllAvailable()
            assert job.query.isActive
            assert rows_of(job.state()) == rows_of(engine.indicator_state(table(spark, [x for p in parts[:n] for x in p]), SHARING, PAIR))
    finally:
        job.stop()
    assert rows_of(job.state(0)) == rows_of(engine.indicator_state(table(spark, parts[0]), SHARING, PAIR))


def test_idle_keys_leave_the_state_in_arrival_order(spark, tmp_path):
    rows = [[(1, "gone", "x", 1.0, 0), (2, "b", "x", 1.0, S)]]
    base = f"file://{tmp_path}/idle"

    def keys():
        held = spark.read.format("statestore").option("stateVarName", "totals").load(f"{base}/checkpoint")
        return {r[0] for r in held.select("key.card_id").distinct().collect()}

    def until(test):
        for _ in range(60):
            time.sleep(0.5)
            try:
                if test(keys()):
                    return True
            except Exception:  # no batch has been committed yet
                continue
        return False

    with jobs._rocksdb(spark):
        query = jobs.sliding(stream(spark, tmp_path, rows[:1]), ["card_id"], {"w": 10_000}, idle_ms=8_000).writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(processingTime="1 second").format("noop").start()
        try:
            assert until(lambda found: found == {"gone", "b"})
            assert until(lambda found: not found)
        finally:
            query.stop()
    with pytest.raises(ValueError, match="trigger"):
        jobs.Job(spark, f"file://{tmp_path}/job").start(stream(spark, tmp_path, rows[:1]), COMPUTE, list, PAIR, idle_ms=1_000)


def test_money_is_rounded_alike_in_streams_and_batches(spark, tmp_path):
    rows = [(1, "c", "x", 1.005, 0), (2, "c", "x", 1.005, S), (3, "c", "x", None, 2 * S)]
    got = {r.transaction_no: r.amount_w for r in jobs.drained(jobs.sliding(stream(spark, tmp_path, [rows]), ["card_id"], {"w": 10_000}), "append").collect()}
    want = engine.with_indicators(table(spark, rows), [R.Rule("c", "COMPUTE", "Card", 10_000, record="tx", amount_sql="amount")]).collect()
    assert got == {r.transaction_no: float(r.tx_amount_card_w10000) for r in want}
