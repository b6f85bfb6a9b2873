"""Summaries and counters over transactions, alerts and windows."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.observation import Observation

from ..sources.folders import written

QUANTILES = (0.5, 0.95, 0.99)
#: Bars of a histogram, of which at most two for each quantile are refined at a time.
BINS = 1024


def values_at(counts: DataFrame, ranks: set[int]) -> dict[int, float]:
    """The value at each rank (from 0) of a table of values and how often each occurs (v double, n long).

    A histogram of BINS bars is counted for each range of values that holds a rank, then for the bar that holds it,
    until that is one value: a few passes that send a bounded number of bars to the driver.
    """
    lo, hi = counts.agg(F.min("v"), F.max("v")).first()
    open_ranges, found = {(lo, hi, 0): set(ranks)}, {}
    while open_ranges:
        ranges = sorted(open_ranges)
        bar = F.coalesce(*(F.when(F.col("v").between(a, b), F.struct(F.lit(i).alias("i"), (F.lit(0.0) if a == b else F.least(F.floor((F.col("v") / 2 - a / 2) / (b / 2 - a / 2) * BINS), F.lit(BINS - 1))).cast("int").alias("b"))) for i, (a, b, _) in enumerate(ranges)))
        bars = counts.select(bar.alias("bar"), "v", "n").filter("bar is not null").groupBy("bar").agg(F.sum("n"), F.min("v"), F.max("v")).collect()
        left = {}
        for i, (_, _, before) in enumerate(ranges):
            wanted = open_ranges[ranges[i]]
            for _, n, a, b in sorted((r for r in bars if r[0]["i"] == i), key=lambda r: r[2]):
                for rank in [r for r in wanted if before <= r < before + n]:
                    if a == b:
                        found[rank] = a
                    else:
                        left.setdefault((a, b, before), set()).add(rank)
                before += n
        open_ranges = left
    return found


def summary(df: DataFrame, value: Column, name: str, accuracy: int | None = None) -> DataFrame:
    """count, sum, max and p50, p95, p99 of a value in one row. Exact quantiles (between the two nearest values) come from a table of
    distinct values, which no single task holds; with an accuracy they are approximate and take one pass."""
    rows = df.select(value.alias("_v")).filter("_v is not null")
    if accuracy is None:
        counts = written(rows.groupBy("_v").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("_v").cast("double")), "value-counts")
        total = counts.agg(F.sum("n")).first()[0] or 0
        places = {q: (total - 1) * q for q in QUANTILES}
        at = values_at(counts, {int(f(p)) for p in places.values() for f in (floor, ceil)}) if total else {}
        between = lambda p: at[floor(p)] + (at[ceil(p)] - at[floor(p)]) * (p - floor(p))
        quantiles = [F.lit(between(places[q]) if total else None).cast("double") for q in QUANTILES]
        first = [F.coalesce(F.sum("n"), F.lit(0)).alias(f"{name}_count"), F.sum(F.col("_v").cast("decimal(24,6)") * F.col("n")).cast("double").alias(f"{name}_sum"), F.max("v").alias(f"{name}_max")]
        out = counts.agg(*first)
    else:
        first = [F.count("_v").alias(f"{name}_count"), F.sum(F.col("_v").cast("decimal(24,6)")).cast("double").alias(f"{name}_sum"), F.max("_v").cast("double").alias(f"{name}_max")]
        out = rows.agg(*first, *(F.percentile_approx("_v", q, accuracy).cast("double").alias(f"_q{i}") for i, q in enumerate(QUANTILES)))
        quantiles = [F.col(f"_q{i}") for i in range(len(QUANTILES))]
    return out.select(f"{name}_count", f"{name}_sum", f"{name}_max", *(F.round(q, 6).alias(f"{name}_p{int(p * 100)}") for p, q in zip(QUANTILES, quantiles, strict=True)))


def transactions_by_subject(fanned: DataFrame) -> DataFrame:
    """Distinct transactions of each subject; (subject, transaction) pairs meet before the shuffle that counts them."""
    subject = F.coalesce("custom_subject", "subject").alias("subject")
    return fanned.select(subject, "transaction_no").distinct().groupBy("subject").agg(F.count(F.lit(1)).alias("n_transactions"))


def top_rules(alert_rows: DataFrame, groups: dict[str, str | None], n: int) -> DataFrame:
    """The n rules with the most alerts, by title among equals; a rule without group is in MAIN."""
    named = F.create_map(*[x for k, v in groups.items() for x in (F.lit(k), F.lit(v or "MAIN"))])
    counted = alert_rows.select(F.explode("alerts").alias("a")).groupBy(F.col("a.rule_title").alias("rule_title")).agg(F.count(F.lit(1)).alias("n_alerts"))
    return counted.select(F.coalesce(named[F.col("rule_title")], F.lit("MAIN")).alias("rule_group"), "rule_title", "n_alerts").orderBy(F.desc("n_alerts"), "rule_title").limit(n)




def run_counters(answers: DataFrame, failed: DataFrame) -> DataFrame:
    """processed, failed, alerted transactions and alerts generated, in one row."""
    done = answers.select(F.lit(1).alias("processed"), F.lit(0).alias("failed"), (F.size("alerts") > 0).cast("int").alias("alerted"), F.size("alerts").alias("alerts_generated"))
    bad = failed.select(F.lit(0).alias("processed"), F.lit(1).alias("failed"), F.lit(0).alias("alerted"), F.lit(0).alias("alerts_generated"))
    return done.unionByName(bad).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("processed", "failed", "alerted", "alerts_generated")))


def observed(answers: DataFrame, name: str = "run") -> tuple[DataFrame, Observation]:
    """answers whose counters are gathered while another action runs over them."""
    seen = Observation(name)
    return answers.observe(seen, F.count(F.lit(1)).alias("processed"), F.count_if(F.size("alerts") > 0).alias("alerted"), F.sum(F.size("alerts")).alias("alerts_generated")), seen
