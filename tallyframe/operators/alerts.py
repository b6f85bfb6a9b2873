"""Alerts: evaluation of predicates, merging, status and score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import HOLDS, Rule, predicate

NO_ALERT, ALERT, UNAVAILABLE = "NO_ALERT", "ALERT", "ALERT_UNAVAILABLE"


def alert_array(rules: list[Rule], keys: dict[str, Column], held: dict[Rule, Column] | None = None) -> Column:
    """The alerts that rules raise on a row, as structs; a condition that is null raises none. keys: a subject's name to its key. held: the column of ``tried`` of each rule."""
    made = []
    for r in rules:
        one = F.struct(F.lit(r.title).alias("rule_title"), F.lit(r.message).cast("string").alias("message"), F.lit(r.action).cast("string").alias("action"), F.lit(r.subject).alias("subject"), keys[(r.custom_subject or r.subject).lower()].cast("string").alias("key"), F.lit(r.window_ms).cast("long").alias("window_ms"))
        made.append(F.when(held[r] == F.lit(HOLDS) if held else predicate(r), one))
    return F.array_compact(F.array(*made)) if made else F.array().cast("array<struct<rule_title:string,message:string,action:string,subject:string,key:string,window_ms:bigint>>")


def union_alerts(*arrays: Column) -> Column:
    """One array without duplicates by (rule_title, subject, key), in the order of those. arrays: columns at hand, since each is read several times."""
    whole = F.flatten(F.array(*(F.coalesce(a, F.array().cast("array<struct<rule_title:string,message:string,action:string,subject:string,key:string,window_ms:bigint>>")) for a in arrays)))
    names = F.array_sort(F.array_distinct(F.transform(whole, lambda a: F.struct(a["rule_title"].alias("rule_title"), a["subject"].alias("subject"), a["key"].alias("key")))))
    one_of_each = F.transform(names, lambda n: F.element_at(F.array_sort(F.filter(whole, lambda a: (a["rule_title"] == n["rule_title"]) & (a["subject"] == n["subject"]) & a["key"].eqNullSafe(n["key"]))), 1))
    return F.when(F.size(whole) > 1, one_of_each).otherwise(whole)


def merge_alerts(rows: DataFrame, n_alert_rules: int) -> DataFrame:
    """Alert sets of one transaction (transaction_no, alerts) merged, with status and score."""
    each = rows.select("transaction_no", F.explode_outer("alerts").alias("a"))
    # duplicates meet before the shuffle; a transaction has at most one alert for each rule, subject and key
    one = each.groupBy("transaction_no", F.col("a.rule_title").alias("t"), F.col("a.subject").alias("s"), F.col("a.key").alias("k")).agg(F.min("a").alias("a"))
    merged = one.groupBy("transaction_no").agg(F.array_sort(F.collect_list("a")).alias("alerts"))
    return with_status(merged, n_alert_rules)


def with_status(rows: DataFrame, n_alert_rules: int) -> DataFrame:
    """alert_status and score from the final array: alerts by ALERT rules, 0.0 without alerts."""
    n = F.size("alerts")
    return rows.withColumns({"alert_status": F.when(n > 0, ALERT).otherwise(NO_ALERT), "score": F.when(n > 0, n / F.lit(max(1, n_alert_rules))).otherwise(F.lit(0.0))})


def titles(alerts: Column) -> Column:
    """Rule titles of an alert array, sorted and joined."""
    return F.array_join(F.array_sort(F.transform(alerts, lambda a: a["rule_title"])), ",")


def by_rule(rows: DataFrame) -> DataFrame:
    """How many transactions each rule alerted."""
    return rows.select(F.explode("alerts").alias("a")).groupBy(F.col("a.rule_title").alias("rule_title")).agg(F.count(F.lit(1)).alias("n_alerts"))
