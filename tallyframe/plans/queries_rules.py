"""Queries over rules tables and deployments. Both are derived from given tables, so they grow with them:
each part is a rule, and each order is a requested deployment of its priority's ruleset."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gate, rules as R, state
from ..sources.transactions import read_rules, read_transactions, table
from .queries_windows import DAY, T

RULES_SQL = """SELECT 'rs' || p_partkey % 7 AS ruleset, '1.' || p_partkey % 3 AS version, p_name || '-' || p_partkey AS rule_title,
  CASE WHEN p_size % 4 <> 0 THEN p_brand END AS rule_group, CASE WHEN p_size % 3 = 0 THEN 'COMPUTE' ELSE 'ALERT' END AS rule_type,
  CASE p_partkey % 5 WHEN 0 THEN 'Card' WHEN 1 THEN 'MERCHANT' WHEN 2 THEN 'custom' WHEN 3 THEN 'card' ELSE 'Any' END AS subject,
  CASE WHEN p_partkey % 5 = 2 THEN p_type END AS custom_subject, CAST(p_size AS BIGINT) AS time_frame,
  CAST(CASE p_partkey % 3 WHEN 0 THEN 1000 WHEN 1 THEN 3600000 ELSE 86400000 END AS BIGINT) AS unit_ms, p_size % 2 = 0 AS fixed_window FROM {part}"""

R_SQL = f"""r AS ({RULES_SQL.format(part="part")}), c AS (SELECT *, time_frame * unit_ms AS window_ms,
  CASE lower(subject) WHEN 'card' THEN 'Card' WHEN 'merchant' THEN 'Merchant' WHEN 'custom' THEN 'Custom' END AS subject_class FROM r),
  k AS (SELECT *, CASE WHEN subject_class IS NOT NULL THEN lower(subject_class) || '-' || CASE WHEN fixed_window THEN 'fixed' ELSE 'sliding' END END AS rule_class FROM c)"""


def rules(spark, sf):
    return spark.sql(RULES_SQL.format(part="{part}"), part=table(spark, sf, "part"))


def src_rules(spark, sf):
    return read_rules(rules(spark, sf), "rs3", "1.1").select("rule_title", "rule_type", "subject", "time_frame", "unit_ms", "fixed_window")


def rule_windows(spark, sf):
    return R.rule_windows(rules(spark, sf)).withColumn("custom_subject", F.coalesce("custom_subject", F.lit("")))


def classify_rules(spark, sf):
    return R.classify(rules(spark, sf)).select("rule_title", "rule_class", "window_ms")


def alert_rules(spark, sf):
    return R.alert_rules(rules(spark, sf)).select("rule_title", "rule_class", "window_ms")


def unknown_subject_rules(spark, sf):
    return R.unknown_subject_rules(rules(spark, sf)).select("rule_title", "subject")


def rule_counts(spark, sf):
    return R.rule_counts(rules(spark, sf))


def rule_groups_by_window(spark, sf):
    return R.rule_groups(rules(spark, sf)).select("rule_class", F.coalesce("custom_subject", F.lit("")).alias("custom_subject"), "window_ms", F.array_join("groups", ",").alias("groups"), "n_groups")


def subject_summary(spark, sf):
    return R.subject_summary(rules(spark, sf))


def subjects_in_use(spark, sf):
    return R.subjects_in_use(rules(spark, sf))


def _windows(spark, sf):
    """How many windows rules have for each subject, sliding and fixed ones, and the longest; custom subjects go by the name of their group of parts."""
    found = R.rule_windows(rules(spark, sf)).withColumn("subject", F.initcap(F.split_part("rule_class", F.lit("-"), F.lit(1))))
    return found.groupBy("subject", F.coalesce("custom_subject", F.lit("")).alias("custom_subject")).agg(F.count(F.lit(1)).alias("n_windows"), F.max("window_ms").alias("longest_ms"))


#: Custom subjects by the names that the rules table uses for some of them; the last has no rules.
CUSTOM_NAMES = ["large", "economy", "no such type"]


def _fanned(spark, sf):
    fanned = state.fan_out(read_transactions(spark, sf), {name: ["card_id", "merchant"] for name in CUSTOM_NAMES})
    return fanned.select("transaction_no", "subject", F.coalesce("custom_subject", F.lit("")).alias("custom_subject"))


def txn_rule_windows(spark, sf):
    """The rule windows of each transaction's subjects: their number and the longest. Windows are counted by subject before they meet transactions."""
    return _fanned(spark, sf).join(_windows(spark, sf), ["subject", "custom_subject"]).select("transaction_no", "subject", "custom_subject", "n_windows", "longest_ms")


def no_rule_transactions(spark, sf):
    """Subjects of transactions that no rule window is about."""
    return _fanned(spark, sf).join(_windows(spark, sf), ["subject", "custom_subject"], "left_anti").select("transaction_no", "subject", "custom_subject", F.lit("NO_ALERT").alias("alert_status"), F.lit(0.0).alias("score"))


def active_ruleset(spark, sf):
    orders = table(spark, sf, "orders")
    d = orders.select(F.col("o_orderpriority").alias("ruleset"), F.col("o_orderkey").alias("version"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("requested_us"), (F.col("o_orderstatus") == "F").alias("valid"))
    return gate.active_ruleset(d)


def releases(spark, sf):
    """Deployments that run while the events do: each card's largest transaction starts one of two to eleven minutes."""
    largest = read_transactions(spark, sf).groupBy("card_id").agg(F.max(F.struct("amount", "us", "transaction_no")).alias("e")).select("e.*")
    return largest.select(F.col("us").alias("started_us"), (F.col("us") + (F.col("transaction_no") % 10 + 2) * 60_000_000).alias("ended_us"), F.col("us").alias("from_us"), F.concat(F.lit("v"), F.col("transaction_no").cast("string")).alias("version"))


def deployment_gate(spark, sf):
    return gate.deployment_gate(read_transactions(spark, sf), releases(spark, sf)).select("transaction_no", "gate_status", "gate_action")


def ruleset_asof(spark, sf):
    late = releases(spark, sf).withColumn("from_us", F.col("ended_us"))
    return gate.ruleset_asof(read_transactions(spark, sf).select("transaction_no", "us"), late).select("transaction_no", "version")


RELEASES = "d AS (SELECT us AS started_us, us + (transaction_no % 10 + 2) * 60000000 AS ended_us, 'v' || transaction_no AS version FROM (SELECT us, transaction_no, row_number() OVER (PARTITION BY card_id ORDER BY amount DESC, us DESC, transaction_no DESC) AS rn FROM t) WHERE rn = 1)"
WINDOWS_SQL = "w AS (SELECT subject, custom_subject, count(*) AS n_windows, max(window_ms) AS longest_ms FROM (SELECT DISTINCT subject_class AS subject, rule_class, coalesce(lower(custom_subject), '') AS custom_subject, window_ms FROM k WHERE subject_class IS NOT NULL) GROUP BY 1, 2)"
FAN = "f AS (SELECT transaction_no, 'Card' AS subject, '' AS custom_subject FROM t UNION ALL SELECT transaction_no, 'Merchant', '' FROM t UNION ALL SELECT transaction_no, 'Custom', unnest([" + ", ".join(f"'{name}'" for name in CUSTOM_NAMES) + "]) FROM t)"

TABLE = {
    "src_rules": (src_rules, f"WITH {R_SQL} SELECT rule_title, rule_type, subject, time_frame, unit_ms, fixed_window FROM r WHERE ruleset = 'rs3' AND version = '1.1'"),
    "rule_windows": (rule_windows, f"WITH {R_SQL} SELECT DISTINCT rule_class, coalesce(lower(custom_subject), '') AS custom_subject, window_ms FROM k WHERE subject_class IS NOT NULL"),
    "classify_rules": (classify_rules, f"WITH {R_SQL} SELECT rule_title, rule_class, window_ms FROM k"),
    "alert_rules": (alert_rules, f"WITH {R_SQL} SELECT rule_title, rule_class, window_ms FROM k WHERE rule_type = 'ALERT' AND subject_class IS NOT NULL"),
    "unknown_subject_rules": (unknown_subject_rules, f"WITH {R_SQL} SELECT rule_title, subject FROM k WHERE subject_class IS NULL"),
    "rule_counts": (rule_counts, f"WITH {R_SQL} SELECT ruleset, version, count(*) FILTER (rule_type = 'ALERT') AS n_alert_rules, count(*) AS n_rules FROM r GROUP BY 1, 2"),
    "rule_groups_by_window": (rule_groups_by_window, f"WITH {R_SQL}, g AS (SELECT *, regexp_replace(coalesce(rule_group, 'MAIN'), '[^A-Za-z0-9_]', '_', 'g') AS g FROM k WHERE subject_class IS NOT NULL) SELECT rule_class, coalesce(lower(custom_subject), '') AS custom_subject, window_ms, string_agg(DISTINCT g, ',' ORDER BY g) AS groups, count(DISTINCT g) AS n_groups FROM g GROUP BY 1, 2, 3"),
    "subject_summary": (subject_summary, f"WITH {R_SQL} SELECT rule_class, count(DISTINCT window_ms) AS n_windows, count(*) AS n_rules FROM k WHERE subject_class IS NOT NULL GROUP BY 1"),
    "subjects_in_use": (subjects_in_use, f"WITH {R_SQL} SELECT DISTINCT CASE WHEN subject_class = 'Custom' THEN lower(custom_subject) ELSE subject_class END AS subject FROM k WHERE subject_class IS NOT NULL"),
    "txn_rule_windows": (txn_rule_windows, f"WITH {T}, {R_SQL}, {WINDOWS_SQL}, {FAN} SELECT transaction_no, subject, custom_subject, n_windows, longest_ms FROM f JOIN w USING (subject, custom_subject)"),
    "no_rule_transactions": (no_rule_transactions, f"WITH {T}, {R_SQL}, {WINDOWS_SQL}, {FAN} SELECT transaction_no, subject, custom_subject, 'NO_ALERT' AS alert_status, 0.0::DOUBLE AS score FROM f ANTI JOIN w USING (subject, custom_subject)"),
    "active_ruleset": (active_ruleset, "SELECT o_orderpriority AS ruleset, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS requested, arg_max(o_orderkey, (o_orderdate, o_orderkey)) FILTER (o_orderstatus = 'F') AS active FROM orders GROUP BY 1"),
    "deployment_gate": (deployment_gate, f"WITH {T}, {RELEASES}, x AS (SELECT transaction_no, EXISTS (SELECT 1 FROM d WHERE us >= started_us AND us < ended_us) AS i FROM t) SELECT transaction_no, CASE WHEN i THEN 'ALERT_UNAVAILABLE' END AS gate_status, CASE WHEN i THEN 'POSTPONE' END AS gate_action FROM x"),
    "ruleset_asof": (ruleset_asof, f"WITH {T}, {RELEASES} SELECT t.transaction_no, d.version FROM t ASOF LEFT JOIN d ON t.us >= d.ended_us"),
}
