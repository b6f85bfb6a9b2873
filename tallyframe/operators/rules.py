"""Rules as data: routing, windows, groups, checks, and their compilation to columns.

A rules table has the fields of ``RULE_FIELDS``, and ``from_table`` makes a ``Rule`` of each
of its rows. COMPUTE rules keep a named record over their window: a count, an amount, sums of named values, a list and
a set of arguments, and a last value. ALERT rules are predicates over the transaction and the records of their
subject and window, where ``name.count``, ``name.amount``, ``name.values.x``, ``name.list``,
``name.set`` and ``name.last`` stand for indicators and ``global.name.count`` for those without end.

A rule that fails on a row (a division by zero, a cast of what is no number, ``raise_error``) must not stop the others: ``failed`` tells
of an expression whether it fails there, which is not the same as having no result, and ``guarded`` gives its result where it doesn't.
In a session without ANSI mode nothing fails where Spark gives null instead.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.columns import clean_group, same_subject
from .sums import BEYOND, MONEY

SUBJECTS = ("Card", "Merchant", "Custom")
MAIN_GROUP = "MAIN"


@dataclass(frozen=True)
class Rule:
    title: str
    kind: str  # COMPUTE or ALERT
    subject: str
    window_ms: int | None = None
    fixed: bool = False
    custom_subject: str | None = None
    group: str | None = None
    record: str | None = None
    filter_sql: str = "true"
    amount_sql: str | None = None
    scope: str = "window"
    value_sqls: tuple[tuple[str, str], ...] = ()
    arg_sql: str | None = None
    last_sql: str | None = None
    condition_sql: str | None = None
    message: str | None = None
    action: str | None = None


def window_ms(rules: DataFrame) -> DataFrame:
    return rules.withColumn("window_ms", F.col("time_frame") * F.col("unit_ms"))


def classify(rules: DataFrame) -> DataFrame:
    """rules with subject_class (Card, Merchant, Custom; null if unknown) and rule_class (with its kind of window)."""
    subject = F.coalesce(*(F.when(same_subject(F.col("subject"), s), F.lit(s)) for s in SUBJECTS))
    kind = F.when(F.coalesce("fixed_window", F.lit(False)), F.lit("fixed")).otherwise(F.lit("sliding"))
    return window_ms(rules).withColumn("subject_class", subject).withColumn("rule_class", F.when(subject.isNotNull(), F.concat_ws("-", F.lower(subject), kind)))


def rule_windows(rules: DataFrame) -> DataFrame:
    """The distinct windows of each subject, from rules of both types."""
    return classify(rules).filter("subject_class is not null").select("rule_class", F.lower("custom_subject").alias("custom_subject"), "window_ms").distinct()


def alert_rules(rules: DataFrame) -> DataFrame:
    return classify(rules).filter("rule_type = 'ALERT' and subject_class is not null")


def unknown_subject_rules(rules: DataFrame) -> DataFrame:
    return classify(rules).filter("subject_class is null")


def rule_counts(rules: DataFrame) -> DataFrame:
    return rules.groupBy("ruleset", "version").agg(F.count_if(F.col("rule_type") == "ALERT").alias("n_alert_rules"), F.count(F.lit(1)).alias("n_rules"))


def rule_groups(rules: DataFrame) -> DataFrame:
    """The groups in use for each subject and window."""
    grouped = classify(rules).filter("subject_class is not null").withColumn("g", clean_group(F.coalesce("rule_group", F.lit(MAIN_GROUP))))
    return grouped.groupBy("rule_class", F.lower("custom_subject").alias("custom_subject"), "window_ms").agg(F.array_sort(F.collect_set("g")).alias("groups"), F.countDistinct("g").alias("n_groups"))


def subject_summary(rules: DataFrame) -> DataFrame:
    return classify(rules).filter("subject_class is not null").groupBy("rule_class").agg(F.countDistinct("window_ms").alias("n_windows"), F.count(F.lit(1)).alias("n_rules"))


def subjects_in_use(rules: DataFrame) -> DataFrame:
    """The names of plain subjects and of custom subjects that rules use."""
    known = classify(rules)
    plain = known.filter("subject_class in ('Card', 'Merchant')").select(F.col("subject_class").alias("subject"))
    custom = known.filter("subject_class = 'Custom'").select(F.lower("custom_subject").alias("subject"))
    return plain.unionByName(custom).dropna().distinct()


# Compilation.

_NAMES = re.compile(r"\b(global\.)?([A-Za-z_]\w*)\.(count|amount|list|set|last|values\.(\w+))\b")
#: Rules of one version that come to the driver to be compiled; more of them are an error.
MOST_RULES = 10_000


#: What can't fail: a column or a constant.
_PLAIN = re.compile(r"\s*(\w+|`\w+`|'[^']*')\s*")


def failed(sql: str) -> Column:
    """Whether an expression fails on a row.

    try_to_binary gives null where anything below it fails, and only there as its argument is never null; the
    lambda keeps Spark from working out what several expressions share ahead of them, outside of their try_to_binary.
    """
    if _PLAIN.fullmatch(sql):
        return F.lit(False)
    return F.expr(f"try_to_binary(coalesce(cast(transform(array(0), _i -> ({sql}))[0] as string), ''), 'utf-8') is null")


def guarded(sql: str) -> Column:
    """An expression's result, null where it fails."""
    return F.expr(sql) if _PLAIN.fullmatch(sql) else F.when(~failed(sql), F.expr(sql))


def chosen(filter_sql: str) -> Column:
    return F.coalesce(guarded(filter_sql).cast("boolean"), F.lit(False))


def tried_cast(sql: str, kind: str) -> Column:
    """An expression's result as a number of some type, null where it fails or doesn't fit."""
    return guarded(sql).try_cast(kind)


def misfit(sql: str, kind: str) -> Column:
    """Whether an expression has a result that can't be summed as kind."""
    value = guarded(sql)
    number = tried_cast(sql, kind)
    return value.isNotNull() & (F.isnan(number) | (F.abs(number) >= BEYOND) | number.isNull() if kind == "double" else number.isNull())


def part_name(subject: str, custom: str | None, window: int | None, fixed: bool) -> str:
    return "_".join(filter(None, [subject.lower(), (custom or "").lower() or None, "global" if window is None else f"{'fw' if fixed else 'w'}{window}"]))


def indicator(rule: Rule, record: str, measure: str, world: bool = False) -> str:
    """The column that holds a record's measure for a rule's subject and window."""
    return f"{record}_{measure.replace('values.', 'value_')}_{part_name(rule.subject, rule.custom_subject, None if world else rule.window_ms, rule.fixed and not world)}"


def columns_used(rule: Rule) -> dict[str, str]:
    """The indicators that an ALERT rule's condition names: column to record and measure."""
    return {indicator(rule, m[2], m[3], bool(m[1])): f"{m[2]}.{m[3]}" for m in _NAMES.finditer(rule.condition_sql)}


def condition(rule: Rule) -> str:
    """An ALERT rule's condition with indicators replaced by their columns."""
    return _NAMES.sub(lambda m: f"`{indicator(rule, m[2], m[3], bool(m[1]))}`", rule.condition_sql)


def predicate(rule: Rule) -> Column:
    """Whether an ALERT rule's condition holds; null where it fails."""
    return guarded(condition(rule))


def tried(rule: Rule) -> Column:
    """What an ALERT rule's condition gives on a row, evaluated once: ``HOLDS``, null where it fails, else some other bytes. To be held as a column that alerts and failures read."""
    return F.expr(f"try_to_binary(coalesce(cast(transform(array(0), _i -> if(({condition(rule)}), true, false))[0] as string), ''), 'utf-8')")


#: The bytes of a condition that holds.
HOLDS = b"true"


def in_group(rules: list[Rule], group: str | None) -> list[Rule]:
    """The rules that are evaluated for a group: its ALERT rules (null: those of every group) and all COMPUTE rules."""
    return [r for r in rules if group is None or r.kind == "COMPUTE" or (r.group or MAIN_GROUP) == group]


def failures(rules: list[Rule], example: DataFrame, held: dict[Rule, Column] | None = None) -> Column:
    """Titles of the rules that fail on a row. example: rows with the columns of the transactions. held: the column of ``tried`` of ALERT rules."""
    from .records import records

    kinds = {(sql, m.name): m.kind for r in records(rules, example) for m in r.measures for _, sql in m.feeds if sql}
    made = []
    for r in rules:
        if r.kind == "ALERT":
            bad = [held[r].isNull() if held else failed(condition(r))]
        else:
            bad = [failed(sql) for sql in (r.filter_sql, r.arg_sql, r.last_sql) if sql]
            for name, sql in [*((("amount", r.amount_sql),) if r.amount_sql else ()), *((f"value_{n}", x) for n, x in r.value_sqls)]:
                bad += [failed(sql), chosen(r.filter_sql) & misfit(sql, kinds[sql, name])]
        made.append(F.when(_any(bad), F.lit(r.title)))
    return F.array_distinct(F.array_compact(F.array(*made))) if made else F.array().cast("array<string>")


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def check(rules: list[Rule], example: DataFrame, custom: dict[str, list[str]] | None = None) -> dict[str, str]:
    """Titles of rules that can't be evaluated on rows like example, with the reason; run when rules are loaded. custom: the keys of custom subjects, if they are known."""
    from .records import records

    bad: dict[str, str] = {}
    known = None if custom is None else {name.lower() for name in custom}
    for r in rules:
        if r.kind not in ("COMPUTE", "ALERT"):
            bad[r.title] = f"its type is {r.kind}"
        elif r.subject not in SUBJECTS or r.subject == "Custom" and (not r.custom_subject or known is not None and r.custom_subject.lower() not in known):
            bad[r.title] = f"its subject is {r.custom_subject or r.subject}, which has no key"
        elif r.kind == "ALERT" and not r.condition_sql:
            bad[r.title] = "it has no condition"
        elif r.kind == "COMPUTE" and not r.record:
            bad[r.title] = "it names no record"
        elif r.kind == "COMPUTE" and r.scope == "window" and not (r.window_ms and r.window_ms > 0):
            bad[r.title] = "it has no window"
        elif r.kind == "COMPUTE" and r.scope == "global" and r.arg_sql:
            bad[r.title] = "lists and sets are kept in windows only"
    none = example.limit(0)

    def kinds(tests: dict[str, list[Column]], rows: DataFrame) -> dict[str, str]:
        """The type of the first test of each title; titles whose tests can't be analysed go to bad. All are tried at once, and one by one only if that fails."""
        try:
            fields = iter(rows.select(*(c for cs in tests.values() for c in cs)).schema if tests else [])
            return {title: [next(fields).dataType.simpleString() for _ in cs][0] for title, cs in tests.items()}
        except AnalysisException as e:
            if len(tests) == 1:
                bad[next(iter(tests))] = str(e).splitlines()[0]
                return {}
        return {title: kind for t, cs in tests.items() for title, kind in kinds({t: cs}, rows).items()}

    tests = {}
    for r in rules:
        if r.kind == "COMPUTE" and r.title not in bad:
            read = [r.filter_sql, *(x for x in (r.arg_sql, r.last_sql) if x)]
            summed = [x for x in (r.amount_sql, *(v for _, v in r.value_sqls)) if x]
            tests[r.title] = [*(guarded(x) for x in read), chosen(r.filter_sql), *(tried_cast(x, "double") for x in summed)]
    sound = kinds(tests, none)
    names: dict[str, str] = {}
    for rec in records([r for r in rules if r.title in sound], example):
        names |= {rec.column(m.name): "decimal(28,2)" if m.name == "amount" else m.kind for m in rec.measures}
        names |= {rec.column("list"): "array<string>", rec.column("set"): "array<string>"} if rec.lists else {}
        names |= {rec.column("last"): "string"} if rec.lasts else {}
    tests = {}
    for r in rules:
        if r.kind == "ALERT" and r.title not in bad:
            if lost := [n for c, n in columns_used(r).items() if c not in names]:
                bad[r.title] = f"no rule computes {lost[0]} over its window"
            else:
                tests[r.title] = [F.expr(condition(r)), predicate(r)]
    for title, kind in kinds(tests, none.withColumns({c: F.lit(None).cast(t) for c, t in names.items()}) if names else none).items():
        if kind != "boolean":
            bad[title] = f"its condition is {kind}"
    return bad


def from_table(rules: DataFrame, most: int = MOST_RULES) -> list[Rule]:
    """The rules of a table as read_rules gives it, by title; those with an unknown subject are left out. Rules are few: more than ``most`` are an error."""
    rows = classify(rules).filter("subject_class is not null").orderBy("rule_title").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    return [
        Rule(
            x.rule_title, x.rule_type, x.subject_class, x.window_ms, bool(x.fixed_window), x.custom_subject, x.rule_group, x.record, x.filter_sql or "true", x.amount_sql, x.scope or "window",
            tuple(sorted((x.value_sqls or {}).items())), x.arg_sql, x.last_sql, x.condition_sql, x.message, x.action,
        )
        for x in rows
    ]


def as_table(spark: SparkSession, rules: list[Rule], ruleset: str, version: str) -> DataFrame:
    from ..sources.transactions import RULE_FIELDS

    rows = [(ruleset, version, r.title, r.group, r.kind, r.subject, r.custom_subject, r.window_ms, 1, r.fixed, r.record, r.scope, r.filter_sql, r.amount_sql, dict(r.value_sqls), r.arg_sql, r.last_sql, r.condition_sql, r.message, r.action) for r in rules]
    return spark.createDataFrame(rows, RULE_FIELDS)
