"""Deployments of rulesets: the gate while one runs, and the version that is in force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import written
from .alerts import UNAVAILABLE

#: Points in time that are sent to every task; more of them are met by a shuffle.
BROADCAST_POINTS = 50_000
#: Points that one row of a look-up table holds at most; where more of them crowd, their stretch of time is cut again.
MOST_POINTS = 32
#: Over how many tasks the rows of one stretch of time are then spread.
SALTS = 16
#: Stretches whose running greatest is found together.
BLOCK = 4096
NEVER = 2**63 - 1


def greatest_so_far(rows: DataFrame, points: DataFrame, top: Column, at: str, out: str) -> DataFrame:
    """rows with the greatest ``top`` of all points whose time (column _at) is not after a row's; null if there is none.

    The points' time is cut into as many stretches as there are points. A stretch knows the greatest of all
    before it and its own points, so a row needs one look-up by an equality, whether it is for
    a version that is in force or the end of an interval. Where more than MOST_POINTS crowd in a stretch, it is cut again into as many as it has points, and
    the rows that fall there need one more look-up; so a row never compares itself with more points than that. No task holds a day or all rows; rows are read once.
    """
    kept = points.filter("_at is not null").groupBy("_at").agg(F.max(top).alias("top"))
    kind = kept.schema["top"].dataType
    n, lo, hi = kept.agg(F.count("_at"), F.min("_at"), F.max("_at")).first()
    if not n:
        return rows.withColumn(out, F.lit(None).cast(kind))
    # a group is a stretch of the level before, with the bounds and the width by which it is cut; the first holds all points
    first = F.struct(*(F.lit(v).cast("long").alias(c) for c, v in (("id", lo), ("lo", lo), ("hi", hi), ("width", (hi - lo) // n + 1))))
    kept = kept.withColumn("_group", first)
    t, met = F.col(at), rows.withColumns({"_in": first, "_found": F.lit(None).cast(kind)})
    while n:
        dims, crowded = _stretches(kept)
        g = F.col("_in")
        met = met.withColumns({"_id": g["id"], "_bucket": F.when(t >= g["lo"], F.floor((F.least(t, g["hi"]) - g["lo"]) / g["width"]))}).drop("_in")
        if n <= BROADCAST_POINTS:
            met = met.join(F.broadcast(dims), ["_id", "_bucket"], "left")
        else:
            salted = dims.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            met = met.withColumn("_salt", F.pmod(F.xxhash64(at), F.lit(SALTS)).cast("int")).join(salted, ["_id", "_bucket", "_salt"], "left").drop("_salt")
        inside = F.array_max(F.transform(F.filter("_points", lambda p: p["_at"] <= t), lambda p: p["top"]))
        met = met.withColumn("_found", F.greatest("_found", inside, "_carried")).withColumnRenamed("_deeper", "_in").drop("_id", "_bucket", "_points", "_carried")
        kept = written(crowded, "points")
        n = kept.count()
    return met.withColumn(out, F.col("_found")).select(*rows.columns, out)


def _stretches(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row for each stretch of each group: what is carried into it, its points, or the group that they are of next; the points of those groups). points: _at, top, _group."""
    g = F.col("_group")
    placed = points.withColumns({"_id": g["id"], "_bucket": F.floor((F.col("_at") - g["lo"]) / g["width"])})
    counted = placed.groupBy("_id", "_bucket").agg(F.count("_at").alias("n"), F.max("top").alias("_most"), F.min("_at").alias("lo"), F.max("_at").alias("hi"))
    # a stretch that is cut again is named by its first point
    next_ = F.struct(F.col("lo").alias("id"), "lo", "hi", (F.floor((F.col("hi") - F.col("lo")) / F.col("n")) + 1).alias("width"))
    deeper = counted.filter(F.col("n") > MOST_POINTS).select("_id", "_bucket", next_.alias("_deeper"))
    full = placed.join(deeper, ["_id", "_bucket"])
    few = placed.join(deeper, ["_id", "_bucket"], "left_anti").groupBy("_id", "_bucket").agg(F.collect_list(F.struct("_at", "top")).alias("_points"))
    last = placed.groupBy("_id").agg(F.max("_bucket").alias("_last"))
    blocks = last.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / BLOCK))))
    grid = blocks.repartition("_id", "_block").withColumn("_bucket", F.explode(F.sequence(F.col("_block") * BLOCK, F.least(F.col("_last"), F.col("_block") * BLOCK + BLOCK - 1)))).drop("_last")
    filled = grid.join(counted.select("_id", "_bucket", "_most"), ["_id", "_bucket"], "left")
    before = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    # one row for each BLOCK of stretches
    ends = filled.groupBy("_id", "_block").agg(F.max("_most").alias("_end")).select("_id", "_block", F.max("_end").over(before(["_id"], "_block")).alias("_earlier"))
    carried = filled.withColumn("_held", F.max("_most").over(before(["_id", "_block"], "_bucket"))).join(ends, ["_id", "_block"])
    dims = carried.select("_id", "_bucket", F.greatest("_held", "_earlier").alias("_carried")).join(few, ["_id", "_bucket"], "left").join(deeper, ["_id", "_bucket"], "left")
    return dims, full.select("_at", "top", F.col("_deeper").alias("_group"))


def in_intervals(rows: DataFrame, intervals: DataFrame, at: str = "us") -> DataFrame:
    """rows with ``inside``: whether an interval (started_us, ended_us; open end: null) holds their time, start included, end not."""
    ended = F.coalesce("ended_us", F.lit(NEVER))
    points = intervals.withColumn("_at", F.col("started_us"))
    return greatest_so_far(rows, points, ended, at, "inside").withColumn("inside", F.coalesce(F.col("inside") > F.col(at), F.lit(False)))


def deployment_gate(rows: DataFrame, intervals: DataFrame, at: str = "us") -> DataFrame:
    """rows with gate_status and gate_action: transactions during a deployment are postponed and skip the rules."""
    return in_intervals(rows, intervals, at).withColumns({"gate_status": F.when(F.col("inside"), UNAVAILABLE), "gate_action": F.when(F.col("inside"), "POSTPONE")}).drop("inside")


def ruleset_asof(rows: DataFrame, versions: DataFrame, at: str = "us") -> DataFrame:
    """rows with the version in force at their time: the last whose from_us is not later (the greatest of equal times); null before the first."""
    points = versions.withColumn("_at", F.col("from_us"))
    found = greatest_so_far(rows, points, F.struct(F.col("from_us").alias("at"), F.col("version").cast("string").alias("version")), at, "_version")
    return found.withColumn("version", F.col("_version.version")).drop("_version")


def active_ruleset(deployments: DataFrame) -> DataFrame:
    """For each ruleset the newest requested version, and the newest valid one: what is in force after a failed deployment."""
    order = F.struct("requested_us", "version")
    return deployments.groupBy("ruleset").agg(F.max_by("version", order).alias("requested"), F.max_by("version", F.when(F.col("valid"), order)).alias("active"))

