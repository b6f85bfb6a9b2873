"""Mixing sources to target weights: complete epochs, then Efraimidis-Spirakis sampling of whole documents up to a budget.

Sources share a multiple of all words by weight; no target goes beyond a number of epochs of its source, and what is over
is shared anew by weight. A source's target is its whole epochs, in which every document is taken, and a
budget for the rest: each document has the exponential key -ln(u) / w, where u in (0, 1) comes from a hash of its number and text
and w is its quality weight; the documents of least key are taken as long as their running sum of words stays nearest to the budget.

Only DataFrame functions. A source isn't sorted whole: keys fall into buckets of equal ratio, of which each holds a small part of its source's
documents whatever their weights; the buckets' sums tell the one in which the budget ends, and only the rows of that one are
summed up in order. They give the greatest key that is taken, which decides for every document where it stands, so no text is shuffled.
What is held for each source is one row; sources are numbered by a sort over ranges, without one task for all of them.

Defined results: a null text has no words, and a document without words is taken as if it had any but adds none; a null source is a source of its own,
the last; a null, not positive or undefined weight counts as ``LEAST_WEIGHT``; rows of equal number, text and source (so of equal keys)
are taken alike, and the budget is met up to half of such a group; without any words all targets are 0; an empty table gives no rows; other columns
are handed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import salted_lookup, written

WEIGHTS, SHARE, EPOCHS, SEED = (3, 1, 2), 1.5, 2, "mix"
WORD, SIGN = r"[^\x20\x09-\x0D]+", r"[!-/:-@\[-`{-~]"
LEAST_WEIGHT = 1e-6
#: How fast a document's weight falls with the share of ASCII signs in its text.
SIGNS_AGAINST = 20.0
#: Rows of a source in a bucket of keys, about, and the least number of buckets for each e-fold of keys.
BUCKET_ROWS, LEAST_BUCKETS = 100_000, 64
#: Sources whose rows are sent to every task; more are met by a salted shuffle.
BROADCAST_SOURCES = 10_000
_PLACE_BITS = 33  # of a row's place within its partition in monotonically_increasing_id


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def quality_weight(text: Column) -> Column:
    """Near 1 for prose, small for texts that are mostly signs."""
    whole = F.coalesce(text, F.lit(""))
    return 1.0 / (1.0 + F.lit(SIGNS_AGAINST) * F.regexp_count(whole, F.lit(SIGN)) / F.greatest(F.length(whole), F.lit(1)))


def exponential_key(doc_id: Column, text: Column, weight: Column, seed: str = SEED) -> Column:
    """-ln(u) / weight; the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    usable = F.when(F.isnan(weight) | ~(weight > LEAST_WEIGHT), F.lit(LEAST_WEIGHT)).otherwise(weight)
    return -F.ln(u) / F.coalesce(usable, F.lit(LEAST_WEIGHT))


def measured(docs: DataFrame, size: Column, key: Column, source: Column) -> DataFrame:
    """docs with _source (text, null last when sorted with _missing), _size and _key."""
    return docs.withColumns({"_missing": source.isNull(), "_source": F.coalesce(source.cast("string"), F.lit("")), "_size": size, "_key": key})


SOURCE = ["_missing", "_source"]


def _numbered(sources: DataFrame) -> DataFrame:
    """sources with their place in order, from 0."""
    ranged = sources.orderBy(*SOURCE).withColumn("_id", F.monotonically_increasing_id())
    held = written(ranged.withColumn("_part", F.shiftright("_id", _PLACE_BITS)), "sources")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    parts = held.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return held.join(parts, "_part").withColumn("_place", F.col("_before") + F.col("_id").bitwiseAND((1 << _PLACE_BITS) - 1)).drop("_id", "_part", "_before")


def targets(rows: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """One row for each source of rows (SOURCE, _size): source_size, n_rows, target."""
    sums = _numbered(rows.groupBy(*SOURCE).agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("n_rows")))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_place") % len(weights) + 1).cast("int"))
    held = written(sums.select(*SOURCE, "source_size", "n_rows", weight.alias("_weight")), "weights")
    limit = F.col("source_size") * epochs
    goal = share * (held.agg(F.sum("source_size")).first()[0] or 0)
    each = 0.0
    while True:  # each round puts at least one more source at its limit, or is the last
        over = F.col("_weight") * each >= limit if each else F.lit(False)
        full, open_ = held.agg(F.sum(F.when(over, limit)), F.sum(F.when(~over, F.col("_weight")))).first()
        now = (goal - (full or 0)) / open_ if open_ else each
        if now <= each:
            break
        each = now
    return held.select(*SOURCE, "source_size", "n_rows", F.least(F.col("_weight") * each, limit.cast("double")).alias("target"))


def plan(rows: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """targets with _epochs, how often every document is taken, and what decides which are taken once more: their _bucket is before _ends, or is it and their _key is not above _cut.

    rows: SOURCE, _size, _key; read several times, so a written table.
    """
    held = targets(rows, weights, share, epochs)
    some = F.col("source_size") > 0
    held = held.withColumn("_epochs", F.when(some, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    held = held.withColumn("_budget", F.col("target") - F.col("_epochs") * F.col("source_size"))
    largest = held.agg(F.max("n_rows")).first()[0] or 0
    fine = max(LEAST_BUCKETS, int(0.37 * largest / BUCKET_ROWS))  # at most 0.37 of a source lie in one e-fold of exponential keys
    bucket = F.floor(F.ln("_key") * fine)
    filled = rows.groupBy(*SOURCE, bucket.alias("_bucket")).agg(F.sum("_size").alias("_n"))
    sums = filled.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*SOURCE).orderBy("_bucket")))
    reached = sums.join(held.select(*SOURCE, "_budget"), SOURCE).filter((F.col("_budget") > 0) & (F.col("_upto") > F.col("_budget")) & (F.col("_upto") - F.col("_n") <= F.col("_budget")))
    ends = reached.groupBy(*SOURCE).agg(F.min(F.struct("_bucket", (F.col("_upto") - F.col("_n")).alias("_before"), "_budget")).alias("_e")).select(*SOURCE, "_e.*")
    inside = rows.withColumn("_bucket", bucket).join(ends, [*SOURCE, "_bucket"]).groupBy(*SOURCE, "_bucket", "_before", "_budget", "_key").agg(F.sum("_size").alias("_n"))
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*SOURCE).orderBy("_key"))
    nearest = inside.withColumn("_upto", upto).filter(F.col("_upto") - F.col("_n") / 2 <= F.col("_budget"))
    cuts = nearest.groupBy(*SOURCE).agg(F.max("_key").alias("_cut"))
    met = held.join(ends.select(*SOURCE, F.col("_bucket").alias("_ends")), SOURCE, "left").join(cuts, SOURCE, "left")
    return written(met.withColumn("_fine", F.lit(fine)), "mix")


def with_copies(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """rows with source_size, target and copies: how often the mix takes each."""
    dims = plans.drop("n_rows", "_budget")
    if dims.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        met = rows.join(F.broadcast(dims), SOURCE)
    else:
        keyed = lambda df: df.withColumn("_s", F.concat(F.col("_missing").cast("string"), F.lit(":"), F.col("_source")))
        met = salted_lookup(keyed(rows), keyed(dims).drop(*SOURCE), "_s", "_key").drop("_s")
    bucket = F.floor(F.ln("_key") * F.col("_fine"))
    once_more = F.coalesce((bucket < F.col("_ends")) | ((bucket == F.col("_ends")) & (F.col("_key") <= F.col("_cut"))), F.lit(False))
    return met.withColumn("copies", (F.col("_epochs") + once_more.cast("int")).cast("int")).drop("_epochs", "_ends", "_cut", "_fine")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """docs with ``copies`` as the last column: how often the mix takes each document.

    weights: of the sources in order, repeating. share: of all words. epochs: beyond which no source is taken. weight: of each document's quality.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]  # docs may have columns of one name, and one named _w
    fields = dict(zip(docs.columns, names, strict=True))
    plain = docs.select("*", (quality_weight(F.col(text)) if weight is None else weight).alias("_w")).toDF(*names, "_w")
    rows = measured(plain, n_words(F.col(fields[text])), exponential_key(F.col(fields[doc_id]), F.col(fields[text]), F.col("_w"), seed), F.col(fields[source]))
    plans = plan(written(rows.select(*SOURCE, "_size", "_key"), "keys"), weights, share, epochs)
    return with_copies(rows, plans).select(*names, "copies").toDF(*docs.columns, "copies")


def op13_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    rows = measured(docs, n_words(F.col("text")), exponential_key(F.col("doc_id"), F.col("text"), quality_weight(F.col("text"))), F.col("source"))
    held = written(rows.select("doc_id", *SOURCE, "_size", "_key"), "keys")
    out = with_copies(held, plan(held))
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", F.round("target", 6).alias("target"), (F.col("_size") * F.col("copies")).alias("taken"))


ORACLE = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
  m AS (SELECT doc_id, source, len(regexp_extract_all(t, '{WORD}'))::BIGINT AS size, len(regexp_extract_all(t, '{SIGN}')) AS signs, greatest(length(t), 1) AS chars,
    (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || t), 1, 13))::BIGINT + 0.5::DOUBLE) / {1 << 52}::DOUBLE AS u FROM d),
  k AS (SELECT doc_id, source, size, -ln(u) / greatest({LEAST_WEIGHT}::DOUBLE, 1.0::DOUBLE / (1.0::DOUBLE + {SIGNS_AGAINST}::DOUBLE * signs / chars)) AS key FROM m),
  s AS (SELECT source, sum(size)::BIGINT AS source_size, [{", ".join(f"{w}::DOUBLE" for w in WEIGHTS)}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS w FROM k GROUP BY source),
  r AS (SELECT *, {EPOCHS} * source_size AS most, sum({EPOCHS} * source_size) OVER o AS at_most, sum(w) OVER () - sum(w) OVER o AS others, {SHARE}::DOUBLE * sum(source_size) OVER () AS goal FROM s WINDOW o AS (ORDER BY {EPOCHS} * source_size / w, source NULLS LAST)),
  e AS (SELECT greatest(max((goal - at_most) / others) FILTER (WHERE others > 0), any_value(goal) / sum(w)) AS each FROM r),
  t AS (SELECT source, source_size, least(w * each, most::DOUBLE) AS target FROM r, e),
  b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
  p AS (SELECT k.*, source_size, target, epochs, target - epochs * source_size AS budget, sum(size) OVER (PARTITION BY k.source ORDER BY key) AS upto, sum(size) OVER (PARTITION BY k.source, key) AS own FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, (size * (epochs + CASE WHEN budget > 0 AND upto - own / 2 <= budget THEN 1 ELSE 0 END))::BIGINT AS taken FROM p"""
