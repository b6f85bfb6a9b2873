"""Rows that every operator must take: nulls, empty and very long texts, repeats, and clashing extra columns."""

import random

CLASHES = ["digest", "tie", "anchor", "n", "rep", "score", "predicted", "key", "part", "spans", "doc", "c0", "closing", "range_no", "name"]


def words(seed, n, letters="abcdefgh"):
    r = random.Random(seed)
    return [r.choice(letters) * r.randint(1, 2) + r.choice(letters) for _ in range(n)]


def rows():
    a, b = " ".join(words(1, 120)), " ".join(words(2, 90))
    long = " ".join(words(3, 60_000))
    return [
        (1, a), (2, a), (3, a.replace(" ", "\n", 5)), (4, a + " tail"), (5, b), (5, b), (6, None), (7, ""), (8, " \n\t "), (9, "one"), (10, "One"),
        (11, long), (12, long + " end"), (None, b), (None, "text of a row without number"), (13, "é ü 日本語 😀 \x1c x\x85y"), (14, "password=hunter2hunter2 " + a), (-3, b + " "), (2**62, "far"),
    ]


def table(spark, some=None, clashes=True):
    some = rows() if some is None else some
    df = spark.createDataFrame(some, "doc_id long, text string")
    from pyspark.sql import functions as F

    return df.select("doc_id", "text", *(F.lit(f"x{c}").alias(c) for c in CLASHES)) if clashes else df


def empty(spark):
    return table(spark, [])
