"""Connected components of a graph given as a table of edges.

Contraction rounds: every vertex hooks onto its least smaller neighbour, pointers jump
until all lead to a root, and the edges between different roots are the next round's
graph. A hot vertex is spread over tasks in every join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, salted_lookup, written


def _rooted(parents: DataFrame) -> DataFrame:
    """(v, root) from (v, parent): parents are smaller than their vertices."""
    now = written(parents.select("v", F.col("parent").alias("root")), "pointers")
    held = None
    while True:
        up = now.select(F.col("v").alias("root"), F.col("root").alias("_up"))
        step = written(salted_lookup(now, up, "root", "v").select("v", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("moved")), "pointers")
        discard(now, held)
        now, held = step.select("v", "root"), step
        if step.filter("moved").isEmpty():
            return now


def components(edges: DataFrame) -> DataFrame:
    """(v, label): the least vertex that each vertex with an edge to another reaches. edges: a long, b long, in any order."""
    least, most = F.least("a", "b"), F.greatest("a", "b")
    graph = written(edges.filter("a <> b").select(least.alias("a"), most.alias("b")).distinct(), "edges")
    labels = before_labels = None
    while True:
        if graph.isEmpty():
            break
        roots = _rooted(graph.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("parent")))
        if labels is None:
            labels = roots.withColumnRenamed("root", "label")
        else:
            known = salted_lookup(labels, roots.withColumnsRenamed({"v": "label", "root": "_to"}), "label", "v").select("v", F.coalesce("_to", "label").alias("label"))
            fresh = roots.join(labels.select("v"), "v", "left_anti").select("v", F.col("root").alias("label"))
            labels = known.unionByName(fresh)
        before, labels = before_labels, written(labels, "labels")
        discard(before)
        before_labels = labels
        to = lambda c: roots.select(F.col("v").alias(c), F.col("root").alias(f"_{c}"))
        moved = salted_lookup(salted_lookup(graph, to("a"), "a", "b"), to("b"), "b", "a").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
        after = written(moved.filter("a <> b").select(least.alias("a"), most.alias("b")).distinct(), "edges")
        discard(graph)
        graph = after
    if labels is None:
        return graph.select(F.col("a").alias("v"), F.col("b").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("v"), "label")).distinct()
