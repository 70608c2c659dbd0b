"""Connected components of a graph given as links between numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour; a row for each row."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them; a row for each row."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))


def _stars(edges: DataFrame) -> bool:
    """Whether every node points at one other node that points nowhere."""
    ends = edges.select(F.col("u").alias("node"), "v").unionByName(edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("v")))
    nodes = ends.groupBy("node").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count_if(F.col("v").isNull()).alias("n"))
    return nodes.agg(F.count_if(F.expr("a != b OR (a IS NOT NULL AND n > 0)"))).first()[0] == 0


def component_labels(links: DataFrame) -> DataFrame:
    """``node, label``: the smallest node reachable, for all nodes of ``links`` (``u, v``) but the smallest ones.

    Large-star and small-star steps alternate until every node points at its
    smallest one; the number of rounds grows with the logarithm of a path's
    length. Links stay distributed; each round is written, so that lost
    executors cost one round. A round keeps the number of rows, equal ones
    go at the end. Only one number per round reaches the driver.
    """
    edges = written(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "links")
    while not _stars(edges):
        edges = written(_small_star(_large_star(edges)), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).distinct()


def labelled(rows: DataFrame, labels: DataFrame, node: str, label: str) -> DataFrame:
    """``rows`` with the label of ``node``, which is the node itself if ``labels`` lacks it."""
    named = labels.select(F.col("node").alias(node), F.col("label").alias(label))
    return rows.join(named, node, "left").withColumn(label, F.coalesce(label, node))


def with_links(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` of ``component_labels`` with more links (``u, v``): only components that a link joins are looked at."""
    ends = labelled(labelled(links, labels, "u", "a"), labels, "v", "b")
    more = written(component_labels(ends.select(F.col("a").alias("u"), F.col("b").alias("v"))), "labels-joined")
    return labelled(labels, more, "label", "least").select("node", F.col("least").alias("label")).unionByName(more)
