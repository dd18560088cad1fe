"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import written


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (a, b).

    Each round points a node to its smallest neighbour, if that is smaller, follows the pointers to
    their ends by doubling, and merges what shares an end; it goes on until no edge is left between
    ends. An end that another end's tree touches has a smaller neighbour after the round, so the
    ends left after two rounds are at most half of the nodes: rounds are logarithmic for any order
    of the ids, and each lowers the number of nodes. Only tables in the shared folder carry over.
    """
    pairs = lambda a, b: edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    edges, levels = written(pairs("a", "b"), spark, "edges"), []
    while not levels or not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        ends = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("end")), spark, "ends")
        while True:
            over = ends.select(F.col("node").alias("end"), F.col("end").alias("over"))
            ends = written(ends.select("node", "end").join(over, "end").select("node", F.col("over").alias("end"), (F.col("over") < F.col("end")).alias("moved")), spark, "ends")
            if ends.where("moved").isEmpty():
                break
        levels.append(ends.select("node", "end"))
        edges = edges.join(levels[-1].toDF("a", "x"), "a").join(levels[-1].toDF("b", "y"), "b").where("x <> y")
        edges = written(pairs("x", "y"), spark, "edges")
    labels = levels.pop().toDF("node", "component")
    for level in reversed(levels):
        after = labels.withColumnRenamed("node", "end")
        labels = written(level.join(after, "end", "left").select("node", F.coalesce("component", "end").alias("component")), spark, "labels")
    return labels
