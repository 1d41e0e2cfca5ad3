"""Example graphs, and belief propagation on a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.graph.frame import GraphFrame
from loomspark.graph.messages import AggregateMessages as AM
from loomspark.session import shared_dir


def friends(spark: SparkSession) -> GraphFrame:
    """Six people and who is a friend of or follows whom."""
    # fixed values
    v = spark.createDataFrame([("a", "Alice", 34), ("b", "Bob", 36), ("c", "Charlie", 30), ("d", "David", 29), ("e", "Esther", 32), ("f", "Fanny", 36)], "id string, name string, age long")
    e = spark.createDataFrame([("a", "b", "friend"), ("b", "c", "follow"), ("c", "b", "follow"), ("f", "c", "follow"), ("e", "f", "follow"), ("e", "d", "friend"), ("d", "a", "friend")], "src string, dst string, relationship string")
    return GraphFrame(v, e)


def grid_ising_model(spark: SparkSession, n: int, v_std: float = 1.0, e_std: float = 1.0) -> GraphFrame:
    """An n by n grid: vertices (id "i,j") with a normal ``a``, edges to the right and down with a normal ``b``."""
    if n < 1:
        raise ValueError("n must be 1 or more")
    cell = spark.range(n * n).select((F.col("id") / n).cast("int").alias("i"), (F.col("id") % n).cast("int").alias("j"))
    name = lambda i, j: F.concat_ws(",", i, j)
    v = cell.select("i", "j", name(F.col("i"), F.col("j")).alias("id"), (F.randn(12345) * v_std).alias("a"))
    right = cell.where(F.col("j") < n - 1).select(name(F.col("i"), F.col("j")).alias("src"), name(F.col("i"), F.col("j") + 1).alias("dst"))
    down = cell.where(F.col("i") < n - 1).select(name(F.col("i"), F.col("j")).alias("src"), name(F.col("i") + 1, F.col("j")).alias("dst"))
    shared_dir(spark)
    # random columns must not be drawn again when a plan is run twice
    return GraphFrame(v.checkpoint(), right.unionByName(down).withColumn("b", F.randn(12346) * e_std).checkpoint())


def belief_propagation(g: GraphFrame, iterations: int) -> DataFrame:
    """The grid's vertices with ``belief`` in [0, 1]: the colours of a chessboard take turns to update from their neighbours."""
    shared_dir(g.vertices.sparkSession)
    v = g.vertices.withColumn("color", (F.col("i") + F.col("j")) % 2).withColumn("belief", F.lit(0.0))
    for _ in range(iterations):
        for color in (0, 1):
            now = GraphFrame(v, g.edges)
            send = lambda to, other: F.when(to["color"] == color, AM.edge["b"] * other["belief"])
            got = now.aggregateMessages(F.sum(AM.msg).alias("aggMess"), sendToSrc=send(AM.src, AM.dst), sendToDst=send(AM.dst, AM.src))
            log_odds = F.coalesce("aggMess", F.lit(0.0)) + F.col("a")
            v = v.join(got, "id", "left").withColumn("belief", F.when(F.col("color") == color, 1.0 / (1.0 + F.exp(-log_odds))).otherwise(F.col("belief"))).drop("aggMess").checkpoint()
    return v.drop("color")
