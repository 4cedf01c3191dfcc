"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Large-star links every larger neighbour of a node to the node's smallest neighbour, small-star
links a node and its smaller neighbours to the smallest of them; both keep components as they are.
They alternate until nothing changes, which takes few rounds also for long chains. Each round is a
grouped minimum (summed up before the shuffle, so a node with very many edges is no burden) and a
join that splits hot keys. Each step's edges are written as a table that the next one reads, and go
once that is written, as do the shuffles. A step never adds rows, so the rows before it tell how many
tasks write it: at least one a core, and one in ``TASK_EDGES`` rows. A checkpoint would have as many
partitions and files as the shuffle before it, however few rows they hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.tables import written
from creditloom.session import dropped_shuffles, shared_folder
from creditloom.sources.files import delete

TASK_EDGES = 500_000


def _large_star(edges: DataFrame) -> DataFrame:
    ways = [F.struct(F.col(x).alias("node"), F.col(y).alias("other")) for x, y in (("high", "low"), ("low", "high"))]
    both = edges.select(F.inline(F.array(*ways)))
    least = both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("least"))
    return (
        both.where("other > node").join(least, "node").select(F.col("other").alias("high"), F.col("least").alias("low"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("high").agg(F.min("low").alias("least"))
    # The smallest neighbour keeps the node; the other ones are linked to the smallest instead.
    child = F.when(F.col("low") == F.col("least"), F.col("high")).otherwise(F.col("low"))
    return edges.join(least, "high").select(child.alias("high"), F.col("least").alias("low")).distinct()


def _state(edges: DataFrame):
    # A sum of hashes may wrap or be rounded the same way each time; it only has to repeat.
    return edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))
    ).first()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of an edge; ``root`` is its component's smallest node.

    ``edges`` has two columns of one orderable type. Loops and repeated edges do no harm; nodes
    without an edge to another node are not returned.
    """
    spark = edges.sparkSession
    a, b = (F.col(f"`{name}`") for name in edges.columns)
    edges = edges.where(a != b).select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct()
    with dropped_shuffles(spark):
        edges = written(edges, folder := shared_folder(spark))
        state = _state(edges)
        while state[0]:
            tasks = max(spark.sparkContext.defaultParallelism, -(-state[0] // TASK_EDGES))
            for step in (_large_star, _small_star):
                edges, old = written(step(edges).coalesce(tasks), new := shared_folder(spark)), folder
                delete(spark, old)
                folder = new
            before, state = state, _state(edges)
            if state == before:
                break
    return edges.select(F.col("high").alias("node"), F.col("low").alias("root")).union(
        edges.select("low", "low").distinct()
    )
