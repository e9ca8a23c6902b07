"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import Tables

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): every id that occurs in an edge, and the smallest id that it is connected to.

    Each round points the larger neighbours of every node to its smallest neighbour, then its smaller ones. Edges
    become stars around the smallest ids in a logarithmic number of rounds. Minima are aggregated before the shuffle
    and rows meet them by a join, so a node with very many edges isn't gathered in one task. Null ends and loops are ignored.
    """
    spark = edges.sparkSession
    tables = Tables(spark, "components")
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    nodes = tables.keep(ends.select(F.explode(F.array("x", "y")).alias("id")).distinct(), "nodes")
    now = ends.where(F.col("x") != F.col("y")).select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
    now = tables.keep(now, "edges0")
    mark = None
    for i in range(1, MAX_ROUNDS):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = tables.keep(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), f"edges{i}")
        row = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        tables.drop(f"edges{i - 1}")
        now = new
        if row == mark:
            break
        mark = row
    else:
        raise RuntimeError("components did not end")
    return nodes.join(now.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )
