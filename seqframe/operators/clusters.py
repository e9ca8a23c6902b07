"""Clusters of reads of bounded size: pairs of neighbours merge their clusters in falling order of their overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import Tables
from .components import connected_components
from .overlaps import top_neighbours

C = F.col
#: Rounds between searches for components that can be taken whole.
WHOLE = 4


def best_pairs(paf: DataFrame, n: int) -> DataFrame:
    """(a, b, score): pairs of different sequences of which one is among the n best neighbours of the other. a is the smaller name."""
    near = top_neighbours(paf, n)
    return near.groupBy(F.least("name", "other").alias("a"), F.greatest("name", "other").alias("b")).agg(F.max("score").alias("score"))


def bounded_clusters(pairs: DataFrame, limit: int) -> DataFrame:
    """(name, cluster, n) of pairs (a, b, score) taken by falling score, then by names. A name without a cluster joins its partner's, or
    two of them make one; two clusters become one if they have fewer than `limit` names together, else they stay apart. cluster is the
    least name, n its size. Null names and pairs of a name with itself are left out; of repeated pairs the best score counts.

    A name's first pair always gives it a cluster, so first pairs make trees, each of which is one cluster that grows name by name:
    its size when a pair comes is the number of names that entered before. Of the other pairs, those of components that stay
    below the limit as a whole are all taken; else each round decides the pairs that are the first ones of both their
    clusters, and drops those between clusters that are too large by then."""
    tables = Tables(pairs.sparkSession, "clusters")
    e = pairs.where(C("a") != C("b")).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("score").alias("score"))
    e = tables.keep(e.select("a", "b", F.struct((-C("score")).alias("s"), "a", "b").alias("o")), "pairs")
    entered = tables.keep(e.select(F.explode(F.array("a", "b")).alias("name"), "o").groupBy("name").agg(F.min("o").alias("o")), "entered")
    first = entered.select("o.a", "o.b").distinct()
    trees = connected_components(first).select(C("id").alias("name"), C("component").alias("cluster"))
    members = tables.keep(entered.join(trees, "name").select("name", "cluster", "o"), "members0")
    of = lambda x, into: members.select(C("name").alias(x), C("cluster").alias(into))
    live = tables.keep(one_each(e.join(first, ["a", "b"], "left_anti").join(of("a", "c"), "a").join(of("b", "d"), "b")), "live0")
    out, i = None, 0
    while live.take(1):
        if i % WHOLE == 0:
            found = connected_components(live, "c", "d").withColumnRenamed("id", "cluster")
            total = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).join(found, "cluster").groupBy("component").agg(F.sum("n").alias("n"))
            whole = tables.keep(found.join(total.where(C("n") < limit), "component").select("cluster", "component"), f"whole{i}")
            members = members.join(whole, "cluster", "left").select("name", F.coalesce("component", "cluster").alias("cluster"), "o")
            live = tables.keep(live.join(whole, C("c") == C("cluster"), "left_anti"), f"live{i}w")
        active = live.select(F.explode(F.array("c", "d")).alias("cluster")).distinct()
        now = tables.keep(members.join(active.withColumn("on", F.lit(True)), "cluster", "left"), f"split{i}")
        settled = now.where(C("on").isNull()).select("name", "cluster")
        out, members = settled if out is None else out.union(settled), now.where(C("on")).select("name", "cluster", "o")
        least = live.select(F.explode(F.array("c", "d")).alias("cluster"), "o").groupBy("cluster").agg(F.min("o").alias("o"))
        both = least.groupBy("o").agg(F.count(F.lit(1)).alias("k"), F.min("cluster").alias("c"), F.max("cluster").alias("d")).where(C("k") == 2)
        top = tables.keep(both.select("o", "c", "d"), f"top{i}")
        sides = top.select(C("o").alias("at"), F.explode(F.array("c", "d")).alias("cluster"))
        sizes = sides.join(members, "cluster").where(C("o") < C("at")).groupBy("at").agg(F.count(F.lit(1)).alias("n"))
        moved = tables.keep(top.join(sizes.where(C("n") < limit), C("o") == C("at")).select(C("d").alias("cluster"), C("c").alias("into")), f"moved{i}")
        members = tables.keep(members.join(moved, "cluster", "left").select("name", F.coalesce("into", "cluster").alias("cluster"), "o"), f"members{i + 1}")
        left = live.join(top.select("o"), "o", "left_anti")
        for x in "cd":
            left = left.join(moved.withColumnRenamed("cluster", x), x, "left").withColumn(x, F.coalesce("into", x)).drop("into")
        live = tables.keep(not_too_large(one_each(left), members, limit), f"live{i + 1}")
        tables.drop(f"live{i}", f"live{i}w", f"members{i}", f"top{i}", f"moved{i}", f"whole{i}")
        i += 1
    every = members.select("name", "cluster") if out is None else out.union(members.select("name", "cluster"))
    named = every.groupBy("cluster").agg(F.min("name").alias("least"), F.count(F.lit(1)).alias("n"))
    return every.join(named, "cluster").select("name", C("least").alias("cluster"), "n")


def one_each(live: DataFrame) -> DataFrame:
    """The first pair between each two clusters: clusters only grow, so where it is refused all later ones are."""
    return live.where(C("c") != C("d")).groupBy(F.least("c", "d").alias("c"), F.greatest("c", "d").alias("d")).agg(F.min("o").alias("o"))


def not_too_large(live: DataFrame, members: DataFrame, limit: int) -> DataFrame:
    """Pairs but those that come after the last names of both clusters, which are too large together."""
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("o").alias("last"))
    out = live
    for x in "cd":
        out = out.join(sizes.select(C("cluster").alias(x), C("n").alias(f"{x}_n"), C("last").alias(f"{x}_last")), x)
    full = (C("o") > C("c_last")) & (C("o") > C("d_last")) & (C("c_n") + C("d_n") >= limit)
    return out.where(~full).select("c", "d", "o")
