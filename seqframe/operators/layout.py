"""The overlap graph: vertices of both strands, best neighbours, walks, redundant vertices, supported edges and sequences of
paths. Edges are (src, dst, s_start, s_end, t_start, t_end) with strands at the ends of the names."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequence import reverse_complement
from ..tables import Tables

C = F.col


def vertices(names: DataFrame) -> DataFrame:
    """(vertex): both strands of each name."""
    return names.select(F.explode(F.array(F.concat("name", F.lit("+")), F.concat("name", F.lit("-")))).alias("vertex"))


def name_of(vertex: Column) -> Column:
    return F.left(vertex, F.length(vertex) - 1)


def flipped(vertex: Column) -> Column:
    return F.concat(name_of(vertex), F.when(F.right(vertex, F.lit(1)) == "+", "-").otherwise("+"))


def without(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges that touch no strand of the names."""
    gone = names.select("name").distinct()
    return edges.join(gone, name_of(C("src")) == C("name"), "left_anti").join(gone, name_of(C("dst")) == C("name"), "left_anti")


def size(edge: str = "") -> Column:
    """Mean of both overlap lengths, rounded down."""
    c = lambda n: C(f"{edge}.{n}" if edge else n)
    return F.floor(((c("s_end") - c("s_start")) + (c("t_end") - c("t_start"))) / 2).cast("int")


def closest(edges: DataFrame, forward: bool = True) -> DataFrame:
    """(vertex, next, size): the neighbour of the greatest overlap; of equal ones, the first by name."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    rows = edges.select(C(a).alias("vertex"), C(b).alias("next"), size().alias("size"))
    return rows.groupBy("vertex").agg(F.min_by("next", F.struct(-C("size"), "next")).alias("next"), F.max("size").alias("size"))


def heaviest(edges: DataFrame, weights: DataFrame, forward: bool = True) -> DataFrame:
    """(vertex, next, weight): the neighbour whose name has the greatest positive weight (name, weight); of equal ones, the first."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    rows = edges.select(C(a).alias("vertex"), C(b).alias("next"), name_of(C(b)).alias("name")).join(weights.where(C("weight") > 0), "name")
    return rows.groupBy("vertex").agg(F.min_by("next", F.struct(-C("weight"), "next")).alias("next"), F.max("weight").alias("weight"))


def walks(steps: DataFrame, most: int | None = None) -> DataFrame:
    """(vertex, path): from each vertex on along (vertex, next), at most `most` steps, until a vertex comes again; the vertex
    itself first. Paths double in each round, so rounds are logarithmic in the longest one."""
    tables = Tables(steps.sparkSession, "walks")
    every = steps.select("vertex").union(steps.select("next")).distinct()
    first = every.join(steps.select("vertex", "next"), "vertex", "left").select("vertex", F.array("vertex").alias("path"), C("next").alias("last"))
    now, i = tables.keep(first, "round0"), 0
    while now.where(C("last").isNotNull()).take(1) and (most is None or 2**i <= most):
        on = now.select(C("vertex").alias("last"), C("path").alias("more"), C("last").alias("then"))
        met = now.join(on, "last", "left")
        whole = F.when(C("more").isNull(), C("path")).otherwise(F.concat("path", "more"))
        once = F.array_distinct(whole)  # what comes after a vertex that comes again has been seen
        new = met.select("vertex", once.alias("path"), F.when(F.size(once) == F.size(whole), C("then")).alias("last"))
        i += 1
        now = tables.keep(new, f"round{i}")
        tables.drop(f"round{i - 1}")
    return now.select("vertex", (C("path") if most is None else F.slice("path", 1, most + 1)).alias("path"))


def redundant(edges: DataFrame, tolerance: float = 0.9, level: int | None = None) -> DataFrame:
    """(vertex): vertices that their neighbours bridge: the closest predecessor has an edge to the closest successor; every
    predecessor leads to a successor, or to a predecessor that does; every successor comes from a predecessor, or from a
    successor that does; and each bridge's overlap is like the one implied through the vertex (within `tolerance`). With `level`,
    only vertices of that level are judged (_src and _dst: the levels of an edge's ends)."""
    at = lambda end: edges if level is None else edges.where(C(end) == level)
    e, e_in, e_out = (x.select("src", "dst", "s_start", "s_end", "t_start", "t_end") for x in (edges, at("_dst"), at("_src")))
    into, out = e_in.alias("i"), e_out.alias("o")
    bridge = e.alias("b")
    pairs = into.join(out, C("i.dst") == C("o.src")).join(bridge, (C("b.src") == C("i.src")) & (C("b.dst") == C("o.dst")))
    reverse = F.right("i.dst", F.lit(1)) == "-"
    length = F.when(reverse, C("i.t_end") - C("o.s_start")).otherwise(C("o.s_end") - C("i.t_start"))
    left = length - (C("i.t_end") - C("i.t_start"))
    right = length - (C("o.s_end") - C("o.s_start"))
    through = length - left - right
    alike = F.greatest(size("b"), through) * tolerance <= F.least(size("b"), through)
    found = pairs.where(C("i.src") != C("o.dst")).select(C("i.dst").alias("v"), C("i.src").alias("p"), C("o.dst").alias("s"), alike.alias("alike"))
    good = found.groupBy("v").agg(F.bool_and("alike").alias("alike")).where("alike").select("v")
    p1, s1 = closest(e_in, False).select(C("vertex").alias("v"), C("next").alias("p")), closest(e_out).select(C("vertex").alias("v"), C("next").alias("s"))
    near = p1.join(s1, "v").join(found.select("v", "p", "s"), ["v", "p", "s"], "left_semi").select("v")
    bridged_p, bridged_s = found.select("v", "p").distinct(), found.select("v", "s").distinct()
    preds, succs = e_in.select(C("dst").alias("v"), C("src").alias("p")), e_out.select(C("src").alias("v"), C("dst").alias("s"))
    # Predecessors without a bridge need an edge to one with a bridge; successors likewise from one.
    to = e.select(C("src").alias("p"), C("dst").alias("q"))
    saved_p = preds.join(bridged_p, ["v", "p"], "left_anti").join(to, "p").join(bridged_p.select("v", C("p").alias("q")), ["v", "q"], "left_semi").select("v", "p").distinct()
    frm = e.select(C("dst").alias("s"), C("src").alias("q"))
    saved_s = succs.join(bridged_s, ["v", "s"], "left_anti").join(frm, "s").join(bridged_s.select("v", C("s").alias("q")), ["v", "q"], "left_semi").select("v", "s").distinct()
    lost_p = preds.join(bridged_p.union(saved_p), ["v", "p"], "left_anti").select("v")
    lost_s = succs.join(bridged_s.union(saved_s), ["v", "s"], "left_anti").select("v")
    return good.join(near.distinct(), "v").join(lost_p.distinct(), "v", "left_anti").join(lost_s.distinct(), "v", "left_anti").select(C("v").alias("vertex"))


@F.pandas_udf(T.DoubleType())
def binomial_cdf(found: pd.Series, trials: pd.Series, chance: pd.Series) -> pd.Series:
    """P(X <= found) of a binomial variable."""

    def one(k: float, n: float, q: float) -> float:
        k, n = int(k), int(n)
        if k >= n or q <= 0:
            return 1.0
        if k < 0 or q >= 1:
            return 0.0
        i = np.arange(k + 1)
        logs = np.concatenate([[0.0], np.cumsum(np.log((n - i[:-1]) / (i[:-1] + 1)))]) + i * math.log(q) + (n - i) * math.log1p(-q)
        top = logs.max()
        return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))

    return pd.Series([one(*x) for x in zip(found, trials, chance, strict=True)], dtype="float64")


def supported(edges: DataFrame, counts: DataFrame, lengths: DataFrame, least: float = 0.001) -> DataFrame:
    """Edges (src, dst, size, support) with `chance` and `kept`. Reads that span an overlap are those longer than it: their share
    is that of the sample (length, n: how many reads have it). An edge goes if so few supporting reads, of as many reads as
    the larger count (name, n_reads) of its ends, are less likely than `least`. Overlaps of the longest read's size or more
    stay. The sample has a row for each length."""
    total = lengths.agg(F.sum("n").alias("total"), F.max("length").alias("longest"))
    # Reads up to each size by a running sum over sizes and lengths together, of which there is a row for each different one.
    both = lengths.select(C("length").alias("at"), "n", F.lit(0).alias("asked")).union(edges.select(C("size").alias("at"), F.lit(0).cast("long"), F.lit(1)).distinct())
    upto = Window.orderBy("at", "asked").rowsBetween(Window.unboundedPreceding, 0)
    share = both.withColumn("shorter", F.sum("n").over(upto)).where(C("asked") == 1).select(C("at").alias("size"), "shorter")
    met = edges.join(share, "size").join(F.broadcast(total))
    for side in ("src", "dst"):
        met = met.join(counts.select(C("name").alias(f"_{side}"), C("n_reads").alias(f"n_{side}")), name_of(C(side)) == C(f"_{side}"), "left")
    trials = F.floor(F.greatest(F.coalesce("n_src", F.lit(0.0)), F.coalesce("n_dst", F.lit(0.0))))
    met = met.withColumn("trials", trials).withColumn("spanning", 1 - C("shorter") / C("total"))
    tested = (C("size") < C("longest")) & (C("support") < C("trials"))
    chance = F.when(tested, binomial_cdf(C("support").cast("double"), C("trials").cast("double"), C("spanning")))
    met = met.withColumn("chance", chance)
    return met.select("src", "dst", "size", "support", "chance", F.coalesce(C("chance") >= least, F.lit(True)).alias("kept"))


def dovetail_support(hits: DataFrame, read: str = "qname") -> DataFrame:
    """(src, dst, support): how many times two targets lie in a read one after the other with an overlap, as vertices. Each pair
    gives the edge and its mirror. Hits (read, tname, strand, qstart, qend) of a read are compared by bins of its places."""
    from .intervals import overlap_join

    h = hits.select(C(read).alias("name"), F.monotonically_increasing_id().alias("id"), "tname", "strand", C("qstart").alias("s"), C("qend").alias("e"))
    h = Tables(hits.sparkSession, "support").keep(h, "hits")
    pairs = overlap_join(h.select("name", "id", "s", "e"), h.select("name", "id", "s", "e"), "name", 512).select("id1", "id2")
    for i in "12":
        pairs = pairs.join(h.select(C("id").alias(f"id{i}"), F.concat("tname", "strand").alias(f"v{i}"), C("s").alias(f"s{i}"), C("e").alias(f"e{i}")), f"id{i}")
    pairs = pairs.where((C("s1") < C("s2")) & (C("e1") < C("e2")) & (C("e1") > C("s2")))
    both = pairs.select(C("v1").alias("src"), C("v2").alias("dst")).union(pairs.select(flipped(C("v2")), flipped(C("v1"))))
    return both.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("support"))


def stitched(paths: DataFrame, edges: DataFrame, sequences: DataFrame) -> DataFrame:
    """(id, seq) of paths (id, path): each vertex adds its part up to the overlap with the next one; the last one the rest.
    A path's parts are put together in one row. Parts of a vertex on the reverse strand are reverse complements."""
    step = paths.select("id", F.posexplode("path").alias("i", "v"), C("path").alias("p"))
    step = step.select("id", "i", "v", F.get("p", C("i") - 1).alias("before"), F.get("p", C("i") + 1).alias("after"))
    e_in = edges.select(C("src").alias("before"), C("dst").alias("v"), C("t_start").alias("in_start"), C("t_end").alias("in_end"))
    e_out = edges.select(C("src").alias("v"), C("dst").alias("after"), C("s_start").alias("out_start"), C("s_end").alias("out_end"))
    met = step.join(e_in, ["before", "v"], "left").join(e_out, ["v", "after"], "left").join(sequences.select("name", "seq"), name_of(C("v")) == C("name"))
    n = F.length("seq")
    reverse = F.right("v", F.lit(1)) == "-"
    start = F.when(reverse, F.coalesce("out_end", F.lit(0))).otherwise(F.coalesce("in_start", F.lit(0)))
    end = F.when(reverse, F.coalesce("in_end", n)).otherwise(F.coalesce("out_start", n))
    part = F.substring(C("seq"), start + 1, F.greatest(F.lit(0), end - start))
    made = met.select("id", "i", F.when(reverse, reverse_complement(part)).otherwise(part).alias("part"))
    return made.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]), "").alias("seq"))


def oriented(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """Edges after pruning by tails: of names (name, forward, reverse) with a tail on one strand only the other strand's vertex
    goes; then edges from a vertex without its other strand to one that still has it."""
    one = scores.where((C("forward") > 0) != (C("reverse") > 0)).select(F.concat("name", F.when(C("forward") > 0, "-").otherwise("+")).alias("gone"))
    kept = edges.join(one, C("src") == C("gone"), "left_anti").join(one, C("dst") == C("gone"), "left_anti")
    single = one.select(flipped(C("gone")).alias("single"))
    from_single = kept.join(single, C("src") == C("single"), "left_semi")
    to_both = from_single.join(single, C("dst") == C("single"), "left_anti").select("src", "dst")
    return kept.join(to_both, ["src", "dst"], "left_anti")
