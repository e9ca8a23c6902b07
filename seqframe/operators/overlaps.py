"""Pairwise overlap records: predicates, classes, best neighbours and counts."""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def large(n: int) -> Column:
    return (C("qend") - C("qstart") >= n) & (C("tend") - C("tstart") >= n)


def similar_sized(tolerance: int) -> Column:
    return F.abs((C("qend") - C("qstart")) - (C("tend") - C("tstart"))) <= tolerance


def good(identity: float) -> Column:
    return C("nmatch") / C("blocklen") >= identity


def contained(clip: int) -> Column:
    """QUERY, TARGET, BOTH or NEITHER: which sequence the overlap spans up to `clip` bases at its ends."""
    q = (C("qstart") <= clip) & (C("qlen") - C("qend") <= clip)
    t = (C("tstart") <= clip) & (C("tlen") - C("tend") <= clip)
    return F.when(q & t, "BOTH").when(q, "QUERY").when(t, "TARGET").otherwise("NEITHER")


def _ends() -> tuple[Column, Column, Column, Column]:
    return C("qstart"), C("qlen") - C("qend"), C("tstart"), C("tlen") - C("tend")


def query_then_target(clip: int) -> Column:
    """The query's end runs into the target's start (the target's other end on the reverse strand)."""
    qh, qt, th, tt = _ends()
    same = (qh > th) & (qt < tt) & (th <= clip) & (qt <= clip)
    turned = (qh > tt) & (th > qt) & (tt <= clip) & (qt <= clip)
    return F.when(C("strand") == "+", same).otherwise(turned)


def target_then_query(clip: int) -> Column:
    """The target runs into the query's start: the query is the sink of the edge."""
    qh, qt, th, tt = _ends()
    same = (th > qh) & (tt < qt) & (qh <= clip) & (tt <= clip)
    turned = (qt > th) & (tt > qh) & (qh <= clip) & (th <= clip)
    return F.when(C("strand") == "+", same).otherwise(turned)


def dovetail(clip: int) -> Column:
    return query_then_target(clip) | target_then_query(clip)


def inverted_self(clip: int) -> Column:
    """A sequence that overlaps its own other strand at an edge."""
    return (C("qname") == C("tname")) & (C("strand") == "-") & ((C("qstart") <= clip) | (C("qlen") - C("qend") <= clip))


def near_primary(paf: DataFrame) -> DataFrame:
    """Records whose identity is at least the square of that of their query's best primary record; all records of queries without one."""
    best = paf.groupBy("qname").agg(F.max(F.when(C("is_primary"), C("nmatch") / C("blocklen"))).alias("_best"))
    return paf.join(best, "qname").where(C("_best").isNull() | (C("nmatch") / C("blocklen") >= C("_best") * C("_best"))).drop("_best")


def edges(paf: DataFrame, clip: int) -> DataFrame:
    """(src, dst, s_start, s_end, t_start, t_end): dovetail edges between oriented sequences, with the mirrored edge of the other strands."""
    ahead = query_then_target(clip)
    rows = paf.where(C("qname") != C("tname")).where(ahead | target_then_query(clip)).withColumn("_ahead", ahead)
    ends = "qstart", "qend", "tstart", "tend"
    same = C("strand") == "+"
    # A record gives one edge at most, its mirror with it: the query runs into the target, or its other strand does.
    q, q_other = F.when(C("_ahead"), "+").otherwise("-"), F.when(C("_ahead"), "-").otherwise("+")
    t, t_other = F.when(C("_ahead") == same, "+").otherwise("-"), F.when(C("_ahead") == same, "-").otherwise("+")
    edge = lambda src, dst, *places: F.struct(src.alias("src"), dst.alias("dst"), *[C(x).alias(n) for x, n in zip(places, ("s_start", "s_end", "t_start", "t_end"), strict=True)])
    both = F.array(edge(F.concat("qname", q), F.concat("tname", t), *ends), edge(F.concat("tname", t_other), F.concat("qname", q_other), *ends[2:], *ends[:2]))
    return rows.select(F.inline(both))


#: Places are below this.
PLACES = 1 << 31


def best_edges(edge_rows: DataFrame) -> DataFrame:
    """One row per (src, dst): the longest overlap (mean of both sides), by coordinates on ties. What edges are compared by is one number,
    so that they are aggregated by hashing; structs would be sorted."""
    at = {c: C(c).cast("long") for c in ("s_start", "s_end", "t_start", "t_end")}
    size2 = (at["s_end"] - at["s_start"]) + (at["t_end"] - at["t_start"])
    high, low = size2 * PLACES + (PLACES - 1 - at["s_start"]), (PLACES - 1 - at["t_start"]) * PLACES + at["s_end"]
    unit = F.lit(Decimal(PLACES * PLACES))
    best = edge_rows.groupBy("src", "dst").agg(F.max(high.cast("decimal(20,0)") * unit + low.cast("decimal(19,0)")).alias("_x"))
    best = best.withColumn("_low", F.pmod("_x", unit).cast("long")).withColumn("_high", ((C("_x") - C("_low")) / unit).cast("long"))
    best = best.withColumn("size2", F.shiftright("_high", 31))
    s_start, s_end = PLACES - 1 - F.pmod("_high", F.lit(PLACES)), F.pmod("_low", F.lit(PLACES))
    t_start = PLACES - 1 - F.shiftright("_low", 31)
    found = {"s_start": s_start, "s_end": s_end, "t_start": t_start, "t_end": C("size2") - (s_end - s_start) + t_start}
    return best.select("src", "dst", *[x.cast(edge_rows.schema[c].dataType).alias(c) for c, x in found.items()], "size2")


def resolve_junctions(edge_rows: DataFrame) -> DataFrame:
    """Edges that are the best one both out of their source and into their target (longest, then by names)."""
    out = Window.partitionBy("src").orderBy(F.desc("size2"), "dst")
    into = Window.partitionBy("dst").orderBy(F.desc("size2"), "src")
    ranked = edge_rows.withColumn("_o", F.row_number().over(out)).withColumn("_i", F.row_number().over(into))
    return ranked.where((C("_o") == 1) & (C("_i") == 1)).drop("_o", "_i")


def transitive(edge_rows: DataFrame) -> DataFrame:
    """(src, dst) of edges a-c for which edges a-b and b-c exist and a-c's overlap is the smaller."""
    ab = edge_rows.select(C("src").alias("a"), C("dst").alias("b"), C("size2").alias("ab"))
    bc = edge_rows.select(C("src").alias("b"), C("dst").alias("c"), C("size2").alias("bc"))
    ac = edge_rows.select(C("src").alias("a"), C("dst").alias("c"), C("size2").alias("ac"))
    # Starting from each a-c edge, the middle is looked up on both sides: no list of all two-step paths is kept.
    met = ac.join(ab, "a").where((C("b") != C("c")) & (C("ac") < C("ab"))).join(bc, ["b", "c"]).where(C("ac") < C("bc"))
    return met.select(C("a").alias("src"), C("c").alias("dst")).distinct()


def top_neighbours(paf: DataFrame, n: int) -> DataFrame:
    """(name, other, score): the n best neighbours of each sequence by matches of their best overlap; ties by name."""
    rows = paf.where(C("qname") != C("tname"))
    both = rows.select(C("qname").alias("name"), C("tname").alias("other"), "nmatch").union(rows.select("tname", "qname", "nmatch"))
    scored = both.groupBy("name", "other").agg(F.max("nmatch").alias("score"))
    order = Window.partitionBy("name").orderBy(F.desc("score"), "other")
    return scored.withColumn("rank", F.row_number().over(order)).where(C("rank") <= n)


def seed_pairs(paf: DataFrame) -> DataFrame:
    """(seed1, seed2, n): how many queries have these as their best and second-best targets (in either order)."""
    best = paf.groupBy("qname", "tname").agg(F.max("nmatch").alias("score"))
    order = Window.partitionBy("qname").orderBy(F.desc("score"), "tname")
    two = best.withColumn("_r", F.row_number().over(order)).where(C("_r") <= 2).groupBy("qname").agg(F.sort_array(F.collect_list("tname")).alias("t"))
    pairs = two.where(F.size("t") == 2).select(F.get("t", F.lit(0)).alias("seed1"), F.get("t", F.lit(1)).alias("seed2"))
    return pairs.groupBy("seed1", "seed2").agg(F.count(F.lit(1)).alias("n"))


def _split_counts(rows: pd.DataFrame) -> pd.DataFrame:
    """Shares of one query's targets: overlaps by falling span; one that a kept overlap covers by 95 % joins it if it is
    nearly as long, and then they share; others that are covered don't count."""
    rows = rows.assign(span=rows["qend"] - rows["qstart"]).sort_values(["span", "tname", "qstart", "tstart"], ascending=[False, True, True, True])
    kept: list[tuple] = []
    joined: list[list[tuple]] = []
    for r in rows.itertuples(index=False):
        over = [max(0, min(r.qend, k.qend) - max(r.qstart, k.qstart)) for k in kept]
        best = max(range(len(kept)), key=lambda i: over[i], default=None)
        if best is None or over[best] == 0 or over[best] < 0.95 * r.span:
            kept.append(r)
            joined.append([r])
        elif r.span >= kept[best].span * 0.95:
            joined[best].append(r)
    out = [(r.tname, (r.tend - r.tstart) / r.tlen / len(g)) for g in joined for r in g]
    return pd.DataFrame(out, columns=["name", "share"])


def multimap_counts(paf: DataFrame) -> DataFrame:
    """(name, n_reads): length-normalised counts, with near-equal overlaps of a query sharing one count."""
    columns = ["qname", "qstart", "qend", "tname", "tlen", "tstart", "tend"]
    shares = paf.select(*columns).groupBy("qname").applyInPandas(_split_counts, "name string, share double")
    return shares.groupBy("name").agg(F.sum("share").alias("n_reads"))


def drop_unlike_edges(edge_rows: DataFrame, counts: DataFrame, most: float) -> DataFrame:
    """Edges whose sequences' counts differ by at most `most` powers of ten; edges of uncounted sequences go."""
    def at(side: str) -> DataFrame:
        return counts.select(C("name").alias(f"_{side}"), C("n_reads").alias(f"_n_{side}"))

    name = lambda c: F.expr(f"substring({c}, 1, length({c}) - 1)")
    met = edge_rows.withColumn("_src", name("src")).withColumn("_dst", name("dst")).join(at("src"), "_src").join(at("dst"), "_dst")
    return met.where(F.abs(F.log10("_n_src") - F.log10("_n_dst")) <= most).drop("_src", "_dst", "_n_src", "_n_dst")
