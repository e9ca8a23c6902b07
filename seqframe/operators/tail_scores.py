"""Tails of sequences, and how far reads with tails support either strand of the sequences that they overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bases import signal_downstream, signal_upstream
from ..functions.tails import SHORT_READS, Profile, head_region, tail_region
from .layout import name_of
from .overlaps import contained, target_then_query

C = F.col


def tail_info(sequences: DataFrame, profile: Profile = SHORT_READS) -> DataFrame:
    """(name, tail, head, has_signal, has_signal_rc) of sequences (name, seq) with a poly-A tail or a poly-T head: both as
    struct<start, end>, and whether a signal lies before the tail and a mirrored one behind the head."""
    found = sequences.select("name", "seq", tail_region(C("seq"), profile).alias("tail"), head_region(C("seq"), profile).alias("head"))
    found = found.where(C("tail").isNotNull() | C("head").isNotNull())
    signal = lambda region, has: F.coalesce(F.when(region.isNotNull(), has), F.lit(False))
    before, behind = signal_upstream(C("seq"), C("tail.start")), signal_downstream(C("seq"), C("head.end"))
    return found.select("name", "tail", "head", signal(C("tail"), before).alias("has_signal"), signal(C("head"), behind).alias("has_signal_rc"))


def tail_scores(paf: DataFrame, tailed: DataFrame, vertices: DataFrame, info: DataFrame, clip: int, skip: DataFrame | None = None) -> DataFrame:
    """(name, forward, reverse): for each target, the largest part of it that the start of a read with a tail covers, by strand; 0
    without one. Overlaps paf are of reads (queries) with the graph's sequences; tailed (name) are reads with a tail, vertices
    (vertex) those of the graph, info as tail_info returns it, skip (name) targets to leave out.

    A read counts only if no containment overlap up to its last base shows that its tail lies inside a target. Of a target with
    one strand in the graph that is so if the overlap ends before the target's tail; of one whose forward strand is there, always;
    of others, unless they have a tail and no head."""
    hits = paf.join(tailed.select(C("name").alias("qname")).distinct(), "qname", "left_semi")
    if skip is not None:
        hits = hits.join(skip.select(C("name").alias("tname")).distinct(), "tname", "left_anti")
    graph = vertices.select(name_of(C("vertex")).alias("tname"), F.right("vertex", F.lit(1)).alias("side")).distinct()
    strands = graph.groupBy("tname").agg(F.count(F.lit(1)).alias("n_strands"), F.max(C("side") == "+").alias("on_forward"))
    tails = info.select(C("name").alias("tname"), C("tail.start").alias("tail_start"), C("head").isNotNull().alias("has_head"))
    met = hits.join(strands, "tname", "left").join(tails, "tname", "left")
    orphan = C("tail_start").isNull() | C("has_head")
    inside = F.when(C("n_strands") == 1, C("tend") < C("tail_start")).when(C("on_forward"), F.lit(True)).otherwise(orphan)
    lost = met.where((contained(clip) != "NEITHER") & (C("qend") >= C("qlen")) & inside).select("qname").distinct()
    part = (C("tend") - C("tstart")) / C("tlen")
    kept = hits.where(target_then_query(clip)).join(lost, "qname", "left_anti")
    of = lambda strand: F.coalesce(F.max(F.when(C("strand") == strand, part)), F.lit(0.0))
    return kept.groupBy(C("tname").alias("name")).agg(of("+").alias("forward"), of("-").alias("reverse"))
