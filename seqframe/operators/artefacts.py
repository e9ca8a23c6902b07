"""Artefacts of assembled sequences, told by the k-mer graph: ends that fold back to their own mirror, joins of two sequences, and
ends that stop beside a known sequence that goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import kmer_codes, mirrored
from ..tables import Tables
from .extension import dead_ends, greedy_steps
from .kmers import covered, runs
from .walking import median_of, walks_from

C = F.col


def places_of(reads: DataFrame, k: int) -> DataFrame:
    """(read_id, pos, code, n): stranded k-mers with their read's number of k-mers; null codes where a base isn't valid."""
    rows = kmer_codes(reads, k, text=False).select("read_id", "pos", "code")
    return rows.join(reads.select("read_id", (F.length("seq") - k + 1).alias("n")), "read_id")


def mirrored_halves(reads: DataFrame, k: int) -> DataFrame:
    """(read_id, start, n_matched, seq) of reads (read_id, seq) whose right half repeats the left one on the other strand: k k-mers or
    more of the right half are mirrored in the left one. The read is cut to what begins at the first of these k-mers, or
    at the first such one of the whole left half where the right half begins with one. Ids are unique; null, empty and short texts have no row."""
    rows = Tables(reads.sparkSession, "halves").keep(places_of(reads, k), "places")
    half = F.floor(C("n") / 2)
    left = rows.where(C("pos") < half).select("read_id", mirrored(C("code"), k).alias("code")).distinct()
    met = rows.where(C("code").isNotNull()).join(left, ["read_id", "code"], "left_semi").groupBy("read_id").agg(
        F.count(F.when(C("pos") >= half, 1)).alias("right"), F.min(F.when(C("pos") >= half, C("pos"))).alias("first"), F.min("pos").alias("least"), F.first(half).alias("half")
    )
    found = met.where(C("right") >= k).select("read_id", F.when(C("first") == C("half"), C("least")).otherwise(C("first")).cast("int").alias("start"), C("right").alias("n_matched"))
    return found.join(reads.select("read_id", "seq"), "read_id").select("read_id", "start", "n_matched", F.substring(C("seq"), C("start") + 1, F.length("seq")).alias("seq"))


def gaps(rows: DataFrame, assembled: DataFrame) -> DataFrame:
    """(read_id, start, end, n_places) of the runs of k-mers that aren't in assembled (code); end included."""
    known = rows.join(assembled.select("code").distinct().withColumn("known", F.lit(True)), "code", "left")
    found = runs(known.withColumn("known", F.coalesce("known", F.lit(False))), ~C("known"))
    return found.select("read_id", "start", "end").join(rows.groupBy("read_id").agg(F.first("n").alias("n_places")), "read_id")


def chimeras(reads: DataFrame, spec: DataFrame, assembled: DataFrame, k: int, depth: int, bound: int = 1000) -> DataFrame:
    """(read_id, from, to): reads (read_id, seq) that join two known sequences. Their first and last k-mers are known (assembled: code), and
    not all between are. Gaps of up to 2k unknown k-mers count as known if greedy steps among known ones lead over them, from
    either side; one before the last k-mer doesn't. The places from before the first gap that is left to behind the last one are
    2k apart at most, and `bound` greedy steps forward from the one and backward from the other share no k-mer. spec holds stranded
    k-mers (code, cov)."""
    tables = Tables(reads.sparkSession, "chimeras")
    rows = tables.keep(places_of(reads, k), "places", merge=True)
    spec = tables.keep(spec.select("code", "cov"), "spec", merge=True)
    assembled = tables.keep(assembled.select("code").distinct(), "assembled", merge=True)
    found = tables.keep(gaps(rows, assembled), "gaps")
    outside = found.where((C("start") == 0) | (C("end") == C("n_places") - 1)).select("read_id").distinct()
    inner = found.join(outside, "read_id", "left_anti")
    at = lambda place, name: rows.select("read_id", C("pos").alias(place), C("code").alias(name))
    inner = inner.withColumn("before", C("start") - 1).withColumn("after", C("end") + 1)
    inner = tables.keep(inner.join(at("before", "left"), ["read_id", "before"]).join(at("after", "right"), ["read_id", "after"]), "inner")
    steps = [tables.keep(greedy_steps(spec, k, depth, forward, assembled), f"steps{forward}", merge=True) for forward in (True, False)]
    short = inner.where(C("end") - C("start") + 1 <= 2 * k)
    walked = both_ways(short, steps, 2 * k, tables, "short")
    # A path of as many steps at most as the gap has places; both walks may meet on the way.
    n = (C("end") - C("start") + 1).cast("int")
    ahead, back = F.slice("ahead", F.lit(2), n), F.slice("back", F.lit(2), n)
    over = F.array_contains(ahead, C("right")) | F.array_contains(back, C("left")) | F.arrays_overlap(ahead, back)
    bridged = walked.where(over).select("read_id", "start", F.lit(True).alias("bridged"))
    judged = inner.join(bridged, ["read_id", "start"], "left").withColumn("open", C("bridged").isNull() | (C("end") == C("n_places") - 2))
    first = judged.where("open").groupBy("read_id").agg(F.min("start").alias("first"))
    judged = judged.join(first, "read_id").where(C("bridged").isNull() | (C("start") == C("first")))
    ends = judged.groupBy("read_id").agg(F.min_by(F.struct("before", "left"), "start").alias("l"), F.max_by(F.struct("after", "right"), "start").alias("r"))
    ends = ends.select("read_id", "l.before", "l.left", "r.after", "r.right").where(C("after") - C("before") <= 2 * k)
    apart = both_ways(tables.keep(ends, "ends"), steps, bound, tables, "far")
    ahead, back = (F.slice(x, F.lit(2), F.greatest(F.lit(0), F.size(x) - 1)) for x in ("ahead", "back"))
    return apart.where(~F.arrays_overlap(ahead, back)).select("read_id", C("before").alias("from"), C("after").alias("to"))


def both_ways(ends: DataFrame, steps: list[DataFrame], bound: int, tables: Tables, name: str) -> DataFrame:
    """ends (left, right, ...) with the walks `ahead` from the left code and `back` from the right one, themselves first."""
    out = ends
    for side, into, s in (("left", "ahead", steps[0]), ("right", "back", steps[1])):
        starts = ends.select(C(side).alias("id"), C(side).alias("code")).distinct()
        walks = tables.keep(walks_from(starts, s, bound, tables, f"{name}_{into}"), f"{name}_{into}_walks", merge=True)
        tables.drop(f"{name}_{into}_rows0")
        tables.tidy()
        out = out.join(walks.select(C("id").alias(side), C("path").alias(into)), side)
    return out


def reach(spec: DataFrame, k: int, most: int, tables: Tables, forward: bool = True, name: str = "reach") -> DataFrame:
    """(code, steps): how many steps lead on from each k-mer, at most `most`."""
    ended = dead_ends(spec, k, most, tables, forward, name)
    return spec.select("code").join(ended, "code", "left").select("code", F.coalesce("steps", F.lit(most)).alias("steps"))


def blunt_ends(reads: DataFrame, spec: DataFrame, assembled: DataFrame, k: int, edge: int, distance: int) -> DataFrame:
    """(read_id, side, n_unknown): reads (read_id, seq) that leave a known sequence near one end and stop, while the known one goes on.

    One end's k-mer is known (assembled: code) and the other one isn't, or the known end's least coverage over `edge` k-mers is the
    greater one; the right end is judged if the first k-mer decides so, else the left one. At most `distance` k-mers at the
    judged end follow the known run (at the left end, distance + 1). No walk of `edge` k-mers leads on from the end, itself included, the known run's median
    coverage is greater than the rest's, and known k-mers lead on from the run's last one as far as the end. spec holds stranded k-mers
    (code, cov). Nothing comes out for an edge of 0."""
    if edge <= 0:
        return reads.select("read_id", F.lit("right").alias("side"), F.lit(0).alias("n_unknown")).limit(0)
    tables = Tables(reads.sparkSession, "blunt")
    spec, assembled = tables.keep(spec.select("code", "cov"), "spec", merge=True), tables.keep(assembled.select("code").distinct(), "assembled", merge=True)
    cov = covered(reads, k, spec, stranded=True, text=False).select("read_id", "pos", "code", "cov")
    known = assembled.withColumn("known", F.lit(True))
    rows = cov.join(known, "code", "left").select("read_id", "pos", "code", "cov", F.coalesce("known", F.lit(False)).alias("known"))
    rows = rows.join(reads.select("read_id", (F.length("seq") - k + 1).alias("n")), "read_id")
    rows = tables.keep(rows, "rows", merge=True)
    last = C("n") - 1
    seen = rows.groupBy("read_id", "n").agg(
        F.max(F.when(C("pos") == 0, C("known"))).alias("head"), F.max(F.when(C("pos") == last, C("known"))).alias("tail"),
        F.min(F.when(C("pos") < edge, C("cov"))).alias("head_cov"), F.min(F.when(C("pos") >= C("n") - edge, C("cov"))).alias("tail_cov"),
        F.min(F.when(~C("known"), C("pos"))).alias("first"), F.max(F.when(~C("known"), C("pos"))).alias("final"),
    )
    right = C("head") & (~C("tail") | (C("head_cov") > C("tail_cov")))
    left = C("tail") & (~C("head") | (C("head_cov") < C("tail_cov")))
    seen = seen.withColumn("side", F.when(right, "right").when(left, "left")).where(C("side").isNotNull() & C("first").isNotNull())
    # The run ends before `cut` to the right, or begins behind it to the left.
    seen = seen.withColumn("cut", F.when(C("side") == "right", C("first")).otherwise(C("final") + 1))
    unknown = F.when(C("side") == "right", C("n") - C("cut")).otherwise(C("cut"))
    seen = seen.withColumn("n_unknown", unknown.cast("int")).where(F.when(C("side") == "right", C("n_unknown") <= distance).otherwise(C("n_unknown") <= distance + 1))
    kept = rows.join(seen.select("read_id", "side", "cut", "n_unknown"), "read_id")
    on_right = C("side") == "right"
    own = (C("pos") < C("cut")) == on_right
    end = F.when(on_right, C("n") - 1).otherwise(F.lit(0))
    stop = F.when(on_right, C("cut") - 1).otherwise(C("cut"))
    judged = kept.groupBy("read_id", "side", "n_unknown").agg(
        median_of(F.collect_list(F.when(own, C("cov")))).alias("run_cov"), median_of(F.collect_list(F.when(~own, C("cov")))).alias("rest_cov"),
        F.max(F.when(C("pos") == end, C("code"))).alias("end"), F.max(F.when(C("pos") == stop, C("code"))).alias("stop"),
    )
    judged = tables.keep(judged.where(C("run_cov") > C("rest_cov")), "judged")
    among = tables.keep(spec.join(assembled, "code", "left_semi"), "among", merge=True)
    parts = []
    for side, forward in (("right", True), ("left", False)):
        on = reach(spec, k, max(1, edge - 1), tables, forward, f"on_{side}").select(C("code").alias("end"), C("steps").alias("end_steps"))
        ahead = reach(among, k, max(1, distance), tables, forward, f"known_{side}").select(C("code").alias("stop"), C("steps").alias("stop_steps"))
        # A walk of as many k-mers as are missing, the run's last one included; one step at least.
        met = judged.where(C("side") == side).join(on, "end", "left").join(ahead, "stop", "left")
        parts.append(met.where((F.coalesce("end_steps", F.lit(0)) < max(1, edge - 1)) & (C("stop_steps") >= F.greatest(F.lit(1), C("n_unknown") - 1))))
    return parts[0].union(parts[1]).select("read_id", "side", "n_unknown")
