"""Correction of reads with wrong, inserted and deleted bases by walks through the k-mer graph between their solid k-mers.

A run of weak k-mers between two solid ones is replaced by the walk that leads from one to the other along the best-covered
steps, if that is about as long and spells nearly the same. Walks start at such solid k-mers only, from the left, and from the right
where the left one doesn't arrive; where neither does, they may meet. Weak ends are replaced by the walk outward from the
last solid k-mer if that is better covered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import decode, encode, kmer_codes, mirrored
from ..tables import Tables
from .extension import best_step
from .kmers import coverage_arrays, neighbours
from .walking import median_of, walks_from

C = F.col


def last_base(code: Column) -> Column:
    return F.substring(F.lit("ACGT"), code.bitwiseAND(F.lit(3).cast("long")).cast("int") + 1, F.lit(1))


def first_base(code: Column, k: int) -> Column:
    return F.substring(F.lit("ACGT"), F.shiftrightunsigned(code, 2 * k - 2).bitwiseAND(F.lit(3).cast("long")).cast("int") + 1, F.lit(1))


def both_strands(spec: DataFrame, k: int) -> DataFrame:
    """(code, cov) of canonical k-mers as a table of both strands."""
    return spec.select("code", "cov").union(spec.select(mirrored(C("code"), k), "cov")).distinct()


def coverages(reads: DataFrame, spec: DataFrame, k: int, tables: Tables) -> DataFrame:
    """(read_id, covs): the coverages of each read's k-mers in order, 0 where a k-mer isn't known; reads without a k-mer have none. The
    k-mers of the reads are moved once, and what follows needs their coverages only."""
    rows = kmer_codes(reads.select("read_id", "seq"), k, text=False).select("read_id", C("pos").cast("int").alias("pos"), "code")
    known = rows.join(spec.select("code", "cov"), "code", "left").select("read_id", "pos", F.coalesce("cov", F.lit(0)).alias("cov"))
    # Written between its two shuffles, so that only one of them is on disk at a time.
    known = tables.keep(known, "known")
    tables.tidy()
    kept = tables.keep(coverage_arrays(known.repartition("read_id")), "coverages", merge=True)
    tables.drop("known")
    tables.tidy()
    return kept


def weak_runs(covs: DataFrame) -> DataFrame:
    """(read_id, a, z, covs) of rows (read_id, covs, least): runs of k-mers below their threshold from a to z, and their coverages. A read
    is one row, or one for each of its windows, which then begin at the place `begin`. Only weak k-mers are moved."""
    begin = C("begin") if "begin" in covs.columns else F.lit(0)
    weak = covs.select("read_id", "least", begin.alias("begin"), F.posexplode("covs").alias("pos", "cov")).where(C("cov") < C("least")).select("read_id", (C("begin") + C("pos")).alias("pos"), "cov")
    order = Window.partitionBy("read_id").orderBy("pos")
    grouped = weak.withColumn("_g", C("pos") - F.row_number().over(order)).groupBy("read_id", "_g")
    return grouped.agg(F.min("pos").alias("a"), F.max("pos").alias("z"), F.collect_list("cov").alias("covs")).drop("_g")


def between(left: Column, right: Column) -> Column:
    """The k-mers between two: of the walk from `left` (an array that begins there) if it comes to the first of the array `right`, of
    the backward walk `right` if that comes to the first of `left`, else of both up to the first k-mer of the backward walk that the other
    one holds; null if they don't meet."""
    l, r = F.get(left, F.lit(0)), F.get(right, F.lit(0))
    at = F.array_position(left, r).cast("int")
    back = F.array_position(right, l).cast("int")
    meet = F.get(F.filter(right, lambda x: F.array_contains(left, x)), F.lit(0))
    i, j = F.array_position(left, meet).cast("int"), F.array_position(right, meet).cast("int")
    joined = F.concat(F.slice(left, F.lit(2), i - 1), F.reverse(F.slice(right, F.lit(2), F.greatest(F.lit(0), j - 2))))
    return F.when(at > 1, F.slice(left, F.lit(2), F.greatest(F.lit(0), at - 2))).when(back > 1, F.reverse(F.slice(right, F.lit(2), F.greatest(F.lit(0), back - 2)))).when(meet.isNotNull(), joined)


def alike(a: Column, b: Column, least: float) -> Column:
    """Two sequences' edit distance is at most the rest of this share of the longer one."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)) >= least


def correct(reads: DataFrame, spec: DataFrame, k: int, floor: int, indel: int = 1, identity: float = 0.9, most: int = 100, least: int | None = None, covs: DataFrame | None = None, better: float = 0) -> DataFrame:
    """(read_id, seq, n_fixed) of the reads (read_id, seq, and `least` if that is None: the coverage of a solid k-mer of the read) that change.
    spec is a table of both strands; steps lead to k-mers of coverage `floor` or more. A replacement has at most `indel` k-mers
    more or fewer than the run, or exactly as many at an end; runs of more than `most` k-mers stay. Spelled with the solid
    k-mers around, it and the run are alike by `identity`. Reads with letters other than bases keep what is around these. covs: the
    reads' coverages where they are known already, in windows with a `least` of their own if they have that column. With `better`, a
    run between solid k-mers is only replaced by k-mers of so many times its median coverage, unless one of its own isn't known at all.
    A read of weak k-mers only stays."""
    tables = Tables(reads.sparkSession, "correction")
    spec = tables.keep(spec.select("code", "cov"), "spec", merge=True)
    covs = coverages(reads, spec, k, tables) if covs is None else covs
    if least is not None:
        covs = covs.withColumn("least", F.lit(least))
    elif "least" not in covs.columns:
        covs = covs.join(reads.select("read_id", "least"), "read_id")
    runs = weak_runs(covs).where(C("z") - C("a") < most).join(reads.select("read_id", "seq"), "read_id")
    # The solid k-mers around a run; null at an end.
    before = F.when(C("a") > 0, encode(F.upper(F.substring(C("seq"), C("a"), F.lit(k)))))
    after = F.when(C("z") < F.length("seq") - k, encode(F.upper(F.substring(C("seq"), C("z") + 2, F.lit(k)))))
    runs = runs.select("*", before.alias("left"), after.alias("right")).where(C("left").isNotNull() | C("right").isNotNull())
    runs = tables.keep(runs, "runs", merge=True)
    tables.tidy()
    walks = []
    for side, forward in (("left", True), ("right", False)):
        steps = best_step(neighbours(spec, k, forward, floor)).select(C("code").alias("vertex"), C("best").alias("next"))
        starts = runs.select(C(side).alias("id"), C(side).alias("code")).where(C("id").isNotNull()).distinct()
        walks.append(tables.keep(walks_from(starts, steps, most + indel + 1, tables, f"{side}_jumps").select(C("id").alias(side), C("path").alias(f"{side}_path")), f"{side}_walks", merge=True))
        tables.drop(f"{side}_jumps_rows0")
        tables.tidy()
    met = runs.join(walks[0], "left", "left").join(walks[1], "right", "left")
    n = C("z") - C("a") + 1
    inner = C("left").isNotNull() & C("right").isNotNull()
    outward = lambda path: F.when(F.size(path) > n, F.slice(path, F.lit(2), n.cast("int")))
    found = F.when(inner, between(C("left_path"), C("right_path"))).when(C("left").isNotNull(), outward(C("left_path"))).otherwise(F.reverse(outward(C("right_path"))))
    met = met.select("*", found.alias("made")).where(C("made").isNotNull() & (F.abs(F.size("made") - n) <= F.when(inner, indel).otherwise(0)))
    # Written here: what follows names `made` many times, and the planner would spell its expressions out each time.
    met = tables.keep(met.drop("left_path", "right_path"), "made", merge=True)
    spelled = F.array_join(F.transform("made", last_base), "")
    # Bases that are replaced: those behind the left solid k-mer up to the end of the right one; at an end, those outside the solid one.
    start = F.when(C("left").isNull(), 0).otherwise(C("a") - 1 + k)
    end = F.when(C("left").isNull(), C("z") + 1).when(C("right").isNull(), F.length("seq")).otherwise(C("z") + 1 + k)
    new = F.when(C("left").isNull(), F.array_join(F.transform("made", lambda c: first_base(c, k)), "")).when(C("right").isNull(), spelled).otherwise(F.concat(spelled, last_base(C("right"))))
    met = met.select("*", start.cast("int").alias("from"), end.cast("int").alias("to"), new.alias("new"))
    old = F.substring(C("seq"), C("from") + 1, C("to") - C("from"))
    around = lambda x: F.concat(F.when(C("left").isNull(), "").otherwise(decode(C("left"), k)), x)
    good = met.where((C("new") != old) & alike(around(old), around(C("new")), identity))
    # Ends are changed only for what is better covered.
    tested = good if better else good.where(~inner)
    key = ["read_id", "a"]
    found = tested.select(*key, "covs", inner.alias("inner"), F.explode("made").alias("code")).join(spec, "code").groupBy(*key).agg(F.collect_list("cov").alias("new_covs"), F.first("covs").alias("covs"), F.first("inner").alias("inner"))
    new, own = median_of(C("new_covs")), median_of(C("covs"))
    found = found.where(F.when(C("inner"), (new >= better * own) | (F.array_min("covs") == 0)).otherwise(new > own)).select(*key)
    fine = tested.join(found, key, "left_semi")
    fixes = (fine if better else good.where(inner).unionByName(fine)).groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("from", "to", "new"))).alias("fixes"), F.first("seq").alias("seq"))
    step = lambda a, f: F.struct(F.concat(a["out"], F.substring(a["seq"], a["at"] + 1, f["from"] - a["at"]), f["new"]).alias("out"), f["to"].alias("at"), a["seq"].alias("seq"))
    whole = F.aggregate("fixes", F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), C("seq").alias("seq")), step, lambda a: F.concat(a["out"], F.substring(a["seq"], a["at"] + 1, F.length(a["seq"]))))
    return fixes.select("read_id", whole.alias("seq"), F.size("fixes").alias("n_fixed"))


def fall(s: Column, gradient: float, spare: float) -> Column:
    """Of an ascending array, from the greatest coverage down, without the share `spare` of greatest ones, the last one before the first fall
    to less than `gradient` times it; null without such a fall."""
    top = F.size(s) - 1 - F.floor(F.size(s) * spare + 0.5).cast("int")
    falls = F.filter(F.when(top > 0, F.sequence(top - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>")), lambda i: F.get(s, i + 1) * gradient > F.get(s, i))
    return F.get(s, F.get(falls, F.lit(0)) + 1)


def thresholds(cov: DataFrame, gradient: float, spare: float) -> DataFrame:
    """(read_id, least) of rows (read_id, cov); reads without a fall have none."""
    return falls_of(cov.groupBy("read_id").agg(F.collect_list("cov").alias("covs")), gradient, spare)


def falls_of(covs: DataFrame, gradient: float, spare: float) -> DataFrame:
    """(read_id, least) of rows (read_id, covs). Exploded, a sorted array is a column that the optimizer can't write into the lambda, where it
    would be sorted for every element."""
    s = covs.select("read_id", F.explode(F.array(F.array_sort("covs"))).alias("s"))
    return s.select("read_id", fall(C("s"), gradient, spare).alias("least")).where(C("least").isNotNull())


def correct_reads(reads: DataFrame, spec: DataFrame, k: int, floor: int, gradient: float = 0.5, spare: float = 0.0, **limits) -> DataFrame:
    """(read_id, seq, n_fixed) of single reads that change; each has its own threshold."""
    tables = Tables(reads.sparkSession, "reads")
    covs = coverages(reads, spec, k, tables)
    own = reads.select("read_id", "seq").join(falls_of(covs, gradient, spare), "read_id")
    return correct(own, spec, k, floor, covs=covs, **limits)


def correct_pairs(pairs: DataFrame, spec: DataFrame, k: int, floor: int, gradient: float = 0.5, spare: float = 0.0, **limits) -> DataFrame:
    """(name, left, right) of mates (name, left, right): both are corrected by the lesser of their thresholds; mates of which neither has
    one stay as they are."""
    tables = Tables(pairs.sparkSession, "pairs")
    mate = lambda c, i: F.struct(C(c).alias("seq"), F.lit(i).alias("mate"))
    reads = tables.keep(pairs.select("name", F.inline(F.array(mate("left", 1), mate("right", 2)))).select(F.struct("name", "mate").alias("read_id"), "name", "seq"), "reads", merge=True)
    covs = coverages(reads, spec, k, tables)
    both = falls_of(covs, gradient, spare).groupBy(C("read_id.name").alias("name")).agg(F.min("least").alias("least"))
    fixed = tables.keep(correct(reads.join(both, "name").select("read_id", "seq", "least"), spec, k, floor, covs=covs, **limits), "fixed", merge=True)
    side = lambda i, c: fixed.where(C("read_id.mate") == i).select(C("read_id.name").alias("name"), C("seq").alias(c))
    met = pairs.join(side(1, "_left"), "name", "left").join(side(2, "_right"), "name", "left")
    return met.select("name", F.coalesce("_left", "left").alias("left"), F.coalesce("_right", "right").alias("right"))


def windows_of(covs: DataFrame, window: int, floor: int, gradient: float, spare: float, shifted: bool) -> DataFrame:
    """(read_id, begin, covs, least) of rows (read_id, covs): windows of so many k-mers and their thresholds, which are their falls, the floor
    at least; without a fall their medians. A rest of half a window or less belongs to the last one. The first window of
    `shifted` ones is half a window longer, so that the others begin elsewhere."""
    n, half = F.size("covs"), window // 2
    first = window + half if shifted else window
    more = F.when(n > first + half, F.sequence(F.lit(first), n - half - 1, F.lit(window))).otherwise(F.array().cast("array<int>"))
    rows = covs.where(n > 0).select("read_id", "covs", F.concat(F.array(F.lit(0)), more, F.array(n)).alias("_at"))
    rows = rows.select("read_id", "covs", F.explode(F.arrays_zip(F.slice("_at", 1, F.size("_at") - 1).alias("a"), F.slice("_at", 2, F.size("_at")).alias("z"))).alias("w"))
    rows = rows.select("read_id", C("w.a").alias("begin"), F.slice("covs", C("w.a") + 1, C("w.z") - C("w.a")).alias("covs"))
    # Exploded for the same reason as in falls_of.
    s = rows.select("read_id", "begin", "covs", F.explode(F.array(F.array_sort("covs"))).alias("s"))
    fallen = fall(C("s"), gradient, spare)
    return s.select("read_id", "begin", "covs", F.when(fallen.isNotNull(), F.greatest(fallen, F.lit(floor))).otherwise(median_of(C("s"))).cast("double").alias("least"))


def correct_long(reads: DataFrame, spec: DataFrame, k: int, floor: int, window: int, gradient: float = 0.5, spare: float = 0.0, rounds: int = 2, better: float = 2, **limits) -> DataFrame:
    """(read_id, seq, n_fixed) of long reads that change: each k-mer is judged by the threshold of its window of so many k-mers, since coverage
    changes along a long read. Where a window has no fall, half of it lies below its median: only what is `better` times as well
    covered replaces a run. Reads that change go through another round, with windows that begin elsewhere, `rounds` in all;
    n_fixed counts what all of them replaced."""
    now, out = reads.select("read_id", "seq"), None
    for i in range(rounds):
        tables = Tables(reads.sparkSession, f"long_reads{i}")
        each = windows_of(coverages(now, spec, k, tables), window, floor, gradient, spare, i % 2 == 1)
        fixed = tables.keep(correct(now, spec, k, floor, covs=each, better=better, **limits), "fixed", merge=True)
        if out is None:
            out = fixed
        else:
            again = fixed.select("read_id", C("seq").alias("_seq"), C("n_fixed").alias("_n"))
            out = out.join(again, "read_id", "left").select("read_id", F.coalesce("_seq", "seq").alias("seq"), (C("n_fixed") + F.coalesce("_n", F.lit(0))).alias("n_fixed"))
        now = fixed.select("read_id", "seq")
        if not now.take(1):
            break
    return out
