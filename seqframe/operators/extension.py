"""The k-mer graph walked: canonical neighbours, lookahead, depth, greedy and unambiguous extension, gaps between segments, and
correction of single bases. k-mers are codes; a stranded table is (code, cov), and steps are found by joins on numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bases import merge_overlapping
from ..functions.codes import MAX_K, check, decode, encode, kmer_codes, mirrored
from ..tables import Tables
from .kmers import covered, neighbours, runs
from .layout import walks
from .walking import walks_from

C = F.col


def canonical_neighbours(spec: DataFrame, k: int, forward: bool = True, least: int = 1) -> DataFrame:
    """(code, base, neighbour, cov): the same as neighbours for canonical k-mers, read in the direction that they are stored in;
    neighbours are looked up by their smaller strand."""
    base = F.explode(F.array(*[F.lit(b).cast("long") for b in range(4)])).alias("base")
    kept = C("code").bitwiseAND(F.lit((1 << (2 * k - 2)) - 1).cast("long"))
    made = F.shiftleft(kept, 2) + C("base") if forward else F.shiftright("code", 2) + F.shiftleft("base", 2 * k - 2)
    ext = spec.select("code", base).withColumn("made", made)
    target = spec.where(C("cov") >= least).select(C("code").alias("neighbour"), "cov")
    return ext.withColumn("neighbour", F.least("made", mirrored(C("made"), k))).join(target, "neighbour").select("code", "base", "neighbour", "cov")


def canonical_variants(spec: DataFrame, k: int, right: bool = True, least: int = 1) -> DataFrame:
    """(code, variant, cov): canonical k-mers that differ in the last (or first) base only, as stored."""
    shift = 0 if right else 2 * k - 2
    place = F.lit(3 << shift).cast("long")
    bases = F.explode(F.array(*[F.lit(b << shift).cast("long") for b in range(4)])).alias("b")
    ext = spec.select("code", bases).withColumn("made", C("code").bitwiseAND(F.bitwise_not(place)) + C("b")).where(C("made") != C("code"))
    target = spec.where(C("cov") >= least).select(C("code").alias("variant"), "cov")
    return ext.withColumn("variant", F.least("made", mirrored(C("made"), k))).join(target, "variant").select("code", "variant", "cov")


def within(steps: DataFrame, allowed: DataFrame) -> DataFrame:
    """Neighbours that a second table (code) allows."""
    return steps.join(allowed.select(C("code").alias("neighbour")), "neighbour", "left_semi")


def best_step(steps: DataFrame) -> DataFrame:
    """(code, best, cov): the neighbour of the greatest coverage; of equal ones, the greatest code."""
    return steps.groupBy("code").agg(F.max_by("neighbour", F.struct("cov", "neighbour")).alias("best"), F.max("cov").alias("cov"))


def lookahead(spec: DataFrame, k: int, depth: int, forward: bool = True) -> DataFrame:
    """(code, ahead): over all paths of `depth` k-mers from each one, itself included, the greatest least coverage; 0 where there
    is none. One join for each step, whatever the number of paths."""
    if depth < 1:
        raise ValueError("a path has one k-mer at least")
    steps = neighbours(spec, k, forward).select("code", "neighbour")
    now = spec.select("code", C("cov").alias("ahead"))
    for _ in range(depth - 1):
        on = steps.join(now.select(C("code").alias("neighbour"), "ahead"), "neighbour").groupBy("code").agg(F.max("ahead").alias("next"))
        now = spec.join(on, "code", "left").select("code", F.least("cov", F.coalesce("next", F.lit(0))).alias("ahead"))
    return now


def greedy_steps(spec: DataFrame, k: int, depth: int, forward: bool = True, allowed: DataFrame | None = None) -> DataFrame:
    """(vertex, next): from each k-mer to the neighbour with the best lookahead, then coverage, then the smaller code."""
    steps = neighbours(spec, k, forward)
    if allowed is not None:
        steps = within(steps, allowed)
    met = steps.join(lookahead(spec, k, depth, forward).withColumnRenamed("code", "neighbour"), "neighbour")
    return met.groupBy(C("code").alias("vertex")).agg(F.max_by("neighbour", F.struct("ahead", "cov", -C("neighbour"))).alias("next"))


def extended(spec: DataFrame, steps: DataFrame, bound: int) -> DataFrame:
    """(code, path): up to `bound` steps from every k-mer of the table, until one comes again; the k-mer itself first."""
    paths = walks(steps, bound).select(C("vertex").alias("code"), "path")
    return spec.select("code").join(paths, "code", "left").select("code", F.coalesce("path", F.array("code")).alias("path"))


def greedy_extension(spec: DataFrame, k: int, depth: int, bound: int, forward: bool = True) -> DataFrame:
    """(code, path): greedy steps from every k-mer."""
    return extended(spec, greedy_steps(spec, k, depth, forward), bound)


def dead_ends(spec: DataFrame, k: int, most: int, tables: Tables, forward: bool = True, name: str = "ends") -> DataFrame:
    """(code, steps): k-mers from which fewer than `most` steps lead on, and how many do. Neighbours are counted once; then each round takes the
    k-mers that have lost all of theirs, so it moves those that end and not those that go on."""
    parts = int(spec.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = neighbours(spec, k, forward).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    counts = tables.keep_bucketed(counts.repartition(parts, "code"), f"{name}_counts", "code")
    now = tables.keep(spec.join(counts, "code", "left_anti").select("code", F.lit(0).alias("steps")), f"{name}_0", merge=True)
    out, lost = now, None
    kept = C("code").bitwiseAND(F.lit((1 << (2 * k - 2)) - 1).cast("long"))
    base = F.explode(F.array(*[F.lit(b).cast("long") for b in range(4)])).alias("base")
    for i in range(1, most):
        if not now.take(1):
            break
        before = F.shiftright("code", 2) + F.shiftleft("base", 2 * k - 2) if forward else F.shiftleft(kept, 2) + C("base")
        new = now.select("code", base).select(before.alias("code"), F.lit(1).cast("long").alias("lost"))
        new = new if lost is None else new.union(lost)
        summed = counts.join(new.groupBy("code").agg(F.sum("lost").alias("lost")), "code")
        met = tables.keep(summed, f"{name}_lost{i}", merge=True)
        now, lost = met.where(C("lost") == C("n")).select("code", F.lit(i).alias("steps")), met.where(C("lost") < C("n")).select("code", "lost")
        out = out.union(now)
    return out


def with_depth(spec: DataFrame, k: int, depth: int, forward: bool = True) -> DataFrame:
    """(code): k-mers from which a walk of `depth` k-mers goes, themselves included."""
    if depth <= 1:
        return spec.select("code")
    tables = Tables(spec.sparkSession, "depth")
    spec = tables.keep(spec.select("code", "cov"), "spec", merge=True)
    return spec.select("code").join(dead_ends(spec, k, depth - 1, tables, forward).select("code"), "code", "left_anti")


def plain_steps(spec: DataFrame, k: int, tip: int) -> DataFrame:
    """(vertex, next): unambiguous steps: the only neighbour, which no other k-mer leads to but tips, from which fewer than
    `tip` k-mers go on backward."""
    edges = neighbours(spec, k).select(C("code").alias("vertex"), C("neighbour").alias("next"))
    one = edges.groupBy("vertex").agg(F.count(F.lit(1)).alias("n"), F.first("next").alias("next")).where(C("n") == 1).drop("n")
    deep = with_depth(spec, k, tip, forward=False).select(C("code").alias("vertex"), F.lit(1).alias("deep"))
    back = edges.join(deep, "vertex").groupBy("next").agg(F.count(F.lit(1)).alias("n_deep"))
    own = one.join(deep, "vertex", "left").join(back, "next", "left")
    return own.where(F.coalesce("n_deep", F.lit(0)) - F.coalesce("deep", F.lit(0)) == 0).select("vertex", "next")


def branching(reads: DataFrame, spec: DataFrame, k: int, tip: int) -> DataFrame:
    """(read_id, n_branches, branch_free): k-mers of a read from whose place another one than the next goes on to the right (or
    comes from the left) over `tip` k-mers or more."""
    rows = kmer_codes(reads, k, text=False).select("read_id", "pos", "code")
    out = None
    for right in (True, False):
        stem = F.shiftright("code", 2) if right else C("code").bitwiseAND(F.lit((1 << (2 * k - 2)) - 1).cast("long"))
        deep = with_depth(spec, k, tip, forward=right).select(stem.alias("stem"), C("code").alias("variant"))
        # Two deep k-mers of one stem tell that each has another one: least and greatest differ.
        ends = deep.groupBy("stem").agg(F.min("variant").alias("least"), F.max("variant").alias("most"))
        met = rows.withColumn("stem", stem).join(ends, "stem").where((C("least") != C("code")) | (C("most") != C("code"))).select("read_id", "pos")
        out = met if out is None else out.union(met)
    n = out.groupBy("read_id").agg(F.count(F.lit(1)).alias("n_branches"))
    every = rows.select("read_id").distinct()
    return every.join(n, "read_id", "left").select("read_id", F.coalesce("n_branches", F.lit(0).cast("long")).alias("n_branches"), C("n_branches").isNull().alias("branch_free"))


def connect(ends: DataFrame, spec: DataFrame, k: int, depth: int, bound: int) -> DataFrame:
    """ends (id, left, right) are sequences of at least k bases. Adds `between`: the bases that lead from the last k-mer of the
    left one to the first k-mer of the right one by greedy steps, at most `bound` of them; null if they don't. Only ends are walked from. The joined
    sequence is left + between + the right one behind its first k-mer."""
    check(k)
    tables = Tables(ends.sparkSession, "connect")
    spec = tables.keep(spec.select("code", "cov"), "spec", merge=True)
    met = ends.withColumn("_code", encode(F.right("left", F.lit(k)))).withColumn("_to", encode(F.left("right", F.lit(k))))
    starts = met.select(C("_code").alias("id"), C("_code").alias("code")).where(C("code").isNotNull()).distinct()
    paths = walks_from(starts, greedy_steps(spec, k, depth), bound, tables)
    met = met.join(paths.select(C("id").alias("_code"), C("path").alias("_path")), "_code", "left")
    n = F.array_position("_path", C("_to"))
    last = lambda c: F.substring(F.lit("ACGT"), c.bitwiseAND(F.lit(3).cast("long")).cast("int") + 1, F.lit(1))
    bases = F.array_join(F.transform(F.slice("_path", F.lit(2), F.greatest(F.lit(0), n.cast("int") - 1)), last), "")
    return met.withColumn("between", F.when(n > 0, bases)).drop("_code", "_to", "_path")


def join_mates(pairs: DataFrame, spec: DataFrame, k: int, least: int, depth: int, bound: int) -> DataFrame:
    """pairs (id, left, right). Adds `seq`, the fragment, and `how`: 'overlap' where the mates overlap by `least` bases or more,
    'path' where greedy steps connect them, else null (both mates stay apart)."""
    met = connect(pairs, spec, k, depth, bound)
    over = merge_overlapping(C("left"), C("right"), least)
    path = F.concat("left", "between", F.substring(C("right"), F.lit(k + 1), F.length("right")))
    return met.select("*", F.coalesce(over, path).alias("seq"), F.when(over.isNotNull(), "overlap").when(path.isNotNull(), "path").alias("how")).drop("between")


def correct_mismatches(reads: DataFrame, spec: DataFrame, k: int, least: int) -> DataFrame:
    """(read_id, seq, n_corrected): a run of exactly k weak k-mers (coverage below `least`) inside a read is one wrong base: it
    becomes the base that makes all of them solid, the best-covered one (then the first). spec holds canonical k-mers."""
    tables = Tables(reads.sparkSession, "correct")
    cov = covered(reads, k, spec, text=False)
    size = cov.groupBy("read_id").agg(F.max("pos").alias("last"))
    weak = runs(cov, C("cov") < least).where((C("n") == k) & (C("start") > 0)).join(size, "read_id").where(C("end") < C("last"))
    at = weak.select("read_id", C("end").cast("int").alias("at")).join(reads.select("read_id", "seq"), "read_id")
    around = at.select("read_id", "at", F.substring(C("seq"), C("at") - (k - 2), F.lit(k - 1)).alias("l"), F.substring(C("seq"), C("at") + 1, F.lit(1)).alias("b"), F.substring(C("seq"), C("at") + 2, F.lit(k - 1)).alias("r"))
    tried = around.select("read_id", "at", F.explode(F.array(*[F.lit(x) for x in "ACGT"])).alias("new"), "l", "b", "r").where(C("new") != C("b"))
    whole = tables.keep(tried.select(F.concat_ws(":", "read_id", "at", "new").alias("key"), "read_id", "at", "new", F.concat("l", "new", "r").alias("seq")), "tried")
    solid = covered(whole.select(C("key").alias("read_id"), "seq"), k, spec, text=False).groupBy("read_id").agg(F.min("cov").alias("score")).where(C("score") >= least)
    best = whole.join(solid.select(C("read_id").alias("key"), "score"), "key").groupBy("read_id", "at").agg(F.max_by("new", F.struct("score", -F.ascii("new"))).alias("new"))
    fixes = best.groupBy("read_id").agg(F.collect_list(F.struct("at", "new")).alias("fixes"))
    changed = F.aggregate("fixes", C("seq"), lambda s, f: F.overlay(s, f["new"], f["at"] + 1, F.lit(1)))
    return reads.join(fixes, "read_id").select("read_id", changed.alias("seq"), F.size("fixes").alias("n_corrected"))


def spelled(paths: DataFrame, k: int) -> DataFrame:
    """(code, seq): paths of codes as sequences."""
    if k > MAX_K:
        raise ValueError("k is too large")
    last = lambda c: F.substring(F.lit("ACGT"), c.bitwiseAND(F.lit(3).cast("long")).cast("int") + 1, F.lit(1))
    tail = F.array_join(F.transform(F.slice("path", F.lit(2), F.greatest(F.lit(0), F.size("path") - 1)), last), "")
    return paths.select("code", F.concat(decode(F.get("path", F.lit(0)), k), tail).alias("seq"))
