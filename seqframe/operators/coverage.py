"""Coverage of k-mers along reads, and of sequences by records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import quartiles
from .kmers import runs

C = F.col


def within(cov: DataFrame, start: int, end: int) -> DataFrame:
    """(read_id, n, min_cov, med_cov) over the k-mers from start to before end."""
    part = cov.where((C("pos") >= start) & (C("pos") < end))
    return part.groupBy("read_id").agg(F.count(F.lit(1)).alias("n"), F.min("cov").alias("min_cov"), F.median("cov").alias("med_cov"))


def longest_covered(cov: DataFrame, least: int) -> DataFrame:
    """(read_id, start, end, n): each read's longest run of k-mers of at least this coverage, the first of equal ones; end
    included. The reference never replaces its first run and overlooks the last one; this takes all runs alike."""
    found = runs(cov, C("cov") >= least)
    best = found.groupBy("read_id").agg(F.max(F.struct("n", (-C("start")).alias("m"), "end")).alias("x"))
    return best.select("read_id", (-C("x.m")).alias("start"), C("x.end").alias("end"), C("x.n").alias("n"))


def valid_sequences(cov: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """(read_id, start, seq): stretches of reads whose k-mers all have a coverage."""
    found = runs(cov, C("cov") > 0)
    return found.join(reads.select("read_id", "seq"), "read_id").select("read_id", "start", F.substring(C("seq"), (C("start") + 1).cast("int"), (C("n") + k - 1).cast("int")).alias("seq"))


def bounds(rows: DataFrame, name: str, length: str, start: str, end: str) -> DataFrame:
    """(name, length, min_start, max_end, fully_covered): how far the records of a sequence reach; fully if to within a base of
    both ends."""
    b = rows.groupBy(name, length).agg(F.min(start).alias("min_start"), F.max(end).alias("max_end"))
    return b.withColumn("fully_covered", (C("min_start") <= 1) & (C("max_end") >= C(length) - 1))


def bin_counts(rows: DataFrame, name: str, length: str, start: str, end: str, size: int, margin: int = 0) -> DataFrame:
    """(name, length, bin, n): records that cover bins of `size` bases. The first bin lies behind the start and the last one
    before the end, `margin` bins further in, but for records that reach the sequence's own ends."""
    bars = F.ceil(C(length) / size).cast("int")
    first = F.when(C(start) > 0, F.ceil(C(start) / size) + margin).otherwise(0).cast("int")
    last = F.when(C(end) < C(length), F.floor(C(end) / size) - margin).otherwise(bars).cast("int")
    each = rows.select(name, length, bars.alias("bars"), first.alias("a"), last.alias("z"))
    each = each.where((C("a") < C("z")) & (C("a") < C("bars")) & (C("z") > 0) & (C("z") <= C("bars")))
    each = each.groupBy(name, length, "a", "z").agg(F.count(F.lit(1)).alias("n"))
    return each.select(name, length, F.explode(F.sequence("a", C("z") - 1)).alias("bin"), "n").groupBy(name, length, "bin").agg(F.sum("n").alias("n"))


def islands(bins: DataFrame, name: str, length: str, size: int, least: int, shortest: int, widen: bool = False) -> DataFrame:
    """(name, start_pos, end_pos): runs of bins of at least this count, of at least floor(shortest / size) bins. With `widen`, a
    run that ends before the last bin gets a bin more on either side (not before the second bin, not behind the last one)."""
    bars = F.ceil(C(length) / size).cast("long")
    rows = bins.where(C("n") >= least).select(C(name).alias("read_id"), C("bin").cast("long").alias("pos"), length)
    found = runs(rows, F.lit(True)).join(rows.select("read_id", bars.alias("bars")).distinct(), "read_id")
    start, end = C("start"), C("end") + 1
    if widen:
        inner = end < C("bars")
        start = F.when(inner & (C("start") > 1), C("start") - 1).otherwise(C("start"))
        end = F.when(end <= C("bars") - 2, end + 1).otherwise(end)
    long = end - start >= shortest // size
    return found.where(long).select(C("read_id").alias(name), (start * size).alias("start_pos"), (end * size).alias("end_pos"))


def widened_to_bounds(found: DataFrame, reach: DataFrame, name: str, length: str, size: int) -> DataFrame:
    """Islands whose first and last ones reach out to what is observed (`bounds`) if they come within a bin of it."""
    ends = found.groupBy(name).agg(F.min("start_pos").alias("_first"), F.max("end_pos").alias("_last"))
    met = found.join(ends, name).join(reach.select(name, length, "min_start", "max_end"), name)
    start = F.when((C("start_pos") == C("_first")) & (C("start_pos") < C("min_start") + size), C("min_start")).otherwise(C("start_pos"))
    end = F.when(C("end_pos") != C("_last"), C("end_pos")).when(C("end_pos") > C(length), C(length)).when(C("end_pos") > C("max_end") - size, C("max_end")).otherwise(C("end_pos"))
    return met.select(name, start.cast("long").alias("start_pos"), end.cast("long").alias("end_pos"))


def solid(cov: DataFrame, least: int) -> DataFrame:
    """(read_id, n_solid, total_log): k-mers of at least this coverage, and the sum of their coverages' logarithms."""
    good = C("cov") >= least
    return cov.groupBy("read_id").agg(F.sum(good.cast("long")).alias("n_solid"), F.sum(F.when(good, F.ln("cov")).otherwise(0.0)).alias("total_log"))


def weak_split(cov: DataFrame, least: int, longest_gap: int, shortest: int) -> DataFrame:
    """(read_id, start, end): parts of reads between runs of longest_gap or more k-mers below this coverage, of at least
    `shortest` k-mers; end included."""
    strong = runs(cov, C("cov") >= least)
    order = Window.partitionBy("read_id").orderBy("start")
    cut = strong.withColumn("_new", F.when(C("start") - F.lag("end").over(order) - 1 < longest_gap, 0).otherwise(1))
    part = cut.withColumn("_k", F.sum("_new").over(order))
    return part.groupBy("read_id", "_k").agg(F.min("start").alias("start"), F.max("end").alias("end")).where(C("end") - C("start") + 1 >= shortest).drop("_k")


def length_quartiles(reads: DataFrame, group: str) -> DataFrame:
    """(group, bytes, min, q1, median, q3, max) of the column len. Lengths are counted before they are gathered: a group's list
    has an entry for each different length, as often as it comes."""
    lengths = reads.groupBy(group, "len").agg(F.count(F.lit(1)).alias("c"))
    listed = lengths.groupBy(group).agg(F.flatten(F.collect_list(F.array_repeat("len", C("c").cast("int")))).alias("l"), F.sum(C("len") * C("c")).alias("bytes"))
    return listed.select(group, "bytes", quartiles(C("l")).alias("q")).select(group, "bytes", "q.*")


def length_parameters(found: DataFrame, k: int, margin: int) -> DataFrame:
    """(pair_distance, tip_length, max_distance): what an assembly derives from quartiles of read lengths, weighed by bases and
    rounded half to even."""
    w = found.agg(*[F.rint(F.sum(C(c) * C("bytes")) / F.sum("bytes")).cast("long").alias(c) for c in ("q1", "median", "q3")])
    return w.select(F.greatest(F.lit(1), C("q1") - k - margin).cast("long").alias("pair_distance"), (C("median") - k).alias("tip_length"), (C("q3") + F.floor((C("q3") - C("q1")) * 3 / 2)).cast("long").alias("max_distance"))
