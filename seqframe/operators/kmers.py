"""k-mer tables: counts, histograms, coverage along reads, pairs, sketches and the implicit graph."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.sequence import canonical, kmers
from ..tables import Tables


def kmer_rows(reads: DataFrame, k: int, id_col: str = "read_id", seq_col: str = "seq") -> DataFrame:
    """(read_id, pos, kmer): every k-mer of every read."""
    return codes.kmer_codes(reads, k, id_col, seq_col).select(id_col, "pos", "kmer")


def unnest(df: DataFrame, array: str, into: str) -> DataFrame:
    """A row for each element. Unlike a plain explode, this infers no filter on the array's size, for which the optimizer
    would write the array's expression into its own lambdas and evaluate it for every element."""
    return df.withColumn(into, F.explode_outer(array)).drop(array).where(F.col(into).isNotNull())


def code_spectrum(reads: DataFrame, k: int, stranded: bool = False, seq_col: str = "seq") -> DataFrame:
    """(code, cov): canonical (or stranded) k-mers as numbers and how often they come; k-mers with other letters than A, C, G,
    T and U are left out. Counts are partial before the shuffle, whose keys are numbers."""
    return codes.code_counts(reads, [k], stranded, seq_col).select("code", "cov")


def spectrum(reads: DataFrame, k: int, stranded: bool = False, seq_col: str = "seq") -> DataFrame:
    """(kmer, cov): the same with k-mers as strings."""
    return decoded(code_spectrum(reads, k, stranded, seq_col), k, code="kmer")


def decoded(df: DataFrame, k: int, **names: str) -> DataFrame:
    """Codes as k-mers: the columns named first, under the names given."""
    return df.select(*[codes.decode(F.col(c), k).alias(names[c]) if c in names else F.col(c) for c in df.columns])


def histogram(spec: DataFrame) -> DataFrame:
    """(multiplicity, n_kmers)."""
    return spec.groupBy(F.col("cov").alias("multiplicity")).agg(F.count(F.lit(1)).alias("n_kmers"))


def totals(spec: DataFrame) -> DataFrame:
    """One row: f1 (all k-mers), f0 (distinct), singletons and non_singletons."""
    once = F.sum(F.when(F.col("cov") == 1, 1).otherwise(0))
    return spec.agg(F.coalesce(F.sum("cov"), F.lit(0)).alias("f1"), F.count(F.lit(1)).alias("f0"), F.coalesce(once, F.lit(0)).alias("singletons"), (F.count(F.lit(1)) - F.coalesce(once, F.lit(0))).alias("non_singletons"))


def choose_k(reads: DataFrame, sizes: list[int]) -> DataFrame:
    """(k, f0, non_singletons, chosen): sizes are tried in order as long as the distinct k-mers seen twice or more increase;
    the last of these is chosen. All sizes are counted in one pass."""
    counts = codes.code_counts(reads, sizes)
    each = counts.groupBy("k").agg(F.count(F.lit(1)).alias("f0"), F.sum(F.when(F.col("cov") > 1, 1).otherwise(0)).alias("non_singletons"))
    order = Window.partitionBy(F.lit(0)).orderBy("k")  # a row for each size
    rising = each.withColumn("_up", (F.col("non_singletons") > F.coalesce(F.lag("non_singletons").over(order), F.lit(0))).cast("int"))
    kept = rising.withColumn("_all", F.min("_up").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return kept.select("k", "f0", "non_singletons", ((F.col("_all") == 1) & (F.coalesce(F.lead("_all").over(order), F.lit(0)) == 0)).alias("chosen"))


def with_coverage(rows: DataFrame, spec: DataFrame) -> DataFrame:
    """Adds ckmer and cov (0 if absent) to k-mer rows."""
    return rows.withColumn("ckmer", canonical(F.col("kmer"))).join(spec.select(F.col("kmer").alias("ckmer"), "cov"), "ckmer", "left").withColumn("cov", F.coalesce("cov", F.lit(0)))


def covered(reads: DataFrame, k: int, spec: DataFrame | None = None, stranded: bool = False, text: bool = True) -> DataFrame:
    """(read_id, pos, kmer, code, cov): every k-mer of every read with its coverage in `spec` (code, cov; the reads' own
    spectrum if not given), 0 if absent or not valid. Rows meet coverages by number; without `text`, no kmer."""
    spec = code_spectrum(reads, k, stranded) if spec is None else spec
    rows = codes.kmer_codes(reads, k, text=text).withColumn("code", F.col("code" if stranded else "ccode")).drop("ccode")
    return rows.join(spec.select("code", "cov"), "code", "left").withColumn("cov", F.coalesce("cov", F.lit(0)))


def coverage_arrays(cov: DataFrame) -> DataFrame:
    """(read_id, covs): coverages of each read in order."""
    return cov.groupBy("read_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "cov"))), lambda x: x["cov"]).alias("covs"))


def held_elsewhere(rows: DataFrame, keys: list[str], id_col: str = "read_id") -> DataFrame:
    """The distinct keys that two or more different reads hold: their least and greatest reads differ."""
    ends = rows.groupBy(*keys).agg(F.min(id_col).alias("_least"), F.max(id_col).alias("_most"))
    return ends.where(F.col("_least") != F.col("_most")).select(*keys)


def median(values: Column) -> Column:
    s = F.array_sort(values)
    n = F.size(values)
    half = F.floor(n / 2).cast("int")
    return F.when(n % 2 == 0, (F.get(s, half - 1) + F.get(s, half)) / 2).otherwise(F.get(s, half).cast("double"))


def dropoff(cov_rows: DataFrame, lookahead: int, gradient: float) -> DataFrame:
    """(read_id, dropoff) of (read_id, covs): from the lookahead-th largest coverage down, the last one before the first fall
    below gradient times it; 0 without one. Sorted once: s is a column by the time that the lambda reads it."""
    s = cov_rows.select("read_id", F.array_sort("covs").alias("s"))
    n = F.size("s")
    falls = F.filter(F.sequence(n - lookahead - 1, F.lit(0), F.lit(-1)), lambda i: F.get("s", i) < F.get("s", i + 1) * gradient)
    found = s.select("read_id", "s", F.when(n > lookahead, F.get(falls, F.lit(0))).alias("at"))
    return found.select("read_id", F.coalesce(F.get("s", F.col("at") + 1), F.lit(0)).alias("dropoff"))


def runs(flagged: DataFrame, flag: Column, keep: list[str] | None = None) -> DataFrame:
    """(read_id, start, end, n): maximal runs of positions where the flag holds; end included."""
    order = Window.partitionBy("read_id").orderBy("pos")
    held = flagged.where(flag).withColumn("_g", F.col("pos") - F.row_number().over(order))
    return held.groupBy("read_id", "_g").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count(F.lit(1)).alias("n")).drop("_g")


def trim_edges(cov_rows: DataFrame, least: int) -> DataFrame:
    """(read_id, from, to) of (read_id, covs) that are left after trimming ends up to two neighbouring k-mers of at least this
    coverage (the second of the first two at the start, as the walk stops there; both of the last two at the end); rows
    that nothing is trimmed from are left out, as are those that nothing is left of."""
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("covs") - 2))
    pairs = F.filter(places, lambda i: (F.get("covs", i) >= least) & (F.get("covs", i + 1) >= least))
    p = cov_rows.select("read_id", F.size("covs").alias("n"), pairs.alias("pairs"))
    p = p.select("read_id", "n", F.coalesce(F.array_min("pairs") + 1, F.lit(0)).alias("from"), F.array_max("pairs").alias("last"))
    p = p.withColumn("to", F.when(F.col("last") >= F.col("from"), F.col("last") + 2).otherwise(F.col("n")))
    changed = (F.col("from") > 0) | (F.col("to") < F.col("n"))
    return p.where(changed & (F.col("to") - F.col("from") > 1)).select("read_id", F.col("from").cast("long").alias("from"), F.col("to").cast("long").alias("to"))


def kmer_pairs(reads: DataFrame, k: int, distance: int) -> DataFrame:
    """Distinct pairs of k-mers `distance` apart; a pair and its reverse-complement mirror are one (the smaller)."""
    return decoded(codes.pair_codes(reads, k, distance).distinct(), k, left="left", right="right")


def minimizers(reads: DataFrame, k: int, w: int) -> DataFrame:
    """(read_id, minimizer): distinct minima of w neighbouring canonical k-mers of each read, in lexicographic order."""
    return decoded(codes.window_minima(reads, k, w), k, code="minimizer")


def bottom_sketch(seq: Column, k: int, s: int) -> Column:
    """The s smallest distinct canonical k-mers, by hash."""
    h = F.transform(F.array_distinct(F.transform(kmers(seq, k), canonical)), lambda x: F.struct(F.md5(x.cast("binary")).alias("h"), x.alias("kmer")))
    return F.transform(F.slice(F.array_sort(h), 1, s), lambda x: x["kmer"])


def neighbours(spec: DataFrame, k: int, forward: bool = True, least: int = 1) -> DataFrame:
    """(code, base, neighbour, cov): extensions of each stranded k-mer (code, cov) by one base (0 to 3) that are in the table
    themselves, at `least` that coverage."""
    base = F.explode(F.array(*[F.lit(b).cast("long") for b in range(4)])).alias("base")
    kept = F.col("code").bitwiseAND(F.lit((1 << (2 * k - 2)) - 1).cast("long"))
    made = F.shiftleft(kept, 2) + F.col("base") if forward else F.shiftright("code", 2) + F.shiftleft("base", 2 * k - 2)
    target = spec.where(F.col("cov") >= least).select(F.col("code").alias("neighbour"), F.col("cov"))
    return spec.select("code", base).withColumn("neighbour", made).join(target, "neighbour").select("code", "base", "neighbour", "cov")


def degrees(spec: DataFrame, k: int) -> DataFrame:
    """(code, n_in, n_out) of stranded k-mers: one join finds all edges, both counts come from it."""
    edges = neighbours(spec, k).select(F.col("code").alias("src"), F.col("neighbour").alias("dst"))
    ends = edges.select(F.col("src").alias("code"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select(F.col("dst"), F.lit(1), F.lit(0)))
    both = spec.select("code", F.lit(0).alias("i"), F.lit(0).alias("o")).union(ends)
    return both.groupBy("code").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def variants(spec: DataFrame, k: int, right: bool = True, least: int = 1) -> DataFrame:
    """(code, variant, cov): k-mers of the table that differ in the last (or first) base only."""
    stem = F.shiftright("code", 2) if right else F.col("code").bitwiseAND(F.lit((1 << (2 * k - 2)) - 1).cast("long"))
    a = spec.select("code", stem.alias("stem"))
    b = spec.where(F.col("cov") >= least).select(F.col("code").alias("variant"), stem.alias("stem"), "cov")
    return a.join(b, "stem").where(F.col("code") != F.col("variant")).select("code", "variant", "cov")


def united_sketch(reads: DataFrame, group: str, k: int, s: int) -> DataFrame:
    """(group, kmer): the s least distinct canonical k-mers of a group's reads by hash. Each read gives its s least ones; they
    are ranked in parts before groups are, so a group that holds most reads is no bottleneck."""
    each = unnest(reads.select(group, bottom_sketch(F.col("seq"), k, s).alias("l")), "l", "kmer").distinct()
    h = each.withColumn("h", F.md5(F.col("kmer").cast("binary"))).withColumn("part", F.pmod(F.xxhash64("kmer"), F.lit(64)))
    few = h.withColumn("r", F.row_number().over(Window.partitionBy(group, "part").orderBy("h"))).where(F.col("r") <= s)
    return few.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy("h"))).where(F.col("r") <= s).select(group, "kmer")


#: Keys of a sketch that three or two common k-mers may make; where they would be more, one common k-mer is a key.
TOGETHER = 300
#: Pairs that are counted at a time, at least, and into how many parts all pairs are divided at most.
SLICE, SLICES = 1 << 20, 32


def first_ones(sketches: DataFrame, least: int, together: int, tables: Tables) -> DataFrame:
    """(read_id, keys) of sketches (read_id, s): sketches that share `least` k-mers share a key, of `together` (1 to 3) k-mers. In one order of
    all k-mers, rare ones first, the first ones that both hold are followed by the others that they share, so keys are made of a
    sketch's first k-mers only."""
    each = sketches.select("read_id", F.size("s").alias("n"), F.explode("s").alias("kmer"))
    counts = each.groupBy("kmer").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > 1)
    rows = each.join(counts, "kmer").groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("many", "kmer"))).alias("l"), F.first("n").alias("n"))
    # K-mers of one sketch would come first; they make no pair.
    size = F.size("l") - least + together
    first = tables.keep(rows.where(F.size("l") >= least).select("read_id", F.transform(F.slice("l", F.lit(1), size), lambda x: x["kmer"]).alias("p")), "first")
    if together == 1:
        return first.select("read_id", F.transform("p", lambda x: F.xxhash64(x)).alias("keys"))
    rest = lambda i: F.slice("p", i + 2, F.size("p"))
    if together == 2:
        return first.select("read_id", F.flatten(F.transform("p", lambda x, i: F.transform(rest(i), lambda y: F.xxhash64(x, y)))).alias("keys"))
    three = F.transform("p", lambda x, i: F.flatten(F.transform(rest(i), lambda y, j: F.transform(rest(i + j + 1), lambda z: F.xxhash64(x, y, z)))))
    return first.select("read_id", F.flatten(three).alias("keys"))


def sketch_similarity(reads: DataFrame, k: int, s: int, least: int) -> DataFrame:
    """(a, b, shared, jaccard, containment): pairs of different sequences whose sketches of s k-mers share `least` (1 at least) or more. Copies
    are represented by their first read. Pairs that share a key of their first k-mers meet (prefix filtering) and are counted exactly."""
    tables = Tables(reads.sparkSession, "sketches")
    parts = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = reads.select("read_id", "seq").repartition(parts, "seq").groupBy("seq").agg(F.min("read_id").alias("read_id"))
    # Filtered behind the write: a filter before it would make each sketch a second time.
    sketches = tables.keep(first.select("read_id", bottom_sketch(F.col("seq"), k, s).alias("s")), "sketches").where(F.size("s") >= least)
    tables.tidy()
    ahead = s - least
    together = next((n for n in (3, 2) if least >= n and math.comb(ahead + n, n) <= TOGETHER), 1)
    keys = tables.keep(unnest(first_ones(sketches, least, together, tables), "keys", "key"), "keys")
    a, b = (keys.select("key", F.col("read_id").alias(x)) for x in "ab")
    met = tables.keep(a.join(b, "key").where(F.col("a") < F.col("b")).select("a", "b").distinct(), "met")
    tables.drop("first", "keys")
    tables.tidy()
    # Numbers take less than k-mers, and in buckets only one of each pair's sketches is moved.
    numbers = sketches.select("read_id", F.transform("s", number).alias("s")) if k <= 31 else sketches
    numbers = tables.keep_bucketed(numbers.repartition(parts, "read_id"), "numbers", "read_id")
    tables.tidy()
    side = lambda x: numbers.select(F.col("read_id").alias(x), F.col("s").alias(f"s{x}")).hint("merge")
    n, slices, out = F.col("shared"), max(1, min(SLICES, met.count() // SLICE)), None
    for i in range(slices):
        some = met.where(F.pmod(F.xxhash64("a"), F.lit(slices)) == i).join(side("a"), "a").join(side("b"), "b")
        now = some.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("shared"), F.size("sa").alias("na"), F.size("sb").alias("nb")).where(n >= least)
        now = tables.keep(now, f"counted/{i}")
        out = now if out is None else out.union(now)
        tables.tidy()
    tables.drop("met", "numbers", "sketches")
    return out.select("a", "b", "shared", (n / (F.col("na") + F.col("nb") - n)).alias("jaccard"), (n / F.col("nb")).alias("containment"))


def number(kmer: Column) -> Column:
    """A number for a k-mer of up to 31 bases: its code, or a negative hash of 63 bits where it has letters other than bases."""
    return F.when(F.translate(kmer, "ACGT", "") == "", codes.encode(kmer)).otherwise(F.xxhash64(kmer).bitwiseOR(F.shiftleft(F.lit(1).cast("long"), 63)))
