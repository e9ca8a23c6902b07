"""Column expressions over bases: runs, strands, packing, tails, strata and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import PAS_MOTIFS, count_of, reverse_complement

# Names of coverage strata, from the lowest up.
STRATA = ["01", "e0", "e1", "e2", "e3", "e4", "e5"]


def is_homopolymer(seq: Column) -> Column:
    """Whether a sequence is one base over and over; false if empty."""
    return (F.length(seq) > 0) & (F.replace(seq, F.substring(seq, F.lit(1), F.lit(1)), F.lit("")) == "")


def has_homopolymer(seq: Column, n: int) -> Column:
    """Whether a run of n or more equal bases occurs."""
    return F.regexp_like(seq, F.lit(f"A{{{n},}}|C{{{n},}}|G{{{n},}}|T{{{n},}}"))


def invalid_within(seq: Column, start: Column, end: Column) -> Column:
    """Whether a letter other than ACGTU, in either case, occurs from start (zero-based) to before end."""
    return F.regexp_like(F.substring(seq, start + 1, end - start), F.lit("[^ACGTUacgtu]"))


def is_reverse_complement(a: Column, b: Column) -> Column:
    return b == reverse_complement(a)


def tail_or_head(seq: Column, n: int) -> Column:
    """Whether n or more T begin the sequence, or n or more A end it."""
    return F.regexp_like(seq, F.lit(f"^T{{{n},}}|A{{{n},}}$"))


def is_rich(seq: Column, base: str, start: Column, end: Column, fraction: float) -> Column:
    """Whether at least the rounded fraction of the places from start to before end hold the base."""
    part = F.substring(seq, start + 1, end - start)
    return count_of(part, base) >= F.floor(fraction * (end - start) + 0.5)


def is_double_tailed(seq: Column, n: int, fraction: float) -> Column:
    """T-rich in the first n bases and A-rich in the last n."""
    size = F.length(seq)
    both = is_rich(seq, "T", F.lit(0), F.lit(n), fraction) & is_rich(seq, "A", size - n, size, fraction)
    return (size >= n) & both


def two_base_content(seq: Column) -> Column:
    """The greatest number of places that two different bases hold together."""
    n = {b: count_of(seq, b) for b in "ACGT"}
    return F.greatest(*[n[a] + n[b] for i, a in enumerate("ACGT") for b in "ACGT"[i + 1 :]])


def is_two_based(seq: Column, fraction: float) -> Column:
    return (F.length(seq) > 0) & (two_base_content(seq) >= fraction * F.length(seq))


def alternatives(base: Column) -> Column:
    """The other three bases; U counts as T; all four for anything else."""
    return F.array_except(F.array(*[F.lit(b) for b in "ACGT"]), F.array(F.translate(base, "U", "T")))


def shift_right(kmer: Column, base: Column) -> Column:
    """The k-mer without its last base, behind a new first one."""
    return F.concat(base, F.substring(kmer, F.lit(1), F.length(kmer) - 1))


def shift_left(kmer: Column, base: Column) -> Column:
    """The k-mer without its first base, before a new last one."""
    return F.concat(F.substring(kmer, F.lit(2), F.length(kmer) - 1), base)


def head_and_tail(seq: Column, n: int) -> Column:
    return F.concat(F.left(seq, F.lit(n)), F.lit("..."), F.right(seq, F.lit(n)))


def length_of(n_kmers: Column, k: int) -> Column:
    """Bases of a sequence of so many k-mers."""
    return n_kmers + (k - 1)


def pack(seq: Column) -> Column:
    """Two bits a base, four bases a byte from the high bits down, the last byte filled with A. Only for A, C, G and T; store
    the length beside it."""
    filled = F.concat(F.translate(seq, "ACGT", "0123"), F.repeat(F.lit("0"), F.pmod(-F.length(seq), F.lit(4)).cast("int")))
    # A base pair is a hexadecimal digit.
    pairs = {f"{a}{b}": f"{4 * a + b:X}" for a in range(4) for b in range(4)}
    digits = F.regexp_extract_all(filled, F.lit("(..)"), F.lit(1))
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.unhex(F.array_join(F.transform(digits, lambda d: F.element_at(table, d)), ""))


def unpack(data: Column, length: Column) -> Column:
    digits = F.regexp_extract_all(F.hex(data), F.lit("(.)"), F.lit(1))
    table = F.create_map(*[F.lit(x) for v in range(16) for x in (f"{v:X}", "ACGT"[v // 4] + "ACGT"[v % 4])])
    return F.substring(F.array_join(F.transform(digits, lambda d: F.element_at(table, d)), ""), F.lit(1), length)


def unpack_range(data: Column, start: Column, end: Column, reverse: bool = False) -> Column:
    """Bases from start to before end; reverse-complemented if asked."""
    part = F.substring(unpack(data, end), start + 1, end - start)
    return reverse_complement(part) if reverse else part


def is_stratum(name: Column) -> Column:
    return name.isin(STRATA)


def stratum_index(name: Column) -> Column:
    """0 for the lowest stratum; -1 for other names."""
    return F.array_position(F.array(*[F.lit(s) for s in STRATA]), name).cast("int") - 1


def is_lower_stratum(a: Column, b: Column) -> Column:
    return stratum_index(a) < stratum_index(b)


def length_stratum(length: Column, q1: Column, median: Column, q3: Column) -> Column:
    """0 to 3, by the quartile that a length lies in."""
    return F.when(length <= q1, 0).when(length <= median, 1).when(length <= q3, 2).otherwise(3)


def percent(fraction: Column) -> Column:
    """A percentage of three significant figures."""
    from .sequence import significant

    return significant(fraction * 100, 3)


def contains_interval(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Whether one of two intervals lies in the other."""
    return ((s1 >= s2) & (e1 <= e2)) | ((s2 >= s1) & (e2 <= e1))


def forward_dovetail(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Whether the first begins and ends before the second, and they overlap."""
    return (s1 < s2) & (e1 < e2) & (e1 > s2)


def any_dovetail(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return forward_dovetail(s1, e1, s2, e2) | forward_dovetail(s2, e2, s1, e1)


def signal_upstream(seq: Column, cleavage: Column, farthest: int = 60, nearest: int = 5) -> Column:
    """Whether a poly-A signal lies between `farthest` and `nearest` bases before the cleavage place."""
    start = F.greatest(F.lit(0), cleavage - farthest)
    return F.regexp_like(F.substring(seq, start + 1, F.greatest(F.lit(0), cleavage - nearest - start)), F.lit("|".join(PAS_MOTIFS)))


def signal_downstream(seq: Column, cleavage: Column, farthest: int = 60, nearest: int = 5) -> Column:
    """The same on the other strand: reverse-complemented signals after the place."""
    flipped = "|".join(m[::-1].translate(str.maketrans("ACGT", "TGCA")) for m in PAS_MOTIFS)
    return F.regexp_like(F.substring(seq, cleavage + nearest + 1, F.lit(farthest - nearest)), F.lit(flipped))


def longest_overlap(left: Column, right: Column, least: int) -> Column:
    """The greatest number of bases, at least `least`, that end the left and begin the right sequence; null without one."""
    most = F.least(F.length(left), F.length(right))
    sizes = F.when(most >= least, F.sequence(most, F.lit(least), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.get(F.filter(sizes, lambda n: F.right(left, n) == F.left(right, n)), F.lit(0))


def shortest_overlap(left: Column, right: Column, least: int) -> Column:
    most = F.least(F.length(left), F.length(right))
    sizes = F.when(most >= least, F.sequence(F.lit(least), most)).otherwise(F.array().cast("array<int>"))
    return F.get(F.filter(sizes, lambda n: F.right(left, n) == F.left(right, n)), F.lit(0))


def merge_overlapping(left: Column, right: Column, least: int) -> Column:
    """Both sequences in one by their longest overlap; the longer one if it contains the other; null if they don't meet."""
    n = longest_overlap(left, right, least)
    inside = F.when(F.contains(left, right), left).when(F.contains(right, left), right)
    return F.coalesce(inside, F.concat(left, F.substring(right, n + 1, F.length(right))))


def distinct_fraction_below(kmers: Column, fraction: float) -> Column:
    """Whether fewer than the rounded fraction of k-mers are distinct: a repeat."""
    return F.size(F.array_distinct(kmers)) < F.floor(F.size(kmers) * fraction + 0.5)


def are_overlapping(kmers: Column) -> Column:
    """Whether each k-mer goes on where the one before it is without its first base."""
    n = F.size(kmers)
    places = F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
    return F.forall(places, lambda i: F.substring(F.get(kmers, i), F.lit(2), F.length(F.get(kmers, i))) == F.left(F.get(kmers, i + 1), F.length(F.get(kmers, i)) - 1))


def chomp_tail(seq: Column, base: str, least: int, tolerance: int) -> Column:
    """A trailing run of the base (with up to `tolerance` other bases in a row between its parts) of at least `least` places is
    cut down to half of that; other sequences stay."""
    run = F.length(F.regexp_extract(seq, f"((?:{base}+[^{base}]{{0,{tolerance}}})*{base}+)$", 1))
    return F.when(run >= least, F.left(seq, F.length(seq) - run + least // 2)).otherwise(seq)
