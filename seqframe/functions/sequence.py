"""Column expressions over nucleotide sequences, qualities and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signal hexamers upstream of a poly-A tail (PMID 27382025).
PAS_MOTIFS = [
    "AATAAA", "ATTAAA", "AGTAAA", "TATAAA", "CATAAA", "GATAAA", "AATATA", "AATACA", "AATAGA", "AAAAAG", "ACTAAA", "AAGAAA",
    "AATGAA", "TTTAAA", "AAAACA", "GGGGCT", "AATAAT", "AACAAA", "ATTACA", "ATTATA", "AACAAG", "AATAAG", "TTTTTT",
]
MARK = "\x01"


def complement(seq: Column) -> Column:
    """Complement of ACGT; U counts as T; anything else, lower case too, becomes N."""
    return F.translate(F.regexp_replace(seq, "[^ACGTU]", "N"), "ACGTU", "TGCAA")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def canonical(seq: Column) -> Column:
    """The lexicographically smaller strand."""
    return F.least(seq, reverse_complement(seq))


def kmers(seq: Column, k: int) -> Column:
    """All k-mers in order; an empty array for shorter sequences. A lookahead finds them in one pass; a lambda over places
    would hold the sequence's own expression, which the optimizer may evaluate again for every place."""
    return F.regexp_extract_all(seq, F.lit(f"(?=(.{{{k}}}))"), F.lit(1))


def n_kmers(seq: Column, k: int) -> Column:
    return F.greatest(F.lit(0), F.length(seq) - (k - 1))


def count_of(seq: Column, base: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(base), F.lit("")))


def gc_count(seq: Column) -> Column:
    return count_of(seq, "G") + count_of(seq, "C")


def compress_homopolymers(seq: Column) -> Column:
    return F.regexp_replace(seq, r"(.)\1+", "$1")


def has_invalid(seq: Column) -> Column:
    """Whether a character other than ACGTU, in either case, occurs."""
    return F.regexp_like(seq, F.lit("[^ACGTUacgtu]"))


def marked_runs(seq: Column, pattern: str) -> Column:
    """The sequence cut at runs of the pattern: gap, run, gap, ..., run, gap."""
    return F.split(F.regexp_replace(seq, f"({pattern})", f"{MARK}$1{MARK}"), MARK)


def segments(seq: Column, k: int) -> Column:
    """Runs of at least k valid bases, upper-cased, with gaps of N of the true length between them."""
    parts = marked_runs(seq, f"[ACGTUacgtu]{{{k},}}")
    inner = F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 2))
    return F.transform(inner, lambda p, i: F.when(i % 2 == 0, F.upper(p)).otherwise(F.repeat(F.lit("N"), F.length(p))))


def longest_run(seq: Column, k: int) -> Column:
    """The longest run of at least k valid bases, the first of equal ones, upper-cased; null if there is none."""
    runs = F.regexp_extract_all(seq, F.lit(f"([ACGTUacgtu]{{{k},}})"), F.lit(1))
    n = F.array_max(F.transform(runs, lambda r: F.length(r)))
    return F.upper(F.get(F.filter(runs, lambda r: F.length(r) == n), F.lit(0)))


def phred(qual: Column) -> Column:
    """Scores of a Phred+33 string."""
    return F.transform(letters(qual), lambda c: F.ascii(c) - 33)


def letters(text: Column) -> Column:
    """The characters. As an argument of a higher-order function they are made once, not for every element."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def mean_phred(qual: Column) -> Column:
    return F.when(F.length(qual) > 0, F.aggregate(phred(qual), F.lit(0), lambda a, x: a + x) / F.length(qual))


def mask_low_quality(seq: Column, qual: Column, least: int) -> Column:
    """Bases of a score below `least` become N."""
    return F.array_join(F.zip_with(letters(seq), phred(qual), lambda b, q: F.when(q < least, F.lit("N")).otherwise(b)), "")


def quality_segments(seq: Column, qual: Column, least: int, k: int) -> Column:
    """Runs of at least k good scores, then runs of at least k valid bases in them; gaps between runs are N.

    What lies before the first and after the last good run is left out.
    """
    good = f"[{chr(33 + least) if chr(33 + least) not in '[]^-&' else chr(92) + chr(33 + least)}-~]{{{k},}}"
    parts = marked_runs(qual, good)
    inner = F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 2))
    first = F.length(F.get(parts, F.lit(0)))
    placed = F.aggregate(
        inner,
        F.struct(first.alias("at"), F.lit(0).alias("i"), F.lit("").alias("s")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p)).alias("at"),
            (a["i"] + 1).alias("i"),
            F.concat(a["s"], F.when(a["i"] % 2 == 0, F.upper(F.substring(seq, a["at"] + 1, F.length(p)))).otherwise(F.repeat(F.lit("N"), F.length(p)))).alias("s"),
        ),
        lambda a: a["s"],
    )
    return segments(placed, k)


def polya_tail(seq: Column, n: int) -> Column:
    return F.regexp_like(seq, F.lit(f"A{{{n},}}$"))


def polyt_head(seq: Column, n: int) -> Column:
    return F.regexp_like(seq, F.lit(f"^T{{{n},}}"))


def tail_length(seq: Column) -> Column:
    """Length of the run of A at the end."""
    return F.length(seq) - F.length(F.rtrim(seq, F.lit("A")))


def signal_positions(seq: Column, motifs: list[str] = PAS_MOTIFS) -> Column:
    """Zero-based places of signal hexamers, overlapping ones too."""
    return F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(seq) - 6)), lambda i: F.substring(seq, i + 1, F.lit(6)).isin(motifs))


def identity(a: Column, b: Column) -> Column:
    """1 - edit distance / length of the longer one."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def order_of_magnitude(c: Column) -> Column:
    """0 to 5: the powers of ten up to 10^5 that c reaches."""
    return sum(((c >= 10**i).cast("int") for i in range(1, 6)), F.lit(0))


def minifloat(c: Column) -> Column:
    """The largest number up to c that an 8-bit float (4 exponent bits, 3 fraction bits) holds; exact to 16."""
    e = F.greatest(F.lit(0), F.floor(F.log2(c.cast("double"))) - 3)
    return F.when(c < 8, c.cast("double")).otherwise(F.floor(c / F.pow(F.lit(2.0), e)) * F.pow(F.lit(2.0), e))


def significant(x: Column, digits: int) -> Column:
    """x rounded to so many significant figures; 0 stays 0."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * scale) / scale)


def quartiles(values: Column) -> Column:
    """min, q1, median, q3, max of an array of integers: indices n/4, n/2 and n/2 + n/4; neighbours are averaged, rounding down, where n is a multiple of four (two for the median)."""
    s = F.array_sort(values)
    n = F.size(values)
    half, quarter = F.floor(n / 2).cast("int"), F.floor(n / 4).cast("int")

    def at(i: Column, between: Column) -> Column:
        return F.when(between, F.floor((F.get(s, i - 1) + F.get(s, i)) / 2)).otherwise(F.get(s, i)).cast("long")

    return F.struct(
        F.get(s, F.lit(0)).cast("long").alias("min"), at(quarter, n % 4 == 0).alias("q1"), at(half, n % 2 == 0).alias("median"),
        at(half + quarter, n % 4 == 0).alias("q3"), F.get(s, n - 1).cast("long").alias("max"),
    )
