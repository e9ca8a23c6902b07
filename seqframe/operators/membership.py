"""Set membership: exact first-seen tests, counting levels, and Bloom filters held as tables of words."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def seen_before(rows: DataFrame, keys: list[str], order: str = "read_id") -> DataFrame:
    """Rows with `seen`: whether a row of a smaller order holds the same keys. One pass in a filter would tell the same."""
    first = rows.groupBy(*keys).agg(F.min(order).alias("_first"))
    return rows.join(first, keys).withColumn("seen", C("_first") < C(order)).drop("_first")


def all_seen_before(rows: DataFrame, keys: list[str], order: str = "read_id") -> DataFrame:
    """(read_id, n, n_seen, represented): whether all keys of a read occur in earlier reads."""
    n = F.sum(C("seen").cast("long"))
    return seen_before(rows, keys, order).groupBy(order).agg(F.count(F.lit(1)).alias("n"), n.alias("n_seen"), (n == F.count(F.lit(1))).alias("represented"))


def running_count(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with `nth`: how often their keys have come so far, themselves included. Rows of one key are ordered in one task;
    for keys that may hold most rows, use counts."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def levels(spec: DataFrame, most: int) -> DataFrame:
    """(level, n_keys): how many keys of (code, cov) come more often than each level from 0 up."""
    each = spec.select(F.explode(F.sequence(F.lit(0), F.least(C("cov"), F.lit(most)).cast("int") - 1)).alias("level"))
    return each.groupBy("level").agg(F.count(F.lit(1)).alias("n_keys"))


def count_if_present(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, n) for keys that are known already."""
    return rows.join(known.select(key), key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def expected_size(n: Column, rate: float, hashes: int) -> Column:
    """Bits of a filter of n keys at a false-positive rate."""
    return F.ceil(n * (-hashes / math.log(1 - math.exp(math.log(rate) / hashes)))).cast("long")


def false_positive_rate(set_bits: Column, size: Column, hashes: int) -> Column:
    return F.pow(set_bits / size, F.lit(hashes))


def bit_of(hash_value: Column, size: int) -> Column:
    """The bit of a hash: its upper 63 bits modulo the size."""
    return F.pmod(F.shiftrightunsigned(hash_value, 1), F.lit(size))


def bloom_words(rows: DataFrame, hashes: list[str], size: int) -> DataFrame:
    """(word, bits): the set bits of a filter, 64 to a row. Words are united before the shuffle, so no task holds the filter."""
    bits = rows.select(F.explode(F.array(*[bit_of(C(h), size) for h in hashes])).alias("bit")).distinct()
    one = F.when(C("bit") % 64 == 63, F.lit(-(1 << 63))).otherwise(F.expr("shiftleft(1L, cast(bit % 64 AS INT))"))
    return bits.groupBy(F.floor(C("bit") / 64).alias("word")).agg(F.bit_or(one).alias("bits"))


def valley(hist: DataFrame, multiplier: int) -> DataFrame:
    """(threshold): of (multiplicity, n_kmers), the first multiplicity whose count times the multiplier exceeds the count before
    it, gaps counting as 0. One row; null without one."""
    before = hist.select((C("multiplicity") + 1).alias("multiplicity"), C("n_kmers").alias("before"))
    met = hist.join(before, "multiplicity", "left").where((C("multiplicity") > 1) & (C("n_kmers") * multiplier > F.coalesce("before", F.lit(0))))
    return met.agg(F.min("multiplicity").alias("threshold"))


def top_share(hist: DataFrame, fraction: float) -> DataFrame:
    """(threshold): the greatest multiplicity from which upward lies at least the fraction of all distinct k-mers. The
    histogram has a row for each multiplicity; it is summed in one window."""
    total = hist.agg(F.sum("n_kmers").alias("total"))
    above = F.sum("n_kmers").over(Window.orderBy(C("multiplicity").desc()))
    return hist.withColumn("above", above).join(F.broadcast(total)).where(C("above") >= C("total") * fraction).agg(F.max("multiplicity").alias("threshold"))
