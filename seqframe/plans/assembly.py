"""Short-read assembly: count, keep what is solid, chain, and drop what is contained."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import canonical, kmers
from ..operators.graph import unitigs
from ..operators.kmers import spectrum
from ..tables import Tables


@dataclass(frozen=True)
class Config:
    k: int = 25
    least_coverage: int = 2
    least_length: int = 200
    #: Extensions of a fragment by pairs to either side, at most; whether mates are mended before they are joined.
    rounds: int = 2
    mend: bool = True


LONG_READS = Config(k=25, least_coverage=2, least_length=200)
PACBIO = Config(k=35, least_coverage=2, least_length=200)


def transcripts(reads: DataFrame, config: Config = Config(), stranded: bool = False) -> DataFrame:
    """(name, seq, len, cov): unbranched sequences of solid k-mers, one of each two strands, at least the given length."""
    tables = Tables(reads.sparkSession, "assembly")
    both = reads.select("seq") if stranded else reads.select("seq").union(reads.select(F.reverse(F.translate("seq", "ACGT", "TGCA")).alias("seq")))
    solid = tables.keep(spectrum(both, config.k, stranded=True).where(F.col("cov") >= config.least_coverage), "solid")
    found = tables.keep(unitigs(solid, config.k), "unitigs")
    named = found.where(F.length("seq") >= config.least_length).withColumn("seq", F.col("seq") if stranded else canonical(F.col("seq")))
    once = named.groupBy("seq").agg(F.max("mean_cov").alias("cov"))
    return once.select(F.concat(F.lit("t"), F.substring(F.md5(F.col("seq").cast("binary")), 1, 12)).alias("name"), "seq", F.length("seq").alias("len"), "cov")


def not_contained(seqs: DataFrame, k: int) -> DataFrame:
    """Sequences without those whose every canonical k-mer lies in one longer sequence (or in an equally long one of a smaller name)."""
    sized = seqs.select("name", "seq", F.length("seq").alias("n"), F.array_distinct(F.transform(kmers(F.col("seq"), k), canonical)).alias("l"))
    rows = sized.select("name", "n", F.size("l").alias("m"), F.explode_outer("l").alias("kmer")).where(F.col("kmer").isNotNull())
    big = rows.select(F.col("name").alias("other"), F.col("n").alias("n2"), "kmer")
    met = rows.join(big, "kmer").where((F.col("n2") > F.col("n")) | ((F.col("n2") == F.col("n")) & (F.col("other") < F.col("name"))))
    inside = met.groupBy("name", "m", "other").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") == F.col("m")).select("name").distinct()
    return seqs.join(inside, "name", "left_anti")
