"""Incremental k-mer counts over a folder that receives FASTA files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.kmers import spectrum
from ..sources.fastx import fasta_rows


def stream_fasta(spark: SparkSession, folder: str) -> DataFrame:
    return fasta_rows(spark.readStream.schema("value string").option("lineSep", "\n>").text(folder))


def stream_spectrum(reads: DataFrame, k: int) -> DataFrame:
    """Running canonical k-mer counts; write with output mode complete or update."""
    return spectrum(reads, k)
