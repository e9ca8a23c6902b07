"""Command line: python -m seqframe.cli --left l.fq --right r.fq --out folder."""

from __future__ import annotations

import argparse
import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.kmers import choose_k
from .plans import stages
from .plans.assembly import LONG_READS, PACBIO, Config
from .sources import fastx


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seqframe", description="Assemble transcripts from reads with Spark.")
    p.add_argument("--left", help="first mates (FASTA or FASTQ)")
    p.add_argument("--right", help="second mates")
    p.add_argument("--forward", help="single reads")
    p.add_argument("--reverse", help="single reads of the other strand")
    p.add_argument("--long", help="long reads")
    p.add_argument("--layout", action="store_true", help="lay long reads out by their overlaps")
    p.add_argument("--pool", help="a manifest: name and files of each sample")
    p.add_argument("--out", required=True, help="folder for the results")
    p.add_argument("--k", default="25", help="a size, or a list such as 25,27,30-40:5 of which the best is taken")
    p.add_argument("--coverage", type=int, help="least coverage of a k-mer")
    p.add_argument("--length", type=int, default=200, help="least length of a transcript")
    p.add_argument("--quality", type=float, default=0.0, help="least mean quality of a read")
    p.add_argument("--stranded", action="store_true")
    p.add_argument("--rounds", type=int, default=2, help="extensions of a fragment by pairs to either side, at most")
    p.add_argument("--unmended", action="store_true", help="join mates without mending them")
    p.add_argument("--pacbio", action="store_true", help="long reads of high accuracy")
    p.add_argument("--uracil", action="store_true", help="write U for T")
    p.add_argument("--prefix", default="sf_", help="before the names of transcripts")
    return p


def numbered(rows: DataFrame) -> DataFrame:
    """(read_id, seq) with ids in no order."""
    return rows.select(F.monotonically_increasing_id().alias("read_id"), F.upper("seq").alias("seq"))


def settings(args: argparse.Namespace, reads: DataFrame) -> Config:
    base = (PACBIO if args.pacbio else LONG_READS) if args.long else Config()
    sizes = fastx.kmer_sizes(args.k)
    k = sizes[0] if len(sizes) == 1 else (choose_k(reads, sizes).where("chosen").first() or {"k": sizes[0]})["k"]
    return Config(k, base.least_coverage if args.coverage is None else args.coverage, args.length, args.rounds, not args.unmended)


def mates(spark: SparkSession, left: str, right: str, least: float) -> DataFrame:
    """(name, left, right), the right one turned to the left one's strand."""
    l, r = (fastx.read_reads(spark, {"forward": p}, least) for p in (left, right))
    return fastx.read_pairs(l, r).select("name", F.upper("left").alias("left"), F.upper("right").alias("right"))


def samples_of(spark: SparkSession, path: str, least: float) -> dict[str, tuple[DataFrame | None, DataFrame | None]]:
    """Mates and single reads of each sample of a manifest, from all of its rows."""
    rows = fastx.read_manifest(spark, path).collect()  # a row for each file
    pairs, singles = {}, {}
    lines: dict[tuple[str, int], dict[str, str]] = {}
    for r in rows:
        lines.setdefault((r["sample"], r["row"]), {})[r["column"]] = r["path"]
    for (sample, _), files in lines.items():
        if ("left" in files) != ("right" in files):
            raise ValueError(f"{sample}: one mate's file only")
        if "left" in files:
            pairs.setdefault(sample, []).append(mates(spark, files["left"], files["right"], least))
        for column, orientation in (("sef", "forward"), ("ser", "reverse")):
            if column in files:
                singles.setdefault(sample, []).append(fastx.read_reads(spark, {orientation: files[column]}, least).select(F.upper("seq").alias("seq")))
    whole = lambda parts: functools.reduce(DataFrame.union, parts) if parts else None
    return {s: (whole(pairs.get(s)), whole(singles.get(s))) for s in dict.fromkeys(r["sample"] for r in rows)}


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The transcripts that the arguments ask for."""
    if args.pool:
        samples = samples_of(spark, args.pool, args.quality)
        pairs, singles = next(iter(samples.values()))
        return stages.pooled(samples, settings(args, pairs.select(F.col("left").alias("seq")) if singles is None else singles), args.stranded)
    if bool(args.left) != bool(args.right):
        raise SystemExit("give --left and --right together")
    files = {k: p for k, p in (("forward", args.forward), ("reverse", args.reverse)) if p}
    singles = fastx.read_reads(spark, files, args.quality).select(F.upper("seq").alias("seq")) if files else None
    if args.left:
        pairs = mates(spark, args.left, args.right, args.quality)
        return stages.paired_end(pairs, settings(args, pairs.select(F.col("left").alias("seq"))), args.stranded, singles)
    if args.long:
        reads = numbered(fastx.read_reads(spark, {"forward": args.long}, args.quality))
        config = settings(args, reads)
        found = stages.long_reads(reads, config)
        return stages.long_read_layout(found, least=config.least_length) if args.layout else stages.single_end(found, config, args.stranded)
    if singles is None:
        raise SystemExit("give --left and --right, --forward or --reverse, --long, or --pool")
    return stages.single_end(singles, settings(args, singles), args.stranded)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("seqframe").getOrCreate()
    found = run(spark, args)
    fastx.write_fasta(found.withColumn("comment", F.concat(F.lit("l="), F.length("seq").cast("string"))), args.out, args.uracil, args.prefix)


if __name__ == "__main__":
    main()
