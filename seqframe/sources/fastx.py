"""FASTA, FASTQ, PAF and manifest files as DataFrames, and writers.

Paths may be files, folders or patterns in any store that Spark reads; .gz is handled by the codec.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

C = F.col
PAF_COLUMNS = [
    ("qname", "string"), ("qlen", "int"), ("qstart", "int"), ("qend", "int"), ("strand", "string"), ("tname", "string"),
    ("tlen", "int"), ("tstart", "int"), ("tend", "int"), ("nmatch", "int"), ("blocklen", "int"), ("mapq", "int"),
]


def read_name(header: Column) -> Column:
    """The first word of a header without a /1 or /2 at its end."""
    return F.regexp_replace(F.regexp_extract(header, r"^(\S+)", 1), "/[12]$", "")


def fasta_rows(text: DataFrame) -> DataFrame:
    """Records of text rows (column value) that were cut at line ends followed by '>'. Sequence lines after a blank line don't count."""
    body = F.regexp_replace(F.regexp_replace("value", "^>", ""), "\r", "")
    header = F.regexp_extract(body, r"^([^\n]*)", 1)
    lines = F.split_part(F.regexp_replace(body, r"^[^\n]*\n?", ""), F.lit("\n\n"), F.lit(1))
    return text.where(F.trim("value") != "").select(read_name(header).alias("name"), F.regexp_extract(header, r"^\S+\s+(.*)$", 1).alias("comment"), F.replace(lines, F.lit("\n"), F.lit("")).alias("seq"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, comment, seq). Files are split between records."""
    return fasta_rows(spark.read.option("lineSep", "\n>").text(path))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of files with their numbers from 0. Files are split; lines are numbered within each split,
    and a table with a row for each split tells how many lines lie before it. What is gzipped is one split."""
    lines = spark.read.text(path).select(C("_metadata.file_path").alias("file"), C("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.rtrim("value", F.lit("\r")).alias("value"))
    splits = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = splits.select("file", "block", (F.coalesce(F.sum("n").over(order), F.lit(0)) - C("first")).alias("shift"))
    return lines.join(F.broadcast(before), ["file", "block"]).select("file", (C("id") + C("shift")).alias("line"), "value")


def read_fastq(spark: SparkSession, path: str, least_mean: float = 0.0) -> DataFrame:
    """(file, record, name, seq, qual) of strict four-line records; empty lines at the end of a file don't count. Reads whose mean
    quality is below least_mean stay, with an empty sequence. A record's lines meet by their number, so files are split
    anywhere: a quality line may start like a header."""
    from ..functions.sequence import mean_phred

    lines = numbered_lines(spark, path).select("file", F.floor(C("line") / 4).alias("record"), (C("line") % 4).alias("part"), "value")
    part = lambda i: F.max(F.when(C("part") == i, C("value"))).alias(f"l{i}")
    rows = lines.groupBy("file", "record").agg(*[part(i) for i in range(4)])
    rows = rows.where(F.coalesce(F.length("l0") + F.coalesce(F.length("l1"), F.lit(0)), F.lit(0)) > 0)
    good = C("l0").startswith("@") & C("l2").startswith("+") & C("l3").isNotNull()
    checked = rows.withColumn("l0", F.when(F.coalesce(good, F.lit(False)), C("l0")).otherwise(F.raise_error(F.lit("not a FASTQ record"))))
    out = checked.select("file", "record", read_name(F.substring("l0", 2, 1 << 30)).alias("name"), C("l1").alias("seq"), C("l3").alias("qual"))
    return out.withColumn("seq", F.when(mean_phred(C("qual")) < least_mean, F.lit("")).otherwise(C("seq"))) if least_mean > 0 else out


def read_reads(spark: SparkSession, paths: dict[str, str], least_mean: float = 0.0) -> DataFrame:
    """(orientation, name, seq, qual): the union of files under their orientation ('forward' or 'reverse'), FASTA or FASTQ by
    their first line; reverse reads are turned to the other strand, with their qualities."""
    from ..functions.sequence import reverse_complement as rc
    from .stores import sniff

    out = None
    for orientation, path in paths.items():
        if sniff(spark, path) == "fastq":
            rows = read_fastq(spark, path, least_mean).select("name", "seq", "qual")
        else:
            rows = read_fasta(spark, path).select("name", "seq", F.lit(None).cast("string").alias("qual"))
        if orientation == "reverse":
            rows = rows.select("name", rc(C("seq")).alias("seq"), F.reverse("qual").alias("qual"))
        rows = rows.select(F.lit(orientation).alias("orientation"), "name", "seq", "qual")
        out = rows if out is None else out.union(rows)
    if out is None:
        raise ValueError("no files")
    return out


def read_pairs(left: DataFrame, right: DataFrame, left_rc: bool = False, right_rc: bool = True) -> DataFrame:
    """(name, left, right): mates by name; either side may be turned to the other strand. A name that only one side has is an error."""
    from ..functions.sequence import reverse_complement as rc

    l = left.select("name", (rc(C("seq")) if left_rc else C("seq")).alias("left"))
    r = right.select("name", (rc(C("seq")) if right_rc else C("seq")).alias("right"))
    met = l.withColumn("_l", F.lit(True)).join(r.withColumn("_r", F.lit(True)), "name", "full")
    alone = F.raise_error(F.concat(F.lit("no mate of "), F.coalesce("name", F.lit("a read without a name"))))
    return met.select("name", F.when(C("_l") & C("_r"), C("left")).otherwise(alone).alias("left"), F.when(C("_l") & C("_r"), C("right")).otherwise(alone).alias("right"))


def pair_segments(left: DataFrame, right: DataFrame, k: int, orientation: str = "FR", least: int | None = None) -> DataFrame:
    """(name, left, right): mates by name as arrays of runs of k or more valid bases with gaps of N between them; with `least`, of
    good qualities first. A side whose letter is R is turned: its order, and each segment to the other strand. A name that
    only one side has is an error where both are read in full, so such rows are kept with an empty array on the other side."""
    from ..functions.sequence import quality_segments, reverse_complement, segments

    def side(df: DataFrame, letter: str, into: str) -> DataFrame:
        made = quality_segments(C("seq"), C("qual"), least, k) if least is not None else segments(C("seq"), k)
        turned = F.transform(F.reverse(made), lambda x: F.when(F.replace(x, F.lit("N"), F.lit("")) == "", x).otherwise(reverse_complement(x)))
        return df.select("name", (turned if letter == "R" else made).alias(into))

    if len(orientation) != 2 or set(orientation) - {"F", "R"}:
        raise ValueError("orientation is FF, FR, RF or RR")
    met = side(left, orientation[0], "left").join(side(right, orientation[1], "right"), "name", "full")
    none = F.array().cast("array<string>")
    return met.select("name", F.coalesce("left", none).alias("left"), F.coalesce("right", none).alias("right"))


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    """The twelve columns, and the tags NM (nm), cg (cigar) and tp (is_primary)."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(f) >= 12)
    base = [F.get(f, F.lit(i)).cast(t).alias(n) for i, (n, t) in enumerate(PAF_COLUMNS)]
    tag = lambda name: F.nullif(F.regexp_extract("value", rf"\t{name}:[A-Za-z]:([^\t]*)", 1), F.lit(""))
    return rows.select(*base, tag("NM").cast("int").alias("nm"), tag("cg").alias("cigar"), (tag("tp") == "P").alias("is_primary"))


def write_paf(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws("\t", *[C(n).cast("string") for n, _ in PAF_COLUMNS]).alias("value")).write.text(path)


def write_fasta(df: DataFrame, path: str, uracil: bool = False, prefix: str = "") -> None:
    seq = F.translate("seq", "Tt", "Uu") if uracil else C("seq")
    comment = F.when(F.coalesce(C("comment"), F.lit("")) != "", F.concat(F.lit(" "), C("comment"))).otherwise("") if "comment" in df.columns else F.lit("")
    df.select(F.concat(F.lit(">" + prefix), "name", comment, F.lit("\n"), seq).alias("value")).write.text(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(sample, column, path, row) of a pool manifest: a header `#name left right sef ser`, then white-space separated rows. Rows of
    one name belong together. Without a header the columns are name, left and right."""
    lines = [r["value"] for r in spark.read.text(path).where(F.trim("value") != "").collect()]  # a line for each file
    header = lines[0].lstrip("#").split() if lines and lines[0].startswith("#") else ["name", "left", "right"]
    if bad := set(header) - {"name", "left", "right", "sef", "ser"}:
        raise ValueError(f"unknown columns: {sorted(bad)}")
    out = []
    for i, x in enumerate(lines[lines[0].startswith("#") if lines else 0 :]):
        values = x.split()
        if len(values) != len(header):
            raise ValueError(f"{len(values)} values for {len(header)} columns: {x}")
        row = dict(zip(header, values, strict=True))
        out.extend((row["name"], c, p, i) for c, p in row.items() if c != "name")
    return spark.createDataFrame(out, "sample string, column string, path string, row int")


def kmer_sizes(grammar: str) -> list[int]:
    """Sizes of a list such as 25,26,30-55:5, ascending and once each."""
    out: set[int] = set()
    for part in grammar.split(","):
        span, _, step = part.partition(":")
        a, _, b = span.partition("-")
        out.update(range(int(a), int(b or a) + 1, int(step or 1)))
    return sorted(out)
