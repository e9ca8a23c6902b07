"""Stores and small files: format sniffing, packed sequences, histograms, statistics, fragments and graph dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bases import pack, unpack
from ..functions.sequence import order_of_magnitude

C = F.col


def sniff(spark: SparkSession, path: str) -> str:
    """'fasta' or 'fastq' by the first line that isn't empty; an error for anything else."""
    first = spark.read.text(path).where(F.trim("value") != "").first()
    kind = {">": "fasta", "@": "fastq"}.get(first["value"][:1]) if first else None
    if kind is None:
        raise ValueError(f"neither FASTA nor FASTQ: {path}")
    return kind


def has_one_record(sequences: DataFrame) -> bool:
    return len(sequences.limit(2).take(2)) == 1


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of a list that aren't empty."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where(C("value") != "")


def write_numbers(df: DataFrame, column: str, path: str) -> None:
    """The numbers of a column, one a line, ascending; nulls are left out. Large tables make several files, in order."""
    df.select(C(column).alias("_n")).where(C("_n").isNotNull()).orderBy("_n").select(C("_n").cast("string").alias("value")).write.text(path)


def read_numbers(spark: SparkSession, path: str, kind: str = "int") -> DataFrame:
    """(value): such a list as numbers of a type; an error if a line isn't one. Empty lines are skipped."""
    value = C("value").try_cast(kind)
    wrong = F.raise_error(F.concat(F.lit("not a number: "), C("value"))).cast(kind)
    return lines(spark, path).select(F.when(value.isNotNull(), value).otherwise(wrong).alias("value"))


def write_packed(df: DataFrame, path: str) -> None:
    """Sequences (name, seq) of A, C, G and T as Parquet with two bits a base."""
    df.select("name", F.length("seq").alias("length"), pack(C("seq")).alias("data")).write.parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("name", unpack(C("data"), C("length")).alias("seq"))


def write_histogram(hist: DataFrame, path: str) -> None:
    """(multiplicity, n_kmers) as rows F1 and F0 and one row for each multiplicity, tab-separated."""
    totals = hist.agg(F.coalesce(F.sum(C("multiplicity") * C("n_kmers")), F.lit(0)).alias("F1"), F.coalesce(F.sum("n_kmers"), F.lit(0)).alias("F0"))
    head = totals.select(F.explode(F.array(F.struct(F.lit(-2).cast("long").alias("o"), F.lit("F1").alias("k"), C("F1").alias("v")), F.struct(F.lit(-1).cast("long").alias("o"), F.lit("F0").alias("k"), C("F0").alias("v")))).alias("x")).select("x.*")
    rows = head.union(hist.select(C("multiplicity").cast("long"), C("multiplicity").cast("string"), "n_kmers"))
    rows.orderBy("o").select(F.concat_ws("\t", "k", C("v").cast("string")).alias("value")).write.text(path)


def read_histogram(spark: SparkSession, path: str) -> tuple[int, int, DataFrame]:
    """F1, F0 and (multiplicity, n_kmers). F0 above F1 is an error."""
    rows = spark.read.csv(path, sep="\t", schema="k string, v long")
    heads = {r["k"]: r["v"] for r in rows.where(C("k").isin("F0", "F1")).collect()}  # two rows
    if heads["F0"] > heads["F1"]:
        raise ValueError("more distinct k-mers than k-mers")
    return heads["F1"], heads["F0"], rows.where(~C("k").isin("F0", "F1")).select(C("k").cast("long").alias("multiplicity"), C("v").alias("n_kmers"))


STATISTICS = ["min", "q1", "median", "q3", "max"]


def write_quartiles(df: DataFrame, path: str) -> None:
    """One row of quartiles as label:value lines."""
    each = F.array(*[F.concat(F.lit(f"{c}:"), C(c).cast("string")) for c in STATISTICS])
    df.select(F.explode(each).alias("value")).coalesce(1).write.text(path)  # five lines


def read_quartiles(spark: SparkSession, path: str) -> dict[str, int]:
    rows = lines(spark, path).select(F.split_part("value", F.lit(":"), F.lit(1)), F.split_part("value", F.lit(":"), F.lit(2)).cast("long"))
    return dict(map(tuple, rows.take(len(STATISTICS))))


def write_fragments(df: DataFrame, path: str, long: int = 200) -> None:
    """Fragments (seq, min_cov, connected, polya) under folders by tail, kind (long, short, unconnected) and stratum of coverage."""
    kind = F.when(~C("connected"), "unconnected").when(F.length("seq") >= long, "long").otherwise("short")
    stratum = F.when(C("min_cov") <= 1, "01").otherwise(F.concat(F.lit("e"), order_of_magnitude(C("min_cov")).cast("string")))
    df.withColumn("kind", kind).withColumn("stratum", stratum).write.partitionBy("polya", "kind", "stratum").parquet(path)


def read_fragments(spark: SparkSession, path: str, least_stratum: str = "01") -> DataFrame:
    """Fragments from a stratum up; only the folders asked for are read. Their order is that of assembly: tails first, then long,
    short and unconnected ones, from high coverage down (order_key)."""
    from ..functions.bases import stratum_index

    rows = spark.read.option("basePath", path).schema("seq string, min_cov double, connected boolean, polya boolean, kind string, stratum string").parquet(path)
    kinds = F.when(C("kind") == "long", 0).when(C("kind") == "short", 1).otherwise(2)
    key = F.when(C("polya"), 0).otherwise(100) + kinds * 10 + (6 - stratum_index(C("stratum")))
    return rows.where(stratum_index(C("stratum")) >= stratum_index(F.lit(least_stratum))).withColumn("order_key", key)


def write_graph(edges: DataFrame, path: str) -> None:
    """Edges (src, dst, size) as lines `a+ -> b- [o=N]`, gzipped."""
    edges.select(F.concat("src", F.lit(" -> "), "dst", F.lit(" [o="), C("size").cast("string"), F.lit("]")).alias("value")).write.option("compression", "gzip").text(path)


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    p = r"^(\S+) -> (\S+) \[o=(\d+)\]$"
    return lines(spark, path).select(F.regexp_extract("value", p, 1).alias("src"), F.regexp_extract("value", p, 2).alias("dst"), F.regexp_extract("value", p, 3).cast("int").alias("size"))


def save_kmers(spec: DataFrame, path: str, k: int, stranded: bool) -> None:
    """A k-mer table (code, cov) with its size and strandedness beside it."""
    spec.select("code", "cov").write.parquet(f"{path}/kmers")
    spec.sparkSession.createDataFrame([(k, stranded)], "k int, stranded boolean").coalesce(1).write.json(f"{path}/description")


def load_kmers(spark: SparkSession, path: str) -> tuple[DataFrame, int, bool]:
    r = spark.read.schema("k int, stranded boolean").json(f"{path}/description").first()
    return spark.read.parquet(f"{path}/kmers"), r["k"], r["stranded"]
