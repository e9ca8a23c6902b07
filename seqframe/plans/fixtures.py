"""Reads, qualities, overlaps and intervals derived from the driver's tables, in Spark SQL and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

K = 11

READS = """SELECT doc_id AS read_id, concat('r', CAST(doc_id AS STRING)) AS name, seq, CAST(length(seq) AS INT) AS len,
  source AS sample, CASE WHEN doc_id % 2 = 0 THEN '+' ELSE '-' END AS strand
FROM (SELECT doc_id, source, regexp_replace(upper(text), '[^ACGT]', ''{g}) AS seq FROM documents) d"""

RAW = "SELECT doc_id AS read_id, upper(regexp_replace(text, '[^ACGTUacgtu]', 'N'{g})) AS raw_seq FROM documents"

PAF = """SELECT qname, qlen, qstart, qend, strand, tname, tlen, tstart, tend,
  CAST(floor(greatest(qend-qstart, tend-tstart) * (100-disc) / 100{f}) AS INT) AS nmatch,
  CAST(greatest(qend-qstart, tend-tstart) AS INT) AS blocklen, is_primary, oid, lno
FROM (SELECT qname, qlen, qstart, CAST(least(qlen, qstart+200+qty*10) AS INT) AS qend, strand, tname, tlen, tstart,
             CAST(least(tlen, tstart+197+qty*10+lno) AS INT) AS tend, disc, is_primary, oid, lno
  FROM (SELECT concat('s', CAST(l_orderkey % 200 AS STRING)) AS qname, concat('s', CAST(l_partkey % 200 AS STRING)) AS tname,
        CAST(500 + ((l_orderkey % 200)*37) % 1500 AS INT) AS qlen, CAST(500 + ((l_partkey % 200)*37) % 1500 AS INT) AS tlen,
        CAST((l_linenumber*l_suppkey*7) % 280 AS INT) AS qstart, CAST((l_suppkey*13 + l_linenumber*29) % 280 AS INT) AS tstart,
        CAST(floor(l_quantity) AS INT) AS qty, CAST(floor(l_discount*100+0.5) AS INT) AS disc,
        CASE WHEN l_returnflag='R' THEN '-' ELSE '+' END AS strand, l_linestatus='O' AS is_primary,
        l_orderkey AS oid, l_linenumber AS lno FROM lineitem) a) b"""

INTERVALS = """SELECT concat('u', CAST(user_id AS STRING)) AS name, event_id,
  CAST((event_id*37) % 2000 AS INT) AS start_pos,
  CAST((event_id*37) % 2000 + 20 + floor(value) % 180 AS INT) AS end_pos
FROM events"""

VIEWS = {"reads": ("documents", READS), "raw_reads": ("documents", RAW), "paf": ("lineitem", PAF), "intervals": ("events", INTERVALS)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, sql = VIEWS[name]
    source = spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    return spark.sql(sql.format(g="", f="").replace(f"FROM {table}", "FROM {source}"), source=source)


def spread(df: DataFrame) -> DataFrame:
    """The rows over as many partitions as there are cores, where a small file would give fewer."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def duck(name: str) -> str:
    """The same as a common table expression."""
    sql = VIEWS[name][1].format(g=", 'g'", f=".0").replace("AS STRING", "AS VARCHAR")
    return f"{name} AS ({sql})"


#: k-mers of the reads, in DuckDB.
DUCK_KMERS = (
    duck("reads") + f""", kmer_lists AS (SELECT read_id, CASE WHEN len >= {K} THEN list_transform(range(1, len - {K} + 2), lambda i: substring(seq, i, {K})) ELSE [] END AS l FROM reads),
kmers AS (SELECT read_id, CAST(pos - 1 AS BIGINT) AS pos, kmer, least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS ckmer FROM (SELECT read_id, unnest(l) AS kmer, unnest(range(1, len(l) + 1)) AS pos FROM kmer_lists)),
spectrum AS (SELECT ckmer, count(*) AS cov FROM kmers GROUP BY ckmer),
cov AS (SELECT read_id, pos, kmer, ckmer, cov FROM kmers JOIN spectrum USING (ckmer))"""
)
