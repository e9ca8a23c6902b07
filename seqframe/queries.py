"""Named queries over the fixtures, each with the SQL that gives the same rows in DuckDB (None: checked by tests)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codes, complexity
from .functions import sequence as S
from .operators import coverage, graph, intervals, kmers, overlaps
from .operators.components import connected_components
from .plans.fixtures import DUCK_KMERS, K, duck, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
C = F.col

READ, RAWS, PAF, IV = (f"WITH {duck(n)} " for n in ("reads", "raw_reads", "paf", "intervals"))
KM = f"WITH {DUCK_KMERS} "
CLIP, PAIR_DISTANCE = 50, 20
MOTIFS = ", ".join(f"'{m}'" for m in S.PAS_MOTIFS)
RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"
#: A quality string for each raw read: scores 0 to 41 that depend on the read and the place.
DUCK_QUAL = "array_to_string(list_transform(range(0, length(raw_seq)), lambda i: chr(CAST(33 + (read_id * 7 + i * 13) % 42 AS INT))), '')"


def query(sql: str | None = None, source: str = "reads"):
    """Registers a function of a fixture under its name."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(view(spark, sf_dir, source))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def qualities(raw: DataFrame) -> DataFrame:
    places = F.sequence(F.lit(0), F.length("raw_seq") - 1)
    q = F.array_join(F.transform(places, lambda i: F.chr((F.lit(33) + (C("read_id") * 7 + i * 13) % 42).cast("int"))), "")
    return raw.withColumn("qual", F.when(F.length("raw_seq") > 0, q).otherwise(F.lit("")))


# Sequences.


@query(READ + f"SELECT read_id, {RC.format('seq')} AS rc FROM reads")
def reverse_complement(reads):
    return reads.select("read_id", S.reverse_complement(C("seq")).alias("rc"))


@query(READ + f"SELECT read_id, least(seq, {RC.format('seq')}) AS strand_seq FROM reads")
def canonical_strand(reads):
    return reads.select("read_id", S.canonical(C("seq")).alias("strand_seq"))


@query(READ + "SELECT read_id, CAST(len(seq) - len(replace(replace(seq, 'G', ''), 'C', '')) AS BIGINT) AS n_gc, round((len(seq) - len(replace(replace(seq, 'G', ''), 'C', ''))) / len(seq), 6) AS gc FROM reads WHERE len > 0")
def gc_content(reads):
    n = S.gc_count(C("seq"))
    return reads.where(C("len") > 0).select("read_id", n.cast("long").alias("n_gc"), F.round(n / C("len"), 6).alias("gc"))


@query(READ + "SELECT read_id, " + ", ".join(f"CAST(len(seq) - len(replace(seq, '{b}', '')) AS BIGINT) AS n_{b.lower()}" for b in "ACGT") + " FROM reads")
def base_counts(reads):
    return reads.select("read_id", *[S.count_of(C("seq"), b).cast("long").alias(f"n_{b.lower()}") for b in "ACGT"])


HPC = "array_to_string(list_filter(list_transform(range(1, len + 1), lambda i: CASE WHEN i = 1 OR substring(seq, i, 1) <> substring(seq, i - 1, 1) THEN substring(seq, i, 1) ELSE '' END), lambda c: c <> ''), '')"


@query(READ + f"SELECT read_id, {HPC} AS hpc, CAST(len({HPC}) AS BIGINT) AS hpc_len FROM reads")
def hpc_compress(reads):
    h = S.compress_homopolymers(C("seq"))
    return reads.select("read_id", h.alias("hpc"), F.length(h).cast("long").alias("hpc_len"))


@query(READ + f"SELECT read_id, CAST(greatest(0, len - {K - 1}) AS BIGINT) AS n_kmers, substring(seq, 1, {K}) AS first_kmer, right(seq, {K}) AS last_kmer FROM reads WHERE len >= {K}")
def kmer_ends(reads):
    return reads.where(C("len") >= K).select("read_id", S.n_kmers(C("seq"), K).cast("long").alias("n_kmers"), F.substring("seq", 1, K).alias("first_kmer"), F.right("seq", F.lit(K)).alias("last_kmer"))


@query(RAWS + f"SELECT read_id, CAST(i - 1 AS BIGINT) AS idx, run FROM (SELECT read_id, unnest(l) AS run, unnest(range(1, len(l) + 1)) AS i FROM (SELECT read_id, regexp_extract_all(raw_seq, '[ACGTU]{{{K},}}') AS l FROM raw_reads))", "raw_reads")
def valid_segments(raw):
    parts = F.filter(S.segments(C("raw_seq"), K), lambda p, i: i % 2 == 0)
    return raw.select("read_id", F.posexplode(parts).alias("idx", "run")).withColumn("idx", C("idx").cast("long"))


@query(RAWS + f"SELECT read_id, len(array_to_string(list_concat([''], l), '')) AS n_valid, n_n FROM (SELECT read_id, regexp_extract_all(raw_seq, '[ACGTU]{{{K},}}') AS l, CAST(CASE WHEN regexp_matches(raw_seq, '[ACGTU]{{{K},}}') THEN len(regexp_replace(regexp_replace(regexp_replace(raw_seq, '[ACGTU]{{{K},}}', '#', 'g'), '^[^#]*#', '#'), '#[^#]*$', '#')) - len(regexp_extract_all(raw_seq, '[ACGTU]{{{K},}}')) ELSE 0 END AS BIGINT) AS n_n FROM raw_reads)", "raw_reads")
def gapped_segments(raw):
    parts = S.segments(C("raw_seq"), K)
    total = lambda odd: F.aggregate(F.filter(parts, lambda p, i: i % 2 == odd), F.lit(0).cast("long"), lambda a, p: a + F.length(p))
    return raw.select("read_id", total(0).alias("n_valid"), total(1).alias("n_n"))


@query(RAWS + f"SELECT read_id, list_extract(list_filter(l, lambda x: len(x) = list_max(list_transform(l, lambda y: len(y)))), 1) AS run FROM (SELECT read_id, regexp_extract_all(raw_seq, '[ACGTU]{{{K},}}') AS l FROM raw_reads)", "raw_reads")
def longest_valid_segment(raw):
    return raw.select("read_id", S.longest_run(C("raw_seq"), K).alias("run"))


@query(RAWS + "SELECT read_id, regexp_matches(raw_seq, '[^ACGTUacgtu]') AS invalid FROM raw_reads", "raw_reads")
def invalid_base_filter(raw):
    return raw.select("read_id", S.has_invalid(C("raw_seq")).alias("invalid"))


@query(READ + "SELECT read_id, regexp_matches(seq, 'A{2,}$') AS a_tail, regexp_matches(seq, '^T{2,}') AS t_head, CAST(len(seq) - len(rtrim(seq, 'A')) AS BIGINT) AS tail_len FROM reads")
def polya_tail(reads):
    return reads.select("read_id", S.polya_tail(C("seq"), 2).alias("a_tail"), S.polyt_head(C("seq"), 2).alias("t_head"), S.tail_length(C("seq")).cast("long").alias("tail_len"))


@query(READ + f"SELECT read_id, CAST(i AS BIGINT) AS pos FROM (SELECT read_id, seq, unnest(range(0, len - 5)) AS i FROM reads WHERE len >= 6) WHERE substring(seq, CAST(i + 1 AS BIGINT), 6) IN ({MOTIFS})")
def pas_signal(reads):
    return kmers.unnest(reads.where(C("len") >= 6).select("read_id", S.signal_positions(C("seq")).alias("p")), "p", "pos").withColumn("pos", C("pos").cast("long"))


@query(RAWS + f"SELECT read_id, round(list_sum(list_transform(range(0, length(raw_seq)), lambda i: (read_id * 7 + i * 13) % 42)) / length(raw_seq), 6) AS mean_q, list_sum(list_transform(range(0, length(raw_seq)), lambda i: (read_id * 7 + i * 13) % 42)) / length(raw_seq) < 20.5 AS blank FROM raw_reads WHERE length(raw_seq) > 0", "raw_reads")
def avg_quality_filter(raw):
    q = qualities(raw.where(F.length("raw_seq") > 0)).withColumn("m", S.mean_phred(C("qual")))
    return q.select("read_id", F.round("m", 6).alias("mean_q"), (C("m") < 20.5).alias("blank"))


@query(RAWS + "SELECT read_id, array_to_string(list_transform(range(0, length(raw_seq)), lambda i: CASE WHEN (read_id * 7 + i * 13) % 42 < 10 THEN 'N' ELSE substring(raw_seq, CAST(i + 1 AS BIGINT), 1) END), '') AS masked FROM raw_reads WHERE length(raw_seq) > 0", "raw_reads")
def quality_mask(raw):
    return qualities(raw.where(F.length("raw_seq") > 0)).select("read_id", S.mask_low_quality(C("raw_seq"), C("qual"), 10).alias("masked"))


@query(READ + "SELECT a.read_id, round(1 - levenshtein(a.seq, b.seq) / greatest(length(a.seq), length(b.seq)), 6) AS identity FROM reads a JOIN reads b ON b.read_id = a.read_id + 1 WHERE greatest(a.len, b.len) > 0")
def edit_identity(reads):
    """Whole reads with whole next reads; the edit distance is the exact one, without the reference's last-column rule."""
    b = reads.select((C("read_id") - 1).alias("read_id"), C("seq").alias("other"))
    met = reads.join(b, "read_id").where(F.greatest(F.length("seq"), F.length("other")) > 0)
    return met.select("read_id", F.round(S.identity(C("seq"), C("other")), 6).alias("identity"))


QUART = """list_extract(l, 1) AS min, CASE WHEN n % 4 = 0 THEN (list_extract(l, n // 4) + list_extract(l, n // 4 + 1)) // 2 ELSE list_extract(l, n // 4 + 1) END AS q1,
CASE WHEN n % 2 = 0 THEN (list_extract(l, n // 2) + list_extract(l, n // 2 + 1)) // 2 ELSE list_extract(l, n // 2 + 1) END AS median,
CASE WHEN n % 4 = 0 THEN (list_extract(l, n // 2 + n // 4) + list_extract(l, n // 2 + n // 4 + 1)) // 2 ELSE list_extract(l, n // 2 + n // 4 + 1) END AS q3, list_extract(l, n) AS max"""
QUARTS = f"q AS (SELECT sample, bytes, {QUART} FROM (SELECT sample, list_sort(list(CAST(len AS BIGINT))) AS l, count(*) AS n, sum(len) AS bytes FROM reads WHERE len >= {K} GROUP BY sample))"


def sample_quartiles(reads: DataFrame) -> DataFrame:
    return coverage.length_quartiles(reads.where(C("len") >= K), "sample")


@query(READ + f", {QUARTS} SELECT sample, min, q1, median, q3, max FROM q")
def read_length_quartiles(reads):
    return sample_quartiles(reads).drop("bytes")


@query(READ + f", {QUARTS} SELECT CAST(greatest(1, q1 - {K} - 10) AS BIGINT) AS pair_distance, CAST(median - {K} AS BIGINT) AS tip_length, CAST(q3 + (q3 - q1) * 3 // 2 AS BIGINT) AS max_distance FROM (SELECT CAST(round_even(sum(q1 * bytes) / sum(bytes), 0) AS BIGINT) AS q1, CAST(round_even(sum(median * bytes) / sum(bytes), 0) AS BIGINT) AS median, CAST(round_even(sum(q3 * bytes) / sum(bytes), 0) AS BIGINT) AS q3 FROM q)")
def length_parameters(reads):
    return coverage.length_parameters(sample_quartiles(reads), K, 10)


@query(READ + "SELECT len >= 200 AS long, count(*) AS n_reads, CAST(sum(len) AS BIGINT) AS bases FROM reads GROUP BY 1")
def length_split(reads):
    return reads.groupBy((C("len") >= 200).alias("long")).agg(F.count(F.lit(1)).alias("n_reads"), F.sum("len").cast("long").alias("bases"))


@query(READ + "SELECT sample, count(*) AS n_reads, CAST(count(*) FILTER (strand = '+') AS BIGINT) AS n_forward, CAST(sum(len) AS BIGINT) AS bases FROM reads GROUP BY sample")
def sample_pool_grouping(reads):
    return reads.groupBy("sample").agg(F.count(F.lit(1)).alias("n_reads"), F.sum((C("strand") == "+").cast("long")).alias("n_forward"), F.sum("len").cast("long").alias("bases"))


@query(READ + "SELECT seq, min(read_id) AS first_read, count(*) AS n FROM reads GROUP BY seq")
def first_seen_dedup(reads):
    return reads.groupBy("seq").agg(F.min("read_id").alias("first_read"), F.count(F.lit(1)).alias("n"))


# k-mers.


@query(KM + "SELECT ckmer AS kmer, cov FROM spectrum")
def kmer_spectrum(reads):
    return kmers.spectrum(reads, K)


@query(KM + "SELECT cov AS multiplicity, count(*) AS n_kmers FROM spectrum GROUP BY cov")
def kmer_histogram(reads):
    return kmers.histogram(kmers.code_spectrum(reads, K))


@query(KM + "SELECT CAST(sum(cov) AS BIGINT) AS f1, count(*) AS f0, count(*) FILTER (cov = 1) AS singletons, count(*) FILTER (cov > 1) AS non_singletons FROM spectrum")
def kmer_distinct_nonsingleton(reads):
    return kmers.totals(kmers.code_spectrum(reads, K))


SIZES = [7, 9, 11, 13]
AUTO = " UNION ALL ".join(f"SELECT {k} AS k, count(*) AS f0, count(*) FILTER (c > 1) AS ns FROM (SELECT least(x, {RC.format('x')}) AS y, count(*) AS c FROM (SELECT unnest(list_transform(range(1, len - {k} + 2), lambda i: substring(seq, i, {k}))) AS x FROM reads WHERE len >= {k}) GROUP BY 1)" for k in SIZES)


@query(READ + f", a AS ({AUTO}), b AS (SELECT *, CASE WHEN ns > coalesce(lag(ns) OVER (ORDER BY k), 0) THEN 1 ELSE 0 END AS up FROM a), c AS (SELECT *, min(up) OVER (ORDER BY k) AS every FROM b) SELECT CAST(k AS INT) AS k, f0, ns AS non_singletons, every = 1 AND coalesce(lead(every) OVER (ORDER BY k), 0) = 0 AS chosen FROM c")
def auto_k(reads):
    return kmers.choose_k(reads, SIZES)


@query(KM + "SELECT read_id, pos, kmer, cov FROM cov")
def read_kmer_coverage(reads):
    return kmers.covered(reads, K).select("read_id", "pos", "kmer", "cov")


COVS = ", covs AS (SELECT read_id, list(cov ORDER BY pos) AS l, list_sort(list(cov)) AS s, count(*) AS n FROM cov GROUP BY read_id)"


def covs_of(reads: DataFrame) -> DataFrame:
    return kmers.coverage_arrays(kmers.covered(reads, K, text=False))


@query(KM + COVS + "SELECT read_id, list_extract(s, 1) AS min_cov, CASE WHEN n % 2 = 0 THEN (list_extract(s, n // 2) + list_extract(s, n // 2 + 1)) / 2.0 ELSE CAST(list_extract(s, n // 2 + 1) AS DOUBLE) END AS med_cov, list_extract(s, n) AS max_cov FROM covs")
def min_med_max_coverage(reads):
    return kmers.covered(reads, K, text=False).groupBy("read_id").agg(F.min("cov").alias("min_cov"), F.median("cov").alias("med_cov"), F.max("cov").alias("max_cov"))


@query(KM + COVS + "SELECT read_id, CASE WHEN n > 3 THEN coalesce(list_extract(s, list_extract(list_filter(list_reverse(range(1, n - 2)), lambda i: list_extract(s, i) < list_extract(s, i + 1) * 0.5), 1) + 1), 0) ELSE 0 END AS dropoff FROM covs")
def coverage_dropoff(reads):
    return kmers.dropoff(covs_of(reads), 3, 0.5)


@query(KM + "SELECT read_id, count(*) FILTER (cov >= 5) AS n_solid, round(sum(CASE WHEN cov >= 5 THEN ln(cov) ELSE 0 END), 6) AS total_log FROM cov GROUP BY read_id")
def solid_kmers(reads):
    return coverage.solid(kmers.covered(reads, K, text=False), 5).withColumn("total_log", F.round("total_log", 6))


MAGNITUDE = "CAST(" + " + ".join(f"CASE WHEN m >= {10**i} THEN 1 ELSE 0 END" for i in range(1, 6)) + " AS INT)"


@query(KM + f", m AS (SELECT read_id, min(cov) AS m, count(*) + {K - 1} AS len FROM cov GROUP BY read_id) SELECT read_id, m AS min_cov, {MAGNITUDE} AS magnitude, CASE WHEN m = 1 THEN '01' ELSE 'e' || CAST({MAGNITUDE} AS VARCHAR) END AS stratum, CASE WHEN len >= 300 THEN 'long' ELSE 'short' END AS kind FROM m")
def stratify_reads(reads):
    cov = kmers.covered(reads, K, text=False)
    m = cov.groupBy("read_id").agg(F.min("cov").alias("min_cov"), (F.count(F.lit(1)) + K - 1).alias("len"))
    mag = S.order_of_magnitude(C("min_cov"))
    return m.select("read_id", "min_cov", mag.alias("magnitude"), F.when(C("min_cov") == 1, "01").otherwise(F.concat(F.lit("e"), mag.cast("string"))).alias("stratum"), F.when(C("len") >= 300, "long").otherwise("short").alias("kind"))


@query(KM + ", w AS (SELECT read_id, pos, pos - row_number() OVER (PARTITION BY read_id ORDER BY pos) AS g FROM cov WHERE cov < 3) SELECT read_id, min(pos) AS start, max(pos) AS \"end\", count(*) AS n FROM w GROUP BY read_id, g HAVING count(*) >= 4")
def gap_runs(reads):
    cov = kmers.covered(reads, K, text=False)
    return kmers.runs(cov, C("cov") < 3).where(C("n") >= 4)


@query(KM + ", w AS (SELECT read_id, pos, pos - row_number() OVER (PARTITION BY read_id ORDER BY pos) AS g FROM cov WHERE cov >= 3), r AS (SELECT read_id, min(pos) AS s, max(pos) AS e FROM w GROUP BY read_id, g), t AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY read_id ORDER BY s) - 1 < 4 THEN 0 ELSE 1 END AS new FROM r), u AS (SELECT *, sum(new) OVER (PARTITION BY read_id ORDER BY s) AS k FROM t) SELECT read_id, min(s) AS start, max(e) AS \"end\" FROM u GROUP BY read_id, k HAVING max(e) - min(s) + 1 >= 10")
def weak_split(reads):
    """Parts of reads between runs of four or more weak k-mers; parts of under ten k-mers go."""
    return coverage.weak_split(kmers.covered(reads, K, text=False), 3, 4, 10)


@query(
    KM + COVS + ", t AS (SELECT read_id, len(l) AS n, list_filter(range(0, len(l) - 1), lambda i: list_extract(l, i + 1) >= 3 AND list_extract(l, i + 2) >= 3) AS p FROM covs), u AS (SELECT read_id, n, coalesce(list_min(p) + 1, 0) AS f, list_max(p) AS z FROM t), "
    "v AS (SELECT read_id, n, f, CASE WHEN z >= f THEN z + 2 ELSE n END AS e FROM u) SELECT read_id, f AS \"from\", e AS \"to\" FROM v WHERE (f > 0 OR e < n) AND e - f > 1"
)
def trim_low_cov_edges(reads):
    return kmers.trim_edges(covs_of(reads), 3)


DUCK_PAIRS = f", pr AS (SELECT read_id, pos, kmer AS a, lead(kmer, {PAIR_DISTANCE}) OVER (PARTITION BY read_id ORDER BY pos) AS b FROM kmers), pm AS (SELECT read_id, pos, CASE WHEN a || b > {RC.format('b')} || {RC.format('a')} THEN {RC.format('b')} ELSE a END AS l, CASE WHEN a || b > {RC.format('b')} || {RC.format('a')} THEN {RC.format('a')} ELSE b END AS r FROM pr WHERE b IS NOT NULL)"


@query(KM + DUCK_PAIRS + 'SELECT DISTINCT l AS "left", r AS "right" FROM pm')
def kmer_pairs(reads):
    return kmers.kmer_pairs(reads, K, PAIR_DISTANCE)


@query(KM + DUCK_PAIRS + f", s AS (SELECT l, r FROM pm GROUP BY ALL HAVING min(read_id) <> max(read_id)), f AS (SELECT read_id, pos, pos - row_number() OVER (PARTITION BY read_id ORDER BY pos) AS g FROM pm SEMI JOIN s USING (l, r)), t AS (SELECT read_id, min(pos) AS s, max(pos) + {PAIR_DISTANCE} + 1 AS e FROM f GROUP BY read_id, g HAVING count(*) >= 2), u AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY read_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM t), v AS (SELECT *, sum(new) OVER (PARTITION BY read_id ORDER BY s) AS k FROM u) SELECT read_id, min(s) AS start, max(e) AS \"end\" FROM v GROUP BY read_id, k")
def pair_support_segments(reads):
    """Segments that two or more neighbouring pairs support which another read has too; segments that overlap are one."""
    pairs = kmers.held_elsewhere(codes.pair_codes(reads, K, PAIR_DISTANCE, id_col="read_id"), ["left", "right"])
    return graph.supported_segments(reads, pairs, K, PAIR_DISTANCE, 2)


@query(KM + ", s AS (SELECT ckmer FROM kmers GROUP BY ckmer HAVING min(read_id) <> max(read_id)) SELECT read_id, count(*) AS n, count(s.ckmer) AS n_seen, count(*) = count(s.ckmer) AS represented FROM kmers LEFT JOIN s USING (ckmer) GROUP BY read_id")
def contains_all_kmers(reads):
    """How many k-mers of each read occur in another one."""
    rows = codes.kmer_codes(reads, K, text=False).select("read_id", C("ccode").alias("code"))
    seen = kmers.held_elsewhere(rows, ["code"]).withColumn("seen", F.lit(1).cast("long"))
    n = F.count("seen")
    return rows.join(seen, "code", "left").groupBy("read_id").agg(F.count(F.lit(1)).alias("n"), n.alias("n_seen"), (F.count(F.lit(1)) == n).alias("represented"))


W = 10
DUCK_MIN = f", mz AS (SELECT DISTINCT read_id, m FROM (SELECT read_id, pos, min(ckmer) OVER w AS m, count(*) OVER w AS c FROM kmers WINDOW w AS (PARTITION BY read_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {W - 1} FOLLOWING)) WHERE c = {W})"


@query(KM + DUCK_MIN + "SELECT read_id, m AS minimizer FROM mz")
def minimizers(reads):
    return kmers.minimizers(reads, K, W)


DUCK_SKETCH = ", sk AS (SELECT read_id, ckmer FROM (SELECT read_id, ckmer, row_number() OVER (PARTITION BY read_id ORDER BY md5(ckmer)) AS r FROM (SELECT DISTINCT read_id, ckmer FROM kmers)) WHERE r <= 20)"


@query(KM + DUCK_SKETCH + "SELECT read_id, ckmer AS kmer FROM sk")
def bottom_sketch(reads):
    return kmers.unnest(reads.select("read_id", kmers.bottom_sketch(C("seq"), K, 20).alias("s")), "s", "kmer")


@query(KM + DUCK_SKETCH + ", first AS (SELECT min(read_id) AS read_id FROM reads GROUP BY seq), s AS (SELECT sk.* FROM sk SEMI JOIN first USING (read_id)), n AS (SELECT read_id, count(*) AS n FROM s GROUP BY read_id) SELECT a.read_id AS a, b.read_id AS b, count(*) AS shared, round(count(*) / (any_value(x.n) + any_value(y.n) - count(*)), 6) AS jaccard, round(count(*) / any_value(y.n), 6) AS containment FROM s a JOIN s b ON a.ckmer = b.ckmer AND a.read_id < b.read_id JOIN n x ON x.read_id = a.read_id JOIN n y ON y.read_id = b.read_id GROUP BY a.read_id, b.read_id HAVING count(*) >= 10")
def sketch_similarity(reads):
    """Different sequences that share ten or more sketch k-mers. Copies are represented by their first read."""
    found = kmers.sketch_similarity(reads, K, 20, 10)
    return found.withColumn("jaccard", F.round("jaccard", 6)).withColumn("containment", F.round("containment", 6))


SPEC_F = f"WITH {DUCK_KMERS}, fs AS MATERIALIZED (SELECT kmer, count(*) AS cov FROM kmers GROUP BY kmer), x AS (SELECT kmer, unnest(['A', 'C', 'G', 'T']) AS base FROM fs) "


def named(rows: DataFrame) -> DataFrame:
    """Neighbours as k-mers and letters."""
    letter = F.substring(F.lit("ACGT"), C("base").cast("int") + 1, F.lit(1))
    return kmers.decoded(rows.withColumn("base", letter), K, code="kmer", neighbour="neighbour")


#: k-mers with the stems that they share with neighbours and variants, computed once; results are materialized.
STEMS = f"WITH {DUCK_KMERS}, fs AS MATERIALIZED (SELECT kmer, count(*) AS cov, left(kmer, {K - 1}) AS l, substring(kmer, 2) AS r FROM kmers GROUP BY kmer), "


@query(STEMS + "o AS MATERIALIZED (SELECT a.kmer, right(b.kmer, 1) AS base, b.kmer AS neighbour, b.cov FROM fs a JOIN fs b ON a.r = b.l) SELECT * FROM o")
def kmer_successors(reads):
    return named(kmers.neighbours(kmers.code_spectrum(reads, K, stranded=True), K))


@query(STEMS + "o AS MATERIALIZED (SELECT a.kmer, left(b.kmer, 1) AS base, b.kmer AS neighbour, b.cov FROM fs a JOIN fs b ON a.l = b.r) SELECT * FROM o")
def kmer_predecessors(reads):
    return named(kmers.neighbours(kmers.code_spectrum(reads, K, stranded=True), K, forward=False))


@query(SPEC_F + f"SELECT kmer, CAST((SELECT count(*) FROM fs b WHERE substring(b.kmer, 1, {K - 1}) = substring(a.kmer, 2)) AS BIGINT) AS n_out, CAST((SELECT count(*) FROM fs b WHERE substring(b.kmer, 2) = substring(a.kmer, 1, {K - 1})) AS BIGINT) AS n_in FROM fs a")
def branch_degree(reads):
    return kmers.decoded(kmers.degrees(kmers.code_spectrum(reads, K, stranded=True), K), K, code="kmer")


@query(STEMS + "o AS MATERIALIZED (SELECT a.kmer, b.kmer AS variant, b.cov FROM fs a JOIN fs b ON a.l = b.l WHERE a.kmer <> b.kmer) SELECT * FROM o")
def right_variants(reads):
    return kmers.decoded(kmers.variants(kmers.code_spectrum(reads, K, stranded=True), K), K, code="kmer", variant="variant")


@query(STEMS + "o AS MATERIALIZED (SELECT a.kmer, b.kmer AS variant, b.cov FROM fs a JOIN fs b ON a.r = b.r WHERE a.kmer <> b.kmer) SELECT * FROM o")
def left_variants(reads):
    return kmers.decoded(kmers.variants(kmers.code_spectrum(reads, K, stranded=True), K, right=False), K, code="kmer", variant="variant")


@query(SPEC_F + "SELECT kmer, arg_max(nb, (cov, nb)) AS best, max(cov) AS cov FROM (SELECT x.kmer, fs.kmer AS nb, cov FROM x JOIN fs ON fs.kmer = substring(x.kmer, 2) || base) GROUP BY kmer")
def max_cov_successor(reads):
    n = kmers.neighbours(kmers.code_spectrum(reads, K, stranded=True), K)
    best = n.groupBy("code").agg(F.max_by("neighbour", F.struct("cov", "neighbour")).alias("best"), F.max("cov").alias("cov"))
    return kmers.decoded(best, K, code="kmer", best="best")


#: Chains of ch (src, dst): every node with its head and place; a cycle begins at its smallest node.
DUCK_CHAINS = """cn AS (SELECT src AS node FROM ch UNION SELECT dst FROM ch), ln AS (SELECT node AS head, node, 0 AS rank FROM cn WHERE node NOT IN (SELECT dst FROM ch) UNION ALL SELECT head, ch.dst, rank + 1 FROM ln JOIN ch ON ch.src = ln.node),
rg AS (SELECT node AS first, node, [node] AS path FROM cn WHERE node NOT IN (SELECT node FROM ln) UNION ALL SELECT first, ch.dst, list_append(path, ch.dst) FROM rg JOIN ch ON ch.src = rg.node WHERE NOT list_contains(path, ch.dst)),
rw AS (SELECT first AS node, arg_max(path, len(path)) AS path FROM rg GROUP BY first),
placed AS (SELECT node, head, rank FROM ln UNION ALL SELECT node, list_min(path) AS head, (len(path) - list_position(path, list_min(path)) + 1) % len(path) AS rank FROM rw)"""
UNITIGS = f"WITH RECURSIVE {DUCK_KMERS}, fs AS MATERIALIZED (SELECT kmer, count(*) AS cov FROM kmers GROUP BY kmer HAVING count(*) >= 3), ed AS MATERIALIZED (SELECT a.kmer AS src, b.kmer AS dst FROM fs a JOIN fs b ON substring(a.kmer, 2) = left(b.kmer, {K - 1})), oo AS (SELECT src, min(dst) AS dst FROM ed GROUP BY src HAVING count(*) = 1), ii AS (SELECT dst FROM ed GROUP BY dst HAVING count(*) = 1), ch AS MATERIALIZED (SELECT src, dst FROM oo SEMI JOIN ii USING (dst) WHERE src <> dst), "


@query(UNITIGS + DUCK_CHAINS + ", e AS (SELECT coalesce(head, kmer) AS head, coalesce(rank, 0) AS rank, kmer, cov FROM fs LEFT JOIN placed ON node = kmer) SELECT head, count(*) AS n_kmers, head || coalesce(string_agg(right(kmer, 1), '' ORDER BY rank) FILTER (rank > 0), '') AS seq, round(avg(cov), 6) AS mean_cov FROM e GROUP BY head")
def unitigs(reads):
    """Maximal unbranched sequences of the graph of k-mers seen three times or more."""
    return graph.unitigs(kmers.spectrum(reads, K, stranded=True).where(C("cov") >= 3), K)


# Overlap records.


@query(PAF + "SELECT oid, lno FROM paf WHERE qend - qstart >= 300 AND tend - tstart >= 300", "paf")
def paf_large_overlap(paf):
    return paf.where(overlaps.large(300)).select("oid", "lno")


@query(PAF + "SELECT oid, lno FROM paf WHERE abs((qend - qstart) - (tend - tstart)) <= 50", "paf")
def paf_similar_sized(paf):
    return paf.where(overlaps.similar_sized(50)).select("oid", "lno")


@query(PAF + "SELECT oid, lno, round(nmatch / blocklen, 6) AS identity FROM paf WHERE nmatch / blocklen >= 0.95", "paf")
def paf_good_identity(paf):
    return paf.where(overlaps.good(0.95)).select("oid", "lno", F.round(C("nmatch") / C("blocklen"), 6).alias("identity"))


QC, TC = f"(qstart <= {CLIP} AND qlen - qend <= {CLIP})", f"(tstart <= {CLIP} AND tlen - tend <= {CLIP})"


@query(PAF + f"SELECT oid, lno, CASE WHEN {QC} AND {TC} THEN 'BOTH' WHEN {QC} THEN 'QUERY' WHEN {TC} THEN 'TARGET' ELSE 'NEITHER' END AS status FROM paf", "paf")
def containment_status(paf):
    return paf.select("oid", "lno", overlaps.contained(CLIP).alias("status"))


OUT = f"CASE WHEN strand = '+' THEN qstart > tstart AND qlen - qend < tlen - tend AND tstart <= {CLIP} AND qlen - qend <= {CLIP} ELSE qstart > tlen - tend AND tstart > qlen - qend AND tlen - tend <= {CLIP} AND qlen - qend <= {CLIP} END"
SINK = f"CASE WHEN strand = '+' THEN tstart > qstart AND tlen - tend < qlen - qend AND qstart <= {CLIP} AND tlen - tend <= {CLIP} ELSE qlen - qend > tstart AND tlen - tend > qstart AND qstart <= {CLIP} AND tstart <= {CLIP} END"


@query(PAF + f"SELECT oid, lno, {OUT} AS query_first, {SINK} AS query_sink, ({OUT}) OR ({SINK}) AS dovetail FROM paf", "paf")
def dovetail(paf):
    return paf.select("oid", "lno", overlaps.query_then_target(CLIP).alias("query_first"), overlaps.target_then_query(CLIP).alias("query_sink"), overlaps.dovetail(CLIP).alias("dovetail"))


@query(PAF + f"SELECT oid, lno FROM paf WHERE qname = tname AND strand = '-' AND (qstart <= {CLIP} OR qlen - qend <= {CLIP})", "paf")
def self_rc_artifact(paf):
    return paf.where(overlaps.inverted_self(CLIP)).select("oid", "lno")


@query(PAF + "SELECT oid, lno FROM (SELECT *, max(CASE WHEN is_primary THEN nmatch / blocklen END) OVER (PARTITION BY qname) AS best FROM paf) WHERE best IS NULL OR nmatch / blocklen >= best * best", "paf")
def primary_identity_filter(paf):
    return overlaps.near_primary(paf).select("oid", "lno")


@query(PAF + "SELECT name, other, score, rank FROM (SELECT name, other, score, CAST(row_number() OVER (PARTITION BY name ORDER BY score DESC, other) AS INT) AS rank FROM (SELECT name, other, max(nmatch) AS score FROM (SELECT qname AS name, tname AS other, nmatch FROM paf WHERE qname <> tname UNION ALL SELECT tname, qname, nmatch FROM paf WHERE qname <> tname) GROUP BY name, other)) WHERE rank <= 3", "paf")
def top_neighbors(paf):
    return overlaps.top_neighbours(paf, 3)


@query(PAF + "SELECT name, other, score FROM (SELECT name, other, score, row_number() OVER (PARTITION BY name ORDER BY score DESC, other) AS rank FROM (SELECT name, other, max(nmatch) AS score FROM (SELECT qname AS name, tname AS other, nmatch FROM paf WHERE qname <> tname UNION ALL SELECT tname, qname, nmatch FROM paf WHERE qname <> tname) GROUP BY name, other)) WHERE rank = 1", "paf")
def best_neighbor(paf):
    return overlaps.top_neighbours(paf, 1).drop("rank")


@query(PAF + ", b AS (SELECT qname, tname, max(nmatch) AS s FROM paf GROUP BY ALL), r AS (SELECT qname, tname, row_number() OVER (PARTITION BY qname ORDER BY s DESC, tname) AS k FROM b), t AS (SELECT qname, list_sort(list(tname)) AS l FROM r WHERE k <= 2 GROUP BY qname HAVING count(*) = 2) SELECT list_extract(l, 1) AS seed1, list_extract(l, 2) AS seed2, count(*) AS n FROM t GROUP BY ALL", "paf")
def seed_pair_counts(paf):
    return overlaps.seed_pairs(paf)


@query(source="paf")
def multimap_counts(paf):
    return overlaps.multimap_counts(paf).select("name", F.round("n_reads", 6).alias("n_reads"))


EDGES = f"""e0 AS (SELECT * FROM paf WHERE qname <> tname), e AS (
SELECT qname || '+' AS src, tname || CASE WHEN strand = '+' THEN '+' ELSE '-' END AS dst, qstart AS s_start, qend AS s_end, tstart AS t_start, tend AS t_end FROM e0 WHERE {OUT}
UNION ALL SELECT tname || CASE WHEN strand = '+' THEN '-' ELSE '+' END, qname || '-', tstart, tend, qstart, qend FROM e0 WHERE {OUT}
UNION ALL SELECT tname || CASE WHEN strand = '+' THEN '+' ELSE '-' END, qname || '+', tstart, tend, qstart, qend FROM e0 WHERE {SINK}
UNION ALL SELECT qname || '-', tname || CASE WHEN strand = '+' THEN '-' ELSE '+' END, qstart, qend, tstart, tend FROM e0 WHERE {SINK}),
be AS (SELECT src, dst, max(CAST((s_end - s_start) + (t_end - t_start) AS BIGINT)) AS size2 FROM e GROUP BY src, dst)"""


@query(PAF + f", {EDGES} SELECT src, dst, size2 FROM be", "paf")
def overlap_edges(paf):
    return overlaps.best_edges(overlaps.edges(paf, CLIP)).select("src", "dst", "size2")


@query(PAF + f", {EDGES} SELECT src, dst, size2 FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY size2 DESC, dst) AS o, row_number() OVER (PARTITION BY dst ORDER BY size2 DESC, src) AS i FROM be) WHERE o = 1 AND i = 1", "paf")
def resolve_junctions(paf):
    return overlaps.resolve_junctions(overlaps.best_edges(overlaps.edges(paf, CLIP))).select("src", "dst", "size2")


@query(PAF + f", {EDGES} SELECT DISTINCT ac.src, ac.dst FROM be ac JOIN be ab ON ab.src = ac.src JOIN be bc ON bc.src = ab.dst AND bc.dst = ac.dst WHERE ab.dst <> ac.dst AND ac.size2 < ab.size2 AND ac.size2 < bc.size2", "paf")
def transitive_edges(paf):
    return overlaps.transitive(overlaps.best_edges(overlaps.edges(paf, CLIP)))


@query(
    f"WITH RECURSIVE {duck('paf')}, g AS (SELECT DISTINCT CAST(substring(qname, 2) AS BIGINT) AS x, CAST(substring(tname, 2) AS BIGINT) AS y FROM paf WHERE qname <> tname AND (({OUT}) OR ({SINK}))), "
    "b AS (SELECT x, y FROM g UNION SELECT y, x FROM g), walk AS (SELECT x, y FROM b UNION SELECT w.x, b.y FROM walk w JOIN b ON w.y = b.x) SELECT x AS id, least(x, min(y)) AS component FROM walk GROUP BY x",
    "paf",
)
def overlap_components(paf):
    """Components of sequences by dovetails."""
    rows = paf.where((C("qname") != C("tname")) & overlaps.dovetail(CLIP))
    return connected_components(rows.select(F.substring("qname", 2, 9).cast("long").alias("a"), F.substring("tname", 2, 9).cast("long").alias("b")))


@query(PAF + f", {EDGES}, n AS (SELECT tname AS name, CAST(count(*) AS DOUBLE) * (1 + CAST(substring(tname, 2) AS INT) % 7) AS n_reads FROM paf GROUP BY tname) SELECT src, dst, size2 FROM be JOIN n a ON a.name = left(src, length(src) - 1) JOIN n b ON b.name = left(dst, length(dst) - 1) WHERE abs(log10(a.n_reads) - log10(b.n_reads)) <= 0.4", "paf")
def log_magnitude_edge_filter(paf):
    counts = paf.groupBy(C("tname").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("n")).select("name", (C("n") * (1 + F.substring("name", 2, 9).cast("int") % 7)).alias("n_reads"))
    return overlaps.drop_unlike_edges(overlaps.best_edges(overlaps.edges(paf, CLIP)), counts, 0.4).select("src", "dst", "size2")


@query(
    (PAF + f", {EDGES}, ch AS MATERIALIZED (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY size2 DESC, dst) AS o, row_number() OVER (PARTITION BY dst ORDER BY size2 DESC, src) AS i FROM be) WHERE o = 1 AND i = 1 AND src <> dst), {DUCK_CHAINS} SELECT node, head, CAST(rank AS BIGINT) AS rank FROM placed").replace("WITH ", "WITH RECURSIVE ", 1),
    "paf",
)
def unambiguous_paths(paf):
    """Chains of the edges that are best at both ends."""
    e = overlaps.resolve_junctions(overlaps.best_edges(overlaps.edges(paf, CLIP)))
    return graph.chains(e.select("src", "dst"))


# Intervals.


@query(IV + "SELECT name, start_pos, max(end_pos) AS end_pos, n FROM (SELECT name, min(start_pos) OVER (PARTITION BY name, g) AS start_pos, end_pos, count(*) OVER (PARTITION BY name, g) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY name ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN start_pos < max(end_pos) OVER (PARTITION BY name ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM intervals))) GROUP BY ALL", "intervals")
def interval_merge(rows):
    return intervals.merge(rows)


@query(IV + "SELECT a.event_id AS id1, b.event_id AS id2, least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos) AS overlap FROM intervals a JOIN intervals b ON a.name = b.name AND a.event_id < b.event_id AND a.start_pos < b.end_pos AND b.start_pos < a.end_pos", "intervals")
def interval_overlap_join(rows):
    r = rows.select("name", C("event_id").alias("id"), C("start_pos").alias("s"), C("end_pos").alias("e"))
    return intervals.overlap_join(r, r, "name", 256).where(C("id1") < C("id2")).select("id1", "id2", C("overlap").cast("int").alias("overlap"))


@query(IV + ", s AS (SELECT name, p, sum(d) AS d FROM (SELECT name, start_pos AS p, 1 AS d FROM intervals UNION ALL SELECT name, end_pos, -1 FROM intervals) GROUP BY ALL), t AS (SELECT name, p, sum(d) OVER w AS depth, lead(p) OVER w AS nx FROM s WINDOW w AS (PARTITION BY name ORDER BY p)), u AS (SELECT *, CASE WHEN depth >= 2 AND NOT coalesce(lag(depth >= 2) OVER (PARTITION BY name ORDER BY p), false) THEN 1 ELSE 0 END AS new FROM t), v AS (SELECT *, sum(new) OVER (PARTITION BY name ORDER BY p) AS g FROM u) SELECT name, min(p) AS start_pos, max(nx) AS end_pos FROM v WHERE depth >= 2 GROUP BY name, g HAVING max(nx) - min(p) >= 30", "intervals")
def effective_intervals(rows):
    return intervals.depth_runs(rows, "name", "start_pos", "end_pos", 2, 30)


BIN = "CASE WHEN tlen <= 250 THEN 25 WHEN tlen <= 500 THEN 50 WHEN tlen <= 1000 THEN 75 ELSE 75 END"


@query(PAF + f", b AS (SELECT tname, tlen, tstart, tend, {BIN} AS w, CAST(ceil(tlen / ({BIN})) AS INT) AS bars FROM paf), c AS (SELECT tname, bars, CASE WHEN tstart > 0 THEN CAST(floor(tstart / w + 0.5) AS INT) + 1 ELSE 0 END AS s, CASE WHEN tend < tlen THEN CAST(floor(tend / w + 0.5) AS INT) - 1 ELSE bars END AS e FROM b) SELECT tname, bin, count(*) AS n FROM (SELECT tname, CAST(unnest(range(s, e)) AS INT) AS bin FROM c WHERE s < e AND s < bars AND e > 0 AND e <= bars) GROUP BY ALL", "paf")
def coverage_histogram(paf):
    return intervals.covered_bins(paf, 150)


# Complexity.

TILES = "tl AS (SELECT read_id, len, n, st, count(*) AS c FROM (SELECT read_id, len, n, st, substring(seq, i, n) AS t FROM (SELECT *, unnest(range(st + 1, len - n + 2, n)) AS i FROM reads, (VALUES (1, 0), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2)) v(n, st))) GROUP BY read_id, len, n, st, t)"


@query(READ + f", {TILES} SELECT read_id, coalesce(repeat, false) AS repeat FROM reads LEFT JOIN (SELECT read_id, bool_or(c >= floor((len // n) * 0.9::DOUBLE + 0.5)) AS repeat FROM tl GROUP BY read_id) USING (read_id)")
def repeat_reads(reads):
    return reads.select("read_id", complexity.flag(complexity.is_repeat, C("seq")).alias("repeat"))


#: Windows of a read (the whole of it if there are fewer than four), their bases by place, and counts of bases, pairs and triples.
WINDOWS = """wn AS (SELECT read_id, 0 AS w, seq AS s FROM reads WHERE len // 50 < 4 UNION ALL SELECT read_id, w, substring(seq, (len % 50) // 2 + w * 50 + 1, 50) FROM (SELECT *, unnest(range(0, len // 50)) AS w FROM reads WHERE len // 50 >= 4)),
ch AS MATERIALIZED (SELECT read_id, w, len(s) AS n, i, substring(s, i, 1) AS a, substring(s, i + 1, 1) AS b, substring(s, i + 2, 1) AS c, substring(s, i - 1, 1) AS z, i = 1 AS first FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM wn)),
b2 AS (SELECT read_id, w, list_sum(list_slice(list_reverse_sort(list(k)), 1, 2)) AS two FROM (SELECT read_id, w, a, count(*) AS k FROM ch GROUP BY ALL) GROUP BY ALL),
tr AS (SELECT read_id, w, max(k) AS tri FROM (SELECT read_id, w, a, b, c, count(*) AS k FROM ch WHERE i <= n - 2 AND NOT (a = b AND b = c) GROUP BY ALL) GROUP BY ALL),
pr AS MATERIALIZED (SELECT read_id, w, a, b, count(*) AS k FROM ch WHERE i <= n - 1 AND CASE WHEN first THEN n < 3 OR NOT (a = b AND b = c) ELSE NOT (z = a AND a = b) END GROUP BY ALL),
pp AS (SELECT x.read_id, x.w, max(x.k + coalesce(y.k, 0)) AS pair FROM pr x LEFT JOIN pr y ON x.read_id = y.read_id AND x.w = y.w AND y.a >= x.a AND y.b >= x.b AND (y.a <> x.a OR y.b <> x.b) GROUP BY ALL),
lw AS (SELECT wn.read_id, wn.w, len(s) > 6 AND (coalesce(two, 0) >= floor(len(s) * 0.89::DOUBLE + 0.5) OR coalesce(tri, 0) >= floor(len(s) * 0.89::DOUBLE / 3 + 0.5) OR coalesce(pair, 0) >= floor(len(s) * 0.89::DOUBLE / 2 + 0.5)) AS low FROM wn LEFT JOIN b2 USING (read_id, w) LEFT JOIN tr USING (read_id, w) LEFT JOIN pp USING (read_id, w)),
wd AS (SELECT read_id, CASE WHEN len // 50 < 4 THEN bool_or(low) ELSE count(*) FILTER (low) >= floor(0.75::DOUBLE * (len // 50)) END AS windowed FROM lw JOIN reads USING (read_id) GROUP BY read_id, len)"""
SHORT = """g AS MATERIALIZED (SELECT read_id, len, i, substring(seq, i, 1) AS a, substring(seq, i, 2) AS b, substring(seq, i, 3) AS c FROM (SELECT *, unnest(range(1, len + 1)) AS i FROM reads)),
g1 AS (SELECT read_id, list_sum(list_slice(list_reverse_sort(list(k)), 1, 2)) AS x FROM (SELECT read_id, a, count(*) AS k FROM g GROUP BY ALL) GROUP BY ALL), g2 AS (SELECT read_id, max(k) AS x FROM (SELECT read_id, b, count(*) AS k FROM g WHERE i < len GROUP BY ALL) GROUP BY ALL), g3 AS (SELECT read_id, max(k) AS x FROM (SELECT read_id, c, count(*) AS k FROM g WHERE i < len - 1 GROUP BY ALL) GROUP BY ALL),
sh AS (SELECT read_id, len >= 4 AND (coalesce(g1.x, 0) >= floor(len * 0.95::DOUBLE + 0.5) OR coalesce(g2.x, 0) >= floor((len // 2) * 0.95::DOUBLE + 0.5) OR coalesce(g3.x, 0) >= floor((len // 3) * 0.95::DOUBLE + 0.5)) AS short FROM reads LEFT JOIN g1 USING (read_id) LEFT JOIN g2 USING (read_id) LEFT JOIN g3 USING (read_id))"""


@query(READ + f", {WINDOWS}, {SHORT} SELECT read_id, short, windowed FROM sh JOIN wd USING (read_id)")
def low_complexity_reads(reads):
    return reads.select("read_id", complexity.flag(complexity.low_complexity_short, C("seq")).alias("short"), complexity.flag(complexity.low_complexity_windowed, C("seq")).alias("windowed"))
