"""Named queries over the k-mer graph: neighbours, lookahead, extension, mates and correction, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import codes
from .operators import extension as X
from .operators import graph, kmers
from .plans.fixtures import DUCK_KMERS, K
from .queries import DUCK_PAIRS, KM, PAIR_DISTANCE, RC, query

C = F.col
RCS = RC.format
#: Stranded k-mers, and the steps between them.
STEPS = f"WITH {DUCK_KMERS}, fs AS MATERIALIZED (SELECT kmer, count(*) AS cov FROM kmers GROUP BY kmer), st AS MATERIALIZED (SELECT a.kmer, a.cov AS own, b.kmer AS nb, b.cov FROM fs a JOIN fs b ON substring(a.kmer, 2) = left(b.kmer, {K - 1}))"


def stranded(reads: DataFrame) -> DataFrame:
    return kmers.code_spectrum(reads, K, stranded=True)


# Canonical neighbours.

CX = ", x AS (SELECT ckmer, unnest(['A', 'C', 'G', 'T']) AS base FROM spectrum)"


def made_sql(made: str, columns: str, where: str = "") -> str:
    """Canonical k-mers joined to those that `made` makes of them; strands and results are materialized."""
    return KM + CX + f", e AS MATERIALIZED (SELECT ckmer, base, {made} AS m FROM x), f AS MATERIALIZED (SELECT ckmer, base, least(m, {RCS('m')}) AS nb FROM e{where}), o AS MATERIALIZED (SELECT {columns} FROM f JOIN spectrum s ON s.ckmer = nb) SELECT * FROM o"


@query(made_sql("substring(ckmer, 2) || base", "f.ckmer AS kmer, base, nb AS neighbour, cov"))
def canonical_successors(reads):
    n = X.canonical_neighbours(kmers.code_spectrum(reads, K), K)
    return kmers.decoded(n.withColumn("base", F.substring(F.lit("ACGT"), C("base").cast("int") + 1, F.lit(1))), K, code="kmer", neighbour="neighbour")


@query(KM + CX + f", e AS (SELECT ckmer, base, base || left(ckmer, {K - 1}) AS m FROM x), f AS (SELECT ckmer, base, least(m, {RCS('m')}) AS nb FROM e), n AS (SELECT f.ckmer AS kmer, nb, cov FROM f JOIN spectrum s ON s.ckmer = nb) SELECT kmer, arg_max(nb, (cov, nb)) AS best, max(cov) AS cov FROM n GROUP BY kmer")
def max_cov_canonical_predecessor(reads):
    return kmers.decoded(X.best_step(X.canonical_neighbours(kmers.code_spectrum(reads, K), K, forward=False)), K, code="kmer", best="best")


@query(made_sql(f"left(ckmer, {K - 1}) || base", "f.ckmer AS kmer, nb AS variant, cov", " WHERE m <> ckmer"))
def canonical_right_variants(reads):
    return kmers.decoded(X.canonical_variants(kmers.code_spectrum(reads, K), K), K, code="kmer", variant="variant")


@query(made_sql("base || substring(ckmer, 2)", "f.ckmer AS kmer, nb AS variant, cov", " WHERE m <> ckmer"))
def canonical_left_variants(reads):
    return kmers.decoded(X.canonical_variants(kmers.code_spectrum(reads, K), K, right=False), K, code="kmer", variant="variant")


@query(STEPS + ", ok AS (SELECT kmer FROM kmers GROUP BY kmer HAVING min(read_id) <> max(read_id)) SELECT kmer, nb AS neighbour, cov FROM st WHERE nb IN (SELECT kmer FROM ok)")
def restricted_successors(reads):
    """Steps to k-mers that two reads hold."""
    rows = codes.kmer_codes(reads, K, text=False).select("read_id", "code")
    steps = X.within(kmers.neighbours(stranded(reads), K), kmers.held_elsewhere(rows, ["code"]))
    return kmers.decoded(steps.select("code", "neighbour", "cov"), K, code="kmer", neighbour="neighbour")


@query(STEPS + " SELECT nb AS kmer, arg_max(kmer, (own, kmer)) AS best, max(own) AS cov FROM st GROUP BY nb")
def max_cov_predecessor(reads):
    return kmers.decoded(X.best_step(kmers.neighbours(stranded(reads), K, forward=False)), K, code="kmer", best="best")


# Lookahead, depth and extension.

AHEAD = ", f1 AS (SELECT kmer, cov AS a FROM fs), f2 AS (SELECT fs.kmer, least(any_value(fs.cov), coalesce(max(f1.a), 0)) AS a FROM fs LEFT JOIN st USING (kmer) LEFT JOIN f1 ON f1.kmer = nb GROUP BY fs.kmer), f3 AS MATERIALIZED (SELECT fs.kmer, least(any_value(fs.cov), coalesce(max(f2.a), 0)) AS a FROM fs LEFT JOIN st USING (kmer) LEFT JOIN f2 ON f2.kmer = nb GROUP BY fs.kmer)"
GREEDY = AHEAD + ", nx AS MATERIALIZED (SELECT st.kmer AS vertex, arg_max(nb, (a, cov, translate(nb, 'ACGT', 'TGCA'))) AS next FROM st JOIN f3 ON f3.kmer = nb GROUP BY st.kmer)"


@query(STEPS + AHEAD + " SELECT kmer, a AS ahead FROM f3")
def lookahead_coverage(reads):
    return kmers.decoded(X.lookahead(stranded(reads), K, 3), K, code="kmer")


@query(STEPS + GREEDY + " SELECT vertex AS kmer, next FROM nx")
def greedy_successor(reads):
    return kmers.decoded(X.greedy_steps(stranded(reads), K, 3), K, vertex="kmer", next="next")


WALK = ", wk AS (SELECT kmer AS vertex, [kmer] AS path FROM fs UNION ALL SELECT w.vertex, list_append(path, next) FROM wk w JOIN nx ON nx.vertex = w.path[-1] WHERE len(path) <= {bound} AND NOT list_contains(path, next)), wl AS (SELECT vertex, arg_max(path, len(path)) AS path FROM wk GROUP BY vertex)"


@query((STEPS + GREEDY + WALK.format(bound=8) + " SELECT vertex AS kmer, vertex || array_to_string(list_transform(path[2:], lambda x: right(x, 1)), '') AS seq FROM wl").replace("WITH ", "WITH RECURSIVE ", 1))
def greedy_extension(reads):
    return kmers.decoded(X.spelled(X.greedy_extension(stranded(reads), K, 3, 8), K), K, code="kmer")


DEEP = ", d2 AS (SELECT DISTINCT kmer FROM st), d3 AS (SELECT DISTINCT st.kmer FROM st JOIN d2 ON d2.kmer = nb), d4 AS MATERIALIZED (SELECT DISTINCT st.kmer FROM st JOIN d3 ON d3.kmer = nb)"
DEEP_LEFT = ", e2 AS (SELECT DISTINCT nb AS kmer FROM st), e3 AS (SELECT DISTINCT nb AS kmer FROM st JOIN e2 ON e2.kmer = st.kmer), e4 AS MATERIALIZED (SELECT DISTINCT nb AS kmer FROM st JOIN e3 ON e3.kmer = st.kmer)"


@query(STEPS + DEEP + " SELECT kmer FROM d4")
def depth_right(reads):
    return kmers.decoded(X.with_depth(stranded(reads), K, 4), K, code="kmer")


@query(STEPS + DEEP_LEFT + " SELECT kmer FROM e4")
def depth_left(reads):
    return kmers.decoded(X.with_depth(stranded(reads), K, 4, forward=False), K, code="kmer")


PLAIN = DEEP_LEFT + ", one AS (SELECT kmer, min(nb) AS nb FROM st GROUP BY kmer HAVING count(*) = 1), bk AS (SELECT nb, count(*) AS n FROM st JOIN e4 USING (kmer) GROUP BY nb), nx AS MATERIALIZED (SELECT one.kmer AS vertex, one.nb AS next FROM one LEFT JOIN e4 USING (kmer) LEFT JOIN bk ON bk.nb = one.nb WHERE coalesce(bk.n, 0) - CASE WHEN e4.kmer IS NULL THEN 0 ELSE 1 END = 0)"


@query(STEPS + PLAIN + " SELECT vertex AS kmer, next FROM nx")
def unambiguous_steps(reads):
    return kmers.decoded(X.plain_steps(stranded(reads), K, 4), K, vertex="kmer", next="next")


@query((STEPS + PLAIN + WALK.format(bound=16) + " SELECT vertex AS kmer, vertex || array_to_string(list_transform(path[2:], lambda x: right(x, 1)), '') AS seq FROM wl").replace("WITH ", "WITH RECURSIVE ", 1))
def naive_extension(reads):
    """Unambiguous extension by up to 16 bases."""
    return kmers.decoded(X.spelled(X.extended(stranded(reads), X.plain_steps(stranded(reads), K, 4), 16), K), K, code="kmer")


@query(
    STEPS + DEEP + DEEP_LEFT + f", rs AS (SELECT left(kmer, {K - 1}) AS stem, min(kmer) AS lo, max(kmer) AS hi FROM d4 GROUP BY 1), ls AS (SELECT substring(kmer, 2) AS stem, min(kmer) AS lo, max(kmer) AS hi FROM e4 GROUP BY 1), "
    f"b AS (SELECT read_id FROM kmers JOIN rs ON stem = left(kmer, {K - 1}) WHERE lo <> kmer OR hi <> kmer UNION ALL SELECT read_id FROM kmers JOIN ls ON stem = substring(kmer, 2) WHERE lo <> kmer OR hi <> kmer), n AS (SELECT read_id, count(*) AS n FROM b GROUP BY read_id) "
    "SELECT read_id, coalesce(n, 0) AS n_branches, n IS NULL AS branch_free FROM (SELECT DISTINCT read_id FROM kmers) LEFT JOIN n USING (read_id)"
)
def branch_free_reads(reads):
    return X.branching(reads, stranded(reads), K, 4)


# Mates and gaps: the first and the last two fifths of a read, of which neither overlaps the other.

ENDS = f"en AS (SELECT read_id, left(seq, CAST(floor(len * 0.4) AS BIGINT)) AS l, right(seq, CAST(floor(len * 0.4) AS BIGINT)) AS r FROM reads WHERE floor(len * 0.4) >= {K})"
#: Walks from the ends alone.
FROM_ENDS = f", {ENDS}" + WALK.format(bound=64).replace("FROM fs", f"FROM (SELECT DISTINCT right(l, {K}) AS kmer FROM en)")
JOIN = f", cn AS (SELECT en.*, CASE WHEN list_contains(path, left(r, {K})) THEN array_to_string(list_transform(path[2:list_position(path, left(r, {K}))], lambda x: right(x, 1)), '') END AS b FROM en LEFT JOIN wl ON vertex = right(l, {K}))"


def ends_of(reads: DataFrame) -> DataFrame:
    n = F.floor(C("len") * 0.4).cast("int")
    return reads.where(n >= K).select("read_id", F.left("seq", n).alias("left"), F.right("seq", n).alias("right"))


@query((STEPS + GREEDY + FROM_ENDS + JOIN + " SELECT read_id, b AS between FROM cn").replace("WITH ", "WITH RECURSIVE ", 1))
def connected_ends(reads):
    return X.connect(ends_of(reads), stranded(reads), K, 3, 64).select("read_id", "between")


@query(
    (
        STEPS + GREEDY + FROM_ENDS + JOIN + f", o AS (SELECT *, list_max(list_filter(range(5, len(l) + 1), lambda n: right(l, n) = left(r, n))) AS n FROM cn), s AS (SELECT read_id, CASE WHEN contains(l, r) THEN l WHEN contains(r, l) THEN r ELSE l || substring(r, n + 1) END AS over, l || b || substring(r, {K + 1}) AS path FROM o) "
        "SELECT read_id, coalesce(over, path) AS seq, CASE WHEN over IS NOT NULL THEN 'overlap' WHEN path IS NOT NULL THEN 'path' END AS how FROM s"
    ).replace("WITH ", "WITH RECURSIVE ", 1)
)
def joined_mates(reads):
    return X.join_mates(ends_of(reads), stranded(reads), K, 5, 3, 64).select("read_id", "seq", "how")


# Pairs along reads.


@query(KM + DUCK_PAIRS + ", s AS (SELECT l, r FROM pm GROUP BY ALL HAVING min(read_id) <> max(read_id)) SELECT read_id, count(*) AS n, count(s.l) AS n_supported, count(*) = count(s.l) AS every, max(CASE WHEN s.l IS NOT NULL THEN pos END) AS last FROM pm LEFT JOIN s USING (l, r) GROUP BY read_id")
def pair_support(reads):
    """How many pairs of each read another read has too, and the place of the last one."""
    rows = codes.pair_codes(reads, K, PAIR_DISTANCE, id_col="read_id")
    known = kmers.held_elsewhere(rows, ["left", "right"]).withColumn("known", F.lit(True))
    met = rows.join(known, ["left", "right"], "left").groupBy("read_id")
    return met.agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("n_supported"), (F.count(F.lit(1)) == F.count("known")).alias("every"), F.max(F.when(C("known"), C("pos"))).alias("last"))


@query(
    KM + DUCK_PAIRS + ", s AS (SELECT l, r FROM pm GROUP BY ALL HAVING min(read_id) <> max(read_id)), f AS (SELECT read_id, pos, pos - row_number() OVER (PARTITION BY read_id ORDER BY pos) AS g FROM pm SEMI JOIN s USING (l, r)), "
    f"t AS (SELECT read_id, min(pos) AS s, max(pos) + {PAIR_DISTANCE} + 1 AS e FROM f GROUP BY read_id, g), u AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY read_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM t), "
    "v AS (SELECT *, sum(new) OVER (PARTITION BY read_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS h FROM u) SELECT read_id, min(s) AS start, max(e) AS \"end\" FROM v GROUP BY read_id, h"
)
def pair_support_any(reads):
    """Segments that single pairs support."""
    pairs = kmers.held_elsewhere(codes.pair_codes(reads, K, PAIR_DISTANCE, id_col="read_id"), ["left", "right"])
    return graph.supported_segments(reads, pairs, K, PAIR_DISTANCE, 1)


# Correction.


@query(
    KM + f", w AS (SELECT read_id, pos, pos - row_number() OVER (PARTITION BY read_id ORDER BY pos) AS g FROM cov WHERE cov < 3), z AS (SELECT read_id, max(pos) AS last FROM kmers GROUP BY read_id), r AS (SELECT read_id, max(pos) AS wp FROM w GROUP BY read_id, g HAVING count(*) = {K} AND min(pos) > 0), "
    f"a AS (SELECT r.read_id, wp, seq, unnest(['A', 'C', 'G', 'T']) AS new FROM r JOIN z USING (read_id) JOIN reads USING (read_id) WHERE wp < last), t AS (SELECT read_id, wp, new, substring(seq, wp - {K - 2}, {K - 1}) || new || substring(seq, wp + 2, {K - 1}) AS win FROM a WHERE substring(seq, wp + 1, 1) <> new), "
    f"k AS (SELECT read_id, wp, new, substring(win, i, {K}) AS x FROM (SELECT *, unnest(range(1, {K + 1})) AS i FROM t)), c AS (SELECT read_id, wp, new, min(coalesce(cov, 0)) AS score FROM k LEFT JOIN spectrum ON ckmer = least(x, {RCS('x')}) GROUP BY ALL HAVING min(coalesce(cov, 0)) >= 3), "
    "b AS (SELECT read_id, wp, new FROM (SELECT *, row_number() OVER (PARTITION BY read_id, wp ORDER BY score DESC, new) AS q FROM c) WHERE q = 1), f AS (SELECT read_id, map_from_entries(list((wp, new))) AS m, count(*) AS n FROM b GROUP BY read_id) "
    "SELECT read_id, array_to_string(list_transform(range(0, len), lambda i: coalesce(element_at(m, i)[1], substring(seq, i + 1, 1))), '') AS seq, CAST(n AS INT) AS n_corrected FROM f JOIN reads USING (read_id)"
)
def corrected_mismatches(reads):
    return X.correct_mismatches(reads, kmers.code_spectrum(reads, K), K, 3)
