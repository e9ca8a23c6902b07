"""Named queries over overlap records: alignments, containment, bins, and the overlap graph, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import alignments as A
from .operators import coverage, layout, overlaps
from .queries import CLIP, EDGES, PAF, query
from .tables import Tables

C = F.col
GAP = 25

# Alignments: the overlap fixture with a CIGAR string of three matches around an insertion and a deletion.

DUCK_ALN = "aln AS (SELECT *, (qend - qstart) // 3 AS x, CAST(oid % 60 AS INT) AS i, CAST(lno * 9 AS INT) AS d FROM paf)"


def aligned(paf: DataFrame) -> DataFrame:
    x, i, d = F.floor((C("qend") - C("qstart")) / 3).cast("string"), (C("oid") % 60).cast("string"), (C("lno") * 9).cast("string")
    cigar = F.concat(x, F.lit("M"), i, F.lit("I"), x, F.lit("M"), d, F.lit("D"), x, F.lit("M"))
    return paf.withColumn("cigar", F.when(C("lno") < 7, cigar)).withColumn("nm", (C("blocklen") - C("nmatch")).cast("int"))


@query(PAF + f", {DUCK_ALN} SELECT oid, lno, lno < 7 AS has, CASE WHEN lno < 7 THEN nmatch / (3 * x) >= 0.97 END AS good_matches, CASE WHEN lno < 7 THEN nmatch / blocklen >= 0.95 AND i <= {GAP} AND d <= {GAP} WHEN nmatch / blocklen < 0.95 THEN false END AS good FROM aln", "paf")
def alignment_filters(paf):
    return aligned(paf).select("oid", "lno", A.has_alignment().alias("has"), A.good_matches(0.97).alias("good_matches"), A.good_alignment(GAP, 0.95).alias("good"))


# Blocks split where the insertion or the deletion is as long as the gap (along the sequence that moves) or longer (along the other).
Q = f"qstart || '-' || CASE WHEN i >= {GAP} THEN (qstart + x) || ',' || (qstart + x + i) || '-' ELSE '' END || CASE WHEN d > {GAP} THEN (qstart + 2 * x + i) || ',' || (qstart + 2 * x + i) || '-' ELSE '' END || (qstart + 3 * x + i)"
TF = f"tstart || '-' || CASE WHEN i > {GAP} THEN (tstart + x) || ',' || (tstart + x) || '-' ELSE '' END || CASE WHEN d >= {GAP} THEN (tstart + 2 * x) || ',' || (tstart + 2 * x + d) || '-' ELSE '' END || (tstart + 3 * x + d)"
TR = f"(tend - 3 * x - d) || '-' || CASE WHEN d >= {GAP} THEN (tend - 2 * x - d) || ',' || (tend - 2 * x) || '-' ELSE '' END || CASE WHEN i > {GAP} THEN (tend - x) || ',' || (tend - x) || '-' ELSE '' END || tend"


@query(PAF + f", {DUCK_ALN} SELECT oid, lno, {Q} AS q, CASE WHEN strand = '+' THEN {TF} ELSE {TR} END AS t FROM aln WHERE lno < 7", "paf")
def aligned_blocks(paf):
    text = lambda b: F.array_join(F.transform(b, lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",")
    return aligned(paf).where(A.has_alignment()).select("oid", "lno", text(A.query_blocks(GAP)).alias("q"), text(A.target_blocks(GAP)).alias("t"))


# Containment.

BOUNDS = "bd AS (SELECT name, min(s) AS low, max(e) AS high FROM (SELECT qname AS name, qstart AS s, qend AS e FROM paf UNION ALL SELECT tname, tstart, tend FROM paf) GROUP BY name)"
QIN = f"(qstart <= q.low + {CLIP} AND q.high - qend <= {CLIP})"
TIN = f"(tstart <= t.low + {CLIP} AND t.high - tend <= {CLIP})"


@query(PAF + f", {BOUNDS} SELECT oid, lno, CASE WHEN {QIN} AND {TIN} THEN CASE WHEN qstart - q.low + q.high - qend < tstart - t.low + t.high - tend THEN 'QUERY' ELSE 'TARGET' END WHEN {QIN} THEN 'QUERY' WHEN {TIN} THEN 'TARGET' ELSE 'NEITHER' END AS status FROM paf JOIN bd q ON q.name = qname JOIN bd t ON t.name = tname", "paf")
def observed_containment(paf):
    return A.observed_containment(paf, CLIP).select("oid", "lno", "status")


BEST = "(SELECT qname, tname, qlen, tlen, qstart, qend, tstart, tend FROM (SELECT *, row_number() OVER (PARTITION BY qname, tname ORDER BY qend - qstart DESC, nmatch DESC, oid DESC, lno DESC) AS k FROM paf WHERE qname <> tname AND strand = '{0}') WHERE k = 1)"


def duck_inside(x: str) -> str:
    return f"((a.{x}start >= b.{x}start AND a.{x}end <= b.{x}end) OR (b.{x}start >= a.{x}start AND b.{x}end <= a.{x}end))"


def duck_unmapped(x: str) -> str:
    return f"(a.{x}len - CASE WHEN a.{x}start <= b.{x}end AND b.{x}start <= a.{x}end THEN greatest(a.{x}end, b.{x}end) - least(a.{x}start, b.{x}start) ELSE a.{x}end - a.{x}start + b.{x}end - b.{x}start END)"


def duck_spans(x: str) -> str:
    return f"(least(a.{x}start, b.{x}start) <= {CLIP} AND greatest(a.{x}end, b.{x}end) + {CLIP} >= a.{x}len)"


@query(PAF + f" SELECT a.qname, a.tname, CASE WHEN {duck_inside('q')} THEN 'TARGET' WHEN {duck_inside('t')} THEN 'QUERY' WHEN {duck_unmapped('t')} > {duck_unmapped('q')} THEN CASE WHEN {duck_spans('q')} THEN 'QUERY' END WHEN {duck_spans('t')} THEN 'TARGET' END AS drop FROM {BEST.format('+')} a JOIN {BEST.format('-')} b ON a.qname = b.qname AND a.tname = b.tname", "paf")
def inverted_artefacts(paf):
    return A.inverted_artefacts(paf, CLIP)


#: Every third sequence has a tail: its last 40 bases.
TAIL = "CASE WHEN CAST(substring({0}name, 2) AS INT) % 3 = 0 THEN {0}len - 40 END"


@query(PAF + f" SELECT oid, lno, coalesce({TAIL.format('q')} >= qstart AND qlen <= qend, true) AS query_kept, coalesce({TAIL.format('t')} >= tstart AND tlen <= tend, true) AS target_kept FROM paf", "paf")
def tails_inside_overlaps(paf):
    start = lambda x: F.when(F.substring(f"{x}name", 2, 9).cast("int") % 3 == 0, C(f"{x}len") - 40)
    kept = lambda x: A.tail_kept(C(f"{x}start"), C(f"{x}end"), start(x), C(f"{x}len"))
    return paf.select("oid", "lno", kept("q").alias("query_kept"), kept("t").alias("target_kept"))


# Coverage of targets by bins.

SIZE = 25
DUCK_BINS = f"""bb AS (SELECT tname, tlen, CAST(ceil(tlen / {SIZE}) AS INT) AS bars, CASE WHEN tstart > 0 THEN CAST(ceil(tstart / {SIZE}) AS INT) + {{m}} ELSE 0 END AS a, CASE WHEN tend < tlen THEN CAST(floor(tend / {SIZE}) AS INT) - {{m}} ELSE CAST(ceil(tlen / {SIZE}) AS INT) END AS z FROM paf),
bn AS (SELECT tname, tlen, bars, bin, count(*) AS n FROM (SELECT tname, tlen, bars, CAST(unnest(range(a, z)) AS INT) AS bin FROM bb WHERE a < z AND a < bars AND z > 0 AND z <= bars) GROUP BY ALL)"""
DUCK_ISLANDS = "ir AS (SELECT tname, tlen, bars, min(bin) AS s, max(bin) + 1 AS e FROM (SELECT *, bin - row_number() OVER (PARTITION BY tname ORDER BY bin) AS g FROM bn WHERE n >= {least}) GROUP BY tname, tlen, bars, g)"


@query(PAF + f", {DUCK_BINS.format(m=1)} SELECT tname, bin, n FROM bn", "paf")
def margin_bins(paf):
    return coverage.bin_counts(paf, "tname", "tlen", "tstart", "tend", SIZE, 1).select("tname", "bin", "n")


@query(PAF + f", {DUCK_BINS.format(m=0)}, {DUCK_ISLANDS.format(least=150)} SELECT tname, CAST(s * {SIZE} AS BIGINT) AS start_pos, CAST(e * {SIZE} AS BIGINT) AS end_pos FROM ir WHERE e - s >= 100 // {SIZE}", "paf")
def coverage_islands(paf):
    return coverage.islands(coverage.bin_counts(paf, "tname", "tlen", "tstart", "tend", SIZE), "tname", "tlen", SIZE, 150, 100)


WIDE = "(SELECT tname, tlen, CASE WHEN e < bars AND s > 1 THEN s - 1 ELSE s END AS s, CASE WHEN e <= bars - 2 THEN e + 1 ELSE e END AS e FROM ir)"


@query(
    PAF + f", {DUCK_BINS.format(m=1)}, {DUCK_ISLANDS.format(least=150)}, w AS (SELECT tname, tlen, CAST(s * {SIZE} AS BIGINT) AS s, CAST(e * {SIZE} AS BIGINT) AS e FROM {WIDE} WHERE e - s >= 100 // {SIZE}), "
    "b AS (SELECT tname, min(tstart) AS lo, max(tend) AS hi FROM paf GROUP BY tname), f AS (SELECT tname, min(s) AS fs, max(e) AS le FROM w GROUP BY tname) "
    f"SELECT tname, CAST(CASE WHEN s = fs AND s < lo + {SIZE} THEN lo ELSE s END AS BIGINT) AS start_pos, CAST(CASE WHEN e <> le THEN e WHEN e > tlen THEN tlen WHEN e > hi - {SIZE} THEN hi ELSE e END AS BIGINT) AS end_pos FROM w JOIN b USING (tname) JOIN f USING (tname)",
    "paf",
)
def widened_islands(paf):
    found = coverage.islands(coverage.bin_counts(paf, "tname", "tlen", "tstart", "tend", SIZE, 1), "tname", "tlen", SIZE, 150, 100, widen=True)
    return coverage.widened_to_bounds(found, coverage.bounds(paf, "tname", "tlen", "tstart", "tend"), "tname", "tlen", SIZE)


@query(PAF + " SELECT tname, tlen, min(tstart) AS min_start, max(tend) AS max_end, min(tstart) <= 1 AND max(tend) >= tlen - 1 AS fully_covered FROM paf GROUP BY tname, tlen", "paf")
def observed_reach(paf):
    return coverage.bounds(paf, "tname", "tlen", "tstart", "tend")


# The overlap graph.

BE = f"{EDGES}, ce AS (SELECT * FROM (SELECT *, CAST(floor(((s_end - s_start) + (t_end - t_start)) / 2) AS INT) AS size, row_number() OVER (PARTITION BY src, dst ORDER BY (s_end - s_start) + (t_end - t_start) DESC, s_start, t_start, s_end DESC) AS k FROM e) WHERE k = 1)"


def best(paf: DataFrame) -> DataFrame:
    """Written once: what follows reads the edges up to nine times, and would compare all records each time."""
    return Tables(paf.sparkSession, "best").keep(overlaps.best_edges(overlaps.edges(paf, CLIP)), "edges")


NEXT = "nx AS (SELECT src AS vertex, dst AS next, size FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY size DESC, dst) AS r FROM ce) WHERE r = 1)"
PREV = "pv AS (SELECT dst AS vertex, src AS next, size FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY size DESC, src) AS r FROM ce) WHERE r = 1)"


@query(PAF + f", {BE}, {NEXT} SELECT vertex, next, size FROM nx", "paf")
def closest_successor(paf):
    return layout.closest(best(paf))


@query(PAF + f", {BE}, {PREV} SELECT vertex, next, size FROM pv", "paf")
def closest_predecessor(paf):
    return layout.closest(best(paf), forward=False)


DUCK_WEIGHTS = "wt AS (SELECT tname AS name, CAST(count(*) AS DOUBLE) * (1 + CAST(substring(tname, 2) AS INT) % 7) AS weight FROM paf GROUP BY tname)"


def weights_of(paf: DataFrame) -> DataFrame:
    n = paf.groupBy(C("tname").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return n.select("name", (C("n") * (1 + F.substring("name", 2, 9).cast("int") % 7)).alias("weight"))


@query(PAF + f", {BE}, {DUCK_WEIGHTS} SELECT src AS vertex, dst AS next, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM ce JOIN wt ON wt.name = left(dst, length(dst) - 1)) WHERE r = 1", "paf")
def heaviest_successor(paf):
    return layout.heaviest(best(paf), weights_of(paf))


@query(PAF + f", {BE}, {DUCK_WEIGHTS} SELECT dst AS vertex, src AS next, weight FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY weight DESC, src) AS r FROM ce JOIN wt ON wt.name = left(src, length(src) - 1)) WHERE r = 1", "paf")
def heaviest_predecessor(paf):
    return layout.heaviest(best(paf), weights_of(paf), forward=False)


WALK = ", wk AS (SELECT vertex, [vertex] AS path, 1 AS n FROM (SELECT vertex FROM nx UNION SELECT next FROM nx) UNION ALL SELECT w.vertex, list_append(path, next), n + 1 FROM wk w JOIN nx ON nx.vertex = w.path[-1] WHERE NOT list_contains(path, next)) SELECT vertex, array_to_string(arg_max(path, n), ',') AS path FROM wk GROUP BY vertex"


@query((PAF + f", {BE}, {NEXT}" + WALK).replace("WITH ", "WITH RECURSIVE ", 1), "paf")
def greedy_walks(paf):
    """From each vertex along its closest successors, until a vertex comes again."""
    return layout.walks(layout.closest(best(paf))).select("vertex", F.array_join("path", ",").alias("path"))


@query((PAF + f", {BE}, {DUCK_WEIGHTS}, nx AS (SELECT src AS vertex, dst AS next FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM ce JOIN wt ON wt.name = left(dst, length(dst) - 1)) WHERE r = 1)" + WALK).replace("WITH ", "WITH RECURSIVE ", 1), "paf")
def heaviest_walks(paf):
    return layout.walks(layout.heaviest(best(paf), weights_of(paf))).select("vertex", F.array_join("path", ",").alias("path"))


@query(
    PAF + f", {BE}, tri AS MATERIALIZED (SELECT i.dst AS v, i.src AS p, o.dst AS s, b.size AS d, (CASE WHEN right(i.dst, 1) = '-' THEN i.t_end - o.s_start ELSE o.s_end - i.t_start END) AS len, i.t_end - i.t_start AS il, o.s_end - o.s_start AS ol FROM ce i JOIN ce o ON i.dst = o.src JOIN ce b ON b.src = i.src AND b.dst = o.dst WHERE i.src <> o.dst), "
    f"{NEXT}, {PREV}, bp AS (SELECT DISTINCT v, p FROM tri), bs AS (SELECT DISTINCT v, s FROM tri), "
    "good AS (SELECT v FROM tri GROUP BY v HAVING bool_and(greatest(d, len - (len - il) - (len - ol)) * 0.9 <= least(d, len - (len - il) - (len - ol)))), "
    "near AS (SELECT DISTINCT t.v FROM tri t JOIN nx ON nx.vertex = t.v AND nx.next = t.s JOIN pv ON pv.vertex = t.v AND pv.next = t.p), "
    "lp AS (SELECT DISTINCT x.dst AS v FROM ce x WHERE NOT EXISTS (SELECT 1 FROM bp WHERE bp.v = x.dst AND bp.p = x.src) AND NOT EXISTS (SELECT 1 FROM ce y JOIN bp ON bp.v = x.dst AND bp.p = y.dst WHERE y.src = x.src)), "
    "ls AS (SELECT DISTINCT x.src AS v FROM ce x WHERE NOT EXISTS (SELECT 1 FROM bs WHERE bs.v = x.src AND bs.s = x.dst) AND NOT EXISTS (SELECT 1 FROM ce y JOIN bs ON bs.v = x.src AND bs.s = y.src WHERE y.dst = x.dst)) "
    "SELECT v AS vertex FROM good SEMI JOIN near USING (v) ANTI JOIN lp USING (v) ANTI JOIN ls USING (v)",
    "paf",
)
def redundant_vertices(paf):
    return layout.redundant(best(paf))


@query(PAF + f", {BE}, gone AS (SELECT DISTINCT tname AS name FROM paf WHERE tlen < 700) SELECT src, dst, size FROM ce WHERE left(src, length(src) - 1) NOT IN (SELECT name FROM gone) AND left(dst, length(dst) - 1) NOT IN (SELECT name FROM gone)", "paf")
def remove_vertices(paf):
    gone = paf.where(C("tlen") < 700).select(C("tname").alias("name")).distinct()
    return layout.without(best(paf), gone).select("src", "dst", layout.size().alias("size"))


@query(PAF + " SELECT DISTINCT unnest([tname || '+', tname || '-']) AS vertex FROM paf", "paf")
def strand_vertices(paf):
    return layout.vertices(paf.select(C("tname").alias("name")).distinct())


FLIP = "left({0}, length({0}) - 1) || CASE WHEN right({0}, 1) = '+' THEN '-' ELSE '+' END"
#: How often two targets follow each other with an overlap in a read; an order's lines are the hits of one read.
SUPPORT = "h AS (SELECT oid, tname || strand AS v, qstart AS s, qend AS e FROM paf), pp AS (SELECT a.v AS v1, b.v AS v2 FROM h a JOIN h b ON a.oid = b.oid AND a.s < b.s AND a.e < b.e AND a.e > b.s), " + f"sp AS (SELECT src, dst, count(*) AS support FROM (SELECT v1 AS src, v2 AS dst FROM pp UNION ALL SELECT {FLIP.format('v2')}, {FLIP.format('v1')} FROM pp) GROUP BY ALL)"
LEN = "lg AS (SELECT qend - qstart AS length, count(*) AS n FROM paf GROUP BY ALL)"


@query(
    PAF + f", {BE}, {LEN}, {SUPPORT}, wt AS (SELECT tname AS name, CAST(count(*) AS DOUBLE) / 8 AS w FROM paf GROUP BY tname), t AS (SELECT sum(n) AS total, max(length) AS longest FROM lg), sz AS (SELECT size, coalesce(sum(n), 0) AS shorter FROM (SELECT DISTINCT size FROM ce) LEFT JOIN lg ON length <= size GROUP BY size), "
    "m AS (SELECT ce.src, ce.dst, ce.size, coalesce(sp.support, 0) AS support, floor(greatest(coalesce(a.w, 0), coalesce(b.w, 0))) AS trials, 1 - shorter / total AS q, longest FROM ce JOIN sz USING (size) CROSS JOIN t LEFT JOIN sp ON sp.src = ce.src AND sp.dst = ce.dst LEFT JOIN wt a ON a.name = left(ce.src, length(ce.src) - 1) LEFT JOIN wt b ON b.name = left(ce.dst, length(ce.dst) - 1)), "
    "p AS (SELECT *, CASE WHEN size < longest AND support < trials THEN CASE WHEN q <= 0 THEN 1.0 WHEN q >= 1 THEN 0.0 ELSE list_sum(list_transform(range(0, support + 1), lambda i: exp(lgamma(trials + 1) - lgamma(i + 1) - lgamma(trials - i + 1) + i * ln(q) + (trials - i) * ln(1 - q)))) END END AS chance FROM m) "
    "SELECT src, dst, CAST(support AS INT) AS support, round(chance, 6) AS chance, coalesce(chance >= 0.001, true) AS kept FROM p",
    "paf",
)
def binomial_edges(paf):
    """Edges against the number of reads that should span them; their support is that of the orders' lines."""
    edges = best(paf).select("src", "dst", layout.size().alias("size")).join(layout.dovetail_support(paf, "oid"), ["src", "dst"], "left")
    edges = edges.withColumn("support", F.coalesce("support", F.lit(0)).cast("int"))
    counts = paf.groupBy(C("tname").alias("name")).agg((F.count(F.lit(1)) / 8).alias("n_reads"))
    lengths = paf.groupBy((C("qend") - C("qstart")).alias("length")).agg(F.count(F.lit(1)).alias("n"))
    out = layout.supported(edges, counts, lengths)
    return out.select("src", "dst", "support", F.round("chance", 6).alias("chance"), "kept")


@query(
    PAF + ", h AS (SELECT oid, tname || strand AS v, qstart AS s, qend AS e, row_number() OVER () AS id FROM paf), p AS (SELECT a.v AS v1, b.v AS v2 FROM h a JOIN h b ON a.oid = b.oid AND a.s < b.s AND a.e < b.e AND a.e > b.s) "
    f"SELECT src, dst, count(*) AS support FROM (SELECT v1 AS src, v2 AS dst FROM p UNION ALL SELECT {FLIP.format('v2')}, {FLIP.format('v1')} FROM p) GROUP BY ALL",
    "paf",
)
def dovetail_support(paf):
    """An order's lines as the hits of one read."""
    return layout.dovetail_support(paf, "oid")


#: A sequence for each name: its length in bases that depend on the name and the place.
DUCK_SEQ = "sq AS (SELECT name, array_to_string(list_transform(range(0, n), lambda i: substring('ACGT', CAST(1 + (i * i + i * x // 3 + x) % 4 AS BIGINT), 1)), '') AS seq FROM (SELECT DISTINCT tname AS name, tlen AS n, CAST(substring(tname, 2) AS INT) AS x FROM paf))"
RCD = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def sequences_of(paf: DataFrame) -> DataFrame:
    s = paf.select(C("tname").alias("name"), C("tlen").alias("n"), F.substring("tname", 2, 9).cast("int").alias("x")).distinct()
    base = lambda i: F.substring(F.lit("ACGT"), (F.lit(1) + (i * i + F.floor(i * C("x") / 3) + C("x")) % 4).cast("int"), F.lit(1))
    return s.select("name", F.array_join(F.transform(F.sequence(F.lit(0), C("n") - 1), base), "").alias("seq"))


@query(
    PAF + f", {BE}, {DUCK_SEQ}, pt AS (SELECT src || '>' || dst AS id, * FROM ce), m AS (SELECT pt.*, a.seq AS sa, b.seq AS sb FROM pt JOIN sq a ON a.name = left(src, length(src) - 1) JOIN sq b ON b.name = left(dst, length(dst) - 1)) "
    f"SELECT id, CASE WHEN right(src, 1) = '-' THEN {RCD.format('substring(sa, s_end + 1, greatest(0, len(sa) - s_end))')} ELSE left(sa, s_start) END || CASE WHEN right(dst, 1) = '-' THEN {RCD.format('left(sb, t_end)')} ELSE substring(sb, t_start + 1) END AS seq FROM m",
    "paf",
)
def stitched_paths(paf):
    """The sequence of every edge, as a path of two vertices."""
    edges = best(paf)
    paths = edges.select(F.concat("src", F.lit(">"), "dst").alias("id"), F.array("src", "dst").alias("path"))
    return layout.stitched(paths, edges, sequences_of(paf))


SCORE = "sc AS (SELECT DISTINCT tname AS name, CAST(substring(tname, 2) AS INT) % 5 AS f, CAST(substring(tname, 2) AS INT) % 3 AS r FROM paf)"


@query(
    PAF + f", {BE}, {SCORE}, gone AS (SELECT name || CASE WHEN f > 0 THEN '-' ELSE '+' END AS v FROM sc WHERE (f > 0) <> (r > 0)), kept AS (SELECT src, dst, size FROM ce WHERE src NOT IN (SELECT v FROM gone) AND dst NOT IN (SELECT v FROM gone)), single AS (SELECT {FLIP.format('v')} AS v FROM gone) "
    "SELECT src, dst, size FROM kept WHERE NOT (src IN (SELECT v FROM single) AND dst NOT IN (SELECT v FROM single))",
    "paf",
)
def oriented_edges(paf):
    x = F.substring("tname", 2, 9).cast("int")
    scores = paf.select(C("tname").alias("name"), (x % 5).alias("forward"), (x % 3).alias("reverse")).distinct()
    return layout.oriented(best(paf), scores).select("src", "dst", layout.size().alias("size"))
