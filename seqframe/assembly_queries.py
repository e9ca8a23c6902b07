"""Named queries over extension, screens, low complexity and paths. Those whose result depends on an order or on rounds have no SQL;
tests compare them with loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import codes, complexity
from .layout_queries import BE, DUCK_SEQ, FLIP, RCD, best, sequences_of
from .operators import artefacts, clusters, correction, guided, kmers, layout, paths, screening, seeding, tail_scores
from .operators.intervals import overlap_join
from .plans import stages
from .plans.fixtures import K
from .queries import CLIP, PAF, PAIR_DISTANCE, READ, WINDOWS, query

C = F.col
FAR = 40

# Low complexity cut out: windows of 50 bases.

LOW = WINDOWS.replace("len // 50 < 4", "len // 50 < {least}").replace("len // 50 >= 4", "len // 50 >= {least}").replace("{{", "{").partition(",\nwd AS")[0]


def cut_sql(least: int, whole: str, few: str = "false") -> str:
    """Runs of windows that aren't low; `whole` tells of sequences of fewer windows, `few` which ones stay whole."""
    return (
        READ + f", {LOW.replace('{least}', str(least))}, wd AS (SELECT read_id, {whole} AS low FROM lw JOIN reads USING (read_id) GROUP BY read_id, len), st AS (SELECT read_id, len, len // 50 AS k, count(*) FILTER (low) AS bad FROM lw JOIN reads USING (read_id) GROUP BY read_id, len), "
        "rn AS (SELECT read_id, min(w) AS a, max(w) + 1 AS z FROM (SELECT read_id, w, w - row_number() OVER (PARTITION BY read_id ORDER BY w) AS g FROM lw WHERE NOT low) GROUP BY read_id, g), "
        f"al AS (SELECT read_id, 0 AS s, len AS e FROM st JOIN wd USING (read_id) WHERE len > 0 AND CASE WHEN k < {least} THEN NOT wd.low ELSE {few} END "
        f"UNION ALL SELECT read_id, CASE WHEN a = 0 THEN 0 ELSE (len % 50) // 2 + a * 50 END, CASE WHEN z = k THEN len ELSE (len % 50) // 2 + z * 50 END FROM rn JOIN st USING (read_id) WHERE k >= {least} AND NOT ({few})) "
        "SELECT read_id, CAST(row_number() OVER (PARTITION BY read_id ORDER BY s) - 1 AS INT) AS idx, CAST(s AS INT) AS start_pos, substring(seq, s + 1, e - s) AS part FROM al JOIN reads USING (read_id)"
    )


def parts(reads: DataFrame, least: int | None) -> DataFrame:
    each = reads.select("read_id", "seq", F.posexplode(complexity.parts(C("seq"), 50, least)).alias("idx", "x"))
    return each.select("read_id", "idx", C("x.start").alias("start_pos"), F.substring(C("seq"), C("x.start") + 1, C("x.end") - C("x.start")).alias("part"))


@query(cut_sql(1, "bool_or(low)"))
def complex_parts(reads):
    return parts(reads, None)


@query(cut_sql(5, "CASE WHEN len // 50 < 4 THEN bool_or(low) ELSE count(*) FILTER (lw.low) >= floor(0.75::DOUBLE * (len // 50)) END", "bad * 50 < 100").replace("len // 50 < 5", "len // 50 < 4").replace("len // 50 >= 5", "len // 50 >= 4"))
def complex_parts_of_long(reads):
    """Only reads with 100 bases or more in windows of low complexity are cut."""
    return parts(reads, 100)


@query()
def complex_ends(reads):
    return reads.select("read_id", complexity.trimmed_ends(C("seq"), 50).alias("seq"))


# Extension by pairs: the middle fifth of every read, by pairs of all reads.


def middles(reads: DataFrame) -> DataFrame:
    n = F.floor(C("len") / 5).cast("int")
    return reads.where(n >= K).select(C("read_id").alias("id"), F.substring(C("seq"), 2 * n + 1, n).alias("seq"))


def guides(reads: DataFrame, fragments: bool) -> guided.Guides:
    near = kmers.held_elsewhere(codes.pair_codes(reads, K, PAIR_DISTANCE, id_col="read_id"), ["left", "right"])
    far = codes.pair_codes(reads, K, FAR).distinct() if fragments else None
    return guided.Guides(near, PAIR_DISTANCE, far, FAR if fragments else 0)


@query()
def guided_extension(reads):
    """By pairs that two reads hold, two extensions to either side at most."""
    return guided.extend(middles(reads), kmers.code_spectrum(reads, K, stranded=True), K, guides(reads, False), 4, 1, 2)


@query()
def guided_fragments(reads):
    """The same with pairs of fragments besides."""
    return guided.extend(middles(reads), kmers.code_spectrum(reads, K, stranded=True), K, guides(reads, True), 4, 1, 2)


# Screens in the order of length.


@query()
def screened_reads(reads):
    """Reads that no longer ones represent: up to a wrong base between runs of three known k-mers."""
    return screening.by_kmers(reads.select(C("read_id"), "seq", "len"), 21, 3, 22, 21, name="read_id").select("read_id", "len")


@query()
def subsampled_by_pairs(reads):
    return screening.by_kmer_pairs(reads.select("read_id", "seq", "len"), K, 2, 30).select("read_id", "len")


@query()
def subsampled_by_strobemers(reads):
    return screening.by_strobemers(reads.select("read_id", "seq", "len"), K, 2, 30, 10).select("read_id", "len")


# The overlap graph of intervals on a line: those of a user that overlap by 20 or more, neither within the other.


def interval_edges(intervals: DataFrame) -> DataFrame:
    rows = intervals.select("name", C("event_id").alias("id"), C("start_pos").alias("s"), C("end_pos").alias("e"))
    met = overlap_join(rows, rows, "name", 200).where((C("s1") < C("s2")) & (C("e1") < C("e2")) & (C("overlap") >= 20))
    v = lambda i, strand: F.concat(F.lit("e"), C(f"id{i}").cast("string"), F.lit(strand))
    ints = lambda *x: [c.cast("int").alias(n) for c, n in zip(x, ("s_start", "s_end", "t_start", "t_end"), strict=True)]
    out = C("s2") - C("s1"), C("e1") - C("s1"), F.lit(0), C("e1") - C("s2")
    return met.select(v(1, "+").alias("src"), v(2, "+").alias("dst"), *ints(*out)).union(met.select(v(2, "-"), v(1, "-"), *ints(*out[2:], *out[:2])))


@query(source="intervals")
def sequentially_redundant(intervals):
    """The edges that stay when bridged intervals have gone one after the other."""
    return paths.without_redundant(interval_edges(intervals)).select("src", "dst", layout.size().alias("size"))


@query(source="intervals")
def falling_paths(intervals):
    """Paths through the intervals that overlap the most of others."""
    edges = interval_edges(intervals)
    weights = edges.groupBy(layout.name_of(C("src")).alias("name")).agg(F.sum(layout.size()).cast("double").alias("weight"))
    return paths.falling_paths(edges, weights).select("seed", "round", "weight", F.array_join("path", ",").alias("path"))


# Backbones: walks between junctions, stitched to sequences.

DUCK_BACKBONES = f"""jn AS MATERIALIZED (SELECT src, dst, s_start, s_end, t_start, t_end FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY (s_end - s_start) + (t_end - t_start) DESC, dst) AS o, row_number() OVER (PARTITION BY dst ORDER BY (s_end - s_start) + (t_end - t_start) DESC, src) AS i FROM ce) WHERE o = 1 AND i = 1),
wk AS (SELECT v, [v] AS path FROM (SELECT src AS v FROM jn UNION SELECT dst FROM jn) UNION ALL SELECT w.v, list_append(path, dst) FROM wk w JOIN jn ON jn.src = w.path[-1] WHERE NOT list_contains(path, dst)),
lp AS (SELECT v, arg_max(path, len(path)) AS path FROM wk GROUP BY v),
hd AS (SELECT v AS id, path FROM lp WHERE v NOT IN (SELECT dst FROM jn) OR (list_min(path) = v AND EXISTS (SELECT 1 FROM jn WHERE src = path[-1] AND dst = v))),
bb AS MATERIALIZED (SELECT id, path FROM (SELECT id, path, list_min(list_transform(path, lambda x: left(x, length(x) - 1) || CASE WHEN right(x, 1) = '+' THEN '0' ELSE '1' END)) AS m FROM hd) WHERE right(m, 1) = '0')"""


@query((PAF + f", {BE}, {DUCK_BACKBONES} SELECT id, array_to_string(path, ',') AS path FROM bb").replace("WITH ", "WITH RECURSIVE ", 1), "paf")
def backbone_paths(paf):
    return paths.backbones(best(paf)).select("id", F.array_join("path", ",").alias("path"))


@query(
    (
        PAF + f", {BE}, {DUCK_SEQ}, {DUCK_BACKBONES}, sp AS (SELECT id, i, path[i] AS v, CASE WHEN i > 1 THEN path[i - 1] END AS p, CASE WHEN i < len(path) THEN path[i + 1] END AS n FROM (SELECT id, path, unnest(range(1, len(path) + 1)) AS i FROM bb)), "
        "m AS (SELECT sp.id, sp.i, sp.v, sq.seq, a.t_start AS ts, a.t_end AS te, b.s_start AS ss, b.s_end AS se FROM sp JOIN sq ON sq.name = left(v, length(v) - 1) LEFT JOIN ce a ON a.src = p AND a.dst = v LEFT JOIN ce b ON b.src = v AND b.dst = n), "
        "q AS (SELECT id, i, v, seq, CASE WHEN right(v, 1) = '-' THEN coalesce(se, 0) ELSE coalesce(ts, 0) END AS s, CASE WHEN right(v, 1) = '-' THEN coalesce(te, len(seq)) ELSE coalesce(ss, len(seq)) END AS e FROM m), "
        f"r AS (SELECT id, i, CASE WHEN right(v, 1) = '-' THEN {RCD.format('substring(seq, s + 1, greatest(0, e - s))')} ELSE substring(seq, s + 1, greatest(0, e - s)) END AS part FROM q) SELECT id, string_agg(part, '' ORDER BY i) AS seq FROM r GROUP BY id"
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "paf",
)
def stitched_backbones(paf):
    """Middle parts are cut on both sides."""
    edges = best(paf)
    return layout.stitched(paths.backbones(edges), edges, sequences_of(paf))


# Correction with insertions and deletions.

LIMITS = {"indel": 2, "identity": 0.8, "most": 60}


def strands(reads: DataFrame) -> DataFrame:
    return correction.both_strands(kmers.code_spectrum(reads, K), K)


@query()
def corrected_gaps(reads):
    return correction.correct(reads.select("read_id", "seq"), strands(reads), K, 2, least=3, **LIMITS)


@query()
def corrected_by_falls(reads):
    """Each read by its own threshold: where its coverages fall by half."""
    return correction.correct_reads(reads.select("read_id", "seq"), strands(reads), K, 2, 0.5, 0.1, **LIMITS)


@query()
def corrected_pairs(reads):
    """The two halves of each read as mates."""
    n = F.floor(C("len") / 2).cast("int")
    pairs = reads.select("name", F.left("seq", n).alias("left"), F.substring(C("seq"), n + 1, C("len")).alias("right"))
    return correction.correct_pairs(pairs, strands(reads), K, 2, 0.5, 0.1, **LIMITS)


@query()
def corrected_long_reads(reads):
    return correction.correct_long(reads.select("read_id", "seq"), strands(reads), K, 2, 200, 0.5, 0.1, **LIMITS)


# Overlaps from the sequences themselves.


@query()
def seeded_overlaps(reads):
    return seeding.seeded_overlaps(reads.select("name", "seq"), 15, 5, 200, 500, 3, 60)


@query()
def long_read_layout(reads):
    """Reads laid out by their own overlaps."""
    return stages.long_read_layout(reads.select("name", "seq"), 15, 5, 60, 20).select("name", "seq", "n_reads", F.array_join("path", ",").alias("path"))


# Clusters of bounded size.

DUCK_NEAR = "nr AS (SELECT a, b, max(s) AS score FROM (SELECT name, other, max(nmatch) AS s, least(name, other) AS a, greatest(name, other) AS b, row_number() OVER (PARTITION BY name ORDER BY max(nmatch) DESC, other) AS k FROM (SELECT qname AS name, tname AS other, nmatch FROM paf WHERE qname <> tname UNION ALL SELECT tname, qname, nmatch FROM paf WHERE qname <> tname) GROUP BY name, other) WHERE k <= 2 GROUP BY a, b)"


@query(PAF + f", {DUCK_NEAR} SELECT a, b, score FROM nr", "paf")
def best_pairs(paf):
    return clusters.best_pairs(paf, 2)


@query(source="paf")
def read_clusters(paf):
    """Sequences clustered by their two best neighbours, at most 20 where clusters meet."""
    return clusters.bounded_clusters(clusters.best_pairs(paf, 2), 20)


@query(source="intervals")
def interval_clusters(intervals):
    """The same of intervals by how far they overlap."""
    e = interval_edges(intervals)
    pairs = e.select(layout.name_of(C("src")).alias("a"), layout.name_of(C("dst")).alias("b"), layout.size().alias("score"))
    return clusters.bounded_clusters(pairs, 12)


# Tails: the overlaps of an order with one query are those of one read; every second order has a tail. Every third target has a tail,
# every fifth a head, and every seventh lacks its reverse, the one behind it its forward strand.

NUMBER = "CAST(substring({0}, 2, length({0}) - 2) AS INT)"
DUCK_TAILS = f"""vx AS (SELECT v FROM (SELECT src AS v FROM ce UNION SELECT dst FROM ce) WHERE {NUMBER.format('v')} % 7 <> CASE WHEN right(v, 1) = '-' THEN 0 ELSE 1 END),
st AS (SELECT left(v, length(v) - 1) AS tname, count(*) AS k, bool_or(right(v, 1) = '+') AS fw FROM vx GROUP BY 1),
hs AS (SELECT paf.*, qname || ':' || oid AS rd, CAST(substring(tname, 2) AS INT) AS x, k, fw FROM paf LEFT JOIN st USING (tname) WHERE oid % 2 = 0),
lost AS (SELECT DISTINCT rd FROM hs WHERE ((qstart <= {CLIP} AND qlen - qend <= {CLIP}) OR (tstart <= {CLIP} AND tlen - tend <= {CLIP})) AND qend >= qlen AND CASE WHEN k = 1 THEN x % 3 = 0 AND tend < tlen - 40 WHEN fw THEN true ELSE x % 3 <> 0 OR x % 5 = 0 END),
ss AS (SELECT * FROM hs ANTI JOIN lost USING (rd) WHERE qstart <= {CLIP} AND CASE WHEN strand = '+' THEN tstart > qstart AND tlen - tend < qlen - qend AND tlen - tend <= {CLIP} ELSE qlen - qend > tstart AND tlen - tend > qstart AND tstart <= {CLIP} END),
ts AS (SELECT tname AS name, coalesce(max((tend - tstart) / tlen) FILTER (strand = '+'), 0) AS forward, coalesce(max((tend - tstart) / tlen) FILTER (strand = '-'), 0) AS reverse FROM ss GROUP BY tname)"""


def scores_of(paf: DataFrame, edges: DataFrame) -> DataFrame:
    reads = paf.withColumn("qname", F.concat("qname", F.lit(":"), C("oid").cast("string")))
    tailed = reads.where(C("oid") % 2 == 0).select(C("qname").alias("name"))
    v = edges.select(F.explode(F.array("src", "dst")).alias("vertex")).distinct()
    x = F.substring(layout.name_of(C("vertex")), 2, 9).cast("int")
    v = v.where(x % 7 != F.when(F.right("vertex", F.lit(1)) == "-", 0).otherwise(1))
    y, names = F.substring("name", 2, 9).cast("int"), paf.select(C("tname").alias("name"), C("tlen").alias("n")).distinct()
    region = lambda has, a, b: F.when(has, F.struct(a.alias("start"), b.alias("end")))
    info = names.select("name", region(y % 3 == 0, C("n") - 40, C("n")).alias("tail"), region(y % 5 == 0, F.lit(0), F.lit(40)).alias("head"))
    return tail_scores.tail_scores(reads, tailed, v, info, CLIP)


@query(PAF + f", {BE}, {DUCK_TAILS} SELECT name, round(forward, 6) AS forward, round(reverse, 6) AS reverse FROM ts", "paf")
def tail_scores_of_targets(paf):
    return scores_of(paf, best(paf)).select("name", F.round("forward", 6).alias("forward"), F.round("reverse", 6).alias("reverse"))


@query(
    PAF + f", {BE}, {DUCK_TAILS}, gone AS (SELECT name || CASE WHEN forward > 0 THEN '-' ELSE '+' END AS v FROM ts WHERE (forward > 0) <> (reverse > 0)), kept AS (SELECT src, dst, size FROM ce WHERE src NOT IN (SELECT v FROM gone) AND dst NOT IN (SELECT v FROM gone)), single AS (SELECT {FLIP.format('v')} AS v FROM gone) "
    "SELECT src, dst, size FROM kept WHERE NOT (src IN (SELECT v FROM single) AND dst NOT IN (SELECT v FROM single))",
    "paf",
)
def tail_oriented_edges(paf):
    """Edges pruned by the scores of tails."""
    edges = best(paf)
    return layout.oriented(edges, scores_of(paf, edges)).select("src", "dst", layout.size().alias("size"))


@query()
def tails_of_reads(reads):
    """Every third read with a tail of its own: 30 bases of A behind its last ones (checked by tests)."""
    tail = F.when(C("read_id") % 3 == 0, F.lit("A" * 30)).otherwise(F.lit(""))
    found = tail_scores.tail_info(reads.select("name", F.concat("seq", tail).alias("seq")))
    ends = [C(f"{x}.{e}").alias(f"{x}_{e}") for x in ("tail", "head") for e in ("start", "end")]
    return found.select("name", *ends, "has_signal", "has_signal_rc")


# Artefacts: reads that fold back (every second one gets the mirror of its last half), the first half of a read with the last one of the next
# read, and the first three fifths of a read with the start of the next one's mirror.

DUCK_FOLDED = f"""fd AS (SELECT read_id, seq || {RCD.format('right(seq, len // 2)')} AS seq FROM reads WHERE read_id % 2 = 0 UNION ALL SELECT read_id, seq FROM reads WHERE read_id % 2 <> 0),
fn AS MATERIALIZED (SELECT read_id, i, substring(seq, i + 1, {K}) AS x, (len(seq) - {K - 1}) // 2 AS half FROM (SELECT *, unnest(range(0, len(seq) - {K - 1})) AS i FROM fd)),
fl AS (SELECT DISTINCT read_id, {RCD.format('x')} AS x FROM fn WHERE i < half),
fm AS (SELECT read_id, any_value(half) AS half, min(i) AS least, min(i) FILTER (i >= half) AS first, count(*) FILTER (i >= half) AS n FROM fn SEMI JOIN fl USING (read_id, x) GROUP BY read_id)"""


@query(READ + f", {DUCK_FOLDED}, fs AS (SELECT read_id, n, CASE WHEN first = half THEN least ELSE first END AS start FROM fm WHERE n >= {K}) SELECT read_id, CAST(start AS INT) AS start, n AS n_matched, substring(seq, start + 1) AS seq FROM fs JOIN fd USING (read_id)")
def mirrored_halves(reads):
    mirror = F.reverse(F.translate(F.right("seq", F.floor(C("len") / 2).cast("int")), "ACGT", "TGCA"))
    folded = reads.select("read_id", F.when(C("read_id") % 2 == 0, F.concat("seq", mirror)).otherwise(C("seq")).alias("seq"))
    return artefacts.mirrored_halves(folded, K)


def known_of(reads: DataFrame) -> DataFrame:
    return kmers.held_elsewhere(codes.kmer_codes(reads, K, text=False).where(C("code").isNotNull()), ["code"])


@query()
def chimeric_reads(reads):
    """Known are the k-mers that the reads hold."""
    half = F.floor(C("len") / 2).cast("int")
    other = reads.select((C("read_id") - 1).alias("read_id"), F.substring(C("seq"), half + 1, C("len")).alias("rest"))
    joined = reads.join(other, "read_id").select("read_id", F.concat(F.left("seq", half), "rest").alias("seq"))
    spec = kmers.code_spectrum(reads, K, stranded=True)
    return artefacts.chimeras(joined, spec, spec.select("code"), K, 3)


@query()
def blunt_reads(reads):
    """Known are the k-mers that two reads hold."""
    n = F.floor(C("len") * 0.6).cast("int")
    other = reads.select((C("read_id") - 1).alias("read_id"), F.reverse(F.translate(F.left("seq", F.lit(10)), "ACGT", "TGCA")).alias("rest"))
    joined = reads.join(other, "read_id").select("read_id", F.concat(F.left("seq", n), "rest").alias("seq"))
    spec = kmers.code_spectrum(reads.select("seq").union(joined.select("seq")), K, stranded=True)
    return artefacts.blunt_ends(joined, spec, known_of(reads), K, 8, PAIR_DISTANCE)
