"""Named queries over reads: bases, hashes, membership and coverage, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import bases as B
from .functions import codes, hashing, tails
from .functions import sequence as S
from .operators import coverage, kmers, membership
from .plans.fixtures import K
from .queries import COVS, DUCK_PAIRS, IV, KM, MOTIFS, PAIR_DISTANCE, QUARTS, RC, READ, query, sample_quartiles

C = F.col
RCS = RC.format

# Bases.


@query(READ + "SELECT read_id, len > 0 AND replace(seq, substring(seq, 1, 1), '') = '' AS homopolymer, regexp_matches(seq, 'A{5,}|C{5,}|G{5,}|T{5,}') AS has_run FROM reads")
def homopolymers(reads):
    return reads.select("read_id", B.is_homopolymer(C("seq")).alias("homopolymer"), B.has_homopolymer(C("seq"), 5).alias("has_run"))


@query(READ + f"SELECT read_id, right(seq, 3) = {RCS('left(seq, 3)')} AS mirrored FROM reads WHERE len >= 3")
def mirrored_ends(reads):
    return reads.where(C("len") >= 3).select("read_id", B.is_reverse_complement(F.left("seq", F.lit(3)), F.right("seq", F.lit(3))).alias("mirrored"))


@query(READ + "SELECT read_id, regexp_matches(seq, '^T{2,}|A{2,}$') AS tailed, len >= 10 AND len(replace(translate(left(seq, 10), 'ACG', '   '), ' ', '')) >= floor(0.4 * 10 + 0.5) AND len(replace(translate(right(seq, 10), 'CGT', '   '), ' ', '')) >= floor(0.4 * 10 + 0.5) AS double_tailed FROM reads")
def tail_chimeras(reads):
    return reads.select("read_id", B.tail_or_head(C("seq"), 2).alias("tailed"), B.is_double_tailed(C("seq"), 10, 0.4).alias("double_tailed"))


N = {b: f"(len(seq) - len(replace(seq, '{b}', '')))" for b in "ACGT"}
TWO = "greatest(" + ", ".join(f"{N[a]} + {N[b]}" for i, a in enumerate("ACGT") for b in "ACGT"[i + 1 :]) + ")"


@query(READ + f"SELECT read_id, CAST({TWO} AS BIGINT) AS content, len > 0 AND {TWO} >= 0.6 * len AS two_based FROM reads")
def two_base_reads(reads):
    return reads.select("read_id", B.two_base_content(C("seq")).cast("long").alias("content"), B.is_two_based(C("seq"), 0.6).alias("two_based"))


@query(READ + "SELECT read_id, left(seq, 4) || '...' || right(seq, 4) AS summary, len >= 20 AND regexp_matches(substring(seq, 11, 10), '[^ACGTUacgtu]') AS invalid FROM reads")
def head_tail_summary(reads):
    bad = (C("len") >= 20) & B.invalid_within(C("seq"), F.lit(10), F.lit(20))
    return reads.select("read_id", B.head_and_tail(C("seq"), 4).alias("summary"), bad.alias("invalid"))


PACK = "upper(array_to_string(list_transform(range(0, (len + 3) // 4), lambda j: format('{:02x}', list_sum(list_transform(range(0, 4), lambda i: CASE substring(seq, CAST(4 * j + i + 1 AS BIGINT), 1) WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 0 END * CAST(power(4, 3 - i) AS INT)))::INT)), ''))"


@query(READ + f"SELECT read_id, {PACK} AS packed, seq AS unpacked, {RCS('substring(seq, 6, 15)')} AS part FROM reads")
def packed_reads(reads):
    p = reads.select("read_id", "len", B.pack(C("seq")).alias("p"))
    return p.select("read_id", F.hex("p").alias("packed"), B.unpack(C("p"), C("len")).alias("unpacked"), B.unpack_range(C("p"), F.least(F.lit(5), "len"), F.least(F.lit(20), "len"), reverse=True).alias("part"))


@query(READ + "SELECT read_id, b AS base, b || substring(seq, 1, 10) AS shifted_right, substring(seq, 2, 10) || b AS shifted_left FROM reads, (SELECT unnest(['A', 'C', 'G', 'T']) AS b) WHERE len >= 11 AND b <> substring(seq, 6, 1)")
def shifted_kmers(reads):
    k = reads.where(C("len") >= 11).select("read_id", F.left("seq", F.lit(11)).alias("k"), F.explode(B.alternatives(F.substring("seq", 6, 1))).alias("base"))
    return k.select("read_id", "base", B.shift_right(C("k"), C("base")).alias("shifted_right"), B.shift_left(C("k"), C("base")).alias("shifted_left"))


@query(KM + COVS + ", s AS (SELECT read_id, list_extract(l, 1) AS a, list_extract(l, len(l)) AS z, len(l) AS n FROM covs), t AS (SELECT *, " + ", ".join("CASE WHEN {0} = 1 THEN 0 ELSE 1 + ".replace("{0}", c) + " + ".join(f"CASE WHEN {c} >= {10**i} THEN 1 ELSE 0 END" for i in range(1, 6)) + f" END AS i{c}" for c in "az") + f" FROM s) SELECT read_id, CAST(ia AS INT) AS first_index, CAST(iz AS INT) AS last_index, ia < iz AS lower, CAST(n + {K} - 1 AS INT) AS len FROM t")
def strata_of_ends(reads):
    name = lambda c: F.when(C(c) == 1, "01").otherwise(F.concat(F.lit("e"), S.order_of_magnitude(C(c)).cast("string")))
    cov = kmers.covered(reads, K, text=False).groupBy("read_id").agg(F.min_by("cov", "pos").alias("a"), F.max_by("cov", "pos").alias("z"), F.count(F.lit(1)).alias("n"))
    named = cov.select("read_id", name("a").alias("a"), name("z").alias("z"), "n").where(B.is_stratum(C("a")))
    return named.select("read_id", B.stratum_index(C("a")).alias("first_index"), B.stratum_index(C("z")).alias("last_index"), B.is_lower_stratum(C("a"), C("z")).alias("lower"), B.length_of(C("n"), K).cast("int").alias("len"))


@query(READ + f", {QUARTS} SELECT read_id, CASE WHEN len <= q1 THEN 0 WHEN len <= median THEN 1 WHEN len <= q3 THEN 2 ELSE 3 END AS stratum FROM reads JOIN q USING (sample) WHERE len >= {K}")
def length_strata(reads):
    return reads.where(C("len") >= K).join(sample_quartiles(reads), "sample").select("read_id", B.length_stratum(C("len"), C("q1"), C("median"), C("q3")).alias("stratum"))


@query(READ + "SELECT read_id, CASE WHEN gc = 0 THEN 0.0 ELSE round(gc * 100 * power(10, 2 - floor(log10(gc * 100)))) / power(10, 2 - floor(log10(gc * 100))) END AS gc_percent FROM (SELECT read_id, (len(seq) - len(replace(replace(seq, 'G', ''), 'C', ''))) / len(seq) AS gc FROM reads WHERE len > 0)")
def gc_percent(reads):
    return reads.where(C("len") > 0).select("read_id", B.percent(S.gc_count(C("seq")) / C("len")).alias("gc_percent"))


UP = f"regexp_matches(substring(seq, CAST(greatest(0, len - 60) + 1 AS BIGINT), CAST(greatest(0, len - 5 - greatest(0, len - 60)) AS BIGINT)), '{'|'.join(S.PAS_MOTIFS)}')"
FLIPPED = "|".join(m[::-1].translate(str.maketrans("ACGT", "TGCA")) for m in S.PAS_MOTIFS)


@query(READ + f"SELECT read_id, {UP} AS upstream, regexp_matches(substring(seq, 6, 55), '{FLIPPED}') AS downstream FROM reads")
def signal_windows(reads):
    return reads.select("read_id", B.signal_upstream(C("seq"), C("len")).alias("upstream"), B.signal_downstream(C("seq"), F.lit(0)).alias("downstream"))


MATES = "mates AS (SELECT read_id, left(seq, CAST(floor(len * 0.6) AS BIGINT)) AS l, right(seq, CAST(floor(len * 0.6) AS BIGINT)) AS r FROM reads)"


def mates_of(reads: DataFrame) -> DataFrame:
    """The first and the last three fifths of each read as mates: the fixture of pairs."""
    n = F.floor(C("len") * 0.6).cast("int")
    return reads.select("read_id", F.left("seq", n).alias("l"), F.right("seq", n).alias("r"))


@query(READ + f", {MATES}, o AS (SELECT read_id, l, r, list_filter(range(4, len(l) + 1), lambda n: right(l, n) = left(r, n)) AS ns FROM mates) SELECT read_id, CAST(list_max(ns) AS INT) AS longest, CAST(list_min(ns) AS INT) AS shortest, CASE WHEN contains(l, r) THEN l WHEN contains(r, l) THEN r ELSE l || substring(r, list_max(ns) + 1) END AS merged FROM o")
def mate_overlap(reads):
    m = mates_of(reads)
    return m.select("read_id", B.longest_overlap(C("l"), C("r"), 4).alias("longest"), B.shortest_overlap(C("l"), C("r"), 4).alias("shortest"), B.merge_overlapping(C("l"), C("r"), 4).alias("merged"))


@query(KM + ", r AS (SELECT read_id, count(*) AS n, count(DISTINCT kmer) AS d FROM kmers GROUP BY read_id) SELECT read_id, d < floor(n * 0.98 + 0.5) AS repeat FROM r")
def repeat_sequences(reads):
    return reads.where(C("len") >= K).select("read_id", B.distinct_fraction_below(S.kmers(C("seq"), K), 0.98).alias("repeat"))


@query(IV + ", p AS (SELECT a.event_id AS id1, b.event_id AS id2, a.start_pos AS s1, a.end_pos AS e1, b.start_pos AS s2, b.end_pos AS e2 FROM intervals a JOIN intervals b ON a.name = b.name AND a.event_id < b.event_id AND a.start_pos < b.end_pos AND b.start_pos < a.end_pos) SELECT id1, id2, (s1 >= s2 AND e1 <= e2) OR (s2 >= s1 AND e2 <= e1) AS contained, s1 < s2 AND e1 < e2 AS forward, (s1 < s2 AND e1 < e2) OR (s2 < s1 AND e2 < e1) AS dovetail FROM p", "intervals")
def interval_relations(rows):
    from .operators import intervals

    r = rows.select("name", C("event_id").alias("id"), C("start_pos").alias("s"), C("end_pos").alias("e"))
    pairs = intervals.overlap_join(r, r, "name", 256).where(C("id1") < C("id2")).select("id1", "id2")
    for i in "12":
        pairs = pairs.join(r.select(C("id").alias(f"id{i}"), C("s").alias(f"s{i}"), C("e").alias(f"e{i}")), f"id{i}")
    four = (C("s1"), C("e1"), C("s2"), C("e2"))
    return pairs.select("id1", "id2", B.contains_interval(*four).alias("contained"), B.forward_dovetail(*four).alias("forward"), B.any_dovetail(*four).alias("dovetail"))


# Hashes. SQL computes in 128 bits and cuts to 64.

MASK = "18446744073709551615::HUGEINT"
SIGN = "CASE WHEN {0} >= 9223372036854775808::HUGEINT THEN {0} - 18446744073709551616::HUGEINT ELSE {0} END"
SEED = "CASE substring({0}, {1}, 1) WHEN 'A' THEN {A} WHEN 'C' THEN {C} WHEN 'G' THEN {G} ELSE {T} END::HUGEINT"


def duck_hash(kmer: str, back: bool = False) -> str:
    seeds = {b: str(hashing.SEEDS[b.translate(str.maketrans("ACGT", "TGCA")) if back else b]) for b in "ACGT"}
    out = []
    for i in range(K):
        n = i if back else K - 1 - i
        x = "(" + SEED.replace("{0}", kmer).replace("{1}", str(i + 1)).format(**seeds) + ")"
        out.append(f"((({x} << {n}) | ({x} >> {64 - n})) & {MASK})" if n else x)
    text = out[0]
    for x in out[1:]:
        text = f"xor({text}, {x})"
    return text


def duck_signed(x: str) -> str:
    return f"CAST({SIGN.replace('{0}', x)} AS BIGINT)"


DUCK_HASH = f", hk AS MATERIALIZED (SELECT kmer, {duck_hash('kmer')} AS f, {duck_hash('kmer', True)} AS r FROM (SELECT DISTINCT kmer FROM kmers)), hs AS MATERIALIZED (SELECT read_id, pos, f, r, {duck_signed('f')} AS sf, {duck_signed('r')} AS sr FROM kmers JOIN hk USING (kmer))"
#: The second hash: (base * m) mod 2^64 in two halves, as 128 bits hold no product of two 64-bit numbers.
M1 = (1 ^ (K * hashing.MANY_SEED)) & (1 << 64) - 1
PROD = f"((((c >> 32) * {M1}::HUGEINT & 4294967295::HUGEINT) << 32) + (c & 4294967295::HUGEINT) * {M1}::HUGEINT) & {MASK}"


@query(KM + DUCK_HASH + f", h AS (SELECT read_id, pos, sf, sr, least(sf, sr) AS h0, CASE WHEN sf <= sr THEN f ELSE r END AS c FROM hs), p AS (SELECT *, {PROD} AS t FROM h), q AS (SELECT *, xor(t, t >> 27) AS u FROM p) SELECT read_id, pos, sf AS ahead, sr AS back, h0, {duck_signed('u')} AS h1 FROM q")
def rolling_hashes(reads):
    return hashing.hash_rows(reads, K, 2)


def duck_combine(a: str, b: str) -> str:
    return f"xor({a}, ({b} + {hashing.COMBINE} + (({a} << 6) & {MASK}) + ({b} >> 2)) & {MASK})"


@query(KM + DUCK_HASH + f", w AS (SELECT read_id, pos, f, r, lead(f, {PAIR_DISTANCE}) OVER (PARTITION BY read_id ORDER BY pos) AS f2, lead(r, {PAIR_DISTANCE}) OVER (PARTITION BY read_id ORDER BY pos) AS r2 FROM hs), c AS (SELECT read_id, pos, {duck_combine('f', 'f2')} AS x, {duck_combine('r2', 'r')} AS y FROM w WHERE f2 IS NOT NULL) SELECT read_id, pos, least({duck_signed('x')}, {duck_signed('y')}) AS hash FROM c")
def pair_hashes(reads):
    return hashing.pair_hash_rows(reads, K, PAIR_DISTANCE)


W_MIN, W_MAX = 4, 12


@query(KM + DUCK_HASH + f", l AS (SELECT a.read_id, a.pos, b.pos AS p2, {duck_combine('a.f', 'b.f')} AS h FROM hs a JOIN hs b ON a.read_id = b.read_id AND b.pos BETWEEN a.pos + {W_MIN} AND a.pos + {W_MAX - 1}), m AS (SELECT read_id, pos, min(h) AS h FROM l GROUP BY ALL) SELECT read_id, pos AS start, max(p2) + {K} AS \"end\", {duck_signed('any_value(m.h)')} AS hash FROM m JOIN l USING (read_id, pos, h) GROUP BY ALL")
def strobemers(reads):
    return hashing.strobemer_rows(reads, K, 2, W_MIN, W_MAX)


# Membership.


@query(KM + ", f AS (SELECT ckmer, min(read_id) AS first FROM kmers GROUP BY ckmer) SELECT read_id, count(*) AS n, count(*) FILTER (first < read_id) AS n_seen, bool_and(first < read_id) AS represented FROM kmers JOIN f USING (ckmer) GROUP BY read_id")
def seen_kmers(reads):
    return membership.all_seen_before(codes.kmer_codes(reads, K, text=False).select("read_id", "ccode"), ["ccode"])


@query(KM + DUCK_PAIRS + ", f AS (SELECT l, r, min(read_id) AS first FROM pm GROUP BY ALL) SELECT read_id, count(*) AS n, count(*) FILTER (first < read_id) AS n_seen, bool_and(first < read_id) AS represented FROM pm JOIN f USING (l, r) GROUP BY read_id")
def seen_kmer_pairs(reads):
    return membership.all_seen_before(codes.pair_codes(reads, K, PAIR_DISTANCE, id_col="read_id"), ["left", "right"])


@query(KM + ", o AS (SELECT read_id, pos, row_number() OVER (PARTITION BY ckmer ORDER BY read_id, pos) AS nth FROM kmers) SELECT read_id, max(nth) AS most, min(nth) AS least FROM o GROUP BY read_id")
def running_kmer_counts(reads):
    n = membership.running_count(codes.kmer_codes(reads, K, text=False), ["ccode"], ["read_id", "pos"])
    return n.groupBy("read_id").agg(F.max("nth").alias("most"), F.min("nth").alias("least"))


@query(KM + "SELECT CAST(level AS INT) AS level, count(*) AS n_keys FROM (SELECT unnest(range(0, least(cov, 5))) AS level FROM spectrum) GROUP BY level")
def count_levels(reads):
    return membership.levels(kmers.code_spectrum(reads, K), 5)


@query(KM + ", first AS (SELECT ckmer FROM (SELECT ckmer, min(read_id) AS m, max(read_id) AS x FROM kmers GROUP BY ckmer) WHERE m <> x) SELECT ckmer AS kmer, count(*) AS n FROM kmers SEMI JOIN first USING (ckmer) GROUP BY ckmer")
def count_present(reads):
    rows = codes.kmer_codes(reads, K, text=False).select("read_id", C("ccode").alias("code"))
    return kmers.decoded(membership.count_if_present(rows, kmers.held_elsewhere(rows, ["code"]), "code"), K, code="kmer")


SIZE = "CAST(ceil(n * (-{h} / ln(1 - exp(ln({r}) / {h})))) AS BIGINT)"


@query(KM + ", n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM spectrum) SELECT " + ", ".join(f"{SIZE.format(h=h, r=r)} AS bits_{h}" for h, r in ((1, 0.01), (2, 0.01), (3, 0.05))) + " FROM n")
def filter_sizes(reads):
    n = kmers.code_spectrum(reads, K).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return n.select(*[membership.expected_size(C("n"), r, h).alias(f"bits_{h}") for h, r in ((1, 0.01), (2, 0.01), (3, 0.05))])


BITS = 1 << 16


@query(KM + DUCK_HASH + f", h AS (SELECT DISTINCT CASE WHEN sf <= sr THEN f ELSE r END AS c FROM hs), p AS (SELECT c, {PROD} AS t FROM h), q AS (SELECT c, xor(t, t >> 27) AS u FROM p), b AS (SELECT DISTINCT bit FROM (SELECT (c >> 1) % {BITS} AS bit FROM q UNION ALL SELECT (u >> 1) % {BITS} FROM q)) SELECT count(*) AS set_bits, round(power(count(*) / {BITS}, 2), 6) AS rate FROM b")
def bloom_filter_rate(reads):
    words = membership.bloom_words(hashing.hash_rows(reads, K, 2), ["h0", "h1"], BITS)
    n = words.agg(F.sum(F.bit_count("bits")).cast("long").alias("set_bits"))
    return n.select("set_bits", F.round(membership.false_positive_rate(C("set_bits"), F.lit(BITS), 2), 6).alias("rate"))


HIST = ", hist AS (SELECT cov AS m, count(*) AS c FROM spectrum GROUP BY cov)"


@query(KM + HIST + ", v AS (SELECT min(a.m) AS valley FROM hist a LEFT JOIN hist b ON b.m = a.m - 1 WHERE a.m > 1 AND a.c * 2 > coalesce(b.c, 0)), t AS (SELECT max(m) AS top FROM (SELECT m, sum(c) OVER (ORDER BY m DESC) AS s, sum(c) OVER () AS n FROM hist) WHERE s >= 0.1 * n) SELECT valley, top FROM v, t")
def histogram_thresholds(reads):
    hist = kmers.histogram(kmers.code_spectrum(reads, K))
    low, high = membership.valley(hist, 2), membership.top_share(hist, 0.1)
    return low.select(C("threshold").alias("valley")).join(F.broadcast(high.select(C("threshold").alias("top"))))


# Coverage.


@query(KM + "SELECT read_id, count(*) AS n, min(cov) AS min_cov, CAST(median(cov) AS DOUBLE) AS med_cov FROM cov WHERE pos >= 5 AND pos < 50 GROUP BY read_id")
def range_coverage(reads):
    return coverage.within(kmers.covered(reads, K, text=False), 5, 50)


@query(KM + ", w AS (SELECT read_id, pos, pos - row_number() OVER (PARTITION BY read_id ORDER BY pos) AS g FROM cov WHERE cov >= 4), r AS (SELECT read_id, min(pos) AS start, max(pos) AS \"end\", count(*) AS n FROM w GROUP BY read_id, g) SELECT read_id, start, \"end\", n FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY n DESC, start) AS k FROM r) WHERE k = 1")
def longest_covered_run(reads):
    return coverage.longest_covered(kmers.covered(reads, K, text=False), 4)


@query(KM + f", s AS (SELECT ckmer FROM kmers GROUP BY ckmer HAVING min(read_id) <> max(read_id)), w AS (SELECT read_id, pos, pos - row_number() OVER (PARTITION BY read_id ORDER BY pos) AS g FROM kmers SEMI JOIN s USING (ckmer)), r AS (SELECT read_id, min(pos) AS start, count(*) AS n FROM w GROUP BY read_id, g) SELECT read_id, start, substring(seq, start + 1, n + {K - 1}) AS seq FROM r JOIN reads USING (read_id)")
def valid_kmer_sequences(reads):
    """What other reads have too, as sequences."""
    rows = codes.kmer_codes(reads, K, text=False).select("read_id", "pos", C("ccode").alias("code"))
    known = kmers.held_elsewhere(rows, ["code"]).withColumn("cov", F.lit(1).cast("long"))
    return coverage.valid_sequences(kmers.covered(reads, K, known, text=False), reads, K)


HPCS = "hp AS (SELECT read_id, array_to_string(list_filter(list_transform(range(1, len + 1), lambda i: CASE WHEN i = 1 OR substring(seq, i, 1) <> substring(seq, i - 1, 1) THEN substring(seq, i, 1) ELSE '' END), lambda c: c <> ''), '') AS seq FROM reads)"


@query(READ + f", {HPCS}, kl AS (SELECT read_id, pos, least(x, {RCS('x')}) AS ckmer FROM (SELECT read_id, unnest(list_transform(range(1, len(seq) - {K} + 2), lambda i: substring(seq, i, {K}))) AS x, unnest(range(1, len(seq) - {K} + 2)) AS pos FROM hp WHERE len(seq) >= {K})) SELECT DISTINCT read_id, m AS minimizer FROM (SELECT read_id, min(ckmer) OVER w AS m, count(*) OVER w AS c FROM kl WINDOW w AS (PARTITION BY read_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)) WHERE c = 10")
def compressed_minimizers(reads):
    return kmers.minimizers(reads.withColumn("seq", S.compress_homopolymers(C("seq"))), K, 10)


@query(KM + "SELECT DISTINCT read_id, ckmer AS kmer, cov FROM cov WHERE cov >= 3")
def covered_kmer_set(reads):
    """Each read's distinct k-mers of a coverage of three or more."""
    return kmers.decoded(kmers.covered(reads, K, text=False).where(C("cov") >= 3).select("read_id", "code", "cov").distinct(), K, code="kmer")


@query(KM + ", d AS (SELECT DISTINCT sample, ckmer FROM kmers JOIN reads USING (read_id)) SELECT sample, ckmer AS kmer FROM (SELECT sample, ckmer, row_number() OVER (PARTITION BY sample ORDER BY md5(ckmer)) AS r FROM d) WHERE r <= 50")
def combined_sketches(reads):
    """The least 50 k-mers by hash of each sample: sketches of its reads, united. Sketches are united in parts first."""
    return kmers.united_sketch(reads, "sample", K, 50)


@query()
def tail_regions(reads):
    """Poly-A tails and poly-T heads with errors (checked by tests)."""
    t, h = tails.tail_region(C("seq")), tails.head_region(C("seq"))
    return reads.select("read_id", t.alias("t"), h.alias("h")).select("read_id", *[C(f"{a}.{b}").alias(f"{n}_{b}") for a, n in (("t", "tail"), ("h", "head")) for b in ("start", "end")])
