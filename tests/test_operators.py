import random

import pytest
from pyspark.sql import functions as F

from seqframe.functions import sequence as S
from seqframe.operators import graph, intervals, kmers, overlaps
from seqframe.operators.components import connected_components
from seqframe.plans.assembly import Config, not_contained, transcripts
from seqframe.sources import fastx


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_sequence_functions(spark):
    assert one(spark, "ACGTUn", S.reverse_complement) == "NAACGT"
    assert one(spark, "AACCGT", S.canonical) == "AACCGT"
    assert one(spark, "ACGTAC", lambda c: S.kmers(c, 4)) == ["ACGT", "CGTA", "GTAC"]
    assert one(spark, "ACG", lambda c: S.kmers(c, 4)) == []
    assert one(spark, "acgtNNNACGTAxAA", lambda c: S.segments(c, 4)) == ["ACGT", "NNN", "ACGTA"]
    assert one(spark, "AACCCGT", S.compress_homopolymers) == "ACGT"
    assert one(spark, "II#I", S.mean_phred) == pytest.approx((40 * 3 + 2) / 4)
    assert one(spark, "ACGTACGTA", lambda c: S.quality_segments(c, F.lit("IIII!IIII"), 20, 4)) == ["ACGT", "N", "CGTA"]
    assert one(spark, [7, 1, 3, 9], S.quartiles, "array<int>").asDict() == {"min": 1, "q1": 2, "median": 5, "q3": 8, "max": 9}
    assert [one(spark, c, S.minifloat, "long") for c in (0, 7, 16, 17, 19, 100)] == [0, 7, 16, 16, 18, 96]
    assert one(spark, 123456.0, lambda c: S.significant(c, 3), "double") == 123000.0


def test_components_and_chains(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = top(a), top(b)
        up[max(p, q)] = min(p, q)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in up}
    line = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "z"), ("z", "x")]
    got = {r["node"]: (r["head"], r["rank"]) for r in graph.chains(spark.createDataFrame(line, "src string, dst string")).collect()}
    assert got == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "x": ("x", 0), "y": ("x", 1), "z": ("x", 2)}
    ring = [(i, (i + 1) % 8) for i in range(8)] + [(20, 21), (21, 20)]
    got = {r["node"]: (r["head"], r["rank"]) for r in graph.chains(spark.createDataFrame(ring, "src long, dst long")).collect()}
    assert got == {i: (0, i) for i in range(8)} | {20: (20, 0), 21: (20, 1)}


def brute_unitigs(counts, k):
    out = {x: [x[1:] + b for b in "ACGT" if x[1:] + b in counts] for x in counts}
    into = {x: [b + x[:-1] for b in "ACGT" if b + x[:-1] in counts] for x in counts}
    nxt = {x: n[0] for x, n in out.items() if len(n) == 1 and len(into[n[0]]) == 1 and n[0] != x}
    starts = set(counts) - set(nxt.values())
    found = set()
    for s in starts:
        seq = s
        while s in nxt:
            s = nxt[s]
            seq += s[-1]
        found.add(seq)
    return found


def test_unitigs_and_transcripts(spark):
    rng = random.Random(5)
    genome = "".join(rng.choices("ACGT", k=300))
    reads = [genome[i : i + 60] for i in range(0, 241, 3)] + ["".join(rng.choices("ACGT", k=40))]
    df = spark.createDataFrame([(r,) for r in reads], "seq string")
    spec = kmers.spectrum(df, 15, stranded=True)
    counts = {r["kmer"]: r["cov"] for r in spec.collect()}
    got = {r["seq"] for r in graph.unitigs(spec, 15).collect()}
    assert got == brute_unitigs(counts, 15)
    rows = transcripts(df, Config(k=15, least_coverage=2, least_length=100)).collect()
    rc = genome[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert len(rows) == 1 and (rows[0]["seq"] in genome or rows[0]["seq"] in rc)


def test_not_contained(spark):
    rows = [("a", "ACGTTGCAAC"), ("b", "GTTGCA"), ("c", "TTTTTTTT"), ("d", "ACGTTGCAAC")]
    assert {r["name"] for r in not_contained(spark.createDataFrame(rows, "name string, seq string"), 4).collect()} == {"a", "c"}


def test_intervals(spark):
    rng = random.Random(2)
    rows = [(f"n{i % 3}", i, s := rng.randrange(100), s + rng.randrange(1, 20)) for i in range(60)]
    df = spark.createDataFrame(rows, "name string, id long, s int, e int")
    got = {(r["id1"], r["id2"]) for r in intervals.overlap_join(df, df, "name", 7).where("id1 < id2").collect()}
    assert got == {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] < b[3] and b[2] < a[3]}
    deep = set()
    for n in ("n0", "n1", "n2"):
        depth = [sum(1 for r in rows if r[0] == n and r[2] <= p < r[3]) for p in range(130)]
        p = 0
        while p < 130:
            q = p
            while q < 130 and depth[q] >= 3:
                q += 1
            if q - p >= 2:
                deep.add((n, p, q))
            p = q + 1
    assert {tuple(r) for r in intervals.depth_runs(df, "name", "s", "e", 3, 2).collect()} == deep


def test_multimap_counts(spark):
    rows = [("q", 0, 100, "a", 200, 0, 100), ("q", 2, 100, "b", 100, 0, 98), ("q", 10, 50, "c", 100, 0, 40), ("q", 200, 300, "a", 200, 100, 200)]
    df = spark.createDataFrame(rows, "qname string, qstart int, qend int, tname string, tlen int, tstart int, tend int")
    got = {r["name"]: round(r["n_reads"], 6) for r in overlaps.multimap_counts(df).collect()}
    assert got == {"a": 0.75, "b": 0.49}


def test_trim_edges(spark):
    df = spark.createDataFrame([(1, [1, 5, 5, 5, 1, 1]), (2, [5, 5]), (3, [1, 1, 1])], "read_id long, covs array<long>")
    got = {r["read_id"]: (r["from"], r["to"]) for r in kmers.trim_edges(df, 3).collect()}
    assert got[1] == (2, 4) and 3 not in got


def test_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">r1/1 first one\nACGT\nAC\n>r2\nGGG\n")
    rows = [tuple(r) for r in fastx.read_fasta(spark, str(tmp_path / "a.fa")).collect()]
    assert rows == [("r1", "first one", "ACGTAC"), ("r2", "", "GGG")]
    fastx.write_fasta(spark.createDataFrame(rows, "name string, comment string, seq string"), str(tmp_path / "out"), uracil=True)
    assert {(r["name"], r["seq"]) for r in fastx.read_fasta(spark, str(tmp_path / "out")).collect()} == {("r1", "ACGUAC"), ("r2", "GGG")}
    (tmp_path / "a.fq").write_text("@r1/1\nACGT\n+\n@III\n@r2\nGG\n+\n!!\n")
    rows = [tuple(r)[1:] for r in fastx.read_fastq(spark, str(tmp_path / "a.fq"), 5).orderBy("record").collect()]
    assert rows == [(0, "r1", "ACGT", "@III"), (1, "r2", "", "!!")]
    (tmp_path / "a.paf").write_text("q\t10\t0\t9\t-\tt\t20\t1\t10\t8\t9\t60\tNM:i:1\tcg:Z:9M\ttp:A:P\n")
    r = fastx.read_paf(spark, str(tmp_path / "a.paf")).first()
    assert (r["qname"], r["nmatch"], r["nm"], r["cigar"], r["is_primary"]) == ("q", 8, 1, "9M", True)
    (tmp_path / "m.txt").write_text("#name left right\ns1 a b\ns1 c d\n")
    assert fastx.read_manifest(spark, str(tmp_path / "m.txt")).count() == 4
    assert fastx.kmer_sizes("25,26,30-55:5") == [25, 26, 30, 35, 40, 45, 50, 55]


def test_best_edges_are_hashed_once(spark):
    """The longest edge of each pair, ties by coordinates, against a loop; the plan doesn't sort the records, and each record is read once."""
    rng = random.Random(3)
    rows = []
    for _ in range(3000):
        qs, ts, n = rng.randrange(0, 90), rng.randrange(0, 90), rng.choice([60, 80, 80, 100])
        rows.append((f"s{rng.randrange(5)}", rng.choice([180, 190]), qs, qs + n, rng.choice("+-"), f"s{rng.randrange(5)}", 185, ts, ts + n + rng.randrange(2)))
    paf = spark.createDataFrame(rows, "qname string, qlen int, qstart int, qend int, strand string, tname string, tlen int, tstart int, tend int")
    other, want = {"+": "-", "-": "+"}, {}
    for q, ql, a, b, strand, t, tl, c, d in rows:
        (head, tail), (th, tt) = (a, ql - b), (c, tl - d)
        if q == t:
            continue
        near, far = (th, tt) if strand == "+" else (tt, th)
        if head > near and tail < far and near <= 50 and tail <= 50:
            made = [(q + "+", t + strand, a, b, c, d), (t + other[strand], q + "-", c, d, a, b)]
        elif near > head and far < tail and head <= 50 and far <= 50:
            made = [(t + strand, q + "+", c, d, a, b), (q + "-", t + other[strand], a, b, c, d)]
        else:
            continue
        for src, dst, *x in made:
            size = x[1] - x[0] + x[3] - x[2]
            want[src, dst] = max(want.get((src, dst), ((-1,), None)), ((size, -x[0], -x[2], x[1]), (*x, size)))
    best = overlaps.best_edges(overlaps.edges(paf, 50))
    assert {(r["src"], r["dst"]): tuple(r)[2:] for r in best.collect()} == {k: v[1] for k, v in want.items()} and len(want) > 30
    plan = best._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert "SortAggregate" not in plan and plan.count("Scan") == 1
