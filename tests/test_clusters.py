"""Clusters of bounded size and tail scores against loops."""

import random

import pytest

from seqframe.operators.clusters import best_pairs, bounded_clusters
from seqframe.operators.tail_scores import tail_info, tail_scores


def clusters(pairs, limit):
    of = {}
    best = {}
    for a, b, s in pairs:
        if a is not None and b is not None and a != b:
            k = (min(a, b), max(a, b))
            best[k] = max(best.get(k, s), s)
    for (a, b), _ in sorted(best.items(), key=lambda x: (-x[1], x[0])):
        p, q = of.get(a), of.get(b)
        if p is None and q is None:
            of[a] = of[b] = {a, b}
        elif p is None or q is None:
            c = q if p is None else p
            c |= {a, b}
            of[a] = of[b] = c
        elif p is not q and len(p) + len(q) < limit:
            p |= q
            for x in q:
                of[x] = p
    return sorted((x, min(c), len(c)) for x, c in of.items())


@pytest.mark.parametrize(("seed", "n", "m", "limit"), [(1, 60, 150, 9), (2, 40, 60, 1000), (3, 50, 200, 1)])
def test_bounded_clusters(spark, seed, n, m, limit):
    rng = random.Random(seed)
    name = lambda: f"r{min(rng.randrange(n), rng.randrange(n)):03}"
    pairs = [(name(), name(), rng.randrange(30)) for _ in range(m)] + [("hub", f"r{i:03}", 29 - i % 7) for i in range(0, n, 3)] + [(None, "r001", 5), ("r002", None, 5)]
    df = spark.createDataFrame(pairs, "a string, b string, score int")
    got = [tuple(r) for r in bounded_clusters(df, limit).collect()]
    assert sorted(got) == clusters(pairs, limit)
    assert bounded_clusters(df.limit(0), limit).count() == 0


def test_best_pairs(spark):
    rows = [("a", "b", 9), ("a", "c", 8), ("a", "d", 7), ("d", "a", 7), ("e", "e", 99), ("c", "b", 8)]
    got = best_pairs(spark.createDataFrame(rows, "qname string, tname string, nmatch int"), 1).collect()
    assert sorted(map(tuple, got)) == [("a", "b", 9), ("a", "c", 8), ("a", "d", 7)]


PAF = "qname string, qlen int, qstart int, qend int, strand string, tname string, tlen int, tstart int, tend int"


def test_tail_scores(spark):
    rows = [
        ("r1", 100, 0, 60, "+", "one", 200, 140, 200),  # its start covers the target's end
        ("r1", 100, 0, 50, "+", "both", 100, 50, 100),
        ("r2", 100, 0, 60, "-", "one", 120, 0, 60),
        ("r3", 100, 0, 60, "+", "one", 120, 60, 120),  # contained elsewhere: doesn't count
        ("r3", 100, 0, 100, "+", "both", 400, 100, 200),
        ("r4", 100, 0, 80, "+", "orphan", 160, 80, 160),
        ("r4", 100, 0, 100, "+", "single", 400, 250, 350),  # behind the start of a true tail
        ("r5", 100, 0, 60, "+", "one", 60, 0, 60),  # no tail
        ("r6", 100, 0, 60, "+", "late", 120, 60, 120),
        ("r6", 100, 0, 100, "+", "single", 400, 100, 200),  # before the tail
    ]
    tailed = spark.createDataFrame([(f"r{i}",) for i in (1, 2, 3, 4, 6)], "name string")
    vertices = spark.createDataFrame([(v,) for v in ("one+", "both+", "both-", "single-")], "vertex string")
    info = spark.createDataFrame([("single", (300, 400), None), ("one", (190, 200), None)], "name string, tail struct<start:int,end:int>, head struct<start:int,end:int>")
    got = {r["name"]: (round(r["forward"], 3), round(r["reverse"], 3)) for r in tail_scores(spark.createDataFrame(rows, PAF), tailed, vertices, info, 5).collect()}
    assert got == {"one": (0.3, 0.5), "both": (0.5, 0.0), "orphan": (0.5, 0.0)}
    skip = spark.createDataFrame([("one",)], "name string")
    assert {r["name"] for r in tail_scores(spark.createDataFrame(rows, PAF), tailed, vertices, info, 5, skip).collect()} == {"both", "orphan"}


def test_tail_info(spark):
    body = "CGTCGGTCACGTGCAGTGCCTGACGTGACTGTCAGTCGATCGGCTAGCTG" * 2
    rows = [("tail", body + "AATAAA" + "CGTGCTCGGTCCTGT" + "A" * 30), ("head", "T" * 30 + body), ("none", body), ("empty", ""), ("null", None)]
    got = {r["name"]: r for r in tail_info(spark.createDataFrame(rows, "name string, seq string")).collect()}
    assert set(got) == {"tail", "head"}
    assert got["tail"]["has_signal"] and not got["tail"]["has_signal_rc"] and got["tail"]["head"] is None
    assert not got["head"]["has_signal"] and got["head"]["tail"] is None
