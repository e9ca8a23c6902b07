"""Artefacts of assembled sequences against loops."""

import random
from collections import Counter

import pytest

from seqframe.functions.codes import encode
from seqframe.operators import artefacts, extension
from seqframe.tables import Tables

K = 5


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def parts(s):
    return [s[i : i + K] for i in range(len(s) - K + 1)]


def halves(s):
    p = parts(s)
    half = len(p) // 2
    left = {rc(x) for x in p[:half]}
    hits = [i for i in range(half, len(p)) if p[i] in left]
    if len(hits) < K:
        return None
    start = hits[0]
    if start == half:
        start = min(i for i in range(half + 1) if p[i] in left)
    return start, len(hits), s[start:]


class Graph:
    def __init__(self, spec, known, depth):
        self.spec, self.known, self.depth = spec, known, depth

    def next(self, x, right):
        made = [x[1:] + b if right else b + x[:-1] for b in "ACGT"]
        return [m for m in made if m in self.spec]

    def ahead(self, x, right, depth):
        if depth == 1:
            return self.spec[x]
        return min(self.spec[x], max((self.ahead(y, right, depth - 1) for y in self.next(x, right)), default=0))

    def walk(self, x, right, bound):
        out, now = [], x
        for _ in range(bound):
            found = [y for y in self.next(now, right) if y in self.known]
            if not found:
                break
            now = min(found, key=lambda y: (-self.ahead(y, right, self.depth), -self.spec[y], y))
            if now in out or now == x:
                break
            out.append(now)
        return out

    def steps(self, x, right, most, among):
        now = {x}
        for i in range(most):
            now = {y for z in now for y in self.next(z, right) if y in among}
            if not now:
                return i
        return most

    def chimera(self, s):
        p = parts(s)
        if len(p) < 1 or p[0] not in self.known or p[-1] not in self.known:
            return None
        found, i = [], 0
        while i < len(p):
            if p[i] not in self.known:
                j = i
                while p[j + 1] not in self.known:
                    j += 1
                n = j - i + 1
                ahead, back = self.walk(p[i - 1], True, n), self.walk(p[j + 1], False, n)
                found.append((i, j, n <= 2 * K and (p[j + 1] in ahead or p[i - 1] in back or bool(set(ahead) & set(back)))))
                i = j
            i += 1
        first = next((g for g in found if not g[2] or g[1] == len(p) - 2), None)
        if first is None:
            return None
        last = max(g[1] for g in found if not g[2] or g == first)
        a, z = first[0] - 1, last + 1
        if z - a > 2 * K or set(self.walk(p[a], True, 1000)) & set(self.walk(p[z], False, 1000)):
            return None
        return a, z

    def blunt(self, s, edge, distance):
        p = parts(s)
        if not p:
            return None
        on, cov = [x in self.known for x in p], [self.spec.get(x, 0) for x in p]
        median = lambda c: sorted(c)[len(c) // 2] if len(c) % 2 else sum(sorted(c)[len(c) // 2 - 1 : len(c) // 2 + 1]) / 2
        low, high = min(cov[:edge]), min(cov[-edge:])
        if on[0] and (not on[-1] or low > high):
            i = next((i for i, x in enumerate(on) if not x), len(p))
            if i == len(p) or i < len(p) - distance:
                return None
            fine = self.steps(p[-1], True, 99, self.spec) < max(1, edge - 1) and median(cov[:i]) > median(cov[i:]) and self.steps(p[i - 1], True, 99, self.known) >= max(1, len(p) - i - 1)
            return ("right", len(p) - i) if fine else None
        if on[-1] and (not on[0] or low < high):
            j = next((j for j in range(len(p) - 2, -1, -1) if not on[j]), -1)
            if j == -1 or j > distance:
                return None
            fine = self.steps(p[0], False, 99, self.spec) < max(1, edge - 1) and median(cov[j + 1 :]) > median(cov[: j + 1]) and self.steps(p[j + 1], False, 99, self.known) >= max(1, j)
            return ("left", j + 1) if fine else None
        return None


def graph_of(spark, every, known):
    spec = Counter(x for s in every for x in parts(s))
    df = lambda rows, schema: spark.createDataFrame(rows, schema).withColumn("code", encode(artefacts.C("kmer"))).drop("kmer")
    return Graph(spec, known, 3), df(sorted(spec.items()), "kmer string, cov long").select("code", "cov"), df([(x,) for x in sorted(known)], "kmer string")


def test_halves(spark):
    rng = random.Random(5)
    rows = []
    for i in range(80):
        s = "".join(rng.choices("ACGT", k=rng.randrange(10, 60)))
        rows.append((i, s + rc(s[-rng.randrange(5, 50) :]) if i % 2 else s))
    rows += [(90, None), (91, ""), (92, "ACG"), (93, "ACGTN" * 6), (94, "AT" * 20), (95, "ACGTTACGATTACG" + rc("ACGTTACGATTACG"))]
    got = {r["read_id"]: (r["start"], r["n_matched"], r["seq"]) for r in artefacts.mirrored_halves(spark.createDataFrame(rows, "read_id int, seq string"), K).collect()}
    want = {i: h for i, s in rows if i != 93 and (h := halves(s or ""))}
    assert got == want and len(want) > 20 and any(w[0] < len(parts(rows[i][1])) // 2 for i, w in want.items() if i < 80)


@pytest.mark.parametrize("seed", [3, 8])
def test_chimeras(spark, seed):
    rng = random.Random(seed)
    genes = ["".join(rng.choices("ACGT", k=40)) for _ in range(8)]
    known = {x for g in genes for x in parts(g)}
    reads = []
    for _ in range(90):
        a, b = rng.choice(genes), rng.choice(genes)
        s = a[: rng.randrange(10, 40)] + rng.choice(["", "", "A", "CCGTA", "GATTACAGATTACA"]) + b[rng.randrange(0, 30) :]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(s))
            s = s[:at] + rng.choice("ACGT") + s[at + 1 :]
        reads.append(s)
    reads += [genes[0], genes[1][:20] + "T" + genes[1][20:], "", None, "ACG", genes[0][:20] + "N" + genes[2][20:]]
    graph, spec, assembled = graph_of(spark, genes * 2 + [r for r in reads if r and "N" not in r], known)
    df = spark.createDataFrame(list(enumerate(reads)), "read_id int, seq string")
    got = {r["read_id"]: (r["from"], r["to"]) for r in artefacts.chimeras(df, spec, assembled, K, 3).collect()}
    want = {i: c for i, s in enumerate(reads) if (c := graph.chimera(s or ""))}
    assert got == want and 5 < len(want) < 80


@pytest.mark.parametrize(("seed", "edge", "distance"), [(2, 4, 12), (7, 1, 6)])
def test_blunt_ends(spark, seed, edge, distance):
    rng = random.Random(seed)
    genes = ["".join(rng.choices("ACGT", k=50)) for _ in range(6)]
    known = {x for g in genes for x in parts(g)}
    reads = []
    for i in range(100):
        g, n = rng.choice(genes), rng.randrange(15, 45)
        extra = "".join(rng.choices("ACGT", k=rng.randrange(0, 12)))
        reads.append(g[:n] + extra if i % 2 else extra + g[-n:])
    reads += [genes[0], "", None, "ACG", "ACGTA"]
    graph, spec, assembled = graph_of(spark, genes * 3 + [r for r in reads if r], known)
    df = spark.createDataFrame(list(enumerate(reads)), "read_id int, seq string")
    got = {r["read_id"]: (r["side"], r["n_unknown"]) for r in artefacts.blunt_ends(df, spec, assembled, K, edge, distance).collect()}
    want = {i: b for i, s in enumerate(reads) if (b := graph.blunt(s or "", edge, distance))}
    assert got == want and {side for side, _ in want.values()} == {"left", "right"}
    assert artefacts.blunt_ends(df, spec, assembled, K, 0, distance).count() == 0
    assert artefacts.blunt_ends(df.limit(0), spec, assembled, K, edge, distance).count() == 0
    assert artefacts.chimeras(df.limit(0), spec, assembled, K, 3).count() == 0 and artefacts.mirrored_halves(df.limit(0), K).count() == 0


@pytest.mark.parametrize("forward", [True, False])
def test_dead_ends(spark, forward, monkeypatch):
    """Steps that lead on, against a loop; k-mers that go on are written once, not in each round."""
    rng = random.Random(4)
    cycle = "ACGTTGCATC"
    spec = {x for s in ["".join(rng.choices("ACGT", k=20)) for _ in range(2)] for x in parts(s)} | set(parts(cycle + cycle[: K - 1])) | {"A" * K}
    written, plain = [], Tables.keep

    def watched(self, df, name, **named):
        written.append(name)
        return plain(self, df, name, **named)

    df = spark.createDataFrame([(x, 1) for x in sorted(spec)], "kmer string, cov long").select(encode("kmer").alias("code"), "cov")
    coded = {r["kmer"]: r["code"] for r in spark.createDataFrame([(x,) for x in spec], "kmer string").select("kmer", encode("kmer").alias("code")).collect()}
    now, steps = set(spec), dict.fromkeys(spec, 0)
    for i in range(1, 8):
        now = {x for x in spec if any((x[1:] + b if forward else b + x[:-1]) in now for b in "ACGT")}
        steps |= dict.fromkeys(now, i)
    got = {r["code"]: r["steps"] for r in extension.dead_ends(df, K, 7, Tables(spark, "test"), forward).collect()}
    assert got == {coded[x]: n for x, n in steps.items() if n < 7} and max(got.values()) > 2
    assert {r["code"] for r in extension.with_depth(df, K, 5, forward).collect()} == {coded[x] for x, n in steps.items() if n >= 4}
    monkeypatch.setattr(Tables, "keep", watched)
    endless = df.where(df.code.isin([coded[x] for x in parts(cycle + cycle[: K - 1])]))
    assert not extension.dead_ends(endless, K, 50, Tables(spark, "test"), forward).take(1) and written == ["ends_0"]
