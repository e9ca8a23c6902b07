"""Correction by walks against a read at a time."""

import random
from statistics import median

from pyspark.sql import functions as F

from seqframe import tables
from seqframe.operators import correction
from seqframe.operators.kmers import code_spectrum

K, FLOOR, INDEL, IDENTITY, MOST, LEAST = 9, 2, 2, 0.8, 40, 3
COMP = str.maketrans("ACGT", "TGCA")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(seq, cov):
    kmers = [seq[i : i + K] for i in range(len(seq) - K + 1)]
    solid = [cov.get(x, 0) >= LEAST for x in kmers]
    if not any(solid):
        return None

    def walk(x, forward, n):
        out = [x]
        while len(out) <= n:
            tried = [out[-1][1:] + b if forward else b + out[-1][:-1] for b in "ACGT"]
            best = max((t for t in tried if cov.get(t, 0) >= FLOOR), key=lambda t: (cov[t], t), default=None)
            if best is None or best in out:
                break
            out.append(best)
        return out

    fixes, i = [], 0
    while i < len(kmers):
        if solid[i]:
            i += 1
            continue
        z = i
        while z + 1 < len(kmers) and not solid[z + 1]:
            z += 1
        n, l, r = z - i + 1, kmers[i - 1] if i else None, kmers[z + 1] if z + 1 < len(kmers) else None
        made = None
        if n <= MOST:
            a, b = walk(l, True, MOST + INDEL + 1) if l else [], walk(r, False, MOST + INDEL + 1) if r else []
            if l and r:
                if r in a[1:]:
                    made = a[1 : a.index(r)]
                elif l in b[1:]:
                    made = b[1 : b.index(l)][::-1]
                elif meet := next((x for x in b if x in a), None):
                    made = a[1 : a.index(meet) + 1] + b[1 : b.index(meet)][::-1]
            elif l:
                made = a[1 : n + 1] if len(a) > n else None
            else:
                made = b[1 : n + 1][::-1] if len(b) > n else None
        if made is not None and abs(len(made) - n) <= (INDEL if l and r else 0):
            start, end = (i - 1 + K if l else 0), (z + 1 + K if l and r else len(seq) if l else z + 1)
            new = "".join(x[-1] for x in made) + (r[-1] if r else "") if l else "".join(x[0] for x in made)
            old, head = seq[start:end], l or ""
            if new != old and 1 - edits(head + old, head + new) / max(len(head + old), len(head + new)) >= IDENTITY:
                if (l and r) or median(cov[x] for x in made) > median(cov.get(x, 0) for x in kmers[i : z + 1]):
                    fixes.append((start, end, new))
        i = z + 1
    for start, end, new in reversed(fixes):
        seq = seq[:start] + new + seq[end:]
    return (seq, len(fixes)) if fixes else None


def simulated(spark):
    rng = random.Random(12)
    genome = "".join(rng.choices("ACGT", k=500))
    reads = []
    for i in range(160):
        a = rng.randrange(len(genome) - 90)
        s = genome[a : a + 90]
        if i % 3 == 0:
            for _ in range(rng.randint(1, 2)):
                j = rng.randrange(len(s))
                s = s[:j] + rng.choice(["", "A", "C", "GT", "T"]) + s[j + rng.randint(0, 1) :]
        reads.append((i, s))
    reads += [(200, "ACGT"), (201, None), (202, "".join(rng.choices("ACGT", k=50)))]
    df = spark.createDataFrame(reads, "read_id long, seq string")
    spec = correction.both_strands(code_spectrum(df, K), K).cache()
    cov = {r["kmer"]: r["cov"] for r in spec.select(correction.decode(F.col("code"), K).alias("kmer"), "cov").collect()}
    return genome, reads, df, spec, cov


def test_correction(spark):
    genome, reads, df, spec, cov = simulated(spark)
    got = {r["read_id"]: (r["seq"], r["n_fixed"]) for r in correction.correct(df, spec, K, FLOOR, INDEL, IDENTITY, MOST, LEAST).collect()}
    want = {i: x for i, s in reads if s and (x := brute(s, cov))}
    assert got == want
    assert sum(len(s) != len(dict(reads)[i]) for i, (s, _) in got.items()) > 8 and sum(s in genome for s, _ in got.values()) > len(got) * 0.6
    # Thresholds of single reads, of mates and of windows; what they mend lies in the genome.
    own = correction.correct_reads(df, spec, K, FLOOR, 0.5, 0.0, indel=INDEL, identity=IDENTITY, most=MOST).collect()
    assert len(own) > 10 and sum(r["seq"] in genome for r in own) > len(own) * 0.6
    pairs = df.where("read_id < 160").select(F.concat(F.lit("p"), F.floor(F.col("read_id") / 2)).alias("name"), "read_id", "seq")
    pairs = pairs.groupBy("name").agg(F.min_by("seq", "read_id").alias("left"), F.max_by("seq", "read_id").alias("right"))
    before = pairs.collect()
    after = {r["name"]: r for r in correction.correct_pairs(pairs, spec, K, FLOOR, indel=INDEL, identity=IDENTITY, most=MOST).collect()}
    right = lambda rows: sum((r["left"] in genome) + (r["right"] in genome) for r in rows)
    assert len(after) == len(before) and right(after.values()) > right(before) + 10
    long = correction.correct_long(df, spec, K, FLOOR, 40, indel=INDEL, identity=IDENTITY, most=MOST).collect()
    assert len(long) > 10 and sum(r["seq"] in genome for r in long) > len(long) * 0.5


def test_thresholds(spark):
    rows = [(1, c) for c in (9, 8, 7, 3, 1)] + [(2, c) for c in (5, 5, 4, 4)] + [(3, 90), (3, 10), (3, 9), (3, 2)] + [(4, 7)]
    df = spark.createDataFrame(rows, "read_id long, cov long")
    assert {r["read_id"]: r["least"] for r in correction.thresholds(df, 0.5, 0.0).collect()} == {1: 7, 3: 90}
    assert {r["read_id"]: r["least"] for r in correction.thresholds(df, 0.5, 0.25).collect()} == {1: 7, 3: 9}


def test_large_tables_are_merged(spark, monkeypatch):
    """Written tables of codes above the bound don't become broadcasts, however small their files are for the planner."""
    df = spark.range(3000).selectExpr("id AS code", "id % 7 AS cov")
    for bound, merged in ((0, True), (1 << 30, False)):
        monkeypatch.setattr(tables, "BROADCAST", bound)
        kept = tables.Tables(spark, "merged").keep(df, "codes", merge=True)
        met = df.join(kept.select("code", F.col("cov").alias("other")), "code", "left")
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" not in plan) == merged and met.where("cov = other").count() == 3000


def test_coverages_of_weak_runs(spark):
    """Coverages and runs come from one array for each read; a run at an end, one inside, and a read of weak k-mers only."""
    df = spark.createDataFrame([(1, [1, 5, 1, 1, 6]), (2, [1, 1]), (3, [7, 8])], "read_id long, covs array<long>").withColumn("least", F.lit(3))
    got = {(r["read_id"], r["a"], r["z"], tuple(sorted(r["covs"]))) for r in correction.weak_runs(df).collect()}
    assert got == {(1, 0, 0, (1,)), (1, 2, 3, (1, 1)), (2, 0, 1, (1, 1))}


def test_windows(spark):
    """Each window of a long read has its own threshold: a fall, else the median; the windows of a second round begin elsewhere."""
    covs = [20, 21, 22, 3, 20, 20, 4, 4, 5, 1, 4, 4, 6, 6, 6]
    df = spark.createDataFrame([(1, covs), (2, []), (3, [9, 9])], "read_id long, covs array<long>")
    rows = lambda shifted: {(r["read_id"], r["begin"], tuple(r["covs"])): r["least"] for r in correction.windows_of(df, 6, 2, 0.5, 0.0, shifted).collect()}
    assert rows(False) == {(1, 0, tuple(covs[:6])): 20, (1, 6, tuple(covs[6:])): 4, (3, 0, (9, 9)): 9}
    assert rows(True) == {(1, 0, tuple(covs[:9])): 20, (1, 9, tuple(covs[9:])): 4, (3, 0, (9, 9)): 9}


def test_thresholds_along_a_long_read(spark):
    """An error that several reads hold is mended where coverage is high, although the read's other window has a lower threshold."""
    rng = random.Random(8)
    deep, thin = ("".join(rng.choices("ACGT", k=120)) for _ in range(2))
    wrong = lambda s, i: s[:i] + ("A" if s[i] != "A" else "C") + s[i + 1 :]
    reads = [deep] * 30 + [wrong(deep, 60)] * 5 + [thin] * 4 + [wrong(deep, 60) + wrong(thin, 60)]
    df = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")
    spec = correction.both_strands(code_spectrum(df, K), K).cache()
    got = {r["read_id"]: (r["seq"], r["n_fixed"]) for r in correction.correct_long(df, spec, K, FLOOR, 120, indel=INDEL, identity=IDENTITY, most=MOST).collect()}
    assert got == {i: (deep, 1) for i in range(30, 35)} | {39: (deep + thin, 2)}
