"""Similar sketches against all pairs, and which sequences meet at all."""

import hashlib
import random

from seqframe.operators import kmers
from seqframe.tables import Tables

COMP = str.maketrans("ACGT", "TGCA")


def sketch(s, k, n):
    found = {min(x, x[::-1].translate(COMP)) for x in (s[i : i + k] for i in range(len(s) - k + 1))}
    return set(sorted(found, key=lambda x: hashlib.md5(x.encode()).hexdigest())[:n])


def test_all_pairs(spark):
    rng = random.Random(5)
    base = ["".join(rng.choices("ACGT", k=rng.randint(12, 90))) for _ in range(12)]
    seqs = [s[: rng.randint(5, len(s))] + "".join(rng.choices("ACGT", k=rng.randint(0, 12))) for s in base for _ in range(5)] + base + base[:3] + ["", "ACG", None]
    df = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")
    first = {}
    for i, s in enumerate(seqs):
        first.setdefault(s, i)
    for least, n in ((1, 20), (2, 20), (10, 20), (20, 20), (30, 200)):
        made = sorted((i, sketch(s, 7, n)) for s, i in first.items() if s)
        want = {(a, b, len(x & y)) for a, x in made for b, y in made if a < b and len(x & y) >= least}
        got = kmers.sketch_similarity(df, 7, n, least).collect()
        assert len(got) == len(want) and bool(want) == (least < 20 or n > 20) and {(r["a"], r["b"], r["shared"]) for r in got} == want
        size = {i: len(x) for i, x in made}
        assert all(abs(r["containment"] - r["shared"] / size[r["b"]]) < 1e-9 for r in got)


def test_frequent_kmers_bring_none_together(spark):
    # 200 sketches hold the same three k-mers and two pairs of them four more, which are rarer.
    rows = [(i, ["f0", "f1", "f2"] + [f"r{i}_{j}" if i > 3 else f"p{i // 2}_{j}" for j in range(4)]) for i in range(200)]
    sketches = spark.createDataFrame(rows, "read_id long, s array<string>")
    for least, together in ((4, 1), (4, 2), (5, 2)):
        keys = kmers.unnest(kmers.first_ones(sketches, least, together, Tables(spark, "test")), "keys", "key").collect()
        held = {}
        for r in keys:
            held.setdefault(r["key"], set()).add(r["read_id"])
        met = {(a, b) for x in held.values() for a in x for b in x if a < b}
        assert met == {(0, 1), (2, 3)}


def test_pairs_in_slices(spark, monkeypatch):
    """Pairs that are counted a slice at a time are the same; what is moved are numbers, also for k-mers with other letters."""
    rng = random.Random(7)
    base = ["".join(rng.choices("ACGTN", [9, 9, 9, 9, 1], k=60)) for _ in range(4)]
    df = spark.createDataFrame([(i, base[i % 4][: rng.randint(35, 60)]) for i in range(40)], "read_id long, seq string")
    rows = lambda: sorted(tuple(r) for r in kmers.sketch_similarity(df, 7, 20, 5).collect())
    whole, kept = rows(), {}
    keep = Tables.keep
    monkeypatch.setattr(Tables, "keep", lambda self, d, name, merge=False: kept.setdefault(name, d.schema) and keep(self, d, name, merge))
    monkeypatch.setattr(kmers, "SLICE", 20)
    made = {s: {min(x, x[::-1].translate(COMP)) for x in (s[i : i + 7] for i in range(len(s) - 6))} for s in {r["seq"] for r in df.collect()}}
    assert rows() == whole and len(whole) > 40 and len([n for n in kept if n.startswith("counted/")]) > 2
    assert max(len(v) for v in made.values()) > 20
    numbers = {x for v in made.values() for x in v}
    got = spark.createDataFrame([(x,) for x in numbers], "s string").select(kmers.number(kmers.F.col("s")).alias("n"), "s").collect()
    assert len({r["n"] for r in got}) == len(numbers) and all((r["n"] < 0) == ("N" in r["s"]) for r in got)


def test_keys_of_three(spark):
    """Sketches meet by three of their first k-mers: those that share two rare ones only don't."""
    rows = [(i, [f"a{i // 2}", f"b{i // 2}"] + [f"{c}{i // 4}" for c in "cdef"]) for i in range(8)] + [(9, ["a0", "b0", "x", "y", "z", "u"]), (10, ["x", "y", "z", "u", "v", "w"])]
    sketches = spark.createDataFrame(rows, "read_id long, s array<string>")
    held = {}
    for r in kmers.unnest(kmers.first_ones(sketches, 4, 3, Tables(spark, "test")), "keys", "key").collect():
        held.setdefault(r["key"], set()).add(r["read_id"])
    met = {(a, b) for x in held.values() for a in x for b in x if a < b}
    want = {(a, b) for a, x in rows for b, y in rows if a < b and len(set(x) & set(y)) >= 4}
    assert want <= met and not met & {(0, 9), (1, 9)} and len(want) == 13
