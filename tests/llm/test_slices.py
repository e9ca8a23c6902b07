"""Pairs of near copies verified in parts: the same links as all at once, and nothing of the sets is left."""

import os
import random
from urllib.parse import urlparse

from pyspark.sql import functions as F

from seqframe.llm import simhash
from seqframe.tables import Tables


def test_similar_in_slices(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 4)
    monkeypatch.setattr(simhash, "SLICES", 3)
    rng = random.Random(2)
    base = [" ".join(rng.choices("abcdefghij", k=60)) for _ in range(4)]
    texts = [(i, " ".join(w for w in base[i % 4].split() if rng.random() > i / 300)) for i in range(16)]
    sets = {i: set(simhash.shingles(t, simhash.SIMILAR_WORDS).tolist()) for i, t in texts}
    every = [(a, b) for a in sets for b in sets if a < b]
    want = {(a, b) for a, b in every if len(sets[a] & sets[b]) >= simhash.SIMILAR * len(sets[a] | sets[b])}
    tables = Tables(spark, "test")
    docs = spark.createDataFrame(texts, "node long, text string").withColumn("cls", F.md5(F.col("node").cast("string")).cast("binary"))
    pairs = tables.keep(spark.createDataFrame(every, "x long, y long"), "pairs")
    got = {(r["x"], r["y"]) for r in simhash.similar(pairs, docs.select("node", "cls"), docs.select("cls", "text"), tables, "near").collect()}
    assert got == want and 0 < len(want) < len(every)
    held = os.listdir(urlparse(tables.at).path)
    assert "near_sets" not in held and len([x for x in os.listdir(urlparse(f"{tables.at}/near").path) if x.isdigit()]) == 3


def test_near_copies_in_parts(spark, monkeypatch):
    """Keys that are moved in parts give the same groups, and no table of sets is written to compare texts: only prefixes are."""
    monkeypatch.setattr(simhash, "KEYS", 40)
    monkeypatch.setattr(simhash, "SLICE", 4)
    written = []
    for way in ("keep", "keep_bucketed"):
        plain = getattr(Tables, way)

        def watched(self, df, name, *more, plain=plain, **named):
            written.append((name, df.schema.json()))
            return plain(self, df, name, *more, **named)

        monkeypatch.setattr(Tables, way, watched)
    rng = random.Random(5)
    base = [rng.choices("abcdefghijklmnop", k=80) for _ in range(5)]
    rows = [(i, " ".join(w for j, w in enumerate(base[i % 5]) if j != i)) for i in range(30)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(min(g) for g in groups_of(rows))
    assert {n for n, s in written if "array" in s} == {"held", "nodes"} and len([n for n, _ in written if n.startswith("pairs/")]) > 1


def groups_of(rows):
    sets = {i: set(simhash.shingles(t, simhash.SIMILAR_WORDS).tolist()) for i, t in rows}
    of = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) >= simhash.SIMILAR * len(sets[a] | sets[b]):
                    of[a] = of[b] = min(of[a], of[b])
    return [[i for i in of if of[i] == g] for g in set(of.values())]
