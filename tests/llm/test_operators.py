"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
from collections import Counter
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seqframe.llm import arrow_output, cover_tree, crf_langid, decision_list, kneser_ney, mixing, piece_scan, sharding, simhash, suffix_dedup, suffix_sort
from seqframe.tables import Tables

RNG = random.Random(11)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, _language string, cls int"


def words(n, lang="en"):
    parts = {"en": ["th", "ing", "er", "and", "ou"], "de": ["sch", "ung", "ein", "ich", "ü"]}[lang]
    return " ".join("".join(RNG.choices(parts, k=RNG.randint(1, 4))) for _ in range(n))


def make(spark, texts, langs=None):
    rows = [(i, t, (langs or ["en"] * len(texts))[i], f"s{i % 3}", None, "x", None, i) for i, t in enumerate(texts)]
    rows += [(None, "lonely words without an id", None, None, 1, None, None, None), (0, texts[0], "en", "s0", None, "x", None, 0)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    base = words(300)
    shared = "".join(RNG.choices("abcdefg h\n", k=900))
    return [
        base, None, "", " \n\t ", "12 34 !!", base, base.upper(), base.replace("th", "ht", 1), words(40, "de"), words(4000), "x" * 3000,
        shared[:450] + words(30), words(20) + shared[20:700], words(10) + shared[430:], "one two", "a▁b  c", "\U0001f600 é x " * 50,
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return make(spark, texts)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_language(spark, empty):
    texts = [words(40, "de" if i % 2 else "en") for i in range(60)] + [None, "", "123 !"]
    langs = ["de" if i % 2 else "en" for i in range(60)] + ["en", None, "de"]
    df = make(spark, texts, langs)
    got = {r["doc_id"]: r["_language_"] for r in crf_langid.identify(df, crf_langid.fit(df), into="_language_").collect() if r["doc_id"] is not None}
    assert sum(got[i]["lang_pred"] == langs[i] for i in range(60)) >= 58
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (60, 61, 62)) and all(0 <= g["score"] <= 1 for g in got.values())
    kept = crf_langid.keep_identified(df)
    assert kept.columns == df.columns and {60, 61, 62}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert crf_langid.keep_identified(empty).count() == 0


def test_every_language_is_learned(spark, monkeypatch):
    rows = [(i, words(40), f"l{i % 90}") for i in range(90 * 8)] + [(10_000 + i, words(40), "rare") for i in range(8)]
    monkeypatch.setattr(crf_langid, "train", lambda samples: samples)
    monkeypatch.setattr(crf_langid, "DOCS_PER_LANG", 3)
    got = crf_langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    n = [sum(s[0] == x for s in got) for x in {r[2] for r in rows}]
    assert min(n) >= crf_langid.WINDOWS and max(n) <= 3 * crf_langid.WINDOWS


def test_forward_backward():
    rng = np.random.default_rng(0)
    e, t, f = rng.normal(size=(4, 2)).astype(np.float32), rng.normal(size=(2, 2)).astype(np.float32), rng.normal(size=2).astype(np.float32)
    got, _ = crf_langid.posteriors(e, np.array([0]), np.array([4]), t, f)
    want = np.zeros((4, 2))
    for p in np.ndindex(2, 2, 2, 2):
        w = math.exp(f[p[0]] + sum(e[i, p[i]] for i in range(4)) + sum(t[p[i], p[i + 1]] for i in range(3)))
        for i in range(4):
            want[i, p[i]] += w
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True), atol=1e-4)


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_shards(docs, texts, empty, law):
    rows = sharding.shard(docs, 4, law).collect()
    assert len(rows) == docs.count()
    for s in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    for r in rows:
        if r["doc_id"] is not None:
            data = (texts[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(data) + 8, zlib.crc32(data))
    if law == "rows":
        n = [sum(r["shard"] == s for r in rows) for s in range(4)]
        assert max(n) - min(n) <= 1
    else:
        n, most = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(4)], max(r["size"] for r in rows)
        assert all(abs(x - sum(n) / 4) < 2 * most for x in n)
    assert sharding.shard(empty, 4, law).count() == 0


def test_statistics(docs, texts):
    import re

    for r in decision_list.with_statistics(docs.select("doc_id", "text")).where("doc_id is not null").collect():
        t = texts[r["doc_id"]] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        times = Counter(wins)
        cover = {j for i, x in enumerate(wins) if times[x] > 1 for j in range(i, i + 8)}
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), dup)
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        assert r["n_repeat_words"] == len(cover)


def test_repeats_inside_a_text(spark):
    w = [f"w{i}" for i in range(30)]
    text = " ".join(w[:20] + w[3:15] + ["x"] + w[3:12])
    r = decision_list.with_statistics(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    wins = [tuple(text.split()[i : i + 8]) for i in range(len(text.split()) - 7)]
    assert r["n_repeat_words"] == len({j for i, x in enumerate(wins) if wins.count(x) > 1 for j in range(i, i + 8)}) > 0


def test_decision_list():
    rows = [({"a": float(i % 10), "b": float(i % 7)}, int(not (i % 10 > 6 and i % 7 < 3))) for i in range(700)]
    rules = decision_list.learn(rows)
    assert rules and all(any(r.holds(x) for r in rules) == (not y) for x, y in rows)
    assert decision_list.learn([]) == [] and decision_list.learn([(x, 1) for x, _ in rows]) == []


def test_arrow_files(spark, docs, texts, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tables = Tables(spark, "t")
    manifest = arrow_output.write_tokens(docs, path, f"file://{tmp_path}/s", tables, seq_len=32, batch_rows=4)
    rows = sorted(arrow_output.read_tokens(manifest).collect(), key=lambda r: r["start"])
    tok = Tokenizer.from_file(path)
    at = 0
    for r in rows:
        if r["doc_id"] is not None:
            ids = [*tok.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
            assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += r["n_tokens"]
    assert [r["doc_id"] for r in rows] == [None, 0, *range(len(texts))]
    file = arrow_output.SequenceFile(manifest.first()["path"] + ".arrows")
    ids, mask = file[len(file) - 1]
    assert len(ids) == len(mask) == 32 and len(file) % 4 == 0
    assert arrow_output.read_tokens(arrow_output.write_tokens(empty, path, f"file://{tmp_path}/e", Tables(spark, "t"))).count() == 0


def test_added_tokens_in_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "plain words", "", "x<|endoftext|>.\n<|endoftext|>", "a <|endoftext| > b  c"]
    got = [np.frombuffer(x, "<u4").tolist() for x in arrow_output.PieceEncoder(path).ids(texts)]
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts] and 50256 in got[0]


def brute_print(t):
    w = (t or "").encode().lower().split()
    sh = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_groups(words):
    """{id: least id of its group}: equal words, or a Jaccard similarity of 0.8 of five-word shingles, by brute force."""
    sets = {i: {w[k : k + 5] for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    out = {}
    for i in sorted(words):
        if i not in out:
            group, queue = {i}, [i]
            while queue:
                a = queue.pop()
                for b in words:
                    n = len(sets[a] & sets[b])
                    if b not in group and (words[a] == words[b] or n and n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)):
                        group.add(b)
                        queue.append(b)
            out |= dict.fromkeys(group, i)
    return out


@pytest.mark.parametrize("group", [6, 1024])
def test_near_copies(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    texts = []
    for _ in range(12):
        first = [word() for _ in range(rng.randint(60, 200))]
        for copy in range(rng.choice([1, 3, 25])):
            new = list(first)
            for _ in range(rng.randint(0, max(1, len(first) // 45))):
                new[rng.randrange(len(new))] = word()
            texts.append((" " if copy % 2 else "\n").join(new).title() if copy % 5 == 4 else " ".join(new))
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, _row long")
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    want = set(near_groups({i: tuple(t.encode().lower().split()) for i, t in enumerate(texts)}).values())
    got = {r["doc_id"] for r in kept.collect()}
    assert want <= got and len(texts) - len(got) >= 0.95 * (len(texts) - len(want))  # a pair may be missed


@pytest.mark.parametrize("group", [2, 5, 1024])
def test_near_copies_are_whole(spark, monkeypatch, group):
    """No link is missed: not at the threshold, not in large groups, and not between texts whose only links lead through others."""
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = random.Random(group)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(3, 6)))
    line = [word() for _ in range(12)]
    texts = ["one", "one two", "one two three four", "", None, "One  two"]
    for _ in range(25):
        first = [word() for _ in range(rng.randint(5, 90))]
        for _ in range(rng.choice([1, 2, 4, 12])):
            # A chain of copies, each near the limit: words at one end change step by step.
            texts.append(" ".join(first + (line if rng.random() < 0.5 else [])))
            n = rng.randint(1, max(1, len(first) // 6))
            first = first[n:] + [word() for _ in range(rng.randint(0, n))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = set(near_groups({i: tuple((t or "").encode().lower().split()) for i, t in enumerate(texts)}).values())
    assert {r["doc_id"] for r in simhash.one_of_each(df).collect()} == want
    assert len(want) < len(texts) - 20


def test_simhash(docs, texts, empty):
    rows = simhash.near_duplicates(docs).collect()
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    for r in rows:
        if r["id"] is not None:
            assert r["fp"] & (1 << 64) - 1 == prints[r["id"]]
            near = {r["id"]}
            while more := {j for j in prints if j not in near and any((prints[j] ^ prints[i]).bit_count() <= 3 for i in near)}:
                near |= more
            assert r["component"] == min(near)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    words = {i: tuple((t or "").encode().lower().split()) for i, t in enumerate(texts)}
    assert len(ids) == len(set(ids)) and ids.count(0) == 1 and set(ids) == {*near_groups(words).values(), None}
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


def test_simhash_large_groups(spark):
    rng = random.Random(4)
    center = rng.getrandbits(64)
    values = {center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(120)} | {rng.getrandbits(64) for _ in range(60)}
    df = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    from seqframe.operators.components import connected_components

    for group in (8, 1024):
        got = {r["id"]: r["component"] for r in connected_components(simhash.links(df, Tables(spark, "t"), group)).collect()}
        near = {v: {w for w in values if v != w and (v ^ w).bit_count() <= 3} for v in values}
        assert set(got) == {simhash.signed(v) for v in values if near[v]}
        assert all(got[simhash.signed(v)] == got[simhash.signed(w)] for v in values for w in near[v])
        assert len(set(got.values())) == count_components(near)


def count_components(near):
    left, n = {v for v in near if near[v]}, 0
    while left:
        n, todo = n + 1, [left.pop()]
        while todo:
            more = near[todo.pop()] & left
            left -= more
            todo.extend(more)
    return n


def test_pieces(docs, texts, empty):
    import sentencepiece

    path = piece_scan.model_path()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = piece_scan.encode(docs, path, chunk=700)
    rows = out.collect()
    assert len(rows) == docs.count() and max(r["n_chunks"] for r in rows) > 3
    for r in rows:
        if r["doc_id"] is not None:
            assert list(r["ids"]) == model.encode(texts[r["doc_id"]] or "") and r["round_trip"]
    assert {r["doc_id"]: r["text"] for r in piece_scan.decode(out, path).collect()}[0] == texts[0]
    assert piece_scan.encode(empty, path).count() == 0


def test_scan_is_associative():
    rng = np.random.default_rng(3)
    m = [np.where(rng.random((4, 4)) < 0.5, 0, -np.inf).astype(np.float32) for _ in range(9)]
    want = [m[0]]
    for x in m[1:]:
        want.append(piece_scan.times(want[-1], x))
    assert all((a == b).all() for a, b in zip(piece_scan.prefix_scan(m), want))


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r["probability"] <= 1 for r in rows)
    tokens = sum(r["n_tokens"] for r in rows)
    assert sum(r["n_tokens"] * r["probability"] for r in rows) == pytest.approx(0.7 * tokens, rel=1e-6)
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows)
    assert mixing.mix(empty).count() == 0 and mixing.sample(empty).count() == 0


def test_raked_marginals(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(50, 400), rng.choice("ab"), rng.choice("xyz")) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mix(df, budget=0.01, sweeps=20).collect()
    total = sum(r["n_tokens"] for r in out)
    for c, power in mixing.POWERS.items():
        held = {v: sum(r["n_tokens"] for r in out if r[c] == v) for v in {r[c] for r in out}}
        made = {v: sum(r["n_tokens"] * r["weight"] for r in out if r[c] == v) / total for v in held}
        for v in held:
            assert made[v] == pytest.approx(held[v] ** power / sum(x**power for x in held.values()), abs=2e-3)


def test_kneser_ney(spark, docs, empty):
    texts = [words(60) for _ in range(30)] + ["".join(RNG.choices("qxzvkj ", k=300)) for _ in range(3)] + [None, ""]
    df = make(spark, texts)
    trusted = spark.createDataFrame([(i,) for i in range(20)], "doc_id long")
    got = {r["doc_id"]: r for r in kneser_ney.classify(df, trusted).collect()}
    assert all(got[i]["kept"] for i in range(30)) and not any(got[i]["kept"] for i in range(30, 35))
    assert kneser_ney.classify(empty, trusted).count() == 0
    none = kneser_ney.classify(docs, trusted.where("doc_id < 0")).where("perplexity is not null")
    assert none.where("not kept").count() == 0


def test_kneser_ney_sums_to_one(spark):
    tables = Tables(spark, "t")
    df = spark.createDataFrame([("the cat sat on the mat that the cat saw",)], "text string")
    model = kneser_ney.train(df, tables)
    symbols = sorted(set("thecasonmw")) + [kneser_ney.END, "\u0001"]
    grams = spark.createDataFrame([("\n\nth" + s,) for s in symbols], "gram string")
    total = kneser_ney.resolve(grams, model, tables).agg(F.sum(F.exp("logp"))).first()[0]
    assert total == pytest.approx(1, abs=1e-9)


def test_kneser_ney_across_words(spark):
    """Against the n-grams of the whole texts one by one; word order and repetition count."""
    trained = ["the cat sat on the mat", "a cat  and\ta \u00e9t\u00e9 mat"]
    asked = ["the cat sat", "sat the cat", "the the the the", " the\n\ncat sat ", "", None, "zzz \U0001f600", "the cat sat on the mat"]
    tables = Tables(spark, "t")
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in trained], "text string"), tables)
    rows = [(i, t, "en") for i, t in enumerate(asked)]
    scored = kneser_ney.perplexities(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model, tables)
    got = {r["doc_id"]: (r["n_chars"], r["log_prob"]) for r in scored.collect()}

    def grams(text):
        padded = "\n" * 4 + "".join(w + " " for w in (text or "").split())
        return [padded[i : i + 5] for i in range(len(padded) - 4)]

    partial = spark.createDataFrame([(t,) for t in trained], "text string").mapInArrow(kneser_ney.count_grams, "gram string, n long")
    counted = {r["gram"]: r["n"] for r in partial.groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    every = [g for t in trained for g in grams(t)]
    assert counted == {g: every.count(g) for g in every}
    needed = spark.createDataFrame([(g,) for g in sorted({g for t in asked for g in grams(t)})], "gram string")
    logp = {r["gram"]: r["logp"] for r in kneser_ney.resolve(needed, model, Tables(spark, "t")).collect()}
    for i, t in enumerate(asked):
        assert got[i][0] == len(grams(t)) and got[i][1] == pytest.approx(sum(logp[g] for g in grams(t)), abs=1e-9)
    assert got[0] == got[3] and got[0][1] > got[1][1] + 0.1
    direct = direct_kneser_ney(counted)
    assert all(logp[g] == pytest.approx(math.log(direct(g)), abs=1e-9) for g in logp)


def direct_kneser_ney(counts):
    """The interpolated modified Kneser-Ney probability of an n-gram's last character, from counts of the longest n-grams."""
    levels = {5: counts}
    for k in (4, 3, 2, 1):
        levels[k] = {}
        for g in levels[k + 1]:
            levels[k][g[1:]] = levels[k].get(g[1:], 0) + 1
    off = {}
    for k, level in levels.items():
        c = [0] + [sum(1 for n in level.values() if n == i) for i in (1, 2, 3, 4)]
        y = c[1] / (c[1] + 2 * c[2]) if c[1] and c[2] else 0.5
        off[k] = [0.0] + [min(max(i - (i + 1) * y * c[i + 1] / c[i], 0.05), i - 0.05) if c[i] else 0.5 * i for i in (1, 2, 3)]

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(levels[1]) + 1)
        same = {h: n for h, n in levels[k].items() if h[:-1] == g[:-1]}
        if not same:
            return p(g[1:])
        total, cut = sum(same.values()), sum(off[k][min(n, 3)] for n in same.values())
        mine = same.get(g, 0)
        return max(mine - off[k][min(mine, 3)], 0) / total + cut / total * p(g[1:])

    return p



def test_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 8))
    rows = [(i, (base[i % 12] + rng.normal(size=8) * 0.05 * (i % 5)).tolist(), i % 2) for i in range(150)]
    rows += [(200, rows[0][1], 0), (201, None, 0), (202, [0.0] * 8, 0), (203, [float("nan")] * 8, 1), (204, [None] * 8, 1), (205, rows[3][1], None), (206, [x * 1e200 for x in rows[2][1]], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, hash string")
    ok = {i: (np.array(v) / max(map(abs, v)), y) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: (v / np.linalg.norm(v), y) for i, (v, y) in ok.items()}
    near = {i: {j for j in unit if i != j and unit[i][1] == unit[j][1] and unit[i][0] @ unit[j][0] >= 0.98} if i in unit else set() for i, _, _ in rows}
    for block in (16, 2048):
        got = {r["vec_id"]: r for r in cover_tree.near_vectors(df, block=block).collect()}
        assert len(got) == len(rows)
        for i in near:
            group, todo = {i}, [i]
            while todo:
                more = near[todo.pop()] - group
                group |= more
                todo.extend(more)
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(near[i]), min(group), i == min(group)), i


def test_deep_shallow():
    rng = random.Random(6)
    for _ in range(300):
        stem = bytes(rng.choices(b"ab", k=60))
        s = [stem[: rng.choice([0, 30, 60])] + bytes(rng.choices(b"ab\0", k=rng.randint(0, 12))) for _ in range(rng.randint(0, 40))]
        order, lcp = suffix_sort.neighbours(s)
        assert [s[i] for i in order] == sorted(s) and len(lcp) == max(1, len(s))


def brute_cut(data, length):
    from collections import Counter

    seen = Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), len([1 for a, b in zip(b"\0" + bytes(gone), gone) if b and not a]), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("ways", [2, 8])
def test_repeats(spark, empty, monkeypatch, ways):
    monkeypatch.setattr(suffix_dedup, "WAYS", ways)
    rng = random.Random(7)
    passage = "".join(rng.choices("abcd ", k=120))
    texts = ["".join(rng.choices("abcé ", k=rng.randint(0, 120))) for _ in range(40)]
    for i in range(0, 40, 2):
        a = rng.randint(0, 60)
        texts[i] = texts[i][:20] + passage[a : a + rng.randint(30, 90)] + texts[i][20:]
    texts += [texts[3], texts[4], "ab" * 100, None, ""]
    df = make(spark, texts)
    every = [(t or "").encode() for t in texts] + [b"lonely words without an id", (texts[0] or "").encode()]
    want = brute_cut(every, 40)
    cut = {bytes(r["cls"]): r for r in suffix_dedup.repeated(df, Tables(spark, "t"), 40).collect()}
    for t, (n, removed, spans, sha) in zip(every, want):
        r = cut.get(hashlib.sha256(t).digest())
        assert ((r["n_removed"], r["n_spans"], r["kept_sha256"]) if r else (0, 0, hashlib.sha256(t).hexdigest())) == (removed, spans, sha), t
    kept = suffix_dedup.without_repeats(df, 40)
    assert kept.columns == df.columns
    assert suffix_dedup.repeated(empty, Tables(spark, "t")).count() == 0


def test_suffix_query(spark, tmp_path):
    """The query's own columns at its own lengths, with a repeat across the pieces of a long text."""
    rng = random.Random(13)
    fresh = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    long, short = fresh(450), fresh(300)
    texts = [fresh(900) + long + fresh(50), fresh(20) + long + short + fresh(400), short + fresh(500), fresh(399), None, "", fresh(700), short * 3]
    texts += [texts[6], long[:399] + "x" + fresh(300)]
    make(spark, texts).drop("fp", "_language", "cls").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in suffix_dedup.op10_suffix_array(spark, str(tmp_path)).collect()}
    every = [(t or "").encode() for t in texts] + [b"lonely words without an id", (texts[0] or "").encode()]
    want, shorter = brute_cut(every, 400), brute_cut(every, 200)
    for i in range(len(texts)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[i], i
    passages = {bytes(r["cls"]): r["n_removed"] for r in suffix_dedup.repeated(make(spark, texts), Tables(spark, "t"), suffix_dedup.PASSAGE).collect()}
    assert all(passages.get(hashlib.sha256(t).digest(), 0) == x[1] for t, x in zip(every, shorter))


def test_language_learns_from_its_rows_alone(spark, tmp_path):
    """Held-out languages, sources and ids that keep the fold move no prediction."""
    rows = [(i, words(40, "de" if i % 2 else "en"), "de" if i % 2 else "en", f"s{i % 3}", 1) for i in range(60)] + [(60, None, "en", "s", 1), (61, "12 3!", "de", "s", 1)]
    out = [zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in rows]
    other = [(i, t, "xx" if held else lang, "t", n) for (i, t, lang, _, n), held in zip(rows, out)]
    got = []
    for name, r in (("a", rows), ("b", other)):
        spark.createDataFrame(r, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / name / "documents.parquet"))
        got.append({x["doc_id"]: (x["held_out"], x["lang_pred"], round(x["score"], 9)) for x in crf_langid.op1_crf_language(spark, str(tmp_path / name)).collect()})
    assert got[0] == got[1] and [got[0][r[0]][0] for r in rows] == out
    assert got[0][60][1:] == got[0][61][1:] == ("und", 0.0)
    assert all(p == r[2] for r in rows[:60] if (p := got[0][r[0]][1]))
