"""Repeated passages, spelling variants and the divergence audit against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from seqframe.llm import divergence, phrase_automata, spelling
from seqframe.tables import Tables

RNG = random.Random(5)
SCHEMA = "doc_id long, text string, lang string, source string, cls int, word string, n long, term string"


def vocabulary(n):
    return ["".join(RNG.choices("abcdeé", k=RNG.randint(1, 7))) for _ in range(n)]


def make(spark, rows):
    return spark.createDataFrame([(i, t, g, s, 1, "w", 2, "x") for i, t, g, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_passages(texts):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    size = phrase_automata.WINDOW
    seen = Counter(tuple(w[i : i + size]) for w in docs for i in range(len(w) - size + 1))
    out = []
    for w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), kept))
    return out


def passages():
    v = vocabulary(3000)
    prose = lambda n: RNG.choices(v, k=n)
    shared, line, loop = prose(120), prose(20), prose(5)
    texts = [prose(200), None, "", " \n\x0b\t", prose(34), prose(35)]
    texts += [prose(RNG.randint(0, 60)) + shared[a : a + n] + prose(RNG.randint(0, 60)) for a, n in ((0, 120), (0, 35), (40, 36), (85, 35), (10, 34), (30, 80), (0, 120))]
    texts += [prose(30) + line + prose(30) for _ in range(40)]  # a phrase of many surroundings, and no window
    texts += [prose(9) + line + shared[:30] + prose(9) for _ in range(20)]  # the same, with windows
    texts += [loop * 40, ["same"] * 500, ["same"] * 36, shared[:50] + prose(30) + shared[:50]]
    near = prose(300)
    texts += [near, near, near[:150] + ["x"] + near[150:], near[100:], ["\U0001f600", "ü ß"] * 30]
    texts = [t if t is None or isinstance(t, str) else RNG.choice((" ", "\n", " \t ")).join(t) for t in texts]
    return texts + ["a" * 3_000_000 + " " + " ".join(shared)]


def test_passages(spark, empty):
    texts = passages()
    df = make(spark, [(i, t, None, "s") for i, t in enumerate(texts)])
    tables = Tables(spark, "test")
    got = {bytes(r["cls"]): (r["n_removed"], r["kept_sha256"], r["kept_text"]) for r in phrase_automata.repeated(df, tables).collect()}
    want = brute_passages(texts)
    for t, (n, gone, kept) in zip(texts, want):
        mine = got.get(hashlib.sha256((t or "").encode()).digest())
        if gone or mine:
            assert mine == (gone, hashlib.sha256(kept.encode()).hexdigest(), kept)
    assert sum(g > 0 for _, g, _ in want) > 30
    kept = phrase_automata.without_passages(df)
    assert kept.columns == df.columns
    left = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert left == {i: (w[2] if w[1] else t) for i, (t, w) in enumerate(zip(texts, want)) if not w[1] or w[2]}
    assert phrase_automata.without_passages(empty).count() == 0


def test_passage_query(spark, tmp_path):
    texts = passages()
    make(spark, [(i, t, None, "s") for i, t in enumerate(texts)] + [(0, texts[0], None, "s"), (None, texts[8], None, None)]).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(repr, map(tuple, phrase_automata.op11_phrase_automata(spark, str(tmp_path)).collect())))
    ids = [*range(len(texts)), 0, None]
    want = brute_passages([*texts, texts[0], texts[8]])
    assert got == sorted(repr((i, n, gone, hashlib.sha256(kept.encode()).hexdigest())) for i, (n, gone, kept) in zip(ids, want))


def test_phrases_stand_for_windows():
    for text in (b"a b c d e f g " * 40, " ".join(vocabulary(400)).encode(), b"x " * 80):
        h = phrase_automata.word_hashes(text)
        g = phrase_automata.phrases_at(h)
        chosen = set(phrase_automata.standing(h).tolist())
        for i in range(len(h) - phrase_automata.WINDOW + 1):
            assert int(min(g[i : i + phrase_automata.AROUND + 1].tolist(), key=lambda x: x >> 20)) >> 20 in {c >> 20 for c in chosen}


def test_automaton():
    words = [w.encode() for w in RNG.choices(vocabulary(30), k=4000)]
    phrases = list({tuple(words[i : i + 12]) for i in range(0, 3000, 7)})
    at, which = phrase_automata.Automaton(phrases).find(words)
    number = {p: i for i, p in enumerate(phrases)}
    assert list(zip(at.tolist(), which.tolist())) == [(i, number[p]) for i in range(len(words) - 11) if (p := tuple(words[i : i + 12])) in number]
    assert phrase_automata.cover(50, [(0, 1), (20, 1 << 10)]).tolist() == [i < 45 for i in range(50)]


def edit_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_spelling(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % spelling.SPOILT == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if c >= 3 and len(w) >= 5}
    out = {}
    for w in n:
        near = [x for x in n if edit_one(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = [form, n[w], len(near), n[form] if form else None]
    for w, v in out.items():
        r = w
        while out[r][0]:
            r = out[r][0]
        v.append(r)
    return out


@pytest.mark.parametrize("limit", [4096, 3])
def test_spelling(spark, empty, limit):
    rng = random.Random(3)
    base = ["".join(rng.choices("aäbß", k=rng.randint(5, 11))) for _ in range(60)]
    words = base + [w[: (i := rng.randrange(len(w)))] + rng.choice(["", "a", "ÿ", "xa"]) + w[i + rng.randint(0, 1) :] for w in base * 6] + ["a" * 40, "a" * 41, "b" + "a" * 39]
    rows = [(rng.randrange(50), " ".join(rng.choices(words, k=60)) + "; ÀBCDEF×ghij ΩABCDE1abcde_abcde") for _ in range(120)] + [(None, "lonely lonely lonely lonesy"), (7, None), (8, ""), (9, "12 3")]
    words = spelling.words_in(make(spark, [(i, t, None, None) for i, t in rows]))
    want = brute_spelling(rows)
    got = {r["word"]: [r["form"], r["n"], r["n_near"], r["form_n"], r["root"]] for r in spelling.variants(words, Tables(spark, "test"), limit).collect()}
    assert got == want and sum(v[0] is not None for v in want.values()) > 20 and max(v[2] for v in want.values()) > 5
    assert spelling.group_spellings(empty).count() == 0


def test_pairs_of_a_hot_half(spark):
    """Thousands of words share their first half; the key is divided and no pair is lost or doubled."""
    rng = random.Random(9)
    words = {"prefix" + "".join(rng.choices("abc", k=6)) for _ in range(500)} | {"prefix" + "".join(rng.choices("abc", k=7)) for _ in range(500)}
    rows = [(w, 3) for w in words]
    found = spelling.near_pairs(spark.createDataFrame(rows, "word string, n long"), Tables(spark, "test"), 50).collect()
    pairs = Counter(frozenset((r["r"], r["s"])) for r in found)
    order = sorted(words)
    assert max(pairs.values()) == 1 and set(pairs) == {frozenset((a, b)) for i, a in enumerate(order) for b in order[i + 1 :] if edit_one(a, b)}


def brute_audit(rows, least, top):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        terms = ["".join(c.lower() if c.isascii() else c for c in t) for t in re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", text)]
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, d in docs[lang].items() if d >= least]
        n = {s: {t: count[lang, s][t] for t in kept} for g, s in groups if g == lang}
        whole = {t: sum(x[t] for x in n.values()) for t in kept}
        p = lambda c, t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        pair = sorted(((-sum(abs(p(n[source], t) - p(n[s], t)) for t in kept), s.encode()) for s in n if s != source))
        term = sorted((p(whole, t) - p(n[source], t), t.encode()) for t in kept if n[source][t] and p(n[source], t) > p(whole, t))[:top]
        out += [(lang, source, part, i.decode(), -v, k + 1) for part, found in (("pair", pair), ("term", term)) for k, (v, i) in enumerate(found)]
    return sorted(out)


def test_divergence(spark, empty):
    v = [*vocabulary(60), "Ünder", "naïve", "日本", "a"]
    rows = [(" ".join(RNG.choices(v, weights=range(len(v), 0, -1), k=RNG.randint(0, 40))).title() + " 12 x-y_z", RNG.choice(["en", "en", "de", None]), RNG.choice(["a", "b", "ß", None])) for _ in range(150)]
    rows += [(None, "fr", "a"), ("", "fr", "b"), (None, None, None), *rows[:3], ("only one", "xx", "lone"), (" ".join(v * 300), "en", "a")]
    df = spark.createDataFrame([(i, t, g, s, 1, "w", 2, "x") for i, (t, g, s) in enumerate(rows)], SCHEMA)
    got = divergence.audit(df, 20, 7).select("lang", "source", "part", "item", "value", "rank").collect()
    want = brute_audit(rows, 20, 7)
    assert sorted(map(tuple, got)) == want and {w[2] for w in want} == {"pair", "term"} and any(w[4] == 0 for w in want)
    assert divergence.audit(empty).count() == 0


def test_joint_histogram(spark):
    cells = spark.createDataFrame([("l", s, t, n, 0) for s, t, n in (("a", "x", 1), ("a", "y", 1), ("a", "z", 2), ("b", "x", 1), ("b", "w", 5))], "lang string, source string, term string, n long, lang_n long")
    groups = spark.createDataFrame([("l", "a", 4, 6, 10), ("l", "b", 6, 6, 10)], "lang string, source string, total long, terms long, lang_total long")
    got = {(r["x"], r["y"]): r["m"] for r in divergence.joint_histogram(cells, groups, Tables(spark, "test")).collect()}
    assert got == {(1, 1): 1, (1, 0): 1, (2, 0): 1, (0, 5): 1, (0, 0): 2}
