"""Removal of repeated passages by automata of recurring phrases.

Of the PHRASE-word strings in a window, the one of the least hash is its phrase, whatever lies around the window; so two
equal windows hold the same phrase at the same place. Phrases of all texts are counted by hash. Those that recur are
compiled into Aho-Corasick automata, one for each slice of texts: an automaton holds the phrases that its texts need, and
neither automata nor texts grow beyond a slice. The slice's texts are streamed through it, which locates every occurrence,
word by word.

Each occurrence is told by its surroundings, as far as a window around it reaches. Equal surroundings repeat all their
windows, and a phrase that always has the same surroundings is settled by that. Where a phrase recurs in different
surroundings (at the ends of passages, and around changes), a window that recurs shares at least NEAR words with another
occurrence on one side of the phrase. Only surroundings that share so many are spelled out, once each: the windows on that side for
which the phrase stands, which are counted one by one.

Words are told apart by 64-bit hashes, windows and surroundings by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_PATTERN, Tables, by_size, documents, freeing, fresh
from .suffix_dedup import _mix, _powers, text_class

#: Words of a window and of the phrase that stands for it.
WINDOW, PHRASE = 35, 12
#: Words that a window goes on before or behind its phrase, at most.
AROUND = WINDOW - PHRASE
#: Words that a window has on one side of its phrase at least.
NEAR = (AROUND + 1) // 2
#: Bytes of text hashed at a time, words hashed at a time, and bytes of texts that share an automaton.
PIECE, CHUNK, SLICE_BYTES = 1 << 20, 1 << 18, 1 << 21
#: Symbols of one place of a word's code in an automaton.
BASE = 64

_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\f\r")] = True
C = F.col


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word, which depends on its bytes alone."""
    x = np.frombuffer(data, np.uint8)
    edge = np.diff(np.concatenate([[True], _SPACE[x], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = int(np.searchsorted(ends, a + PIECE, "right"))
        if j <= i:  # a word longer than a piece
            out[i] = int.from_bytes(hashlib.blake2b(data[a : ends[i]], digest_size=8).digest(), "little")
            i += 1
            continue
        part = x[a : ends[j - 1]]
        byte, up, down = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(byte[part] * up[: len(part)], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = _mix((sums[e] - sums[s]) * down[s])
        i = j
    return out


class Sums:
    """Hashes of any run of words, from sums over the words' hashes."""

    def __init__(self, h: np.ndarray, salt: int = 0):
        _, self.up, self.down = _powers(len(h) + 1)
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(_mix(h + np.uint64(salt)) * self.up[: len(h)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def phrases_at(h: np.ndarray) -> np.ndarray:
    """Hashes of the phrases that start at each word."""
    at = np.arange(max(0, len(h) - PHRASE + 1))
    return Sums(h).of(at, at + PHRASE) if len(at) else np.zeros(0, np.uint64)


def chunks(n: int) -> Iterator[tuple[int, int]]:
    """Ranges of words so that every window lies in one of them."""
    for a in range(0, max(0, n - WINDOW + 1), CHUNK):
        yield a, min(n, a + CHUNK + WINDOW - 1)


def stands(h: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For ranges of a text's windows: where the first one starts, the places of the phrases that stand for them, and all phrases' hashes
    from there on."""
    w = AROUND + 1
    for a, z in chunks(len(h)):
        g = phrases_at(h[a:z])
        m = len(g)
        # The place in the low bits: of equal hashes, the first counts.
        key = np.full(-(-m // w) * w + w, np.iinfo(np.uint64).max, np.uint64)
        key[:m] = (g >> np.uint64(20) << np.uint64(20)) | np.arange(m, dtype=np.uint64)
        rows = key.reshape(-1, w)
        ahead, behind = np.minimum.accumulate(rows, axis=1).ravel(), np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        yield a, (np.minimum(behind[: m - w + 1], ahead[w - 1 : m]) & np.uint64((1 << 20) - 1)).astype(np.int64) + a, g


def standing(h: np.ndarray) -> np.ndarray:
    """Hashes of the phrases that stand for the windows of a text, one for each place where such a phrase starts."""
    out, last = [], -1
    for a, places, g in stands(h):
        new = np.unique(places)
        new = new[new > last]
        out.append(g[new - a])
        last = int(places[-1])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


@freeing
def find_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in by_size(batches, SLICE_BYTES):
        found = [standing(word_hashes(encoded(t))).view(np.int64) for t in b.column("text").to_pylist()]
        yield pa.record_batch([b.column("cls"), pa.array(found, pa.list_(pa.int64()))], names=["cls", "phrases"])


class Automaton:
    """Phrases (tuples of words) as an Aho-Corasick automaton over codes of their words: each word that a phrase holds is `width` symbols, with
    symbols of their own for each place, so that matches start at words; all other words are one code."""

    def __init__(self, phrases: list[tuple[bytes, ...]]):
        words = dict.fromkeys(w for p in phrases for w in p)
        self.width = next(n for n in range(1, 9) if BASE**n > len(words))
        self.code = {w: self.symbols(i) for i, w in enumerate(words, 1)}
        self.other = self.symbols(0)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, p in enumerate(phrases):
            self.machine.add_word("".join(self.code[w] for w in p), i)
        self.machine.make_automaton()

    def symbols(self, i: int) -> str:
        return "".join(chr(0x100 + BASE * place + i // BASE**place % BASE) for place in range(self.width))

    def find(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The places at which phrases start, and which phrases these are."""
        get, other = self.code.get, self.other
        hits = [(end, i) for end, i in self.machine.iter("".join([get(w, other) for w in words]))]
        at = np.array(hits, np.int64).reshape(-1, 2)
        return (at[:, 0] + 1) // self.width - PHRASE, at[:, 1]


HITS = "cls binary, place int, before int, behind int, phrase long, x long, y long, left long, right long"


@freeing
def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All occurrences of recurring phrases in texts (cls, text, phrases): the place, the words before and behind it that a window
    around it may reach, the hash of these surroundings (x, y), and those of the NEAR words on either side (null: fewer)."""
    for b in by_size(batches, SLICE_BYTES):
        texts = [encoded(t) for t in b.column("text").to_pylist()]
        known: dict[tuple[bytes, ...], int] = {}
        for data, wanted in zip(texts, b.column("phrases").to_pylist(), strict=True):
            words, h = data.split(), word_hashes(data)
            for a, z in chunks(len(h)):
                g = phrases_at(h[a:z]).view(np.int64)
                for i in np.flatnonzero(np.isin(g, np.array(wanted, np.int64))).tolist():
                    known.setdefault(tuple(words[a + i : a + i + PHRASE]), int(g[i]))
        machine = Automaton(list(known))
        names = np.array(list(known.values()), np.int64)
        for i, data in enumerate(texts):
            words = data.split()
            place, which = machine.find(words)
            if not len(place):
                continue
            before, behind = np.minimum(place, AROUND), np.minimum(len(words) - PHRASE - place, AROUND)
            h = word_hashes(data)
            plain = Sums(h)
            x, y = Sums(h, 1).of(place - before, place + PHRASE + behind), Sums(h, 2).of(place - before, place + PHRASE + behind)
            x = _mix(x + before.astype(np.uint64))
            left, right = plain.of(np.maximum(place - NEAR, 0), place), plain.of(place + PHRASE, np.minimum(place + PHRASE + NEAR, len(words)))
            ints, longs = (lambda v: pa.array(v.astype(np.int32))), (lambda v, mask=None: pa.array(v.view(np.int64), mask=mask))
            yield pa.record_batch(
                [pa.array([b.column("cls")[i].as_py()] * len(place), pa.binary()), ints(place), ints(before), ints(behind), pa.array(names[which]), longs(x), longs(y), longs(left, before < NEAR), longs(right, behind < NEAR)],
                names=["cls", "place", "before", "behind", "phrase", "x", "y", "left", "right"],
            )


WINDOWS = "x long, y long, at int, u long, v long"


@freeing
def spell_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows for which chosen occurrences in texts (cls, text, chosen) stand, on the sides that count: how many words they start
    before the phrase, and the hash of the window and that number."""
    for b in by_size(batches, SLICE_BYTES):
        for text, chosen in zip(b.column("text").to_pylist(), b.column("chosen").to_pylist(), strict=True):
            h = word_hashes(encoded(text))
            u, v = Sums(h, 3), Sums(h, 4)
            number = np.full(len(h), -1, np.int64)
            number[[c["place"] for c in chosen]] = np.arange(len(chosen))
            far, close = (np.array([c[k] for c in chosen], bool) for k in ("on_left", "on_right"))
            x, y = (np.array([c[k] for c in chosen], np.int64) for k in "xy")
            for a, places, _ in stands(h):
                start = np.flatnonzero(number[places] >= 0)
                which, at = number[places[start]], places[start] - a - start
                good = np.where(at >= NEAR, far[which], close[which])
                start, which, at = start[good] + a, which[good], at[good]
                one, two = (s.of(start, start + WINDOW) for s in (u, v))
                yield pa.record_batch([pa.array(x[which]), pa.array(y[which]), pa.array(at.astype(np.int32)), pa.array(_mix(one + at.astype(np.uint64)).view(np.int64)), pa.array(two.view(np.int64))], names=["x", "y", "at", "u", "v"])


def cover(n: int, hits: list[tuple[int, int]]) -> np.ndarray:
    """Which of n words lie in windows: hits are places with a mask, whose bit i tells that the window from i words before counts."""
    place, mask = np.array(hits, np.int64).reshape(-1, 2).T
    back = np.arange(AROUND + 1)
    starts = (place[:, None] - back)[(mask[:, None] >> back & 1).astype(bool)]
    count = lambda at: np.bincount(at, minlength=n + 1)[: n + 1]
    return np.cumsum(count(starts) - count(starts + WINDOW))[:n] > 0


@freeing
def cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in by_size(batches, SLICE_BYTES):
        out = []
        for cls, text, hits in zip(*(b.column(c).to_pylist() for c in ("cls", "text", "hits")), strict=True):
            words = encoded(text).split()
            gone = cover(len(words), [(h["place"], h["mask"]) for h in hits])
            kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
            out.append((cls, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
        types = [pa.binary(), pa.int64(), pa.string(), pa.string()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["cls", "n_removed", "kept_sha256", "kept_text"])


CUT = "cls binary, n_removed long, kept_sha256 string, kept_text string"


def spaced(text: Column) -> Column:
    """The words of a text with one space between them; '' for null."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_PATTERN, " "))


def count_of_words(spaced_text: Column) -> Column:
    return F.when(spaced_text == "", 0).otherwise(F.char_length(spaced_text) - F.char_length(F.replace(spaced_text, F.lit(" "), F.lit(""))) + 1).cast("long")


def settle(hits: DataFrame, texts: DataFrame, tables: Tables) -> DataFrame:
    """(x, y, mask): of surroundings, the windows around the phrase that start anywhere else too."""
    groups = hits.where(C("before") + C("behind") >= AROUND).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("cls", "place")).alias("one"), *[F.first(c).alias(c) for c in ("phrase", "before", "behind", "left", "right")])
    groups = tables.keep(groups, "groups")
    some = F.sequence(F.greatest(F.lit(0), F.lit(AROUND) - C("behind")), C("before"))
    every = F.aggregate(some, F.lit(0), lambda a, i: a + F.call_function("shiftleft", F.lit(1), i))
    whole = groups.where(C("n") > 1).select("x", "y", every.alias("mask"))
    shared = lambda side: groups.where(C(side).isNotNull()).groupBy("phrase", side).agg(F.count(F.lit(1)).alias("c")).where(C("c") > 1).select("phrase", side, F.lit(True).alias(f"on_{side}"))
    chosen = groups.join(shared("left"), ["phrase", "left"], "left").join(shared("right"), ["phrase", "right"], "left").where(C("on_left") | C("on_right"))
    flag = lambda side: F.coalesce(f"on_{side}", F.lit(False)).alias(f"on_{side}")
    chosen = chosen.select("one.cls", F.struct("one.place", "x", "y", flag("left"), flag("right")).alias("c"))
    chosen = tables.keep(chosen.groupBy("cls").agg(F.collect_list("c").alias("chosen")), "chosen")  # of one text
    tables.tidy()
    windows = tables.keep(texts.select("cls", "text").join(chosen, "cls").select("text", "chosen").mapInArrow(spell_windows, WINDOWS), "windows")
    again = tables.keep(windows.groupBy("u", "v").agg(F.count(F.lit(1)).alias("c")).where(C("c") > 1).select("u", "v"), "again_windows")
    tables.drop("chosen")
    tables.tidy()
    found = windows.join(again, ["u", "v"], "left_semi").groupBy("x", "y").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), C("at"))).alias("mask"))
    return tables.keep(whole.union(found).groupBy("x", "y").agg(F.bit_or("mask").alias("mask")), "masks")


def repeated(docs: DataFrame, tables: Tables, text_col: str = "text") -> DataFrame:
    """One row for each distinct text that loses words: cls, n_removed, kept_sha256, kept_text (kept words joined by a space). Texts that
    come several times lose all words, if they have a whole window; of others, what windows cover that start elsewhere too."""
    long = docs.where(F.octet_length(text_col) >= 2 * WINDOW - 1).select(text_class(text_col).alias("cls"), C(text_col).alias("text"))
    texts = tables.keep_bucketed(long.groupBy("cls").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")), "texts", "cls")
    tables.tidy()
    found = tables.keep(texts.select("cls", "text").mapInArrow(find_phrases, "cls binary, phrases array<long>"), "phrases")
    each = found.select("cls", F.explode("phrases").alias("phrase"))
    twice = tables.keep(each.groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).where(C("n") > 1).select("phrase"), "twice")
    again = tables.keep(each.join(twice, "phrase", "left_semi").groupBy("cls").agg(F.collect_set("phrase").alias("phrases")), "again")  # of one text
    tables.drop("phrases", "twice")
    hits = tables.keep(texts.select("cls", "text").join(again, "cls").mapInArrow(locate, HITS), "hits")
    tables.drop("again")
    tables.tidy()
    masks = settle(hits, texts, tables)
    tables.drop("groups", "windows", "again_windows")
    tables.tidy()
    runs = hits.select("cls", "place", "x", "y").join(masks, ["x", "y"]).groupBy("cls").agg(F.collect_list(F.struct("place", "mask")).alias("hits"))  # of one text
    runs = tables.keep(runs, "runs")
    tables.drop("hits", "masks")
    tables.tidy()
    cut = texts.where(C("copies") == 1).select("cls", "text").join(runs, "cls").mapInArrow(cut_words, CUT)
    n = count_of_words(spaced(C("text")))
    copied = texts.where(C("copies") > 1).select("cls", n.alias("n_removed"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), F.lit("").alias("kept_text")).where(C("n_removed") >= WINDOW)
    cut = tables.keep(cut.union(copied), "cut")
    tables.drop("texts", "runs")
    return cut


def without_passages(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the words of repeated passages. Texts that lose words have one space between the others; rows that lose all words
    go, as do all copies of such a text; null, short and unrepeated texts stay as they are, with all other columns."""
    tables = Tables(docs.sparkSession, "phrases")
    cut = repeated(docs, tables, text_col).select(C("cls").alias("_cut_cls"), C("kept_text").alias("_cut_text"))
    key = fresh(docs, "cls")
    met = docs.withColumn(key, text_class(text_col)).join(cut, C(key) == C("_cut_cls"), "left").where(C("_cut_cls").isNull() | (C("_cut_text") != ""))
    return met.select(*[F.coalesce("_cut_text", text_col).alias(text_col) if c == text_col else C(c) for c in docs.columns])


def op11_phrase_automata(spark, sf_dir: str) -> DataFrame:
    """What every document loses, in words, and the hash of what is left. Null and empty texts have no words; repeated rows are copies."""
    tables = Tables(spark, "phrases")
    docs = documents(spark, sf_dir)
    cut = repeated(docs, tables).drop("kept_text")
    slim = docs.select("doc_id", text_class().alias("cls"), spaced(C("text")).alias("t"))
    slim = slim.select("doc_id", "cls", count_of_words(C("t")).alias("n_words"), F.sha2(F.encode("t", "UTF-8"), 256).alias("own"))
    return slim.join(cut, "cls", "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "own").alias("kept_sha256"))


def oracle() -> str:
    return f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT k, i, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS win FROM (SELECT k, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
r AS (SELECT k, i FROM s WHERE win IN (SELECT win FROM s GROUP BY win HAVING count(*) > 1)),
g AS (SELECT DISTINCT k, unnest(range(i, i + {WINDOW})) AS p FROM r),
u AS (SELECT k, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
n AS (SELECT k, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM u ANTI JOIN g USING (k, p) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN n USING (k)"""
