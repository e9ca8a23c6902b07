"""Language identification of words and texts by a linear-chain conditional random field.

Each line of a text is a sequence of words. A word's emission scores add up weights of its affixes, character
n-grams and lexicon memberships; learned transitions link neighbouring words; forward-backward gives each word's
label posteriors, also in code-switched text. A text's language has the largest mean posterior over its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, freeing, fresh, words_of

#: The model is fitted on at most DOCS_PER_LANG documents of each language, WINDOWS windows of WINDOW_WORDS words each.
DOCS_PER_LANG, WINDOWS, WINDOW_WORDS = 300, 6, 32
LEXICON_WORDS = 400
BUCKETS = 1 << 16
#: Texts are labelled in groups of about so many bytes, which bounds memory; a longer text makes a group of its own.
GROUP_BYTES = 2 << 20
MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)
EDGE = np.uint64(3)


def clean(words: pa.Array) -> pa.Array:
    """Lower-cased words without what is not a letter at either end; empty if a word has no letter."""
    return pc.replace_substring_regex(pc.utf8_lower(words), r"^\PL+|\PL+$", "")


class WordFeatures:
    """Hashed features of distinct cleaned words: ids of n-grams (orders 2 and 3, affixes with the word's edge up to 3 letters)."""

    def __init__(self, words: list[str]):
        text = "".join(f"\x02{w}\x03" for w in words)
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        lengths = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
        self.starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(words) else np.zeros(0, np.int64)
        self.n, self.empty = len(words), lengths == 2
        ends = np.repeat(self.starts + lengths, lengths)
        at = np.arange(len(c))
        pad = np.concatenate([c, np.zeros(3, np.uint64)])
        h, self.ids = np.zeros(len(c), np.uint64), []
        edge = (c == 2) | (c == EDGE)
        with np.errstate(over="ignore"):
            for k in range(4):
                h = h + pad[k : k + len(c)] * MULT[k]
                if not k:
                    continue
                ids = ((h ^ (h >> np.uint64(29))) * MULT[0] >> np.uint64(48)).astype(np.int64) + 1
                ok = at + k < ends
                if k == 3:
                    ok &= edge | np.concatenate([edge, np.zeros(3, bool)])[3:]
                self.ids.append(np.where(ok, ids, 0))  # 0: no feature
            place = (at - np.repeat(self.starts, lengths)).astype(np.uint64)
            mixed = (c + np.uint64(7)) * (place * MULT[1] | np.uint64(1))
            mixed ^= mixed >> np.uint64(31)
            self.word_hash = np.add.reduceat(mixed * MULT[2], self.starts) if len(words) else np.zeros(0, np.uint64)

    def scores(self, weights: np.ndarray, lexicon: np.ndarray, member: np.ndarray, lex_weights: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.zeros((0, weights.shape[1]), np.float32)
        per_char = weights[self.ids[0]]
        for ids in self.ids[1:]:
            per_char += weights[ids]
        out = np.add.reduceat(per_char, self.starts, axis=0)
        out += self.members(lexicon, member) @ lex_weights
        out[self.empty] = 0
        return out

    def members(self, lexicon: np.ndarray, member: np.ndarray) -> np.ndarray:
        if not len(lexicon):
            return np.zeros((self.n, member.shape[1]), np.float32)
        i = np.minimum(np.searchsorted(lexicon, self.word_hash), len(lexicon) - 1)
        return np.where((lexicon[i] == self.word_hash)[:, None], member[i], 0)


def posteriors(emission: np.ndarray, starts: np.ndarray, lengths: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over many sequences at once. emission: (words, labels); returns posteriors and, for each word but
    a sequence's last, the sum over positions of pair posteriors is available through the second value (labels, labels)."""
    n, k = emission.shape
    e = np.exp(emission - emission.max(axis=1, keepdims=True)).astype(np.float32) + np.float32(1e-12)
    a = np.exp(trans).astype(np.float32)
    alpha, beta = np.empty((n, k), np.float32), np.empty((n, k), np.float32)
    order = np.argsort(-lengths, kind="stable")
    s, m = starts[order], lengths[order]
    most = int(m[0]) if len(m) else 0
    active = np.searchsorted(-m, -np.arange(most), side="left")  # sequences longer than t
    x = np.exp(first - first.max()).astype(np.float32)
    for t in range(most):
        i = s[: active[t]] + t
        v = e[i] * (x if t == 0 else alpha[i - 1] @ a)
        alpha[i] = v / v.sum(axis=1, keepdims=True)
    last = s + m - 1
    beta[last[m > 0]] = 1
    pairs = np.zeros((k, k))
    for t in range(most - 2, -1, -1):
        i = s[: active[t + 1]] + t
        w = e[i + 1] * beta[i + 1]
        v = w @ a.T
        both = alpha[i].T @ (w / np.maximum((alpha[i] * v).sum(axis=1, keepdims=True), 1e-30))
        pairs += both * a
        beta[i] = v / v.sum(axis=1, keepdims=True)
    g = alpha * beta
    return g / g.sum(axis=1, keepdims=True), pairs


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    member: np.ndarray
    lex_weights: np.ndarray
    trans: np.ndarray
    first: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        return WordFeatures(words).scores(self.weights, self.lexicon, self.member, self.lex_weights)

    def label(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Posteriors of every word, which words have letters, and each word's text."""
        lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
        of_line = pc.list_parent_indices(lines).to_numpy()
        words = pc.ascii_split_whitespace(lines.flatten())
        lengths = pc.list_value_length(words).to_numpy().astype(np.int64)
        coded = words.flatten().dictionary_encode()
        cleaned = clean(coded.dictionary).dictionary_encode()
        names = cleaned.dictionary.to_pylist()
        ids = cleaned.indices.to_numpy()[coded.indices.to_numpy()]
        g, _ = posteriors(self.emissions(names)[ids], np.cumsum(lengths) - lengths, lengths, self.trans, self.first)
        spoken = np.array([w != "" for w in names], dtype=bool)[ids] if len(names) else np.zeros(0, bool)
        return g, spoken, np.repeat(of_line, lengths)

    def predict(self, texts: pa.Array) -> pd.DataFrame:
        """lang_pred, score and n_switches (neighbouring words of one text with different labels) of each text."""
        n, k = len(texts), len(self.langs)
        if not k:
            return pd.DataFrame({"lang_pred": ["und"] * n, "score": np.zeros(n), "n_switches": np.zeros(n, np.int64)})
        g, spoken, of = self.label(texts)
        g, of = g[spoken], of[spoken]
        total = np.stack([np.bincount(of, weights=g[:, j], minlength=n) for j in range(k)], axis=1)
        count = np.bincount(of, minlength=n)
        share = total / np.maximum(count, 1)[:, None]
        best = share.argmax(axis=1)
        top = g.argmax(axis=1)
        switch = (top[1:] != top[:-1]) & (of[1:] == of[:-1])
        names = np.array([*self.langs, "und"], dtype=object)
        return pd.DataFrame({
            "lang_pred": names[np.where(count > 0, best, k)],
            "score": np.where(count > 0, np.clip(share[np.arange(n), best], 0, 1), 0.0),
            "n_switches": np.bincount(of[1:][switch], minlength=n).astype(np.int64),
        })


def train(samples: list[tuple[str, list[str]]], rounds: int = 25, rate: float = 0.15, decay: float = 1e-4, seed: int = 7) -> Model:
    """Fits the field to (language, words of a window). Half of the windows are cut and joined with another language's,
    so that transitions are learned on code-switched sequences. No samples: a model without labels, which answers `und`."""
    langs = sorted({s[0] for s in samples})
    k = len(langs)
    rng = np.random.default_rng(seed)
    code = {x: i for i, x in enumerate(langs)}
    windows = [(code[x], w) for x, w in sorted(samples, key=lambda s: (s[0], s[1])) if w]
    sequences: list[tuple[list[str], list[int]]] = []
    for i, (y, w) in enumerate(windows):
        z, v = windows[int(rng.integers(len(windows)))]
        cut = int(rng.integers(1, len(w) + 1)) if i % 2 else len(w)
        sequences.append((w[:cut] + v[cut:], [y] * cut + [z] * len(v[cut:])))
    flat = pa.array([w for ws, _ in sequences for w in ws], pa.string())
    coded = clean(flat).dictionary_encode() if len(flat) else pa.array([], pa.string()).dictionary_encode()
    names, ids = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    y = np.array([c for _, ys in sequences for c in ys], dtype=np.int64)
    lengths = np.array([len(ws) for ws, _ in sequences], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    x = WordFeatures(names)
    # Lexicons: the most frequent words of each language.
    counts = np.zeros((len(names), max(k, 1)))
    np.add.at(counts, (ids, y), 1)
    chosen = np.zeros((len(names), k), np.float32)
    for j in range(k):
        top = np.lexsort((np.arange(len(names)), -counts[:, j]))[:LEXICON_WORDS]
        chosen[top[(counts[top, j] >= 3) & ~x.empty[top]], j] = 1
    listed = np.flatnonzero(chosen.any(axis=1)) if k else np.zeros(0, np.int64)
    by_hash = listed[np.argsort(x.word_hash[listed])]
    model = Model(langs, np.zeros((BUCKETS + 1, k), np.float32), x.word_hash[by_hash], chosen[by_hash], np.zeros((k, k), np.float32), np.zeros((k, k), np.float32), np.zeros(k, np.float32))
    if not len(y):
        return model
    member = x.members(model.lexicon, model.member)
    true_pairs = np.zeros((k, k))
    inner = np.ones(len(y), bool)
    inner[starts + lengths - 1] = False
    np.add.at(true_pairs, (y[inner.nonzero()[0]], y[inner.nonzero()[0] + 1]), 1)
    params = [model.weights, model.lex_weights, model.trans, model.first]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    widths = np.diff(np.append(x.starts, len(x.ids[0])))
    for step in range(1, rounds + 1):
        g, pairs = posteriors(model.emissions(names)[ids], starts, lengths, model.trans, model.first)
        diff = -g.astype(np.float64)
        diff[np.arange(len(y)), y] += 1
        types = np.stack([np.bincount(ids, weights=diff[:, j], minlength=len(names)) for j in range(k)], axis=1)
        types[x.empty] = 0
        spread = np.repeat(types, widths, axis=0)
        grad = np.zeros((BUCKETS + 1, k))
        for one in x.ids:
            grad += np.stack([np.bincount(one, weights=spread[:, j], minlength=BUCKETS + 1) for j in range(k)], axis=1)
        grad[0] = 0
        grads = [grad / len(y), member.T @ types / len(y), (true_pairs - pairs) / len(y), diff[starts].sum(axis=0) / len(y)]
        for p, d, a, b in zip(params, grads, m1, m2, strict=True):
            d = d - decay * p / len(y)
            a[...] = 0.9 * a + 0.1 * d
            b[...] = 0.98 * b + 0.02 * d * d
            p += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.98**step)) + 1e-8)
    return model


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by 5; false for a null id, which is not learned from either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame) -> Model:
    """Learns from text and lang of a bounded sample of each language's documents that are not held out, by the hash of doc_id."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))  # a row for each language
    u = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.join(F.broadcast(counts), "lang").where(u < 1.5 * DOCS_PER_LANG / F.col("n")).select("doc_id", "lang", words_of(F.col("text")).alias("w"))
    start = [F.pmod(F.xxhash64("doc_id", F.lit(j)), F.greatest(F.lit(1), F.size("w") - WINDOW_WORDS + 1)) for j in range(WINDOWS)]
    cut = drawn.select("doc_id", "lang", F.array(*[F.slice("w", (s + 1).cast("int"), WINDOW_WORDS) for s in start]).alias("w"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(6)), "doc_id"))
    rows = cut.withColumn("place", place).where(F.col("place") <= DOCS_PER_LANG).collect()
    return train([(r["lang"], list(w)) for r in rows for w in r["w"]])


def groups(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    a, total = 0, 0
    for i, s in enumerate(sizes):
        if total and total + s > most:
            yield a, i
            a, total = i, 0
        total += int(s)
    if a < len(sizes):
        yield a, len(sizes)


def identify(docs: DataFrame, model: Model, text_col: str = "text", into: str = "_language") -> DataFrame:
    """Adds a struct (lang_pred, score, n_switches) for every row. Null, empty and letterless texts: `und`, score 0."""

    @F.pandas_udf("lang_pred string, score double, n_switches long")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from freeing(labelled)(batches)

    def labelled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = pa.array(b, pa.large_string(), from_pandas=True)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            parts = [model.predict(texts.slice(i, j - i)) for i, j in groups(sizes, GROUP_BYTES)]
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"lang_pred": [], "score": [], "n_switches": []})

    return docs.withColumn(into, label(F.col(text_col)))


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows whose text has a language with at least this score; the columns stay as they are. Where nothing can be
    learned (no row has a text, an id and a language) all rows stay."""
    model = fit(docs)
    if not model.langs:
        return docs
    into = fresh(docs, "language")
    known = identify(docs, model, into=into)
    return known.where((F.col(f"{into}.lang_pred") != "und") & (F.col(f"{into}.score") >= least)).drop(into)


def op1_crf_language(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), "_language.*")
