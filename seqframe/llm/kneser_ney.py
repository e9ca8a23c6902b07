"""Quality classifier: an interpolated modified Kneser-Ney model over the characters of texts.

The model is counted on trusted text. N-grams run over all characters of a text, across word borders, so word order and
repetition count; white space between words counts as one space. Counts, continuation counts and discounts are tables;
the n-grams that the documents need are resolved by joins on their keys, from the longest order down to single
characters, and come back to blocks of documents, where perplexities are summed. A document is kept if its perplexity is
within a quantile of the trusted documents of its language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, by_size, documents, freeing

ORDER = 5
#: What comes before a text, and what ends each word of it. White space can't be part of a word.
START, END = "\n", " "
#: Bytes of text in a block of documents, about: n-grams of a block are asked for once.
BLOCK_BYTES = 64 << 20
#: Bytes of text that are held as numbers at a time, about, and n-grams whose counts a task holds.
SLICE_BYTES, HELD = 4 << 20, 500_000
#: Numbers below this are ranked by a table, others by sorting.
TABLE = 1 << 24
#: Parts that a language's rows are dealt into when they meet their threshold.
SALTS = 64
#: Kept: perplexity up to this quantile of the trusted documents of the language, times the margin.
QUANTILE, MARGIN = 0.99, 1.25


def lines(texts: pa.Array) -> list[str]:
    """Each text as n-grams see it: its words, each followed by END; empty without words."""
    words = pc.binary_join(pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, ""))), END)
    return [t + END if t else "" for t in words.to_pylist()]


def ranked(x: np.ndarray) -> tuple[int, np.ndarray]:
    """How many distinct numbers there are, and for each number how many distinct ones are smaller."""
    top = int(x.max()) + 1 if len(x) else 0
    if top > TABLE:
        distinct, ranks = np.unique(x, return_inverse=True)
        return len(distinct), ranks.astype(np.int32)
    seen = np.zeros(top, bool)
    seen[x] = True
    place = np.cumsum(seen, dtype=np.int32)
    return int(place[-1]) if top else 0, place[x] - 1


def grams_of(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The distinct ORDER-grams that predict each character of the texts, in the order of their characters, and for each
    character of the texts, one text after the other, the number of its n-gram."""
    codes = np.frombuffer("".join(START * (ORDER - 1) + t for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    if len(codes) < ORDER:
        return [], np.zeros(0, np.int32)
    n, chars = ranked(codes)
    at = np.flatnonzero(codes != ord(START)).astype(np.int32)
    ranks = chars[at - (ORDER - 1)]
    for k in range(ORDER - 2, -1, -1):
        longer = ranks.astype(np.int64)
        longer *= n
        longer += chars[at - k]
        many, ranks = ranked(longer)
    place = np.empty(many if len(at) else 0, np.int32)
    place[ranks] = at
    joined = codes[place[:, None] + np.arange(1 - ORDER, 1)].tobytes().decode("utf-32-le", "surrogatepass")
    return [joined[i : i + ORDER] for i in range(0, len(joined), ORDER)], ranks


@freeing
def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of n-grams in a task's texts."""
    total: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["gram", "n"])

    for b in by_size(batches, SLICE_BYTES):
        grams, ranks = grams_of(lines(b.column("text").cast(pa.string())))
        for g, n in zip(grams, np.bincount(ranks, minlength=len(grams)).tolist(), strict=True):
            total[g] += n
        if len(total) > HELD:
            yield out()
            total.clear()
    yield out()


class Model:
    """Tables p1 .. p{ORDER}: the probability part of each seen n-gram; b1 .. : the weight left to the shorter order by context."""

    def __init__(self, tables: Tables, floor: float):
        self.tables, self.floor = tables, floor
        self.prob: dict[int, DataFrame] = {}
        self.rest: dict[int, DataFrame] = {}


def train(texts: DataFrame, tables: Tables) -> Model:
    """Counts the column text. An empty table gives a model that finds every character equally likely."""
    counted = texts.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count_grams, "gram string, n long")
    counts = tables.keep(counted.groupBy("gram").agg(F.sum("n").alias("n")), f"count{ORDER}")
    symbols = 0
    model = Model(tables, 1.0)
    for k in range(ORDER, 0, -1):
        # Modified Kneser-Ney discounts from the numbers of n-grams that come once to four times.
        c = counts.agg(*[F.sum(F.when(F.col("n") == i, 1).otherwise(0)).alias(f"c{i}") for i in (1, 2, 3, 4)]).first()
        c = [0] + [x or 0 for x in c]
        y = c[1] / (c[1] + 2 * c[2]) if c[1] and c[2] else 0.5
        d = [0.0] + [min(max(i - (i + 1) * y * c[i + 1] / c[i], 0.05), i - 0.05) if c[i] else 0.5 * i for i in (1, 2, 3)]
        cut = F.when(F.col("n") == 1, d[1]).when(F.col("n") == 2, d[2]).otherwise(d[3])
        parts = counts.select("gram", F.substring("gram", 1, k - 1).alias("context"), "n", cut.alias("cut"))
        sums = tables.keep(parts.groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("left")), f"context{k}")
        if k > 1:
            model.prob[k] = tables.keep(parts.join(sums, "context").select("gram", ((F.col("n") - F.col("cut")) / F.col("total")).alias("p")), f"p{k}")
            model.rest[k] = tables.keep(sums.select("context", (F.col("left") / F.col("total")).alias("b")), f"b{k}")
            # Continuation counts: in how many different n-grams the shorter one ends.
            counts = tables.keep(counts.groupBy(F.substring("gram", 2, k - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"count{k - 1}")
            tables.drop(f"count{k}", f"context{k}")
            tables.tidy()
        else:
            row = sums.first()
            total, left = (float(row["total"]), float(row["left"])) if row else (1.0, 1.0)
            symbols = counts.count() + 1  # and one for all unseen characters
            model.floor = left / total / symbols
            model.prob[1] = tables.keep(parts.select("gram", ((F.col("n") - F.col("cut")) / F.lit(total) + F.lit(model.floor)).alias("p")), "p1")
    return model


def resolve(needed: DataFrame, model: Model, tables: Tables) -> DataFrame:
    """(gram, logp) of distinct n-grams (column gram) of full order: one join on n-grams and one on contexts for each order."""
    wanted = {ORDER: needed.select("gram")}
    for k in range(ORDER - 1, 0, -1):
        wanted[k] = tables.keep(wanted[k + 1].select(F.substring("gram", 2, k).alias("gram")).distinct(), f"wanted{k}")
    lower = tables.keep(wanted[1].join(model.prob[1], "gram", "left").select("gram", F.coalesce("p", F.lit(model.floor)).alias("p")), "known1")
    for k in range(2, ORDER + 1):
        w = wanted[k].select("gram", F.substring("gram", 1, k - 1).alias("context"), F.substring("gram", 2, k - 1).alias("shorter"))
        w = w.join(model.prob[k], "gram", "left").join(model.rest[k], "context", "left").join(lower.select(F.col("gram").alias("shorter"), F.col("p").alias("q")), "shorter")
        lower = tables.keep(w.select("gram", (F.coalesce("p", F.lit(0.0)) + F.coalesce("b", F.lit(1.0)) * F.col("q")).alias("p")), f"known{k}")
        tables.drop(f"known{k - 1}", f"wanted{k - 1}")
        tables.tidy()
    return lower.select("gram", F.ln("p").alias("logp"))


BLOCKS = "block long, kind int, gram string, number int, doc_id long, lang string, n_chars long, texts binary, needs binary"


@freeing
def make_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts a task's documents into blocks of slices. A block is: each slice's texts and the numbers of the distinct n-grams that
    they need (kind 1: a row for a slice), its documents in the order of their texts (kind 2, by number), and its distinct
    n-grams, numbered as they come (kind 0)."""
    task, block = TaskContext.get().partitionId(), 0
    number: dict[str, int] = {}
    count = size = docs = 0
    zipped = lambda x: len(x).to_bytes(8, "little") + pa.Codec("zstd", compression_level=6).compress(x, asbytes=True)
    for part in by_size(batches, SLICE_BYTES):
        texts, at = lines(part.column("text").cast(pa.string())), (task << 32) | block
        before, grams = len(number), grams_of(texts)[0]
        numbers = np.array([number.setdefault(g, len(number)) for g in grams], np.int32)
        new = [g for g, n in zip(grams, numbers.tolist(), strict=True) if n >= before]
        yield block_rows(at, 0, range(before, len(number)), gram=pa.array(new, pa.string()))
        packed = "".join(texts).encode("utf-8", "surrogatepass")
        yield block_rows(at, 1, [count], texts=pa.array([zipped(packed)], pa.binary()), needs=pa.array([zipped(numbers.tobytes())], pa.binary()), n_chars=pa.array([len(texts)], pa.int64()))
        lengths = pa.array([len(t) for t in texts], pa.int64())
        yield block_rows(at, 2, range(docs, docs + len(texts)), doc_id=part.column("doc_id"), lang=part.column("lang"), n_chars=lengths)
        count, size, docs = count + 1, size + len(packed), docs + len(texts)
        if size >= BLOCK_BYTES:
            number, count, size, docs, block = {}, 0, 0, 0, block + 1


def block_rows(block: int, kind: int, numbers, **columns) -> pa.RecordBatch:
    n = len(numbers)
    made = {"block": pa.array(np.full(n, block, np.int64)), "kind": pa.array(np.full(n, kind, np.int32)), "number": pa.array(list(numbers), pa.int32())}
    kinds = (("gram", pa.string()), ("doc_id", pa.int64()), ("lang", pa.string()), ("n_chars", pa.int64()), ("texts", pa.binary()), ("needs", pa.binary()))
    made |= {c: columns[c] if c in columns else pa.nulls(n, t) for c, t in kinds}
    names = ["block", "kind", "gram", "number", "doc_id", "lang", "n_chars", "texts", "needs"]
    return pa.record_batch([made[c] for c in names], names=names)


SCORES = "doc_id long, lang string, n_chars long, log_prob double"


def score_block(key, block: pd.DataFrame, grams: pd.DataFrame) -> pd.DataFrame:
    """Sums the logarithms of a block's n-grams by document, a slice at a time."""
    docs = block[block["kind"] == 2].sort_values("number")
    lengths = docs["n_chars"].to_numpy(np.int64)
    logs = np.full(len(grams), np.nan)
    logs[grams["number"].to_numpy()] = grams["logp"].to_numpy()
    plain = lambda x: pa.Codec("zstd").decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True)
    sums, at = [], 0
    for texts, needs, n in block[block["kind"] == 1].sort_values("number")[["texts", "needs", "n_chars"]].itertuples(index=False):
        joined = plain(texts).decode("utf-8", "surrogatepass")
        own = lengths[at : at + int(n)]
        ends = np.cumsum(own)
        ranks = grams_of([joined[z - k : z] for k, z in zip(own.tolist(), ends.tolist(), strict=True)])[1]
        each = logs[np.frombuffer(plain(needs), np.int32)][ranks]
        sums.extend(float(each[z - k : z].sum()) for k, z in zip(own.tolist(), ends.tolist(), strict=True))
        at += int(n)
    return pd.DataFrame({"doc_id": docs["doc_id"].astype("Int64"), "lang": docs["lang"], "n_chars": lengths, "log_prob": sums})


def perplexities(docs: DataFrame, model: Model, tables: Tables) -> DataFrame:
    """docs has doc_id, text and lang; each row gets n_chars (with word ends) and log_prob."""
    # A task makes a block, or several: n-grams are asked for fewer times if small partitions make one together.
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(-(-size // BLOCK_BYTES), docs.sparkSession.sparkContext.defaultParallelism)
    parts = tables.keep_bucketed(docs.select("doc_id", "text", "lang").coalesce(tasks).mapInArrow(make_blocks, BLOCKS), "blocks", "block")
    asked = parts.where(F.col("kind") == 0).select("block", "gram", "number")
    logs = resolve(tables.keep(asked.select("gram").distinct(), f"wanted{ORDER}"), model, tables)
    tables.tidy()
    answers = asked.join(logs, "gram").select(F.col("block").alias("of"), "number", "logp")
    blocks = parts.where(F.col("kind") != 0).select("block", "kind", "number", "doc_id", "lang", "n_chars", "texts", "needs")
    # Answers are written first, so that their join's shuffle is gone when they are dealt to their blocks, which stay where they are.
    answers = tables.keep(answers, "answers")
    tables.drop(f"known{ORDER}", f"wanted{ORDER}")
    tables.tidy()
    return blocks.groupBy("block").cogroup(answers.groupBy("of")).applyInPandas(score_block, SCORES)


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """One row per document: doc_id, lang, n_chars, perplexity (of a character; null without words), threshold and kept.

    trusted: the doc_ids whose text trains the model. Null languages are one language of their own. A language without
    trusted documents has the quantile over all trusted ones (quantiles are those of percentile_approx at an accuracy of
    10,000: exact for fewer trusted documents); without any trusted document everything is kept. Documents
    without words (null, empty) are not kept. Null ids are scored like any other and are never trusted.
    """
    tables = Tables(docs.sparkSession, "kneser_ney")
    marks = trusted.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().withColumn("_mark", F.lit(True))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = train(base.join(marks, "doc_id", "left_semi").select("text"), tables)
    tables.tidy()
    # Marks are joined to scores: texts are not shuffled for them.
    scored = perplexities(base, model, tables).join(marks, "doc_id", "left")
    scored = tables.keep(scored.withColumn("trusted", F.coalesce("_mark", F.lit(False))).drop("_mark"), "scored")
    p = F.when(F.col("n_chars") > 0, F.exp(-F.col("log_prob") / F.col("n_chars")))
    scored = scored.withColumn("perplexity", p).withColumn("_lang", F.coalesce("lang", F.lit("")))
    good = scored.where(F.col("trusted") & F.col("perplexity").isNotNull())
    cuts = good.groupBy("_lang").agg((F.percentile_approx("perplexity", quantile, 10_000) * margin).alias("_cut"))
    every = good.agg(F.percentile_approx("perplexity", quantile, 10_000)).first()[0]
    limit = F.coalesce("_cut", F.lit(every * margin if every is not None else float("inf")))
    # A language may hold most rows: they are dealt over SALTS keys, each with a copy of the threshold.
    cuts = cuts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = scored.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "log_prob"), F.lit(SALTS)).cast("int"))
    out = salted.join(cuts, ["_lang", "_salt"], "left").withColumn("threshold", limit)
    return out.select("doc_id", "lang", "n_chars", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"))


def op8_kneser_ney(spark, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of every document; documents labelled good and not toxic are trusted."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(documents(spark, sf_dir), labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)))
