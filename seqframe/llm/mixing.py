"""Mixing sources to target weights by iterative proportional fitting (native).

Token counts of (source, language, topic) cells are raked until each marginal has its target share; a document is then
sampled with its cell's calibrated probability. Only cells, whose number depends on the categories and not on the
documents, are raked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_PATTERN, Tables, documents, fresh, words_of

#: A category's target share is in proportion to its tokens to this power (below 1: small categories gain).
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.9}
#: Share of all tokens that the sample has in expectation.
BUDGET = 0.7
SWEEPS = 10
#: The category of null sources and languages.
NONE = "(none)"


def topic_of(text: Column, n_tokens: Column) -> Column:
    """The topics of the query: legal notices, then classes of length."""
    legal = F.contains(text, F.lit("icense")) | F.contains(text, F.lit("ights reserved"))
    return F.when(F.coalesce(legal, F.lit(False)), "legal").when(n_tokens < 60, "note").when(n_tokens >= 1500, "long").otherwise("prose")


def with_categories(docs: DataFrame) -> DataFrame:
    """doc_id, the three categories and n_tokens (words; 0 for null and empty texts)."""
    one = docs.select("doc_id", F.coalesce("source", F.lit(NONE)).alias("source"), F.coalesce("lang", F.lit(NONE)).alias("lang"), "text", F.size(words_of(F.col("text"))).cast("long").alias("n_tokens"))
    return one.withColumn("topic", topic_of(F.col("text"), F.col("n_tokens"))).drop("text")


def rake(cells: DataFrame, powers: dict[str, float], sweeps: int, tables: Tables) -> DataFrame:
    """Adds w: weights with the given marginals, in proportion to tokens within what the marginals leave open."""
    total = Window.partitionBy(F.lit(1))
    w = cells.withColumn("w", F.col("tokens").cast("double"))
    for name, power in powers.items():
        held = F.sum("tokens").over(Window.partitionBy(name)).cast("double")
        first = F.row_number().over(Window.partitionBy(name).orderBy(*powers)) == 1
        w = w.withColumn("_t", F.pow(held, power)).withColumn("_f", F.when(first, F.col("_t")).otherwise(0.0))
        w = w.withColumn(f"target_{name}", F.col("_t") / F.sum("_f").over(total)).drop("_t", "_f")
    w = tables.keep(w, "raked0")
    all_tokens = w.agg(F.sum("tokens")).first()[0] or 0
    for i in range(sweeps):
        for name in powers:
            have = F.sum("w").over(Window.partitionBy(name))
            w = w.withColumn("w", F.when(have > 0, F.col("w") * (F.col(f"target_{name}") * float(all_tokens)) / have).otherwise(0.0))
        if i % 2 or i == sweeps - 1:
            w = tables.keep(w, f"raked{i + 1}")
    return w.drop(*[f"target_{n}" for n in powers])


def calibrate(raked: DataFrame, budget: float) -> DataFrame:
    """Adds probability = min(1, c * w / tokens), with c such that the expected tokens are the budget's share of all.

    Cells are taken in the order of their weight for a token; the c for the first k being certain is right as soon as
    the next cell's probability is at most 1.
    """
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("rate"), "source", "lang", "topic")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    r = raked.withColumn("rate", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(0.0))
    r = r.withColumn("_sure", F.coalesce(F.sum("tokens").over(before), F.lit(0))).withColumn("_rest", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    r = r.withColumn("_c", F.when(F.col("_rest") > 0, (F.sum("tokens").over(every) * budget - F.col("_sure")) / F.col("_rest")))
    r = r.withColumn("_fits", F.when(F.col("_c") * F.col("rate") <= 1, F.col("_c")))
    c = F.first("_fits", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return r.withColumn("probability", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c * F.col("rate"), F.lit(1.0))))).drop("_sure", "_rest", "_c", "_fits")


def draw(id_col: Column) -> Column:
    """A number from 0 to 1 that depends on the id alone (null counts as empty)."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def cell_table(slim: DataFrame, powers: dict[str, float], budget: float, sweeps: int, tables: Tables) -> DataFrame:
    """weight (wanted tokens for each token) and probability of every (source, lang, topic)."""
    cells = slim.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"))
    done = calibrate(rake(cells, powers, sweeps, tables), budget)
    return tables.keep(done.select("source", "lang", "topic", F.col("rate").alias("weight"), F.when(F.col("tokens") > 0, F.col("probability")).otherwise(1.0).alias("probability")), "cells")


def mix(docs: DataFrame, powers: dict[str, float] = POWERS, budget: float = BUDGET, sweeps: int = SWEEPS) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, weight (wanted tokens for each token of the cell),
    probability and kept.

    Null sources and languages are a category of their own. Documents without tokens are kept as their cell is (with
    probability 1 in a cell without tokens). Repeated rows and rows with equal or null ids are drawn alike.
    """
    tables = Tables(docs.sparkSession, "mixing")
    slim = tables.keep(with_categories(docs), "slim")
    out = slim.join(cell_table(slim, powers, budget, sweeps, tables), ["source", "lang", "topic"])
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", (draw(F.col("doc_id")) < F.col("probability")).alias("kept"))


def sample(docs: DataFrame, powers: dict[str, float] = POWERS, budget: float = BUDGET, sweeps: int = SWEEPS) -> DataFrame:
    """The rows of docs that are drawn, with their columns as they are."""
    tables = Tables(docs.sparkSession, "mixing")
    cells = cell_table(tables.keep(with_categories(docs), "slim"), powers, budget, sweeps, tables)
    n, t, s, k, p = (fresh(docs, f"mix_{x}") for x in ("tokens", "topic", "source", "lang", "chance"))
    held = docs.withColumn(n, F.size(words_of(F.col("text"))).cast("long")).withColumn(t, topic_of(F.col("text"), F.col(n)))
    named = cells.select(F.col("source").alias(s), F.col("lang").alias(k), F.col("topic").alias(f"{t}_"), F.col("probability").alias(p))
    met = held.join(named, (F.coalesce(held["source"], F.lit(NONE)) == F.col(s)) & (F.coalesce(held["lang"], F.lit(NONE)) == F.col(k)) & (F.col(t) == F.col(f"{t}_")))
    return met.where(draw(F.col("doc_id")) < F.col(p)).select(*docs.columns)


def op7_raking(spark, sf_dir: str) -> DataFrame:
    """Every document with its raked weight, probability and whether it is drawn."""
    out = mix(documents(spark, sf_dir).select("doc_id", "text", "source", "lang"))
    return out.withColumn("weight", F.round("weight", 6)).withColumn("probability", F.round("probability", 6))


def oracle() -> str:
    parts = [
        f"slim0 AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, text, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE_PATTERN}'), lambda x: x <> '')) AS BIGINT) AS n_tokens FROM documents)",
        "slim AS (SELECT doc_id, source, lang, n_tokens, CASE WHEN coalesce(contains(text, 'icense') OR contains(text, 'ights reserved'), false) THEN 'legal' WHEN n_tokens < 60 THEN 'note' WHEN n_tokens >= 1500 THEN 'long' ELSE 'prose' END AS topic FROM slim0)",
        "cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM slim GROUP BY ALL)",
        *[f"t_{n} AS (SELECT {n}, pow(sum(tokens), {p}) / sum(pow(sum(tokens), {p})) OVER () AS share FROM cells GROUP BY {n})" for n, p in POWERS.items()],
        "w0 AS (SELECT source, lang, topic, tokens, tokens AS w, sum(tokens) OVER () AS every FROM cells)",
    ]
    last = "w0"
    for i in range(SWEEPS):
        for n in POWERS:
            new = f"w{i}_{n}"
            parts.append(f"{new} AS MATERIALIZED (SELECT a.source, a.lang, a.topic, a.tokens, a.every, CASE WHEN h.have > 0 THEN a.w * (t.share * a.every) / h.have ELSE 0 END AS w FROM {last} a JOIN t_{n} t USING ({n}) JOIN (SELECT {n}, sum(w) AS have FROM {last} GROUP BY {n}) h USING ({n}))")
            last = new
    parts += [
        f"r AS (SELECT *, CASE WHEN tokens > 0 THEN w / tokens ELSE 0 END AS rate FROM {last})",
        "s AS (SELECT *, coalesce(sum(tokens) OVER b, 0) AS sure, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS rest FROM r WINDOW b AS (ORDER BY rate DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
        f"c AS (SELECT *, CASE WHEN rest > 0 THEN (every * {BUDGET} - sure) / rest END AS c FROM s)",
        "k AS (SELECT arg_max(c, rate) AS c FROM c WHERE c * rate <= 1)",
        "p AS (SELECT source, lang, topic, rate, CASE WHEN tokens > 0 THEN least(1.0, greatest(0.0, coalesce(k.c * rate, 1.0))) ELSE 1.0 END AS probability FROM c, k)",
    ]
    draw_sql = "CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0"
    return f"WITH {', '.join(parts)} SELECT doc_id, source, lang, topic, n_tokens, round(rate, 6) AS weight, round(probability, 6) AS probability, {draw_sql} < probability AS kept FROM slim JOIN p USING (source, lang, topic)"
