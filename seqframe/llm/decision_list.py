"""Quality rules as a learned decision list (native).

Text statistics are Spark array expressions inside each row. Rules are learned from labelled statistics by
sequential covering: a conjunction of thresholds grows by information gain, is pruned on rows set aside, and
is kept if it is precise there. The list becomes one ordered Spark conditional.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Tables, documents, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Labelled rows that the list is fitted on at most, drawn by the hash of their id.
SAMPLE_ROWS = 4096


def with_statistics(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words; the text itself goes.

    Null and empty texts count 0 throughout. keep: columns of df that stay (all but the text if not given).
    """
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    names = {c: f"_keep{i}" for i, c in enumerate(keep)}
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = df.select(*[F.col(c).alias(n) for c, n in names.items()], text.alias("_text"))
    chars = F.char_length("_text")
    spaces = sum((F.octet_length("_text") - F.octet_length(F.replace(F.col("_text"), F.lit(s), F.lit(""))) for s in SPACES), F.lit(0))
    symbols = sum((F.octet_length("_text") - F.octet_length(F.replace(F.col("_text"), F.lit(s), F.lit(""))) for s in SYMBOLS), F.lit(0))
    one = base.select(
        *names.values(),
        (chars - spaces).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        F.filter(F.split("_text", "\n"), lambda x: F.translate(x, SPACES, "") != "").alias("_lines"),
        F.transform(words_of(F.col("_text")), lambda w: F.xxhash64(w)).alias("_h"),
    )
    two = one.select(
        *names.values(), "word_chars", "n_symbols",
        F.size("_h").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_h") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_h") - WINDOW), lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(WINDOW)])))
        .otherwise(F.array().cast("array<bigint>")).alias("_win"),
    )
    made = ["word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines"]
    three = two.select(
        *names.values(), *made,
        # hash and place of each window, in hash order, where some window comes twice
        F.when(F.size(F.array_distinct("_win")) < F.size("_win"), F.array_sort(F.transform("_win", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("_sorted"),
    )
    twice = F.filter(
        F.transform("_sorted", lambda s, k: F.when((s["x"] == F.get("_sorted", k - 1)["x"]) | (s["x"] == F.get("_sorted", k + 1)["x"]), s["i"])),
        lambda p: p.isNotNull(),
    )
    covered = F.aggregate(
        F.array_sort(twice),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n")),
        lambda a: a["n"],
    )
    return three.select(
        *[F.col(n).alias(c) for c, n in names.items()], *made,
        F.when(F.col("_sorted").isNotNull(), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def features() -> dict[str, Column]:
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": ratio("word_chars", "n_words"),
        "symbol_share": ratio("n_symbols", "word_chars"),
        "dup_line_share": ratio("n_dup_lines", "n_lines"),
        "repeat_share": ratio("n_repeat_words", "n_words"),
        "line_words": ratio("n_words", "n_lines"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """Rejects rows that meet every (feature, '<=' or '>', threshold)."""

    tests: tuple[tuple[str, str, float], ...]
    precision: float

    def holds(self, row: dict) -> bool:
        return all((row[f] <= t) if op == "<=" else (row[f] > t) for f, op, t in self.tests)

    def column(self, cols: dict[str, Column]) -> Column:
        out = F.lit(True)
        for f, op, t in self.tests:
            out = out & ((cols[f] <= t) if op == "<=" else (cols[f] > t))
        return out


def learn(rows: list[tuple[dict, int]], max_rules: int = 8, max_tests: int = 3, least_precision: float = 0.9, least_cover: int = 3, cuts: int = 24) -> list[Rule]:
    """Sequential covering of the bad rows (label 0). rows: (features, label). No bad or no good rows: no rules."""
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    rules: list[Rule] = []

    def counts(tests, data):
        rule = Rule(tuple(tests), 0)
        met = [y for x, y in data if rule.holds(x)]
        return len(met) - sum(met), sum(met)  # bad, good

    while len(rules) < max_rules and any(y == 0 for _, y in grow):
        tests: list = []
        inside = grow
        while len(tests) < max_tests:
            bad, good = sum(1 - y for _, y in inside), sum(y for _, y in inside)
            if not bad or not good:
                break
            now, best = math.log2(bad / (bad + good)), (1e-9, None)
            for f in inside[0][0]:
                values = sorted({x[f] for x, _ in inside})
                if len(values) < 2:
                    continue
                at = sorted({int(i * (len(values) - 1) / cuts) for i in range(cuts)} | {0, len(values) - 2})
                for i in at:
                    t = (values[i] + values[i + 1]) / 2
                    for op in ("<=", ">"):
                        met = [y for x, y in inside if ((x[f] <= t) if op == "<=" else (x[f] > t))]
                        p, q = len(met) - sum(met), sum(met)
                        if p and (gain := p * (math.log2(p / (p + q)) - now)) > best[0]:
                            best = (gain, (f, op, t))
            if best[1] is None:
                break
            tests.append(best[1])
            inside = [(x, y) for x, y in inside if ((x[best[1][0]] <= best[1][2]) if best[1][1] == "<=" else (x[best[1][0]] > best[1][2]))]
        if not tests:
            break

        def worth(ts):
            p, q = counts(ts, prune)
            return (p - q) / (p + q) if p + q else -1.0

        while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
            tests.pop()
        p, q = counts(tests, rows)
        pp, pq = counts(tests, prune)
        if p < least_cover or p / (p + q) < least_precision or (pp + pq and pp / (pp + pq) < least_precision):
            break
        rules.append(Rule(tuple(tests), p / (p + q)))
        grow = [r for r in grow if not rules[-1].holds(r[0])]
        prune = [r for r in prune if not rules[-1].holds(r[0])]
    return rules


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """The list as ordered conditionals: kept, and the number of the rule that fired (null: the default, keep)."""
    cols = features()
    kept, number = F.when(F.lit(False), F.lit(False)), F.when(F.lit(False), F.lit(0))
    for i, r in enumerate(rules):
        kept, number = kept.when(r.column(cols), F.lit(False)), number.when(r.column(cols), F.lit(i + 1))
    return kept.otherwise(F.lit(True)), number


def apply_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, list[Rule]]:
    """Statistics and verdict for every row of df; rules learned from at most sample_rows labelled rows.

    Conflicting labels of one id count as bad; null labels and ids are not learned from.
    """
    tables = Tables(df.sparkSession, "quality")
    stats = tables.keep(with_statistics(df.select(F.col(id_col).alias("doc_id"), F.col("text"))), "stats")
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_label"))
    cols = features()
    drawn = (
        stats.join(known, "doc_id")
        .select(F.col("doc_id"), "_label", *[c.alias(f) for f, c in cols.items()])
        .orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id", *cols)
        .limit(sample_rows)
    )
    rows = [({f: float(r[f]) for f in cols}, int(r["_label"])) for r in drawn.collect()]
    rules = learn(rows)
    kept, number = verdict(rules)
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", number).withColumn("kept", ~F.col("base_failed") & kept)
    return out.withColumnRenamed("doc_id", id_col), rules


def op3_decision_list(spark, sf_dir: str) -> DataFrame:
    """Statistics, base verdict and learned verdict of every document."""
    out, _ = apply_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "rule")
