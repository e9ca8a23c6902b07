"""Source divergence audit by joint count histograms.

Terms are counted by language and source in Arrow batches, before the shuffle. For each pair of sources of a language the
distinct (count, count) combinations of its kept terms are tallied; cells with a zero on one side or both are implied by
the tallies of each source alone, so no term that a source lacks is spelled out. The difference of the two shares is
evaluated once for each combination and multiplied by how many terms have it. All sums are whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, by_size, documents, freeing, parts_of

#: Documents of a language that hold a kept term, what is added to each count, what shares are multiplied by, terms reported.
LEAST_DOCS, ADDED, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Terms that a task holds before it hands its counts on, and bytes of text at a time.
HELD, SLICE_BYTES = 300_000, 2 << 20

#: A-Z become a-z; a-z and all bytes of characters beyond ASCII stay; everything else divides terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
C = F.col


@freeing
def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (lang, source, term, n, docs) of a task's texts; term '' marks a group that occurs."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            terms = pa.array([t.decode("utf-8", "replace") for t in n], pa.string())
            same = lambda x: pa.array([x] * len(n), pa.string())
            yield pa.record_batch([same(lang), same(source), terms, pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        counts.clear()

    for b in by_size(batches, SLICE_BYTES):
        for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            n, docs = counts.setdefault((lang, source), (Counter({b"": 0}), Counter()))
            held: set[bytes] = set()
            for words in parts_of(text.encode("utf-8", "surrogatepass").translate(TERM_BYTES)):
                n.update(words)
                held.update(words)
            docs.update(held)
        if sum(len(n) for n, _ in counts.values()) > HELD:
            yield from out()
    yield from out()


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + ADDED) / (total + ADDED * terms)), exactly; null without terms."""
    whole = lambda x: x.cast("decimal(20,0)")
    part = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * whole(n + ADDED), whole(total + F.lit(ADDED) * terms))
    return F.when(terms > 0, part + 1)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int | None = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (text, lang, source; null counts as ''). Part `pair`: the sum of differences
    of shares to each other source of the language, 0 where it keeps no term. Part `term`: the kept terms that a source has
    more of than its language, the `top` largest differences (None: all). Ties go by the item's bytes; repeated rows count as often as they come;
    an empty table gives no rows. Other columns of docs are not looked at."""
    tables = Tables(docs.sparkSession, "divergence")
    text = lambda c: F.coalesce(C(c), F.lit("")).alias(c)
    part = docs.select(text("text"), text("lang"), text("source")).mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
    counts = tables.keep(part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = counts.where(C("term") != "").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    kept = tables.keep(kept.where(C("docs") >= least_docs).drop("docs"), "kept")
    cells = tables.keep(counts.where(C("term") != "").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "cells")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(C(c), F.lit(0).cast("long")).alias(c)
    groups = counts.where(C("term") == "").select("lang", "source").join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = tables.keep(groups.select("lang", "source", zero("total"), zero("terms"), zero("lang_total")), "groups")
    rows = terms_of(cells, groups, top).unionByName(pairs_of(cells, groups, tables))
    return rows.select("lang", "source", "part", "item", "value", C("rank").cast("int").alias("rank"))


def terms_of(cells: DataFrame, groups: DataFrame, top: int | None) -> DataFrame:
    met = cells.join(groups, ["lang", "source"])
    value = share(C("n"), C("total"), C("terms")) - share(C("lang_n"), C("lang_total"), C("terms"))
    found = met.select("lang", "source", F.lit("term").alias("part"), C("term").alias("item"), value.alias("value")).where(C("value") > 0)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked if top is None else ranked.where(C("rank") <= top)


def joint_histogram(cells: DataFrame, groups: DataFrame, tables: Tables) -> DataFrame:
    """(lang, a, b, x, y, m): for sources a < b of a language, how many of its kept terms a has x times and b has y times. Terms
    that both have are tallied; a source's own tally, less those, gives the cells with one zero, and the number of kept terms,
    less all others, the cell with two."""
    side = lambda s, n: cells.select("lang", "term", C("source").alias(s), C("n").alias(n))
    both = side("a", "x").join(side("b", "y"), ["lang", "term"]).where(C("a") < C("b"))
    both = tables.keep(both.groupBy("lang", "a", "b", "x", "y").agg(F.count(F.lit(1)).alias("m")), "both")
    own = tables.keep(cells.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m")), "own")
    pairs = pairs_in(groups)
    none = F.lit(0).cast("long")
    cell = lambda x, y, m: F.struct(x.alias("x"), y.alias("y"), m.alias("m"))
    x, y, m = C("x"), C("y"), C("m")
    met = both.select("lang", "a", "b", F.inline(F.array(cell(x, y, m), cell(x, none, -m), cell(none, y, -m), cell(none, none, m))))
    left = pairs.join(own.select("lang", C("source").alias("a"), C("n").alias("x"), "m"), ["lang", "a"]).select("lang", "a", "b", F.inline(F.array(cell(x, none, m), cell(none, none, -m))))
    right = pairs.join(own.select("lang", C("source").alias("b"), C("n").alias("y"), "m"), ["lang", "b"]).select("lang", "a", "b", F.inline(F.array(cell(none, y, m), cell(none, none, -m))))
    rest = pairs.select("lang", "a", "b", none.alias("x"), none.alias("y"), C("terms").alias("m"))
    every = met.union(left).union(right).union(rest)
    return every.groupBy("lang", "a", "b", "x", "y").agg(F.sum("m").alias("m")).where(C("m") > 0)


def pairs_in(groups: DataFrame) -> DataFrame:
    """(lang, a, b, a_total, b_total, terms) of the sources a < b of each language: the rows of the result, each once."""
    a = groups.select("lang", C("source").alias("a"), C("total").alias("a_total"), "terms")
    return a.join(groups.select("lang", C("source").alias("b"), C("total").alias("b_total")), "lang").where(C("a") < C("b"))


def pairs_of(cells: DataFrame, groups: DataFrame, tables: Tables) -> DataFrame:
    hist = joint_histogram(cells, groups, tables)
    pairs = pairs_in(groups)
    met = hist.join(pairs, ["lang", "a", "b"])
    f = F.abs(share(C("x"), C("a_total"), C("terms")) - share(C("y"), C("b_total"), C("terms")))
    summed = met.groupBy("lang", "a", "b").agg(F.sum(f * C("m")).alias("value"))
    whole = pairs.select("lang", "a", "b").join(summed, ["lang", "a", "b"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))
    ends = F.array(F.struct(C("a").alias("source"), C("b").alias("item")), F.struct(C("b").alias("source"), C("a").alias("item")))
    rows = whole.select("lang", F.inline(ends), F.lit("pair").alias("part"), "value")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def op13_divergence(spark, sf_dir: str) -> DataFrame:
    """How the sources of each language differ from each other and from the language."""
    return audit(documents(spark, sf_dir))


def oracle() -> str:
    term = "'[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'"
    p = lambda n, total: f"CAST(1 + ({SCALE}::HUGEINT * ({n} + {ADDED})) // ({total} + {ADDED} * v) AS BIGINT)"
    return f"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS MATERIALIZED (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {term})) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS total FROM k GROUP BY lang),
c AS MATERIALIZED (SELECT g.lang, g.source, k.term, k.n AS lang_n, coalesce(x.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
s AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY lang, source),
p AS MATERIALIZED (SELECT c.lang, c.source, c.term, c.n, {p('c.n', 's.total')} AS p, {p('c.lang_n', 'v.total')} AS q FROM c JOIN s ON s.lang = c.lang AND s.source = c.source JOIN v ON v.lang = c.lang),
f AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= {TOP}"""
