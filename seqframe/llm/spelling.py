"""Spelling variant grouping by an even-partition pigeonhole join.

Words are counted in Arrow batches, before the shuffle. Two words that differ by one edit agree, with the longer one's part
shifted by at most one place, on one of the shorter word's two halves. So each word is indexed by its two halves and
probes, for words of its own length and one shorter, with its substrings at the two places that fit. What is left of two
words after the half that agrees differs by one edit again: a key that brings too many words together is divided by the
halves of what is left, and so on, down to single letters. A pair follows the first half wherever that agrees, so it
meets under one key only. Every candidate is verified.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, by_size, documents, freeing, parts_of

#: Of the documents' runs of letters one in SPOILT loses a letter. Words have so many letters and come so often at least.
SPOILT, LEAST_LENGTH, LEAST_COUNT = 97, 5, 3
#: A form comes so many times as often.
TIMES = 2
#: A key with more candidate pairs is divided.
LIMIT = 4096
#: Words that a task holds before it hands their counts on, and bytes of text at a time.
HELD, SLICE_BYTES = 300_000, 2 << 20

#: Latin-1: A-Z become a-z; a-z and 0xC0 to 0xFF stay; everything else divides runs.
RUN_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
C = F.col


def spoil(run: bytes, start: int) -> bytes:
    """The run (Latin-1), without a letter if its checksum, which goes on from `start`, says so."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % SPOILT:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1 :]


@freeing
def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (word, n) of a task's texts (id, text)."""
    total: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        made = pa.record_batch([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
        total.clear()
        return made

    for b in by_size(batches, SLICE_BYTES):
        for key, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
            start, own = zlib.crc32(f"{key}:".encode()), Counter()
            for runs in parts_of(text.encode("latin-1", "replace").translate(RUN_BYTES)):
                own.update(runs)
            for run, n in own.items():
                if len(run) >= LEAST_LENGTH and len(word := spoil(run, start)) >= LEAST_LENGTH:
                    total[word] += n
        if len(total) > HELD:
            yield out()
    yield out()


def words_in(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of docs (doc_id, text). A null text has none; a null id counts as an empty one."""
    rows = docs.select(F.coalesce(C("doc_id").cast("string"), F.lit("")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(C("n") >= least)


def halves(rows: DataFrame) -> DataFrame:
    """Rows (probe, shift, key, a, z, firsts, word, n) divided: [a, z) is what is left of the shorter word, its letters before a
    and from z on agree. Either the first half agrees and the second is left, or the second half agrees (in the longer word, shifted
    by one place) and the first is left; then the first half is noted, since those that agree on it meet elsewhere."""
    m = F.floor((C("a") + C("z")) / 2).cast("int")
    part = lambda start, end, by: F.substring(C("word"), (start + by + 1).cast("int"), (end - start).cast("int"))
    none, by = F.lit(0), F.when(C("probe"), C("shift")).otherwise(0)
    first, second = part(C("a"), m, none), part(m, C("z"), by)
    key = lambda side, half: F.concat("key", F.lit(side), half)
    one = F.struct(key("<", first).alias("key"), m.alias("a"), C("z").alias("z"), C("firsts").alias("firsts"))
    two = F.struct(key(">", second).alias("key"), C("a").alias("a"), m.alias("z"), F.concat("firsts", F.array(first)).alias("firsts"))
    return rows.select("probe", "shift", F.inline(F.array(one, two)), "word", "n")


def candidates(rows: DataFrame) -> DataFrame:
    """(r, s, r_n, s_n): verified pairs of an indexed and a probing word that meet under a key; words of one length both index
    and probe, and each pair of them counts once."""
    r = rows.where(~C("probe")).select("shift", "key", "a", "z", C("firsts").alias("f"), C("word").alias("r"), C("n").alias("r_n"))
    s = rows.where(C("probe")).select("shift", "key", "a", "z", C("firsts").alias("g"), C("word").alias("s"), C("n").alias("s_n"))
    met = r.join(s, ["shift", "key", "a", "z"]).where((C("shift") == 1) | (C("r") < C("s")))
    met = met.where(~F.exists(F.arrays_zip("f", "g"), lambda x: x["f"] == x["g"]))
    return met.where(F.levenshtein("r", "s", 1) == 1).select("r", "s", "r_n", "s_n")


def near_pairs(words: DataFrame, tables: Tables, limit: int = LIMIT) -> DataFrame:
    """(r, s, r_n, s_n): all pairs of different words (word, n) that differ by one edit, once each."""
    n = F.char_length("word")
    role = lambda probe, shift, length: F.struct(F.lit(probe).alias("probe"), F.lit(shift).alias("shift"), length.alias("z"))
    roles = F.inline(F.array(role(False, 0, n), role(True, 0, n), role(False, 1, n), role(True, 1, n - 1)))
    rows = words.select("word", "n", roles).select("probe", "shift", C("z").cast("string").alias("key"), F.lit(0).alias("a"), "z", F.array().cast("array<string>").alias("firsts"), "word", "n")
    rows, found, level = tables.keep(halves(rows), "keys0"), None, 0
    while True:
        at = ["shift", "key", "a", "z"]
        count = lambda probe: F.sum((C("probe") == probe).cast("long"))
        sizes = rows.groupBy(*at).agg(count(True).alias("p"), count(False).alias("i"))
        large = tables.keep(sizes.where((C("p") * C("i") > limit) & (C("z") - C("a") > 1)).select(*at), f"large{level}")
        some = bool(large.take(1))
        now = tables.keep(candidates(rows.join(large, at, "left_anti") if some else rows), f"pairs{level}")
        found = now if found is None else found.union(now)
        if not some:
            return found
        rows = tables.keep(halves(rows.join(large, at, "left_semi")), f"keys{level + 1}")
        tables.drop(f"keys{level}", f"large{level}")
        level += 1


def roots(forms: DataFrame, tables: Tables) -> DataFrame:
    """(word, root) of (word, form): where forms lead to. A form comes more often than its word, so none comes back; places
    double in each round."""
    now, i = tables.keep(forms.select("word", C("form").alias("root")), "roots0"), 0
    while now.join(now.select(C("word").alias("root")), "root", "left_semi").take(1):
        on = now.select(C("word").alias("root"), C("root").alias("then"))
        now = tables.keep(now.join(on, "root", "left").select("word", F.coalesce("then", "root").alias("root")), f"roots{i + 1}")
        tables.drop(f"roots{i}")
        i += 1
    return now


def variants(words: DataFrame, tables: Tables, limit: int = LIMIT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n): the near word that comes most often, at least TIMES as often (of
    equal ones the first by code points), and the last one that forms lead to, the word itself without any."""
    pairs = near_pairs(words, tables, limit)
    other = lambda w, o, n: F.struct(C(w).alias("word"), C(o).alias("other"), C(n).alias("other_n"))
    near = pairs.select(F.inline(F.array(other("r", "s", "s_n"), other("s", "r", "r_n"))))
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-C("other_n")).alias("m"), C("other").alias("form"))).alias("x"))
    good = -C("x.m") >= TIMES * C("n")
    met = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, C("x.form")).alias("form"), F.when(good, -C("x.m")).alias("form_n"))
    met = tables.keep(met, "forms")
    last = roots(met.where(C("form").isNotNull()).select("word", "form"), tables)
    return met.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_spellings(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """The variants among the words of docs (doc_id, text). Repeated rows count as often as they come; an empty table, null and
    empty texts have no words; other columns are not looked at."""
    tables = Tables(docs.sparkSession, "spelling")
    return variants(tables.keep(words_in(docs, least), "words"), tables)


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    """The words of all documents with their most frequent near words."""
    return group_spellings(documents(spark, sf_dir))


def oracle() -> str:
    """Near words share what is left without one letter; checksums are computed a byte at a time from their rule."""
    return f"""WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
d AS (SELECT row_number() OVER () AS k, coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
r AS MATERIALIZED (SELECT id, run, count(*) AS n FROM (SELECT k, id, unnest(regexp_extract_all(text, '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM d) WHERE length(run) >= {LEAST_LENGTH} GROUP BY k, id, run),
b AS (SELECT id, run, n, list_transform(string_split(id || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, 128 + unicode(c) % 64] END) AS l FROM r),
h AS MATERIALIZED (SELECT id, run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(flatten(l), lambda x: CAST(x AS BIGINT))), lambda c, x: xor(c // 256, t.t[1 + xor(c, x) % 256])), 4294967295) AS h FROM b, t),
s AS (SELECT CASE WHEN h % {SPOILT} = 0 THEN left(run, h % length(run)) || substring(run, 2 + h % length(run)) ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
x AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS (SELECT p.word, q.word AS o, q.n AS m FROM x p JOIN x q ON p.i = q.i AND p.rest = q.rest AND p.word <> q.word AND length(p.word) = length(q.word) UNION SELECT p.word, q.word, q.n FROM x p JOIN w q ON p.rest = q.word UNION SELECT q.word, p.word, p.n FROM x p JOIN w q ON p.rest = q.word),
g AS (SELECT word, count(*) AS c, arg_min(o, (-m, o)) AS f, max(m) AS m FROM e GROUP BY word),
v AS MATERIALIZED (SELECT w.word, w.n, coalesce(c, 0) AS n_near, CASE WHEN m >= {TIMES} * w.n THEN f END AS form, CASE WHEN m >= {TIMES} * w.n THEN m END AS form_n FROM w LEFT JOIN g ON g.word = w.word),
z AS (SELECT word, word AS root, 0 AS i FROM v UNION ALL SELECT z.word, v.form, i + 1 FROM z JOIN v ON v.word = z.root WHERE v.form IS NOT NULL)
SELECT v.word, form, a.root, n, n_near, form_n FROM v JOIN (SELECT word, arg_max(root, i) AS root FROM z GROUP BY word) a ON a.word = v.word"""
