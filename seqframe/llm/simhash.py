"""SimHash near-duplicate groups by pigeonhole blocks.

Fingerprints are cut into blocks. Two that differ in at most MAX_BITS bits agree on all but MAX_BITS blocks, so each
combination of the other blocks makes a table, and close pairs share a key in one of them. Keys are joined by grouping:
each group verifies Hamming distances and emits a spanning forest of its links, never all pairs. A group of very many
distinct fingerprints is divided by blocks of its remaining bits, which loses no link.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from .common import Tables, documents, freeing, fresh

SEED, SHINGLE, MAX_BITS = 42, 3, 3
#: Near copies: words in a shingle of the sets that are compared, and their least Jaccard similarity.
SIMILAR_WORDS, SIMILAR = 5, 0.8
#: One in so many texts tells which shingles are frequent: at most so many, which come at least so often in these texts.
HOT_SHARE, HOT, HOT_LEAST = 16, 1 << 17, 4
#: Rows of a large group that each row meets at first.
BEFORE = 16
#: Parts of a large group that meet its rows apart.
SALTS = 16
#: Pairs whose sets are compared at a time, at least; and into how many parts all pairs are divided at most.
SLICE, SLICES = 1 << 14, 6
#: Keys that are moved at a time, at least.
KEYS = 1 << 20
#: A group of more distinct fingerprints than this is divided again.
GROUP = 1024
#: Bytes of a text that are hashed at a time.
PIECE = 1 << 20


def fingerprint(text: str | None) -> int:
    """The fingerprint as a signed 64-bit number; 0 without words. A-Z count as a-z; shingles count as often as they come."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    ones, total, carried, at = np.zeros(64, np.int64), 0, [], 0
    digest = xxhash.xxh64_intdigest
    while at < len(data):
        end = at + PIECE
        while end < len(data) and data[end] not in b" \t\n\x0b\f\r":
            end += 1
        words = carried + data[at:end].split()
        at = end
        joined = [b" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]
        for i in range(0, len(joined), 1 << 15):
            h = np.array([digest(s, SEED) for s in joined[i : i + (1 << 15)]], dtype="<u8")
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(joined)
        carried = words[-(SHINGLE - 1) :] if len(words) >= SHINGLE - 1 else words
    if not total:
        if not carried:
            return 0
        h = np.array([digest(b" ".join(carried), SEED)], dtype="<u8")
        ones, total = np.unpackbits(h.view(np.uint8), bitorder="little").astype(np.int64), 1
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", into: str = "_fp") -> DataFrame:
    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([fingerprint(t) for t in b], dtype="int64")

    return docs.withColumn(into, prints(F.col(text_col)))


def block_masks(blocks: int) -> list[int]:
    """Masks (signed) of all combinations of blocks - MAX_BITS blocks of 64 bits."""
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    each = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(cuts)]
    return [signed(sum(c)) for c in itertools.combinations(each, blocks - MAX_BITS)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def divide(mask: int) -> list[int]:
    """The mask with each of MAX_BITS + 1 blocks of its remaining bits (fewer if fewer bits are left)."""
    mask &= (1 << 64) - 1
    left = [i for i in range(64) if not mask >> i & 1]
    parts = np.array_split(np.array(left, dtype=object), MAX_BITS + 1)
    return [signed(mask | sum(1 << int(i) for i in p)) for p in parts if len(p)]


@F.pandas_udf(T.ArrayType(T.LongType()))
def divided(masks: pd.Series) -> pd.Series:
    """Each mask's divisions; masks repeat, so each is divided once for a batch."""
    each = {m: divide(int(m)) for m in masks.unique()}
    return masks.map(each)


def forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links between distinct fingerprints: a spanning forest of the graph of distances up to MAX_BITS."""
    x = prints.view(np.uint64)
    free = np.ones(len(x), bool)
    out = []
    for i in range(len(x)):
        if not free[i]:
            continue
        free[i] = False
        queue = [i]
        while queue:
            j = queue.pop()
            near = np.flatnonzero(free & (np.bitwise_count(x ^ x[j]) <= MAX_BITS))
            free[near] = False
            queue.extend(near.tolist())
            out.extend((int(prints[j]), int(prints[k])) for k in near)
    return out


def links_of_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come ordered by (path, key); a group may span batches."""
    held = None
    for b in itertools.chain(batches, [None]):
        if b is None:
            rows, last = held, True
        else:
            rows, last = (b if held is None else pd.concat([held, b])), False
        if rows is None or not len(rows):
            held = rows
            continue
        path, key, fp = (rows[c].to_numpy() for c in ("path", "key", "fp"))
        new = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (key[1:] != key[:-1])]))
        ends = np.append(new[1:], len(rows))
        if not last:
            held = rows.iloc[new[-1] :]
            new, ends = new[:-1], ends[:-1]
        many = np.flatnonzero(ends - new > 1)
        found = [e for g in many for e in forest(np.unique(fp[new[g] : ends[g]]))]
        if found:
            yield pd.DataFrame(found, columns=["a", "b"])


def links(prints: DataFrame, tables: Tables, group: int = GROUP) -> DataFrame:
    """A table of links (a, b) between the distinct fingerprints in column fp that keeps their components."""
    n = max(1, prints.count())
    blocks = next((m for m in (4, 5, 6) if 64 * (m - MAX_BITS) // m >= math.log2(n) + 3), 7)
    masks = F.array(*[F.lit(m).cast("long") for m in block_masks(blocks)])
    rows = prints.select("fp", F.posexplode(masks).alias("p", "mask")).select("fp", "mask", F.col("p").cast("long").alias("path"))
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found, level = None, 0
    while True:
        keyed = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = keyed.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n"))
        large = tables.keep(sizes.where(F.col("n") > group).select("path", "key"), f"large{level}")
        some = bool(large.take(1))
        small = keyed.join(large, ["path", "key"], "left_anti") if some else keyed
        dealt = small.select("path", "key", "fp").repartition(parts, "path", "key").sortWithinPartitions("path", "key")
        now = tables.keep(dealt.mapInPandas(links_of_groups, "a long, b long"), f"links{level}")
        found = now if found is None else found.union(now)
        if not some:
            return found
        more = keyed.join(large, ["path", "key"], "left_semi")
        rows = tables.keep(
            more.select("fp", "path", "key", F.posexplode(divided(F.col("mask"))).alias("p", "mask")).select("fp", "mask", F.xxhash64("path", "key", "p").alias("path")), f"rows{level}"
        )
        level += 1


def components_of(prints: DataFrame, tables: Tables) -> DataFrame:
    """(fp, component) of rows (id, fp): the component is the smallest id that links reach."""
    nodes = tables.keep(prints.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    comps = connected_components(links(nodes.select("fp"), tables)).withColumnRenamed("id", "fp")
    named = tables.keep(nodes.join(comps, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "named")
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    return tables.keep(named.join(least, "component").select("fp", F.col("component").alias("node"), F.col("least").alias("component")), "of")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): each row's fingerprint and the smallest id that links of <= MAX_BITS bits reach.

    Rows with equal fingerprints (copies; null, empty and wordless texts have 0) are one node. Null ids belong to a
    component but do not name it, unless it has no other; repeated rows are returned as often as they come.
    """
    tables = Tables(docs.sparkSession, "simhash")
    rows = tables.keep(with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "fp").select("id", "fp"), "prints")
    return rows.join(components_of(rows, tables), "fp").select("id", "fp", "component")


def shingles(text: str | None, n: int, digest=None) -> np.ndarray:
    """The distinct hashes of the text's shingles of n words, ascending. A-Z count as a-z; a text of fewer words is one
    shingle, one without words has none. `digest` is updated with the words."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    held, carried, at, short = [], [], 0, True
    while at < len(data):
        end = at + PIECE
        while end < len(data) and data[end] not in b" \t\n\x0b\f\r":
            end += 1
        words = data[at:end].split()
        at = end
        if digest is not None and words:
            digest.update(b" ".join(words) + b" ")
        words = carried + words
        if len(words) >= n:
            short = False
            held.append(np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), SEED) for i in range(len(words) - n + 1)], dtype="<u8")))
        carried = words[-(n - 1) :] if n > 1 else []
    if short and carried:
        return np.array([xxhash.xxh64_intdigest(b" ".join(carried), SEED)], dtype="<u8")
    return np.unique(np.concatenate(held)) if held else np.zeros(0, "<u8")


def near_prints(hot: np.ndarray):
    """A column's class (a digest of its words), how many shingles its text has, and the prefix of them: the first ones in an order of all
    shingles, of which two texts of enough similarity share one. Rare ones come first; `hot` are the others, by falling rank."""
    order = np.argsort(hot)
    known = hot[order]

    @F.pandas_udf(T.StructType([T.StructField("cls", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType()))]))
    def prints(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            digest = hashlib.blake2b(digest_size=16)
            h = shingles(t, SIMILAR_WORDS, digest)
            if len(known) and len(h):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                rank = np.where(known[at] == h, len(known) - order[at], 0)
                h = h[np.argsort(rank, kind="stable")]
            # Of n shingles, SIMILAR * n are in the other text too: of the rest and one more, one is.
            first = h[: len(h) - math.ceil(SIMILAR * len(h) - 1e-6) + 1]
            out.append((digest.digest(), len(h), first.view("<i8")))
        return pd.DataFrame(out, columns=["cls", "n", "keys"])

    return prints


@freeing
def shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for t in b.column("text").to_pylist():
            yield pa.record_batch([pa.array(shingles(t, SIMILAR_WORDS).view("<i8"))], names=["key"])


def hot_shingles(docs: DataFrame, text_col: str) -> np.ndarray:
    """The most frequent shingles of one in HOT_SHARE texts, by falling frequency, HOT at most. They only order shingles: links are
    the same with any."""
    some = docs.select(F.col(text_col).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(HOT_SHARE)) == 0).distinct()
    counts = some.mapInArrow(shingle_rows, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT_LEAST)
    return counts.orderBy(F.desc("n"), "key").limit(HOT).select("key").toPandas()["key"].to_numpy(np.int64).view(np.uint64)


def may_be_similar(n, i, m, j):
    """Whether sets of n and m keys may be similar enough if places i and j hold their first common key (columns or arrays)."""
    least = F.least if isinstance(n, Column) else np.minimum
    return (1 + SIMILAR) * least(n - i, m - j) >= SIMILAR * (n + m) - 1e-6


@freeing
def near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes (x < y) that a key brings together, from rows ordered by key. Of a group of more than GROUP rows only the pairs with
    the BEFORE rows before come, and a row with the key, so that the others can be looked at later."""
    names = ["key", "node", "n", "i"]
    held = {c: np.zeros(0, np.int64) for c in names}
    large: int | None = None
    before = np.zeros((4, 0), np.int64)

    def found(a, z):
        fine = may_be_similar(a[2], a[3], z[2], z[3])
        return np.minimum(a[1], z[1])[fine], np.maximum(a[1], z[1])[fine]

    def made(x, y, keys=()):
        x, y = np.concatenate(x) if x else np.zeros(0, np.int64), np.concatenate(y) if y else np.zeros(0, np.int64)
        key = pa.array([None] * len(x) + list(keys), pa.int64())
        return pa.record_batch([pa.array(np.append(x, [0] * len(keys)).astype(np.int64)), pa.array(np.append(y, [0] * len(keys)).astype(np.int64)), key], names=["x", "y", "key"])

    for b in itertools.chain(batches, [None]):
        new = {c: b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names} if b is not None else {c: np.zeros(0, np.int64) for c in names}
        rows = np.stack([np.concatenate([held[c], new[c]]) for c in names])
        key, count = rows[0], rows.shape[1]
        if not count:
            continue
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(cuts, count))
        big = (sizes > GROUP) | (key[cuts] == large if large is not None else np.zeros(len(cuts), bool))
        # The last group may go on; a large one isn't held.
        done = count if b is None or big[-1] else int(cuts[-1])
        x, y, keys = [], [], []
        r = np.flatnonzero(np.repeat(~big & (sizes > 1), sizes) & (np.arange(count) < done))
        for d in range(1, GROUP):
            r = r[r + d < done]
            r = r[key[r + d] == key[r]]
            if not len(r):
                break
            u, v = found(rows[:, r], rows[:, r + d])
            x.append(u)
            y.append(v)
        for g in np.flatnonzero(big).tolist():
            part = rows[:, cuts[g] : cuts[g] + sizes[g]]
            if part[0, 0] != large:
                large, before = int(part[0, 0]), part[:, :0]
                keys.append(large)
            on = np.concatenate([before, part], axis=1)
            for d in range(1, BEFORE + 1):
                start = max(before.shape[1], d)
                u, v = found(on[:, start - d : max(start, on.shape[1]) - d], on[:, start:])
                x.append(u)
                y.append(v)
            before = on[:, -BEFORE:]
        held = {c: rows[k, done:] for k, c in enumerate(names)}
        yield made(x, y, keys)


@freeing
def near_shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (x, y) of rows (x, y, p, q) whose texts p and q are similar. Rows of one y follow each other, so its set is made once."""
    last, held = None, np.zeros(0, "<u8")
    for b in batches:
        x, y = b.column("x").to_numpy(), b.column("y").to_numpy()
        fine = np.zeros(b.num_rows, bool)
        for i in range(b.num_rows):
            if y[i] != last:
                last, held = y[i], shingles(b.column("q")[i].as_py(), SIMILAR_WORDS)
            own = shingles(b.column("p")[i].as_py(), SIMILAR_WORDS)
            shared = len(np.intersect1d(own, held, assume_unique=True))
            fine[i] = shared >= SIMILAR * (len(own) + len(held) - shared)
        yield pa.record_batch([pa.array(x[fine]), pa.array(y[fine])], names=["x", "y"])


def similar(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, tables: Tables, name: str) -> DataFrame:
    """The pairs of nodes (x, y) whose texts have a Jaccard similarity of SIMILAR or more. texts (cls, text) holds a text of each class once."""
    cls = lambda node, into: nodes.select(F.col("node").alias(node), F.col("cls").alias(into))
    named = tables.keep(pairs.join(cls("x", "a"), "x").join(cls("y", "b"), "y"), f"{name}_named")
    tables.tidy()
    # Texts are moved, which take less than their sets: one of each pair, for some of the pairs at a time.
    side = lambda key, into: texts.select(F.col("cls").alias(key), F.col("text").alias(into)).hint("merge")
    slices, out = max(1, min(SLICES, named.count() // SLICE)), None
    for i in range(slices):
        some = named.where(F.pmod(F.xxhash64("x", "y"), F.lit(slices)) == i)
        both = some.join(side("a", "p"), "a").join(side("b", "q"), "b")
        now = tables.keep(both.select("x", "y", "p", "q").mapInArrow(near_shares, "x long, y long"), f"{name}/{i}")
        out = now if out is None else out.union(now)
        tables.tidy()
    tables.drop(f"{name}_named")
    return out


def apart_in_large(rows: DataFrame, comps: DataFrame, tables: Tables) -> DataFrame:
    """Pairs (x, y) of different components in large groups (key, node, n, i). A group's greatest component meets the others only."""
    rows = rows.join(comps, "node", "left").withColumn("of", F.coalesce("of", "node"))
    rows = tables.keep(rows, "large_rows")
    sizes = rows.groupBy("key", "of").agg(F.count(F.lit(1)).alias("many"))
    mixed = sizes.groupBy("key").agg(F.max_by("of", F.struct("many", "of")).alias("main"), F.count(F.lit(1)).alias("c")).where(F.col("c") > 1).drop("c")
    rows = rows.join(mixed, "key")
    side = lambda x: [F.col(c).alias(f"{c}{x}") for c in ("node", "n", "i", "of")]
    few = rows.where(F.col("of") != F.col("main")).select("key", "main", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), *side(1))
    all_ = rows.select("key", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt"), *side(2))
    met = few.join(all_, ["key", "salt"]).where((F.col("of1") != F.col("of2")) & ((F.col("of2") == F.col("main")) | (F.col("node1") < F.col("node2"))))
    met = met.where(may_be_similar(F.col("n1"), F.col("i1"), F.col("n2"), F.col("i2")))
    return met.select(F.least("node1", "node2").alias("x"), F.greatest("node1", "node2").alias("y"))


def near_copies(nodes: DataFrame, texts: DataFrame, tables: Tables) -> DataFrame:
    """(x, y): links between nodes (node, cls, n, keys) whose texts (cls, text) have a Jaccard similarity of SIMILAR or more, enough
    of them to join all nodes that such links join. Every pair that shares a key is looked at, unless other links have joined
    it before: first each node with the one that it shares most keys with, then those that are still apart."""
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = nodes.select("node", "n", F.posexplode("keys").alias("i", "key"))
    # Keys are moved in parts, so that only one part's shuffle is on disk.
    slices, found = max(1, min(SLICES, (nodes.agg(F.sum(F.size("keys"))).first()[0] or 0) // KEYS)), None
    for i in range(slices):
        dealt = keyed.where(F.pmod("key", F.lit(slices)) == i).repartition(parts, "key").sortWithinPartitions("key", "n", "node")
        now = tables.keep(dealt.mapInArrow(near_pairs, "x long, y long, key long"), f"pairs/{i}")
        found = now if found is None else found.union(now)
        tables.tidy()
    large = found.where(F.col("key").isNotNull()).select("key")
    edges = tables.keep(found.where(F.col("key").isNull()).groupBy("x", "y").agg(F.count(F.lit(1)).alias("shared")), "edges")
    most = edges.select(F.posexplode(F.array("x", "y")).alias("side", "node"), "x", "y", "shared").groupBy("node").agg(F.max_by(F.struct("x", "y"), F.struct("shared", -F.col("x"), -F.col("y"))).alias("e"))
    tried = tables.keep(most.select("e.*").distinct(), "tried")
    first = similar(tried, nodes, texts, tables, "near")
    named = lambda links, name: tables.keep(connected_components(links, "x", "y").select(F.col("id").alias("node"), F.col("component").alias("of")), name)
    comps = named(first, "comps")
    of = lambda x: comps.select(F.col("node").alias(x), F.col("of").alias(f"of_{x}"))
    apart = edges.join(of("x"), "x", "left").join(of("y"), "y", "left").where(F.coalesce("of_x", "x") != F.coalesce("of_y", "y")).select("x", "y")
    apart = tables.keep(apart.join(tried, ["x", "y"], "left_anti"), "apart")
    links = first.union(similar(apart, nodes, texts, tables, "more"))
    if not large.take(1):
        return links
    rows = keyed.join(large, "key", "left_semi")
    rest = tables.keep(apart_in_large(rows, named(links, "comps_of_more"), tables).distinct().join(edges, ["x", "y"], "left_anti"), "apart_in_large")
    return links.union(similar(rest, nodes, texts, tables, "in_large"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with one row of each group of near copies: that of the smallest id (null only where there is no
    other; of equal ids, any one). All columns stay as they are.

    Texts whose words are equal without regard to A-Z and white space (null, empty and wordless ones too) are copies. Other
    texts are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more, and groups follow links.
    Candidates share one of the first shingles of each in an order of all shingles (prefix filtering), which every pair of this
    similarity does. Every link is verified, and none is missed that joins groups.
    """
    tables = Tables(docs.sparkSession, "near")
    fp, row = fresh(docs, "_fp"), fresh(docs, "_row")
    held = tables.keep(docs.withColumn(fp, near_prints(hot_shingles(docs, text_col))(F.col(text_col))).withColumn(row, F.monotonically_increasing_id()), "held")
    ids = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    nodes = held.groupBy(F.col(f"{fp}.cls").alias("cls")).agg(F.min(ids).alias("least"), F.first(f"{fp}.n").alias("n"), F.first(f"{fp}.keys").alias("keys"))
    nodes = tables.keep(nodes.withColumn("node", F.col("least.row")), "nodes")
    tables.tidy()
    # In buckets, a text of each class: the pairs' texts are met there, and copies aren't moved again.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = held.select(F.col(f"{fp}.cls").alias("cls"), F.col(text_col).alias("text")).repartition(parts, "cls")
    texts = tables.keep_bucketed(texts.groupBy("cls").agg(F.first("text").alias("text")), "texts", "cls")
    tables.tidy()
    links = near_copies(nodes, texts, tables)
    comps = connected_components(links, "x", "y").withColumnRenamed("id", "node")
    named = nodes.join(comps, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("least").alias("least"))
    winners = tables.keep(named.select(F.col("least.row").alias(row)), "winners")
    tables.drop("pairs", "edges", "tried", "comps", "comps_of_more", "large_rows", "apart", "apart_in_large", "near", "more", "in_large", "nodes", "texts")
    return held.join(winners, row, "left_semi").drop(fp, row)


def op5_simhash_blocks(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicates(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
