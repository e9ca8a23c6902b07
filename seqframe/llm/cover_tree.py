"""Exact threshold pairs of embeddings by cover trees.

Unit vectors are compared by chord length: cosine >= c is distance <= sqrt(2 - 2c). Each label's distinct vectors are
cut into blocks along a fixed direction; pairs of blocks that are too far apart along it are left out, and every other
pair is joined by traversing two cover trees together. A level halves the radius; node pairs farther apart than their
covering radii allow are pruned, node pairs close enough as a whole are counted without opening them, and what is left
is verified by cosines in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import Tables

COSINE = 0.98
#: Vectors of a block, about.
BLOCK = 2048
#: A node of so few vectors isn't divided any more.
LEAF = 24
#: Slack of the bounds against rounding; pairs within it are verified one by one.
SLACK = 1e-6


@dataclass
class Node:
    """A center, the greatest distance from it to the node's vectors, and their places (all of them, or by child)."""

    center: int
    radius: float
    members: np.ndarray
    children: list[Node] = field(default_factory=list)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


def build(x: np.ndarray) -> Node:
    """Cover tree of unit vectors: below a node, centers at least half its radius apart, each vector with its nearest."""
    members = np.arange(len(x))

    def node(center: int, members: np.ndarray, d: np.ndarray) -> Node:
        out = Node(center, float(d.max()), members)
        if len(members) <= LEAF or out.radius <= 1e-9:
            return out
        # Farthest-first centers until all vectors are within half the radius (the center itself is the first).
        centers, near, owner = [center], d.copy(), np.zeros(len(members), np.int64)
        while near.max() > out.radius / 2:
            far = int(near.argmax())
            e = distances(x[members], x[members[far]][None])[:, 0]
            owner[e < near] = len(centers)
            near = np.minimum(near, e)
            centers.append(int(members[far]))
            if len(centers) > 2 * math.sqrt(len(members)) + 8:
                break  # hardly any vectors share a center in high dimensions; the rest stay with their nearest
        for k, c in enumerate(centers):
            mine = owner == k
            if mine.any():
                child = members[mine]
                if len(child) == len(members):
                    return out
                out.children.append(node(c, child, near[mine]))
        return out

    return node(0, members, distances(x, x[:1])[:, 0])


class Forest:
    """Links that join parts which were apart: those that were together already are dropped as they are found."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def add(self, i: int, j: int) -> None:
        a, b = self.top(i), self.top(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((i, j))


def dual(x: np.ndarray, y: np.ndarray, tx: Node, ty: Node, cosine: float, same: bool, size_x: np.ndarray, size_y: np.ndarray):
    """Numbers of linked vectors for each of x and of y (weighted by class sizes), and a spanning forest of the links. In it
    y's vectors come after x's."""
    limit = math.sqrt(max(0.0, 2 - 2 * cosine))
    nx = np.zeros(len(x), np.int64)
    ny = nx if same else np.zeros(len(y), np.int64)
    shift = 0 if same else len(x)
    found = Forest(shift + len(y))
    stack = [(tx, ty)]
    while stack:
        a, b = stack.pop()
        own = same and a is b
        d = float(distances(x[a.center][None], y[b.center][None])[0, 0])
        if d > a.radius + b.radius + limit + SLACK:
            continue
        if d + a.radius + b.radius < limit - SLACK:  # every pair is linked
            nx[a.members] += size_y[b.members].sum()
            if own:
                nx[a.members] -= size_x[a.members]
            else:
                ny[b.members] += size_x[a.members].sum()
            first = int(a.members[0])
            for j in b.members.tolist():
                found.add(first, j + shift)
            for i in [] if own else a.members[1:].tolist():
                found.add(i, int(b.members[0]) + shift)
            continue
        open_a, open_b = bool(a.children), bool(b.children)
        if not open_a and not open_b:
            link = x[a.members] @ y[b.members].T >= cosine
            if own:
                np.fill_diagonal(link, False)
            nx[a.members] += link @ size_y[b.members]
            if not own:
                ny[b.members] += link.T @ size_x[a.members]
            i, j = np.nonzero(link)
            for p, q in zip(a.members[i].tolist(), b.members[j].tolist(), strict=True):
                found.add(p, q + shift)
        elif own:
            stack.extend((p, q) for k, p in enumerate(a.children) for q in a.children[k:])
        elif open_a and (not open_b or a.radius >= b.radius):
            stack.extend(near_children(x, y, a, b, limit, False))
        else:
            stack.extend(near_children(y, x, b, a, limit, True))
    return nx, ny, found.links


def near_children(x: np.ndarray, y: np.ndarray, a: Node, b: Node, limit: float, turned: bool) -> list[tuple[Node, Node]]:
    """Children of a that may hold vectors near b's."""
    d = distances(x[[c.center for c in a.children]], y[b.center][None])[:, 0]
    radii = np.array([c.radius for c in a.children])
    kept = [c for c, ok in zip(a.children, d <= radii + b.radius + limit + SLACK, strict=True) if ok]
    return [(b, c) if turned else (c, b) for c in kept]


def join_blocks(cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["bi"].iloc[0]), int(pdf["bj"].iloc[0])
        sides = [pdf[pdf["b"] == k].sort_values("id") for k in dict.fromkeys((i, j))]
        vectors = [np.stack(s["v"].to_list()) if len(s) else np.zeros((0, 1)) for s in sides]
        if any(not len(v) for v in vectors):
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
        trees = [build(v) for v in vectors]
        sizes = [s["n"].to_numpy(np.int64) for s in sides]
        ids = [s["id"].to_numpy(np.int64) for s in sides]
        nx, ny, kept = dual(vectors[0], vectors[-1], trees[0], trees[-1], cosine, i == j, sizes[0], sizes[-1])
        every = ids[0] if i == j else np.concatenate(ids)
        counts = nx if i == j else np.concatenate([nx, ny])
        linked = np.flatnonzero(counts)
        return pd.DataFrame({
            "a": np.concatenate([every[[p for p, _ in kept]], every[linked]]).astype("int64"),
            "b": np.concatenate([every[[q for _, q in kept]], every[linked]]).astype("int64"),
            "n": np.concatenate([np.zeros(len(kept), np.int64), counts[linked]]),
        })

    return run


def usable(v):
    """Not null, no null or non-finite component, not all zero."""
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda e: e != 0), F.lit(False))


def near_vectors(df: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """One row per vector: id, n_links (other vectors of its label with cosine >= the threshold), component_id
    (smallest id reachable by links, itself included), kept (id is component_id).

    Null labels and unusable vectors link with nothing and keep their own id. Vectors of different lengths aren't
    compared. Equal vectors are one node whose copies count as links (a row repeated with its id counts as another
    vector). Null ids take part in counts; a component takes its name from the other ids.
    """
    spark = df.sparkSession
    tables = Tables(spark, "vectors")
    doubles = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), doubles.alias("v"))
    ok = F.col("label").isNotNull() & usable(F.col("v"))
    # Two hashes of 64 bits name a vector.
    rows = rows.withColumn("hash", F.when(ok, F.xxhash64("label", "v"))).withColumn("more", F.when(ok, F.xxhash64("v", "label", F.lit(1))))
    # Scaled before squaring, so that huge and tiny components neither overflow nor vanish.
    scaled = rows.where(ok).withColumn("v", F.transform("v", lambda e: e / F.array_max(F.transform("v", lambda x: F.abs(x)))))
    unit = scaled.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e)))
    unit = unit.select("id", "label", "hash", "more", F.transform("v", lambda e: e / F.col("norm")).alias("v"), F.size("v").alias("dim"))
    # One node for equal vectors; node is its number.
    nodes = unit.groupBy("label", "hash", "more").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"), F.first("dim").alias("dim"))
    along = F.aggregate(F.col("v"), F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("s")), lambda a, e: F.struct((a["i"] + 1).alias("i"), (a["s"] + e * F.cos(a["i"] * 2.399963 + 0.5)).alias("s")), lambda a: a["s"])
    scale = F.sqrt(F.aggregate(F.sequence(F.lit(0), F.col("dim") - 1), F.lit(0.0), lambda s, i: s + F.pow(F.cos(i * 2.399963 + 0.5), 2)))
    nodes = tables.keep(nodes.withColumn("p", along / scale).withColumn("node", F.monotonically_increasing_id()), "nodes")
    # Blocks: quantiles of the projection within each label (and length).
    sizes = nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("total"), F.percentile_approx("p", [k / 256 for k in range(1, 256)], 4096).alias("q"))
    cuts = sizes.withColumn("k", F.least(F.lit(256), F.ceil(F.col("total") / block)).cast("int")).select(
        "label", "dim", "total", F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("k") - 1)), lambda i: F.when(F.col("k") > 1, F.get("q", (i * 256 / F.col("k") - 1).cast("int")))).alias("cut"),
        F.ceil(F.col("total") / (256 * block)).cast("int").alias("salts"),
    )
    cell = F.size(F.filter("cut", lambda c: F.coalesce(F.col("p") > c, F.lit(False))))
    placed = nodes.join(cuts, ["label", "dim"]).withColumn("b", (cell * F.col("salts") + F.pmod(F.col("node"), F.col("salts"))).cast("int"))
    placed = tables.keep(placed.select("label", "dim", "node", "n", "v", "p", "b"), "placed")
    # Pairs of blocks whose projections come within the limit of each other: projecting shortens distances.
    limit = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    ends = placed.groupBy("label", "dim", "b").agg(F.min("p").alias("low"), F.max("p").alias("high"))
    other = ends.select("label", "dim", F.col("b").alias("c"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    near = ends.join(other, ["label", "dim"]).where((F.col("low") <= F.col("high2") + limit) & (F.col("low2") <= F.col("high") + limit))
    partners = near.groupBy("label", "dim", "b").agg(F.collect_list("c").alias("with"))  # blocks, not vectors
    dealt = placed.join(partners, ["label", "dim", "b"]).select(
        "label", "dim", "b", F.col("node").alias("id"), "n", "v", F.explode("with").alias("c"),
    )
    # Only the part of a block that reaches the other block's interval needs to meet it; ends are checked in the tree.
    dealt = dealt.withColumn("bi", F.least("b", "c")).withColumn("bj", F.greatest("b", "c"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = dealt.repartition(parts, "label", "dim", "bi", "bj").groupBy("label", "dim", "bi", "bj").applyInPandas(join_blocks(cosine), "a long, b long, n long")
    found = tables.keep(found, "found")
    comps = connected_components(found.where(F.col("a") != F.col("b"))).withColumnRenamed("id", "node")
    counts = found.where(F.col("a") == F.col("b")).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    named = nodes.select("node", "hash", "more", "first", "n").join(counts, "node", "left").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    of = named.join(least, "component").select("hash", "more", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "least")
    out = rows.select("id", "hash", "more").join(tables.keep(of, "of"), ["hash", "more"], "left")
    component = F.coalesce("least", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def op9_cover_tree(spark, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.98."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
