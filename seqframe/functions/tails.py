"""Poly-A tails and poly-T heads with errors, in batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Profile:
    """A seed's length, the share of its bases that must be A, the gap between seeds that counts as tail, and the bases that a
    seed is looked for in."""

    seed: int
    identity: float
    gap: int
    window: int


# Short accurate reads and long noisy ones.
SHORT_READS = Profile(4, 0.9, 1, 5)
LONG_READS = Profile(12, 0.9, 4, 100)


def seed(is_a: np.ndarray, start: int, end: int, p: Profile) -> tuple[int, int] | None:
    """The seed nearest to `end` in [start, end): neighbouring windows of the seed's length that hold enough A. It ends with an A
    if it is longer than a window. A seed that reaches `start` goes on to the first other base before it."""
    if start < 0 or end - start < p.seed:
        return None
    sums = np.concatenate([[0], np.cumsum(is_a)])
    n = sums[start + p.seed : end + 1] - sums[start : end - p.seed + 1]
    good = np.float32(1) * n / np.float32(p.seed) >= np.float32(p.identity)
    here = is_a[start : end - p.seed + 1]
    begins = good & here
    begins[-1] = good[-1]
    first = np.flatnonzero(begins)
    if not len(first):
        return None
    top = int(first[-1])
    bad = np.flatnonzero(~good[:top])
    low = int(bad[-1]) + 1 if len(bad) else 0
    inside = np.flatnonzero(here[low:top])
    a, z = start + (low + int(inside[0]) if len(inside) else top), start + top + p.seed
    while z - a > p.seed and not is_a[z - 1]:
        z -= 1
    if a == start:
        while a > 0 and is_a[a]:
            a -= 1
    return a, z


def tail(is_a: np.ndarray, p: Profile) -> tuple[int, int] | None:
    """Seeds from the end of the sequence backward, as long as the gap between two is short or holds enough A."""
    start = max(0, len(is_a) - max(p.window, p.seed))
    best = seed(is_a, start, len(is_a), p)
    while best and start > 0:
        start = max(0, best[0] - max(p.window, p.seed))
        before = seed(is_a, start, best[0], p)
        if not before or (before[1] + p.gap < best[0] and np.float32(is_a[before[1] : best[0]].mean()) < np.float32(p.identity)):
            break
        best = (before[0], best[1])
    return best


INTERVAL = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def _letters(seq: str) -> np.ndarray:
    return np.frombuffer(seq.upper().encode("latin-1", "replace"), np.uint8)


def tail_region(seq: Column, profile: Profile = SHORT_READS) -> Column:
    """struct<start, end> of the poly-A tail, end excluded; null without one."""

    @F.pandas_udf(INTERVAL)
    def run(s: pd.Series) -> pd.DataFrame:
        found = [tail(_letters(x) == ord("A"), profile) if x else None for x in s]
        return pd.DataFrame([f or (None, None) for f in found], columns=["start", "end"]).astype("Int32")

    return _or_null(run(seq))


def head_region(seq: Column, profile: Profile = SHORT_READS) -> Column:
    """The same for a poly-T head: the tail of the reversed sequence."""

    @F.pandas_udf(INTERVAL)
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for x in s:
            f = tail((_letters(x) == ord("T"))[::-1], profile) if x else None
            out.append((len(x) - f[1], len(x) - f[0]) if f else (None, None))
        return pd.DataFrame(out, columns=["start", "end"]).astype("Int32")

    return _or_null(run(seq))


def _or_null(region: Column) -> Column:
    return F.when(region["end"].isNotNull(), region)
