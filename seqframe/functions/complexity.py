"""Repeat and low-complexity tests of sequences, in batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Shares of a sequence that make it a repeat, a short or a long one of low complexity; the long test's window.
REPEAT, SHORT, LONG, WINDOW = 0.9, 0.95, 0.89, 50
_CODES = np.full(256, -1, np.int64)
for _i, _b in enumerate("ACGT"):
    _CODES[ord(_b)] = _i
_CODES[ord("U")] = 3


def nearest(x: float) -> int:
    return math.floor(x + 0.5)


def codes(seq: str) -> np.ndarray:
    return _CODES[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]


def most(values: np.ndarray, size: int) -> int:
    return int(np.bincount(values, minlength=size).max()) if len(values) else 0


def two_bases(mono: np.ndarray) -> int:
    """The two commonest bases together."""
    return int(np.sort(mono)[-2:].sum())


def is_repeat(seq: str) -> bool:
    """One base, or one pair or triple in some phase, makes up nine tenths."""
    c = codes(seq)
    if not len(c):
        return False
    for n in (1, 2, 3):
        for start in range(n):
            whole = c[start : start + (len(c) - start) // n * n].reshape(-1, n)
            whole = whole[(whole >= 0).all(axis=1)]
            if len(whole) and most(whole @ 4 ** np.arange(n), 4**n) >= nearest(len(c) // n * REPEAT):
                return True
    return False


def low_complexity_short(seq: str) -> bool:
    """One or two bases, or one overlapping pair or triple, reach the share; shorter than four bases: no."""
    c = codes(seq)
    n = len(c)
    if n < 4:
        return False
    mono = np.bincount(c[c >= 0], minlength=4)
    if two_bases(mono) >= nearest(n * SHORT):
        return True
    pairs, triples = windows(c)
    return most(pairs, 16) >= nearest(n // 2 * SHORT) or most(triples, 64) >= nearest(n // 3 * SHORT)


def windows(c: np.ndarray, mixed: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping pairs and triples of valid bases; mixed: none that ends a run of three equal bases."""
    ok = np.ones(max(0, len(c) - 2), bool)
    if mixed:
        ok = (c[2:] != c[1:-1]) | (c[1:-1] != c[:-2])
    two = np.concatenate([[ok[0] if len(ok) else True], ok])
    p = (c[:-1] >= 0) & (c[1:] >= 0) & two
    t = (c[:-2] >= 0) & (c[1:-1] >= 0) & (c[2:] >= 0) & ok
    return (c[:-1] * 4 + c[1:])[p], (c[:-2] * 16 + c[1:-1] * 4 + c[2:])[t]


def low_complexity_long(seq: str) -> bool:
    """As the short test with a lower share, without runs of one base, and for two kinds of pairs together; up to six bases: no."""
    c = codes(seq)
    n = len(c)
    if n <= 6:
        return False
    mono = np.bincount(c[c >= 0], minlength=4)
    if two_bases(mono) >= nearest(n * LONG):
        return True
    pairs, triples = windows(c, mixed=True)
    if most(triples, 64) >= nearest(n * LONG / 3):
        return True
    # Two kinds of pairs of which the second has no smaller base at either place.
    table = np.bincount(pairs, minlength=16).reshape(4, 4)
    later = np.maximum.accumulate(np.maximum.accumulate(table[::-1, ::-1], axis=0), axis=1)[::-1, ::-1]
    best = 0
    for i in range(4):
        for j in range(4):
            rest = max(later[i + 1, j] if i < 3 else 0, later[i, j + 1] if j < 3 else 0)
            best = max(best, int(table[i, j] + rest))
    return best >= nearest(n * LONG / 2)


def low_complexity_windowed(seq: str) -> bool:
    """Three quarters of the centred windows are of low complexity; under four windows: the whole sequence is."""
    k = len(seq) // WINDOW
    if k < 4:
        return low_complexity_long(seq)
    first = len(seq) % WINDOW // 2
    return sum(low_complexity_long(seq[first + i * WINDOW : first + (i + 1) * WINDOW]) for i in range(k)) >= math.floor(0.75 * k)


def flag(test, seq: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else test(x) for x in s], dtype="object")

    return run(seq)


def complex_parts(seq: str, window: int, least: int | None = None) -> list[tuple[int, int]]:
    """The parts [start, end) of a sequence without its windows of low complexity, which are centred; the first and the last window
    take the rest with them. Without `least`, a sequence shorter than a window is one part, or none. With `least`, a sequence
    that has fewer bases in such windows is left whole; one of under five windows is left whole, or not at all."""
    n = len(seq)
    many = n // window
    if many < (1 if least is None else 5):
        return [(0, n)] if n and not (low_complexity_long if least is None else low_complexity_windowed)(seq) else []
    first = n % window // 2
    low = [low_complexity_long(seq[first + i * window : first + (i + 1) * window]) for i in range(many)]
    if least is not None and sum(low) * window < least:
        return [(0, n)]
    edge = np.diff(np.concatenate([[1], np.array(low, np.int8), [1]]))
    runs = zip(np.flatnonzero(edge == -1).tolist(), np.flatnonzero(edge == 1).tolist(), strict=True)
    return [(0 if a == 0 else first + a * window, n if z == many else first + z * window) for a, z in runs]


def complex_ends(seq: str, window: int) -> str:
    """The sequence without windows of low complexity at its ends; one good window between two low ones doesn't stop the cut."""

    def cut(windows: list[str]) -> int:
        taken, skipped = 0, False
        for w in windows:
            if low_complexity_long(w):
                taken, skipped = taken + (2 if skipped else 1), False
            elif skipped:
                break
            else:
                skipped = True
        return taken * window

    n = len(seq)
    start = cut([seq[i : i + window] for i in range(0, n - window + 1, window)])
    end = n - cut([seq[i - window : i] for i in range(n, window - 1, -window)])
    return seq[start:end] if start < end else ""


def parts(seq: Column, window: int, least: int | None = None) -> Column:
    """array<struct<start, end>> of complex_parts; null for null."""

    @F.pandas_udf("array<struct<start: int, end: int>>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [{"start": a, "end": z} for a, z in complex_parts(x, window, least)] for x in s], dtype="object")

    return run(seq)


def trimmed_ends(seq: Column, window: int) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else complex_ends(x, window) for x in s], dtype="object")

    return run(seq)
