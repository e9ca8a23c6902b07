"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import json

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import Tables

__all__ = ["Tables", "at", "by_size", "count_at_most", "documents", "freeing", "fresh", "longs", "parts_of", "words_of"]

#: Bytes that end a word: space and the control characters 0x09 to 0x0D.
SPACES = " \t\n\x0b\f\r"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"


def freeing(run):
    """The pass of Arrow batches, after which a worker, which lives on, gives freed memory back to the system."""

    def passing(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return passing


def by_size(batches, limit: int, column: str = "text"):
    """The batches in slices of about so many bytes of a text column, of at least one row each."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()
        a = 0
        while a < b.num_rows:
            z, total = a + 1, sizes[a]
            while z < b.num_rows and total + sizes[z] <= limit:
                total += sizes[z]
                z += 1
            yield b.slice(a, z - a)
            a = z


def parts_of(data: bytes, size: int = 1 << 20):
    """Lists of the words of bytes that spaces divide, from a piece of about `size` bytes each."""
    a = 0
    while a < len(data):
        z = data.find(b" ", a + size) if a + size < len(data) else -1
        z = len(data) if z < 0 else z
        yield data[a:z].split()
        a = z


def longs(values: list[int]) -> Column:
    """A constant array; one literal after constant folding."""
    return F.from_json(F.lit(json.dumps([int(x) for x in values])), "array<bigint>")


def count_at_most(sorted_values: list[int], key: Column) -> Column:
    """How many of the sorted constants are <= key: a binary search inside one expression."""
    n = len(sorted_values)
    if not n:
        return F.lit(0)
    arr = longs(sorted_values)
    steps = [1 << b for b in range(n.bit_length() - 1, -1, -1)]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda pos, st: F.when((pos + st <= n) & (F.get(arr, pos + st - 1) <= key), pos + st).otherwise(pos),
    )


def at(values: list[int], index: Column) -> Column:
    return F.get(longs(values), index)


def words_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_PATTERN), lambda w: w != "")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have (names are compared without regard to case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
