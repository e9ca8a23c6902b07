"""Tails and heads with errors."""

import numpy as np

from seqframe.functions import tails


def find(seq, p):
    return tails.tail(np.array([c == "A" for c in seq]), p)


def test_tails(spark):
    short, long = tails.SHORT_READS, tails.LONG_READS
    assert find("GGGGCCCC", short) is None and find("AAA", short) is None and find("", short) is None
    assert find("CCCCAAAAAA", short) == (3, 10)  # goes on to the base before the run
    assert find("CCCCCCCCAAAAGAAAA", short) == (7, 17)  # one other base between seeds
    assert find("CCCCCCCCAAAAGGAAAA", short) == (14, 18)  # two are too many
    body = "CGTCGTTGCC" * 10
    assert find(body + "A" * 30, long) == (100, 130)
    assert find(body + "A" * 13 + "G" + "A" * 14, long) == (100, 128)
    df = spark.createDataFrame([(1, "CCCCAAAAAA"), (2, "TTTTTTGGGG"), (3, None), (4, "ACGT")], "id int, seq string")
    got = {r["id"]: (r["t"], r["h"]) for r in df.select("id", tails.tail_region(df["seq"]).alias("t"), tails.head_region(df["seq"]).alias("h")).collect()}
    assert got[1][0] == (3, 10) and got[1][1] is None
    assert got[2][0] is None and got[2][1] == (0, 7)
    assert got[3] == (None, None) and got[4] == (None, None)
