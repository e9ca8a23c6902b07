import random

import pytest

from seqframe.functions import complexity as X


@pytest.mark.parametrize("seq", ["A" * 40, "AC" * 20, "ACG" * 15, "T" + "AC" * 20])
def test_repeats(seq):
    assert X.is_repeat(seq) and X.low_complexity_long(seq)


def test_others():
    seq = "".join(random.Random(3).choices("ACGT", k=400))
    assert not X.is_repeat(seq) and not X.low_complexity_short(seq) and not X.low_complexity_windowed(seq)
    assert X.low_complexity_windowed("AT" * 150 + seq[:50])
    assert not X.is_repeat("") and not X.low_complexity_short("AAA") and not X.low_complexity_long("AAAAAA")
    assert X.low_complexity_short("AACA" * 12)


def test_query(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("A" * 30,), ("ACGTTGCATTAGCCGATAGC",), (None,)], "seq string")
    assert [r[0] for r in df.select(X.flag(X.is_repeat, F.col("seq"))).collect()] == [True, False, None]
