"""Sources and stores: round trips and malformed input."""

import random

import pytest
from pyspark.sql import functions as F

from seqframe.sources import fastx, stores


def test_fastq_in_splits(spark, tmp_path):
    rng = random.Random(3)
    want = []
    for f in range(2):
        lines = []
        for i in range(400):
            seq = "".join(rng.choices("ACGTN", k=rng.randint(1, 80)))
            qual = "@" + "".join(chr(33 + rng.randint(0, 41)) for _ in seq[1:])
            lines += [f"@f{f}r{i}/1 x", seq, "+", qual]
            want.append((f"f{f}r{i}", seq, qual))
        (tmp_path / f"{f}.fq").write_text("\n".join(lines) + "\n" * (1 + f))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = fastx.read_fastq(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() >= 1 and spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        assert sorted((r["name"], r["seq"], r["qual"]) for r in got.collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert stores.sniff(spark, str(tmp_path / "0.fq")) == "fastq"
    (tmp_path / "bad.fq").write_text("@a\nAC\n-\nII\n")
    with pytest.raises(Exception, match="not a FASTQ record"):
        fastx.read_fastq(spark, str(tmp_path / "bad.fq")).collect()
    (tmp_path / "none.txt").write_text("abc\n")
    with pytest.raises(ValueError, match="neither"):
        stores.sniff(spark, str(tmp_path / "none.txt"))


def test_reads_and_segments(spark, tmp_path):
    (tmp_path / "l.fa").write_text(">a/1\nACGTACGTNNACGTT\n>b/1\nAAAAA\n")
    (tmp_path / "r.fa").write_text(">a/2\nTTTTTNGGGGG\n>c/2\nCCCCC\n")
    both = fastx.read_reads(spark, {"forward": str(tmp_path / "l.fa"), "reverse": str(tmp_path / "r.fa")})
    assert {(r["orientation"], r["name"], r["seq"]) for r in both.collect()} == {("forward", "a", "ACGTACGTNNACGTT"), ("forward", "b", "AAAAA"), ("reverse", "a", "CCCCCNAAAAA"), ("reverse", "c", "GGGGG")}
    l, r = (fastx.read_fasta(spark, str(tmp_path / f"{x}.fa")) for x in "lr")
    got = {x["name"]: (x["left"], x["right"]) for x in fastx.pair_segments(l, r, 4, "FR").collect()}
    assert got == {"a": (["ACGTACGT", "NN", "ACGTT"], ["CCCCC", "N", "AAAAA"]), "b": (["AAAAA"], []), "c": ([], ["GGGGG"])}


def test_stores(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    rows = [("a", "ACGTA"), ("b", ""), ("c", "T" * 9)]
    df = spark.createDataFrame(rows, "name string, seq string")
    stores.write_packed(df, at("packed"))
    assert sorted(map(tuple, stores.read_packed(spark, at("packed")).collect())) == rows
    hist = spark.createDataFrame([(1, 5), (3, 2), (12, 1)], "multiplicity long, n_kmers long")
    stores.write_histogram(hist, at("hist"))
    f1, f0, back = stores.read_histogram(spark, at("hist"))
    assert (f1, f0) == (23, 8) and sorted(map(tuple, back.collect())) == [(1, 5), (3, 2), (12, 1)]
    q = {"min": 1, "q1": 2, "median": 3, "q3": 4, "max": 9}
    stores.write_quartiles(spark.createDataFrame([tuple(q.values())], "min long, q1 long, median long, q3 long, max long"), at("q"))
    assert stores.read_quartiles(spark, at("q")) == q
    frags = [("A" * 300, 20.0, True, False), ("C" * 50, 1.0, True, True), ("G" * 60, 5.0, False, False)]
    stores.write_fragments(spark.createDataFrame(frags, "seq string, min_cov double, connected boolean, polya boolean"), at("frags"))
    got = stores.read_fragments(spark, at("frags")).orderBy("order_key").collect()
    assert [(r["seq"][0], r["kind"], r["stratum"]) for r in got] == [("C", "short", "01"), ("A", "long", "e1"), ("G", "unconnected", "e0")]
    assert {r["seq"][0] for r in stores.read_fragments(spark, at("frags"), "e1").collect()} == {"A"}
    edges = [("a+", "b-", 100), ("b+", "a-", 70)]
    stores.write_graph(spark.createDataFrame(edges, "src string, dst string, size int"), at("graph"))
    assert sorted(map(tuple, stores.read_graph(spark, at("graph")).collect())) == edges
    stores.save_kmers(spark.createDataFrame([(5, 2)], "code long, cov long"), at("kmers"), 11, True)
    table, k, stranded = stores.load_kmers(spark, at("kmers"))
    assert (k, stranded, table.first()["cov"]) == (11, True, 2)
    assert stores.has_one_record(df.limit(1)) and not stores.has_one_record(df) and not stores.has_one_record(df.where(F.lit(False)))


def test_numbers(spark, tmp_path):
    df = spark.createDataFrame([(5,), (None,), (-3,), (5,), (2000000000,)], "n int")
    stores.write_numbers(df, "n", str(tmp_path / "n"))
    assert sorted(r["value"] for r in stores.read_numbers(spark, str(tmp_path / "n")).collect()) == [-3, 5, 5, 2000000000]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.txt").write_text("1.5\n\n 2 \n")
    assert [r["value"] for r in stores.read_numbers(spark, str(tmp_path / "d"), "double").collect()] == [1.5, 2.0]
    with pytest.raises(Exception, match="not a number"):
        stores.read_numbers(spark, str(tmp_path / "d")).collect()
    stores.write_numbers(df.limit(0), "n", str(tmp_path / "none"))
    assert stores.read_numbers(spark, str(tmp_path / "none")).count() == 0
