"""Stages and the command line on simulated reads."""

import random

import pytest

from seqframe import cli
from seqframe.plans import stages
from seqframe.plans.assembly import Config
from seqframe.sources import fastx

RC = str.maketrans("ACGT", "TGCA")


def test_paired_assembly(spark, tmp_path):
    rng = random.Random(4)
    made = ["".join(rng.choices("ACGT", k=n)) for n in (400, 300)]
    l, r = [], []
    for t in made:
        for i in range(0, len(t) - 159, 4):
            f = t[i : i + 160]
            l.append(f[:70])
            r.append(f[-70:][::-1].translate(RC))
    for name, rows in (("l", l), ("r", r)):
        (tmp_path / f"{name}.fq").write_text("".join(f"@p{i}/1\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(rows)))
    pairs = cli.mates(spark, str(tmp_path / "l.fq"), str(tmp_path / "r.fq"), 0)
    got = {x["name"]: x for x in stages.fragments(pairs, Config(21, 1, 100)).collect()}
    whole = {f"p{i}": t[a : a + 160] for i, (t, a) in enumerate((t, a) for t in made for a in range(0, len(t) - 159, 4))}
    assert len(got) == len(whole) and all(x["connected"] and x["seq"] == whole[n] for n, x in got.items())
    args = ["--left", str(tmp_path / "l.fq"), "--right", str(tmp_path / "r.fq"), "--out", str(tmp_path / "out"), "--k", "21", "--coverage", "1", "--length", "100", "--rounds", "0", "--unmended"]
    cli.main(args)
    seqs = {x["seq"] for x in fastx.read_fasta(spark, str(tmp_path / "out")).collect()}
    assert seqs == {min(t, t[::-1].translate(RC)) for t in made}


def write_fastq(path, rows):
    path.write_text("".join(f"@{n}\n{s}\n+\n{'I' * len(s)}\n" for n, s in rows))


def test_pool(spark, tmp_path):
    """Two rows of one sample, of different columns; every file counts."""
    rng = random.Random(6)
    made = ["".join(rng.choices("ACGT", k=n)) for n in (260, 240, 220, 250)]
    cut = lambda t: [t[i : i + 80] for i in range(0, len(t) - 79, 5)]
    for i, t in enumerate(made[:2]):
        frags = [t[a : a + 120] for a in range(0, len(t) - 119, 4)]
        write_fastq(tmp_path / f"l{i}.fq", [(f"p{j}/1", f[:70]) for j, f in enumerate(frags)])
        write_fastq(tmp_path / f"r{i}.fq", [(f"p{j}/2", f[-70:][::-1].translate(RC)) for j, f in enumerate(frags)])
    write_fastq(tmp_path / "f.fq", [(f"f{j}", s) for j, s in enumerate(cut(made[2]))])
    write_fastq(tmp_path / "b.fq", [(f"b{j}", s[::-1].translate(RC)) for j, s in enumerate(cut(made[3]))])
    p = lambda n: str(tmp_path / n)
    (tmp_path / "pool.txt").write_text(f"#name left right sef ser\na {p('l0.fq')} {p('r0.fq')} {p('f.fq')} {p('b.fq')}\n")
    (tmp_path / "pool2.txt").write_text(f"#name left right\na {p('l0.fq')} {p('r0.fq')}\na {p('l1.fq')} {p('r1.fq')}\n")
    for pool, n in (("pool.txt", (0, 2, 3)), ("pool2.txt", (0, 1))):
        args = cli.parser().parse_args(["--pool", p(pool), "--out", p("x"), "--k", "21", "--coverage", "1", "--length", "100", "--rounds", "0", "--unmended"])
        got = {r["seq"] for r in cli.run(spark, args).collect()}
        assert got == {min(made[i], made[i][::-1].translate(RC)) for i in n}


def test_mates_without_partner(spark):
    left = spark.createDataFrame([("a", "ACGT"), ("b", "CCGT")], "name string, seq string")
    assert fastx.read_pairs(left, left).count() == 2
    with pytest.raises(Exception, match="no mate of b"):
        fastx.read_pairs(left, left.where("name = 'a'")).collect()


def test_long_reads(spark):
    rng = random.Random(3)
    made = "".join(rng.choices("ACGT", k=900))
    reads = [(i, made[a : a + 400]) for i, a in enumerate(range(0, 501, 50))] * 1
    reads = [(i, s[:200] + ("" if i == 3 else s[200]) + s[201:]) for i, s in reads]
    parts = stages.long_reads(spark.createDataFrame(reads, "read_id long, seq string"), Config(15, 2, 100))
    got = {r["name"]: r["seq"] for r in parts.collect()}
    assert len(got) == len(reads) and got["3_s0"] in made
    whole = stages.long_read_layout(parts.select("name", "seq"), k=13, w=4, least=100, clip=20).collect()
    assert [r["seq"] in (made, made[::-1].translate(RC)) for r in whole] == [True]
