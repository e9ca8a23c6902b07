"""Alignment records with CIGAR strings, containment of overlaps, and inverted-repeat artefacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col


def operations(cigar: Column) -> Column:
    """array<struct<n, op>> of a CIGAR string."""
    each = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHPX=])"), F.lit(1))
    return F.transform(each, lambda x: F.struct(F.substring(x, F.lit(1), F.length(x) - 1).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")))


def has_alignment() -> Column:
    return C("cigar").isNotNull() & C("nm").isNotNull() & (C("nm") >= 0)


def matches_in(ops: Column) -> Column:
    """Bases in M operations."""
    return F.aggregate(F.filter(ops, lambda o: o["op"] == "M"), F.lit(0), lambda a, o: a + o["n"])


def good_matches(least: float) -> Column:
    """Matches are at least this share of the M operations' bases."""
    return C("nmatch") / matches_in(operations(C("cigar"))) >= least


def good_alignment(longest_gap: int, least: float) -> Column:
    """Identity is at least this, and no insertion or deletion is longer than longest_gap."""
    gaps = F.exists(operations(C("cigar")), lambda o: o["op"].isin("I", "D") & (o["n"] > longest_gap))
    return (C("nmatch") / C("blocklen") >= least) & ~gaps


def _blocks(ops: Column, start: Column, moves: str, cuts: str, longest_gap: int) -> Column:
    """Blocks along one sequence: M operations, those less than longest_gap apart in one, unless a longer gap lies between.
    `moves` are the operations that advance the place, `cuts` those that end a block where they are longer than the gap."""
    block = lambda a, z: F.struct(a.alias("start"), z.alias("end"))

    def step(a: Column, o: Column) -> Column:
        last = F.get(a["blocks"], F.size(a["blocks"]) - 1)
        on = a["open"] & (a["at"] - longest_gap < last["end"])
        end = a["at"] + o["n"]
        grown = F.when(on, F.concat(F.slice(a["blocks"], F.lit(1), F.greatest(F.lit(0), F.size(a["blocks"]) - 1)), F.array(block(last["start"], end)))).otherwise(F.concat(a["blocks"], F.array(block(a["at"], end))))
        match = o["op"] == "M"
        cut = o["op"].isin(*cuts) & (o["n"] > longest_gap)
        return F.struct(
            (a["at"] + F.when(match | o["op"].isin(*moves), o["n"]).otherwise(0)).alias("at"),
            F.when(match, True).when(cut, False).otherwise(a["open"]).alias("open"),
            F.when(match, grown).otherwise(a["blocks"]).alias("blocks"),
        )

    begin = F.struct(start.cast("int").alias("at"), F.lit(False).alias("open"), F.array().cast("array<struct<start:int,end:int>>").alias("blocks"))
    return F.aggregate(ops, begin, step, lambda a: a["blocks"])


def query_blocks(longest_gap: int) -> Column:
    """Aligned blocks of the query, ascending."""
    return _blocks(operations(C("cigar")), C("qstart"), "ISHPX", "ID", longest_gap)


def target_blocks(longest_gap: int) -> Column:
    """Aligned blocks of the target, ascending; on the reverse strand the target is read from its end."""
    ops = operations(C("cigar"))
    ahead = _blocks(ops, C("tstart"), "DNPX", "IDN", longest_gap)
    # The distance from the target's end, turned round.
    back = F.reverse(F.transform(_blocks(ops, F.lit(0), "DNPX", "IDN", longest_gap), lambda b: F.struct((C("tend") - b["end"]).alias("start"), (C("tend") - b["start"]).alias("end"))))
    return F.when(C("strand") == "+", ahead).otherwise(back)


def observed_bounds(paf: DataFrame) -> DataFrame:
    """(name, low, high): the least start and the greatest end of a sequence over all records, as query or target."""
    ends = paf.select(C("qname").alias("name"), C("qstart").alias("s"), C("qend").alias("e")).union(paf.select("tname", "tstart", "tend"))
    return ends.groupBy("name").agg(F.min("s").alias("low"), F.max("e").alias("high"))


def observed_containment(paf: DataFrame, clip: int) -> DataFrame:
    """Records with `status`: which of both reaches no farther than the overlap, judged by what is observed of each sequence
    instead of its length. Of both, the one with fewer bases left over; of equal ones, the target."""
    b = observed_bounds(paf)
    met = paf.join(b.select(C("name").alias("qname"), C("low").alias("qlow"), C("high").alias("qhigh")), "qname").join(b.select(C("name").alias("tname"), C("low").alias("tlow"), C("high").alias("thigh")), "tname")
    inside = lambda x: (C(f"{x}start") <= C(f"{x}low") + clip) & (C(f"{x}high") - C(f"{x}end") <= clip)
    over = lambda x: C(f"{x}start") - C(f"{x}low") + C(f"{x}high") - C(f"{x}end")
    q, t = inside("q"), inside("t")
    status = F.when(q & t, F.when(over("q") < over("t"), "QUERY").otherwise("TARGET")).when(q, "QUERY").when(t, "TARGET").otherwise("NEITHER")
    return met.withColumn("status", status)


def inverted_artefacts(paf: DataFrame, clip: int) -> DataFrame:
    """(qname, tname, drop): for each query and target with overlaps on both strands, by the longest overlap of either strand,
    which of them is an artefact of an inverted repeat: the target if one query interval lies in the other, the query if one
    target interval does, else the one with fewer unmapped bases if both overlaps together span it. Null: neither."""
    key = F.struct((C("qend") - C("qstart")).alias("span"), "nmatch", "oid", "lno")
    best = paf.where(C("qname") != C("tname")).groupBy("qname", "tname", "qlen", "tlen", "strand").agg(F.max_by(F.struct("qstart", "qend", "tstart", "tend"), key).alias("x"))
    a, b = (best.where(C("strand") == s).select("qname", "tname", "qlen", "tlen", C("x").alias(n)) for s, n in (("+", "a"), ("-", "b")))
    m = a.join(b, ["qname", "tname", "qlen", "tlen"])
    within = lambda x: ((C(f"a.{x}start") >= C(f"b.{x}start")) & (C(f"a.{x}end") <= C(f"b.{x}end"))) | ((C(f"b.{x}start") >= C(f"a.{x}start")) & (C(f"b.{x}end") <= C(f"a.{x}end")))
    low, high = (lambda x: F.least(f"a.{x}start", f"b.{x}start")), (lambda x: F.greatest(f"a.{x}end", f"b.{x}end"))
    size = lambda s, x: C(f"{s}.{x}end") - C(f"{s}.{x}start")
    meets = lambda x: (C(f"a.{x}start") <= C(f"b.{x}end")) & (C(f"b.{x}start") <= C(f"a.{x}end"))
    unmapped = lambda x: C(f"{x}len") - F.when(meets(x), high(x) - low(x)).otherwise(size("a", x) + size("b", x))
    spans = lambda x: (low(x) <= clip) & (high(x) + clip >= C(f"{x}len"))
    drop = F.when(within("q"), "TARGET").when(within("t"), "QUERY").when(unmapped("t") > unmapped("q"), F.when(spans("q"), "QUERY")).when(spans("t"), "TARGET")
    return m.select("qname", "tname", drop.alias("drop"))


def tail_kept(start: Column, end: Column, tail_start: Column, tail_end: Column) -> Column:
    """Whether a sequence's poly-A tail, if it has one, lies inside its overlap."""
    return F.coalesce((tail_start >= start) & (tail_end <= end), F.lit(True))
