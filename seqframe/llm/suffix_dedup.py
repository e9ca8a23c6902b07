"""Removal of long repeated byte strings by a sparse suffix array with deep-shallow sorting.

Every string of LENGTH bytes holds an anchor: the place of the least hash among its KGRAM-byte strings, which depends on
the string alone. Two places of an equal string therefore share an anchor's k-gram, with the same bytes to its left and
right. Anchors whose k-gram comes once are done with. For the others the contexts within LENGTH bytes are sorted, to the
right and (reversed) to the left, by deep-shallow sorting; neighbours in the order give the longest repeats on either
side, and from these follows the run of bytes around each anchor that repeated strings cover.

Contexts are sorted over ranges of (set, side, string, context), so neither a large set nor equal strings are gathered in
one task; the ends of the ranges are compared afterwards. A set whose common left and right parts make up a whole string
is settled by its neighbours alone. In the other sets, contexts whose longest repeats to the left and right don't make up
a string are done with, as are those whose neighbours show that they reach as far as their longest repeats allow. The
rest is divided, with what it may share strings with, by how the shared bytes fall to the two sides, and sorted again.
Sets of any size go the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, documents, freeing, fresh
from .suffix_sort import common, neighbours

LENGTH = 400
#: The length for training text: about 50 tokens or 30 words, so that any passage of over 50 words is found.
PASSAGE = 200
#: Parts that a set that isn't settled is divided into, by how the shared bytes fall to the two sides.
WAYS = 8
#: Bytes of a text that are hashed at a time.
PIECE = 1 << 21

_MULT = 0x9E3779B97F4A7C15
_tables: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if "byte" not in _tables:
        _tables["byte"] = _mix(np.arange(1, 257, dtype=np.uint64))
    if len(_tables.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, m in (("up", _MULT), ("down", pow(_MULT, -1, 1 << 64))):
            x = np.full(size, m, dtype=np.uint64)
            x[0] = 1
            _tables[name] = np.multiply.accumulate(x)
    return _tables["byte"], _tables["up"], _tables["down"]


def anchors(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of all strings of `length` bytes, ascending, and the hashes of their k-grams."""
    k = length // 2
    w = length - k + 1
    place, hashed = [], []
    for a in range(0, max(1, len(data) - length + 1), PIECE - length + 1):
        x = np.frombuffer(data[a : a + PIECE], dtype=np.uint8)
        n = len(x)
        if n < length:
            break
        byte, up, down = _powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(byte[x] * up[:n], out=sums[1:])
        h = _mix((sums[k:] - sums[:-k]) * down[: n - k + 1])
        m = len(h)
        # The place in the low bits makes keys distinct: of equal hashes, the leftmost counts.
        key = np.full(-(-m // w) * w + w, np.iinfo(np.uint64).max, np.uint64)
        key[:m] = (h >> np.uint64(22) << np.uint64(22)) | np.arange(m, dtype=np.uint64)
        rows = key.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        count = m - w + 1
        least = np.minimum(behind[:count], ahead[w - 1 : w - 1 + count])
        least = least[np.concatenate([[True], least[1:] != least[:-1]])]
        p = (least & np.uint64((1 << 22) - 1)).astype(np.int64)
        place.append(p + a)
        hashed.append(h[p])
    if not place:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p, first = np.unique(np.concatenate(place), return_index=True)
    return p, np.concatenate(hashed)[first].view(np.int64)


def find_anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                found = [anchors(t.encode("utf-8", "surrogatepass"), length) for t in part.column("text").to_pylist()]
                places = pa.array([p for p, _ in found], pa.list_(pa.int64()))
                hashes = pa.array([h for _, h in found], pa.list_(pa.int64()))
                yield pa.record_batch([part.column("cls"), places, hashes], names=["cls", "places", "hashes"])

    return freeing(run)


def cut_contexts(length: int):
    """Contexts of the given anchors: one row for each; the bytes themselves once for each task."""
    k = length // 2
    side = length - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            out: list[tuple] = []
            for cls, text, places in zip(*(b.column(c).to_pylist() for c in ("cls", "text", "places")), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for p in places:
                    left, right = data[max(0, p - side) : p][::-1], data[p + k : p + length]
                    gram = hashlib.blake2b(data[p : p + k], digest_size=16).digest()
                    whole = hashlib.blake2b(gram + len(left).to_bytes(2, "big") + left + right, digest_size=16).digest()
                    new = whole not in seen
                    if new:
                        if len(seen) > 200_000:
                            seen.clear()
                        seen.add(whole)
                    out.append((cls, p, gram, whole, left if new else None, right if new else None))
                if len(out) > 5000:
                    yield pack(out)
                    out = []
            if out:
                yield pack(out)

    return freeing(run)


CONTEXTS = "cls binary, place long, gram binary, context binary, left binary, right binary"


def pack(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.binary(), pa.int64(), *[pa.binary()] * 4]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["cls", "place", "gram", "context", "left", "right"])


REACH = "context binary, lo int, hi int"
SORTED = "context binary, klo int, khi int, side int, gram binary, best int, shared int, lo int, hi int, part int, role int, string binary"
#: Places of a row in its range: first, end of the first set, start of the last set, last.
FIRST, FIRST_END, LAST_START, LAST = 1, 2, 4, 8


def sort_range(side: int, named: bool):
    """Sorts one range of (set, side, string, context). For each string: its longest prefix shared with a neighbour of its
    set and side, the prefix shared by all of the set's strings in this range, and the reach (lo, hi) that its neighbours
    show. Four rows at most keep their string, for what lies in other ranges. Sets are `named` where a context may lie in
    several; else only those at the ends of the range are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = list(batches)
        if not sum(b.num_rows for b in read):
            return
        held = pa.Table.from_batches(read)
        del read
        sides, others = (held.column(c).to_pylist() for c in ("side", "other"))
        strings = [g + bytes([s]) + x for g, s, x in zip(held.column("gram").to_pylist(), sides, held.column("string").to_pylist())]
        grams = held.column("gram").to_pylist()
        held = held.select(["context", "klo", "khi", "side"])
        order, lcp = neighbours(strings)
        n, head = len(order), HEAD
        starts = [i for i in range(n) if not i or lcp[i] < head]
        best, shared, role, lo, hi = [0] * n, [0] * n, [0] * n, [None] * n, [None] * n
        for a, z in zip(starts, [*starts[1:], n]):
            for i in range(a + 1, z):
                own = lcp[i] - head
                best[i - 1], best[i] = max(best[i - 1], own), own
                if own and own + (other := common(others[order[i - 1]], others[order[i]])) >= side:
                    low, high = (side - other, own) if sides[order[i]] == 0 else (side - own, other)
                    for j in (i - 1, i):
                        lo[j] = low if lo[j] is None else min(lo[j], low)
                        hi[j] = high if hi[j] is None else max(hi[j], high)
            shared[a:z] = [common(strings[order[a]], strings[order[z - 1]]) - head] * (z - a)
        role[0] |= FIRST
        role[(starts[1] if len(starts) > 1 else n) - 1] |= FIRST_END
        role[starts[-1]] |= LAST_START
        role[n - 1] |= LAST
        part = TaskContext.get().partitionId()
        made = held.take(pa.array(order))
        whole = [strings[x] if r else None for x, r in zip(order, role)]
        ends = {strings[order[i]][:head] for i in (0, n - 1)}
        made = made.append_column("gram", pa.array([grams[x] if named or strings[x][:head] in ends else None for x in order], pa.binary()))
        for name, values in (("best", best), ("shared", shared), ("lo", lo), ("hi", hi), ("part", [part] * n), ("role", role)):
            made = made.append_column(name, pa.array(values, pa.int32()))
        yield from made.append_column("string", pa.array(whole, pa.binary())).to_batches(8192)

    return freeing(run)


#: Bytes before a context's own in a sorted string: the set and the side.
HEAD = 17


def across(ends: list) -> tuple[list[tuple], list[tuple]]:
    """From the marked rows of all ranges: (gram, context, side, best) for neighbours in different ranges, and (gram, side,
    shared) for sets that lie in several ranges."""
    best, spans = [], []
    parts: dict[int, dict[int, object]] = {}
    for r in ends:
        for role in (FIRST, FIRST_END, LAST_START, LAST):
            if r["role"] & role:
                parts.setdefault(r["part"], {})[role] = r
    before, opened, ranges = None, None, 0
    for p in sorted(parts):
        now = parts[p]
        first, last = bytes(now[FIRST]["string"]), bytes(now[LAST]["string"])
        if before is not None:
            n = common(bytes(before["string"]), first) - HEAD
            if n >= 0:
                best.extend((bytes(x["gram"]), bytes(x["context"]), x["side"], n) for x in (before, now[FIRST]))
        if opened is not None and opened[:HEAD] == first[:HEAD]:
            ranges += 1
            end = bytes(now[FIRST_END]["string"])
            if ranges > 1:
                if spans and spans[-1][:2] == (first[: HEAD - 1], first[HEAD - 1]):
                    spans.pop()
                spans.append((first[: HEAD - 1], first[HEAD - 1], common(opened, end) - HEAD))
        if opened is None or opened[:HEAD] != last[:HEAD]:
            opened, ranges = bytes(now[LAST_START]["string"]), 1
        before = now[LAST]
    return best, spans


def reach_of(rows: DataFrame, tables: Tables, side: int) -> DataFrame:
    """(context, lo, hi) for contexts (gram, context, left, right; no context twice): the least and greatest number of
    bytes before the anchor at which a string shared with another context of its set starts."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out, level = [], 0
    strings = rows.select("context", "left", "right")
    # What is known of each context's reach so far (klo, khi): nothing.
    rows = rows.withColumn("klo", F.lit(side + 1)).withColumn("khi", F.lit(-1))
    while True:
        one = lambda n, own, other: F.struct(F.lit(n).alias("side"), F.col(own).alias("string"), F.col(other).alias("other"))
        each = rows.select("gram", "context", "klo", "khi", F.explode(F.array(one(0, "left", "right"), one(1, "right", "left"))).alias("x"))
        dealt = each.select("gram", "context", "klo", "khi", "x.*").repartitionByRange(parts, "gram", "side", "string", "context")
        ordered = tables.keep(dealt.mapInArrow(sort_range(side, level > 0), SORTED), f"sorted{side}_{level}")
        tables.tidy()
        best, spans = across(ordered.where(F.col("role") > 0).collect())  # four rows a range at most
        wide = spark.createDataFrame(spans, "gram binary, side int, wide int")  # a row for two ranges at most
        known = ["gram", "context", "klo", "khi", "side", "best", "lo", "hi"]
        found = ordered.select(*known, "shared").join(F.broadcast(wide), ["gram", "side"], "left").select(*known, F.coalesce("wide", "shared").alias("shared"))
        border = spark.createDataFrame(best, "gram binary, context binary, side int, best int")
        found = found.unionByName(border, allowMissingColumns=True)
        pick = lambda s, c: F.when(F.col("side") == s, F.col(c))
        keys = ["gram", "context"] if level else ["context"]  # at first each context lies in one set
        met = found.groupBy(*keys).agg(
            F.max(pick(0, "best")).alias("bl"), F.max(pick(1, "best")).alias("br"), F.max(pick(0, "shared")).alias("l"), F.max(pick(1, "shared")).alias("r"),
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("klo").alias("klo"), F.max("khi").alias("khi"),
        )
        # A shared string is at most as long as what is shared on the two sides.
        met = tables.keep(met.where(F.col("bl") + F.col("br") >= side), f"met{side}_{level}")
        tables.drop(f"sorted{side}_{level}")
        settled = F.col("l") + F.col("r") >= side
        most, least = F.least(F.lit(side), "bl"), side - F.least(F.lit(side), "br")
        out.append(met.where(settled).select("context", least.alias("lo"), most.alias("hi")))
        out.append(met.where(~settled & F.col("lo").isNotNull()).select("context", "lo", "hi"))
        met = met.withColumn("klo", F.least("klo", "lo")).withColumn("khi", F.greatest("khi", "hi"))
        open_hi, open_lo = F.col("khi") < most, F.col("klo") > least
        left = met.where(~settled)
        if not left.where(open_hi | open_lo).take(1):
            break
        # A pair that shares s more bytes in total shares at least p_t to the left and s + 1 - p_(t+1) to the right for one t
        # (p: WAYS + 1 even steps from 0 to s + 1), within the longest repeats of each. What reaches farther to the left than
        # is known falls to the greater t, what reaches farther to the right to the smaller ones. Keys are counted first;
        # strings follow those that come twice and that something looks for.
        s = side - F.col("l") - F.col("r")
        step = lambda t: F.floor((s + 1) * t / WAYS).cast("int")
        ways = []
        for t in range(WAYS):
            a, b = F.col("l") + step(t), F.col("r") + s + 1 - step(t + 1)
            key = F.concat("gram", F.lit(str(t)).cast("binary"), F.substring("left", F.lit(1), a), F.substring("right", F.lit(1), b))
            to_left = open_hi & ((F.col("l") + step(t + 1) > F.col("khi") + 1) | (step(t + 1) == s + 1))
            to_right = open_lo & ((step(t) == 0) | (step(t) < F.col("r") + s + F.col("klo") - side))
            made = F.struct(F.unhex(F.substring(F.sha2(key, 256), 1, 32)).alias("gram"), (to_left | to_right).alias("wanted"))
            ways.append(F.when((step(t) < step(t + 1)) & (a <= F.col("bl")) & (b <= F.col("br")), made))
        # What isn't open is only met by others.
        done = ~(open_hi | open_lo)
        klo, khi = F.when(done, -1).otherwise(F.col("klo")).alias("klo"), F.when(done, side + 1).otherwise(F.col("khi")).alias("khi")
        with_strings = left.join(strings if level else rows.select("gram", "context", "left", "right"), "context")
        child = with_strings.select("context", klo, khi, F.explode(F.array(*ways)).alias("x")).where(F.col("x").isNotNull()).select("context", "klo", "khi", "x.*")
        child = tables.keep(child, f"keys{side}_{level}")
        twice = child.groupBy("gram").agg(F.count(F.lit(1)).alias("c"), F.bool_or("wanted").alias("wanted")).where((F.col("c") > 1) & F.col("wanted")).select("gram")
        rows = tables.keep(child.join(twice, "gram", "left_semi").join(strings, "context").select("gram", "context", "left", "right", "klo", "khi"), f"rows{side}_{level}")
        tables.drop(f"keys{side}_{level}", *([f"rows{side}_{level - 1}"] if level else []))
        tables.tidy()
        level += 1
    found = out[0]
    for x in out[1:]:
        found = found.union(x)
    return found


def remove(data: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left without the runs [from, to), the number of bytes removed, and the number of maximal runs."""
    kept, at, removed, spans, end = [], 0, 0, 0, -1
    for a, b in sorted(runs):
        if a > end:
            spans += 1
        a = max(a, at)
        if b > a:
            kept.append(data[at:a])
            removed += b - a
            at = b
        end = max(end, b)
    kept.append(data[at:])
    return b"".join(kept), removed, spans


@freeing
def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
        out = []
        for cls, text, runs in zip(*(b.column(c).to_pylist() for c in ("cls", "text", "runs")), strict=True):
            kept, removed, spans = remove(text.encode("utf-8", "surrogatepass"), [(r["a"], r["b"]) for r in runs])
            out.append((cls, removed, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
        cols = list(zip(*out, strict=True)) or [()] * 5
        types = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["cls", "n_removed", "n_spans", "kept_sha256", "kept_text"])


CUT = "cls binary, n_removed long, n_spans long, kept_sha256 string, kept_text string"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def text_class(text_col: str = "text"):
    """Equal texts have an equal class: the SHA-256 of their bytes; null counts as empty."""
    return F.unhex(F.sha2(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"), 256))


def distinct_texts(docs: DataFrame, tables: Tables, length: int, text_col: str = "text") -> DataFrame:
    """(cls, text, copies): the distinct texts of at least `length` bytes; shorter ones hold no string of it. They lie in buckets, so
    that anchors and runs come to the texts."""
    long = docs.where(F.octet_length(text_col) >= length).select(text_class(text_col).alias("cls"), F.col(text_col).alias("text"))
    texts = tables.keep_bucketed(long.groupBy("cls").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")), "texts", "cls")
    tables.tidy()
    return texts


def repeated_runs(texts: DataFrame, tables: Tables, length: int) -> DataFrame:
    """(cls, runs): the bytes [a, b) of distinct texts that strings of `length` bytes cover which start anywhere else too; runs
    may overlap. Texts without any have no row. Copies of a text don't count here."""
    side = length - length // 2
    texts = texts.where(F.octet_length("text") >= length)
    found = tables.keep(texts.select("cls", "text").mapInArrow(find_anchors(length), "cls binary, places array<long>, hashes array<long>"), f"anchors_{length}")
    each = found.select("cls", F.explode(F.arrays_zip("places", "hashes")).alias("x")).select("cls", F.col("x.places").alias("place"), F.col("x.hashes").alias("h"))
    twice = tables.keep(each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("h"), f"twice_{length}")
    again = tables.keep(each.join(twice, "h").groupBy("cls").agg(F.collect_list("place").alias("places")), f"again_{length}")  # of one text
    tables.tidy()
    rows = tables.keep(texts.join(again, "cls").select("cls", "text", "places").mapInArrow(cut_contexts(length), CONTEXTS), f"contexts_{length}")
    tables.drop(*(f"{n}_{length}" for n in ("anchors", "twice", "again")))
    tables.tidy()
    # Contexts that come several times share all that they are.
    times = rows.groupBy("context").agg(F.count(F.lit(1)).alias("times"), F.max(F.octet_length("left")).alias("l"), F.max(F.octet_length("right")).alias("r"))
    same = times.where((F.col("times") > 1) & (F.col("l") + F.col("r") >= side)).select("context", (side - F.col("r")).alias("lo"), F.col("l").alias("hi"))
    same = tables.keep(same, f"same_{length}")
    strings = tables.keep(rows.where(F.col("left").isNotNull()).select("gram", "context", "left", "right").dropDuplicates(["context"]), f"strings_{length}")
    # From here on the strings are held once.
    placed = tables.keep(rows.select("cls", "place", "context"), f"placed_{length}")
    tables.drop(f"contexts_{length}")
    tables.tidy()
    reach = reach_of(strings, tables, side)
    reach = tables.keep(reach.union(same).groupBy("context").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), f"reach_{length}")
    runs = placed.join(reach, "context").select("cls", F.struct((F.col("place") - F.col("hi")).alias("a"), (F.col("place") - F.col("lo") + length).alias("b")).alias("run"))
    runs = tables.keep(runs.groupBy("cls").agg(F.collect_list("run").alias("runs")), f"runs_{length}")  # of one text
    tables.drop(*(f"{n}_{length}" for n in ("placed", "same", "strings", "reach")))
    tables.tidy()
    return runs


def repeated(docs: DataFrame, tables: Tables, length: int = LENGTH, text_col: str = "text") -> DataFrame:
    """One row per distinct text that loses bytes: cls, n_removed, n_spans, kept_sha256, kept_text (undecodable rests of
    cut characters left out). Only texts of at least `length` bytes can lose any; copies lose everything."""
    texts = distinct_texts(docs, tables, length, text_col)
    runs = repeated_runs(texts, tables, length)
    copied = texts.where((F.col("copies") > 1) & (F.octet_length("text") >= length)).select("cls", F.octet_length("text").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(EMPTY_SHA).alias("kept_sha256"), F.lit("").alias("kept_text"))
    cut = texts.where(F.col("copies") == 1).select("cls", "text").join(runs, "cls").mapInArrow(cut_texts, CUT)
    made = tables.keep(cut.union(copied), "cut")
    tables.drop("texts", f"runs_{length}")
    return made


def without_repeats(docs: DataFrame, length: int = PASSAGE) -> DataFrame:
    """docs with the repeated strings cut out of their texts, and n_chars set anew where a text is cut. Rows of which
    nothing but white space is left go; other rows and columns stay as they are."""
    tables = Tables(docs.sparkSession, "suffix")
    cut = repeated(docs, tables, length).select(F.col("cls").alias("_cut_cls"), F.col("kept_text").alias("_cut_text"))
    key = fresh(docs, "cls")
    met = docs.withColumn(key, text_class()).join(cut, F.col(key) == F.col("_cut_cls"), "left")
    met = met.where(F.col("_cut_cls").isNull() | (F.trim(F.translate("_cut_text", "\t\n\x0b\f\r", "     ")) != ""))
    new = {"text": F.when(F.col("_cut_cls").isNull(), F.col("text")).otherwise(F.col("_cut_text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_cut_cls").isNull(), F.col("n_chars")).otherwise(F.char_length("_cut_text")).cast(docs.schema["n_chars"].dataType)
    return met.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def op10_suffix_array(spark, sf_dir: str) -> DataFrame:
    """What every document loses and the hash of what is left."""
    tables = Tables(spark, "suffix")
    docs = documents(spark, sf_dir)
    slim = docs.select("doc_id", text_class().alias("cls"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    cut = repeated(docs, tables).drop("kept_text")
    long = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return slim.join(cut, "cls", "left").select("doc_id", "n_bytes", long("n_removed"), long("n_spans"), F.coalesce("kept_sha256", F.lower(F.hex("cls"))).alias("kept_sha256"))
