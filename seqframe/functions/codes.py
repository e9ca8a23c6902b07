"""k-mers as 64-bit numbers: two bits a base (A, C, G, T are 0 to 3), so numbers are ordered as strings are. k is at most 31.

Codes are made in Arrow batches, a piece of bounded size at a time; counting, joining and everything else is left to Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bases that are coded at a time.
PIECE = 1 << 20
MAX_K = 31

_CODE = np.full(256, 4, np.uint8)
for _i, _letters in enumerate(("Aa", "Cc", "Gg", "TtUu")):
    _CODE[[ord(c) for c in _letters]] = _i


def check(k: int) -> None:
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be 1 to {MAX_K}")


def decode(code: Column, k: int) -> Column:
    """The k-mer of a code."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def encode(kmer: Column) -> Column:
    """The code of a k-mer of A, C, G and T."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def mirrored(code: Column, k: int) -> Column:
    """The code of the reverse complement."""
    pairs = F.bitwise_not(code)
    for bits, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        m = F.lit(mask).cast("long")
        pairs = F.shiftrightunsigned(pairs, bits).bitwiseAND(m).bitwiseOR(F.shiftleft(pairs.bitwiseAND(m), bits))
    return F.shiftrightunsigned(pairs, 64 - 2 * k)


def _rolled(b: np.ndarray, k: int, backward: bool) -> np.ndarray:
    """Numbers of all windows of k digits, in reading order or backward, by doubling."""
    out, size, have = None, 0, (b, 1)
    while True:
        part, n = have
        if k & n:
            if out is None:
                out, size = part, n
            else:
                m = len(b) - size - n + 1
                near, far = out[:m], part[size : size + m]
                out = (far << np.uint64(2 * size)) | near if backward else (near << np.uint64(2 * n)) | far
                size += n
        if 2 * n > k:
            return out
        m = len(part) - n
        near, far = part[:m], part[n : n + m]
        have = ((far << np.uint64(2 * n)) | near if backward else (near << np.uint64(2 * n)) | far, 2 * n)


def windows(data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all k-mers of the bytes, those of their reverse complements, and which hold valid bases only."""
    digits = _CODE[data]
    bad = np.concatenate([[0], np.cumsum(digits == 4)])
    b = digits.astype(np.uint64) & np.uint64(3)
    return _rolled(b, k, False).view(np.int64), _rolled(np.uint64(3) - b, k, True).view(np.int64), bad[k:] == bad[:-k]


def pieces(batch: pa.RecordBatch, seq_col: str, span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, row, place, start): the sequences' bytes, about PIECE at a time. For each window of `span` bases that lies in one
    sequence: its row, its place in the sequence and where it starts in the bytes. A longer sequence is cut with overlaps."""
    texts = batch.column(seq_col).cast(pa.large_binary())
    held, total = [], 0

    def out(held):
        parts, rows, places, starts, at = [], [], [], [], 0
        for i, a, s in held:
            n = len(s) - span + 1
            rows.append(np.full(n, i, np.int64))
            places.append(np.arange(a, a + n))
            starts.append(np.arange(at, at + n))
            parts.append(s)
            at += len(s)
        return (np.frombuffer(b"".join(parts), np.uint8), *(np.concatenate(x) for x in (rows, places, starts)))

    for i, s in enumerate(texts.to_pylist()):
        for a in range(0, max(1, len(s or b"") - span + 1), PIECE):
            part = (s or b"")[a : a + PIECE + span - 1]
            if len(part) < span:
                continue
            held.append((i, a, part))
            total += len(part)
            if total >= PIECE:
                yield out(held)
                held, total = [], 0
    if held:
        yield out(held)


def kmer_codes(reads: DataFrame, k: int, id_col: str = "read_id", seq_col: str = "seq", text: bool = True) -> DataFrame:
    """(read_id, pos, kmer, code, ccode) of every k-mer: the code of the k-mer, and the smaller one of both strands. Codes are
    null where a base isn't A, C, G, T or U. Without `text`, no kmer."""
    check(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, row, place, start in pieces(b, seq_col, k):
                ahead, back, valid = windows(data, k)
                ahead, back, valid = ahead[start], back[start], valid[start]
                cols = {id_col: b.column(id_col).take(pa.array(row)), "pos": pa.array(place)}
                if text:
                    letters = np.lib.stride_tricks.sliding_window_view(data, k)[start]
                    ends = np.arange(len(start) + 1, dtype=np.int32) * k
                    cols["kmer"] = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(letters)))
                cols |= {"code": pa.array(ahead, mask=~valid), "ccode": pa.array(np.minimum(ahead, back), mask=~valid)}
                yield pa.record_batch(list(cols.values()), names=list(cols))

    kind = reads.schema[id_col].dataType.simpleString()
    return reads.select(id_col, seq_col).mapInArrow(run, f"`{id_col}` {kind}, pos long, " + ("kmer string, " if text else "") + "code long, ccode long")


def code_counts(reads: DataFrame, sizes: list[int], stranded: bool = False, seq_col: str = "seq") -> DataFrame:
    """(k, code, cov) for each size: valid canonical (or stranded) k-mers and how often they come, counted before the shuffle."""
    for k in sizes:
        check(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in sizes:
                for data, _, _, start in pieces(b, seq_col, k):
                    ahead, back, valid = windows(data, k)
                    code = (ahead if stranded else np.minimum(ahead, back))[start][valid[start]]
                    code, n = np.unique(code, return_counts=True)
                    yield pa.record_batch([pa.array(np.full(len(code), k, np.int32)), pa.array(code), pa.array(n.astype(np.int64))], names=["k", "code", "n"])

    partial = reads.select(seq_col).mapInArrow(run, "k int, code long, n long")
    return partial.groupBy("k", "code").agg(F.sum("n").alias("cov"))


def pair_codes(reads: DataFrame, k: int, distance: int, seq_col: str = "seq", id_col: str | None = None) -> DataFrame:
    """(left, right) codes of k-mers `distance` apart, both valid; the smaller one of a pair and its reverse-complement mirror.
    With id_col: also the read and the place (pos) of the first k-mer, for every pair; else each pair once for a piece."""
    check(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, row, place, start in pieces(b, seq_col, k + distance):
                ahead, back, valid = windows(data, k)
                fine = valid[start] & valid[start + distance]
                start = start[fine]
                a, z, ra, rz = ahead[start], ahead[start + distance], back[start], back[start + distance]
                flip = (rz < a) | ((rz == a) & (ra < z))
                left, right = np.where(flip, rz, a), np.where(flip, ra, z)
                cols = {}
                if id_col:
                    cols = {id_col: b.column(id_col).take(pa.array(row[fine])), "pos": pa.array(place[fine])}
                else:
                    order = np.lexsort((right, left))
                    left, right = left[order], right[order]
                    new = np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]) if len(left) else np.zeros(0, bool)
                    left, right = left[new], right[new]
                cols |= {"left": pa.array(left), "right": pa.array(right)}
                yield pa.record_batch(list(cols.values()), names=list(cols))

    own = f"`{id_col}` {reads.schema[id_col].dataType.simpleString()}, pos long, " if id_col else ""
    return reads.select(*([id_col] if id_col else []), seq_col).mapInArrow(run, own + "left long, right long")


def window_minima(reads: DataFrame, k: int, w: int, id_col: str = "read_id", seq_col: str = "seq") -> DataFrame:
    """(read_id, code): the distinct least canonical codes of w neighbouring k-mers. Windows with an invalid base have none."""
    check(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, row, _, start in pieces(b, seq_col, k + w - 1):
                ahead, back, valid = windows(data, k)
                code = np.where(valid, np.minimum(ahead, back), np.iinfo(np.int64).max)
                least = np.lib.stride_tricks.sliding_window_view(code, w).min(axis=1)[start]
                bad = np.concatenate([[0], np.cumsum(~valid)])
                fine = bad[start + w] == bad[start]
                least, row = least[fine], row[fine]
                order = np.lexsort((least, row))
                least, row = least[order], row[order]
                new = np.concatenate([[True], (row[1:] != row[:-1]) | (least[1:] != least[:-1])]) if len(row) else np.zeros(0, bool)
                yield pa.record_batch([b.column(id_col).take(pa.array(row[new])), pa.array(least[new])], names=[id_col, "code"])

    kind = reads.schema[id_col].dataType.simpleString()
    return reads.select(id_col, seq_col).mapInArrow(run, f"`{id_col}` {kind}, code long").distinct()
