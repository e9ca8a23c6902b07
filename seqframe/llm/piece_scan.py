"""SentencePiece encoding and decoding by a max-plus scan over chunks.

The pieces of a text under byte-pair merges are the one sequence in which every neighbouring pair is stable: merging the
two pieces' characters alone gives the same two pieces again. So the encoding is the best path through a lattice whose
arcs score 0 (stable) or minus infinity, with the last piece as state, and giant documents can be cut anywhere. Each
chunk yields a matrix from the states at its start to those at its end; matrices are multiplied in the max-plus algebra,
which is associative, so a prefix scan combines them in a logarithmic number of steps; with the states at the cuts known,
each chunk is backtraced independently.

The vocabulary file is a merge model with byte fallback and no normalization beyond spaces written as U+2581.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, documents

SPACE = "▁"
#: Characters of a chunk; longer texts are cut.
CHUNK = 1 << 15
#: Distinct units and pairs that a worker remembers.
REMEMBERED_UNITS, REMEMBERED_PAIRS = 1_200_000, 500_000
UNIT = re.compile(f"{SPACE}*[^{SPACE}]*")
#: A state: a piece (-1 - code point: a character outside the vocabulary) and the place where it ends.
State = tuple[int, int]
LOW = np.float32(-np.inf)


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        special = [m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i) for i in range(len(self.text))]
        self.ids = {p: i for i, p in enumerate(self.text) if not special[i]}
        self.score = [m.get_score(i) for i in range(len(self.text))]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.text) if m.is_byte(i)}
        # Bytes that a piece stands for when decoded.
        raw = {i: bytes([b]) for b, i in self.byte.items()}
        self.raw = [raw[i] if i in raw else b"" if special[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(self.text)]
        self.longest = max(map(len, self.ids))
        self.adjacent = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        # Lengths of the pieces that end in two given characters, longest first.
        by_end: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 1:
                by_end.setdefault(p[-2:], set()).add(len(p))
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in by_end.items()}
        assert all(SPACE not in p.lstrip(SPACE) for p in self.ids), "pieces with a space after another character"
        self.pairs: dict[tuple[int, int], bool] = {}
        self.units: dict[str, bytes] = {}
        self.whole_pieces: dict[int, bool] = {}

    def merge(self, text: str) -> list[int]:
        """Byte-pair merges of a short string, best score and then leftmost first."""
        parts = list(text)
        while True:
            best = None
            for i in range(len(parts) - 1):
                p = self.ids.get(parts[i] + parts[i + 1])
                if p is not None and (best is None or self.score[p] > best[0]):
                    best = (self.score[p], i)
            if best is None:
                return [self.ids.get(p, -1 - ord(p[0])) for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def stable(self, a: int, b: int) -> bool:
        if a < 0 or b < 0:
            return self.alone(a) and self.alone(b)
        found = self.pairs.get((a, b))
        if found is None:
            found = self.merge(self.text[a] + self.text[b]) == [a, b]
            if len(self.pairs) > REMEMBERED_PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = found
        return found

    def alone(self, a: int) -> bool:
        """Whether merging a piece's characters gives the piece; some pieces are never made."""
        if a < 0:
            return True
        found = self.whole_pieces.get(a)
        if found is None:
            found = self.whole_pieces[a] = self.merge(self.text[a]) == [a]
        return found

    def ending(self, text: str, i: int, start: int) -> Iterator[tuple[int, int]]:
        """Pieces that end at i and start at `start` or later, longest first: (piece, its start)."""
        if i - start > 1:
            for n in self.lengths.get(text[i - 2 : i], ()):
                if i - n >= start and (p := self.ids.get(text[i - n : i])) is not None:
                    yield p, i - n
        if i > start:
            p = self.ids.get(text[i - 1])
            yield (p if p is not None else -1 - ord(text[i - 1])), i - 1

    def reach(self, text: str, start: int, first: int | None, stop: int, lengths: dict[int, int]) -> dict[int, int]:
        """From a piece `first` ending at start (None: nothing before it): the last piece of the stable sequence that
        ends at each place up to stop. lengths: gets the start of each."""
        last: dict[int, int] = {}
        for i in range(start + 1, stop + 1):
            for p, j in self.ending(text, i, start):
                before = first if j == start else last.get(j)
                if (j == start and first is None and self.alone(p)) or (before is not None and self.stable(before, p)):
                    last[i], lengths[i] = p, j
                    break
        return last

    def path(self, text: str, start: int, first: int | None, end: State) -> list[int]:
        """Backtrace: the pieces from start to the state `end`."""
        lengths: dict[int, int] = {}
        last = self.reach(text, start, first, end[1], lengths)
        out, i = [], end[1]
        assert i == start or last[i] == end[0]
        while i > start:
            out.append(last[i])
            i = lengths[i]
        return out[::-1]

    def pack(self, pieces: list[int]) -> bytes:
        """Little-endian 32-bit ids, with bytes for characters outside the vocabulary."""
        out: list[int] = []
        for p in pieces:
            out.extend([p] if p >= 0 else [self.byte[b] for b in chr(-1 - p).encode("utf-8", "surrogatepass")])
        return np.array(out, dtype="<i4").tobytes()

    def unit(self, unit: str) -> bytes:
        """Ids of a run of spaces and the word after it. No piece crosses its ends."""
        found = self.units.get(unit)
        if found is None:
            # Two characters that no piece holds side by side are never in one piece: the parts are encoded on their own.
            at = [i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in self.adjacent]
            if at:
                found = b"".join([self.unit(unit[i:j]) for i, j in zip([0, *at], [*at, len(unit)])])
                if len(self.units) < REMEMBERED_UNITS:
                    self.units[unit] = found
                return found
            n = len(unit)
            lengths: dict[int, int] = {}
            last = self.reach(unit, 0, None, n, lengths)
            out, i = [], n
            while i > 0:
                out.append(last[i])
                i = lengths[i]
            found = self.pack(out[::-1])
            if len(self.units) < REMEMBERED_UNITS:
                self.units[unit] = found
        return found

    def whole(self, text: str) -> bytes:
        """Ids of a text with spaces already written as U+2581: one chunk from the empty state to its end."""
        return b"".join([self.unit(u) for u in UNIT.findall(text) if u])

    # Chunks of giant texts: a chunk [a, b) comes with up to `longest` characters on either side.

    def states(self, text: str, cut: int) -> list[State]:
        """All states at a cut: pieces that start before it and end at it or later."""
        return [(p, e) for e in range(cut, min(len(text), cut + self.longest - 1) + 1) for p, j in self.ending(text, e, 0) if j < cut and self.alone(p)]

    def body(self, text: str, a: int, b: int) -> tuple[int, int]:
        """The first and last places in [a, b) where a run of spaces starts after a word: no piece crosses them. (b, b) if there is none."""
        first = next((i for i in range(max(a, 1), b) if text[i] == SPACE != text[i - 1]), None)
        if first is None:
            return b, b
        return first, next(i for i in range(b - 1, first - 1, -1) if text[i] == SPACE != text[i - 1])

    def matrix(self, text: str, a: int, b: int, starts: list[State] | None, ends: list[State] | None) -> np.ndarray:
        """Scores from the states at a (None: the text's start) to those at b (None: the text's end)."""
        rows = starts if starts is not None else [(None, a)]
        cols = ends if ends is not None else [(None, b)]
        out = np.full((len(rows), len(cols)), LOW, np.float32)
        first, last = self.body(text, a + self.longest, b)
        # What comes after the last place that no piece crosses is the same for all states that get there.
        tail = self.reach(text, last, None, max(e for _, e in cols), {}) if first < b else None
        for r, (p, at) in enumerate(rows):
            stop = first if tail is not None else max(e for _, e in cols)
            if at > stop:
                continue
            got = self.reach(text, at, p, stop, {})
            if tail is not None:
                if at != stop and stop not in got:
                    continue
                got = tail
            for c, (q, e) in enumerate(cols):
                if (got.get(e) == q if q is not None else e in got or e == at) or (q is not None and e == at and q == p):
                    out[r, c] = 0
        return out

    def backtrace(self, text: str, a: int, b: int, start: State | None, end: State | None) -> bytes:
        """Ids of the pieces after the state `start` up to the state `end`."""
        at, p = (start[1], start[0]) if start else (a, None)
        first, last = self.body(text, a + self.longest, b)
        if end is not None and end[1] == at and end[0] == p:
            return b""
        if not first < b:
            return self.pack(self.path(text, at, p, end)) if end else self.finish(text, at, p, b)
        return self.finish(text, at, p, first) + self.whole(text[first:last]) + (self.pack(self.path(text, last, None, end)) if end else self.finish(text, last, None, b))

    def finish(self, text: str, at: int, p: int | None, stop: int) -> bytes:
        if at == stop:
            return b""
        lengths: dict[int, int] = {}
        last = self.reach(text, at, p, stop, lengths)
        return self.pack(self.path(text, at, p, (last[stop], stop)))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that make no character become U+FFFD. The space put before every text goes."""
        raw = b"".join([self.raw[i] for i in ids.tolist()])
        out = raw.decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def spaced(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def prefix_scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """All prefix products, by doubling: log2(n) rounds of independent products."""
    out, step = list(matrices), 1
    while step < len(out):
        out = [times(out[i - step], x) if i >= step else x for i, x in enumerate(out)]
        step *= 2
    return out


def choose(matrices: list[np.ndarray]) -> list[int]:
    """The state at every cut: reached from the start, and leading to the end."""
    before = prefix_scan(matrices)
    out: list[int] = []
    at = 0
    for k in range(len(matrices) - 1, 0, -1):
        at = int((before[k - 1][0] + matrices[k][:, at]).argmax())
        out.append(at)
    return out[::-1]


def cut(text: str, chunk: int, margin: int) -> list[tuple[str, int, int, bool, bool]]:
    """Chunks with margins: (characters, start and end of the chunk in them, whether it is the first, the last)."""
    n = len(text)
    # A last chunk shorter than the margins joins the one before.
    places = [*range(0, max(1, n - 4 * margin), chunk), n]
    return [(text[max(0, a - margin) : b + margin], a - max(0, a - margin), b - max(0, a - margin), a == 0, b == n) for a, b in zip(places, places[1:])]


def encode_chunks(p: Pieces, text: str, chunk: int) -> bytes:
    """One text by chunks, all in one place: what the tables below do across tasks."""
    parts = cut(text, chunk, 2 * p.longest)
    edges = [(None if first else p.states(t, a), None if last else p.states(t, b)) for t, a, b, first, last in parts]
    at = choose([p.matrix(t, a, b, s, e) for (t, a, b, _, _), (s, e) in zip(parts, edges)])
    # States are relative to each chunk's own characters, in the same order on both sides of a cut.
    return b"".join(
        p.backtrace(t, a, b, s[at[k - 1]] if s is not None else None, e[at[k]] if e is not None else None) for k, ((t, a, b, _, _), (s, e)) in enumerate(zip(parts, edges))
    )


ENCODED = "doc_id long, n_chunks long, n_tokens long, ids_crc32 long, round_trip boolean, ids array<int>"


def result(rows: list[tuple]) -> pa.RecordBatch:
    """rows: (doc_id, n_chunks, packed ids, round trip)."""
    ids = np.frombuffer(b"".join([r[2] for r in rows]), dtype="<i4")
    sizes = np.array([len(r[2]) // 4 for r in rows], dtype=np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids, pa.int32()))
    return pa.record_batch(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(sizes), pa.array([zlib.crc32(r[2]) for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.bool_()), lists],
        names=["doc_id", "n_chunks", "n_tokens", "ids_crc32", "round_trip", "ids"],
    )


def encode_short(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                rows = []
                for d, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    packed = p.whole(spaced(text or ""))
                    rows.append((d, 1, packed, p.decode(np.frombuffer(packed, "<i4")) == (text or "").replace(SPACE, " ")))
                yield result(rows)

    return run


def cut_long(path: str, chunk: int):
    """Giant texts as chunk rows, each with its transfer matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for b in batches:
            for row, text in zip(b.column("row").to_pylist(), b.column("text").to_pylist(), strict=True):
                for k, (t, a, e, first, last) in enumerate(cut(spaced(text), chunk, 2 * p.longest)):
                    m = p.matrix(t, a, e, None if first else p.states(t, a), None if last else p.states(t, e))
                    values = [pa.array([x]) for x in (row, k, t, a, e, first, last, m.shape[0], m.tobytes())]
                    yield pa.record_batch(values, names=["row", "k", "text", "a", "e", "first", "last", "rows", "matrix"])

    return run


CHUNKS = "row long, k long, text string, a long, e long, first boolean, last boolean, rows long, matrix binary"


def choose_states(pdf):
    """One document's matrices in order: the states at each chunk's ends (-1: the text's own ends)."""
    pdf = pdf.sort_values("k")
    at = choose([np.frombuffer(m, np.float32).reshape(r, -1) for m, r in zip(pdf["matrix"], pdf["rows"], strict=True)])
    return pdf[["row", "k"]].assign(s=[-1, *at], t=[*at, -1])


def backtrace_chunks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for b in batches:
            out = []
            for row, k, t, a, e, s, u in zip(*(b.column(c).to_pylist() for c in ("row", "k", "text", "a", "e", "s", "t")), strict=True):
                ids = p.backtrace(t, a, e, p.states(t, a)[s] if s >= 0 else None, p.states(t, e)[u] if u >= 0 else None)
                out.append((row, k, ids))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["row", "k", "packed"])

    return run


def join_long(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for b in batches:
            for d, text, parts in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "parts")), strict=True):
                packed = b"".join(x["packed"] for x in sorted(parts, key=lambda x: x["k"]))
                yield result([(d, len(parts), packed, p.decode(np.frombuffer(packed, "<i4")) == text.replace(SPACE, " "))])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_chunks, n_tokens, ids_crc32 (of the ids as little-endian 32-bit numbers), round_trip (decoding gives the
    text back, U+2581 counting as a space) and ids of every document.

    Null and empty texts have no ids. Rows are encoded on their own, so null ids and repeated rows come back as they are.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "pieces")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = F.coalesce(F.char_length("text"), F.lit(0))
    short = rows.where(size <= chunk).mapInArrow(encode_short(path), ENCODED)
    long = tables.keep(rows.where(size > chunk).withColumn("row", F.monotonically_increasing_id()), "long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = tables.keep(long.select("row", "text").repartition(parts).mapInArrow(cut_long(path, chunk), CHUNKS), "chunks")
    states = chunks.select("row", "k", "rows", "matrix").groupBy("row").applyInPandas(choose_states, "row long, k long, s long, t long")
    traced = chunks.drop("matrix", "rows", "first", "last").join(tables.keep(states, "states"), ["row", "k"]).mapInArrow(backtrace_chunks(path), "row long, k long, packed binary")
    joined = tables.keep(traced, "traced").groupBy("row").agg(F.collect_list(F.struct("k", "packed")).alias("parts")).join(long, "row")
    return short.union(joined.select("doc_id", "text", "parts").mapInArrow(join_long(path), ENCODED))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of encoded rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for b in batches:
            texts = [p.decode(np.array(x, dtype=np.int64)) for x in b.column("ids").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_piece_scan(spark, sf_dir: str) -> DataFrame:
    """Ids of all documents, and whether decoding gives each back."""
    return encode(documents(spark, sf_dir), model_path())
