"""Token ids as Arrow stream files of equal batches of fixed-size lists.

Tokens of the documents, each ended by an end id, follow one another in ascending doc_id order, packed into rows of
seq_len ids with a mask (0: padding at the end of a file). All record batches of a file have the same shape and no
nulls, so they have the same byte length: row i is found by arithmetic in a memory map and read without a copy.
Beside each file an index stream lists its documents (doc_id, start, n_tokens).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, documents

END_ID = 2
SEQ_LEN, BATCH_ROWS = 1024, 64
#: Distinct pieces of text whose ids a worker remembers; further ones are encoded each time.
REMEMBERED = 1_300_000

INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "part int, path string, n_docs long, n_tokens long"


def sequence_schema(seq_len: int, vocabulary: int = 1 << 16) -> pa.Schema:
    """ids: the narrowest unsigned type that holds the vocabulary; mask: a bit for each id."""
    ids = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
    return pa.schema([pa.field("ids", pa.list_(pa.field("item", ids, False), seq_len), False), pa.field("mask", pa.list_(pa.field("item", pa.bool_(), False), seq_len), False)])


def list_batch(ids: np.ndarray, mask: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    seq_len = schema.field("ids").type.list_size
    columns = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), schema.field(n).type.value_type), type=schema.field(n).type) for n, x in (("ids", ids), ("mask", mask))]
    assert ids.size % seq_len == 0
    return pa.record_batch(columns, schema=schema)


class PieceEncoder:
    """Ids of whole texts with the tokenizers library, remembering those of pieces between single spaces and newlines.

    A byte-level BPE splits texts before a space or newline that stands alone between two other characters, so ids of
    the pieces add up to those of the text. Other texts are cut at such spaces only. Texts that contain an added token
    (like <|endoftext|>) are encoded whole, as the library does by default: the token becomes its id.
    """

    CUT = re.compile(r"(?<=\S)(?= \S)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added else None
        self.vocabulary = max(self.tokenizer.get_vocab_size(), END_ID + 1)
        self.known: tuple[dict, dict] = ({}, {})  # at the start of a line, after a space
        self.newline = self.encode(["\n"])[0]
        self.marks = dict(zip(".,", self.encode([".", ","]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, lines: list[list[str]]) -> tuple[dict, dict]:
        """Tables that hold every piece of the lines; None for pieces that begin or end with white space, or are empty."""
        out = []
        for known, prefix, pieces in ((self.known[0], "", {p[0] for p in lines}), (self.known[1], " ", {w for p in lines for w in p[1:]})):
            new = sorted(w for w in pieces if w not in known)
            plain = [w for w in new if w and not w[0].isspace() and not w[-1].isspace()]
            # A letter and the mark after it never share a token, so a word's ids serve with and without the mark.
            marked = {w for w in plain if w[-1] in self.marks and w[-2:-1].isalpha()}
            bare = {w[:-1] for w in marked}
            todo = sorted((bare | {w for w in plain if w not in marked}) - known.keys())
            fresh = dict(zip(todo, self.encode([prefix + w for w in todo]), strict=True))
            found = dict.fromkeys(new) | fresh
            for w in marked:
                found[w] = (fresh[w[:-1]] if w[:-1] in fresh else known[w[:-1]]) + self.marks[w[-1]]
            if len(known) + len(found) <= REMEMBERED:
                known.update(found)
                out.append(known)
            else:
                out.append({w: known[w] if w in known else found[w] for w in pieces})  # the first ones seen stay
        return out[0], out[1]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        whole = [i for i, t in enumerate(texts) if self.added and self.added.search(t)]
        if whole:
            out = dict(zip(whole, self.encode([texts[i] for i in whole]), strict=True))
            others = iter(self.ids([t for i, t in enumerate(texts) if i not in out]))
            return [out[i] if i in out else next(others) for i in range(len(texts))]
        split = [[line.split(" ") for line in t.split("\n")] for t in texts]
        first, after = self.learn([p for t in split for p in t])
        out = []
        for text, lines in zip(texts, split, strict=True):
            parts = [b"".join([first[p[0]], *[after[w] for w in p[1:]]]) if self.plain(p, first, after) else None for p in lines]
            out.append(self.newline.join(parts) if None not in parts else b"".join(self.encode(self.CUT.split(text))) if text else b"")
        return out

    @staticmethod
    def plain(p: list[str], first: dict, after: dict) -> bool:
        return first[p[0]] is not None and None not in [after[w] for w in p[1:]]


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


class Writer:
    """One sequence file and its index. Memory: one batch of sequences."""

    def __init__(self, uri: str, seq_len: int, batch_rows: int, vocabulary: int):
        store, path = fs.FileSystem.from_uri(uri)
        self.schema, self.rows = sequence_schema(seq_len, vocabulary), batch_rows
        self.dtype = self.schema.field("ids").type.value_type.to_pandas_dtype()
        self.sinks = [store.open_output_stream(f"{path}.arrows"), store.open_output_stream(f"{path}.index.arrows")]
        self.out, self.index = ipc.new_stream(self.sinks[0], self.schema), ipc.new_stream(self.sinks[1], INDEX)
        self.full, self.pending, self.held, self.total = seq_len * batch_rows, [], 0, 0
        self.docs: list[tuple] = []
        self.n_docs = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        x = np.frombuffer(ids, dtype="<u4")
        self.docs.append((doc_id, self.total, len(x)))
        self.n_docs += 1
        self.total += len(x)
        self.pending.append(x)
        self.held += len(x)
        if self.held >= self.full:
            self.flush(False)
        if len(self.docs) >= 4096:
            self.flush_index()

    def flush(self, last: bool) -> None:
        x = np.concatenate(self.pending) if self.pending else np.zeros(0, "<u4")
        n = -(-len(x) // self.full) if last else len(x) // self.full
        for k in range(n):
            ids = x[k * self.full : (k + 1) * self.full]
            mask = np.zeros(self.full, bool)
            mask[: len(ids)] = True
            self.out.write_batch(list_batch(np.pad(ids, (0, self.full - len(ids))).astype(self.dtype), mask, self.schema))
        self.pending = [x[n * self.full :]]
        self.held = len(self.pending[0])

    def flush_index(self) -> None:
        self.index.write_batch(pa.record_batch([pa.array(c, t) for c, t in zip(zip(*self.docs, strict=True), INDEX.types, strict=True)], schema=INDEX))
        self.docs = []

    def close(self) -> None:
        self.flush(True)
        if self.docs:
            self.flush_index()
        for x in (self.out, self.index, *self.sinks):
            x.close()


class SequenceFile:
    """Zero-copy random access to the rows of one sequence file: file[i] gives views of ids and mask as Arrow arrays."""

    def __init__(self, uri: str):
        store, path = fs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if store.type_name == "local" else store.open_input_file(path)
        self.schema = ipc.read_schema(self.source)
        self.first = self.source.tell()
        size = self.source.size()
        self.n_batches, self.length, self.rows = 0, 0, 0
        if size - self.first > 8:  # the end mark alone takes 8 bytes
            batch = ipc.read_record_batch(ipc.read_message(self.source), self.schema)
            self.rows, self.length = batch.num_rows, self.source.tell() - self.first
            self.n_batches = (size - self.first) // self.length

    def __len__(self) -> int:
        return self.n_batches * self.rows

    def batch(self, k: int) -> pa.RecordBatch:
        self.source.seek(self.first + k * self.length)
        return ipc.read_record_batch(ipc.read_message(self.source), self.schema)

    def __getitem__(self, i: int) -> tuple[pa.Array, pa.Array]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        b = self.batch(i // self.rows)
        return tuple(b.column(c)[i % self.rows].values for c in (0, 1))


def write_tokens(docs: DataFrame, tokenizer: str, at: str, tables: Tables, seq_len: int = SEQ_LEN, batch_rows: int = BATCH_ROWS, end_id: int = END_ID) -> DataFrame:
    """Writes all documents to sequence files under the folder `at` and returns the manifest, a row for each file.

    Null and empty texts consist of the end id. Null ids come first; equal ids are ordered by the hash of their text.
    A file is named by task and attempt, and the manifest lists those of the attempts that counted.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, writer, uri = TaskContext.get(), None, ""
        code = encoder(tokenizer)
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                if writer is None:
                    uri = f"{at}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
                    store, path = fs.FileSystem.from_uri(at)
                    store.create_dir(path, recursive=True)
                    writer = Writer(uri, seq_len, batch_rows, code.vocabulary)
                texts = [t or "" for t in part.column("text").to_pylist()]
                for d, ids in zip(part.column("doc_id").to_pylist(), code.ids(texts), strict=True):
                    writer.add(d, ids + end)
        if writer is not None:
            writer.close()
            yield pa.record_batch([pa.array([task.partitionId()], pa.int32()), pa.array([uri]), pa.array([writer.n_docs]), pa.array([writer.total])], names=["part", "path", "n_docs", "n_tokens"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = rows.repartitionByRange(n, "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    out = tables.keep(ranged.mapInArrow(write, MANIFEST), "manifest")
    tables.tidy()
    return out


def read_tokens(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    files, base = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):  # a row for each file
        files.append((r["path"], base))
        base += r["n_tokens"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, base in zip(*(b.column(c).to_pylist() for c in ("path", "base")), strict=True):
                yield from read_file(uri, base)

    listed = spark.createDataFrame(files, "path string, base long").repartition(max(1, len(files)))
    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_file(uri: str, base: int) -> Iterator[pa.RecordBatch]:
    file = SequenceFile(f"{uri}.arrows")
    store, path = fs.FileSystem.from_uri(f"{uri}.index.arrows")
    held, at, k = np.zeros(0, "<u4"), 0, 0  # ids from place `at` on
    with store.open_input_stream(path) as source, ipc.open_stream(source) as index:
        for docs in index:
            starts, counts = docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist()
            sums = []
            for s, n in zip(starts, counts, strict=True):
                parts = [held]
                have = at + len(held)
                while have < s + n:
                    b = file.batch(k)
                    ids, mask = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in (0, 1))
                    parts.append(ids[mask].astype("<u4"))
                    have += len(parts[-1])
                    k += 1
                if len(parts) > 1:
                    held = np.concatenate(parts)
                sums.append(zlib.crc32(held[s - at : s - at + n].astype("<u4").tobytes()))
                if s + n - at > 1 << 16:
                    held, at = held[s + n - at :], s + n
            yield pa.record_batch([docs.column("doc_id"), pa.array([base + s for s in starts], pa.int64()), docs.column("n_tokens"), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op4_arrow_stream(spark, sf_dir: str) -> DataFrame:
    """All documents encoded, written, and read back."""
    import public_tokenizers

    tables = Tables(spark, "tokens")
    manifest = write_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), f"{tables.at}/sequences", tables)
    return read_tokens(manifest)
