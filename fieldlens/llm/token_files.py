"""Token-id files: independent zstandard frames, a document index, and a trailing seek table with a checksum for each frame.

Layout of one file (all numbers little-endian):
  data frames    ids as unsigned 32-bit numbers; a frame holds whole documents up to ``frame_bytes``, or a part of one long document
  index frame    count u64, doc ids i64[count], validity u8[count] (0: the id is null), ids per document u64[count]
  seek table     a skippable frame of the public seekable format: for each frame before it compressed size u32, decompressed size
                 u32, low half of the content's XXH64 u32; then frame count u32, descriptor u8, magic u32
"""

from __future__ import annotations

import functools
import re
import struct
import uuid

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import xxhash
import zstandard
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlens.llm.packing import Ids
from fieldlens.llm.pieces import PieceCache, slices
from fieldlens.llm.store import documents, scratch_path, written

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
FRAME_BYTES = 1 << 18
FILE_BYTES = 1 << 26

# Fixed values of the public seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

# Fixed value: the vocabulary's own word pattern.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+").findall
#: Characters that normalisation only lower-cases, one by one; no string of a special token among them.
_PLAIN = re.compile("(?:(?!<[|])[\0-\u012f\u0131-\u024f])*").fullmatch


#: Outside of what can be lower-cased and cut at white space at once; the characters 28 to 31 are white space to ``str.split`` only.
_UNEVEN = re.compile("[^\0-\x1b\x20-\u012f\u0131-\u024f]").search
_RUN = 1000  # words that the library gets as one text


class WordIds(Ids):
    """Ids of a vocabulary that lower-cases and drops white space: a text is cut into the vocabulary's words, and each distinct word is encoded once.

    Texts with characters beyond ``_PLAIN`` and those that may hold the string of a special token are cut into pieces first; such pieces go to the
    library whole.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.parts, self.words = PieceCache(self._parts), PieceCache(self._words)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        cuts = [t.lower().split() if "<|" not in t and not _UNEVEN(t) else None for t in texts]
        of = self.words.whole(set().union(*(c for c in cuts if c))).__getitem__
        others = iter(super().encode([t for t, c in zip(texts, cuts) if c is None]))
        return [next(others) if c is None else b"".join(map(of, c)) for c in cuts]

    def _words(self, words: list[str]) -> list[bytes]:
        """Encodings of plain words between white space."""
        keys = [w if w.isalpha() else _WORDS(w) for w in words]
        of = self.parts.whole({k for k in keys if type(k) is str}.union(*(k for k in keys if type(k) is list)))
        return [of[k] if type(k) is str else b"".join([of[w] for w in k]) for k in keys]

    def _parts(self, words: list[str]):
        """Encodings by the library: a thousand plain words of letters as one text, whose ids are cut behind each that ends a word."""
        letters = [w for w in words if w.isalpha() and not _UNEVEN(w)]
        found = {}
        runs = [letters[at:at + _RUN] for at in range(0, len(letters), _RUN)]
        for run, e in zip(runs, self.tokenizer.encode_batch_fast(list(map(" ".join, runs)), add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            content = ids.tobytes()
            if len(stops) == len(run) and stops[-1] == len(content):
                found.update(zip(run, [content[i:j] for i, j in zip([0, *stops], stops)]))
        rest = [w for w in words if w not in found]
        found.update(zip(rest, self._single(rest)))
        return map(found.__getitem__, words)

    def _encode(self, pieces: list[str]):
        keys: list = [p.lstrip(" ") for p in pieces]
        single: set[str] = set()
        several: list[int] = []
        for i, p in enumerate(keys):
            if _PLAIN(p):
                keys[i] = p = p.lower()
                if not p.isalpha():
                    keys[i] = _WORDS(p)
                    several.append(i)
                    continue
            single.add(p)
        single.update(*(keys[i] for i in several))
        of = self.parts.whole(single)
        for i in several:
            keys[i] = of[keys[i][0]] if len(keys[i]) == 1 else b"".join([of[w] for w in keys[i]])
        return [k if type(k) is bytes else of[k] for k in keys]


@functools.cache
def _shared(path: str) -> WordIds:
    return WordIds(path)


class TokenFileWriter:
    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        self.out, self.frame_bytes = out, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.entries: list[tuple[int, int, int]] = []
        self.waiting: list[bytes] = []
        self.size = self.raw = 0
        self.doc_ids: list = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.size and self.size + len(ids) > self.frame_bytes:
            self._flush()
        view = memoryview(ids)
        while len(view) > self.frame_bytes:  # a long document fills frames of its own
            self._frame(bytes(view[:self.frame_bytes]))
            view = view[self.frame_bytes:]
        self.waiting.append(bytes(view))
        self.size += len(view)
        self.raw += len(ids)
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids) // 4)

    def _flush(self) -> None:
        if self.size:
            self._frame(b"".join(self.waiting))
        self.waiting, self.size = [], 0

    def _frame(self, content: bytes) -> None:
        packed = self.compressor.compress(content)
        self.out.write(packed)
        self.entries.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def close(self) -> None:
        self._flush()
        valid = np.array([d is not None for d in self.doc_ids], dtype="u1")
        ids = np.array([d or 0 for d in self.doc_ids], dtype="<i8")
        self._frame(struct.pack("<Q", len(ids)) + ids.tobytes() + valid.tobytes() + np.array(self.counts, dtype="<u8").tobytes())
        table = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), CHECKSUM_FLAG, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()


class TokenFileReader:
    """Random access: only frames that hold requested documents are read and decompressed; every checksum is verified."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        n, flag, magic = struct.unpack("<IBI", self._read(end - 9, 9))
        if magic != SEEK_MAGIC or not flag & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end")
        self.entries = np.frombuffer(self._read(end - 9 - 12 * n, 12 * n), dtype="<u4").reshape(n, 3).astype("i8")
        self.starts = np.concatenate([[0], np.cumsum(self.entries[:, 0])])
        self.raw_starts = np.concatenate([[0], np.cumsum(self.entries[:-1, 1])])
        index = self.frame(n - 1)
        count, = struct.unpack_from("<Q", index)
        self.doc_ids = np.frombuffer(index, "<i8", count, 8)
        self.valid = np.frombuffer(index, "u1", count, 8 + 8 * count).astype(bool)
        self.counts = np.frombuffer(index, "<u8", count, 8 + 9 * count).astype("i8")
        self.doc_starts = np.concatenate([[0], np.cumsum(self.counts)])
        self._held = (-1, b"")

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def frame(self, k: int) -> bytes:
        packed, raw, check = map(int, self.entries[k])
        content = zstandard.ZstdDecompressor().decompress(self._read(int(self.starts[k]), packed), max_output_size=raw)
        if len(content) != raw or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return content

    def ids(self, position: int) -> bytes:
        """Ids of the document at ``position`` of the index."""
        lo, hi = 4 * int(self.doc_starts[position]), 4 * int(self.doc_starts[position + 1])
        out = []
        k = int(np.searchsorted(self.raw_starts, lo, side="right")) - 1
        while lo < hi:
            if self._held[0] != k:
                self._held = (k, self.frame(k))
            base = int(self.raw_starts[k])
            part = self._held[1][lo - base:hi - base]
            out.append(part)
            lo += len(part)
            k += 1
        return b"".join(out)

    def positions(self, doc_ids) -> np.ndarray:
        """Places of the documents with these ids."""
        return np.flatnonzero(self.valid & np.isin(self.doc_ids, np.asarray(list(doc_ids), dtype="i8")))


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, frame_bytes: int = FRAME_BYTES,
                      file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode every whole text, append ``end_id``, and write files in ascending doc_id order below ``folder`` (a shared URI).

    Returns the manifest: task, part, file, docs, base (ids of all documents in earlier files), n_ids. Documents are ranged by
    (doc_id, text hash, row), so a repeated id is split over tasks as well. Each attempt of a task writes files of its own name
    and the manifest names those of the attempt that succeeded. Null ids come first and stay null; a null text is its end id
    alone; repeated rows are documents of their own; an empty table gives an empty manifest.
    """
    schema = "task int, part int, file string, docs bigint, n_ids bigint"
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        fs, base = FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        ids = _shared(path)
        task, part, writer, rows = TaskContext.get().partitionId(), 0, None, []
        stamp = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"

        def close():
            writer.close()
            rows.append((task, part, name, len(writer.counts), sum(writer.counts)))

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, some in slices(texts):
                for doc_id, got in zip(doc_ids[at:at + len(some)], ids.encode(some)):
                    if writer is None:
                        name = f"part-{task:06d}-{part:04d}-{stamp}.ids.zst"
                        writer = TokenFileWriter(fs.open_output_stream(f"{base}/{name}", compression=None), frame_bytes)
                    writer.add(doc_id, got + end)
                    if writer.raw >= file_bytes:
                        close()
                        writer, part = None, part + 1
        if writer is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(
            (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["task", "part", "file", "docs", "n_ids"])

    ranged = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = ranged.withColumn("__h", F.xxhash64("text")).withColumn("__row", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange("doc_id", "__h", "__row").sortWithinPartitions("doc_id", "__h", "__row")
    files = written(ranged.select("doc_id", "text").mapInArrow(run, schema), "manifest")
    # One number for each writing task: their count is the cluster's partition setting, not the data's size.
    totals = sorted(files.groupBy("task").agg(F.sum("n_ids").alias("n")).collect())
    bases, total = [], 0
    for task, n in totals:
        bases.append((task, total))
        total += n
    base = docs.sparkSession.createDataFrame(bases, "task int, task_base bigint")
    before = Window.partitionBy("task").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return (files.withColumn("__before", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).join(F.broadcast(base), "task")
            .select("task", "part", "file", "docs", (F.col("task_base") + F.col("__before")).alias("base"), "n_ids"))


def read_token_files(manifest: DataFrame, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of all documents, or of those asked for, read back from the files."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids binary"

    def run(batches):
        fs, root = FileSystem.from_uri(folder)
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(f"{root}/{name}") as source:
                    reader = TokenFileReader(source)
                    places = range(len(reader.counts)) if doc_ids is None else reader.positions(doc_ids)
                    rows, size = [], 0
                    for p in places:
                        got = reader.ids(int(p))
                        rows.append((int(reader.doc_ids[p]) if reader.valid[p] else None, first + int(reader.doc_starts[p]), len(got) // 4, got))
                        size += len(got)
                        if size > 1 << 23:
                            yield _batch(rows)
                            rows, size = [], 0
                    yield _batch(rows)

    # With a number of its own the exchange is not coalesced: adaptive execution takes these few short rows for one task's work.
    spread = manifest.select("file", "base").repartition(max(1, min(manifest.count(), 10_000)), "file")
    return spread.mapInArrow(run, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["doc_id", "start", "n_tokens", "ids"])


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    folder = folder if "://" in folder else "file://" + folder if folder.startswith("/") else folder.replace("file:/", "file:///", 1)
    manifest = write_token_files(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), folder)
    return read_token_files(manifest, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
