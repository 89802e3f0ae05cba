"""Packing by power-of-two decomposition: pieces of binary length, equal lengths in one bucket, one document per sequence."""

from __future__ import annotations

import functools
import os
import re
import struct

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm.pieces import PieceCache, slices
from fieldlens.llm.store import documents

VOCABULARY = "byte_bpe_50k.json"
_SLOTS = 36  # bits of a sequence's number inside its task and bucket; 4 bits of bucket stand above, then the task
_ROWS = 4096
#: Behind letters, the vocabulary's pattern never joins these to them.
_MARKS = ".,;:!?)\"\n\r#$%&*"
#: A later version of Unicode may know more letters than the library does.
_LATE = re.compile("[^\0-\u024f]").search
_RUN = 100  # words that the library gets as one text
_ID_BYTES = [struct.Struct(f"<{n}I").pack for n in range(32)]

PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, bucket int, sequence_id bigint, offset bigint"


class Ids:
    """Ids of whole texts as little-endian unsigned 32-bit bytes; the library encodes each distinct piece once per worker, words of letters many as one text.

    Strings of special tokens inside texts get the ids that the library gives them by default; none is added.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache, self.heads, self.rests = PieceCache(self._encode), PieceCache(self._runs), PieceCache(self._single)
        vocabulary = self.tokenizer.get_vocab()
        self.starts = np.zeros(max(vocabulary.values()) + 1, bool)
        self.starts[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True

    def _encode(self, pieces: list[str]):
        """Encodings of pieces: a space and letters apart from marks behind them, so that a word is encoded once whichever they are."""
        heads = [p.rstrip(_MARKS) for p in pieces]
        plain = [p[:1] == " " and h[1:].isalpha() and not _LATE(h) for p, h in zip(pieces, heads)]
        of = self.heads.whole({h for h, ok in zip(heads, plain) if ok})
        rest = self.rests.whole({p[len(h):] if ok else p for p, h, ok in zip(pieces, heads, plain)})
        return [rest[p] if not ok else of[h] if len(h) == len(p) else of[h] + rest[p[len(h):]] for p, h, ok in zip(pieces, heads, plain)]

    def _runs(self, words: list[str]) -> list[bytes]:
        """Encodings of words of a space and letters: a run of them as one text, whose ids are cut before each that begins with a space."""
        found = []
        runs = [words[at:at + _RUN] for at in range(0, len(words), _RUN)]
        for run, e in zip(runs, self.tokenizer.encode_batch_fast(list(map("".join, runs)), add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            cuts = (4 * np.flatnonzero(self.starts[ids])).tolist()
            content = ids.tobytes()
            one = len(cuts) == len(run) and cuts[0] == 0
            found += [content[i:j] for i, j in zip(cuts, [*cuts[1:], len(content)])] if one else self._single(run)
        return found

    def _single(self, pieces: list[str]):
        for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False):
            ids = e.ids
            yield _ID_BYTES[len(ids)](*ids) if len(ids) < 32 else np.array(ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        return [head + b"".join(tail) for head, tail in self.cache.lookup(texts)]


@functools.cache
def shared_ids(path: str) -> Ids:
    return Ids(path)


def binary_lengths(n: int, longest: int) -> list[int]:
    """``n`` as full lengths and then the binary digits of the rest, largest first."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack_documents(docs: DataFrame, path: str, longest: int = 1024, end_id: int = 0) -> DataFrame:
    """Cut every document (its ids, then ``end_id``) into pieces of power-of-two length; each piece is a whole sequence.

    ``longest`` is a power of two. ``bucket`` is log2 of the length: sequences of one bucket have equal lengths and need no padding, and
    none crosses documents. Map-only; sequence numbers count up inside each (task, bucket), so no row moves. A null or empty text is the end id alone;
    repeated rows and null ids are documents of their own; other columns are not read; an empty table gives no rows.
    """
    if longest & longest - 1 or not 0 < longest < 1 << 16:
        raise ValueError("longest must be a power of two below 65536")
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        ids = shared_ids(path)
        task = TaskContext.get().partitionId() << _SLOTS + 4
        used = [0] * 16
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, part in slices(texts):
                rows: list[list] = [[] for _ in range(7)]
                for doc_id, got in zip(doc_ids[at:at + len(part)], ids.encode(part)):
                    got += end
                    n, start = len(got) // 4, 0
                    for length in binary_lengths(n, longest):
                        bucket = length.bit_length() - 1
                        for col, v in zip(rows, (doc_id, start, length, got[4 * start:4 * (start + length)], n, bucket,
                                                 task | bucket << _SLOTS | used[bucket])):
                            col.append(v)
                        used[bucket] += 1
                        start += length
                for k in range(0, len(rows[0]), _ROWS):
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64())
                    cols = [pa.array(r[k:k + _ROWS], kind) for r, kind in zip(rows, kinds)]
                    cols.append(pa.array(np.zeros(len(cols[0]), dtype="int64")))
                    yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, PIECES)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Sequences as Parquet, one folder for each length."""
    pieces.write.partitionBy("bucket").parquet(path)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
