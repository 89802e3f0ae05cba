"""Byte-level BPE encoding and decoding with a sentencepiece model written straight from the vocabulary."""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from itertools import chain

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm.pieces import PieceCache, slices
from fieldlens.llm.store import documents

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@functools.cache
def byte_chars() -> list[str]:
    """One printable character for each byte: Latin-1 characters stand for themselves where printable, the rest follow U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        out.append(n & 127 | (128 if n > 127 else 0))
        n >>= 7
        if not n:
            return bytes(out)


def _field(number: int, value) -> bytes:
    """A protobuf field: bytes as length-delimited, float as 32 bits, int (negative: ten bytes) as varint."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model: byte-mapped pieces in rank order scored by negative rank, identity normalisation.

    Ranks must be 0..n-1. Piece ids equal ranks; the unknown piece, which no text reaches, comes last.
    """
    chars = byte_chars()
    table = dict(enumerate(chars))
    ordered = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in ordered] != list(range(len(ordered))):
        raise ValueError("ranks must be 0..n-1, each once")
    out = [_field(1, _field(1, t.decode("latin-1").translate(table).encode()) + _field(2, -float(i)) + _field(3, 1))
           for i, t in enumerate(ordered)]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(ordered) + 1) + b"".join(_field(n, v) for n, v in ((40, len(ordered)), (41, -1), (42, -1), (43, -1)))
    normalizer = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBpe:
    """Encoder and decoder of one vocabulary file; pieces are cached per worker."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        import sentencepiece

        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.ranks))
        self.find = regex.compile(pattern).findall
        self.table = dict(enumerate(byte_chars()))
        back = {c: b for b, c in enumerate(byte_chars())}
        self.bytes_of = [bytes(map(back.__getitem__, self.model.id_to_piece(i))) for i in range(len(self.ranks))]
        self.cache = PieceCache(self._pieces)

    def _pieces(self, pieces: list[str]):
        """(ids, decimal text) of each piece. A pre-token that is itself in the vocabulary is one id; others are merged."""
        found = [self.find(p) for p in pieces]
        todo = list(set(chain.from_iterable(found)))
        raw = [t.encode() for t in todo]
        whole = [self.ranks.get(r) for r in raw]
        merge = [i for i, w in enumerate(whole) if w is None]
        ids = [(w,) for w in whole]
        for i, got in zip(merge, self.model.encode([raw[i].decode("latin-1").translate(self.table) for i in merge], num_threads=1)):
            ids[i] = tuple(got)
        of = dict(zip(todo, ids))
        for f in found:
            all_ids = tuple(chain.from_iterable(map(of.__getitem__, f)))
            yield all_ids, ",".join(map(str, all_ids))

    def encode(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """Ids and their decimal text, joined by commas."""
        out = []
        for head, tail in self.cache.lookup(texts):
            parts = [head, *tail] if head[0] else tail
            out.append((list(chain.from_iterable([p[0] for p in parts])), ",".join([p[1] for p in parts])))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.cache
def _shared(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """Rows (doc_id, n_tokens, ids, ids_sha256, decoded_sha256): every whole text encoded, then decoded from its ids.

    Map-only. Null texts count as empty (no ids); each row stands for itself, so repeated rows and null ids stay; other columns
    are not read. ``keep_ids=False`` leaves the id array out.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")

    def run(batches):
        bpe = _shared(path)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            for at, part in slices(texts):
                ids, shas, backs = [], [], []
                for got, decimal in bpe.encode(part):
                    ids.append(got if keep_ids else len(got))
                    shas.append(hashlib.sha256(decimal.encode()).hexdigest())
                    backs.append(hashlib.sha256(bpe.decode(got)).hexdigest())
                cols = [doc_ids.slice(at, len(part)), pa.array([len(i) for i in ids] if keep_ids else ids, pa.int64()), pa.array(shas, pa.string()),
                        pa.array(backs, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), keep_ids=False)
