"""Language-model scores from a weighted backoff automaton over smoothed bigrams."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm.factorisation import in_fold
from fieldlens.llm.store import documents
from fieldlens.llm.words import WordHashes, ascii_words

PRIOR = 100.0  # tokens that the unigram prior of a bigram context counts for
BLOCK_BYTES = 8 << 20  # text of one block of documents, and of one bucket of counts
END = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))  # no word holds a line feed
_MIX = np.uint64(0x9E3779B97F4A7C15)


def pack(a: np.ndarray) -> bytes:
    """An array as compressed byte planes: the high bytes of sorted numbers nearly vanish."""
    planes = np.ascontiguousarray(a.view("u1").reshape(len(a), a.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(b: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), "u1")
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def pair_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    k = (context ^ (context >> np.uint64(29))) * _MIX + word
    k ^= k >> np.uint64(32)
    return k * _MIX


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, "i8")
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


@dataclass
class Totals:
    """Training tokens, distinct tokens, and tokens met once and twice."""

    tokens: int
    distinct: int
    once: int
    twice: int

    def unigram(self, c: np.ndarray) -> np.ndarray:
        """Absolute discounting over the distinct tokens and one unknown token, which gets what was discounted. Sums to 1."""
        if not self.tokens:
            return np.ones(len(c))
        d = (self.once + 1) / (self.once + 2 * self.twice + 2)
        return np.where(c > 0, c - d, d * self.distinct) / self.tokens


class Automaton:
    """States are the empty context and every known word; arcs carry log10 weights.

    From state h, an arc for w weighs (c(hw) + m p(w)) / (c(h) + m). Without one, the failure arc weighs m / (c(h) + m) and leads to the
    empty context, whose arcs weigh p(w). Either way the next state is w. Both give the prior-smoothed bigram, which sums to 1.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, totals: Totals, prior: float):
        self.keys, self.counts, self.totals, self.prior = keys, counts, totals, prior

    def count(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), "i8")
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0)

    def traverse(self, tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the tokens and the log10 weights collected at each step, left to right; a text begins in the empty context."""
        c = self.count(tokens)
        p = self.totals.unigram(c)
        weight = np.log10(p)
        inner = np.ones(len(tokens), bool)
        inner[starts] = False
        at = np.flatnonzero(inner)  # steps that leave a word's state
        arcs, state = self.count(pair_keys(tokens[at - 1], tokens[at])), c[at - 1]
        taken = arcs > 0
        fail = math.log10(self.prior) - np.log10(state + self.prior)
        weight[at] = np.where(taken, np.log10((arcs + self.prior * p[at]) / (state + self.prior)), fail + weight[at])
        return c, weight


def _tokens(texts: list[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the texts one after another, each text closed by the end token, and where texts start."""
    parts, starts, n = [], [], 0
    for t in texts:
        h = hashes(ascii_words(t))
        starts.append(n)
        parts += [h, np.array([END])]
        n += len(h) + 1
    return (np.concatenate(parts) if parts else np.zeros(0, "u8")), np.array(starts, "i8")


def _bigrams(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    inner = np.ones(len(tokens), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    return pair_keys(tokens[at - 1], tokens[at])


def _block_counts(table: pa.Table, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """All one- and two-token keys of a block, with their counts in its training documents (0: only met elsewhere)."""
    keys, counts = [], []
    train = table["train"].to_numpy()
    texts = table["text"].to_pylist()
    for wanted in (True, False):
        tokens, starts = _tokens([t for t, ok in zip(texts, train) if ok == wanted], hashes)
        for k in (tokens, _bigrams(tokens, starts)):
            keys.append(k)
            counts.append(np.full(len(k), int(wanted), "u4"))
    keys, counts = summed(np.concatenate(keys), np.concatenate(counts))
    return keys, counts.astype("u4")


def _bucket_rows(keys: np.ndarray, buckets: int):
    """(bucket, slice) of ascending keys; the bucket is the key's place in the whole range."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else []
    for a, b in zip(cuts, [*cuts[1:], len(keys)]):
        yield int(bucket[a]), slice(a, b)


def training_totals(docs: DataFrame, buckets: int) -> Totals:
    """Counted over all training documents; one row of sums reaches the driver."""

    def count(batches):
        hashes, keys, counts = WordHashes(), np.zeros(0, "u8"), np.zeros(0, "i8")

        def out():
            rows = [(b, pack(keys[s]), pack(counts[s])) for b, s in _bucket_rows(keys, buckets)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))],
                                              names=["bucket", "keys", "counts"])

        for b in batches:
            for at in range(0, b.num_rows, 2000):
                tokens, _ = _tokens(b.column(0).slice(at, 2000).to_pylist(), hashes)
                keys, counts = summed(np.concatenate([keys, tokens]), np.concatenate([counts, np.ones(len(tokens), "i8")]))
                if len(keys) > 2_000_000:
                    yield out()
                    keys, counts = keys[:0], counts[:0]
        yield out()

    def total(table: pa.Table) -> pa.Table:
        keys = np.concatenate([unpack(x, "u8") for x in table["keys"].to_pylist()])
        counts = np.concatenate([unpack(x, "i8") for x in table["counts"].to_pylist()])
        _, c = summed(keys, counts)
        return pa.table({"n": [int(c.sum())], "v": [len(c)], "n1": [int((c == 1).sum())], "n2": [int((c == 2).sum())]})

    sums = docs.where("train").select("text").mapInArrow(count, "bucket int, keys binary, counts binary").groupBy("bucket").applyInArrow(
        total, "n bigint, v bigint, n1 bigint, n2 bigint")
    row = sums.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "n1", "n2"))).first()
    return Totals(*map(int, row))


def score_documents(docs: DataFrame, train, prior: float = PRIOR) -> DataFrame:
    """Rows (doc_id, n_tokens, n_known, train_tokens, base_score, score), one for each row of ``docs``; ``train`` marks training documents.

    Documents are dealt into blocks by row, so equal ids or texts spread. Each block sends its distinct keys with its own training counts
    to key buckets as compressed runs; a bucket adds them up and sends back to each block the counts that differ from what the block
    has itself. So every block receives exactly the part of the automaton that its texts can reach, and the model, which grows with
    the corpus, is never whole in one place. Tokens are told apart by 64-bit hashes.

    A null text counts as empty (its end token alone); a null id is scored and, having no fold, learned from; repeated rows are documents of their own; an
    empty table gives no rows; other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), train.alias("train"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long") + 8)).first()[0] or 0
    buckets = max(1, math.ceil(size / BLOCK_BYTES))
    totals = training_totals(texts, buckets)
    blocked = texts.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).cast("int"))

    def own(table: pa.Table) -> pa.Table:
        keys, counts = _block_counts(table, WordHashes())
        block = table["block"][0].as_py()
        rows = [(b, block, pack(keys[s]), pack(counts[s])) for b, s in _bucket_rows(keys, buckets)]
        return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                        names=["bucket", "block", "keys", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        runs = [(b, unpack(k, "u8"), unpack(c, "u4")) for b, k, c in zip(*(table[n].to_pylist() for n in ("block", "keys", "counts")))]
        keys, counts = summed(np.concatenate([r[1] for r in runs]), np.concatenate([r[2] for r in runs]).astype("i8"))
        out = []
        for block, k, c in runs:
            whole = counts[np.searchsorted(keys, k)]
            told = whole != c
            if told.any():
                out.append((block, pack(k[told]), pack(whole[told])))
        return pa.table([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int32(), pa.binary(), pa.binary()))],
                        names=["block", "keys", "counts"])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        hashes = WordHashes()
        keys, counts = _block_counts(left, hashes)
        counts = counts.astype("i8")
        for k, c in zip(right["keys"].to_pylist(), right["counts"].to_pylist()):
            counts[np.searchsorted(keys, unpack(k, "u8"))] = unpack(c, "i8")
        automaton = Automaton(keys, counts, totals, prior)
        out = [[], [], [], []]
        for at in range(0, left.num_rows, 500):
            tokens, starts = _tokens(left["text"].slice(at, 500).to_pylist(), hashes)
            c, weight = automaton.traverse(tokens, starts)
            base = np.log10((c + 1) / (totals.tokens + totals.distinct + 1))
            out[0].append(np.diff(np.append(starts, len(tokens))))
            out[1].append(np.add.reduceat((c > 0).astype("i8"), starts))
            out[2].append(np.add.reduceat(base, starts))
            out[3].append(np.add.reduceat(weight, starts))
        n, known, base, weight = (np.concatenate(o) for o in out)
        return pa.table({"doc_id": left["doc_id"], "n_tokens": n, "n_known": known, "base_score": base, "score": weight})

    blobs = "block int, keys binary, counts binary"
    model = blocked.groupBy("block").applyInArrow(own, f"bucket int, {blobs}").groupBy("bucket").applyInArrow(answer, blobs)
    scored = blocked.groupBy("block").cogroup(model.groupBy("block")).applyInArrow(
        score, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = in_fold(F.col("doc_id"), 7, 2)
    scored = score_documents(documents(spark, sf_dir), ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
