"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark; repeated windows merge into removal intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm.store import documents
from fieldlens.llm.words import WordHashes

WINDOW = 20
PART_BYTES = 8_000_000  # text of one part, about
SAMPLES = 32  # sampled keys for each part boundary; they balance parts and change no result
MOST_SAMPLES = 1_000_000
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd: invertible modulo 2**64


def _mixed(x: np.ndarray) -> np.ndarray:
    """Another hash of 64-bit hashes: two rounds of shift and odd factor."""
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ x >> np.uint64(29)) * np.uint64(0xA0761D6478BD642F)


def rolling_hashes(words: np.ndarray, window: int, base: int) -> np.ndarray:
    """Polynomial hash modulo 2**64 of every run of ``window`` word hashes, from one running sum (Rabin-Karp)."""
    n = len(words)
    if n < window:
        return np.zeros(0, "u8")
    power = np.full(n, base, "u8")
    back = np.full(n, pow(base, -1, 1 << 64), "u8")
    power[0] = back[0] = 1
    power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
    total = np.concatenate([np.zeros(1, "u8"), np.cumsum(words * back, dtype="u8")])
    return (total[window:] - total[:-window]) * power[:n - window + 1]


class Part:
    """Rows of one part in corpus order, and the hash and start of every window; words are held for one row at a time."""

    def __init__(self, rows: pa.Table, window: int, hashes: WordHashes):
        ids, ties, texts = (rows.column(c).to_pylist() for c in ("doc_id", "tie", "text"))
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.order = sorted(range(len(raw)), key=lambda i: (ids[i] is None, ids[i] or 0, ties[i], raw[i]))
        self.ids = [ids[i] for i in self.order]
        self.raw = [raw[i] for i in self.order]
        by_row = [hashes(r.split()) for r in self.raw]
        sizes = np.array([len(h) for h in by_row], "i8")
        self.ends = np.cumsum(sizes)
        flat = np.concatenate(by_row) if len(raw) else np.zeros(0, "u8")
        left = np.repeat(self.ends, sizes) - np.arange(len(flat))  # words from here to the end of the row
        self.starts = np.flatnonzero(left >= window)
        self.hash = rolling_hashes(flat, window, _BASES[0])[self.starts]
        self.other = _mixed(rolling_hashes(_mixed(flat), window, _BASES[1])[self.starts])

    def buckets(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows by (bucket, hash): bucket, hash, and the place in ``starts`` where each occurs first."""
        bucket = ((self.other >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype("i8")
        order = np.lexsort((self.hash, bucket))  # stable: equal windows stay in corpus order
        b, h = bucket[order], self.hash[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (b[1:] != b[:-1])
        return b[new], h[new], order[new]


def _keys(unnamed, ids, ties) -> np.ndarray:
    """(unnamed, id, tie) as bytes that sort alike."""
    out = np.empty((len(ids), 17), "u1")
    out[:, 0] = unnamed
    for at, v in ((1, ids), (9, ties)):
        out[:, at:at + 8] = (np.asarray(v, "i8").view("u8") ^ np.uint64(1 << 63)).astype(">u8").view("u1").reshape(-1, 8)
    return out.view("S17").ravel()


def _parted(docs: DataFrame, part_bytes: int) -> tuple[DataFrame, int]:
    """``docs`` with a column part, which rises with (doc_id, null last; text hash), and the number of parts.

    Bounds come from sampled keys, at most ``MOST_SAMPLES``; a part is a function of the row alone, so lost tasks give the same parts again.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size.bytes or 0) // part_bytes))
    parts = min(parts, MOST_SAMPLES // SAMPLES, max(size.n, 1))
    share = min(1.0, SAMPLES * parts / max(size.n, 1))
    key = rows.select(F.col("doc_id").isNull().cast("int").alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("id"), "tie")
    got = key.sample(share, seed=12).toPandas()
    drawn = np.sort(_keys(got.unnamed, got.id, got.tie))
    bounds = np.unique(drawn[np.arange(1, parts) * len(drawn) // parts]) if len(drawn) else drawn

    @F.pandas_udf("int")
    def part(unnamed: pd.Series, ids: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, _keys(unnamed, ids, ties), side="right").astype("i4"))

    at = part(F.col("doc_id").isNull().cast("int"), F.coalesce("doc_id", F.lit(0)), F.col("tie"))
    return rows.withColumn("part", at), parts


def without_repeats(docs: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept_text), one row for each row of ``docs``: words of repeated windows are taken out.

    A window is ``window`` consecutive words of one row; its words go if the same words also start earlier: in a row of smaller
    doc_id (null last), or earlier in the same row. Windows are judged on the input. ``removed`` lists maximal intervals of word
    numbers (from, until; from 0, end excluded); ``kept_text`` joins the other words by one space.

    Parts are ranges of documents. Each part sends the hash of every distinct window once, to the bucket of a second hash, so a
    passage in a third of all documents arrives once from each part; a bucket tells each part by one bit a window which of them an
    earlier part holds. Parts then hash their rows again, so places are never sent. Hashes have 64 bits beside the bucket:
    for n windows in b buckets about n * n / (b * 2**65) of them are taken for repeats wrongly.

    Null and empty texts have no words; rows of fewer words than a window stay whole; rows of equal id follow one another by text hash and
    text, so of fully equal rows the first is kept; other columns are not read; an empty table gives no rows.
    """
    rows, parts = _parted(docs, part_bytes)

    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket, h, _ = Part(table, window, WordHashes()).buckets(parts)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(h) else np.zeros(0, "i8")
        sent = [x.tobytes() for x in np.split(h, cuts[1:])] if len(h) else []
        return pa.table({"bucket": pa.array(bucket[cuts].astype("i4")), "part": pa.array([key[0].as_py()] * len(sent), pa.int32()), "hashes": pa.array(sent, pa.binary())})

    def judge(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        sent = [np.frombuffer(x, "u8") for x in table.column("hashes").to_pylist()]
        h = np.concatenate(sent)
        order = np.argsort(h, kind="stable")  # equal hashes: earliest part first
        later = np.zeros(len(h), bool)
        later[order[1:]] = h[order[1:]] == h[order[:-1]]
        bits = [np.packbits(x).tobytes() for x in np.split(later, np.cumsum([len(x) for x in sent])[:-1])]
        return pa.table({"part": table.column("part"), "bucket": table.column("bucket"), "later": pa.array(bits, pa.binary())})

    def take_out(table: pa.Table, told: pa.Table) -> pa.Table:
        part = Part(table, window, WordHashes())
        bucket, _, first = part.buckets(parts)
        repeated = np.ones(len(part.starts), bool)
        sizes = np.bincount(bucket, minlength=parts)
        told = told.sort_by("bucket")
        later = [np.unpackbits(np.frombuffer(x, "u1"), count=sizes[b])
                 for b, x in zip(told.column("bucket").to_pylist(), told.column("later").to_pylist())]
        repeated[first] = np.concatenate(later).astype(bool) if later else False
        change = np.zeros((part.ends[-1] if len(part.ends) else 0) + 1, "i8")
        change[part.starts[repeated]] += 1
        change[part.starts[repeated] + window] -= 1
        gone = np.cumsum(change)[:-1] > 0
        out: list[list] = [[] for _ in range(5)]
        for doc_id, raw, end in zip(part.ids, part.raw, part.ends):
            words = raw.split()
            here = gone[end - len(words):end]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], here.view("i1"), [0]])))
            kept = [w for w, g in zip(words, here.tolist()) if not g] if len(edges) else words
            for col, v in zip(out, (doc_id, len(words), int(here.sum()), edges.reshape(-1, 2).tolist(), b" ".join(kept).decode("utf-8", "surrogatepass"))):
                col.append(v)
        spans = [[{"from": a, "until": b} for a, b in s] for s in out[3]]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("from", pa.int64()), ("until", pa.int64())])), pa.string())
        return pa.table([pa.array(v, kind) for v, kind in zip((*out[:3], spans, out[4]), kinds)], names=["doc_id", "n_words", "n_removed", "removed", "kept_text"])

    sent = rows.groupBy("part").applyInArrow(send, "bucket int, part int, hashes binary")
    told = sent.groupBy("bucket").applyInArrow(judge, "part int, bucket int, later binary")
    schema = "doc_id bigint, n_words bigint, n_removed bigint, removed array<struct<from: bigint, until: bigint>>, kept_text string"
    return rows.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(take_out, schema)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH listed AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM listed),
windows AS (SELECT l.doc_id, s.pos, array_to_string(l.words[s.pos:s.pos + 19], ' ') AS run
            FROM listed l, LATERAL (SELECT unnest(range(1, len(l.words) - 18)) AS pos) s),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS k FROM windows) WHERE k > 1),
marked AS (SELECT p.doc_id, p.pos, p.word, count(l.pos) OVER (PARTITION BY p.doc_id ORDER BY p.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) > 0 AS gone
           FROM placed p LEFT JOIN later l ON p.doc_id = l.doc_id AND p.pos = l.pos),
summed AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS r, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(r, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN summed USING (doc_id)
"""
