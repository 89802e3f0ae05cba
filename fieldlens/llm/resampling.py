"""Importance resampling towards a target distribution: weights from bucket arrays, drawn rows by distributed quickselect."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm.store import documents, written

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
PIVOTS = 16  # random pivot keys of one round; a round divides the keys in play by about this number

#: Bytes of words, A-Z in lower case; every other byte below 128 becomes a space.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def feature_words(text: str | None) -> list[bytes]:
    """UTF-8 words: runs of digits, ASCII letters (lower-cased) and all characters from U+0080."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class Buckets:
    """Buckets of all features of a text: runs of 1 to ``longest`` consecutive words, by the checksum of their bytes."""

    def __init__(self, n: int, longest: int, limit: int = 500_000):
        self.n, self.longest, self.limit, self.known = n, longest, limit, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        features = list(words)
        for k in range(2, self.longest + 1):
            features += [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)]
        if len(self.known) > self.limit:
            self.known.clear()
        known = self.known
        for f in set(features).difference(known):
            known[f] = zlib.crc32(f) % self.n
        return np.fromiter(map(known.__getitem__, features), "i8", len(features))


def bucket_counts(texts: DataFrame, n: int = BUCKETS, longest: int = 1) -> np.ndarray:
    """Features of all rows of ``texts`` (its column text) in each bucket. Each task sends at most ``n`` sums; the result has ``n`` numbers."""

    def run(batches):
        buckets, total = Buckets(n, longest), np.zeros(n, "i8")
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(buckets(feature_words(text.as_py())), minlength=n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    sums = texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(n, "i8")
    for r in sums.collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, both smoothed by one feature a bucket."""
    s, t, n = source.astype("f8"), target.astype("f8"), len(source)
    ratio = (t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n))
    return np.floor(1000 * np.log(ratio)).astype("i8")


def weighted(docs: DataFrame, gains: np.ndarray, longest: int = 1) -> DataFrame:
    """(doc_id, tie, n_words, n_features, weight) of every row; the weight is the floored mean gain of its features, 0 without any."""
    n = len(gains)

    def run(batches):
        buckets = Buckets(n, longest)
        for batch in batches:
            words, features, weights = [], [], []
            for text in batch.column(2):
                w = feature_words(text.as_py())
                got = gains[buckets(w)]
                words.append(len(w))
                features.append(len(got))
                weights.append(int(got.sum()) // len(got) if len(got) else 0)
            cols = [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in (words, features, weights))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "tie", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    return rows.mapInArrow(run, "doc_id bigint, tie bigint, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, floored, from the digest of seed and id; a null id counts as no characters."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def kth_key(df: DataFrame, key: list[str], k: int, pivots: int = PIVOTS, seed: int = SEED):
    """The k-th smallest composite key (from 1, repeated keys counted), as a row; None if there are fewer rows.

    Distributed quickselect: each round draws random pivot keys from the keys still in play, counts exactly how many of these keys are
    below and equal to each pivot in one aggregate, and keeps the part between two pivots that holds the k-th. Nothing is sorted, and
    only pivots and counts reach the driver. Components are compared in turn and must not be null.
    """
    kinds = dict(df.dtypes)
    at = F.struct(*key)
    literal = lambda row: F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(key, row)])
    low = high = None
    below, turn = 0, 0
    while True:
        turn += 1
        active = df.select(*key)
        if low is not None:
            active = active.where((F.col(key[0]) >= F.lit(low[0])) & (at > literal(low)))
        if high is not None:
            active = active.where((F.col(key[0]) <= F.lit(high[0])) & (at < literal(high)))
        drawn = active.orderBy(F.xxhash64(F.lit(seed), F.lit(turn), *key)).limit(pivots).collect()
        points = sorted({tuple(r) for r in drawn})
        if not points:
            return None
        counts = active.agg(*[F.count(F.when(at < literal(p), 1)) for p in points], *[F.count(F.when(at == literal(p), 1)) for p in points]).first()
        less, equal = counts[:len(points)], counts[len(points):]
        before = below
        for p, n, same in zip(points, less, equal):
            if k <= before + n:
                high = p
                break
            if k <= before + n + same:
                return p
            low, below = p, before + n + same


def numbered(df: DataFrame, key: list[str], out: str) -> DataFrame:
    """``df`` with 1-based row numbers in the order of ``key``, written once.

    Rows are ranged by key and row, so that fully equal keys are split over tasks as well, and sorted in their range; a row's number is its place there
    after the rows of earlier ranges. Of each range only its count reaches the driver. The plan stays small whatever the partition setting is.
    """
    order = [*key, "__row"]
    ranged = df.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    held = written(ranged.select(*df.columns, F.spark_partition_id().alias("__range"), place.alias("__place")), "numbered")
    before, total = [], 0
    for of, n in sorted(held.groupBy("__range").agg(F.count("*").alias("n")).collect()):
        before.append((of, total + 1))
        total += n
    first = df.sparkSession.createDataFrame(before, "__range int, __first bigint")
    return held.join(F.broadcast(first), "__range").select(*df.columns, (F.col("__first") + F.col("__place")).alias(out))


def resampled(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = 1, percent: int = PERCENT, least_words: int = LEAST_WORDS,
              seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; rank numbers the drawn rows from 1, best first, and is null for others.

    Of the N rows with at least ``least_words`` words, floor(percent * N / 100) rows of the highest score are drawn, ties to the smaller doc_id
    (null last), then to the smaller text hash; fully equal rows are told apart by their number only. Null and empty texts have no
    features and weight 0. Counts cover all rows of both tables (columns ``text``); other columns are not read. Empty tables are allowed: without
    documents there are no rows, without a target the target is uniform.
    """
    gains = bucket_gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    scored = weighted(docs, gains, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = written(scored.withColumns({"down": -F.col("score"), "unnamed": F.col("doc_id").isNull().cast("int"),
                                         "place": F.coalesce("doc_id", F.lit((1 << 63) - 1))}), "scored")
    able = F.col("n_words") >= least_words
    k = percent * scored.where(able).count() // 100
    result = ["doc_id", "n_features", "weight", "score"]
    unranked = scored.select(*result, F.lit(None).cast("long").alias("rank"))
    if not k:
        return unranked
    key = ["down", "unnamed", "place", "tie"]
    last = kth_key(scored.where(able), key, k)
    won = able & (F.struct(*key) <= F.struct(*[F.lit(v).cast(scored.schema[c].dataType).alias(c) for c, v in zip(key, last)]))
    ranked = numbered(scored.where(won).select(*result, *key), key, "rank")
    ranked = ranked.select(*result, F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))
    return ranked.unionByName(scored.where(~won).select(*result, F.lit(None).cast("long").alias("rank")))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The checksum is computed once for each distinct word, byte by byte, with its 256-entry table built by the rule of its polynomial.
SQL = r"""
WITH RECURSIVE steps AS (
  SELECT range AS byte, range::BIGINT AS v, 0 AS bit FROM range(256)
  UNION ALL
  SELECT byte, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END, bit + 1 FROM steps WHERE bit < 8),
crc AS (SELECT list(v ORDER BY byte) AS t FROM steps WHERE bit = 8),
lowered AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
target AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
held AS (SELECT doc_id, unnest(words) AS word FROM lowered),
every AS (SELECT DISTINCT word FROM (SELECT word FROM held UNION ALL SELECT word FROM target)),
hexed AS (SELECT word, hex(encode(word)) AS h FROM every),
hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h) + 1, 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM hexed, crc),
source_counts AS (SELECT bucket, count(*) AS s FROM held JOIN hashed USING (word) GROUP BY bucket),
target_counts AS (SELECT bucket, count(*) AS t FROM target JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM held)::DOUBLE AS ss, (SELECT count(*) FROM target)::DOUBLE AS tt),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (ss + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (tt + 10000))))::BIGINT AS gain
          FROM (SELECT DISTINCT bucket FROM hashed) LEFT JOIN source_counts USING (bucket) LEFT JOIN target_counts USING (bucket), totals),
sums AS (SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS w
         FROM held JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(w, 0)::BIGINT AS weight,
             (coalesce(w, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
           FROM documents d LEFT JOIN sums USING (doc_id)),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * able // 100 THEN rank END AS rank
FROM scored LEFT JOIN drawn USING (doc_id)
"""
