"""MinHash near-dedup by a signature-coordinate inverted join."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlens.llm.components import connected_components, linked_postings
from fieldlens.llm.grid_join import Forest
from fieldlens.llm.store import documents, written
from fieldlens.llm.words import WordHashes, ascii_words

COORDINATES = 64
BLOCK = 512  # members of a long posting list in one block
MISS = 1e-6  # most likely share of linked pairs below the match threshold

_A = np.uint64(0x9E3779B97F4A7C15)
_SKETCH = "doc_id bigint, n_shingles bigint, cid bigint, signature array<int>"


def match_threshold(similarity: float, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """Largest number of equal coordinates that a pair at ``similarity`` reaches but for a chance of ``miss``."""
    below = 0.0
    for t in range(coordinates + 1):
        below += math.comb(coordinates, t) * similarity ** t * (1 - similarity) ** (coordinates - t)
        if below > miss:
            return t
    return coordinates


class Shingler:
    """Sorted distinct 64-bit hashes of the word shingles of a text; words are remembered per task up to a bound."""

    def __init__(self, words: int):
        self.words, self.hashes = words, WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        h = self.hashes(ascii_words(text))
        n = min(self.words, len(h))
        if not n:
            return h
        out = np.full(len(h) - n + 1, n, "u8")
        for i in range(n):
            out = out * _A + h[i:len(h) - n + 1 + i]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
        return np.unique(out)


class Signer:
    """Coordinate k: the least of the hashes under the k-th multiplication, as 32 bits."""

    def __init__(self, coordinates: int):
        rng = np.random.default_rng(20)
        self.mask = rng.integers(0, 1 << 63, coordinates, dtype="u8")
        self.factor = rng.integers(0, 1 << 63, coordinates, dtype="u8") * np.uint64(2) + np.uint64(1)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        least = np.full(len(self.mask), np.iinfo("u8").max, "u8")
        for at in range(0, len(h), 1024):
            np.minimum(least, (((h[at:at + 1024, None] ^ self.mask) * self.factor)).min(axis=0), out=least)
        return (least >> np.uint64(32)).astype("u4").view("i4")


def class_of(h: np.ndarray) -> int:
    """64-bit class of equal shingle sets."""
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketches(docs: DataFrame, words: int, coordinates: int = COORDINATES) -> DataFrame:
    """(doc_id, n_shingles, cid, signature) of every whole text; cid and signature are null without shingles."""

    def run(batches):
        shingle, sign = Shingler(words), Signer(coordinates)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                sets = [shingle(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array([class_of(h) if len(h) else None for h in sets], pa.int64()),
                     pa.array([sign(h) if len(h) else None for h in sets], pa.list_(pa.int32()))], names=["doc_id", "n_shingles", "cid", "signature"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SKETCH)


def postings(classes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """(cid, token): each class under its rarest coordinate values.

    A token is a coordinate and its value. Two classes that agree on ``matches`` tokens must share one of the first ``coordinates - matches + 1``
    tokens of either, in any common order; the order is by frequency. Tokens of one class only join nothing, and are the rarest:
    they use up the prefix without being posted, so a class with fewer than ``matches`` shared tokens posts nothing.
    """
    token = F.shiftleft(F.col("pos").cast("long"), 32) + F.col("col").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    tokens = classes.select("cid", F.posexplode("signature")).select("cid", token.alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    own = tokens.join(shared, "token").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    own = own.where(F.size("t") >= matches).select("cid", F.explode(F.slice("t", F.lit(1), F.size("t") - (matches - 1))).alias("t"))
    return own.select("cid", "t.token")


def _jaccard(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity; sets are sorted 64-bit hashes."""

    def run(batches):
        for b in batches:
            left, right = b.column(2).to_pylist(), b.column(3).to_pylist()
            keep = []
            for x, y in zip(left, right):
                p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(run, "a bigint, b bigint")


def block_links(members: DataFrame, matches: int, percent: int) -> DataFrame:
    """Links (a, b) that connect what all links inside a group of (group, cid, component, signature, set) connect.

    A group is dealt into blocks of about ``BLOCK`` members, and each pair of blocks is one task's table: collisions are counted as a
    matrix, and where pairs of different components reach ``matches``, intersections are products of 0/1 matrices over the shingles of
    the two blocks. Only a spanning forest leaves a table.
    """
    sizes = members.groupBy("group").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = members.join(sizes, "group").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    other = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = other.select("group", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "cid", "component",
                         "signature", "set")

    def tile(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        block, cid, component = (table[c].to_numpy() for c in ("block", "cid", "component"))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        signature = table["signature"].combine_chunks().flatten().to_numpy().reshape(len(cid), -1)
        same = np.zeros((len(left), len(right)), "u1")
        for k in range(signature.shape[1]):
            same += signature[left, k][:, None] == signature[right, k][None, :]
        wanted = (same >= matches) & (component[left][:, None] != component[right][None, :])
        forest = Forest(len(cid))
        rows, cols = np.flatnonzero(wanted.any(1)), np.flatnonzero(wanted.any(0))
        if len(rows):
            a, b = left[rows], right[cols]
            sets = [np.frombuffer(x, "<u8") for x in table["set"].to_pylist()]
            linked = wanted[np.ix_(rows, cols)] & similar([sets[x] for x in a], [sets[x] for x in b], percent)
            forest.link(a, b, linked)
        apart = np.flatnonzero(forest.root != np.arange(len(cid)))
        return pa.table({"a": cid[apart], "b": cid[forest.root[apart]]})

    return tiles.groupBy("group", "i", "j").applyInArrow(tile, "a bigint, b bigint")


def similar(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sorted sets reach the similarity, from intersections summed over runs of the common vocabulary."""
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    inter = np.zeros((len(left), len(right)), "f8")
    places = [[np.flatnonzero(np.isin(both, s, assume_unique=True)) for s in side] for side in (left, right)]
    for at in range(0, len(both), 4096):
        m = []
        for side in places:
            x = np.zeros((len(side), min(4096, len(both) - at)), "f4")
            for r, p in enumerate(side):
                x[r, p[np.searchsorted(p, at):np.searchsorted(p, at + 4096)] - at] = 1
            m.append(x)
        inter += m[0] @ m[1].T
    sizes = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :]
    return 100 * inter >= percent * (sizes - inter)


def links(docs: DataFrame, sketch: DataFrame, words: int, percent: int, coordinates: int = COORDINATES) -> DataFrame:
    """Links (rep_a, rep_b) between different shingle sets that connect exactly what all links at ``percent`` similarity connect.

    See ``linked_postings``. Collisions are counted on whole signatures before full sets are compared.
    """
    matches = match_threshold(percent / 100, coordinates)
    usable = sketch.where("doc_id is not null and cid is not null")
    classes = written(usable.groupBy("cid").agg(F.min("doc_id").alias("rep"), F.min("signature").alias("signature")), "classes")
    post = written(postings(classes, coordinates, matches), "postings")
    near = post.select("cid").distinct().join(classes, "cid")
    wanted = near.select(F.col("rep").alias("doc_id")).distinct()

    def sets(batches):
        shingle = Shingler(words)
        for b in batches:
            found = [shingle(t) for t in b.column(0).to_pylist()]
            found = [h for h in found if len(h)]
            yield pa.RecordBatch.from_arrays([pa.array([class_of(h) for h in found], pa.int64()), pa.array([h.tobytes() for h in found], pa.binary())],
                                             names=["cid", "set"])

    texts = docs.select(F.col("doc_id").cast("long"), "text").join(wanted, "doc_id", "left_semi").select("text").mapInArrow(sets, "cid bigint, set binary")
    full = written(texts.groupBy("cid").agg(F.min("set").alias("set")).join(near.select("cid", "signature"), "cid"), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        for s in ("a", "b"):
            pairs = pairs.join(full.select(F.col("cid").alias(s), F.col("signature").alias(f"sig_{s}")), s)
        same = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
        pairs = pairs.where(same >= matches).select("a", "b")
        for s in ("a", "b"):
            pairs = pairs.join(full.select(F.col("cid").alias(s), F.col("set").alias(f"set_{s}")), s)
        return _jaccard(pairs, percent)

    def dense(rows: DataFrame) -> DataFrame:
        stars = rows.withColumn("least", F.min("cid").over(Window.partitionBy("token"))).select("cid", "least").distinct()
        group = connected_components(stars, "cid", "least")
        group = group.unionByName(group.select(F.col("component_id").alias("node"), "component_id").distinct())
        members = rows.select("cid", "component").distinct().join(group, F.col("cid") == F.col("node"))
        return block_links(members.select(F.col("component_id").alias("group"), "cid", "component").join(full, "cid"), matches, percent)

    found, _ = linked_postings(post, verified, dense=dense)
    reps = classes.select("cid", "rep")
    if found is None:
        return reps.select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b")).where("false")
    return (found.join(reps.select(F.col("cid").alias("a"), F.col("rep").alias("rep_a")), "a")
            .join(reps.select(F.col("cid").alias("b"), F.col("rep").alias("rep_b")), "b").select("rep_a", "rep_b"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, coordinates: int = COORDINATES) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of ``docs``.

    Texts are lower-cased (A-Z), cut at ASCII white space and compared as sets of ``words``-word shingles (a shorter text is one shingle). Documents
    are linked at Jaccard similarity >= ``percent`` / 100, confirmed on full sets; component_id is the smallest id reachable. Equal sets
    are one class and join through its smallest id, so copies are never paired with each other.

    Null or empty texts have no shingles and link with nothing. A null id links with nothing and is kept with a null component. Rows
    that share an id are one document with the links of all of them. An empty table gives no rows; other columns are not read.
    """
    sketch = written(sketches(docs, words, coordinates), "sketches")
    usable = sketch.where("doc_id is not null and cid is not null")
    rep = usable.groupBy("cid").agg(F.min("doc_id").alias("rep"))
    copies = usable.join(rep, "cid").where("doc_id <> rep").select(F.col("doc_id").alias("rep_a"), F.col("rep").alias("rep_b"))
    label = connected_components(copies.unionByName(links(docs, sketch, words, percent, coordinates)), "rep_a", "rep_b")
    out = sketch.select("doc_id", "n_shingles").join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=3, percent=85)


SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),
    '[ \t-\r]+'), lambda x: x<>'') as ws from documents),
s as (select doc_id, list_distinct(case when len(ws)=0 then [] when len(ws)<3 then [array_to_string(ws,' ')]
    else [ws[i]||' '||ws[i+1]||' '||ws[i+2] for i in range(1, len(ws)-1)] end) as sh from w),
rows_ as (select doc_id, len(sh) as n, unnest(sh) as g from s),
both_ as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c
  from rows_ a join rows_ b on a.g=b.g and a.doc_id<>b.doc_id group by 1,2),
links as (select a, b from both_ where 100*c>=85*(na+nb-c)),
reach as (select doc_id as node, doc_id as other from documents union select reach.node, links.b from reach join links on reach.other=links.a)
select s.doc_id, len(sh) as n_shingles, m as component_id, s.doc_id=m as kept
from s join (select node, min(other) as m from reach group by node) r on r.node=s.doc_id
"""
