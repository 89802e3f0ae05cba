"""Cross-tokenizer alignment: token ends of two tokenizers merged along merge-path diagonals into links and common groups."""

from __future__ import annotations

import functools
import hashlib
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm.byte_bpe import byte_chars
from fieldlens.llm.pieces import PieceCache, cut, slices
from fieldlens.llm.store import documents, written

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
WORK = 16_384  # token ends of one piece of the merge
_PIECES = 250_000  # distinct text pieces of one cache generation


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Where diagonals at every ``work`` ends cross the merge path of ascending ``a`` and ``b``: how many of each lie before.

    All diagonals are searched at once by halving. Equal ends count as a's first.
    """
    n, m = len(a), len(b)
    d = np.append(np.arange(0, n + m, work), n + m)
    low, high = np.maximum(0, d - m), np.minimum(d, n)
    while (open_ := low < high).any():
        mid = (low + high) // 2
        at, of = np.minimum(mid, max(n - 1, 0)), np.clip(d - 1 - mid, 0, max(m - 1, 0))
        right = open_ & (a[at] <= b[of])
        low = np.where(right, mid + 1, low)
        high = np.where(open_ & ~right, mid, high)
    return low, d - low


def merge_piece(a: np.ndarray, b: np.ndarray, i: tuple[int, int], j: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Overlaps that end in one piece of the path, a's ends i[0]:i[1] with b's ends j[0]:j[1], in merge order.

    Token numbers of a and of b, whether both end there, and whether the piece opens with an end of b. Every merged end closes the
    stretch of one overlapping pair; where both end together the two ends close one.
    """
    own_a, own_b = a[i[0]:i[1]], b[j[0]:j[1]]
    b_of_a = j[0] + np.searchsorted(own_b, own_a, "left")
    a_of_b = i[0] + np.searchsorted(own_a, own_b, "right")
    both_a = np.searchsorted(own_b, own_a, "right") + j[0] > b_of_a
    alone = np.ones(len(own_b), bool)
    inside = a_of_b > i[0]
    alone[inside] = own_a[a_of_b[inside] - 1 - i[0]] != own_b[inside]
    rest = np.flatnonzero(alone)
    at = np.concatenate([np.arange(i[0], i[1]), a_of_b[rest]])
    of = np.concatenate([b_of_a, j[0] + rest])
    both = np.concatenate([both_a, np.zeros(len(rest), bool)])
    order = np.argsort(np.concatenate([own_a, own_b[rest]]), kind="stable")
    return at[order], of[order], both[order], bool(len(own_b)) and not inside[0]


def overlaps(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All overlapping pairs (number in a, number in b) of two tokenizations of the same bytes by their ends, and whether a group ends with the pair.

    Pieces of equal work are merged alone, then stitched: where a piece opens with the end of b that equals the last end of a before it,
    that pair is already there and closes a group.
    """
    i, j = diagonals(a, b, work)
    parts = []
    for k in range(len(i) - 1):
        at, of, both, opens = merge_piece(a, b, (i[k], i[k + 1]), (j[k], j[k + 1]))
        if opens and i[k] and a[i[k] - 1] == b[j[k]]:
            at, of, both = at[1:], of[1:], both[1:]
            for before in reversed(parts):
                if len(before[2]):
                    before[2][-1] = True
                    break
        parts.append((at, of, both))
    if not parts:
        return np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, bool)
    return tuple(np.concatenate(p) for p in zip(*parts))


class Aligner:
    """Both tokenizers, and the aligned tokens of distinct text pieces, kept per worker.

    Texts are cut before each space behind a character that is not white space. No pre-token of the byte-level pattern and no sentencepiece
    piece crosses such a cut, so tokens of both end there and no group crosses it: a text's alignment is that of its pieces in turn.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        back = {c: i for i, c in enumerate(byte_chars())}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            self.bytes_a[i] = bytes(map(back.__getitem__, token)) if all(c in back for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = [self._piece(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        crossing = [t for t in map(self.b.id_to_piece, range(self.b.get_piece_size())) if re.search(r"[^\s▁]▁", t)]
        if crossing:
            raise ValueError(f"pieces hold a space behind a character that is none: {crossing[:3]}")
        self.sizes_a, self.sizes_b = (np.array(list(map(len, t)), "i8") for t in (self.bytes_a, self.bytes_b))
        self.width, self.space = len(self.bytes_b), self.b.piece_to_id("▁")
        self.names = list(map(str, range(max(self.width, len(self.bytes_a)))))
        self.cache = PieceCache(self._align, _PIECES)

    @staticmethod
    def _piece(piece: str, is_byte: bool) -> bytes:
        return bytes([int(piece[3:5], 16)]) if is_byte else piece.replace("▁", " ").encode()

    def _align(self, pieces: list[str]):
        """Of each piece (with its space): (tokens of a, of b, groups, links, links as 64-bit a * width + b, groups as text), None where a tokenizer changes bytes."""
        a = [e.ids for e in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        b = self.b.encode([p[1:] for p in pieces], num_threads=1)
        b = [ids if p != " " else [self.space] for p, ids in zip(pieces, b)]  # the library gives an empty text no tokens
        good = []
        for k, (p, x, y) in enumerate(zip(pieces, a, b)):
            raw = p.encode()
            if b"".join(map(self.bytes_a.__getitem__, x)) == raw == b"".join(map(self.bytes_b.__getitem__, y)):
                good.append(k)
        na, nb = (np.array([len(t[k]) for k in good], "i8") for t in (a, b))
        ids_a, ids_b = (np.fromiter(chain.from_iterable(t[k] for k in good), "i8", n.sum()) for t, n in ((a, na), (b, nb)))
        at, of, closes = overlaps(np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b]))
        last_a, last_b = np.cumsum(na), np.cumsum(nb)
        ends = np.searchsorted(at, last_a)  # links of each piece end where its last token of a ends
        links = (ids_a[at] * self.width + ids_b[of]).tobytes()
        to_a, to_b = at[closes] + 1, of[closes] + 1  # tokens before the end of each group
        names_a, names_b = (list(map(self.names.__getitem__, ids.tolist())) for ids in (ids_a, ids_b))
        some = lambda names, i, j: names[i] if j - i == 1 else ",".join(names[i:j])
        groups = [f"{some(names_a, i, j)}|{some(names_b, p, q)}"
                  for i, j, p, q in zip([0, *to_a.tolist()], to_a.tolist(), [0, *to_b.tolist()], to_b.tolist())]
        out: list = [None] * len(pieces)
        start = first = 0
        for k, n, m, end, group in zip(good, na.tolist(), nb.tolist(), ends.tolist(), np.searchsorted(to_a, last_a, "right").tolist()):
            out[k] = (n, m, group - first, end - start, links[8 * start:8 * end], ";".join(groups[first:group]).encode())
            start, first = end, group
        return out

    def texts(self, texts: list[str]):
        """For a list of texts: per text counts (n_a, n_b, n_groups, n_links), its groups as text, and all links with the number of their text."""
        cuts = [([h[1:], *t] if h else t) if text else [] for text in texts for h, t in (cut(" " + text),)]
        distinct = set(chain.from_iterable(cuts))
        known = self.cache.of(distinct)
        number = dict(zip(distinct, range(len(distinct))))
        none = (0, 0, 0, 0, b"", b"")
        found = [known[p] for p in distinct]
        bad = np.array([g is None for g in found], bool)
        got = [g or none for g in found]
        blank = np.zeros(0, "i8")
        counts = np.array([g[:4] for g in got], "i8").reshape(-1, 4)
        flat = np.frombuffer(b"".join([g[4] for g in got]), "i8")
        groups = [g[5] for g in got]
        first = np.cumsum(counts[:, 3]) - counts[:, 3]
        totals, named, used = np.zeros((len(texts), 4), "i8"), [], []
        for k, c in enumerate(cuts):
            ids = np.fromiter(map(number.__getitem__, c), "i8", len(c))
            if not len(c) or bad[ids].any():
                used.append(blank)
                named.append(None)
                continue
            used.append(ids)
            totals[k] = counts[ids].sum(axis=0)
            named.append(b";".join(map(groups.__getitem__, ids.tolist())))
        ids = np.concatenate(used) if used else blank
        n = counts[ids, 3]
        place = np.repeat(first[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return totals, named, flat[place], np.repeat(np.arange(len(texts)), totals[:, 3])


@functools.cache
def _shared(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


_SLICES = ("slice bigint, bucket int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups binary, "
           "pairs binary, times binary")


def _slices_of(docs: DataFrame, path_a: str, path_b: str, buckets: int, keep_groups: bool) -> DataFrame:
    """Aligned documents by slice, and of each slice its distinct id pairs with the number of its documents that hold them linked.

    A document row (bucket null) lists its distinct pairs by their place in the slice's pair list, with how often each is linked; a pair row holds
    those of one bucket, the hash of a's id. Slices have at most about two million characters or one document.
    """
    names = [f.split()[0] for f in _SLICES.split(", ")]
    kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.binary(), pa.binary(), pa.binary())

    def run(batches):
        aligner = _shared(path_a, path_b)
        serial = TaskContext.get().partitionId() << 32
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, part in slices(texts):
                totals, named, links, of = aligner.texts(part)
                pairs, place = np.unique(links, return_inverse=True)
                bucket = _buckets(pairs // aligner.width, buckets)
                order = np.argsort(bucket, kind="stable")  # the slice's pair list: by bucket, then by code
                rank = np.empty(len(order), "i8")
                rank[order] = np.arange(len(order))
                held, times = np.unique(of * max(len(pairs), 1) + rank[place], return_counts=True)
                doc, pair = np.divmod(held, max(len(pairs), 1))
                edges = np.searchsorted(doc, np.arange(len(part) + 1))
                rows: list[list] = [[] for _ in names]
                for k, (n, text) in enumerate(zip(totals.tolist(), named)):
                    span = slice(edges[k], edges[k + 1])
                    sha = hashlib.sha256(text).hexdigest() if text is not None else ""
                    for col, v in zip(rows, (serial, None, doc_ids[at + k], *n, sha, text if keep_groups else None, pair[span].astype("<u4").tobytes(),
                                             times[span].astype("<u4").tobytes())):
                        col.append(v)
                share = np.bincount(pair, minlength=len(pairs))
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    span = slice(cuts[b], cuts[b + 1])
                    for col, v in zip(rows, (serial, b, *[None] * 7, pairs[order[span]].astype("<u8").tobytes(), share[span].astype("<u4").tobytes())):
                        col.append(v)
                serial += 1
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(rows, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, _SLICES)


def _buckets(ids: np.ndarray, n: int) -> np.ndarray:
    mixed = ids.astype("u8") * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype("i8")


def _counted(width: int):
    """Replies to the pair rows of one bucket: how many documents hold each pair, as a negative number unless it is the highest of its A id."""

    def run(table: pa.Table) -> pa.Table:
        sent = [np.frombuffer(x, "<u8") for x in table.column("pairs").to_pylist()]
        pairs, place = np.unique(np.concatenate(sent), return_inverse=True)
        counts = np.zeros(len(pairs), "i8")
        np.add.at(counts, place, np.frombuffer(b"".join(table.column("times").to_pylist()), "<u4"))
        ids = pairs // np.uint64(width)
        starts = np.flatnonzero(np.diff(ids.astype("i8"), prepend=-1))
        highest = np.repeat(np.maximum.reduceat(counts, starts), np.diff(np.append(starts, len(ids))))
        told = np.where(counts == highest, counts, -counts)[place]
        parts = np.split(told, np.cumsum([len(x) for x in sent])[:-1])
        return pa.table({"slice": table.column("slice"), "bucket": table.column("bucket"), "counts": pa.array([x.astype("<i8").tobytes() for x in parts], pa.binary())})

    return run


_ALIGNED = ("doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string, groups binary")


def _summed(table: pa.Table, told: pa.Table) -> pa.Table:
    told = told.sort_by("bucket")
    counts = np.frombuffer(b"".join(told.column("counts").to_pylist()), "<i8")
    best, total = [], []
    for pairs, times in zip(table.column("pairs").to_pylist(), table.column("times").to_pylist()):
        c, n = counts[np.frombuffer(pairs, "<u4")], np.frombuffer(times, "<u4").astype("i8")
        best.append(int(n[c > 0].sum()))
        total.append(int((n * np.abs(c)).sum()))
    names = [f.split()[0] for f in _ALIGNED.split(", ")]
    mine = {"n_best": pa.array(best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
    return pa.table([mine[c] if c in mine else table.column(c) for c in names], names=names)


def aligned(docs: DataFrame, path_a: str, path_b: str, buckets: int | None = None, keep_groups: bool = True) -> DataFrame:
    """Documents tokenized twice, by ``path_a`` (tokenizers, byte-level) over space and text and by ``path_b`` (sentencepiece) over the text, and aligned.

    One row for each row of ``docs``: doc_id, n_a, n_b, n_groups (stretches between byte offsets where tokens of both end), n_links
    (overlapping token pairs), n_best and count_sum by the corpus-wide document counts of id pairs, groups_sha256, and ``groups`` as text in UTF-8
    (``a1,a2|b1;a3|b2,b3``; null without ``keep_groups``). Special strings are plain text. Null and empty texts, and texts whose token bytes of either
    side differ from space and text, have no tokens: zeros, groups_sha256 '' and null groups; they count in no pair. Repeated rows and
    null ids are documents of their own; other columns are not read; an empty table gives no rows.

    Token ends are merged piece by piece of equal work; texts are encoded once. Aligned slices are written to the shared folder.
    Each slice sends its distinct id pairs once, by hash of the A id, so that one task sees all counts of an A id, at most one for each slice and B id;
    the replies go back to the slices. ``buckets`` defaults to the number of shuffle partitions.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    sliced = written(_slices_of(docs, path_a, path_b, buckets, keep_groups), "slices")
    sent = sliced.where("bucket is not null").select("slice", "bucket", "pairs", "times")
    told = sent.groupBy("bucket").applyInArrow(_counted(width), "slice bigint, bucket int, counts binary")
    own = sliced.where("bucket is null").drop("bucket")
    return own.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(_summed, _ALIGNED)


def pair_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(a, b, n_docs): how many documents hold each pair of an A id and a B id linked."""
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    sent = _slices_of(docs, path_a, path_b, 1, False).where("bucket is not null").select("pairs", "times")

    def unpack(batches):
        for batch in batches:
            for pairs, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = np.divmod(np.frombuffer(pairs, "<u8").astype("i8"), width)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.frombuffer(times, "<u4").astype("i8"))], names=["a", "b", "n"])

    return sent.mapInArrow(unpack, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n_docs"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (public_tokenizers.path(v) for v in (VOCABULARY_A, VOCABULARY_B))
    return aligned(documents(spark, sf_dir), *paths, keep_groups=False).drop("groups")
