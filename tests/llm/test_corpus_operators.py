"""Alignment, substring dedup and resampling against plain Python, and their edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from fieldlens.llm import alignment, resampling, substrings
from fieldlens.session import ship_package
from tests.conftest import SF

_CHARS = [*" \n\t\r\x1c 　▁slt1٣½aéß漢か\U0001f600́İ.,!?<|>", "  ", " \n", "\n ", "'s", " the", " and", "<|endoftext|>", "<s>", "<0x41>", "\x00", " quality"]


def _edge(spark, more=()):
    ship_package(spark)
    rows = [(i, t, i, t) for i, t in enumerate(more)] + [(None, "no id here", 1, "x"), (None, None, 1, "x"), (5, "twice the same", 1, "x"), (5, "twice the same", 1, "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, part int, tie string")


def _mixed(n):
    rng = random.Random(3)
    return ["", None, "word " * 30000, "x" * 3000, *("".join(rng.choices(_CHARS, k=rng.randint(0, 60))) for _ in range(n))]


# alignment


def _plain_groups(aligner, text):
    """Groups and links of one text by walking its bytes, or None."""
    if not text:
        return None
    a = aligner.a.encode(" " + text, add_special_tokens=False).ids
    b = aligner.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(aligner.bytes_a[i] for i in a) != raw or b"".join(aligner.bytes_b[i] for i in b) != raw:
        return None
    of_a, of_b = ([k for k, i in enumerate(ids) for _ in table[i]] for ids, table in ((a, aligner.bytes_a), (b, aligner.bytes_b)))
    links = sorted(set(zip(of_a, of_b)))
    ends = sorted({k for k in range(1, len(raw) + 1) if (k == len(raw) or of_a[k] != of_a[k - 1]) and (k == len(raw) or of_b[k] != of_b[k - 1])})
    groups, start = [], 0
    for e in ends:
        groups.append((sorted(set(of_a[start:e])), sorted(set(of_b[start:e]))))
        start = e
    return a, b, links, groups


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(*(public_tokenizers.path(v) for v in (alignment.VOCABULARY_A, alignment.VOCABULARY_B)))


def test_alignment_matches_plain(spark, aligner):
    docs = _edge(spark, _mixed(500))
    paths = [public_tokenizers.path(v) for v in (alignment.VOCABULARY_A, alignment.VOCABULARY_B)]
    rows = docs.collect()
    plain = [_plain_groups(aligner, r.text) for r in rows]
    counts = Counter()
    for p in plain:
        counts.update({(p[0][i], p[1][j]) for i, j in p[2]} if p else ())
    best: dict = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    want = []
    for r, p in zip(rows, plain):
        if p is None:
            want.append((r.doc_id, 0, 0, 0, 0, 0, 0, "", None))
            continue
        a, b, links, groups = p
        text = ";".join(",".join(str(a[i]) for i in x) + "|" + ",".join(str(b[j]) for j in y) for x, y in groups)
        held = [counts[a[i], b[j]] for i, j in links]
        top = sum(counts[a[i], b[j]] == best[a[i]] for i, j in links)
        want.append((r.doc_id, len(a), len(b), len(groups), len(links), top, sum(held), hashlib.sha256(text.encode()).hexdigest(), text.encode()))
    got = [tuple(r) for r in alignment.aligned(docs, *paths, buckets=5).collect()]
    clean = lambda rs: sorted([(*r[:8], bytes(r[8]) if r[8] is not None else None) for r in rs], key=repr)
    assert clean(got) == clean(want)
    assert sum(p is None for p in plain) > 10  # texts that a tokenizer changes are among them
    assert {(r.a, r.b): r.n_docs for r in alignment.pair_counts(docs, *paths).collect()} == dict(counts)
    assert alignment.aligned(docs.where("false"), *paths).count() == 0


def test_merge_pieces_are_stitched():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a, b = (np.unique(np.append(rng.integers(1, n + 1, rng.integers(0, n + 1)), n)) for _ in range(2))
        bytes_a, bytes_b = np.searchsorted(a, np.arange(n), "right"), np.searchsorted(b, np.arange(n), "right")
        want = sorted(set(zip(bytes_a.tolist(), bytes_b.tolist())))
        for work in (1, 2, 3, 7, 1000):
            i, j = alignment.diagonals(a, b, work)
            assert (np.diff(i + j) <= work).all() and i[-1] == len(a) and j[-1] == len(b)
            at, of, closes = alignment.overlaps(a, b, work)
            assert list(zip(at.tolist(), of.tolist())) == want
            assert a[at[closes]].tolist() == np.intersect1d(a, b).tolist()
    assert all(len(x) == 0 for x in alignment.overlaps(np.zeros(0, "i8"), np.zeros(0, "i8")))


# substring dedup


def _plain_removal(rows, window):
    """rows: (id, text) in corpus order."""
    words = [(t or "").encode().split() for _, t in rows]
    seen, out = set(), []
    for w in words:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            if key in seen:
                gone[s:s + window] = [True] * window
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        spans = []
        for k, g in enumerate(gone):
            if g and (not k or not gone[k - 1]):
                spans.append([k, k + 1])
            elif g:
                spans[-1][1] = k + 1
        out.append((len(w), sum(gone), tuple(map(tuple, spans)), kept.decode()))
    return out


@pytest.mark.parametrize("part_bytes", [200, 10**7])
def test_substrings_match_plain(spark, part_bytes):
    rng = random.Random(8)
    shared = [[rng.choice("abcdefg") for _ in range(40)] for _ in range(4)]
    texts = []
    for _ in range(150):
        parts = [rng.choice([[rng.choice("abc") for _ in range(rng.randint(0, 12))], rng.choice(shared), rng.choice(shared)[rng.randint(0, 20):]]) for _ in range(rng.randint(0, 4))]
        texts.append(rng.choice([" ", "\n", "\t "]).join(w for p in parts for w in p))
    docs = _edge(spark, ["", None, "a " * 500, " 　 é x y", *texts])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for window in (5, 20):
        got = [(r.doc_id, (r.n_words, r.n_removed, tuple(map(tuple, r.removed)), r.kept_text)) for r in substrings.without_repeats(docs, window, part_bytes).collect()]
        # Rows of one id follow one another by text hash; here they share no window or are equal.
        order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        want = list(zip([r[0] for r in order], _plain_removal(order, window)))
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert substrings.without_repeats(docs.where("false")).count() == 0


def test_rolling_hash_equals_sum():
    words = np.random.default_rng(5).integers(0, 1 << 63, 50).astype("u8")
    base = substrings._BASES[0]
    back = pow(base, -1, 1 << 64)
    want = [sum(int(words[i + j]) * pow(back, j, 1 << 64) for j in range(7)) % (1 << 64) for i in range(44)]
    assert substrings.rolling_hashes(words, 7, base).tolist() == want
    assert len(substrings.rolling_hashes(words[:6], 7, base)) == 0


# resampling


def _plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if "0" <= c <= "9" or "a" <= c <= "z" or ord(c) >= 128 else " " for c in low).split(" ")


def _features(text, longest):
    words = [w for w in _plain_words(text) if w]
    return len(words), [" ".join(words[i:i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling_matches_plain(spark, longest):
    rng = random.Random(2)
    letters = ["alpha", "beta", "GAMMA", "x1", "é", "漢字", "a-b", "delta", "\x1f"]
    texts = [" ".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(300)]
    docs = _edge(spark, ["", None, "alpha " * 20000, *texts])
    target = spark.createDataFrame([(1, "alpha beta x1"), (2, None), (3, "é delta delta")], "item_id int, text string")
    n = 50
    bucket = lambda f: zlib.crc32(f.encode()) % n
    s, t = Counter(), Counter()
    for r in docs.collect():
        s.update(map(bucket, _features(r.text, longest)[1]))
    for r in target.collect():
        t.update(map(bucket, _features(r.text, longest)[1]))
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (t_s + n) / ((s[b] + 1.0) * (t_t + n)))) for b in range(n) for t_s, t_t in [(sum(s.values()), sum(t.values()))]]
    want = []
    for r in docs.collect():
        words, f = _features(r.text, longest)
        w = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16)
        want.append([r.doc_id, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    able = sorted((r for r in want if r[4] >= 10), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    k = 20 * len(able) // 100
    ranked = [(*r[:4], i + 1) for i, r in enumerate(able[:k])] + [(*r[:4], None) for r in able[k:] + [r for r in want if r[4] < 10]]
    got = [tuple(r) for r in resampling.resampled(docs, target, n, longest, 20, 10, 7).collect()]
    assert sorted(got, key=repr) == sorted(ranked, key=repr) and k > 10
    assert resampling.resampled(docs.where("false"), target).count() == 0
    assert {r.rank for r in resampling.resampled(docs, target.where("false"), n, 1, 0).collect()} == {None}


def test_kth_key_of_repeated_keys(spark):
    values = [random.Random(1).randint(0, 30) for _ in range(500)] + [7] * 400
    df = spark.createDataFrame([(v, v % 3) for v in values], "a bigint, b int")
    want = sorted((v, v % 3) for v in values)
    for k in (1, 2, 450, 899, 900):
        assert resampling.kth_key(df, ["a", "b"], k, pivots=3) == want[k - 1]
    assert resampling.kth_key(df, ["a", "b"], 901) is None


def test_resampling_plan_does_not_grow_with_partitions(spark):
    """halving steps over a quantile for each slice made a plan that took most of the driver's memory at 211 partitions."""
    docs = spark.createDataFrame([(i, f"word{i % 9} " * 30) for i in range(300)], "doc_id long, text string")
    target = spark.createDataFrame([("word1 word2",)], "text string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    sizes = {}
    try:
        for n in (8, 211):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out = resampling.resampled(docs, target)
            sizes[n] = len(out._jdf.queryExecution().analyzed().toJSON())
            assert sorted(r["rank"] for r in out.where("rank is not null").collect()) == list(range(1, 31))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sizes[211] < 1.2 * sizes[8] and sizes[211] < 100_000, sizes


def test_numbered_with_repeated_keys(spark):
    rows = [(i * 7 % 5, i % 3, i) for i in range(2000)] + [(2, 1, -1)] * 1500
    df = spark.createDataFrame(rows, "a int, b int, v long").repartition(7)
    got = sorted((r.no, r.a, r.b) for r in resampling.numbered(df, ["a", "b"], "no").collect())
    assert got == [(i + 1, a, b) for i, (a, b) in enumerate(sorted((r[0], r[1]) for r in rows))]


@pytest.mark.parametrize("name", ["op11_alignment", "op12_substring_dedup", "op13_resampling"])
def test_queries_cover_all_documents(spark, name):
    from fieldlens.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES[name](spark, SF)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())
