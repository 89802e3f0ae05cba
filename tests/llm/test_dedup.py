"""Near-duplicates and lines against brute force, with groups of copies, edge cases and hot groups."""

import os
import random

import pytest
from pyspark.sql import functions as F

from fieldlens.llm import components, lines, minhash, store
from fieldlens.llm.lines import dedup_lines, line_decisions
from fieldlens.llm.minhash import Shingler, near_duplicates
from fieldlens.session import ship_package


def _components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def _texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(words) for _ in range(rng.randint(30, 60))] for _ in range(4)]
    out = []
    for _ in range(n):
        t = list(rng.choice(bases))
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice(words) + rng.choice("xyz")
        out.append(" ".join(t).upper() if rng.random() < 0.1 else " ".join(t))
    return out


def _expected(rows, words, percent):
    shingle = Shingler(words)
    sets = {}
    for i, t in rows:
        sets.setdefault(i, set()).update(shingle(t).tolist())
    ids = list(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k]
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return _components(ids, links)


@pytest.mark.parametrize("long", [64, 4])
def test_near_duplicates_match_brute_force(spark, monkeypatch, long):
    """Four families of close variants, so that lists hold linked and unlinked members; with a low limit, blocks settle them."""
    ship_package(spark)
    monkeypatch.setattr(components, "LONG", long)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rows = list(enumerate(_texts(3, 120)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), words=3, percent=85).collect()
    want = _expected(rows, 3, 85)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len(set(want.values())) < len(want)


def test_near_duplicates_edge_cases(spark):
    ship_package(spark)
    rows = [(5, None, 1), (6, "", 2), (7, " \n\t", 3), (None, "one two", 4), (8, "One TWO", 5), (3, "one\ttwo", 6), (9, "one two", 7), (9, "one two", 7),
            (10, "x " * 30000, 8), (11, "x " * 30000 + "\n", 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, component_id int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (None, 1, None, True), (8, 1, 3, False), (3, 1, 3, True),
                          (9, 1, 3, False), (9, 1, 3, False), (10, 1, 10, True), (11, 1, 10, False)], key=str)
    assert near_duplicates(df.where("false")).collect() == []


def test_lines_match_brute_force(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(6, 25))) for _ in range(60)]
    docs = []
    for i in range(80):
        own = []
        for _ in range(rng.randint(1, 4)):
            t = rng.choice(lines)
            if rng.random() < 0.5:
                at = rng.randrange(len(t))
                t = t[:at] + rng.choice("xyz") + t[at + 1:]
            own.append(t)
        docs.append((i, "\n".join(own)))
    first, keep = [], {}
    for i, t in docs:
        for n, line in enumerate(t.split("\n")):
            s = {line[k:k + 5] for k in range(len(line) - 4)} or {line}
            first.append(((i, n), s))
    links = [(a, b) for k, (a, s) in enumerate(first) for b, r in first[:k] if len(s & r) >= 0.8 * len(s | r) - 1e-9]
    want = _components([p for p, _ in first], links)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = line_decisions(df).collect()
    assert {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no) for r in got} == want
    assert all(r.kept == (want[r.doc_id, r.line_no] == (r.doc_id, r.line_no)) for r in got)


def test_dedup_lines_texts(spark):
    long = "word " * 40000
    rows = [(1, "A first line of the text.\n\nShort", 1), (2, "A first line of the text.\nOwn words here", 2), (3, "Short", 3), (None, None, None), (4, "", 4),
            (5, "\n \n", 5), (6, long + "\nShort", 6), (6, long + "\nShort", 6), (None, "Own words here", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kept int")
    got = {(r.doc_id, r.text, r.kept) for r in dedup_lines(df).collect()}
    assert got == {(1, "A first line of the text.\n\nShort", 1), (2, "Own words here", 2), (None, None, None), (4, "", 4), (5, "\n \n", 5), (6, long, 6)}
    assert dedup_lines(df.where("false")).columns == ["doc_id", "text", "kept"]
    assert dedup_lines(df.where("false")).count() == 0


def _line_pairs(spark, pairs):
    """How many of the pairs of lines, each line a document of its own, stay apart."""
    rows = [(2 * i + s, t) for i, p in enumerate(pairs) for s, t in enumerate(p)]
    first = {r.doc_id: r.first_doc_id for r in line_decisions(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    return sum(first[2 * i] != first[2 * i + 1] for i in range(len(pairs)))


def test_long_lines_without_spaces_are_linked(spark):
    """Rows that differ only in a leading id, and rows that all begin alike: similarity 0.97 and 0.96."""
    rng = random.Random(11)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz/-_") for _ in range(n))
    tails = ["," + ",".join(number(5) for _ in range(50)) for _ in range(60)]
    assert _line_pairs(spark, [(number(8) + t, number(8) + t) for t in tails]) == 0
    urls = ["https://" + name(266) for _ in range(60)]
    assert _line_pairs(spark, [(u + name(5), u + name(5)) for u in urls]) == 0


def test_repeating_lines_of_unlike_lengths_are_linked(spark):
    assert _line_pairs(spark, [("-" * 120, "-" * 200), ("buy now " * 14, "buy now " * 25), ("-=" * 30, "-=" * 3000)]) == 0


def test_short_pairs_share_a_band_as_often_as_stated(spark):
    """16 of 20 shingles in common: 1 - (1 - 0.8^4)^12 = 0.9982 for independent coordinates."""
    rng = random.Random(13)
    text = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    bases = [text(20, "abcdefghijklmnopqrstuvwxyz") for _ in range(1000)]
    assert _line_pairs(spark, [(b + text(2, "ABCDE"), b + text(2, "VWXYZ")) for b in bases]) <= 8


def test_members_meet_when_two_rounds_have_the_same_leader(spark):
    """One list {x, y, z}; x leads both star rounds, only y and z are alike."""
    ids = spark.range(200).select("id", *[F.xxhash64(F.lit(step), F.col("id")).alias(f"h{step}") for step in (0, 1)]).collect()
    x = min(ids, key=lambda r: r.h0)
    y, z = [r.id for r in ids if r.h1 > x.h1 and r.id != x.id][:2]
    post = spark.createDataFrame([(i, 1) for i in (x.id, y, z)], "cid bigint, token bigint")
    alike = lambda pairs: pairs.where(F.col("a").isin(y, z) & F.col("b").isin(y, z))
    found, _ = components.linked_postings(post, alike, rounds=2)
    assert found is not None and [(r.a, r.b) for r in found.collect()] == [(min(y, z), max(y, z))]


@pytest.mark.parametrize("long", [64, 20])
def test_alike_lines_in_a_list_of_unlike_lines_are_linked(spark, monkeypatch, long):
    """A shared sentence and 16 own characters (similarity 0.72), each line with one copy at 0.90: pairs and blocks lose none."""
    monkeypatch.setattr(components, "LONG", long)
    monkeypatch.setattr(lines, "BLOCK", 16)
    rng = random.Random(17)
    own = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    sentence = "Terms of this notice hold for every reader of the page and all of its parts, see the annex for more, reference "
    pairs = []
    for _ in range(300):
        t = sentence + own(16)
        pairs.append((t, t[:-6] + own(6)))
    assert _line_pairs(spark, pairs) == 0


def test_links_of_long_lists_stay_when_the_last_pair_step_finds_none(spark):
    """One list of 70 with a linked pair that only blocks meet, one of 10 unlike members."""
    post = spark.createDataFrame([(i, 1) for i in range(70)] + [(i, 2) for i in range(100, 110)], "cid bigint, token bigint")
    none = lambda pairs: pairs.where("false")
    dense = lambda rows: rows.where("cid in (3, 5)").groupBy().agg(F.min("cid").alias("a"), F.max("cid").alias("b"))
    found, label = components.linked_postings(post, none, rounds=1, dense=dense)
    assert label is None and [(r.a, r.b) for r in found.collect()] == [(3, 5)]


def test_copies_in_a_long_list_are_linked_beside_short_lists(spark):
    """203 lines of one sentence and own characters, three of them copies at 0.90, beside twelve lines of another sentence and one near pair."""
    rng = random.Random(6)
    own = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    first = "Terms of this notice hold for every reader of the page and all of its parts, see the annex for more reference: "[:111]
    second = "Nothing written here binds the printer of the almanac nor any of the editors, whoever holds the pen in the end"
    base = [first + own(16) for _ in range(200)]
    texts = base + [t[:-6] + own(6) for t in base[:3]] + [second + own(16) for _ in range(12)] + ["a near pair of lines, number one of two", "a near pair of lines, number one of twO"]
    got = {r.doc_id: r.first_doc_id for r in line_decisions(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [got[200 + i] for i in range(3)] == [got[i] for i in range(3)] and got[216] == got[215]


def test_equal_coordinates(spark):
    rng = random.Random(3)
    rows = [[rng.randrange(16) for _ in range(96)] for _ in range(50)]
    rows += [r[:48] + r[:40] + r[88:] for r in rows]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    sketch = lambda c: [signed(sum(v << 4 * i for i, v in enumerate(c[k:k + 16]))) for k in (0, 16, 32)]
    df = spark.createDataFrame([(i, sketch(r[:48]), sketch(r[48:])) for i, r in enumerate(rows)], "id int, a array<bigint>, b array<bigint>")
    got = df.orderBy("id").select(lines._equal_coordinates(F.col("a"), F.col("b"), 48).alias("n")).collect()
    assert [r.n for r in got] == [sum(a == b for a, b in zip(r[:48], r[48:])) for r in rows]
    assert 20 < lines.least_equal(48, 0.8) < 28


def test_bounds_hold_for_every_linked_pair(spark):
    """Bits and coordinates never differ in more places than shingles do."""
    rng = random.Random(31)
    texts = []
    for n in (3, 5, 8, 20, 60, 200, 700):
        t = "".join(rng.choice("abcdefgh ") for _ in range(n)) + "."
        texts += [t, t[:-1] + "xy", t[: n // 2] + t[n // 2 + 1:], t + t[: n // 10], "-" * (n + 4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    near = lines._candidates(lines._occurrences(docs), lines.BANDS, lines.ROWS)
    rows = near.join(lines._wide_bits(near.select("cid", "line")), "cid").collect()
    sets = [{r.line[k:k + 5] for k in range(len(r.line) - 4)} or {r.line} for r in rows]
    differing = lambda a, b: sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a, b))
    nibbles = lambda s: [x >> 4 * i & 15 for x in s for i in range(16)]
    for r, a in zip(rows, sets):
        assert r.n >= len(a) and len(r.wide) == lines.WORDS and len(r.bits) == lines.BANDS
        for q, b in zip(rows, sets):
            d = len(a ^ b)
            assert differing(r.bits, q.bits) <= d and differing(r.wide, q.wide) <= d
            assert sum(x != y for x, y in zip(nibbles(r.sketch), nibbles(q.sketch))) <= d
    assert len(rows) > 20


@pytest.mark.parametrize("long", [64, 3])
def test_spent_tables_go_and_passes_lose_no_link(spark, monkeypatch, long):
    """Lists of three families are compared pair by pair or in blocks of several passes; of all written tables only links and components are left."""
    monkeypatch.setattr(components, "LONG", long)
    made = []

    def kept(df, name, **options):
        made.append((name, store.written(df, name, **options)))
        return made[-1][1]

    for module in (components, lines):
        monkeypatch.setattr(module, "written", kept)
    rng = random.Random(23)
    own = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    heads = [own(112) for _ in range(3)]
    texts = [h + own(16) for h in heads for _ in range(12)]
    texts += [t[:-6] + own(6) for t in texts[::5]]
    got = line_decisions(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    sets = [{t[k:k + 5] for k in range(len(t) - 4)} for t in texts]
    want = _components(range(len(texts)), [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    assert {r.doc_id: r.first_doc_id for r in got} == want
    there = {name for name, df in made if os.path.exists(df._fieldlens_path.removeprefix("file:"))}
    assert there <= {"links", "components", "near", "blocks", "dense", "leads"} and "signs" in {name for name, _ in made}


def test_unlike_lines_of_common_words_seldom_meet(spark, monkeypatch):
    """3,000 lines of 45 words out of 150: many common shingles, but no links; pairs of them must not grow with the square of the lines."""
    met = []

    def kept(df, name, **options):
        out = store.written(df, name, **options)
        if name == "pairs":
            met.append(out.count())
        return out

    for module in (components, lines):
        monkeypatch.setattr(module, "written", kept)
    rng = random.Random(41)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(150)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(45))) for i in range(3000)]
    got = line_decisions(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == 3000 and all(r.kept for r in got)
    assert sum(met) < 1000
