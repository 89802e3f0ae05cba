"""Tokenising, packing, token files, vectors, classifiers, language model: brute force, round trips, held-out accuracy, edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldlens.llm import byte_bpe, grid_join, language_model, nearest, packing, quality, token_files, toxicity
from fieldlens.llm.factorisation import Machine
from fieldlens.llm.store import scratch_path
from fieldlens.session import ship_package
from tests.conftest import SF

_PIECES = [*" \n\t\r\x1c 　slt1٣½aéß漢か\U0001f600́İ.,!?<|>", "  ", " \n", "\n ", "'s", "'ll", " the", "<|endoftext|>", "<|startoftext|>"]


def _fuzz(n=400):
    rng = random.Random(1)
    return ["", None, "long text " * 20000, *("".join(rng.choices(_PIECES, k=rng.randint(0, 50))) for _ in range(n))]


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    rows = [(i, t, i) for i, t in enumerate(_fuzz())] + [(None, "no id", 1), (1, "twice", 1), (1, "twice", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids int")


def test_byte_bpe_matches_library(docs):
    path = public_tokenizers.path(byte_bpe.VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    key = lambda r: str(r)
    want = []
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = [tuple(r) for r in byte_bpe.encode_documents(docs, path, keep_ids=False).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert byte_bpe.encode_documents(docs.where("false"), path).count() == 0


def _library_ids(name, text, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_packing_covers_each_id_once(docs):
    few = docs.where("doc_id is not null and doc_id <> 1 and doc_id < 80")
    got = packing.pack_documents(few, public_tokenizers.path(packing.VOCABULARY)).collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 and r.length == 1 << r.bucket <= 1024 for r in got)
    for r in few.collect():
        own = sorted((p for p in got if p.doc_id == r.doc_id), key=lambda p: p.start)
        want = _library_ids(packing.VOCABULARY, r.text, 0)
        assert b"".join(bytes(p.ids) for p in own) == want.tobytes() and {p.doc_tokens for p in own} == {len(want)}
        assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1].tolist()]


def test_token_files_round_trip(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/files"
    manifest = token_files.write_token_files(docs, public_tokenizers.path(token_files.VOCABULARY), folder, frame_bytes=4096, file_bytes=20000)
    rows = token_files.read_token_files(manifest, folder).collect()
    assert len(rows) == docs.count()
    rows.sort(key=lambda r: r.start)
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    known = [r.doc_id for r in rows if r.doc_id is not None]
    assert known == sorted(known) and [r.doc_id for r in rows].count(1) == 3
    texts = {r.doc_id: r.text for r in docs.where("doc_id < 60 and doc_id <> 1").collect()}
    for r in token_files.read_token_files(manifest, folder, list(texts)).collect():
        assert bytes(r.ids) == _library_ids(token_files.VOCABULARY, texts[r.doc_id], 2).tobytes()
    name = manifest.first().file
    raw = bytearray((tmp_path / "files" / name).read_bytes())
    raw[20] ^= 255
    (tmp_path / "files" / name).write_bytes(raw)
    with pytest.raises(Exception):
        token_files.read_token_files(manifest, folder).collect()


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, score int")


ODD = [(900, None, 1, 0), (901, [0.0] * 8, 1, 0), (902, [1.0, None] + [0.0] * 6, 1, 0), (903, [float("nan")] + [1.0] * 7, 1, 0), (904, [float("inf")] * 8, 1, 0),
       (None, [1.0] * 8, 1, 0), (905, [1.0] * 3, 1, 0), (906, [], 1, 0)]


def test_nearest_matches_brute_force(spark):
    ship_package(spark)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8)).astype("f4")
    x[50:120] = x[40]  # many ties
    rows = [(i, v.tolist(), 1, 0) for i, v in enumerate(x)]
    got = nearest.nearest(_vectors(spark, rows + rows[:30] + ODD), F.col("vec_id") % 20 == 0, k=7, query_rows=6, candidate_rows=64).collect()
    for q in range(0, 300, 20):
        score = np.zeros(300)
        for d in range(8):
            score += x[q, d].astype("f8") * x[:, d].astype("f8")
        want = sorted(((-s, i) for i, s in enumerate(score.tolist()) if i != q))[:7]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(i, -s) for s, i in want]
    assert nearest.nearest(_vectors(spark, ODD[:1]), F.col("vec_id") % 20 == 0).count() == 0


def test_grid_join_matches_brute_force(spark):
    ship_package(spark)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    x = (centres[rng.integers(0, 6, 300)] + rng.normal(size=(300, 8)) * 0.25).astype("f4")
    label = [int(v) if v < 3 else None for v in rng.integers(0, 4, 300)]
    rows = [(i, v.tolist(), l, 0) for i, (v, l) in enumerate(zip(x, label))]
    got = {r.vec_id: r for r in grid_join.near_vectors(_vectors(spark, rows + rows[:9] + ODD), interval=40).collect()}
    u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1)[:, None]
    link = [[j for j in range(300) if j != i and label[i] is not None and label[i] == label[j] and u[i] @ u[j] >= 0.93] for i in range(300)]
    for i in range(300):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(link[i]), min(seen), min(seen) == i)
    assert all(got[i].n_links == 0 and got[i].kept for i in (None, 900, 901, 902, 903, 904, 905, 906)) and len(got) == 308


def test_language_model_matches_brute_force(spark):
    ship_package(spark)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["A", "b", "cÉ", "d", "rare%d" % rng.randint(0, 40)]) for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, "", "x " * 5000]
    df = spark.createDataFrame([(i, t, i % 3 != 0) for i, t in enumerate(texts)] + [(None, "A b", True)], "doc_id bigint, text string, t boolean")
    got = language_model.score_documents(df, F.col("t")).collect()
    low = str.maketrans({c: c + 32 for c in range(65, 91)})
    tokens = [(i, (t or "").translate(low).split() + [None], i is None or i % 3 != 0) for i, t in [*enumerate(texts), (None, "A b")]]
    c, pair = Counter(), Counter()
    for _, t, train in tokens:
        if train:
            c.update(t)
            pair.update(zip(t, t[1:]))
    n, v = sum(c.values()), len(c)
    once, twice = (sum(x == k for x in c.values()) for k in (1, 2))
    d = (once + 1) / (once + 2 * twice + 2)
    p = lambda w: (c[w] - d) / n if c[w] else d * v / n
    assert abs(sum(p(w) for w in [*c, "unknown"]) - 1) < 1e-12
    want = {i: (len(t), sum(c[w] > 0 for w in t), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t),
                math.log10(p(t[0])) + sum(math.log10((pair[a, b] + 100 * p(b)) / (c[a] + 100)) for a, b in zip(t, t[1:]))) for i, t, _ in tokens}
    assert len(got) == len(want)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == (*want[r.doc_id][:2], n)
        assert r.base_score == pytest.approx(want[r.doc_id][2]) and r.score == pytest.approx(want[r.doc_id][3])
    assert language_model.score_documents(df.where("false"), F.col("t")).count() == 0


def test_machine_equals_pairwise_sum():
    rng = np.random.default_rng(3)
    m = Machine(0.3, rng.normal(size=9).astype("f4"), rng.normal(size=(9, 4)).astype("f4"))
    slots, x = np.array([1, 4, 7]), np.array([0.5, 2.0, -1.0], "f4")
    pairs = sum(m.factors[a] @ m.factors[b] * u * v for i, (a, u) in enumerate(zip(slots, x)) for b, v in list(zip(slots, x))[:i])
    assert m.logits(slots, x, np.array([0]))[0] == pytest.approx(0.3 + (m.weights[slots] * x).sum() + pairs, rel=1e-4)


def _labelled(spark, make):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        t = [rng.choice(words) for _ in range(40)]
        y = i % 3 == 0
        rows.append((i, make(t, y, rng), 200, 1))
        labels.append((i, int(y), int(y)))
    rows += [(5000, None, None, 1), (None, "", 3, 1), (7, "again", None, 1)]
    return (spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, score int"),
            spark.createDataFrame([*labels, (None, 1, 1), (5000, None, None)], "doc_id bigint, quality int, toxic int"))


@pytest.mark.parametrize("module,make", [
    (quality, lambda t, y, rng: " ".join(t) if y else " ".join(w + "***" for w in t)),
    # Either word alone is harmless; together they are not: linear weights can't tell.
    (toxicity, lambda t, y, rng: " ".join(t + (["insult", "group"] if y else [rng.choice(["insult", "group"])]))),
])
def test_classifiers_on_held_out_rows(spark, module, make):
    ship_package(spark)
    df, labels = _labelled(spark, make)
    fit, score, folds, fold = (module.fit_quality, module.with_quality, 5, 0) if module is quality else (module.fit_toxicity, module.with_toxicity, 3, 1)
    got = score(df, fit(df, labels)).collect()
    assert len(got) == 903 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900 and r.text != "again" and zlib.crc32(str(r.doc_id).encode()) % folds == fold]
    assert sum((r.score >= module.THRESHOLD) == (r.doc_id % 3 == 0) for r in held) >= 0.95 * len(held)
    none = score(df, fit(df, labels.where("false"))).collect()
    assert len({r.score for r in none}) == 1


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    out = p.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert out.count() > 0 and {r[0] for r in out.select("doc_id").distinct().collect()} <= {r[0] for r in docs.select("doc_id").collect()}
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    kept = p.minhash(spark, docs, SF)
    from fieldlens.llm.minhash import near_duplicates

    assert kept.count() == near_duplicates(docs).where("kept").count()


def test_queries_match_sql(spark):
    from check import compare, connect
    from fieldlens.llm.queries import QUERIES, SQL

    con = connect(SF)
    for name in SQL:
        assert compare(QUERIES[name](spark, SF), con, SQL[name]) is None, name
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_word_ids_equal_library_on_odd_pieces():
    """Words, contractions, digits, signs, special strings and characters that normalisation changes, in any order."""
    ids = token_files.WordIds(public_tokenizers.path(token_files.VOCABULARY))
    parts = ["'s", "'T", "'", "''", "!", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "<|", "|>", " ", "  ", "\n", "\t", "\x1c", "\x0b", "\x00", "\x7f", "\x85", "\xa0",
             "é", "É", "é", "İ", "ß", "Σ", "中", "²", "a", "Ab", "DON'T", "42", "_", "-", "'re", "'LL", ""]
    rng = random.Random(1)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(5000)]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in ids.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert ids.encode(texts) == want


def test_remembered_words_stay_within_their_bound():
    from fieldlens.llm import factorisation, quality, toxicity

    features = [quality.Features(np.zeros(quality.SIZE, bool)), toxicity.Features(np.zeros(toxicity.SIZE, bool))]
    for at in range(0, 400_000, 1000):
        for f in features:
            f(" ".join(f"w{i}" for i in range(at, at + 1000)), None)
    most = factorisation.KEPT + 1000
    assert len(features[0].words) <= most and len(features[0].counts) <= most and len(features[1].terms) <= most


def test_sample_is_written_and_read_in_parts(spark, monkeypatch):
    """the labelled sample came to the driver in one result, several times its size in memory."""
    from fieldlens.llm import factorisation, toxicity

    docs = spark.createDataFrame([(i, f"word{i} other") for i in range(60)] + [(5, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    want = [r.doc_id for r in docs.orderBy(F.xxhash64("doc_id"), "doc_id").limit(40).collect()]
    options = []
    write = factorisation.written
    monkeypatch.setattr(factorisation, "written", lambda df, name, **o: options.append(o) or write(df, name, **o))
    monkeypatch.setattr(factorisation, "READ_ROWS", 7)
    monkeypatch.setattr(type(docs), "collect", lambda self: pytest.fail("the sample is collected at once"))
    rows = factorisation.labelled_sample(docs, labels, "toxic", F.lit(True), toxicity.Features, 40, None)
    assert options == [{"maxRecordsPerFile": 7}] and [r[2] for r in rows] == [i % 2 for i in want]
    assert all(len(s) == len(v) and s.dtype == "i4" for s, v, _ in rows)


def test_written_leaves_no_shuffle_files(spark):
    """shuffles of finished steps stayed on disk until the driver happened to collect its garbage."""
    import glob

    from fieldlens.llm.store import _CLEAN_UP, written

    folders = list(spark._jsc.sc().env().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in folders for f in glob.glob(f"{d}/**/shuffle_*", recursive=True)}
    before, setting = files(), spark.conf.get(_CLEAN_UP)
    out = written(spark.range(100_000).groupBy((F.col("id") % 5000).alias("k")).count(), "counts")
    assert not files() - before and spark.conf.get(_CLEAN_UP) == setting
    assert out.count() == 5000


def test_word_ids_encode_runs_of_words(spark):
    """each distinct word was a call of the library, and each piece of a text was lower-cased and matched by itself."""
    path = public_tokenizers.path(token_files.VOCABULARY)
    ids = token_files.WordIds(path)
    library = Tokenizer.from_file(path)
    letters = [*"abcXYZéßÀŉªµǅɏ", *"\x1c\x1f\x85\xa0\t\n  .,'19²<|", "漢", "́", "İ", "'ll ", "<|endoftext|>"]
    rng = random.Random(3)
    texts = ["", "x" * 70_000, "Plain Words, only: don't.", *("".join(rng.choices(letters[:k], k=rng.randint(1, 40))) for k in (14, 29, len(letters)) for _ in range(1500))]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert ids.encode(texts) == want
    calls = []
    own = ids.tokenizer
    ids.tokenizer = type("Counted", (), {"encode": lambda self, *a, **b: calls.append(1) or own.encode(*a, **b),
                                         "encode_batch_fast": lambda self, some, **b: calls.extend(some) or own.encode_batch_fast(some, **b)})()
    new = " ".join("".join(rng.choices("abcdefgh", k=12)) for _ in range(5000))
    assert ids.encode([new])[0] == np.array(library.encode(new, add_special_tokens=False).ids, "<u4").tobytes() and len(calls) <= 6


def test_packing_encodes_words_once_whatever_marks_follow():
    """Marks, line feeds and odd letters behind words: ids equal the library's; most words reach it in runs and not as pieces of their own."""
    path = public_tokenizers.path(packing.VOCABULARY)
    ids = packing.Ids(path)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeABCé") for _ in range(rng.randint(1, 9))) for _ in range(300)] + ["don't", "x1", "12", "ŉa", "ɐɑ", "中文", "<|endoftext|>", "a<|endoftext|>.", "Ƛ", "i̇"]
    ends = ["", "", ",", ".", "...", ".\n", "\n", "\n\n", ".\r\n", "\t", "?!", "\"", "'s", " ", ".\n\n", " "]
    texts = ["".join(rng.choice(words) + rng.choice(ends) + rng.choice([" ", " ", " ", "", "\n"]) for _ in range(200)) for _ in range(80)]
    single, seen = ids._single, []
    ids._single = ids.rests.encode = lambda pieces: seen.extend(pieces) or single(pieces)
    want = [np.array(ids.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert ids.encode(texts) == want
    simple = " ".join(w + e for w in words[:300] for e in (",", ".", "?!", "..."))
    seen.clear()
    assert ids.encode([simple]) == [np.array(ids.tokenizer.encode(simple, add_special_tokens=False).ids, dtype="<u4").tobytes()]
    assert len(seen) < 20
