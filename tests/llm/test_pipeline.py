"""Each stage of the pipeline against plain Python on its own small input."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as p
from fieldlens.llm import packing, quality, toxicity
from fieldlens.llm.factorisation import sigmoid
from tests.conftest import SF
from tests.llm.test_dedup import _components, _expected, _texts


def _frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


@pytest.mark.parametrize("module,stage,fit,good", [(quality, "quality", "fit_quality", True), (toxicity, "toxicity", "fit_toxicity", False)])
def test_classifier_stages_keep_by_threshold(spark, monkeypatch, module, stage, fit, good):
    sf = SF.replace("0.001", "0.01")  # the smallest table has too few toxic rows to learn from
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    machine = getattr(module, fit)(docs, p._labels(spark, sf))
    monkeypatch.setattr(p, fit, lambda *_: machine)
    got = {r.doc_id for r in getattr(p, stage)(spark, docs, sf).collect()}
    features, want, close = module.Features(), set(), set()
    for r in docs.collect():
        score = sigmoid(machine.logits(*features(r.text or "", r.n_chars), np.array([0])))[0]
        if (score >= module.THRESHOLD) == good:
            want.add(r.doc_id)
        if abs(score - module.THRESHOLD) < 1e-5:  # single precision may round either way
            close.add(r.doc_id)
    assert got - close == want - close and 0 < len(got) < docs.count()


def test_line_stage_matches_brute_force(spark):
    docs = ["first line of the first text\nown words of it", "First line of the first text\nquite another line", "quite another lines", "own words of it\n\n",
            "-" * 200 + "\nabcde", "-" * 120, "abcd", "abcde\nabcd", " \n", ""]
    places, sets = [], []
    for i, t in enumerate(docs):
        for n, line in enumerate(t.split("\n")):
            if line.strip(" "):
                places.append((i, n))
                sets.append({line[k:k + 5] for k in range(len(line) - 4)} or {line})
    links = [(a, b) for k, a in enumerate(places) for m, b in enumerate(places[:k]) if len(sets[k] & sets[m]) >= 0.8 * len(sets[k] | sets[m]) - 1e-9]
    first, want = _components(places, links), set()
    for i, t in enumerate(docs):
        left = [line for n, line in enumerate(t.split("\n")) if first.get((i, n), (i, n)) == (i, n)]
        if len(left) == len(t.split("\n")) or any(x.strip(" ") for x in left):
            want.add((i, "\n".join(left)))
    assert {(r.doc_id, r.text) for r in p.line_dedup(spark, _frame(spark, docs), SF).collect()} == want
    assert len(want) < len(docs)


def test_minhash_stage_matches_brute_force(spark):
    """Five words at 0.8."""
    texts = _texts(19, 60)
    want = _expected(list(enumerate(texts)), 5, 80)
    got = {r.doc_id for r in p.minhash(spark, _frame(spark, texts), SF).collect()}
    assert got == {i for i, c in want.items() if i == c} and len(got) < len(texts)


def test_packing_stage_covers_each_id_once(spark):
    texts = ["", "one", *_texts(23, 10), "word " * 1500]
    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    rows = p.packing(spark, _frame(spark, texts), SF).collect()
    for i, text in enumerate(texts):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        want = np.array(t.encode(text, add_special_tokens=False).ids + [0], "<u4")
        assert b"".join(bytes(r.ids) for r in own) == want.tobytes()
