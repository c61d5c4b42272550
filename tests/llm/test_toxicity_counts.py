"""Which labelled documents the toxicity model counts."""

import math
import random
import re
from collections import Counter

import pytest

from tidemark.llm import toxicity


def test_every_labelled_document_is_counted(spark):
    docs = spark.createDataFrame([(i, f"common words then only{i} here") for i in range(60)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    seen = {}
    own = toxicity.continuations

    def spy(keys):
        seen["rows"] = own(keys).collect()
        return own(keys)

    toxicity.continuations = spy
    try:
        toxicity.fit(docs, labels)
    finally:
        toxicity.continuations = own
    # The 60 words of one document each, and common, words, then, here in both classes.
    assert len(seen["rows"]) == 60 + 2 * 4
    assert sum(r["open"] == 0 for r in seen["rows"]) in range(1, 40)


def test_calibration_holds_fewer_texts_of_many_labels(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_CALIBRATION", 6)
    docs = spark.createDataFrame([(i, f"common words then only{i} here") for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, toxic int")
    own, held = toxicity.bigrams, []

    def spy(train):
        held.append(train.filter("held").count())
        return own(train)

    monkeypatch.setattr(toxicity, "bigrams", spy)
    toxicity.fit(docs, labels)
    assert 0 < held[0] < 30


def plain_ratios(texts):
    """Log-likelihood ratio of each word, from (text, toxic) rows."""
    pairs = {0: set(), 1: set()}
    for text, toxic in texts:
        before = None
        for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower()):
            pairs[toxic].add((before, w))
            before = w
    types = {c: Counter(w for _, w in p) for c, p in pairs.items()}
    words = set(types[0]) | set(types[1])
    both = {w: types[0][w] + types[1][w] + 0.5 for w in words}
    out = {}
    for w in words:
        p = []
        for c in (0, 1):
            mass = sum(max(n - toxicity.DISCOUNT, 0) for n in types[c].values())
            shared = both[w] / sum(both.values())
            p.append((1 - toxicity.BACKOFF) * max(types[c][w] - toxicity.DISCOUNT, 0) / max(mass, 1) + toxicity.BACKOFF * shared if mass > 0 else shared)
        out[w] = math.log(p[1] / p[0])
    return out


def corpus():
    rng = random.Random(8)
    texts = []
    for i in range(160):
        words = rng.choices([f"w{j}" for j in range(60)], k=rng.randrange(0, 40))
        toxic = i % 4 == 0
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["scum", "Vile", "fo\u00fcl"]))
        texts.append((" ".join(words), int(toxic)))
    return texts


def test_scores_against_plain_python(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    ratio = plain_ratios(texts)
    a, b, c = model.weights
    assert sum(r > toxicity.EVIDENT for r in ratio.values()) >= 3
    for r in toxicity.score(docs, model).collect():
        words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", texts[r["doc_id"]][0].lower())
        up = sum(max(ratio[w] - toxicity.EVIDENT, 0) for w in words)
        n = max(len(words), 1)
        assert r["up"] == pytest.approx(up / n, abs=1e-5)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, a * up / n + b * up / math.sqrt(n) + c)))), abs=1e-3)


def test_a_join_scores_like_the_broadcast(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "up", "row", "n") for i, (t, _) in enumerate(texts)] + [(3, "scum again", "", "", ""), (None, None, "", "", "")], "doc_id long, text string, up string, row string, n string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int")
    few, many = toxicity.fit(docs, labels), toxicity.fit(docs, labels, max_evident=0)
    assert few.word is not None and many.word is None
    assert few.weights == pytest.approx(many.weights, rel=1e-6)
    one, other = toxicity.score_rows(docs, few), toxicity.score_rows(docs, many)
    assert one.columns == other.columns == [*docs.columns, "score"]
    key = lambda r: repr(tuple(r)[:-1])
    for r, x in zip(sorted(one.collect(), key=key), sorted(other.collect(), key=key), strict=True):
        assert key(r) == key(x)
        assert r["score"] == pytest.approx(x["score"], rel=1e-6)
