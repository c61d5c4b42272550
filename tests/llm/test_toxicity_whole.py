"""A whole toxicity model counts every word's ratio, to either side, and the queries use one."""

import math
import re

import corpus_pipeline
import pytest
from test_toxicity_counts import corpus, plain_ratios

from tidemark.llm import queries, toxicity


def test_every_word_counts(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int")
    ratio = plain_ratios(texts)
    assert sum(r < 0 for r in ratio.values()) >= 10 and sum(0 < r < toxicity.EVIDENT for r in ratio.values()) >= 10
    few, many = toxicity.fit(docs, labels, whole=True), toxicity.fit(docs, labels, max_evident=0, whole=True)
    assert few.word is not None and many.word is None
    assert few.weights == pytest.approx(many.weights, rel=1e-6)
    a, b, c, d = few.weights
    assert abs(c) > 1e-3
    for model in (few, many):
        for r in toxicity.score(docs, model).collect():
            words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", texts[r["doc_id"]][0].lower())
            up, n = sum(max(ratio[w] - toxicity.EVIDENT, 0) for w in words), max(len(words), 1)
            x = a * up / n + b * up / math.sqrt(n) + c * sum(ratio[w] for w in words) / n + d
            assert r["up"] == pytest.approx(up / n, abs=1e-5)
            assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, x)))), abs=1e-3)


def test_texts_without_evident_words_are_told_apart(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int")
    ratio = {w: r for w, r in plain_ratios(texts).items() if r < toxicity.EVIDENT}
    ends = spark.createDataFrame([(0, min(ratio, key=ratio.get)), (1, max(ratio, key=ratio.get))], "doc_id long, text string")
    low, high = (r["score"] for r in toxicity.score(ends, toxicity.fit(docs, labels, whole=True)).orderBy("doc_id").collect())
    assert abs(low - high) > 1e-4


@pytest.mark.parametrize("run", [queries.op2_toxicity, lambda spark, sf: corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)])
def test_the_queries_use_whole_models(spark, monkeypatch, run):
    own, models = toxicity.fit, []
    monkeypatch.setattr(toxicity, "fit", lambda *args, **kwargs: models.append(own(*args, **kwargs)) or models[0])
    run(spark, "/root/testdata/sf0.001")
    assert len(models[0].weights) == 4 and models[0].table.filter("ratio < 0").count() > 0
