"""The near-dedup stage goes through SimHash first; whole shingle sets decide."""

import random

from tests.llm.test_near import plain_near
from tidemark.llm import near


def _texts(n):
    rng = random.Random(5)
    return [" ".join(rng.choices([f"w{i}" for i in range(3000)], k=400)) for _ in range(n)]


def _kept(spark, docs):
    return sorted(r["doc_id"] for r in near.keep_first(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect())


def test_simhash_links_close_copies_by_itself(spark, monkeypatch):
    texts = _texts(12)
    docs = [*enumerate(texts), *((100 + i, f"{t} end") for i, t in enumerate(texts))]
    asked, compare = [], near._alike
    monkeypatch.setattr(near, "_across", lambda rest: rest.select(near.F.col("row").alias("u"), near.F.col("row").alias("v")).limit(0))
    monkeypatch.setattr(near, "_alike", lambda pairs, rows, shingle: asked.append(pairs.count()) or compare(pairs, rows, shingle))
    assert _kept(spark, docs) == list(range(12))
    # What SimHash linked is not compared again.
    assert asked == [12, 0, 0]


def test_equal_fingerprints_are_no_link_by_themselves(spark, monkeypatch):
    # The workers get the function by value.
    monkeypatch.setattr(near, "fingerprints_of", lambda column, shingle: near.np.full(len(column), 7, near.np.uint64))
    docs = [*enumerate(_texts(20)), (50, None), (51, "a b"), (52, "A b")]
    docs += [(100 + i, " ".join(t.split()[: 400 - 15 * i])) for i, t in docs[:8]]
    assert _kept(spark, docs) == sorted(i for _, i in plain_near(docs))
