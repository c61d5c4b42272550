"""The near-dedup stage against plain Jaccard similarities."""

import random

import corpus_pipeline
import pytest

from tests.llm.test_contracts import table
from tidemark.llm import near


def plain_near(docs):
    """Kept (id, text) of (id, text) rows: all pairs are compared."""
    sets = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a == sets[j] or (both and 5 * both >= 4 * (len(a) + len(sets[j]) - both)):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(find(i), []).append(docs[i])
    return [min((i is None, i or 0) for i, _ in g) for g in groups.values()]


@pytest.mark.parametrize("seed", range(2))
def test_near_copies(spark, seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(400)], k=rng.randrange(1, 90))) for _ in range(25)]
    docs = []
    for t in texts:
        for _ in range(6):
            w = t.split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = "new"
            docs.append(" ".join(w[: len(w) - rng.randrange(len(w) // 6 + 1)]))
    docs = list(enumerate([*docs, "", None, " \n", "A b", "a  B"]))
    rng.shuffle(docs)
    got = near.keep_first(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for _, i in plain_near(docs))


def test_stage_finds_pairs_of_many_bits(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = dict(corpus_pipeline.STAGES)["near-dedup by shingle sets"](spark, docs, sf)
    plain = plain_near([(d["doc_id"], d["text"]) for d in table(spark, sf, "documents")])
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for _, i in plain)


def test_a_passage_of_all_texts_makes_no_candidates(spark, monkeypatch):
    monkeypatch.setattr(near, "SAMPLE_ONE_IN", 2)
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(i, f"{passage} " + " ".join(f"own{i}x{j}" for j in range(60))) for i in range(80)]
    docs += [(100 + i, docs[i][1] + " and more") for i in range(10)]
    asked = watch(monkeypatch)
    kept = near.keep_first(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(80))
    assert sum(asked) < 40


def watch(monkeypatch):
    """Counts of the pairs that are formed in both passes."""
    asked, first, second = [], near._able, near._alike

    def spy(pairs, size):
        asked.append(pairs.count())
        return first(pairs, size)

    def compared(pairs, rows, shingle):
        asked.append(pairs.count())
        return second(pairs, rows, shingle)

    monkeypatch.setattr(near, "_able", spy)
    monkeypatch.setattr(near, "_alike", compared)
    return asked


def test_pages_of_one_template_make_pairs_in_proportion(spark, monkeypatch):
    asked, counts = watch(monkeypatch), []
    template = [f"t{i}" for i in range(300)]
    for n in (100, 200):
        docs = [(i, " ".join([*template, *(f"own{i}x{j}" for j in range(50))])) for i in range(n)]
        docs.append((n, docs[0][1].replace("own0x7", "other")))
        kept = near.keep_first(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
        assert sorted(r["doc_id"] for r in kept) == list(range(n))
        counts.append(sum(asked))
        asked.clear()
    assert counts[1] <= 2.2 * counts[0] and counts[1] <= 4 * 201


@pytest.mark.parametrize("seed", range(2))
def test_templates_of_unlike_sizes(spark, seed):
    """Pages with more or less of their own around the threshold: links over template shingles, early and late ones."""
    rng = random.Random(seed)
    template = [f"t{i}" for i in range(60)]
    docs = []
    for i in range(60):
        w = list(template[: rng.randrange(40, 61)])
        for j in range(rng.randrange(12)):
            w.insert(rng.choice([0, len(w), rng.randrange(len(w))]), f"o{i}x{j}")
        docs.append((i, " ".join(w)))
    got = near.keep_first(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for _, i in plain_near(docs))
