"""Line runs against plain Python, and the pipeline against its stages' brute-force rules."""

import random
from collections import defaultdict

import corpus_pipeline
import pytest

from tests.llm.test_contracts import empty, folder, norm, odd, rows, sha, table  # noqa: F401
from tests.llm.test_near import plain_near
from tidemark.llm import lines
from tidemark.llm import queries as Q


def plain_lines(docs, least, long_words=None):
    """(lines, removed, longest run that an earlier place has, kept text) of texts in the order of their ids."""
    texts = [t.split("\n") for t in docs]
    longest, gone = [0] * len(texts), [set() for _ in texts]
    k, found = 1, True
    while found:
        seen, found = set(), False
        for d, t in enumerate(texts):
            for i in range(len(t) - k + 1):
                run = tuple(t[i : i + k])
                if run in seen:
                    found = True
                    if k >= least or (long_words and len(run[0].split()) >= long_words):
                        longest[d] = k
                        gone[d] |= set(range(i, i + k))
                seen.add(run)
        k += 1
    return [(len(t), len(g), n, "\n".join(x for i, x in enumerate(t) if i not in g)) for t, g, n in zip(texts, gone, longest, strict=True)]


def test_runs_are_exact_and_maximal(spark):
    a = [f"a{i}" for i in range(12)]
    texts = ["\n".join(a), "\n".join(["x", *a[2:9], "y", *a[5:8], "z"]), "\n".join([*a[:5], "q", *a[2:9], "r"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    runs = sorted((r["id"], r["line"], r["k"]) for r in lines.repeated_runs(docs).collect())
    assert runs == [(1, 1, 7), (1, 9, 3), (2, 0, 5), (2, 6, 7)]


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", 1, 2, 3), (2, "a\nb\nd", 4, 5, 6)], "doc_id long, text string, gone int, hash int, n_lines int").toDF("doc_id", "text", "gone", "__hash", "n_lines")
    got = lines.remove_repeated_lines(docs)
    assert got.columns == ["doc_id", "text", "gone", "__hash", "n_lines", "n_removed", "longest_run"]
    assert sorted(map(tuple, got.collect())) == [(1, "a\nb\nc", 1, 2, 3, 0, 0), (2, "d", 4, 5, 3, 2, 2)]


@pytest.mark.parametrize("least", [1, 2, 3])
def test_lines_of_few_kinds(spark, least):
    rng = random.Random(least)
    texts = ["\n".join(rng.choices(["a", "b", "c", "", "dé"], k=rng.randrange(1, 12))) for _ in range(40)] + ["x\n" * 20, "q\nr\ns", "", "q\nr\ns"]
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, line string").repartition(3)
    got = sorted(lines.remove_repeated_lines(docs, min_lines=least).collect())
    assert [r["line"] for r in got] == ["kept"] * len(texts)
    assert [(r["n_lines"], r["n_removed"], r["longest_run"], r["text"]) for r in got] == plain_lines(texts, least)


def test_lines(spark):
    docs = sorted(table(spark, "/root/testdata/sf0.001", "documents"), key=lambda d: d["doc_id"])
    plain = plain_lines([d["text"] for d in docs], 2)
    expected = [(d["doc_id"], n, g, k, sha(t)) for d, (n, g, k, t) in zip(docs, plain, strict=True)]
    assert rows(Q.op1_lines(spark, "/root/testdata/sf0.001"), "doc_id", "n_lines", "n_removed", "longest_run", "kept_sha256") == sorted(expected, key=repr)


def test_lines_of_odd_rows(spark, odd):  # noqa: F811
    got = Q.op1_lines(spark, odd).collect()
    assert len(got) == 7
    assert {r["n_removed"] for r in got} == {0}


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(corpus_pipeline.STAGES) == 5
    kept = stages["toxicity"](spark, docs, sf)
    scores = {r["doc_id"]: r["predicted"] for r in Q.op2_toxicity(spark, sf).collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, p in scores.items() if not p)
    assert kept.columns == docs.columns

    by_id = {r["doc_id"]: r["text"] for r in stages["line dedup"](spark, docs, sf).collect()}
    ids = sorted(by_id)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [by_id[i] for i in ids] == [t for _, _, _, t in plain_lines([texts[i] for i in ids], 2, 50)]

    kept = plain_near([(i, texts[i]) for i in ids])
    assert sorted(r["doc_id"] for r in stages["near-dedup by shingle sets"](spark, docs, sf).collect()) == sorted(i for _, i in kept)

    windows = set()
    for b in table(spark, sf, "benchmark"):
        w = norm(b["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    clean = []
    for i in ids:
        w = norm(texts[i])
        if not any(tuple(w[j : j + k]) in windows for k in {len(x) for x in windows} for j in range(len(w) - k + 1)):
            clean.append(i)
    assert sorted(r["doc_id"] for r in stages["benchmark decontamination"](spark, docs, sf).collect()) == clean


def test_run_is_its_stages_in_turn(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), stage(spark, docs, sf).schema)
    assert sorted(map(tuple, docs.collect()), key=repr) == sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()), key=repr)


def test_pipeline_of_empty_tables(spark, empty):  # noqa: F811
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_pipeline_of_odd_rows(spark, odd):  # noqa: F811
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{odd}/labels.parquet")
    counts = defaultdict(int)
    for r in corpus_pipeline.run(spark, odd).collect():
        counts[r["doc_id"]] += 1
    assert set(counts) <= {1, None, 3, 4, 5, 6}
