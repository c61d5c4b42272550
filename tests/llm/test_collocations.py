"""Phrase mining against plain Python, on odd rows and with hashes that collide."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import collocations

SCHEMA = "doc_id long, text string, lang string, h long, rank string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [
    (1, "New York City hall. New York, new york city! In New  York\tCity Hall", None, 1, "x"),
    (1, "New York City hall. New York, new york city! In New  York\tCity Hall", None, 1, "x"),
    (2, "new york city hall", "und", 1, "x"),
    (None, None, "en", None, None),
    (4, "", "en", 1, "x"),
    (5, " .,;\n\t ", "en", 1, "x"),
    (6, "É ß 漢字 \x0b É ß 漢字 \x00 É ß É ß", "de", 1, "x"),
    (7, "la la la la la la. " * 2000, "fr", 1, "x"),
    (8, "a b c d e f g " * 30, "en", 1, "x"),
    (9, "a b c d x e f g b c", "en", 1, "x"),
]


def expected(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        known = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        inside = Counter()
        for p, c in known.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], c)
        found = []
        for p, a in known.items():
            if inside[p] < a:
                score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("least", "top"), [(2, 2000), (1, 5), (3, 2000), (100, 2000)])
def test_odd_rows(spark, least, top):
    docs = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    got = collocations.collocations(docs, least=least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == expected(ODD, least, top)


def test_sf_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    assert sorted(map(tuple, collocations.collocations(docs, least=7).collect())) == expected(rows, 7, 2000)


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_least_that_counters_cannot_hold(spark):
    with pytest.raises(ValueError, match="between 1 and 255"):
        collocations.collocations(spark.createDataFrame([], SCHEMA), least=256)


def test_another_seed_where_words_share_a_hash(spark):
    docs = spark.createDataFrame([("en", "red red blue")], "lang string, text string")

    def colliding(docs, seed):
        words = collocations.vocabulary(docs, seed)
        return words.withColumn("h", F.lit(1).cast("long")) if seed < 2 else words

    seed, words = collocations._seeded(docs, 2, colliding)
    assert seed == 2 and words.select("h").distinct().count() == 2
    with pytest.raises(ValueError, match="share a hash"):
        collocations._seeded(docs, 2, lambda d, s: colliding(d, 0))
