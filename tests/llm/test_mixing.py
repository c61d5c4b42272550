"""The mix against plain Python: targets by repeated resharing, words of each block, quotas of shards, odd rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing
from tidemark.llm import queries as Q

TEXT = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "a b c d e f g", None, "b", 1),
    (1, "a b c d e f g", None, "b", 1),
    (None, "one\ttwo\x0bthree", None, None, 1),
    (None, None, None, None, None),
    (3, "", None, "empty", 0),
    (4, " \n\t ", None, "empty", 4),
    (5, "word " * 20_000, None, "long", 4),
    (6, "É ß 漢字", None, "null", 4),
    (7, "x y z", None, "𝄞", 4),
    (8, "x y z", None, "￮", 4),
]


def write(spark, rows, folder):
    spark.createDataFrame([(*r, "clash", 1) for r in rows], TEXT + ", row string, src int").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.fixture(scope="module", params=["sf", "odd"])
def folder(request, spark, tmp_path_factory):
    return "/root/testdata/sf0.001" if request.param == "sf" else write(spark, ODD, tmp_path_factory.mktemp("odd"))


def expected(docs):
    size = lambda d: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or ""))
    whole = Counter()
    for d in docs:
        whole[d["source"]] += size(d)
    order = sorted(whole, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, target = Fraction(3 * sum(whole.values()), 2), list(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total >= 2 * whole[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        target |= {s: Fraction(2 * whole[s]) for s in over}
        left -= sum(target[s] for s in over)
        free = [s for s in free if s not in over]
    own = defaultdict(list)
    for d in docs:
        key = f"mix:{'' if d['doc_id'] is None else d['doc_id']}:{d['text'] or ''}"
        own[d["source"]].append((hashlib.sha256(key.encode()).hexdigest(), d["doc_id"], size(d)))
    out = []
    for s, rows in own.items():
        words = [i for i, r in enumerate(sorted(rows, key=lambda r: r[0])) for _ in range(r[2])]
        got = Counter((words * 2)[: math.floor(target[s] + Fraction(1, 2))])
        out += [(r[1], r[2], whole[s], float(target[s]), got[i]) for i, r in enumerate(sorted(rows, key=lambda r: r[0]))]
    return sorted(out, key=repr)


def test_mix_against_plain_python(spark, folder):
    docs = [r.asDict() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = [tuple(r) for r in Q.op13_mixing(spark, folder).select("doc_id", "size", "source_size", "target", "taken").collect()]
    for a, b in zip(sorted(got, key=repr), expected(docs), strict=True):
        assert a[:3] + a[4:] == b[:3] + b[4:] and a[3] == pytest.approx(b[3], rel=1e-12)
    assert all(taken <= 2 * size for _, size, _, _, taken in got)


def test_shards_are_even_disjoint_and_cover_the_quotas(spark):
    rows = [(i, "w " * (i % 37), None, f"s{i % 5}", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, TEXT)
    placed, mixed = mixing.mix(docs, shards=6, block_words=16)
    quota = {r["src"]: r["quota"] for r in placed.select("src", "quota").distinct().collect()}
    cut, placed = mixed.collect(), {r["row"]: r for r in placed.collect()}
    blocks = {(r["src"], r["block"]): r["shard"] for r in cut}
    assert len(blocks) == sum(-(-q // 16) for q in quota.values())
    assert len({(r["src"], r["block"], r["shard"]) for r in cut}) == len(blocks)
    per_shard = Counter(blocks.values())
    assert set(per_shard) == set(range(6)) and max(per_shard.values()) - min(per_shard.values()) <= 1
    words = Counter()
    for r in cut:
        assert 0 <= r["from_word"] and r["from_word"] + r["words"] <= placed[r["row"]]["size"]
        words.update((r["row"], w) for w in range(r["from_word"], r["from_word"] + r["words"]))
    assert max(words.values()) <= 2
    by_source = Counter()
    for (row, _), n in words.items():
        by_source[placed[row]["src"]] += n
    assert by_source == quota
    # In the order of a shard's keys, sources and blocks are shuffled.
    first = [(r["src"], r["block"]) for r in sorted((r for r in cut if r["shard"] == 0), key=lambda r: r["place_key"])]
    assert first != sorted(first)
    again = mixing.mix(docs.repartition(7), shards=6, block_words=16)[1].select("shard", "place_key", "at", "id", "from_word", "words").collect()
    assert sorted(map(tuple, again)) == sorted((r["shard"], r["place_key"], r["at"], r["id"], r["from_word"], r["words"]) for r in cut)


@pytest.mark.parametrize(("marked", "others", "drawn"), [(12, 30, 9), (400, 300, 350), (5, 0, 3), (0, 5, 3), (1_000_000, 3_000_000, 2_000_000)])
def test_hypergeometric_draws(spark, marked, others, drawn):
    one = lambda n: F.lit(float(n))
    draws = spark.range(4000).select(mixing.hypergeometric(one(marked), one(others), one(drawn), (F.col("id") + 0.5) / 4000).alias("x"))
    r = draws.agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var"), F.min("x").alias("low"), F.max("x").alias("high")).first()
    n = marked + others
    mean, var = drawn * marked / n, drawn * marked / n * others / n * (n - drawn) / max(n - 1, 1)
    assert r["mean"] == pytest.approx(mean, abs=0.02 * var**0.5 + 1e-9) and r["var"] == pytest.approx(var, rel=0.02, abs=1e-9)
    assert max(0, drawn - others) <= r["low"] and r["high"] <= min(marked, drawn)


def test_writes_shards_in_reading_order(spark, tmp_path):
    docs = spark.createDataFrame([(i, "w " * 50, None, "s", 1) for i in range(40)], TEXT)
    _, mixed = mixing.mix(docs, shards=3, block_words=8)
    mixing.write_mix(mixed, f"{tmp_path}/mix")
    back = spark.read.parquet(f"{tmp_path}/mix")
    assert back.count() == mixed.count() and back.select("shard").distinct().count() == 3


def test_empty_and_wordless_tables(spark, tmp_path):
    assert Q.op13_mixing(spark, write(spark, [], tmp_path / "none")).count() == 0
    got = Q.op13_mixing(spark, write(spark, [(1, None, None, "a", 1), (2, "", None, None, 1)], tmp_path / "wordless")).collect()
    assert [(r["size"], r["source_size"], r["target"], r["taken"]) for r in got] == [(0, 0, 0.0, 0)] * 2
