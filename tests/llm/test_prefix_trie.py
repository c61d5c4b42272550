"""The trie's nodes against plain Python: odd rows, combs, chains, copies, and the shape of its compacted nodes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import prefix_trie
from tidemark.llm import queries as Q

SCHEMA = "conv_id long, turn long, role string, text string, depth string, id long"
ODD = [
    (0, 0, "user", "hi"), (0, 1, "assistant", "a\n:b"), (0, 2, "user", "go on"), (0, None, None, "first"), (0, 2, "user", "go"),
    (7, 0, "user", "hi"), (7, 1, None, None), (7, 1, None, None),
    (107, 0, "user", "h"), (107, 0, "user", "h"), (13, 5, "", ""), (250, 1, "u" * 3, "x" * 70_000), (-5, 0, "user", "hi"), (-205, 0, "user", "hi"), (11, 0, "us", "er漢\U0001f600"), (12, 0, "user", "漢\U0001f600"),
    (None, 0, "user", "nobody's"), (None, None, None, None),
]


def table(spark, rows, folder):
    spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def brute(turns_of):
    """Nodes of ``{conv_id: turns}``."""
    members = defaultdict(list)
    for c in sorted(turns_of):
        for d in range(len(turns_of[c]) + 1):
            members[turns_of[c][:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(who) - 1) * (len(p[-1][1]) if p else 0)
    ends = {p: ",".join(str(c) for c in who if len(turns_of[c]) == len(p)) for p, who in members.items()}
    return sorted(
        ((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p in members), key=repr
    )


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: tuple((r, t) for _, r, t in sorted(x)) for c, x in own.items()}
    out = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c > 0 else -1)
        out[c] = own.get(base, ())[:h] + x[h:]
    return out


@pytest.mark.parametrize("name", ["sf", "odd"])
def test_query_against_plain_python(spark, tmp_path, name):
    folder = "/root/testdata/sf0.001" if name == "sf" else table(spark, ODD, tmp_path)
    rows = [tuple(r)[:4] for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, Q.op11_prefix_trie(spark, folder).collect()), key=repr) == brute(rebuilt(rows))


def shapes():
    turn = lambda i: ("user", f"t{i}")
    spine = tuple(turn(i) for i in range(40))
    rng = random.Random(3)
    return {
        "comb": {i: spine[:i] + (("assistant", f"tooth {i}"),) for i in range(40)},
        "chain": {i: spine[: 40 - i] for i in range(40)},
        "copies": {i: spine[:5] for i in range(50)} | {99: spine[:9], 98: spine[:2]},
        "bushy": {i: tuple(turn(rng.randrange(2)) for _ in range(rng.randrange(12))) for i in range(300)},
    }


@pytest.mark.parametrize("name", sorted(shapes()))
def test_shapes(spark, name):
    turns_of = shapes()[name]
    rows = [(c, i, *t) for c, turns in turns_of.items() for i, t in enumerate(turns)]
    convs = prefix_trie.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    missing = [(c, []) for c in turns_of if not turns_of[c]]
    convs = convs.unionByName(spark.createDataFrame(missing, convs.schema))
    members = prefix_trie.paths(convs)
    got = prefix_trie.shared_prefixes(members).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(turns_of)
    nodes = prefix_trie.trie(members.dropDuplicates(["key"]).select("key", "len", "path", "chars")).collect()
    ends = {t for t in turns_of.values() if t}
    parts = {p[:d] for p in ends for q in ends for d in range(1, len(p)) if p[:d] == q[:d] and (len(q) == d or q[d : d + 1] != p[d : d + 1])}
    assert len(nodes) == len(ends | parts)  # one node where conversations part or end
    for n in nodes:
        f = max(range(n["start"] + 1, n["end"] + 1), key=lambda d: d & -d)
        assert bytes(n["handle"]) == bytes(n["edge"][16 * (f - n["start"] - 1) : 16 * (f - n["start"])])
        assert len(n["edge"]) == 16 * (n["end"] - n["start"]) and len(n["chars"]) == n["end"] - n["start"] + 1


def test_fattest_numbers(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)]
    got = spark.createDataFrame(pairs, "a int, b int").select("a", "b", prefix_trie.fattest(F.col("a"), F.col("b")).alias("f")).collect()
    assert all(r["f"] == max(range(r["a"] + 1, r["b"] + 1), key=lambda d: d & -d) for r in got)


def test_ids_longer_than_a_block(spark, monkeypatch):
    rows = spark.range(5000).select(F.lit(bytes(16)).alias("key"), F.col("id").alias("conv_id")).repartition(7)
    monkeypatch.setattr(prefix_trie, "BLOCK_CHARS", 100)
    expected = hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest()
    assert [r["ends_sha256"] for r in prefix_trie.joined_hashes(rows).collect()] == [expected]


def test_empty_table(spark, tmp_path):
    assert Q.op11_prefix_trie(spark, table(spark, [], tmp_path)).count() == 0
