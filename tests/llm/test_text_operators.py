"""Repeated passages, near-duplicates and toxicity against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from math import comb

import numpy as np
import pytest
import xxhash

from tests.llm.test_contracts import empty, folder, odd, rows, sha, table  # noqa: F401
from tidemark.llm import _text, phrases, simhash
from tidemark.llm import queries as Q


def repeats(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_phrases(spark, folder):  # noqa: F811
    docs = table(spark, folder, "documents")
    expected = [(d["doc_id"], n, g, hashlib.sha256(k).hexdigest()) for d, (n, g, k) in zip(docs, repeats([d["text"] for d in docs], 35), strict=True)]
    assert rows(Q.op3_phrases(spark, folder), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(expected, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_phrases_of_few_words(spark, seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices("abc é".split(), k=rng.randrange(0, 60))) for _ in range(60)]
    texts += [texts[3] + " z " + texts[4], None, "  x y " * 12, "a " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"].encode()) for r in phrases.remove_repeats(docs, window=12, block_bytes=500).collect()}
    assert got == dict(enumerate(repeats(texts, 12)))


def test_word_hashes_in_pieces(monkeypatch):
    text = ("ab cd\té " * 500).encode()
    data = np.frombuffer(text, np.uint8)
    ends = np.array([0, 7, 7, len(text)])
    one = _text.Words(data, ends[:-1], ends[1:])
    whole = one.hashes()
    monkeypatch.setattr(_text, "WINDOW_WORDS_BYTES", 40)
    assert (whole == one.hashes()).all()
    assert len(set(whole.tolist())) == 5  # ab, cd, é, and the two bytes of the é that the second text boundary cuts


def plain_components(ids, texts):
    prints = []
    for t in texts:
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), seed=42) for i in range(max(1, len(w) - 3))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    fps = np.array(sorted(set(prints)), np.uint64)
    root = {int(f): int(f) for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, f in enumerate(fps):
        for g in fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ f) <= 4]:
            root[find(int(g))] = find(int(f))
    least = defaultdict(list)
    for i, p in zip(ids, prints, strict=True):
        least[find(p)].append(i)
    return [(i, f"{p:016x}", min((x for x in least[find(p)] if x is not None), default=None)) for i, p in zip(ids, prints, strict=True)]


def test_simhash(spark, folder):  # noqa: F811
    docs = table(spark, folder, "documents")
    expected = plain_components([d["doc_id"] for d in docs], [d["text"] for d in docs])
    assert rows(Q.op10_simhash(spark, folder), "doc_id", "fingerprint", "component_id") == sorted(expected, key=repr)


def test_groups_grow_with_the_classes():
    counts = [simhash.group_count(10**i, 4) for i in range(1, 11)]
    assert counts == sorted(counts)
    assert counts[0] == 6
    assert counts[-1] > 8
    for i in range(1, 11):
        groups = simhash.group_count(10**i, 4)
        sizes = sorted(simhash.group_sizes(groups))
        assert sum(sizes) == 32
        assert 10**i * 0.5 ** sum(sizes[: groups - 4]) <= simhash.FULL_CELL or groups == simhash.MAX_GROUPS
        # Comparisons of a class grow far more slowly than the classes.
        assert comb(groups, 4) * 10**i * 0.375 ** (32 * (groups - 4) / groups) < 100 * 10 ** (i / 3)


def test_pairs_compared_grow_slowly():
    rng = np.random.default_rng(6)
    met = []
    for n in (20_000, 80_000):
        embedded = simhash.embed(rng.integers(0, 2**64, n, dtype=np.uint64))
        groups = simhash.group_count(n, 4)
        met.append(sum(int((c * (c - 1) // 2).sum()) for m in simhash._masks(groups, 4) for c in [np.unique(embedded & np.uint64(m), return_counts=True)[1]]) / n)
    assert met[1] < 100


@pytest.mark.parametrize("groups", [6, 7, 9])
def test_links_of_planted_fingerprints(spark, groups):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 400, dtype=np.uint64)
    fps = [base]
    for _ in range(6):  # chains of up to four bits each, and one dense group
        step = base.copy()
        for _ in range(4):
            step ^= np.uint64(1) << rng.integers(0, 64, len(base)).astype(np.uint64)
        fps.append(step)
    dense = base[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    fps = np.unique(np.concatenate([*fps, dense]))
    classes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(7)
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(classes, groups=groups)).collect()}
    root = {int(f): int(f) for f in fps.view(np.int64)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    signed = fps.view(np.int64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(fps ^ f) <= 4):
            a, b = find(int(signed[i])), find(int(signed[j]))
            root[max(a, b)] = min(a, b)
    for f in signed:
        assert got.get(int(f), int(f)) == find(int(f))


def test_large_cell_is_joined_like_small_ones():
    rng = np.random.default_rng(2)
    fp = np.unique(rng.integers(0, 2**64, 3, dtype=np.uint64)[rng.integers(0, 3, 800)] ^ (np.uint64(1) << rng.integers(0, 64, 800).astype(np.uint64)))
    u, v = simhash.cell_links(np.zeros(len(fp), np.int64), fp, 4)
    assert len(u) <= len(fp)
    assert len(set(u.tolist())) == len(fp) - 3


def test_manhattan_is_below_hamming():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**64, (2, 2000), dtype=np.uint64)
    segments = lambda x: np.bitwise_count((x[:, None] >> np.arange(0, 64, 2, dtype=np.uint64)) & np.uint64(3)).astype(int)
    assert (simhash.manhattan(simhash.embed(a), simhash.embed(b)) == np.abs(segments(a) - segments(b)).sum(axis=1)).all()
    assert (simhash.manhattan(simhash.embed(a), simhash.embed(b)) <= np.bitwise_count(a ^ b)).all()


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = Q.op2_toxicity(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    right = sum(r["predicted"] == labels[r["doc_id"]] for r in held)
    assert right / len(held) > 0.97
    toxic = [r for r in held if labels[r["doc_id"]]]
    assert sum(r["predicted"] for r in toxic) / len(toxic) > 0.85


def test_toxicity_of_odd_rows(spark, odd):  # noqa: F811
    spark.createDataFrame([(1, 1, 0), (3, 1, 1), (3, 1, 0), (None, 1, 1), (77, 0, None)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{odd}/labels.parquet")
    got = Q.op2_toxicity(spark, odd).collect()
    assert len(got) == 7
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
