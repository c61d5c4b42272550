"""Prefix trees in characters and tokens, slot maps, Bloom filter and features of clips."""

import itertools
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import audio, chat, sharding, urls
from tidemark.llm import queries as Q

CONVS = "conv_id long, turn long, role string, text string"


def conversations(spark):
    rows = [(i, 0, "user", "same start") for i in range(40)]
    rows += [(i, 1, "assistant", f"answer {i % 4} <s>[INST]\\") for i in range(40)]
    rows += [(i, 2, "user", f"own {i}") for i in range(0, 40, 3)]
    return spark.createDataFrame(rows, CONVS).repartition(3)


def test_shared_turns_are_written_once(spark):
    packs = chat.pack(conversations(spark).coalesce(1)).collect()
    assert sum(len(p["leaves"]) for p in packs) == 40
    for p in packs:
        starts = [n for n in p["nodes"] if n["parent"] == -1]
        assert len(starts) == 1
        written = [p["text"][n["start"] : n["end"]] for n in p["nodes"]]
        assert "".join(written) == p["text"]
        below = [(n["parent"], t) for n, t in zip(p["nodes"], written, strict=True)]
        assert len(below) == len(set(below))


@pytest.mark.parametrize("limits", [{}, {"max_convs": 3}, {"max_chars": 120}])
def test_positions_and_intervals(spark, limits):
    packs = chat.pack(conversations(spark), **limits)
    for p in packs.collect():
        assert len(p["leaves"]) <= limits.get("max_convs", 256)
        for i, n in enumerate(p["nodes"]):
            assert n["parent"] < i
            spans = [(a["start"], a["end"]) for a in n["attends"]]
            assert all(a[1] < b[0] for a, b in itertools.pairwise(spans))  # none touch
            above, at = set(), n["parent"]
            while at >= 0:
                above |= set(range(p["nodes"][at]["start"], p["nodes"][at]["end"]))
                at = p["nodes"][at]["parent"]
            assert n["position"] == len(above)
            assert {x for a, b in spans for x in range(a, b)} == above | set(range(n["start"], n["end"]))
    assert chat.read_back(packs).count() == 40


def test_tokens_say_what_the_characters_say(spark):
    packs = chat.pack(conversations(spark))
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coding = chat._coding(path, public_tokenizers.PATTERN)
    texts = {p["pack_id"]: p for p in packs.collect()}
    for p in chat.tokenized(packs, path, public_tokenizers.PATTERN).collect():
        own = texts[p["pack_id"]]
        assert coding.decode(p["ids"]) == own["text"]
        for n, m in zip(p["nodes"], own["nodes"], strict=True):
            assert coding.decode(p["ids"][n["start"] : n["end"]]) == own["text"][m["start"] : m["end"]]
            assert coding.decode(p["ids"][n["loss_start"] : n["loss_end"]]) == own["text"][m["loss_start"] : m["loss_end"]]
            assert n["position"] == sum(a["end"] - a["start"] for a in n["attends"]) - (n["end"] - n["start"])
            assert "".join(coding.decode(p["ids"][a["start"] : a["end"]]) for a in n["attends"]) == "".join(own["text"][a["start"] : a["end"]] for a in m["attends"])


def test_long_conversations_have_few_intervals(spark):
    turns = [(1, i, "user", f"turn {i}") for i in range(2000)] + [(2, i, "user", f"turn {i}") for i in range(1000)] + [(2, 1000, "user", "other")]
    packs = chat.pack(spark.createDataFrame(turns, CONVS)).collect()
    assert sum(len(n["attends"]) for p in packs for n in p["nodes"]) <= 2 * sum(len(p["nodes"]) for p in packs)
    assert chat.pack(spark.createDataFrame(turns, CONVS + "").withColumn("attends", F.lit(1)).withColumn("turns", F.lit(2))).count() == len(packs)


def test_escapes_are_reversible():
    for text in ("", "\\", "</s>", "a\\n<b>[x]\n", "\\<s>\\\\", "[INST] ok [/INST]"):
        assert chat.unescape(chat.escape(text)) == text
        assert chat.unescape_role(chat.escape_role(text)) == text
        assert "</s>" not in chat.escape(text).replace("\\<", "")


def test_a_new_shard_takes_only_what_it_needs(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    recs = sharding.records(docs, n_slots=256)
    sizes = sharding.slot_sizes(recs)
    first = sharding.new_map(recs, 8, n_slots=256)
    second = sharding.rebalance(first, recs, 9, n_slots=256)
    load = lambda m: {r["shard"]: r["b"] for r in m.join(sizes, "virtual_slot").groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}
    old, new = load(first), load(second)
    largest = sizes.agg(F.max("bytes")).first()[0]
    assert max(old.values()) - min(old.values()) <= largest
    assert len(new) == 9 and max(new.values()) <= sum(new.values()) / 9 + largest
    was = {r["virtual_slot"]: r["shard"] for r in first.collect()}
    moved = [r for r in second.collect() if was[r["virtual_slot"]] != r["shard"]]
    assert {r["version"] for r in second.collect()} == {2}
    assert sum(1 for r in moved if r["shard"] == 8) > 0.6 * len(moved)
    assert len(moved) < 0.25 * len(was)


def test_maps_are_stored_by_version(spark, tmp_path):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"))
    recs = sharding.records(docs, n_slots=32)
    first = sharding.new_map(recs, 3, n_slots=32)
    sharding.save_map(first, f"{tmp_path}/maps")
    with pytest.raises(Exception, match="(?i)exists"):
        sharding.save_map(first, f"{tmp_path}/maps")
    sharding.save_map(sharding.rebalance(first, recs, 4, n_slots=32), f"{tmp_path}/maps")
    rows = lambda m: sorted((r["virtual_slot"], r["shard"]) for r in m.collect())
    assert rows(sharding.load_map(spark, f"{tmp_path}/maps", 1)) == rows(first)
    assert {r["version"] for r in sharding.load_map(spark, f"{tmp_path}/maps").collect()} == {2}
    assert sharding.place(recs, sharding.load_map(spark, f"{tmp_path}/maps"), n_slots=32).count() == 100
    with pytest.raises(ValueError, match="one row for each slot"):
        sharding.save_map(first.unionByName(first).withColumn("version", F.lit(3)), f"{tmp_path}/maps")


def test_shards_against_plain_placing(spark):
    got = [r.asDict() for r in Q.op7_sharding(spark, "/root/testdata/sf0.001").collect()]
    size, shard, rows = Counter(), {}, defaultdict(list)
    for r in got:
        size[r["virtual_slot"]] += r["size"]
        assert shard.setdefault(r["virtual_slot"], r["shard"]) == r["shard"]
        rows[r["shard"]].append((r["virtual_slot"], r["doc_id"], r["size"], r["text_crc32"], r["slot"]))
    load = [0] * 24
    for slot, n in sorted(size.items(), key=lambda x: (-x[1], x[0])):
        least = load.index(min(load))
        assert shard[slot] == least
        load[least] += n
    for placed in rows.values():
        assert [x[-1] for x in sorted(placed)] == list(range(len(placed)))


def test_equal_records_do_not_fill_one_shard(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 != 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 != 0, F.repeat(F.lit("x"), 40)).otherwise("the same text of about forty characters").alias("text"), F.lit(1).alias("row"), F.lit(2).alias("parts"))
    recs = sharding.records(docs)
    slot_map = sharding.new_map(recs, 24)
    placed = sharding.place(recs, slot_map).collect()
    load = Counter()
    for r in placed:
        load[r["shard"]] += r["size"]
    assert len(placed) == 3000
    again = sharding.place(sharding.records(docs.repartition(13)), slot_map).collect()
    assert Counter((r["id"], r["virtual_slot"]) for r in again) == Counter((r["id"], r["virtual_slot"]) for r in placed)
    assert max(load.values()) < 1.1 * min(load.values())


def test_bloom_filter_never_misses(spark):
    keys = spark.range(5000).select(F.concat(F.lit("host/"), F.col("id")).alias("key"))
    bloom = urls.build_filter(keys)
    others = spark.range(5000, 25000).select(F.concat(F.lit("host/"), F.col("id")).alias("key"))
    assert keys.filter(~urls.maybe_listed(spark, bloom, F.col("key"))).count() == 0
    assert others.filter(urls.maybe_listed(spark, bloom, F.col("key"))).count() < 400
    assert urls.build_filter(keys.limit(0)).shape == (1, 8)


def test_rules_of_equal_length_and_both_verdicts(spark):
    pages = spark.createDataFrame([(1, "x://a.bc/de"), (2, "x://bc/d"), (3, "x://q/")], "page_id long, url string")
    rules = spark.createDataFrame([("bc", "/de", "allow"), ("a.bc", "/", "block"), ("bc", "/d", "allow"), ("bc", "/d", "block"), (None, "/", "block")], "host string, path string, verdict string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.filter_urls(pages, rules, default="block").collect()}
    assert got == {1: ("a.bc/", "block"), 2: ("bc/d", "block"), 3: (None, "block")}


def test_a_key_tells_host_from_path(spark):
    pages = spark.createDataFrame([(1, "x://a.com/x"), (2, "x://a.co/x"), (3, "x://b/x")], "page_id long, url string")
    rules = spark.createDataFrame([("a.co", "m/x", "block"), ("a.c", "om/x", "block"), ("a.com/", "x", "block"), ("b", "/", "block")], "host string, path string, verdict string")
    got = {r["page_id"]: r["rule"] for r in urls.filter_urls(pages, rules).collect()}
    assert got == {1: None, 2: None, 3: "b/"}


def test_clips_keep_a_tone_and_find_its_segment():
    t = np.arange(12_000 * 2) / audio.RATE
    tone = np.sin(2 * np.pi * 1000 * t) * ((t > 0.5) & (t < 1.0))
    raw = (tone * 120 + 128).astype(np.uint8).tobytes()
    clip = audio.wav(raw)
    assert audio.samples(clip).tobytes() == raw
    x = audio.resample((audio.samples(clip).astype(np.float32) - 128) / 128)
    assert len(x) == len(raw) * 2 // 3
    assert abs(np.abs(np.fft.rfft(x)).argmax() / len(x) * audio.LOW_RATE - 1000) < 2
    spans = audio.segments(audio.log_mel(x))
    assert len(spans) == 1
    assert abs(spans[0][0] * audio.HOP / audio.LOW_RATE - 0.5) < 0.05
    with pytest.raises(ValueError, match="8-bit"):
        audio.samples(clip[:-1])


def plain_feature(raw):
    """Frames, patches, segments and band means of a clip, by sums over samples, frames and bins."""
    x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    taps = np.arange(49) - 24.0
    low = np.sinc(taps / 3) * np.hamming(49)
    low *= 2 / low.sum()
    y = np.zeros(len(x) * 2 // 3)
    for m in range(len(y)):  # upsampled by two, filtered, every third sample taken
        for k in range(49):
            at = 3 * m - (k - 24)
            if at % 2 == 0 and 0 <= at // 2 < len(x):
                y[m] += low[k] * x[at // 2]
    n = max(1, 1 + -(-max(0, len(y) - 256) // 160))
    y = np.pad(y, (0, (n - 1) * 160 + 256 - len(y)))
    basis = np.exp(-2j * np.pi * np.outer(np.arange(129), np.arange(256)) / 256)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(mel(60), mel(4000), 26)]
    bands = np.zeros((n, 24))
    for i in range(n):
        power = np.abs(basis @ (y[160 * i : 160 * i + 256] * np.hanning(256))) ** 2
        for b in range(24):
            lo, mid, hi = edges[b : b + 3]
            weight = [max(0.0, min((f - lo) / (mid - lo), (hi - f) / (hi - mid))) for f in np.arange(129) * 8000 / 256]
            bands[i, b] = np.log(power @ weight + 1e-6)
    return n, -(-n // 64), bands


def test_feature_against_plain_sums(spark):
    texts = ["", "a b c", "word " * 60, "".join(chr(33 + (i * i) % 90) for i in range(6000)), "x" * 3000 + "Hello, world! " * 200]
    clips = audio.as_audio(spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string"), F.encode("t", "UTF-8"))
    for r in audio.patch_features(clips).collect():
        text = texts[r["doc_id"]].encode()
        n, count, bands = plain_feature(text + b" " * (-len(text) % 192 or (0 if text else 192)))
        assert (r["n_frames"], r["n_patches"]) == (n, count)
        assert r["band_means"] == pytest.approx(bands.mean(axis=0), abs=2e-3)


def test_patches_are_fixed_shape_tensors(spark):
    rows = audio.as_audio(spark.createDataFrame([(1, "a" * 30_000), (2, None)], "doc_id long, t string"), F.encode(F.coalesce("t", F.lit("")), "UTF-8")).collect()
    for r in rows:
        start, end, mel = audio.read_patches(bytes(r["patches"]))
        assert mel.shape == (-(-r["n_frames"] // audio.PATCH_FRAMES), audio.PATCH_FRAMES, audio.MELS)
        assert (end > start).all()
        assert (np.diff(start) > 0).all()
        assert (mel.reshape(-1, audio.MELS)[r["n_frames"] :] == 0).all()
        with pa.ipc.open_stream(bytes(r["patches"])) as stream:
            assert stream.schema.field("mel").type == pa.fixed_shape_tensor(pa.float32(), (audio.PATCH_FRAMES, audio.MELS), dim_names=("frame", "mel"))
    assert {len(audio.read_patches(bytes(r["patches"]))[0]) for r in rows if r["doc_id"] == 2} == {1}


def test_model_file_of_the_query_is_public():
    assert Q.model_path().endswith("piece_bpe_32k.model")


def test_a_map_places_records_that_came_later(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 50, F.lit("a b c")).otherwise(F.lit("later")).alias("text"))
    slot_map = sharding.new_map(sharding.records(docs.filter("doc_id < 50")), 5)
    assert slot_map.select("virtual_slot").distinct().count() == slot_map.count() >= sharding.N_SLOTS
    first = {r["id"]: (r["virtual_slot"], r["shard"]) for r in sharding.place(sharding.records(docs.filter("doc_id < 50")), slot_map).collect()}
    every = sharding.place(sharding.records(docs), slot_map).collect()
    assert len(every) == 200 and {r["shard"] for r in every} == set(range(5))
    assert all(first[r["id"]] == (r["virtual_slot"], r["shard"]) for r in every if r["id"] in first)


def test_a_map_of_other_slots_is_refused(spark):
    recs = sharding.records(spark.range(50).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")))
    with pytest.raises(Exception, match="the map has no slot"):
        sharding.place(recs, sharding.new_map(recs, 3).filter("virtual_slot % 2 = 0")).collect()
