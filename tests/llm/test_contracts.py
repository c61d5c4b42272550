"""The contract queries against plain Python on sf0.001 tables and on odd rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
import sentencepiece

from tidemark.llm import queries as Q

SF = "/root/testdata/sf0.001"
TEXT = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "a b c d e f g h i j k l", "id", "x", 1),
    (1, "a b c d e f g h i j k l", "id", "x", 1),
    (None, None, None, None, None),
    (3, "", None, None, 0),
    (4, "  \n\t", "en", "y", 4),
    (5, "É Ü ß 漢字 \U0001f600 <s> </s> ▁▁ \x00 end  ", "en", "y", 4),
    (6, "word " * 30_000, "en", "y", 4),
]


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    docs = spark.createDataFrame([(*r, r[0], "clash") for r in ODD], TEXT + ", id long, window string")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "C d e F g, h i j k l"), (2, "漢字"), (3, None), (4, ""), (2, "漢字")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, "http://A.Example.com/en/7?x"), (1, "http://A.Example.com/en/7?x"), (2, None), (3, "no scheme"), (4, "x://net/de/"), (5, "ftp://example.net/de/8#q"), (6, "https://notcom/en/")], "page_id long, url string").write.parquet(f"{folder}/pages.parquet")
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", r"a\<s>[INST]"), (2, 0, "user", "hi"), (2, 1, None, None), (None, None, None, None), (3, 5, "a\nssistant", "x\n</s>"), (4, 0, "assistant", ""), (5, 0, "user", "hi"), (5, 1, "assistant", r"a\<s>[INST]")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name, schema in (("documents", TEXT), ("benchmark", "item_id long, text string"), ("pages", "page_id long, url string"), ("conversations", "conv_id long, turn long, role string, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module", params=["sf", "odd"])
def folder(request):
    return SF if request.param == "sf" else request.getfixturevalue("odd")


def table(spark, folder, name):
    return [r.asDict() for r in spark.read.parquet(f"{folder}/{name}.parquet").collect()]


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_sentencepiece(spark, folder):
    model = sentencepiece.SentencePieceProcessor(model_file=Q.model_path())
    expected = []
    for d in table(spark, folder, "documents"):
        ids = model.encode(d["text"] or "")
        expected.append((d["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))))
    assert rows(Q.op4_sentencepiece(spark, folder), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected, key=repr)


def test_audio(spark, folder):
    expected = []
    for d in table(spark, folder, "documents"):
        raw = (d["text"] or "").encode()
        padded = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
        expected.append((d["doc_id"], len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]), len(padded) + 44))
    got = Q.op5_audio(spark, folder)
    assert rows(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes") == sorted(expected, key=repr)
    by_text = defaultdict(set)
    for r in got.collect():
        by_text[r["payload_sha256"]].add((r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by_text.values())


def norm(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_decontaminate(spark, folder):
    windows = defaultdict(set)
    for b in table(spark, folder, "benchmark"):
        w = norm(b["text"])
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[i : i + k])].add(str(b["item_id"]))
    expected = []
    for d in table(spark, folder, "documents"):
        w, hit, items = norm(d["text"]), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if found := windows.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    items |= found
        expected.append((d["doc_id"], len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)))
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(Q.op6_decontaminate(spark, folder), *cols) == sorted(expected, key=repr)
    from tidemark.llm import decontaminate

    docs, bench = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark"))
    joined = decontaminate.scan(docs, bench, max_set=0)
    assert sorted(((r["doc_id"], len(r["hit_words"]), len(r["items"])) for r in joined.collect()), key=repr) == sorted(((e[0], e[2], e[3]) for e in expected), key=repr)


def test_sharding(spark, folder):
    got = [r.asDict() for r in Q.op7_sharding(spark, folder).collect()]
    docs = table(spark, folder, "documents")
    key = lambda i, text: (i, len((text or "").encode()) + 8, zlib.crc32((text or "").encode()))
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == sorted((key(d["doc_id"], d["text"]) for d in docs), key=repr)
    slots = defaultdict(list)
    load = dict.fromkeys(range(24), 0)
    for r in got:
        assert 0 <= r["shard"] < 24
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    if len(docs) > 100:
        assert max(load.values()) < 1.1 * sum(load.values()) / 24 + max(r["size"] for r in got)


def test_urls(spark, folder):
    expected = []
    for p in table(spark, folder, "pages"):
        host = path = ""
        if p["url"] and "://" in p["url"]:
            rest = p["url"].split("://", 1)[1]
            host = re.match("[^/?#]*", rest)[0]
            path = re.match("[^?#]*", rest[len(host) :])[0]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + q), h + q, v) for h, q, v in Q.RULES if (host == h or host.endswith("." + h)) and path.startswith(q)]
        best = max(fits, default=(0, None, "allow"))
        expected.append((p["page_id"], host, path, best[1], best[2]))
    assert rows(Q.op8_urls(spark, folder), "page_id", "host", "path", "rule", "verdict") == sorted(expected, key=repr)


def test_chat(spark, folder):
    said = "</s>[INST] ok [/INST]"
    convs = defaultdict(list)
    for c in [*table(spark, folder, "conversations"), {"conv_id": -1, "turn": 0, "role": "user", "text": said}, {"conv_id": -1, "turn": 1, "role": "assistant", "text": said}]:
        convs[c["conv_id"]].append((c["turn"] if c["turn"] is not None else -1, c["role"] or "", c["text"] or ""))
    expected = []
    for i, turns in convs.items():
        turns.sort()
        lost = "".join(t for _, r, t in turns if r == "assistant")
        expected.append((i, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(lost), sha(lost)))
    assert rows(Q.op9_chat(spark, folder), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == sorted(expected, key=repr)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_empty_tables(spark, empty, name):
    found = Q.QUERIES[name](spark, empty).count()
    assert found == (1 if name.startswith("op9_") else 0)
