"""The registered queries of this subpackage, each over its whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import audio, chat, collocations, decontaminate, lines, mixing, phrases, pieces, prefix_trie, sharding, simhash, toxicity, urls
from tidemark.sources.shared import shared_path

PIECE_MODEL = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def model_path(name: str = PIECE_MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.remove_repeated_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.col("longest_run").cast("long").alias("longest_run"), _sha256(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


#: Places of equal lines pair up; on one diagonal, pairs that follow each other are a run that the later place repeats.
OP1_SQL = """
WITH d AS (
  SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL
), parts AS (
  SELECT doc_id, p, l[p] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS p FROM d)
), pairs AS (
  SELECT a.doc_id AS d1, b.doc_id AS d2, b.p - a.p AS diagonal, b.p AS p FROM parts a JOIN parts b ON a.line = b.line AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.p < b.p))
), islands AS (
  SELECT d2, p, d1, diagonal, p - row_number() OVER (PARTITION BY d1, d2, diagonal ORDER BY p) AS island FROM pairs
), runs AS (
  SELECT d2 AS doc_id, min(p) AS start, count(*) AS k FROM islands GROUP BY d1, d2, diagonal, island HAVING count(*) >= 2
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start, start + k)) AS p FROM runs
), longest AS (
  SELECT doc_id, max(k) AS longest_run FROM runs GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS text, count(*) AS n FROM parts ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT o.doc_id AS doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(l), 0) - coalesce(n, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(longest_run, 0) AS BIGINT) AS longest_run, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents o LEFT JOIN d USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN longest USING (doc_id)
"""


def held_out(key: Column) -> Column:
    """Rows whose labels no model may see."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), ~held_out(F.col("id")), whole=True)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.col("up").alias("evidence"))


def op3_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = phrases.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", _sha256(F.col("kept")).alias("kept_sha256"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_decode(_table(spark, sf_dir, "documents"), model_path())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), _sha256(F.concat_ws(",", F.col("ids").cast("array<string>"))).alias("ids_sha256"), _sha256(F.col("decoded")).alias("decoded_sha256"))


def op5_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = audio.as_audio(_table(spark, sf_dir, "documents"), F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    # The feature comes from the stored tensors and segments, read back.
    clips = audio.patch_features(clips)
    bands = F.array_join(F.transform("band_means", lambda m: F.round(m, 3).cast("string")), ";")
    size = F.length("payload")
    return clips.withColumn("payload", audio.stored_payload(F.col("media"))).select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substr("payload", size - 15, F.lit(16))).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws("|", F.col("n_frames").cast("string"), F.col("n_patches").cast("string"), F.size("segments").cast("string"), bands).alias("feature"),
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit_words").cast("long")
    return marks.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        _sha256(F.array_join("items", ",")).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP6_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (
    SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM (
    SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)
), h AS (
  SELECT doc_id, item_id, i, k FROM dw JOIN bw USING (k, win)
), pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = sharding.records(_table(spark, sf_dir, "documents"))
    maps = shared_path(spark, "slot-maps")
    sharding.save_map(sharding.new_map(recs, 24), maps)
    placed = sharding.place(recs, sharding.load_map(spark, maps))
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


#: The listed entries that the query's contract gives.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urls.filter_urls(_table(spark, sf_dir, "pages"), rules)


OP8_SQL = """
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages
), r(rhost, rpath, v) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), u AS (SELECT DISTINCT host, path FROM p), m AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(v, length(rhost || rpath)) AS v
  FROM u, r WHERE (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath) GROUP BY host, path
)
SELECT page_id, p.host AS host, p.path AS path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path
"""


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    convs = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.read_back(chat.pack(convs))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        _sha256(spoken).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        _sha256(F.col("loss_text")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = prefix_trie.rebuilt(prefix_trie.conversations(_table(spark, sf_dir, "conversations")))
    nodes = prefix_trie.shared_prefixes(prefix_trie.paths(convs))
    return nodes.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: Nodes are prefixes themselves; CRC-32 goes bit by bit.
OP11_SQL = r"""
WITH turns AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), crc AS (
  SELECT conv_id, t, conv_id - conv_id % 100 AS base, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT),
    lambda crc, byte: list_reduce([xor(crc, byte)] || range(8), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT) % 6 AS h FROM turns
), rebuilt AS (
  SELECT c.conv_id, coalesce(b.t[1:c.h], []) || c.t[c.h + 1:] AS t FROM crc c LEFT JOIN turns b ON b.conv_id = c.base
), prefixes AS (
  SELECT conv_id, len(t) AS whole, d, t[1:d] AS p FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT d, p, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE whole = d), '')) AS ends,
    (count(*) - 1) * coalesce(length(p[d].text), 0) AS saved FROM prefixes GROUP BY d, p
), kids AS (
  SELECT a.d, a.p, a.conv_id, count(b.d) AS k FROM nodes a LEFT JOIN nodes b ON b.d = a.d + 1 AND b.p[1:b.d - 1] = a.p GROUP BY ALL
), above AS (SELECT n.d, n.p, unnest(range(0, n.d + 1)) AS u, saved, k FROM nodes n JOIN kids USING (d, p)
), below AS (SELECT u, p[1:u] AS q, CAST(sum(saved) AS BIGINT) AS saved, count(*) FILTER (WHERE k = 0) AS leaves FROM above GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n AS n_convs, k.k AS n_children, b.leaves AS n_leaves, b.saved AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN kids k ON k.d = n.d AND k.p = n.p JOIN below b ON b.u = n.d AND b.q = n.p LEFT JOIN nodes up ON up.d = n.d - 1 AND up.p = n.p[1:n.d - 1] AND n.d > 0
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), grams AS (
  SELECT lang, w[i:i + k - 1] AS p FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 6) o(k) WHERE len(w) >= k)
), f AS (SELECT lang, p, count(*) AS f FROM grams GROUP BY lang, p HAVING count(*) >= 100
), totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang
), cuts AS (
  SELECT c.lang, c.p, c.f AS a, k, x.f AS l, y.f AS r, n, (1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, len(p))) AS k FROM f WHERE len(p) > 1) c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1:] JOIN totals t ON t.lang = c.lang
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), inside AS (
  SELECT DISTINCT lang, p[i:i + k - 1] AS p, f FROM (SELECT lang, p, f, k, unnest(range(1, len(p) - k + 2)) AS i FROM f, range(2, 5) o(k) WHERE len(p) > k)
), kept AS (
  SELECT b.* FROM best b WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.p = b.p AND 100 * i.f >= 100 * b.a)
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM (
  SELECT *, array_to_string(p, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM kept) WHERE rank <= 2000
"""


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixing.taken(placed, mixed).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


#: A source is full if the share isn't spent at the level where it becomes full, each other source taking that level or its bound.
OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    sha256('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS digest FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS HUGEINT) AS whole, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source
), w AS (SELECT *, CASE (i - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s
), full_ones AS (
  SELECT a.i FROM w a, w b GROUP BY a.i, a.whole, a.w HAVING 3 * sum(b.whole) * a.w >= 2 * sum(least(2 * b.whole * a.w, 2 * a.whole * b.w))
), rest AS (
  SELECT 3 * sum(whole) - 4 * coalesce(sum(whole) FILTER (WHERE i IN (SELECT i FROM full_ones)), 0) AS spare, sum(w) FILTER (WHERE i NOT IN (SELECT i FROM full_ones)) AS weights FROM w
), t AS (
  SELECT source, whole, CASE WHEN i IN (SELECT i FROM full_ones) THEN 2 * CAST(whole AS DOUBLE) ELSE CAST(spare * w AS DOUBLE) / CAST(2 * weights AS DOUBLE) END AS target FROM w, rest
), p AS (
  SELECT d.*, whole, target, CAST(floor(target + 0.5) AS HUGEINT) AS quota, sum(size) OVER (PARTITION BY d.source ORDER BY digest ROWS UNBOUNDED PRECEDING) - size AS begin
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, CAST(whole AS BIGINT) AS source_size, target,
  CAST(greatest(0, least(begin + size, quota) - begin) + greatest(0, least(begin + whole + size, quota) - begin - whole) AS BIGINT) AS taken FROM p
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lines": op1_lines,
    "op2_toxicity": op2_toxicity,
    "op3_phrases": op3_phrases,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_audio": op5_audio,
    "op6_decontaminate": op6_decontaminate,
    "op7_sharding": op7_sharding,
    "op8_urls": op8_urls,
    "op9_chat": op9_chat,
    "op10_simhash": op10_simhash,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_collocations": op12_collocations,
    "op13_mixing": op13_mixing,
}
ORACLE_SQL: dict[str, str] = {"op1_lines": OP1_SQL, "op6_decontaminate": OP6_SQL, "op8_urls": OP8_SQL, "op11_prefix_trie": OP11_SQL, "op12_collocations": OP12_SQL, "op13_mixing": OP13_SQL}
