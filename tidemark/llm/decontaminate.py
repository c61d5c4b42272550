"""Benchmark decontamination by a hash set of n-grams (operator 6), in DataFrame functions only.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.
Each document hashes its windows of ``n`` words; windows whose hash is in the
set of benchmark windows are compared as text with the benchmark (which settles
collisions), and the words that they cover are hit.  An item of fewer than ``n``
words is one window of its own length.

The set is broadcast as a literal set while the benchmark has at most ``MAX_SET``
distinct windows, and so are these windows' texts, without their items.  A larger
benchmark is broadcast as a bitmap of its hashes (2^20 words of 64 bits at most);
hashes and places of the document windows that pass it meet the benchmark's hashes
in a shuffled join, and only windows that this leaves are cut as text, with the same
results.  Items, of which any number may share a window, are joined to the windows
that were hit.  With a literal set documents are scanned once, and the windows that
passed are a stored table; with a bitmap their words are stored and read twice.

* null or empty text: no words, no hits; items without words never occur
* repeated rows and ids: one output row for each input row; an item_id used
  twice counts once
* an empty benchmark: nothing is hit
* an empty table: no rows; very long texts: a document's words are one array, and one
  task counts its hits
* columns other than the named ones are not read, whatever their names
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import stored, unused

N = 10
MAX_SET = 100_000
#: Leading bits of a hash that choose a word of the bitmap.
WORD_BITS = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case, everything else unchanged; pure ASCII takes the faster function."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAP), "")


def _at(words: Column, i: Column, n: int) -> Column:
    return F.slice(words, i, F.lit(n))


def item_windows(benchmark: DataFrame, n: int = N, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item_id, n_words, window, hash)``: the windows of every item."""
    items = benchmark.select(benchmark[item_col].cast("string").alias("item_id"), words_of(benchmark[text_col]).alias("words")).filter("size(words) > 0")
    size = F.least(F.size("words"), F.lit(n))
    cut = F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda i: F.slice("words", i, size))
    return items.select("item_id", size.alias("n_words"), F.explode(cut).alias("w")).select("item_id", "n_words", F.array_join("w", " ").alias("window"), F.xxhash64("w").alias("hash"))


def _bitmap(hash_: Column) -> tuple[Column, Column]:
    """The word of the bitmap that a hash falls in, by its leading bits, and its bit there, by its last six."""
    return F.shiftrightunsigned(hash_, 64 - WORD_BITS), F.pmod(hash_, F.lit(64)).cast("int")


def _met_by_bitmap(rows: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """``(row, at, hash, k, window)`` of the windows of stored ``rows`` (row, words, n_words) that the benchmark has."""
    hashed = lambda k: F.transform(F.sequence(F.lit(1), F.col("n_words") - (k - 1)), lambda i: F.struct((i - 1).alias("at"), F.xxhash64(_at(F.col("words"), i, k)).alias("hash"), F.lit(k).alias("k")))
    none = F.array().cast("array<struct<at:int,hash:bigint,k:int>>")
    word, bit = _bitmap(F.col("hash"))
    bits = windows.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b")).groupBy("word").agg(F.bit_or("b").alias("bits"))
    every = rows.select("row", F.explode(F.concat(none, *(F.when(F.col("n_words") >= k, hashed(k)).otherwise(none) for k in lengths))).alias("x")).select("row", "x.*")
    passed = every.withColumn("word", word).join(F.broadcast(bits), "word").filter(F.getbit("bits", bit) == 1).select("row", "at", "hash", "k")
    possible = passed.join(windows.select("hash", "k").distinct(), ["hash", "k"], "left_semi").groupBy("row").agg(F.collect_list(F.struct("at", "hash", "k")).alias("places"))
    cut = F.transform("places", lambda x: F.struct(x["at"].alias("at"), x["hash"].alias("hash"), x["k"].alias("k"), F.array_join(F.slice("words", x["at"] + 1, x["k"]), " ").alias("window")))
    return rows.join(possible, "row").select("row", F.explode(cut).alias("x")).select("row", "x.*").join(windows, ["hash", "window", "k"])


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", max_set: int = MAX_SET) -> DataFrame:
    """``(id, n_words, hit_words array<int>, items array<string>)`` of every row: positions from 0, item ids sorted."""
    listed = stored(item_windows(benchmark, n, item_col, text_col).distinct(), "windows")
    windows = listed.select("hash", "window", F.col("n_words").alias("k")).distinct()
    sizes = {r[0]: r[1] for r in windows.groupBy("k").agg(F.count("*")).collect()}  # one number for each length
    small = sum(sizes.values()) <= max_set
    hashes: dict[int, list[int]] = {}
    if small:
        for k, value in windows.select("k", "hash").distinct().collect():
            hashes.setdefault(k, []).append(value)

    base = docs.select(docs[id_col].alias("id"), words_of(docs[text_col]).alias("words")).withColumn("n_words", F.size("words"))

    def found(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.col("n_words") - (k - 1))
        hashed = F.transform(starts, lambda i: F.struct(i.alias("at"), F.xxhash64(_at(F.col("words"), i, k)).alias("hash")))
        kept = F.filter(hashed, lambda x: x["hash"].isin(hashes[k]))
        out = F.transform(kept, lambda x: F.struct((x["at"] - 1).alias("at"), x["hash"].alias("hash"), F.lit(k).alias("k"), F.array_join(_at(F.col("words"), x["at"], k), " ").alias("window")))
        return F.when(F.col("n_words") >= k, out).otherwise(F.array().cast("array<struct<at:int,hash:bigint,k:int,window:string>>"))

    numbered = base.withColumn("row", F.monotonically_increasing_id())
    if small:
        none = F.array().cast("array<struct<at:int,hash:bigint,k:int,window:string>>")
        seen = stored(numbered.select("row", "id", "n_words", (F.concat(*map(found, sorted(sizes))) if sizes else none).alias("found")), "seen")
        met = stored(seen.select("row", F.explode("found").alias("x")).select("row", "x.*").join(F.broadcast(windows), ["hash", "window", "k"]), "hits")
    else:
        seen = stored(numbered, "seen")
        met = stored(_met_by_bitmap(seen, windows, sorted(sizes)), "hits")
    hits = met.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("at"), F.col("at") + F.col("k") - 1))))).alias("hit_words"))
    owned = listed.select("hash", "window", F.col("n_words").alias("k"), "item_id")
    items = met.select("row", "hash", "window", "k").distinct().join(owned, ["hash", "window", "k"]).groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    judged = seen.select("row", "id", "n_words").join(hits.join(items, "row"), "row", "left")
    return judged.select(F.col("id").alias(id_col), "n_words", F.coalesce("hit_words", F.array().cast("array<int>")).alias("hit_words"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, max_share: float = 0.0, **names) -> DataFrame:
    """Rows whose share of hit words is at most ``max_share``, with all their columns; each is judged by its own text, whatever its id."""
    (row,) = unused(docs.columns, "row")
    own = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    bad = scan(own, benchmark, id_col=row, **names).filter(F.size("hit_words") > F.lit(max_share) * F.col("n_words")).select(row)
    return own.join(bad, row, "left_anti").select(*(f"`{c}`" for c in docs.columns))
