"""Mixing sources to target weights (operator 13), in DataFrame functions only.

Each source's documents are laid in an order by digest, as one sequence of words that the mix reads from its start and, at
its end, once more.  What a source gives is a number of words, rounded from its target, cut into blocks of ``block_words``.
A splitting tree says how many blocks of each source every shard gets: a node's exact quotas are divided between its two
halves of the shards by one draw of the multivariate hypergeometric distribution, so shards are of equal size and the quotas
of each source add up.  A shard takes its quota of a source's permuted blocks, and these are permuted again inside the shard.

No task sees a whole source: words and blocks are counted in buckets by digest, and running sums over the buckets' counts
shift the places inside them.  One row holds a number for each source and two shards (the splitting tree's nodes), whatever
the number of documents.  Draws come from SHA-256 and the seed, so a rerun gives the same mix.

* null text: no words; a document without words is in no block
* null source: a source like any other, the last one; sources are in the order of code points
* repeated rows and repeated or null ids: every row is a document; equal rows may change places with each other
* an empty table, or one without words: targets of zero and no blocks
* very long texts lie in several blocks; other columns are not read, whatever their names
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import stored

#: Weights of the sources in their order, repeating, and what they share, as parts of a hundred of all sizes.
WEIGHTS = (3, 1, 2)
SHARE = 150
#: How often a document is taken at most.
MOST = 2
SHARDS = 64
BLOCK_WORDS = 1024
#: Leading hex digits of a digest that make its bucket.
BUCKET_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"

_ROWS = Window.unboundedPreceding


def documents(docs: DataFrame, seed: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(row, id, source, size, digest)`` of every row, stored: texts are read once, and a row's number stays."""
    text = F.coalesce(docs[text_col], F.lit(""))
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(docs[id_col].cast("string"), F.lit("")), text), 256)
    rows = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), digest.alias("digest"))
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "mix-rows")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size), one row a source, with ``src``, ``weight`` and ``target``.

    All targets together are ``share`` hundredths of all sizes, in the ratio of the weights, but none is over ``most`` times
    its source's size.  A source reaches that bound exactly if the rest, shared by weight among it and all sources that are
    further from theirs, would be more: one running sum in the order of size over weight.
    """
    listed = F.array(*(F.lit(w) for w in weights))
    order = Window.orderBy(F.asc_nulls_last("source"))
    numbered = sources.withColumn("src", F.row_number().over(order) - 1).withColumn("weight", F.get(listed, F.col("src") % len(weights)).cast("decimal(19,0)"))
    big = F.col("source_size").cast("decimal(19,0)")
    nearest = Window.orderBy((F.col("source_size") / F.col("weight")), "src")
    before, every = nearest.rowsBetween(_ROWS, -1), Window.partitionBy()
    summed = numbered.select(
        "*",
        (share * F.sum(big).over(every) - 100 * most * F.coalesce(F.sum(big).over(before), F.lit(0))).cast("decimal(28,0)").alias("left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("decimal(10,0)").alias("weights"),
    )
    summed = summed.withColumn("full", 100 * most * big * F.col("weights") <= F.col("left") * F.col("weight"))
    free = F.struct("left", "weights")
    shared = F.min(F.when(~F.col("full"), F.struct((-F.col("left")).alias("o"), free.alias("free")))).over(every)["free"]
    # The first source that is not full has the most left over; all after it share the same.
    rest = (shared["left"] * F.col("weight")).cast("double") / (100 * shared["weights"]).cast("double")
    target = F.when(F.col("full"), F.col("source_size").cast("double") * most).otherwise(rest)
    return summed.withColumn("target", target).select("source", "source_size", "src", F.col("weight").cast("int").alias("weight"), "target")


def _places(rows: DataFrame, by: str, digest: str, ties: list[Column], amount: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``amount`` over the rows of their ``by`` before them, by ``digest``, then ``ties``.

    Sums of buckets by digest come first, so that what a task has is a bucket of one ``by``.
    """
    cut = rows.withColumn("__b", F.substring(digest, 1, BUCKET_DIGITS)).withColumn("__a", amount)
    sums = cut.groupBy(by, "__b").agg(F.sum("__a").alias("__s"))
    upto = Window.partitionBy(by).orderBy("__b").rowsBetween(_ROWS, -1)
    shifts = sums.select(by, "__b", F.coalesce(F.sum("__s").over(upto), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(by, "__b").orderBy(digest, *ties).rowsBetween(_ROWS, -1)
    placed = cut.withColumn("__in", F.coalesce(F.sum("__a").over(inside), F.lit(0)))
    return placed.join(shifts, [by, "__b"]).withColumn(name, F.col("__before") + F.col("__in")).drop("__a", "__b", "__in", "__before")


def laid_out(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with their source's columns, ``start``, the words of the source before them, and ``quota``, the words that the source gives."""
    # Null sources are equal here; the table of sources is one row a source.
    known = sources.withColumnRenamed("source", "__source")
    joined = rows.join(known, rows["source"].eqNullSafe(known["__source"])).drop("__source")
    placed = _places(joined, "src", "digest", [F.col("row")], F.col("size"), "start")
    return placed.withColumn("quota", F.floor(F.col("target") + 0.5).cast("long"))


def segments(placed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(src, block, row, id, from_word, words)``: what each block takes of each document, in the order of ``at``."""
    size, quota, whole = F.col("size"), F.col("quota"), F.col("source_size")
    times = F.when(size > 0, F.sequence(F.lit(0), F.lit(MOST - 1))).otherwise(F.array().cast("array<int>"))
    read = placed.withColumn("turn", F.explode(times)).withColumn("begin", F.col("start") + F.col("turn") * whole)
    read = read.withColumn("end", F.least(F.col("begin") + size, quota)).filter("begin < end")
    first, last = F.expr(f"begin div {block_words}"), F.expr(f"(end - 1) div {block_words}")
    cut = read.select("src", "row", "id", "begin", "end", F.explode(F.sequence(first, last)).alias("block"))
    low, high = F.greatest("begin", F.col("block") * block_words), F.least("end", (F.col("block") + 1) * block_words)
    return cut.select("src", "block", "row", "id", (low - F.col("begin")).alias("from_word"), (high - low).alias("words"), low.alias("at"))


def _log_factorial(n: Column) -> Column:
    """Stirling's series at n + 8, less the logarithms of the eight factors between."""
    z = n + 8
    series = z * F.log(z) - z + 0.5 * F.log(2 * 3.141592653589793 * z) + 1 / (12 * z) - 1 / (360 * z * z * z)
    return series - F.log(reduce(lambda a, k: a * (n + k), range(2, 9), n + 1))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hypergeometric(marked: Column, others: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` out of ``marked + others`` are marked: the inverse distribution at ``u`` (0 to 1), for doubles.

    Probabilities are taken relative to the mode's over ten and eight standard deviations to each side, or all that is
    possible; what lies beyond is less than the precision of ``u``.
    """

    def bounds(p: Column) -> Column:
        total = p["marked"] + p["others"]
        some, rest = F.greatest(total, F.lit(1.0)), F.greatest(total - 1, F.lit(1.0))
        spread = F.sqrt(p["drawn"] * (p["marked"] / some) * (p["others"] / some) * ((total - p["drawn"]) / rest))
        least, most = F.greatest(F.lit(0.0), p["drawn"] - p["others"]), F.least(p["marked"], p["drawn"])
        mode = F.greatest(least, F.least(most, F.floor((p["drawn"] + 1) * (p["marked"] + 1) / (total + 2)).cast("double")))
        return F.struct(least.alias("least"), most.alias("most"), mode.alias("mode"), F.ceil(8 * spread + 10).cast("double").alias("reach"))

    def log_weight(p: Column, x: Column) -> Column:
        return -(_log_factorial(x) + _log_factorial(p["marked"] - x) + _log_factorial(p["drawn"] - x) + _log_factorial(p["others"] - p["drawn"] + x))

    def found(p: Column, b: Column, top: Column) -> Column:
        low, high = F.greatest(b["least"], b["mode"] - b["reach"]), F.least(b["most"], b["mode"] + b["reach"])
        weights = F.transform(F.sequence(low.cast("long"), high.cast("long")), lambda x: F.exp(_let(x.cast("double"), lambda y: log_weight(p, y)) - top))

        def chosen(w: Column) -> Column:
            start = F.struct((p["u"] * F.aggregate(w, F.lit(0.0), lambda a, y: a + y)).alias("left"), low.alias("x"))
            # As long as the weight of x fits under what is left of u, go on to the next x.
            step = lambda a, y: F.when(a["left"] < 0, a).otherwise(F.struct((a["left"] - y).alias("left"), F.when(a["left"] >= y, a["x"] + 1).otherwise(a["x"]).alias("x")))
            return F.least(F.aggregate(w, start, step)["x"], high)

        return F.when(low >= high, low).otherwise(_let(weights, chosen))

    given = F.struct(marked.alias("marked"), others.alias("others"), drawn.alias("drawn"), u.alias("u"))
    return _let(given, lambda p: _let(bounds(p), lambda b: _let(log_weight(p, b["mode"]), lambda top: found(p, b, top))))


def _uniform(*parts: Column) -> Column:
    """A number from 0 to 1 by SHA-256 of ``parts``."""
    digits = F.substring(F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def split_quotas(quotas: DataFrame, shards: int, seed: str) -> DataFrame:
    """``(shard, src, quota)`` from ``quotas`` (src, blocks): blocks of each source for every shard, whose totals are at most one apart.

    A node of the tree is one row with its shards ``low`` to ``high`` and its quotas, an array by source; the root has all.
    """
    pairs = F.array_sort(F.collect_list(F.struct("src", F.col("blocks").cast("double").alias("n"))))
    nodes = quotas.agg(pairs.alias("quotas"), F.sum("blocks").cast("double").alias("all")).filter("all is not null").select(F.lit(0).alias("low"), F.lit(shards).alias("high"), "quotas", "all", F.col("all").alias("total"))

    def capacity(low: Column, high: Column) -> Column:
        """Blocks of the shards from ``low`` to ``high``: an equal share each, and one more for the first ones."""
        share = F.floor(F.col("all") / shards)
        more = F.col("all") - share * shards
        return (share * (high - low) + F.least(F.greatest(more - low, F.lit(0)), high - low)).cast("double")

    def draw(acc: Column, q: Column) -> Column:
        x = hypergeometric(q["n"], acc["population"] - q["n"], acc["drawn"], _uniform(F.lit(seed), F.col("low"), F.col("high"), q["src"]))
        put = lambda n: F.struct((acc["population"] - q["n"]).alias("population"), (acc["drawn"] - n).alias("drawn"), F.concat(acc["out"], F.array(F.struct(q["src"].alias("src"), n.alias("n")))).alias("out"))
        return _let(x, put)

    middle = F.expr("(low + high) div 2").cast("int")
    start = F.struct(F.col("total").alias("population"), capacity(F.col("low"), F.col("mid")).alias("drawn"), F.array().cast("array<struct<src:int,n:double>>").alias("out"))
    left = F.aggregate("quotas", start, draw)["out"]
    rest = F.zip_with("quotas", "left", lambda q, x: F.struct(q["src"].alias("src"), (q["n"] - x["n"]).alias("n")))
    part = lambda low, high, q, n: F.struct(low.alias("low"), high.alias("high"), q.alias("quotas"), n.alias("total"))
    halves = F.array(part(F.col("low"), F.col("mid"), F.col("left"), capacity(F.col("low"), F.col("mid"))), part(F.col("mid"), F.col("high"), rest, capacity(F.col("mid"), F.col("high"))))
    whole = F.array(part(F.col("low"), F.col("high"), F.col("quotas"), F.col("total")))
    for _ in range((shards - 1).bit_length()):
        halved = nodes.withColumn("mid", middle).withColumn("left", left)
        nodes = halved.select("all", F.explode(F.when(F.col("high") - F.col("low") > 1, halves).otherwise(whole)).alias("x")).select("x.low", "x.high", "x.quotas", "all", "x.total")
    return nodes.select(F.col("low").alias("shard"), F.explode("quotas").alias("q")).select("shard", "q.src", F.col("q.n").cast("long").alias("quota"))


def deal(blocks: DataFrame, shards: int = SHARDS, seed: str = "mix") -> DataFrame:
    """``blocks`` (src, block) with ``shard`` and ``place_key``, whose order inside a shard is the shuffled one.

    A source's blocks are ranked by digest; the splitting tree's quotas cut the ranks into one range a shard.
    """
    marked = blocks.withColumn("digest", F.sha2(F.concat_ws(":", F.lit(f"{seed}:block"), "src", "block"), 256))
    ranked = _places(marked, "src", "digest", [F.col("block")], F.lit(1), "nth")
    quotas = stored(split_quotas(blocks.groupBy("src").agg(F.count("*").alias("blocks")), shards, seed), "mix-quotas")
    upto = Window.partitionBy("src").orderBy("shard").rowsBetween(_ROWS, Window.currentRow)
    ends = quotas.withColumn("end", F.sum("quota").over(upto)).groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "end"))), lambda x: x["end"]).alias("ends"))
    shard = F.size(F.filter("ends", lambda e: e <= F.col("nth")))
    key = F.sha2(F.concat_ws(":", F.lit(f"{seed}:place"), "src", "block"), 256)
    return ranked.join(ends, "src").select("src", "block", shard.alias("shard"), key.alias("place_key"))


def mix(docs: DataFrame, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The placed documents, and the segments of the mix: ``(shard, place_key, at, src, block, row, id, from_word, words)``.

    A shard is read in the order of (place_key, at); ``from_word`` counts the document's words from 0.
    """
    rows = documents(docs, seed, id_col, text_col, source_col)
    sources = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-sources")
    placed = stored(laid_out(rows, sources), "mix-placed")
    cut = stored(segments(placed, block_words), "mix-segments")
    # A block is there once as the segment that has its first word.
    blocks = cut.filter(F.col("at") % block_words == 0).select("src", "block")
    dealt = deal(blocks, shards, seed)
    return placed, cut.join(dealt, ["src", "block"]).select("shard", "place_key", "at", "src", "block", "row", "id", "from_word", "words")


def write_mix(mixed: DataFrame, path: str) -> None:
    """Segments as Parquet, one folder a shard, each file in reading order."""
    ordered = mixed.repartitionByRange("shard", "place_key", "at").sortWithinPartitions("shard", "place_key", "at")
    ordered.write.partitionBy("shard").parquet(path)


def taken(placed: DataFrame, mixed: DataFrame) -> DataFrame:
    """Every document with ``taken``, its words in the mix, repeats counted."""
    counts = mixed.groupBy("row").agg(F.sum("words").alias("taken"))
    return placed.join(counts, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
