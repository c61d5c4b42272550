"""Phrase collocation mining by top-order marginalisation (operator 12).

Every word leads one window of the longest order, ``LONGEST`` words, padded with nulls where its piece ends.  Only these windows
are counted, by Spark, as columns; a ROLLUP over the columns then sums them into the counts of all shorter phrases, which are
their prefixes.  No order below the longest is ever formed from the texts.

Words are 64-bit hashes until the end.  That no two words of a language share one is checked over the whole vocabulary, and
another seed is taken if two do, so counts are those of the words themselves.

A window is padded earlier where no candidate can go on: before n-grams that occur fewer than ``LEAST`` times whatever
language and text they are in.  That is told by a sketch of 2^``SKETCH_BITS`` counters, each the sum of the n-grams that
hash to it and so never below the count of one: first for pairs, then for the longer n-grams whose pairs have passed.  As
bits (16 MB at any size of the input) it is broadcast.  Where a corpus fills the sketch, fewer windows are padded early and
more are shuffled, with the same result.

* null text: no words; null language: ``und``, like a language of that name
* pieces end at any of ``.,;:!?`` and at line breaks; words are what lies between spaces and tabs; only A-Z are lower-cased
* repeated rows and repeated or null ids: every row's words count; ids are not read
* an empty table: no rows; very long texts are read whole, a megabyte of texts at a time
* columns other than the two named ones are not read, whatever their names
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import _text
from tidemark.sources.shared import stored

LONGEST = 5
#: Least count of a candidate.
LEAST = 100
TOP = 2000
SKETCH_BITS = 27
SKETCH_PARTS = 64
#: N-grams that a task holds before it counts them, counters of a block of the sketch, and salts of the last ranking.
HELD, BLOCK_BITS, SALTS = 1 << 20, 15, 64
SEEDS = 4

_DELIMITER = np.zeros(256, bool)
_DELIMITER[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BETWEEN = _DELIMITER.copy()
_BETWEEN[[9, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Spans:
    """Words of a group of texts: their hashes with those of their languages, and how many words follow in the piece of each."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, langs: np.ndarray, seed: int) -> None:
        self.data = _LOWER[data]
        self.words = words = _text.Words(self.data, start, end, _BETWEEN)
        self.hash = _word_hashes(words, seed)
        n = len(self.hash)
        row = np.repeat(np.arange(len(start)), words.stop - words.begin)
        self.row = row
        self.lang = langs[row]
        piece = np.concatenate([[0], np.cumsum(_DELIMITER[data])])[words.start]
        same = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
        last = np.flatnonzero(np.append(~same, True)) if n else np.zeros(0, np.int64)
        self.after = last[np.searchsorted(last, np.arange(n))] - np.arange(n) if n else np.zeros(0, np.int64)

    def grams(self, order: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the ``order`` words from each of ``at`` on, with their language."""
        h = self.lang[at] + np.uint64(order)
        for k in range(order):
            h = _text.mix(h * _STEP + self.hash[at + k])
        return h

    def reach(self, bits: np.ndarray | None, orders: tuple[int, ...]) -> np.ndarray:
        """How many words after each can still belong to a candidate that it leads: as long as the n-grams of all ``orders`` pass."""
        reach = np.minimum(self.after, LONGEST - 1)
        if bits is None:
            return reach
        at = np.flatnonzero(self.after >= 1)
        pair = np.zeros(len(self.hash), bool)
        pair[at] = passes(bits, self.grams(2, at))
        bad = np.flatnonzero(~pair)
        nearest = np.append(bad, len(pair))[np.searchsorted(bad, np.arange(len(pair)))]
        reach = np.minimum(reach, nearest - np.arange(len(pair)))
        for order in (o for o in orders if o > 2):
            at = np.flatnonzero(reach >= order - 1)
            stop = at[~passes(bits, self.grams(order, at))]
            reach[stop] = order - 2
        return reach


def _word_hashes(words: _text.Words, seed: int) -> np.ndarray:
    """Hashes of words whose bytes stand for other values with each seed."""
    values = _text.mix(np.arange(256, dtype=np.uint64) + np.uint64(256 * (seed + 1)))
    out = np.empty(len(words.start), np.uint64)
    i = 0
    while i < len(out):
        j = max(i + 1, int(np.searchsorted(words.end, words.start[i] + 8 * _text.WINDOW_WORDS_BYTES)))
        low, high = words.start[i], words.end[j - 1]
        out[i:j] = _text.range_hashes(values[words.data[low:high]], words.start[i:j] - low, words.end[i:j] - low)
        i = j
    return out


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _groups(batch: pa.RecordBatch, seed: int) -> Iterator[tuple[Spans, pa.Array]]:
    """Groups of a batch's rows (lang, text)."""
    names = batch.column(0).fill_null("und")
    coded = names.dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(x.encode(), seed) for x in coded.dictionary.to_pylist()], np.uint64)
    langs = hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(batch) else np.zeros(0, np.uint64)
    for low, high, data, start, end in _text.texts(batch.column(1)):
        yield Spans(data, start, end, langs[low:high], seed), names.slice(low, high - low)


def _longs(h: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(h).view(np.int64))


def vocabulary(docs: DataFrame, seed: int) -> DataFrame:
    """``(lang, h, word, n)``: every distinct word of each language, its hash and its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for spans, names in _groups(batch, seed):
                w = spans.words
                _, first, inverse, n = np.unique(spans.hash + spans.lang * _STEP, return_index=True, return_inverse=True, return_counts=True)
                # What a second hash tells apart from the first word of its key stands for itself.
                other = _word_hashes(w, seed + SEEDS) ^ spans.lang
                odd = np.flatnonzero(other != other[first][inverse])
                n = np.concatenate([n - np.bincount(inverse[odd], minlength=len(n)), np.ones(len(odd), np.int64)])
                first = np.concatenate([first, odd])
                offsets = np.empty(2 * len(w.start) + 1, np.int32)
                offsets[0:-1:2], offsets[1::2], offsets[-1] = w.start, w.end, w.end[-1] if len(w.end) else 0
                text = pa.StringArray.from_buffers(2 * len(w.start), pa.py_buffer(offsets), pa.py_buffer(spans.data.tobytes()))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(spans.row[first])), _longs(spans.hash[first]), text.take(pa.array(2 * first)), pa.array(n)], ["lang", "h", "word", "n"])

    return docs.mapInArrow(run, "lang string, h long, word string, n long").groupBy("lang", "h", "word").agg(F.sum("n").alias("n"))


def sketch(docs: DataFrame, seed: int, least: int, orders: tuple[int, ...], known: Broadcast | None, known_orders: tuple[int, ...]) -> np.ndarray:
    """Bits of the counters that reach ``least`` over all n-grams of ``orders``; ``known`` pads windows before.

    Tasks count up to HELD n-grams at a time into blocks of counters, of which only those above zero are sent; blocks
    are summed as they come.
    """

    def counted(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        slots, n = np.unique(np.concatenate(held) >> np.uint64(64 - SKETCH_BITS), return_counts=True)
        n = np.minimum(n, least).astype(np.uint8)
        block = (slots >> np.uint64(BLOCK_BITS)).astype(np.int64)
        inside = (slots & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.uint16)
        edges = np.flatnonzero(np.diff(block, prepend=-1))
        ends = np.append(edges[1:], len(block))
        yield pa.RecordBatch.from_arrays(
            [pa.array(block[edges].astype(np.int32)), pa.array([inside[a:b].tobytes() for a, b in zip(edges, ends, strict=True)], pa.binary()), pa.array([n[a:b].tobytes() for a, b in zip(edges, ends, strict=True)], pa.binary())],
            ["block", "slots", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        bits = None if known is None else known.value
        for batch in batches:
            for spans, _ in _groups(batch, seed):
                reach = spans.reach(bits, known_orders)
                for order in orders:
                    at = np.flatnonzero(reach >= order - 1)
                    held.append(spans.grams(order, at))
                    size += len(at)
                if size >= HELD:
                    yield from counted(held)
                    held, size = [], 0
        if size:
            yield from counted(held)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, slots, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total = totals.setdefault(block, np.zeros(1 << BLOCK_BITS, np.uint8))
                at = np.frombuffer(slots, np.uint16)
                total[at] = np.minimum(total[at].astype(np.uint16) + np.frombuffer(n, np.uint8), least)
        packed = {b: np.packbits(t >= least, bitorder="little").tobytes() for b, t in totals.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(packed), pa.int32()), pa.array(list(packed.values()), pa.binary())], ["block", "bits"])

    # A task has some of the 2^12 blocks, 32 KB each, whatever the number of rows that it reads.
    parts = docs.mapInArrow(run, "block int, slots binary, n binary").repartition(SKETCH_PARTS, "block")
    out = np.zeros(1 << (SKETCH_BITS - 3), np.uint8)
    size = 1 << (BLOCK_BITS - 3)
    found = parts.mapInArrow(summed, "block int, bits binary").toArrow()
    for block, bits in zip(found.column("block").to_pylist(), found.column("bits").to_pylist(), strict=True):
        out[block * size : (block + 1) * size] = np.frombuffer(bits, np.uint8)
    return out


def windows(docs: DataFrame, seed: int, known: Broadcast, orders: tuple[int, ...]) -> DataFrame:
    """``(lang, w1, .., w5)`` of every word that leads a window of two words or more, with nulls as padding."""
    columns = [f"w{k + 1}" for k in range(LONGEST)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for spans, names in _groups(batch, seed):
                reach = spans.reach(known.value, orders)
                at = np.flatnonzero(reach >= 1)
                lead = [pa.array(spans.hash[np.minimum(at + k, len(spans.hash) - 1)].view(np.int64), mask=reach[at] < k) for k in range(LONGEST)]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(spans.row[at])), *lead], ["lang", *columns])

    return docs.mapInArrow(run, "lang string, " + ", ".join(f"{c} long" for c in columns))


def phrase_counts(led: DataFrame, least: int = LEAST) -> DataFrame:
    """``(lang, p, f)``: phrases of two words or more, arrays of word hashes, that occur ``least`` times, from windows."""
    columns = [f"w{k + 1}" for k in range(LONGEST)]
    tops = led.groupBy("lang", *columns).agg(F.count("*").alias("f"))
    # Levels of the rollup drop columns from the last on; grouping_id() has a bit for each dropped one.
    levels = tops.rollup("lang", *columns).agg(F.grouping_id().alias("dropped"), F.sum("f").alias("f"))
    order = sum(F.when(F.col("dropped") == (1 << (LONGEST - k)) - 1, k).otherwise(0) for k in range(2, LONGEST + 1))
    found = levels.filter(F.col("f") >= least).select("lang", F.slice(F.array(*columns), 1, F.greatest(order, F.lit(1))).alias("p"), "f", order.alias("order"))
    # A padded prefix is a shorter phrase's window, not a phrase.
    return found.filter((F.col("order") >= 2) & ~F.exists("p", lambda x: x.isNull())).select("lang", "p", "f")


def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """``(lang, p, a, l, r, n, score)``: the lowest-scoring cut of each phrase, the earliest one of equal scores."""
    parts = phrases.unionByName(words.select("lang", F.array("h").alias("p"), F.col("n").alias("f")))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("p") - 1)))
    cuts = cuts.select("lang", "p", F.col("f").alias("a"), "k", F.slice("p", 1, F.col("k")).alias("first"), F.slice("p", F.col("k") + 1, F.size("p")).alias("rest"))
    cuts = cuts.join(parts.select("lang", F.col("p").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("p").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang")
    # 38 digits hold 1000 times 10^17 times 10^17.
    whole = lambda c, digits=19: F.col(c).cast(f"decimal({digits},0)")
    cuts = cuts.withColumn("over", (F.lit(1000).cast("decimal(4,0)") * whole("a", 17) * whole("n", 17)).cast("decimal(38,0)")).withColumn("under", (whole("l") * whole("r")).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("over div under"))
    best = cuts.groupBy("lang", "p", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    return best.select("lang", "p", "a", "x.l", "x.r", "n", "x.score")


def maximal(candidates: DataFrame) -> DataFrame:
    """``candidates`` that occur more often than any longer one that holds them.

    A phrase that some longer one holds as often is held as often by one that is a single word longer.
    """
    longer = candidates.filter(F.size("p") > 2)
    inner = F.array(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p")))
    held = longer.select("lang", F.explode(inner).alias("p"), F.col("a").alias("held")).groupBy("lang", "p").agg(F.max("held").alias("held"))
    return candidates.join(held, ["lang", "p"], "left").filter(F.col("held").isNull() | (F.col("held") < F.col("a"))).drop("held")


def named(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with ``phrase``, the words of ``p`` joined by spaces."""
    each = found.select("lang", "p", F.posexplode("p").alias("pos", "h")).join(words.select("lang", "h", "word"), ["lang", "h"])
    texts = each.groupBy("lang", "p").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("x"))
    return found.join(texts.select("lang", "p", F.array_join(F.transform("x", lambda x: x["word"]), " ").alias("phrase")), ["lang", "p"])


def best_of(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` phrases of each language with their rank, cut in salted parts before, so that no task ranks a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    parts = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    return parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top).drop("salt")


def _seeded(docs: DataFrame, least: int, hashes: Callable[[DataFrame, int], DataFrame] = vocabulary) -> tuple[int, DataFrame]:
    """The first seed for which no word that can be part of a phrase shares its hash, and the vocabulary with it, stored."""
    for seed in range(SEEDS):
        words = stored(hashes(docs, seed), "words")
        if words.groupBy("lang", "h").agg(F.count("*").alias("words"), F.sum("n").alias("n")).filter((F.col("words") > 1) & (F.col("n") >= least)).isEmpty():
            return seed, words
    raise ValueError("words of one language share a hash with every seed")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases of 2 to LONGEST words.

    ``a``, ``l`` and ``r`` count the phrase and the two parts of its cut, ``n`` all words of the language.
    """
    if not 1 <= least <= 255:
        raise ValueError("least has to be between 1 and 255, which a counter of the sketch holds")
    texts = docs.select(docs[lang_col].alias("lang"), docs[text_col].alias("text"))
    seed, words = _seeded(texts, least)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.filter(F.col("n") >= least)
    context = docs.sparkSession.sparkContext
    longer = tuple(range(3, LONGEST + 1))
    pairs = sketch(texts, seed, least, (2,), None, ())
    known = context.broadcast(pairs | sketch(texts, seed, least, longer, context.broadcast(pairs), (2,)))
    phrases = stored(phrase_counts(windows(texts, seed, known, (2, *longer)), least), "phrases")
    candidates = stored(scored(phrases, frequent, totals), "candidates")
    return best_of(named(maximal(candidates), frequent), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
