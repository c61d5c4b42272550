"""Near-duplicate groups by exact Jaccard similarity (the near-dedup stage of the pipeline).

Two documents link if the sets of their five-word shingles have a Jaccard
similarity of 0.8 or more; linked documents are one group.  SimHash comes first:
classes whose 64-bit fingerprints of these shingles are equal, or meet in the grids of
``simhash.links`` at MAX_BITS bits, are compared exactly, and those that link are one group from then on.
That finds copies of few changes only, since at 0.8 two texts differ in about ten bits
(README).  The rest is found exactly by prefix filtering, which misses no pair and compares
no two classes that are in one group already: of n shingles in any one order, those of
two linked documents share one among the first n - ceil(0.8 n) + 1.  The order is by
frequency, then hash, so a passage in a third of all documents comes last and makes no
candidates.  Frequencies are counted in one of SAMPLE_ONE_IN distinct texts; that only
orders the shingles, and every order finds the same links.  The ``MAX_COMMON`` most
frequent are broadcast, all others count as rare.  Documents of equal shingle sets are one class, and classes
that share such a shingle are compared in two passes: each with one class that is
the smallest of a shingle, then those of different groups with each other, if
sizes and the shared shingles leave 0.8 possible.  So a large group of near copies
costs no pairs of its members.  In the second pass a pair forms under a shingle only if
the smaller of both has it among its first n - ceil(8/9 n) + 1, where every link has one:
pages of one template whose own shingles fill that part meet in no pair, however many.

Shingles are compared as 64-bit hashes, whole sets by two of them.

* words are split at ASCII white space, A-Z lower-cased; a text of fewer than five
  words is one shingle
* null, empty or blank text: no shingles; all such rows are one class
* an empty table: no rows; very long texts: all their shingles count, a megabyte of texts at a time
* columns other than the two named ones go through as they are, whatever their names
* repeated rows and ids: each row counts by itself, whatever its id
* one row of a group stays: that of the smallest id, null ids last, then of the
  smallest row number
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _text
from tidemark.llm.simhash import MAX_BITS, components, fingerprint, links
from tidemark.sources.shared import stored, unused

SHINGLE = 5
#: Least similarity, as a fraction.
OVER, UNDER = 4, 5

#: Share of the texts that shingle frequencies are counted in, the least count there of a common one, and how many of these are kept at most.
SAMPLE_ONE_IN, COMMON, MAX_COMMON = 16, 3, 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, in ascending order."""
    for _, _, data, start, end in _text.texts(column):
        words = _text.Words(_LOWER[data], start, end)
        hashes = words.hashes()
        n = words.stop - words.begin
        k = np.minimum(n, shingle)
        count = np.where(n > 0, n - k + 1, 0)
        upto = np.concatenate([[0], np.cumsum(count)])
        at = np.arange(upto[-1]) + np.repeat(words.begin - upto[:-1], count)
        own = _text.range_hashes(hashes, at, at + np.repeat(k, count))
        for i in range(len(n)):
            yield np.unique(own[upto[i] : upto[i + 1]])


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)))


def common_shingles(rows: DataFrame, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in ascending order, and frequencies of the shingles that many texts of a sample have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in shingle_sets(batch.column(0), shingle):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["h"])

    texts = rows.select("text").filter(F.pmod(F.xxhash64(F.lit("sample"), "text"), F.lit(SAMPLE_ONE_IN)) == 0).distinct()
    counts = texts.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON)
    found = counts.orderBy(F.desc("n"), "h").limit(MAX_COMMON).toArrow()
    h = found.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], found.column("n").to_numpy()[order].astype(np.int32)


def rarest_first(s: np.ndarray, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Ascending hashes in the order of their frequency, then hash."""
    if not len(common):
        return s
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    n = np.where(common[at] == s, times[at], 0)
    return s[np.argsort(n, kind="stable")] if n.any() else s


def prints(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(row, id, high, low, n, fp, prefix)`` of ``rows`` (row, id, text): set hashes, size, SimHash, and the shingles that a link must share one of."""
    common = rows.sparkSession.sparkContext.broadcast(common_shingles(rows, shingle))
    simhash = fingerprints_of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n, prefix = [], [], []
            for s in shingle_sets(batch.column(2), shingle):
                raw = s.tobytes()
                key.append((xxhash.xxh64_intdigest(raw, 0), xxhash.xxh64_intdigest(raw, 1)))
                n.append(len(s))
                prefix.append(rarest_first(s, *common.value)[: len(s) - (OVER * len(s) + UNDER - 1) // UNDER + 1].copy())
            key = np.array(key, np.uint64).reshape(-1, 2).view(np.int64)
            fp = simhash(batch.column(2), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy()), pa.array(n, pa.int32()), pa.array(fp), _lists(prefix)],
                ["row", "id", "high", "low", "n", "fp", "prefix"],
            )

    return rows.mapInArrow(run, f"row long, id {rows.schema['id'].dataType.simpleString()}, high long, low long, n int, fp long, prefix array<long>")


def _alike(pairs: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """Those of ``pairs`` (u, v) of row numbers whose shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for a, b in zip(shingle_sets(batch.column(2), shingle), shingle_sets(batch.column(3), shingle), strict=True):
                both = len(np.intersect1d(a, b, assume_unique=True))
                near.append(both * UNDER >= (len(a) + len(b) - both) * OVER)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(near, pa.bool_()))

    # Each side fetches its texts for itself, so that only texts of pairs are shuffled, as long as the pairs' numbers are few.
    left = pairs.join(rows.select(F.col("row").alias("u"), F.col("text").alias("a")), "u")
    right = pairs.join(rows.select(F.col("row").alias("v"), F.col("text").alias("b")), "v")
    return left.join(right, ["u", "v"]).select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def fingerprints_of(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The SimHash of each text."""
    return np.fromiter((fingerprint(t.as_py(), shingle) for t in column), np.uint64, len(column))


def _possible(o: Column) -> Column:
    """Whether sets of sizes ``m`` and ``n`` can be similar enough, having o shingles in common before their prefixes end."""
    # Beyond the o shingles that both prefixes have, only what is after one of the prefixes can be shared.
    after = F.floor((F.greatest("m", "n") * OVER + UNDER - 1) / UNDER) - 1
    return (F.least("m", "n") * UNDER >= F.greatest("m", "n") * OVER) & ((o + after) * (OVER + UNDER) >= (F.col("m") + F.col("n")) * OVER)


def by_simhash(heads: DataFrame) -> DataFrame:
    """Pairs (u, v) of ``heads`` (row, n, fp, prefix) with equal or linked fingerprints whose sizes and prefixes leave 0.8 possible.

    The first row of a fingerprint stands for it.  Some pages of one template meet by their fingerprints, but share too few shingles of their prefixes.
    """
    classes = stored(heads.groupBy("fp").agg(F.min(F.struct("row", "n")).alias("x")).select("fp", F.col("x.row").alias("first"), F.col("x.n").alias("m")), "fingerprints")
    same = heads.join(classes, "fp").select(F.col("row").alias("u"), F.col("first").alias("v"), "n", "m")
    to = links(classes.select("fp"), MAX_BITS).join(classes.select(F.col("fp").alias("u"), F.col("first").alias("a"), F.col("m").alias("n")), "u")
    near = to.join(classes.select(F.col("fp").alias("v"), F.col("first").alias("b"), "m"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"), "n", "m")
    pairs = stored(same.filter("u <> v").unionByName(near).filter(_possible(F.least("n", "m"))), "pairs")
    left = pairs.join(heads.select(F.col("row").alias("u"), F.col("prefix").alias("p")), "u")
    return left.join(heads.select(F.col("row").alias("v"), F.col("prefix").alias("q")), "v").filter(_possible(F.size(F.array_intersect("p", "q")))).select("u", "v")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of ``pairs`` (u, v) that are not in one group of ``roots`` (node, root)."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    return pairs.join(of("u"), "u", "left").join(of("v"), "v", "left").filter(F.coalesce(F.col("root_u") != F.col("root_v"), F.lit(True))).select("u", "v")


def _able(pairs: DataFrame, size: DataFrame) -> DataFrame:
    """Those of ``pairs`` (u, v, o) that can be similar enough, having o shingles in common before their prefixes end."""
    sized = pairs.join(size.toDF("u", "m"), "u").join(size.toDF("v", "n"), "v")
    return sized.filter(_possible(F.col("o"))).select("u", "v")


def _across(rest: DataFrame) -> DataFrame:
    """Pairs (u, v) of different groups that can be similar enough, from prefix marks (h, g, row, n, i): group, size and place of each.

    All shingles that both have come no earlier than the first that they share, so
    the smaller of what is left after it on both sides bounds them; and those of both
    prefixes are the shared ones found here and at most the smaller side's later ones.
    """
    least = F.col("n") - F.ceil(F.col("n") * 2 * OVER / (OVER + UNDER)) + 1
    flagged = rest.withColumn("early", F.col("i") < least)
    late = flagged.groupBy("row").agg(F.count_if(~F.col("early")).alias("late"))
    small = flagged.filter("early").select("h", F.col("g").alias("k"), F.col("row").alias("v"), F.col("n").alias("q"), F.col("i").alias("j"))
    large = rest.select("h", "g", F.col("row").alias("u"), F.col("n").alias("m"), "i")
    sizes = (F.col("q") * UNDER >= F.col("m") * OVER) & ((F.col("q") < F.col("m")) | ((F.col("q") == F.col("m")) & (F.col("v") < F.col("u"))))
    met = small.join(large, "h").filter((F.col("g") != F.col("k")) & sizes)
    left = F.max(F.least(F.col("m") - F.col("i"), F.col("q") - F.col("j")))
    pairs = met.groupBy("u", "v", "m", "q").agg(F.count("*").alias("o"), left.alias("left")).filter(F.col("left") * (OVER + UNDER) >= (F.col("m") + F.col("q")) * OVER)
    after = F.floor((F.col("m") * OVER + UNDER - 1) / UNDER) - 1
    able = (F.col("o") + F.col("late") + after) * (OVER + UNDER) >= (F.col("m") + F.col("q")) * OVER
    return pairs.join(late.withColumnRenamed("row", "v"), "v").filter(able).select("u", "v")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row of each group, with all its columns."""
    row, kept_row = unused(docs.columns, "row", "kept")
    own = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    rows = own.select(F.col(row).alias("row"), own[id_col].alias("id"), own[text_col].alias("text"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    heads = stored(
        prints(rows, shingle).groupBy("high", "low").agg(F.min(F.struct(order.alias("order"), "n", "fp", "prefix")).alias("x")).select("x.order.none", "x.order.id", F.col("x.order.row").alias("row"), "x.n", "x.fp", "x.prefix"),
        "classes",
    )
    alike = stored(_alike(stored(by_simhash(heads.withColumn("n", F.col("n").cast("long"))), "pairs"), rows, shingle), "links")
    # One exchange serves the counts and the join on them.
    marks = heads.select("row", F.col("n").cast("long"), F.posexplode("prefix").alias("i", "h")).repartition("h")
    common = marks.groupBy("h").agg(F.count("*").alias("c"), F.min("row").alias("least")).filter("c > 1").select("h", "least")
    shared = stored(marks.join(common, "h"), "marks")

    size = heads.select("row", F.col("n").cast("long"))
    stars = shared.filter("row <> least").groupBy("row", "least").count().groupBy("row").agg(F.max(F.struct("count", "least")).alias("x"))
    able = _able(stars.select(F.col("row").alias("u"), F.col("x.least").alias("v"), F.col("x.count").alias("o")), size)
    first = stored(_alike(stored(_apart(able, components(alike)), "pairs"), rows, shingle), "links").union(alike)
    roots = components(first)
    placed = shared.join(roots, shared["row"] == roots["node"], "left").select("h", F.coalesce("root", "row").alias("g"), "row", "n", "i")
    mixed = placed.groupBy("h").agg(F.min("g").alias("low"), F.max("g").alias("high")).filter("low < high").select("h")
    rest = stored(placed.join(mixed, "h"), "marks")
    second = stored(_alike(stored(_across(rest), "pairs"), rows, shingle), "links")

    roots = components(first.union(second))
    grouped = heads.join(roots, heads["row"] == roots["node"], "left").select(F.coalesce("root", "row").alias("group"), order.alias("order"))
    kept = grouped.groupBy("group").agg(F.min("order").alias("order")).select(F.col("order.row").alias(kept_row))
    return own.join(kept, own[row] == kept[kept_row], "left_semi").drop(row)
