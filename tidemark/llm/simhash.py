"""SimHash near-duplicate groups by a segment-popcount embedding (operator 10).

Documents get 64-bit fingerprints of their word shingles.  Equal fingerprints
are one class.  A class is embedded as the bit counts of its 32 two-bit
segments; the Manhattan distance of two embeddings is at most the Hamming
distance of the fingerprints.  The segments fall into groups.  Embeddings within
distance d of each other have no difference in all but d groups at most, so the
classes meet in a grid cell of the others: each choice of groups is a grid, whose
cells have the counts of the chosen groups as coordinates and a range of zero.  In a
cell, pairs within Manhattan distance d are compared exactly, and each class that
links is joined to the smallest class that it is connected to there, so a cell gives
no more rows than it has classes.  Linked classes then meet in rounds of large-star
and small-star steps.

The number of groups follows from the number of classes (``group_count``): more
groups make more grids, and cells of more coordinates, which hold a smaller share of
the classes.  A count of one is as likely as zero and two together, so the fullest
cell of k segments holds 2^-k of unlike classes; groups are added until that is
``FULL_CELL`` classes at most, and as long as the comparisons that they spare are more
than the rows that they add.  Every number of groups gives the same links.

A cell is streamed through one task, eight bytes a class; inside it a class that
is linked is never compared again with those that it is linked to.

* null, empty or blank text: fingerprint zero, linked like any other
* repeated rows and ids: one output row for each input row; a null id takes part
  in its class, and is no component's id unless all of it are null
* an empty table: no rows
* very long texts: a text is hashed by one task, a shingle at a time
* columns other than the two named ones are not read, whatever their names
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import stored

SHINGLE = 4
SEED = 42
MAX_BITS = 4
SHINGLES_AT_ONCE = 1 << 16
SEGMENTS = 32
#: Groups that a grid choice is made of at most, and the classes of a cell that more groups are taken for.
MAX_GROUPS, FULL_CELL = 12, 20_000
#: What a row of a grid costs, in comparisons.
ROW_COST = 64
LAGGED = 96


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash: a bit is 1 if over half of the shingles' hashes have it."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
    n = len(words) - k + 1
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    counts = np.zeros(64, np.int64)
    for i in range(0, n, SHINGLES_AT_ONCE):
        h = np.fromiter(hashes, np.uint64, min(SHINGLES_AT_ONCE, n - i))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id, fp)`` of every row; ``fp`` has the fingerprint's bits as a signed long."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {id_type}, fp long")


def embed(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, two bits each."""
    return fp - ((fp >> np.uint64(1)) & np.uint64(0x5555555555555555))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of embeddings, sixteen segments to a word at a time."""
    low, high, one = np.uint64(0x3333333333333333), np.uint64(0x8888888888888888), np.uint64(0x1111111111111111)
    total = np.zeros(np.broadcast(a, b).shape, np.uint64)
    for shift in (np.uint64(0), np.uint64(2)):
        x = ((((a >> shift) & low) | high) - ((b >> shift) & low)) ^ high
        sign = (x >> np.uint64(3)) & one
        total = total + ((x ^ (sign * np.uint64(15))) + sign)
    halves = np.uint64(0x0F0F0F0F0F0F0F0F)
    total = (total & halves) + ((total >> np.uint64(4)) & halves)
    return (total * np.uint64(0x0101010101010101)) >> np.uint64(56)


def linked(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    near = manhattan(embed(a), embed(b)) <= bits
    near[near] = np.bitwise_count((a ^ b)[near]) <= bits
    return near


def group_sizes(groups: int) -> list[int]:
    """Segments of each group, as even as can be."""
    return [SEGMENTS // groups + (i < SEGMENTS % groups) for i in range(groups)]


def group_count(classes: int, bits: int) -> int:
    """How many groups the segments of so many classes fall into."""

    def judge(groups: int) -> tuple[bool, float]:
        least = sum(sorted(group_sizes(groups))[: groups - bits])
        mean = SEGMENTS * (groups - bits) / groups
        # Two unlike classes have one count in common with a chance of 1/4 + 1/16 + 1/16.
        return classes * 0.5**least > FULL_CELL, comb(groups, bits) * (ROW_COST + classes * 0.375**mean)

    return min(range(bits + 2, max(MAX_GROUPS, bits + 2) + 1), key=judge)


def _masks(groups: int, bits: int) -> list[int]:
    """Bits of the embedding in each choice of all groups but ``bits``."""
    own, at = [], 0
    for n in group_sizes(groups):
        own.append(((1 << 2 * n) - 1) << 2 * at)
        at += n
    return [sum(chosen) for chosen in combinations(own, groups - bits)]


def _roots_of_large(fp: np.ndarray, bits: int) -> np.ndarray:
    """The smallest member, by place, that each member of one cell is connected to."""
    root = np.arange(len(fp))
    rest = np.arange(len(fp))
    while len(rest):
        first, todo, rest = rest[0], [rest[0]], rest[1:]
        while todo and len(rest):
            near = linked(fp[rest], fp[todo.pop()], bits)
            found, rest = rest[near], rest[~near]
            root[found] = first
            todo.extend(found)
    return root


def cell_links(cell: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of whole cells, in the order of (cell, fp), and what they are joined to."""
    n = len(fp)
    begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, n))
    left = np.repeat(begin + size, size) - np.arange(n)
    small = np.repeat(size <= LAGGED, size)
    root = np.arange(n)
    a, b = [], []
    for lag in range(1, min(LAGGED, int(size.max(initial=0)))):
        i = np.flatnonzero(small & (left > lag))
        if not len(i):
            break
        i = i[linked(fp[i], fp[i + lag], bits)]
        a.append(i)
        b.append(i + lag)
    if a and len(x := np.concatenate(a)):
        y = np.concatenate(b)
        while True:
            least = np.minimum(root[x], root[y])
            before = root.copy()
            np.minimum.at(root, x, least)
            np.minimum.at(root, y, least)
            root = root[root]
            if (root == before).all():
                break
    for start, count in zip(begin[size > LAGGED], size[size > LAGGED], strict=True):
        root[start : start + count] = start + _roots_of_large(fp[start : start + count], bits)
    moved = np.flatnonzero(root != np.arange(n))
    return fp[moved], fp[root[moved]]


def links(classes: DataFrame, bits: int = MAX_BITS, groups: int | None = None) -> DataFrame:
    """``(u, v)`` with v below u: enough pairs of connected fingerprints of ``classes`` (fp) to connect all that link."""
    odd = "6148914691236517205L"  # the lower bit of each segment; a segment's count is its two bits added
    embedding = F.expr(f"((fp ^ shiftrightunsigned(fp, 1)) & {odd}) | shiftleft(fp & shiftrightunsigned(fp, 1) & {odd}, 1)")
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = _masks(groups or group_count(classes.count(), bits), bits)
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("grid"), F.col("e").bitwiseAND(F.lit(signed(m))).alias("key")) for k, m in enumerate(masks))))
    rows = classes.select("fp", embedding.alias("e")).select("fp", cells.alias("c")).select(F.xxhash64("c.grid", "c.key").alias("cell"), "c.grid", "c.key", "fp")
    laid = rows.repartition("cell").sortWithinPartitions("cell", "grid", "key", "fp").select("cell", "grid", "key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in chain_end(batches):
            if batch is not None:
                cols = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)]
                # A cell's number inside the task: it goes up whenever grid or key change.
                held.append(np.stack(cols))
                if sum(x.shape[1] for x in held) < 50_000:
                    continue
            if not held:
                continue
            all_rows = np.concatenate(held, axis=1)
            change = np.append(False, (all_rows[:3, 1:] != all_rows[:3, :-1]).any(axis=0))
            cell = np.cumsum(change)
            whole = len(cell) if batch is None else int(np.searchsorted(cell, cell[-1]))
            held = [all_rows[:, whole:]]
            if whole:
                u, v = cell_links(cell[:whole], all_rows[3, :whole].view(np.uint64), bits)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return laid.mapInArrow(run, "u long, v long").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def chain_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` of every node of ``edges`` (u, v): the smallest node that it is connected to.

    Large-star and small-star in turn; each round is a table in the shared
    folder, and only its size and check sum come to the driver.
    """

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))

    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v"))).distinct()
        before = state
        both = now.union(now.select("v", "u")).toDF("u", "v")
        large = both.join(least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = large.join(least(large), "u").select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b"), "u", "m")
        now = stored(small.select(F.col("a").alias("u"), F.col("b").alias("v")).union(small.select("u", "m")).filter("u <> v").distinct(), "edges")
    raise RuntimeError(f"components not settled after {max_rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """``(id, fp, component_id)`` of every row: its fingerprint and the smallest id reachable over links."""
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    roots = components(links(classes, bits))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")
