"""Removal of repeated passages by sharded Aho-Corasick automata (operator 3).

A window is ``window`` consecutive words of one document.  Words covered by a
window whose sequence starts anywhere else are removed.

1. Candidates.  In each window the ``ANCHOR`` words with the lowest hash are its
   anchor; consecutive windows on one anchor are a run.  Equal windows have equal
   anchors, so only runs whose anchor occurs twice can hold a repeated window.
2. Confirmation.  All windows of a run that occurs twice as a whole repeat.  Of
   the other runs under an anchor, each distinct one sends its windows' hashes
   (with the anchor's, 128 bits), which are counted.
3. Automata.  Documents are dealt into blocks of about ``block_bytes``.  Of the
   confirmed windows in a block, those that tile its repeated passages are
   compiled into the block's own automaton, which streams all of its documents
   to find every occurrence.  What a block has to know is bounded by its texts,
   and a passage in a third of all documents is sent once to each block.

Everything is one lazy plan; blocks and anchors are shuffle keys, counts are
combined before each shuffle, and nothing is collected.

* null or empty text: no words
* repeated rows and ids: each row is a document of its own, with its own output row
* texts of fewer words than a window are kept whole; an empty table gives no rows
* rows of one id, or without one, are dealt by their whole text; only rows equal in both share a block
* very long texts are read whole, a megabyte of texts at a time, in the task of their block
* columns other than the two named ones are not read
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _text

WINDOW = 35
ANCHOR = 8
BLOCK_BYTES = 4 << 20


class Runs:
    """Runs of the windows of some texts: first and last start word, anchor hash, and hash of the whole run."""

    def __init__(self, hashes: np.ndarray, begin: np.ndarray, stop: np.ndarray, window: int) -> None:
        n = len(hashes)
        self.hashes, self.window = hashes, window
        anchor = min(ANCHOR, window)
        starts = np.maximum(stop - begin - window + 1, 0)
        first = np.repeat(begin, starts)
        at = first + np.arange(len(first)) - np.repeat(np.cumsum(starts) - starts, starts)
        self.doc_of_window = np.repeat(np.arange(len(begin)), starts)
        self.first = self.last = self.doc = np.zeros(0, np.int64)
        self.anchor = self.whole = np.zeros(0, np.uint64)
        if not len(at):
            return
        i = np.arange(n - anchor + 1)
        phrase = _text.range_hashes(hashes, i, i + anchor)
        place = _leftmost_least(phrase, window - anchor + 1)[at]
        new = np.append(True, (place[1:] != place[:-1]) | (self.doc_of_window[1:] != self.doc_of_window[:-1]))
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(at)) - 1
        self.first, self.last, self.doc = at[a], at[b], self.doc_of_window[a]
        self.anchor = phrase[place[a]]
        self.whole = _text.mix(_text.range_hashes(hashes, self.first, self.last + window) + (place[a] - self.first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def windows(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start words of all windows of the runs at ``runs``, and the run of each."""
        count = self.last[runs] - self.first[runs] + 1
        owner = np.repeat(runs, count)
        return self.first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count), owner


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each place, where the least of the next ``width`` values is, the leftmost of equals.  The end is padded."""
    top = np.full(width, np.iinfo(np.uint64).max, np.uint64)
    v = np.concatenate([values, top])
    p = np.arange(len(v))
    size = 1
    while size < width:
        step = min(size, width - size)
        left, right = v[:-step], v[step:]
        take = right < left
        v = np.where(take, right, left)
        p = np.where(take, p[step:], p[:-step])
        size += step
    return p[: len(values)]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _runs_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, window: int) -> tuple[_text.Words, Runs]:
    words = _text.Words(data, start, end)
    return words, Runs(words.hashes(), words.begin, words.stop, window)


def _find_runs(docs: DataFrame, window: int) -> DataFrame:
    """``(anchor, whole, block)`` of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(1).to_numpy(zero_copy_only=False)
            for i, _, data, start, end in _text.texts(batch.column(0)):
                _, runs = _runs_of(data, start, end, window)
                yield pa.RecordBatch.from_arrays([_signed(runs.anchor), _signed(runs.whole), pa.array(block[i + runs.doc].astype(np.int32))], ["anchor", "whole", "block"])

    return docs.select("text", "block").mapInArrow(run, "anchor long, whole long, block int")


class Known:
    """A sorted table of (anchor, hash) pairs."""

    def __init__(self, anchor: np.ndarray, value: np.ndarray, **more: np.ndarray) -> None:
        order = np.lexsort((anchor, value))
        self.anchor, self.value = anchor[order], value[order]
        self.more = {k: v[order] for k, v in more.items()}

    def find(self, anchor: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Where each pair is, or -1."""
        at = np.searchsorted(self.value, value)
        found = np.full(len(value), -1)
        todo = np.arange(len(value))
        while len(todo):  # more than one step only for anchors with one hash in common
            todo = todo[at[todo] < len(self.value)]
            todo = todo[self.value[at[todo]] == value[todo]]
            hit = self.anchor[at[todo]] == anchor[todo]
            found[todo[hit]] = at[todo[hit]]
            todo = todo[~hit]
            at[todo] += 1
        return found


_NOTHING = pa.table({"block": pa.array([], pa.int32()), "anchor": pa.array([], pa.int64()), "whole": pa.array([], pa.int64()), "times": pa.array([], pa.int64()), "rep": pa.array([], pa.bool_())})


def _unsigned(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64).view(np.uint64)


def _confirm_windows(docs: pa.Table, runs: pa.Table, window: int) -> pa.Table:
    """Hashes of the windows of this block's runs that are to be compared window by window, with the times that each run occurs."""
    asked = Known(_unsigned(runs, "anchor"), _unsigned(runs, "whole"), times=runs.column("times").to_numpy(), rep=runs.column("rep").to_numpy(zero_copy_only=False))
    todo = asked.more["rep"].copy()
    out: list[list[np.ndarray]] = [[], [], []]
    for _, _, data, start, end in _text.texts(docs.column("text")):
        if not todo.any():
            break
        _, own = _runs_of(data, start, end, window)
        at = asked.find(own.anchor, own.whole)
        chosen = np.flatnonzero(at >= 0)
        chosen = chosen[todo[at[chosen]]]
        _, one = np.unique(at[chosen], return_index=True)
        chosen = chosen[one]
        todo[at[chosen]] = False
        first, owner = own.windows(chosen)
        out[0].append(own.anchor[owner])
        out[1].append(_text.range_hashes(own.hashes, first, first + window))
        out[2].append(asked.more["times"][at[owner]])
    anchor, value, times = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in out)
    return pa.table([_signed(anchor), _signed(value), pa.array(times.astype(np.int64))], ["anchor", "value", "times"])


def _tiles(confirmed: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Of the confirmed start words, enough to cover what all of them cover: each passage's first, every ``window`` on, and its last."""
    new = np.append(True, (confirmed[1:] != confirmed[:-1] + 1) | (doc[1:] != doc[:-1]))
    begin = np.flatnonzero(new)
    first = np.repeat(confirmed[begin], np.diff(np.append(begin, len(confirmed))))
    return ((confirmed - first) % window == 0) | np.append(new[1:], True)


def _clean_block(docs: pa.Table, runs: pa.Table, values: pa.Table, window: int, id_type: pa.DataType) -> pa.Table:
    """Kept texts of one block's documents."""
    runs = runs.filter(runs.column("times").to_numpy() >= 2) if len(runs) else runs
    whole = Known(_unsigned(runs, "anchor"), _unsigned(runs, "whole"))
    single = Known(_unsigned(values, "anchor"), _unsigned(values, "value"))
    anchors = np.unique(single.anchor)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for _, _, data, start, end in _text.texts(docs.column("text")):
        words, own = _runs_of(data, start, end, window)
        full = whole.find(own.anchor, own.whole) >= 0
        first, _ = own.windows(np.flatnonzero(full))
        edge, owner = own.windows(np.flatnonzero(~full & np.isin(own.anchor, anchors)))
        seen = single.find(own.anchor[owner], _text.range_hashes(own.hashes, edge, edge + window)) >= 0 if len(edge) else np.zeros(0, bool)
        confirmed = np.sort(np.concatenate([first, edge[seen]]))
        if len(confirmed):
            raw = data.tobytes()
            for w in confirmed[_tiles(confirmed, np.searchsorted(words.stop, confirmed, side="right"), window)]:
                span = raw[words.start[w] : words.end[w + window - 1]]
                automaton.add_word(f" {b' '.join(span.split()).decode('latin-1')} ")
    if len(automaton):
        automaton.make_automaton()
    n_words, n_removed, kept = [], [], []
    for _, _, data, start, end in _text.texts(docs.column("text")):
        raw = data.tobytes()
        for a, b in zip(start, end, strict=True):
            words = raw[a:b].split()
            n_words.append(len(words))
            line = b" ".join(words)
            if len(automaton) and len(words) >= window:
                gone = _covered(automaton, line, window)
                if gone is not None:
                    words = [w for w, x in zip(words, gone, strict=True) if not x]
                    line = b" ".join(words)
            n_removed.append(n_words[-1] - len(words))
            kept.append(line)
    return pa.table([docs.column("id").cast(id_type), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept"])


def _covered(automaton: ahocorasick.Automaton, line: bytes, window: int) -> np.ndarray | None:
    """Which words of ``line`` lie in an occurrence of a compiled phrase."""
    # One character a byte: places in the text are places in the bytes, with one space before.
    ends = np.array([e for e, _ in automaton.iter(f" {line.decode('latin-1')} ")], np.int64)
    if not len(ends):
        return None
    gaps = np.flatnonzero(np.frombuffer(b" " + line + b" ", np.uint8) == 32)
    stop = np.searchsorted(gaps, ends)
    edge = np.zeros(len(gaps), np.int64)
    np.add.at(edge, stop - window, 1)
    np.add.at(edge, stop, -1)
    return np.cumsum(edge)[:-1] > 0


def deal(docs: DataFrame, blocks: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, block)`` of every row."""
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(id, n_words, n_removed, kept)`` of every row; ``kept`` has the words that stay, joined by one space."""
    id_type = docs.schema[id_col].dataType.simpleString()
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = int(max(1, -(-total // block_bytes)))
    dealt = deal(docs, blocks, id_col, text_col)
    found = _find_runs(dealt, window)
    # Both groupings are by a struct, so that neither side of the join stays where another step has dealt it: only then can
    # the join of an anchor in a third of all documents be split.  Its runs are counted before they move on.
    repeated = found.groupBy(F.struct("anchor").alias("k")).agg(F.count("*").alias("n")).filter("n >= 2").select("k.anchor")
    counted = found.join(repeated, "anchor", "left_semi").groupBy(F.struct("anchor", "whole").alias("run")).agg(F.count("*").alias("times"), F.collect_set("block").alias("blocks"))
    runs = counted.select("run.anchor", "run.whole", "times", "blocks")
    forks = runs.groupBy(F.struct("anchor").alias("k")).agg(F.count("*").alias("n")).filter("n >= 2").select("k.anchor", F.lit(True).alias("forks"))
    judged = runs.join(forks, "anchor", "left").filter("forks or times >= 2")
    placed = judged.select("anchor", "whole", "times", (F.coalesce("forks", F.lit(False))).alias("forks"), F.array_min("blocks").alias("one"), F.explode("blocks").alias("block"))
    placed = placed.select("block", "anchor", "whole", "times", (F.col("forks") & (F.col("block") == F.col("one"))).alias("rep"))

    def confirm(left: pa.Table, right: pa.Table) -> pa.Table:
        out = _confirm_windows(left, right if len(right) else _NOTHING, window)
        block = (left if len(left) else right).column("block")[0].as_py()
        return out.append_column("block", pa.array(np.full(len(out), block, np.int32)))

    asked = dealt.groupBy("block").cogroup(placed.groupBy("block")).applyInArrow(confirm, "anchor long, value long, times long, block int")
    # A run that occurs once is in one block, which has to learn of its windows; the others know from the run.
    values = asked.groupBy("anchor", "value").agg(F.sum("times").alias("times"), F.collect_set(F.when(F.col("times") == 1, F.col("block"))).alias("blocks")).filter("times >= 2")
    sent = values.select(F.explode("blocks").alias("block"), "anchor", F.col("value").alias("whole"), F.lit(0).cast("long").alias("times"), F.lit(False).alias("rep"))
    known = placed.unionByName(sent)

    def clean(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = left.schema.field("id").type
        if not len(right):
            right = _NOTHING
        times = right.column("times").to_numpy()
        single = right.rename_columns(["value" if n == "whole" else n for n in right.schema.names])
        return _clean_block(left, right.filter(pa.array(times > 0)), single.filter(pa.array(times == 0)), window, kind)

    cleaned = dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(clean, f"id {id_type}, n_words long, n_removed long, kept string")
    return cleaned.withColumnRenamed("id", id_col)
