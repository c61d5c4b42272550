"""SentencePiece encoding and decoding by a table of distinct chunks (operator 4).

In a model none of whose pieces crosses a whitespace marker, segmentation of a
text is the concatenation of the segmentations of its marked chunks
(``▁+[^▁]*``).  Each task keeps a table of the distinct chunks it has met, asks
the library once for those that are new, and joins ids and surfaces back by
position.  Nothing is shuffled; the table is bounded by ``max_chunks`` and begun anew
when it is full.  Chunks are cut and put together in numpy, a few texts at a time.

One table for the whole corpus, fetched by blocks of documents, needs more disk than
the texts themselves where most words are rare (README).

* null or empty text: no ids, empty decoded text
* repeated rows and repeated or null ids: one output row for each input row
* an empty table: no rows; a very long text is cut as a whole by its task
* columns other than the two named ones are not read, whatever their names
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from tidemark.llm import _text

MAX_CHUNKS = 300_000
MARKER = "▁"
_TABLES: dict[str, Table] = {}


class Coder:
    """The library's segmentation of single chunks."""

    def __init__(self, model_path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        crossing = [p for p in pieces if re.search("[^▁]▁", p)]
        if crossing:
            raise ValueError(f"pieces cross whitespace markers: {crossing[:3]}")
        # Decoding drops the first marker of a sequence; this piece stands before each chunk instead.
        self.guard = next(i for i in range(len(pieces)) if self.model.decode([i]).isalpha())
        self.guard_chars = len(self.model.decode([self.guard]))
        self.marker = self.model.piece_to_id(MARKER)

    def segment(self, chunks: list[str]) -> tuple[list[list[int]], list[str]]:
        """Ids and surface of each chunk; a chunk begins with spaces in place of markers."""
        ids = self.model.encode([c[1:] for c in chunks], num_threads=1)  # the library sets the first marker itself
        ids = [x if len(c) > 1 else [self.marker] for c, x in zip(chunks, ids, strict=True)]
        decoded = self.model.decode([[self.guard, *x] for x in ids], num_threads=1)
        return ids, [d[self.guard_chars :] for d in decoded]


def chunks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, pa.DictionaryArray, np.ndarray]]:
    """For groups of texts: their number, all of their chunks in order, and where each text's chunks begin (and the last ones end)."""
    for _, _, data, start, end in _text.texts(pc.replace_substring(column.cast(pa.large_string()), MARKER, " ")):
        size = end - start
        marks = (size > 0).astype(np.int64)
        begin = start + np.cumsum(marks) - marks
        marked = np.full(len(data) + marks.sum(), 32, np.uint8)
        marked[np.arange(len(data)) + np.repeat(np.cumsum(marks), size)] = data
        first = marked == 32
        first[1:] &= marked[:-1] != 32
        first[begin[marks > 0]] = True
        at = np.flatnonzero(first)
        offsets = np.append(at, len(marked)).astype(np.int32)
        cut = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(marked)])
        yield len(size), cut.dictionary_encode(), np.searchsorted(at, np.append(begin, len(marked)))


def _spread(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the lists at ``rows`` one after another, and where each list begins (and the last one ends)."""
    size = offsets[rows + 1] - offsets[rows]
    upto = np.concatenate([[0], np.cumsum(size)])
    return flat[np.arange(upto[-1]) + np.repeat(offsets[rows] - upto[:-1], size)], upto


class Table:
    """Chunks met so far, with their ids and surfaces as flat arrays."""

    def __init__(self, model_path: str, max_chunks: int = MAX_CHUNKS) -> None:
        self.coder, self.max_chunks = Coder(model_path), max_chunks
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.ids, self.id_at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.surface, self.surface_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def find(self, wanted: list[str]) -> np.ndarray:
        """The row of each of these distinct chunks; new ones are segmented."""
        new = [c for c in wanted if c not in self.row]
        if len(self.row) + len(new) > self.max_chunks:
            self.clear()
            new = wanted
        if new:
            ids, said = self.coder.segment(new)
            said = [x.encode() for x in said]
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
            self.id_at = np.concatenate([self.id_at, self.id_at[-1] + np.cumsum([len(x) for x in ids])])
            self.surface_at = np.concatenate([self.surface_at, self.surface_at[-1] + np.cumsum([len(x) for x in said])])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.int32)])
            self.surface = np.concatenate([self.surface, np.frombuffer(b"".join(said), np.uint8)])
        return np.fromiter(map(self.row.__getitem__, wanted), np.int64, len(wanted))

    def texts(self, cut: pa.DictionaryArray, begin: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Ids and decoded text of each text from its chunks."""
        rows = self.find(cut.dictionary.to_pylist())[cut.indices.to_numpy()]
        ids, id_upto = _spread(self.ids, self.id_at, rows)
        said, upto = _spread(self.surface, self.surface_at, rows)
        # The first space of each text is its own marker's.
        start, end = upto[begin[:-1]], upto[begin[1:]]
        keep = np.ones(len(said), bool)
        keep[start[end > start]] = False
        size = np.maximum(end - start - 1, 0)
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        decoded = pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(said[keep])])
        return pa.ListArray.from_arrays(pa.array(id_upto[begin].astype(np.int32)), pa.array(ids)), decoded


def _table(model_path: str) -> Table:
    if model_path not in _TABLES:
        _TABLES[model_path] = Table(model_path)
    return _TABLES[model_path]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>, decoded string)`` for every row of ``docs``.

    The model file has to be readable at ``model_path`` on every executor.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model_path)
        for batch in batches:
            row = 0
            for n, cut, begin in chunks(batch.column(1)):
                ids, decoded = table.texts(cut, begin)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), ids, decoded], ["id", "ids", "decoded"])
                row += n

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {id_type}, ids array<int>, decoded string").withColumnRenamed("id", id_col)
