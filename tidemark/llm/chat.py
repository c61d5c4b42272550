"""Chat formatting through prefix trees (operator 9).

Conversations are sorted by the hashes of their turns, so that those which share
initial turns stand together, and packed in that order.  In a pack, a turn that
several conversations share as a prefix is one node and is written once, depth
first.  Each node has the position id of its first character (the length of its
ancestors) and the intervals of the pack that it attends to: its ancestors' and
its own, where intervals that touch are one.  A turn written right after the one that
it answers goes on with its interval, so a conversation that shares nothing has one
interval, however many turns it has.  A pack closes at ``max_chars`` characters or ``max_convs``
conversations, so the tree under a very common first turn spreads over packs
and tasks.

A turn is written ``<s>role\\ntext</s>``; in role and text, ``\\`` comes before
``\\``, ``<`` and ``[``, and a line break in a role is ``\\n``.

* null role or text: empty; turns are ordered by (turn, role, text), nulls first
* repeated rows: repeated turns; rows with a null conv_id are one conversation
* a conversation longer than a pack gets one for itself, and one task holds it; turns
  that more conversations share than fit a pack are written once in each pack
* an empty table: no packs; other columns are not read, whatever their names
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHARS = 1 << 16
MAX_CONVS = 256
LOSS_ROLE = "assistant"
_TURN = re.compile(r"<s>((?:[^\\<\n]|\\.)*)\n((?:[^\\<]|\\.)*)</s>", re.S)


def escape(text: str) -> str:
    return re.sub(r"[\\<\[]", lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


def _onward(attends: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """``attends`` and one more interval, which goes on with the last one if they touch."""
    if attends and attends[-1][1] == start:
        return [*attends[:-1], (attends[-1][0], end)]
    return [*attends, (start, end)]


@dataclass
class Node:
    parent: int
    turn: tuple[str, str]
    start: int
    end: int
    position: int
    loss_start: int
    loss_end: int
    attends: list[tuple[int, int]]


@dataclass
class Pack:
    """A prefix tree of conversations that come in the order of their turns' hashes."""

    nodes: list[Node] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    leaves: list[tuple[int | None, int]] = field(default_factory=list)
    path: list[int] = field(default_factory=list)
    chars: int = 0

    def shared(self, turns: list[tuple[str, str]]) -> int:
        n = 0
        while n < min(len(turns), len(self.path)) and self.nodes[self.path[n]].turn == turns[n]:
            n += 1
        return n

    def add(self, conv_id, turns: list[tuple[str, str]]) -> None:
        self.path = self.path[: self.shared(turns)]
        for role, text in turns[len(self.path) :]:
            above = self.nodes[self.path[-1]] if self.path else None
            head, body = f"<s>{escape_role(role)}\n", escape(text)
            written = f"{head}{body}</s>"
            start, end = self.chars, self.chars + len(written)
            lost = (start + len(head), start + len(head) + len(body)) if role == LOSS_ROLE else (start, start)
            position = above.position + above.end - above.start if above else 0
            self.nodes.append(Node(self.path[-1] if self.path else -1, (role, text), start, end, position, *lost, _onward(above.attends if above else [], start, end)))
            self.path.append(len(self.nodes) - 1)
            self.texts.append(written)
            self.chars = end
        self.leaves.append((conv_id, self.path[-1] if self.path else -1))

    def row(self, pack_id: int) -> dict:
        spans = lambda node: [{"start": a, "end": b} for a, b in node.attends]
        nodes = [{"parent": n.parent, "start": n.start, "end": n.end, "position": n.position, "loss_start": n.loss_start, "loss_end": n.loss_end, "attends": spans(n)} for n in self.nodes]
        return {"pack_id": pack_id, "text": "".join(self.texts), "nodes": nodes, "leaves": [{"conv_id": c, "node": n} for c, n in self.leaves]}


def _schema(id_type: pa.DataType) -> pa.Schema:
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    node = pa.struct([(n, pa.int32()) for n in ("parent", "start", "end", "position", "loss_start", "loss_end")] + [("attends", pa.list_(span))])
    return pa.schema([("pack_id", pa.int64()), ("text", pa.string()), ("nodes", pa.list_(node)), ("leaves", pa.list_(pa.struct([("conv_id", id_type), ("node", pa.int32())])))])


def pack(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", max_chars: int = MAX_CHARS, max_convs: int = MAX_CONVS) -> DataFrame:
    """Packs: ``(pack_id, text, nodes, leaves)``, positions and intervals in characters of ``text``."""
    c = conversations
    id_type = c.schema[id_col].dataType.simpleString()
    turn = F.struct(c[turn_col].alias("turn"), F.coalesce(c[role_col], F.lit("")).alias("role"), F.coalesce(c[text_col], F.lit("")).alias("text"))
    convs = c.select(c[id_col].alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    keyed = convs.withColumn("path", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])))
    laid = keyed.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "turns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, now, schema = TaskContext.get().partitionId() << 32, 0, Pack(), None
        for batch in batches:
            schema = schema or _schema(batch.schema.field("conv_id").type)
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                for conv_id, turns in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    said = [(t["role"], t["text"]) for t in turns]
                    new = sum(len(r) + len(t) for r, t in said[now.shared(said) :])
                    if now.leaves and (now.chars + new > max_chars or len(now.leaves) >= max_convs):
                        yield pa.RecordBatch.from_pylist([now.row(base + made)], schema)
                        made, now = made + 1, Pack()
                    now.add(conv_id, said)
        if now.leaves:
            yield pa.RecordBatch.from_pylist([now.row(base + made)], schema)

    node = "parent:int,start:int,end:int,position:int,loss_start:int,loss_end:int,attends:array<struct<start:int,end:int>>"
    return laid.mapInArrow(run, f"pack_id long, text string, nodes array<struct<{node}>>, leaves array<struct<conv_id:{id_type},node:int>>")


def read_back(packs: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Every conversation of the packs as its attention intervals give it: ``(id, formatted, turns, loss_text)``."""
    id_type = packs.schema["leaves"].dataType.elementType["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("leaves").type.value_type.field("conv_id").type
            schema = pa.schema([("id", kind), ("formatted", pa.string()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), ("loss_text", pa.string())])
            for i in range(batch.num_rows):
                own = batch.slice(i, 1).to_pylist()[0]
                out = []
                for leaf in own["leaves"]:
                    at, chain = leaf["node"], []
                    while at >= 0:
                        chain.append(own["nodes"][at])
                        at = own["nodes"][at]["parent"]
                    spans = chain[0]["attends"] if chain else []
                    formatted = "".join(own["text"][s["start"] : s["end"]] for s in spans)
                    turns = [{"role": unescape_role(r), "text": unescape(t)} for r, t in _TURN.findall(formatted)]
                    lost = "".join(unescape(own["text"][n["loss_start"] : n["loss_end"]]) for n in reversed(chain))
                    out.append({"id": leaf["conv_id"], "formatted": formatted, "turns": turns, "loss_text": lost})
                yield pa.RecordBatch.from_pylist(out, schema)

    return packs.mapInArrow(run, f"id {id_type}, formatted string, turns array<struct<role:string,text:string>>, loss_text string").withColumnRenamed("id", id_col)


def tokenized(packs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``(pack_id, ids, nodes, leaves)``: the packs in tokens of a byte-level BPE vocabulary (a ranks file of base64 and number).

    Each node's head, loss text and tail are encoded for themselves, so a shared
    turn has the same ids for all its conversations and the loss spans are whole
    tokens.  Control strings are encoded as ordinary text.  ``nodes`` has the
    spans, position ids and attention intervals of ``pack``, in tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coding = _coding(ranks_path, pattern)
        for batch in batches:
            schema = pa.schema([("pack_id", pa.int64()), ("ids", pa.list_(pa.int32())), batch.schema.field("nodes"), batch.schema.field("leaves")])
            for i in range(batch.num_rows):
                own = batch.slice(i, 1).to_pylist()[0]
                ids: list[int] = []
                nodes = []
                for n in own["nodes"]:
                    start, text = len(ids), own["text"]
                    ids += coding.encode_ordinary(text[n["start"] : n["loss_start"]])
                    loss_start = len(ids)
                    ids += coding.encode_ordinary(text[n["loss_start"] : n["loss_end"]])
                    loss_end = len(ids)
                    ids += coding.encode_ordinary(text[n["loss_end"] : n["end"]])
                    above = nodes[n["parent"]] if n["parent"] >= 0 else None
                    position = above["position"] + above["end"] - above["start"] if above else 0
                    attends = _onward([(a["start"], a["end"]) for a in above["attends"]] if above else [], start, len(ids))
                    nodes.append({"parent": n["parent"], "start": start, "end": len(ids), "position": position, "loss_start": loss_start, "loss_end": loss_end, "attends": [{"start": a, "end": b} for a, b in attends]})
                yield pa.RecordBatch.from_pylist([{"pack_id": own["pack_id"], "ids": ids, "nodes": nodes, "leaves": own["leaves"]}], schema)

    kinds = {f.name: f.dataType.simpleString() for f in packs.schema}
    return packs.mapInArrow(run, f"pack_id long, ids array<int>, nodes {kinds['nodes']}, leaves {kinds['leaves']}")


_CODINGS: dict[str, object] = {}


def _coding(ranks_path: str, pattern: str):
    if ranks_path not in _CODINGS:
        import base64

        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _CODINGS[ranks_path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _CODINGS[ranks_path]
