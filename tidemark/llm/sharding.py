"""Sharding by fixed virtual slots (operator 7), in DataFrame functions only.

A record, which is an id with its text, hashes to one of ``n_slots`` slots for good.
Bytes are summed by slot, and a stored, versioned map sends every slot, also those
without records so far, to a shard; rebalancing edits the map into its next version,
and moves no more slots than the new targets ask for.  What passes through one task is
the slot table, whose size is ``n_slots`` and SPLIT slots a shard at most, whatever the input.

A slot that holds more than a quarter of a shard's mean when its map is made is split
into parts, whose number the map keeps.  A record's part is by a second hash of id and
text; copies of one record take the parts from there on in turn.  So every later record
has its slot and part from the map alone, and equal inputs are placed alike.

* null text: no bytes; the record has its fixed overhead only
* repeated rows and repeated or null ids: every input row is placed; equal ids with
  different texts are different records
* an empty table: no rows, and a map of empty slots; very long texts count their bytes
* a map of other slots than the records': an error when the rows are read
* columns other than the two named ones are not read, whatever their names
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.ranking import carried
from tidemark.sources.shared import stored

N_SLOTS = 4096
OVERHEAD = 8
#: Parts of a shard's mean that a slot may hold before it is split.
SPLIT = 4


def slot_of(*key: Column, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(n_slots)).cast("int")


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """``(id, size, text_crc32, virtual_slot, mark, row)`` of every row, stored: texts are read once.  ``mark`` is the second hash."""
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(
        docs[id_col].alias("id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        slot_of(docs[id_col], docs[text_col], n_slots=n_slots).alias("virtual_slot"),
        F.xxhash64(F.lit("part"), docs[id_col], docs[text_col]).alias("mark"),
    )
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "records")


def slot_sizes(recs: DataFrame) -> DataFrame:
    """Rows and bytes of each slot that has records."""
    return recs.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def hot_slots(recs: DataFrame, shards: int) -> DataFrame:
    """``(virtual_slot, parts)`` of the slots to split: at most SPLIT * shards have so many bytes."""
    sizes = slot_sizes(recs)
    total = sizes.agg((F.sum("bytes") / (SPLIT * shards)).alias("most"))
    return sizes.crossJoin(F.broadcast(total)).filter("rows > 1 and bytes > most").select("virtual_slot", F.ceil(F.col("bytes") / F.col("most")).cast("int").alias("parts"))


def split(recs: DataFrame, hot: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """``recs`` with the slot of each part of ``hot`` (virtual_slot, parts) in place of the whole slot's; those of no hot slot as they are."""
    own = recs.join(F.broadcast(hot), "virtual_slot", "left")
    # Copies are numbered over their ranges: a record of any number of copies is in no single task.
    copies = carried(own.filter("parts is not null").withColumn("one", F.lit(1).cast("long")), ("virtual_slot", "mark", "id", "text_crc32", "size"), ("row",), nth=("sum", "one"))
    part = F.pmod(F.col("mark") + F.col("nth"), F.col("parts"))
    columns = [F.col(c) for c in ("id", "size", "text_crc32")]
    parted = copies.select(*columns, (F.col("virtual_slot") + n_slots * part).cast("int").alias("virtual_slot"), "mark", "row")
    return own.filter("parts is null").select(*columns, "virtual_slot", "mark", "row").unionByName(parted)


def _place(sizes: DataFrame, loads: Column, constant: str | None = None) -> DataFrame:
    """Slots of ``sizes`` (virtual_slot, bytes), largest first, each to the shard with the least load so far.

    ``loads``: array of the shards' loads before, which may use the column named
    ``constant``, the same in every row.  One row holds all slots.
    """
    empty = F.array().cast("array<struct<virtual_slot:int,shard:int>>")
    start = F.struct(loads.alias("loads"), empty.alias("out"))

    def step(acc: Column, item: Column) -> Column:
        least = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        grown = F.transform(acc["loads"], lambda x, i: F.when(i == least, x - item["less"]).otherwise(x))
        put = F.array(F.struct(item["virtual_slot"].alias("virtual_slot"), least.alias("shard")))
        return F.struct(grown.alias("loads"), F.concat(acc["out"], put).alias("out"))

    queue = F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), F.col("virtual_slot"))))
    gathered = sizes.agg(queue.alias("queue"), *([F.first(constant).alias(constant)] if constant else []))
    return gathered.select(F.explode(F.aggregate("queue", start, step)["out"]).alias("x")).select("x.virtual_slot", "x.shard")


def _all_slots(hot: DataFrame, n_slots: int) -> DataFrame:
    """``(virtual_slot, parts)`` of every slot and every part of a split one."""
    base = hot.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("virtual_slot")).join(F.broadcast(hot), "virtual_slot", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    each = base.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return each.select((F.col("virtual_slot") + n_slots * F.col("part")).cast("int").alias("virtual_slot"), "parts")


def new_map(recs: DataFrame, shards: int, version: int = 1, n_slots: int = N_SLOTS) -> DataFrame:
    """``(version, virtual_slot, parts, shard)``: every slot, with near-equal bytes of ``recs`` in every shard.

    Slots without bytes are dealt in turn.
    """
    hot = stored(hot_slots(recs, shards), "hot-slots")
    slots = _all_slots(hot, n_slots)
    sizes = slot_sizes(split(recs, hot, n_slots))
    placed = _place(sizes, F.array_repeat(F.lit(0).cast("long"), shards))
    idle = F.pmod(F.col("virtual_slot"), F.lit(shards)).cast("int")
    out = slots.join(placed, "virtual_slot", "left")
    return out.select(F.lit(version).alias("version"), "virtual_slot", "parts", F.coalesce("shard", idle).alias("shard"))


def hot_of(slot_map: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """``(virtual_slot, parts)`` of the slots that a map has split."""
    return slot_map.filter((F.col("parts") > 1) & (F.col("virtual_slot") < n_slots)).select("virtual_slot", "parts")


def rebalance(current: DataFrame, recs: DataFrame, shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """The next version of ``current`` (one version's rows) for ``shards`` shards and the bytes of ``recs``.

    A slot stays where it is while its shard exists and the slots kept before it
    there leave room under the mean load; the others go to the least loaded shards.
    Slots without bytes stay while their shard exists.  Parts stay as they are.
    """
    version = current.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))
    sizes = slot_sizes(split(recs, stored(hot_of(current, n_slots), "hot-slots"), n_slots))
    total = sizes.agg((F.sum("bytes") / shards).alias("target"))
    slots = current.select("virtual_slot", "parts", F.col("shard").alias("was")).join(sizes, "virtual_slot", "left")
    known = slots.filter("bytes is not null").crossJoin(F.broadcast(total))
    order = Window.partitionBy("was").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    judged = known.withColumn("upto", F.sum("bytes").over(order)).withColumn("stays", (F.col("was") < shards) & (F.col("upto") <= F.col("target")))
    kept = judged.filter("stays")
    by_shard = kept.groupBy("was").agg(F.sum("bytes").alias("load")).agg(F.map_from_entries(F.collect_list(F.struct("was", "load"))).alias("by_shard"))
    moving = judged.filter(~F.col("stays")).select("virtual_slot", "bytes").crossJoin(F.broadcast(by_shard))
    load = lambda s: F.coalesce(F.element_at("by_shard", s.cast("int")), F.lit(0).cast("long"))
    placed = _place(moving, F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), load), "by_shard")
    idle = F.when(F.col("was") < shards, F.col("was")).otherwise(F.pmod(F.col("virtual_slot"), F.lit(shards)).cast("int"))
    moved = slots.join(kept.select("virtual_slot", F.col("was").alias("stay")).unionByName(placed.withColumnRenamed("shard", "stay")), "virtual_slot", "left")
    return moved.crossJoin(F.broadcast(version)).select("version", "virtual_slot", "parts", F.coalesce("stay", idle).alias("shard"))


def save_map(slot_map: DataFrame, path: str) -> None:
    """Store one version of the map; a version that is there already is never written again."""
    found = slot_map.agg(F.count_distinct("version").alias("versions"), F.max("version").alias("version"), (F.count("*") - F.count_distinct("virtual_slot")).alias("repeated")).first()
    if found["versions"] > 1 or found["repeated"]:
        raise ValueError("a map has one version, and one row for each slot")
    version = 1 if found["version"] is None else found["version"]
    slot_map.drop("version").write.mode("errorifexists").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the latest by default."""
    maps = spark.read.parquet(path)
    if version is None:
        return maps.join(F.broadcast(maps.agg(F.max("version").alias("version"))), "version", "left_semi")
    return maps.filter(F.col("version") == version)


def place(recs: DataFrame, slot_map: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """Records with ``shard`` and ``slot``, their gapless place from 0 in the shard (by virtual slot, id, size, crc, row).

    Slots are split as the map says.  Rows are numbered inside each virtual slot and
    shifted by the rows of the shard's earlier slots, so no task sees a whole shard.
    """
    own = split(recs, hot_of(slot_map, n_slots), n_slots)
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    # One row a slot: bounded like the map.
    shards = slot_sizes(own).join(slot_map.select("virtual_slot", "shard"), "virtual_slot", "left")
    none = F.raise_error(F.concat(F.lit("the map has no slot "), F.col("virtual_slot").cast("string"))).cast("int")
    shards = shards.withColumn("shard", F.when(F.col("shard").isNull(), none).otherwise(F.col("shard")))
    offsets = shards.select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("virtual_slot").orderBy("id", "size", "text_crc32", "row")
    numbered = own.withColumn("slot", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(offsets), "virtual_slot").select("id", "size", "text_crc32", "virtual_slot", "shard", (F.col("slot") + F.col("offset")).cast("long").alias("slot"))
