"""Sharding over fixed virtual slots.

Records hash into a fixed number of slots, bytes are summed per slot, and a small versioned map says which shard owns
a slot.  Growing or rebalancing edits the map; records keep their slots for ever.  Every whole-table step is narrow:
one combined count, one window per slot (thousands of them), one join with the map, whose size is the slot count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.session import shared_folder, stage

SLOTS = 4096


def slotted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """``id, size, text_crc32, virtual_slot`` per row: UTF-8 bytes plus one; null counts as empty.

    The slot depends on id, size and checksum, so a repeated or null id does not heat one slot.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("id", "size", "text_crc32"), F.lit(slots)).cast("int"))


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``virtual_slot, bytes, n_rows`` for every slot, empty ones too."""
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(sums, "virtual_slot", "left").fillna(0, ["bytes", "n_rows"])


def _least(loads: Column) -> Column:
    return F.array_position(loads, F.array_min(loads)).cast("int") - 1


def edit_map(sums: DataFrame, shards: int, current: DataFrame | None = None, version: int = 1, slack: float = 0.01) -> DataFrame:
    """The next version of the slot-to-shard map: ``version, virtual_slot, shard``.

    Slots are visited from the largest down.  A slot stays with its shard while that shard is within ``slack`` of an
    equal share; the others go, again from the largest, to the shard with least bytes.  Without a current map every
    slot is placed this way.  The fold runs over one array with an entry per slot, a size fixed by configuration.
    """
    owned = sums.withColumn("owner", F.lit(-1)) if current is None else sums.join(
        current.select("virtual_slot", F.col("shard").alias("owner")), "virtual_slot", "left"
    ).fillna(-1, ["owner"])
    entry = F.struct((-F.col("bytes")).alias("less"), "virtual_slot", "bytes", "owner")
    listed = owned.agg(F.sort_array(F.collect_list(entry)).alias("slots"), F.sum("bytes").alias("total"))
    limit = F.col("total") / shards * (1 + slack)
    added = lambda loads, k, b: F.transform(loads, lambda x, i: F.when(i == k, x + b).otherwise(x))
    empty = F.struct(
        F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<struct<virtual_slot:int,bytes:bigint,shard:int>>").alias("done")
    )

    def keep(state: Column, slot: Column) -> Column:
        fits = (slot["owner"] >= 0) & (slot["owner"] < shards) & (F.get(state["loads"], slot["owner"]) + slot["bytes"] <= limit)
        put = F.struct(slot["virtual_slot"].alias("virtual_slot"), slot["bytes"].alias("bytes"), F.when(fits, slot["owner"]).otherwise(-1).alias("shard"))
        return F.struct(
            F.when(fits, added(state["loads"], slot["owner"], slot["bytes"])).otherwise(state["loads"]).alias("loads"),
            F.concat(state["done"], F.array(put)).alias("done"),
        )

    def place(state: Column, slot: Column) -> Column:
        goal = F.when(slot["shard"] >= 0, slot["shard"]).otherwise(_least(state["loads"]))
        put = F.struct(slot["virtual_slot"].alias("virtual_slot"), slot["bytes"].alias("bytes"), goal.alias("shard"))
        loads = F.when(slot["shard"] >= 0, state["loads"]).otherwise(added(state["loads"], goal, slot["bytes"]))
        return F.struct(loads.alias("loads"), F.concat(state["done"], F.array(put)).alias("done"))

    held = listed.select("slots", "total", F.aggregate("slots", empty, keep).alias("held"))
    start = F.struct(F.col("held.loads").alias("loads"), empty["done"].alias("done"))
    placed = held.select(F.explode(F.aggregate("held.done", start, place)["done"]).alias("slot"))
    return placed.select(F.lit(version).alias("version"), "slot.virtual_slot", "slot.shard")


def store_map(spark: SparkSession, slot_map: DataFrame, folder: str | None = None) -> str:
    """Append a version to the map table; its folder."""
    folder = folder or shared_folder(spark, "slot-map")
    slot_map.write.mode("append").partitionBy("version").parquet(folder)
    return folder


def load_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    schema = "virtual_slot int, shard int, version int"
    return spark.read.schema(schema).parquet(folder).filter(F.col("version") == version).select("version", "virtual_slot", "shard")


def placed(rows: DataFrame, sums: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Rows with ``shard``, ``position`` (0, 1, 2, … within the shard, without a gap) and the map's ``version``.

    A position is the row's rank inside its virtual slot plus the rows of the shard's slots before it.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.join(slot_map, "virtual_slot").select(
        "virtual_slot", "shard", "version", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("start")
    )
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("id", "size", "text_crc32"))
    ranked = rows.withColumn("rank", rank)
    # one row per slot: the side sent to every task has a fixed size
    return ranked.join(F.broadcast(starts), "virtual_slot").withColumn("position", F.col("start") + F.col("rank") - 1).drop("start", "rank")


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Lay out a table afresh: ``id, size, text_crc32, virtual_slot, version, shard, position``.

    Law ``bytes``: shards hold nearly equal bytes.  An empty table gives no rows; nulls are ids and texts like others.
    """
    rows = stage(slotted(docs, id_col, text_col, slots), "slots")
    sums = stage(slot_bytes(rows, slots), "slot-bytes")
    folder = store_map(docs.sparkSession, edit_map(sums, shards))
    return placed(rows, sums, load_map(docs.sparkSession, folder, 1))
