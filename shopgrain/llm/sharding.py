"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record is hashed into one of some thousands of slots, for good.  What is
balanced is the map from slots to shards: the bytes of each slot are summed,
and an edit of the map moves only what stands above a shard's fair share to
the shards with the least bytes.  Every version of the map is stored, so
readers can follow records from one version to the next.

The size of a record is the UTF-8 bytes of its text plus one; a null text has
none.  Records without an id are dealt by their text.  Repeated rows share a
slot and get places of their own, which follow the order of the files.  Texts
are measured whole where they lie.  Columns are taken by name, so further ones
never clash.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopgrain.llm.columns import named, own, whole
from shopgrain.sources import files
from shopgrain.sources.shared import materialize

SLOTS = 4096
#: Parts of a slot that are numbered apart, as one id may hold a large share of all rows.
PARTS = 16


def measured(docs: DataFrame, slots: int = SLOTS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of every record."""
    text = whole(named(text_column))
    rows = docs.select(
        named(id_column).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    record = F.coalesce(F.xxhash64(F.when(F.col("doc_id").isNotNull(), F.col("doc_id"))), F.lit(0))
    record = F.when(F.col("doc_id").isNull(), F.xxhash64("text_crc32", "size")).otherwise(record)
    return rows.withColumn("virtual_slot", F.pmod(record, F.lit(slots)).cast("int"))


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes and records of every slot, empty ones included: as many rows as there are slots."""
    found = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("records"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(found, "virtual_slot", "left").na.fill(0, ["bytes", "records"])


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """The map before any bytes are known: slots in turn."""
    slot = F.col("id").cast("int")
    return spark.range(slots).select(slot.alias("virtual_slot"), (slot % shards).alias("shard"))


def edited_map(sizes: DataFrame, current: DataFrame, shards: int) -> DataFrame:
    """The map after rebalancing: virtual_slot, shard, moved.

    Each shard keeps its largest slots up to its fair share; the others, and
    those of shards that go, are dealt from the largest down to the shard that
    has the least bytes.  A new shard so takes only what the others had too
    much of.  ``sizes`` and ``current`` have one row for each slot, which is
    what bounds the single array that is folded here.
    """
    now = sizes.join(current, "virtual_slot")
    largest = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    fair = F.ceil(F.sum("bytes").over(Window.partitionBy()) / shards)
    upto = F.sum("bytes").over(largest.rowsBetween(Window.unboundedPreceding, 0))
    judged = now.select(
        "virtual_slot", "bytes", "shard", ((F.col("shard") < shards) & (upto <= fair)).alias("stays")
    )
    one = judged.agg(
        F.sort_array(F.collect_list(F.when(~F.col("stays"), F.struct(
            (-F.col("bytes")).alias("less"), F.col("virtual_slot").alias("slot"),
        )))).alias("freed"),
        *[F.coalesce(F.sum(F.when(F.col("stays") & (F.col("shard") == s), F.col("bytes"))), F.lit(0)).alias(f"b{s}")
          for s in range(shards)],
    )
    loads = F.array(*[F.struct(F.col(f"b{s}").cast("long").alias("load"), F.lit(s).alias("to")) for s in range(shards)])
    none = F.array().cast("array<struct<virtual_slot:int,shard:int>>")

    def deal(state: Column, slot: Column) -> Column:
        least = F.array_min(state["loads"])
        grown = F.transform(state["loads"], lambda x: F.struct(
            F.when(x["to"] == least["to"], x["load"] - slot["less"]).otherwise(x["load"]).alias("load"),
            x["to"].alias("to"),
        ))
        put = F.struct(slot["slot"].alias("virtual_slot"), least["to"].alias("shard"))
        return F.struct(grown.alias("loads"), F.array_append(state["put"], put).alias("put"))

    dealt = F.aggregate("freed", F.struct(loads.alias("loads"), none.alias("put")), deal)["put"]
    moved = one.select(F.inline(dealt)).withColumn("moved", F.lit(True))
    kept = judged.filter("stays").select("virtual_slot", "shard", F.lit(False).alias("moved"))
    return kept.unionByName(moved)


class SlotMaps:
    """Versions of the slot-to-shard map, one folder each, under a folder on shared storage."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def versions(self) -> list[int]:
        names = [p.rstrip("/").rsplit("/", 1)[-1] for p in files.children(self.spark, self.path)]
        done = [n for n in names if files.exists(self.spark, f"{self.path}/{n}/_SUCCESS")]
        return sorted(int(n.removeprefix("version-")) for n in done if n.startswith("version-"))

    def store(self, slot_map: DataFrame) -> int:
        """Write the next version; its number."""
        version = max(self.versions(), default=-1) + 1
        slot_map.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version-{version}")
        return version

    def read(self, version: int | None = None) -> DataFrame:
        version = self.versions()[-1] if version is None else version
        return self.spark.read.parquet(f"{self.path}/version-{version}")


def rebalance(maps: SlotMaps, sizes: DataFrame, shards: int, slots: int = SLOTS) -> int:
    """Store the edited map as the next version; its number."""
    if not maps.versions():
        maps.store(first_map(maps.spark, shards, slots).withColumn("moved", F.lit(False)))
    return maps.store(edited_map(sizes, maps.read().select("virtual_slot", "shard"), shards))


def placed(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``rows`` with shard and slot, the record's place in its shard, gapless from 0.

    Places are counted inside each part of a virtual slot and shifted by the
    parts that come before it in the shard, so no task holds a shard, nor all
    rows of one id.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.groupBy("virtual_slot", "part").agg(F.count(F.lit(1)).alias("records"))
    starts = counted.join(slot_map.select("virtual_slot", "shard"), "virtual_slot").select(
        "virtual_slot", "part", "shard", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("start")
    )
    inside = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size"))
    # At most PARTS rows for each virtual slot.
    return rows.join(F.broadcast(starts), ["virtual_slot", "part"]).withColumn(
        "slot", (F.col("start") + inside - 1).cast("long")
    ).drop("start", "part")


def shard(docs: DataFrame, maps: SlotMaps, shards: int, slots: int = SLOTS) -> DataFrame:
    """Every record with its shard under a map rebalanced for these records."""
    part = F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int")
    rows = materialize(measured(docs, slots).withColumn("part", part))
    version = rebalance(maps, materialize(slot_sizes(rows, slots)), shards, slots)
    return placed(rows, maps.read(version)).withColumn("map_version", F.lit(version))


def write_shards(
    docs: DataFrame, slot_map: DataFrame, path: str, slots: int = SLOTS, id_column: str = "doc_id",
    text_column: str = "text",
) -> None:
    """Write whole records into one folder for each shard.

    Parts of slots, not shards, are what tasks get, so a shard is written by
    many tasks.  The columns of slot and shard are called ``virtual_slot`` and
    ``shard``, with underscores before them where the table has such columns.
    """
    slot_name, shard_name = own(docs, "virtual_slot", "shard")
    text = whole(named(text_column))
    lost = F.xxhash64(F.crc32(F.encode(text, "UTF-8")), (F.octet_length(text) + 1).cast("long"))
    slot = F.pmod(F.when(named(id_column).isNull(), lost).otherwise(F.xxhash64(named(id_column))), F.lit(slots))
    small = F.broadcast(slot_map.select(F.col("virtual_slot").alias(slot_name), F.col("shard").alias(shard_name)))
    part = F.pmod(F.monotonically_increasing_id(), F.lit(PARTS))
    rows = docs.withColumn(slot_name, slot.cast("int")).join(small, slot_name)
    rows.repartition(named(slot_name), part).write.partitionBy(shard_name).parquet(path)
