"""Sharding by fixed virtual slots and a versioned slot-to-shard map."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.keys import hash_of
from riskloom.sources.staging import new_path

SLOTS = 4_096
RECORD_BYTES = 16


def slots_of(df: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Documents with ``size``, ``text_crc32`` and their virtual slot.

    The slot depends on id and text, so rows that share an id (or have none) still spread.
    """
    text = F.coalesce("text", F.lit(""))
    return df.select(
        "doc_id", (F.octet_length(text) + F.lit(RECORD_BYTES)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        (hash_of(F.col("doc_id"), F.col("text"), digits=8) % slots).alias("virtual_slot"),
    )


def measure(placed: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) of the slots in use; at most as many as there are slots."""
    sums = placed.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    return sorted(tuple(r) for r in sums.collect())


def assign(sizes: list[tuple[int, int, int]], shards: int) -> dict[int, int]:
    """Largest slot first, each to the shard with the fewest bytes (then the smallest number)."""
    loads = [(0, shard) for shard in range(shards)]
    shard_of = {}
    for slot, size, _ in sorted(sizes, key=lambda s: (-s[1], s[0])):
        load, shard = loads[0]
        shard_of[slot] = shard
        heapq.heapreplace(loads, (load + size, shard))
    return shard_of


def rebalance(shard_of: dict[int, int], sizes: list[tuple[int, int, int]], shards: int) -> dict[int, int]:
    """The map edited for a new shard count: slots of shards that are gone, and those above the mean, move.

    Shards that start below the mean take slots, largest first, from shards above it, as long as
    that does not put them above it themselves; every other slot stays where it is.
    """
    size_of = {slot: size for slot, size, _ in sizes}
    loads = [0] * shards
    edited, homeless = {}, []
    for slot, size in size_of.items():
        shard = shard_of.get(slot, shards)
        if shard < shards:
            edited[slot] = shard
            loads[shard] += size
        else:
            homeless.append(slot)
    mean = sum(size_of.values()) / shards
    takers = [s for s in range(shards) if loads[s] < mean]
    for slot in sorted(edited, key=lambda s: (-size_of[s], s)):
        old, size = edited[slot], size_of[slot]
        new = min(takers, key=lambda s: (loads[s], s), default=old)
        if loads[old] > mean and loads[new] + size <= mean:
            edited[slot] = new
            loads[old] -= size
            loads[new] += size
    for slot in sorted(homeless, key=lambda s: (-size_of[s], s)):
        new = min(range(shards), key=lambda s: (loads[s], s))
        edited[slot] = new
        loads[new] += size_of[slot]
    return edited


@dataclass
class SlotMap:
    """Versions of one slot-to-shard map, each a small Parquet table below ``path``."""

    spark: SparkSession
    path: str

    def write(self, version: int, shard_of: dict[int, int], sizes: list[tuple[int, int, int]]) -> DataFrame:
        """Add a version: slot, shard, bytes, rows, and the position of the slot's first record in its shard."""
        next_row: dict[int, int] = {}
        rows = []
        for slot, size, count in sizes:
            shard = shard_of[slot]
            rows.append((slot, shard, size, count, next_row.get(shard, 0)))
            next_row[shard] = next_row.get(shard, 0) + count
        kind = "virtual_slot long, shard int, bytes long, rows long, first_row long"
        self.spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{self.path}/version={version}")
        return self.read(version)

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={version}")

    def edit(self, version: int, shards: int) -> DataFrame:
        """Add the version that follows ``version``, with few slots moved to suit the new shard count."""
        rows = self.read(version).collect()  # a row per slot, a fixed number
        sizes = sorted((r["virtual_slot"], r["bytes"], r["rows"]) for r in rows)
        current = {r["virtual_slot"]: r["shard"] for r in rows}
        return self.write(version + 1, rebalance(current, sizes, shards), sizes)


def placed_by(df: DataFrame, versions: SlotMap, version: int, slots: int = SLOTS) -> DataFrame:
    """Documents with ``shard`` and ``slot`` by one version of a stored map, and their ``virtual_slot``.

    A document whose virtual slot is on no map (it was not there when the map was made) has a null shard.
    """
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    placed = slots_of(df, slots).join(F.broadcast(versions.read(version)), "virtual_slot", "left")
    return placed.withColumn("slot", F.col("first_row") + rank - 1)


def rebalanced(df: DataFrame, shards: int, later: int, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Both placements when ``shards`` become ``later``: doc_id, size, text_crc32, shard, slot, next_shard, next_slot.

    Version 0 of the map is made and stored, read again, edited and stored as version 1; records move with their slots
    only. Null texts count as empty, null ids as an id; repeated rows are placed one by one, an empty table gives an
    empty result, other columns are ignored. Texts are read once per placement and not shuffled.
    """
    spark = df.sparkSession
    sizes = measure(slots_of(df, slots))
    versions = SlotMap(spark, path or new_path(spark, "slot-map"))
    versions.write(0, assign(sizes, shards), sizes)
    versions.edit(0, later)
    new = versions.read(1).select("virtual_slot", F.col("shard").alias("next_shard"), F.col("first_row").alias("next_first"))
    old = placed_by(df, versions, 0, slots)
    both = old.join(F.broadcast(new), "virtual_slot")
    return both.select(
        "doc_id", "size", "text_crc32", "shard", "slot", "next_shard",
        (F.col("next_first") + F.col("slot") - F.col("first_row")).alias("next_slot"),
    )


def shard(df: DataFrame, shards: int, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Documents in ``shards`` shards of nearly equal bytes: law ``bytes``.

    Records are hashed into ``slots`` fixed virtual slots, bytes are added up per slot, and the
    slots are dealt to the shards by size. The map is stored as version 0 below ``path``; a
    later version made by ``rebalance`` moves only some of its slots. ``slot`` is the record's
    position in its shard, gapless from 0: the slot's first position plus the rank in the slot.

    Only the sums per slot reach the driver, a fixed number. The map is broadcast, no larger.
    Null texts count as empty, null ids as an id; equal rows get different positions; a slot
    without rows is on no map; an empty table gives an empty result. Other columns are ignored.
    """
    spark = df.sparkSession
    placed = slots_of(df, slots)
    sizes = measure(placed)
    versions = SlotMap(spark, path or new_path(spark, "slot-map"))
    current = versions.write(0, assign(sizes, shards), sizes)
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return (
        placed.join(F.broadcast(current), "virtual_slot")
        .withColumn("slot", F.col("first_row") + rank - 1)
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
            F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
        )
    )
