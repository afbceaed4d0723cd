"""Shards by fixed virtual slots.

A record's key hashes to one of thousands of virtual slots for good. A versioned map says which shard
holds a slot; only the map changes when shards are added, and then slots move into the new shard alone.
Maps are kept in a store, a folder with one table for each version and the bytes of its slots beside it; a version is never overwritten. ``rebalance``
loads the last one, edits it by those bytes and saves the next, where an operator wants equal bytes more than a map that follows from the shard count.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, stash

N_SLOTS = 4096
#: Parts of a slot, ranked apart, so that no task ranks a whole large slot.
N_PARTS = 8


@dataclass(frozen=True)
class SlotMap:
    """Version, and the shard of each virtual slot. Edits give a new version and list the moves."""

    version: int
    shard_of: tuple[int, ...]
    moved: tuple[int, ...] = field(default=())

    @property
    def n_shards(self) -> int:
        return max(self.shard_of) + 1 if self.shard_of else 0

    @classmethod
    def first(cls, n_slots: int = N_SLOTS) -> SlotMap:
        return cls(1, (0,) * n_slots)

    def grown(self) -> SlotMap:
        """One more shard: it takes an equal share, from the highest slots of the fullest shards. No other slot moves."""
        new, total = self.n_shards, len(self.shard_of)
        held: dict[int, list[int]] = {s: [] for s in range(new)}
        for slot, shard in enumerate(self.shard_of):
            held[shard].append(slot)
        heap = [(-len(v), s) for s, v in held.items()]
        heapq.heapify(heap)
        moved = []
        for _ in range(total // (new + 1)):
            n, s = heapq.heappop(heap)
            moved.append(held[s].pop())
            heapq.heappush(heap, (n + 1, s))
        out = list(self.shard_of)
        for slot in moved:
            out[slot] = new
        return SlotMap(self.version + 1, tuple(out), tuple(sorted(moved)))

    @classmethod
    def of(cls, n_shards: int, n_slots: int = N_SLOTS) -> SlotMap:
        """The map for a shard count, grown one shard at a time: it follows from the two counts alone."""
        if not 1 <= n_shards <= n_slots:
            raise ValueError(f"shards must be 1 to {n_slots}")
        m = cls.first(n_slots)
        while m.n_shards < n_shards:
            m = m.grown()
        return m

    def rebalanced(self, slot_bytes: dict[int, int], tolerance: float = 0.05) -> SlotMap:
        """Moves slots from the heaviest shard to the lightest until all are within ``tolerance`` of the mean, or no move helps."""
        out, load = list(self.shard_of), [0] * self.n_shards
        for slot, shard in enumerate(out):
            load[shard] += slot_bytes.get(slot, 0)
        mean, moved = sum(load) / max(1, len(load)), set()
        while True:
            hi, lo = max(range(len(load)), key=load.__getitem__), min(range(len(load)), key=load.__getitem__)
            gap = load[hi] - load[lo]
            if load[hi] <= mean * (1 + tolerance) or gap <= 0:
                break
            fit = [(w, s) for s in range(len(out)) if out[s] == hi and 0 < (w := slot_bytes.get(s, 0)) < gap]
            if not fit:
                break
            w, s = min(fit, key=lambda x: (abs(x[0] - gap / 2), x[1]))
            out[s] = lo
            load[hi], load[lo] = load[hi] - w, load[lo] + w
            moved.add(s)
        return SlotMap(self.version + 1, tuple(out), tuple(sorted(moved)))

    def save(self, spark: SparkSession, store: str) -> None:
        """Adds this version to a store; raises if it is there."""
        self.frame(spark).coalesce(1).write.mode("errorifexists").parquet(f"{store}/map/version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, store: str, version: int | None = None) -> SlotMap:
        """The given version of a store's map, or the last."""
        rows = spark.read.schema("virtual_slot int, shard int, version int").parquet(f"{store}/map")
        wanted = rows.agg(F.max("version")).first()[0] if version is None else version
        shard = {r["virtual_slot"]: r["shard"] for r in rows.where(F.col("version") == wanted).collect()}  # as many rows as slots
        if wanted is None or not shard:
            raise ValueError(f"{store} has no version {wanted} of the map")
        return cls(wanted, tuple(shard[i] for i in range(len(shard))))

    def frame(self, spark: SparkSession) -> DataFrame:
        """(virtual_slot, shard): as many rows as there are slots, never more."""
        return spark.createDataFrame(list(enumerate(self.shard_of)), "virtual_slot int, shard int")


def virtual_slots(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS, n_parts: int = N_PARTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes, null none, plus 1), text_crc32, virtual_slot, part.

    The slot is a hash of the id alone (rows without an id share one). The part splits a slot, by the row and by the task that reads it: rows alike in
    all, or without an id, are dealt over parts too. Texts are read whole, however long.
    """
    raw = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    return (
        df.select(F.col(f"`{id_col}`").alias("doc_id"), raw.alias("raw"))
        .select(
            "doc_id",
            (F.octet_length("raw") + 1).cast("long").alias("size"),
            F.crc32("raw").alias("text_crc32"),
        )
        .withColumn("virtual_slot", F.pmod(spread("doc_id"), F.lit(n_slots)).cast("int"))
        .withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.spark_partition_id()), F.lit(n_parts)).cast("int"))
    )


def slot_bytes(slots: DataFrame) -> DataFrame:
    """What each part of each virtual slot holds: rows and bytes. At most n_slots x n_parts rows."""
    return slots.groupBy("virtual_slot", "part").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))


def sharded(
    df: DataFrame, slot_map: SlotMap, id_col: str = "doc_id", text_col: str = "text", n_parts: int = N_PARTS, store: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows with their shard and place, the bytes of each part of each slot, which are also saved beside the map in ``store``).

    Rows: doc_id, size, text_crc32, virtual_slot, shard, slot (place in the shard, gapless from 0, by virtual
    slot, part, id), grown_shard (with one more shard). Rows that repeat an id go to one shard and
    get a place each; null ids sort first; null and empty texts weigh 1; texts are read whole, however long. Other columns are not read. An empty table gives no rows and 0 bytes.
    """
    spark, n_slots = df.sparkSession, len(slot_map.shard_of)
    # written once, as parts follow from the tasks that read the table
    slots = stash(virtual_slots(df, id_col, text_col, n_slots, n_parts), "slots")
    both = slot_map.frame(spark).join(slot_map.grown().frame(spark).withColumnRenamed("shard", "grown_shard"), "virtual_slot")
    weights = slot_bytes(slots)
    # n_slots x n_parts rows at most, whatever the input: bounded, so a broadcast is safe
    cells = both.crossJoin(spark.range(n_parts).select(F.col("id").cast("int").alias("part"))).join(weights, ["virtual_slot", "part"], "left").na.fill(0, ["rows", "bytes"])
    counted = cells.selectExpr(
        f"{slot_map.version} as version", "virtual_slot", "part", "shard", "grown_shard", "rows", "bytes",
        "coalesce(sum(rows) over (partition by shard order by virtual_slot, part rows between unbounded preceding and 1 preceding), 0) as before",
    ).coalesce(1)
    if store is None:
        stored = stash(counted, "slot-bytes")
    else:
        path = f"{store}/bytes/version={slot_map.version}"
        counted.drop("version").write.mode("overwrite").parquet(path)
        stored = spark.read.parquet(path).withColumn("version", F.lit(slot_map.version))
    place = F.broadcast(stored.select("virtual_slot", "part", "shard", "grown_shard", "before"))
    ranked = slots.join(place, ["virtual_slot", "part"]).selectExpr(
        "doc_id", "size", "text_crc32", "virtual_slot", "shard",
        "before + row_number() over (partition by virtual_slot, part order by doc_id, text_crc32, size) - 1 as slot",
        "grown_shard",
    )
    return ranked, stored


def rebalance(spark: SparkSession, store: str, tolerance: float = 0.05) -> SlotMap:
    """The next version of a store's map: the last one, edited by the bytes that its slots held when rows were last placed by it, and saved."""
    last = SlotMap.load(spark, store)
    held = spark.read.parquet(f"{store}/bytes/version={last.version}").groupBy("virtual_slot").agg(F.sum("bytes").alias("bytes")).collect()  # as many rows as slots
    new = last.rebalanced({r["virtual_slot"]: int(r["bytes"]) for r in held}, tolerance)
    new.save(spark, store)
    return new
