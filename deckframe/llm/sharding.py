"""Sharding by fixed virtual slots with a versioned slot-to-shard map.

A record hashes into one of a few thousand virtual slots, once and for all. Bytes are added up
for each slot, and a map from slots to shards is made from these sums: heaviest slot first, each
to the lightest shard. Rebalancing edits the map, never the hash: ``grow`` moves just as many
slots as a new shard needs. The map is one table at a path of its own; every edit appends a version,
and ``shard`` with the path of a map that is there places rows by its last version.

Rows that repeat both id and text are counted before anything else, and the number of the copy
enters the hash, so a row that is there a billion times spreads over all slots.

Defined cases: a null text counts as empty; a null id is hashed as such; rows that repeat both id
and text each have a place of their own; an empty table gives an empty result and a map of empty
slots; a text of any length is one row of its size; other columns are ignored.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from deckframe.llm.common import cut, shared_dir, text_of

#: Virtual slots; it bounds what the driver gathers and what is broadcast.
SLOTS = 8192
SEED = 20240607
#: Copies of one row that one task makes.
COPIES = 1 << 16

MAP_SCHEMA = T.StructType([
    T.StructField("version", T.IntegerType(), False),
    T.StructField("n_shards", T.IntegerType(), False),
    T.StructField("vslot", T.IntegerType(), False),
    T.StructField("shard", T.IntegerType(), False),
    T.StructField("slot_bytes", T.LongType(), False),
    T.StructField("slot_rows", T.LongType(), False),
])


@dataclass(frozen=True)
class SlotMap:
    """One version of the map: for each virtual slot its shard, bytes and rows."""

    version: int
    n_shards: int
    shard: tuple[int, ...]
    slot_bytes: tuple[int, ...]
    slot_rows: tuple[int, ...]

    def loads(self) -> list[int]:
        out = [0] * self.n_shards
        for s, b in zip(self.shard, self.slot_bytes, strict=True):
            out[s] += b
        return out

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, self.n_shards, i, *x) for i, x in enumerate(zip(self.shard, self.slot_bytes, self.slot_rows, strict=True))]
        return spark.createDataFrame(rows, MAP_SCHEMA)

    @staticmethod
    def from_frame(df: DataFrame, version: int) -> SlotMap:
        rows = sorted((r.vslot, r.shard, r.slot_bytes, r.slot_rows, r.n_shards) for r in df.where(F.col("version") == version).collect())
        _, shard, size, count, n_shards = zip(*rows, strict=True)
        return SlotMap(version, n_shards[0], shard, size, count)


def balanced(slot_bytes: list[int], slot_rows: list[int], n_shards: int) -> SlotMap:
    """The first version: heaviest slot first to the lightest shard, then fewest rows, then least number."""
    shard = [0] * len(slot_bytes)
    heap = [(0, 0, s) for s in range(n_shards)]
    for i in sorted(range(len(slot_bytes)), key=lambda i: (-slot_bytes[i], i)):
        load, count, s = heapq.heappop(heap)
        shard[i] = s
        heapq.heappush(heap, (load + slot_bytes[i], count + slot_rows[i], s))
    return SlotMap(1, n_shards, tuple(shard), tuple(slot_bytes), tuple(slot_rows))


def grow(old: SlotMap) -> SlotMap:
    """The next version, with one shard more. Slots move into the new shard only."""
    shard, new, loads = list(old.shard), old.n_shards, [*old.loads(), 0]
    share = sum(old.slot_bytes) / (new + 1)
    own: dict[int, list[int]] = {s: [] for s in range(new)}
    for i in sorted(range(len(shard)), key=lambda i: (old.slot_bytes[i], i)):
        own[old.shard[i]].append(i)  # ascending, so the heaviest is taken first
    while True:
        donor = max(range(new), key=lambda s: (loads[s], -s))
        fit = next((i for i in reversed(own[donor]) if 0 < old.slot_bytes[i] and loads[new] + old.slot_bytes[i] <= share), None)
        if fit is None:
            break
        own[donor].remove(fit)
        shard[fit] = new
        loads[donor] -= old.slot_bytes[fit]
        loads[new] += old.slot_bytes[fit]
    return replace(old, version=old.version + 1, n_shards=new + 1, shard=tuple(shard))


# the table of versions ----------------------------------------------------------------------


def new_map(spark: SparkSession) -> str:
    """A path for a map in the shared folder."""
    return f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"


def versions(spark: SparkSession, path: str) -> DataFrame | None:
    """The table of versions, None where there is none yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(MAP_SCHEMA).parquet(path)


def latest(spark: SparkSession, path: str) -> SlotMap | None:
    """The last version; the driver gathers one row for each slot."""
    table = versions(spark, path)
    last = None if table is None else table.agg(F.max("version").alias("v")).first().v
    return None if last is None else SlotMap.from_frame(table, last)


def append(spark: SparkSession, path: str, made: SlotMap) -> SlotMap:
    """Adds a version, and reads it back."""
    made.to_frame(spark).coalesce(1).write.mode("append").parquet(path)
    return latest(spark, path)


def add_shard(spark: SparkSession, path: str) -> SlotMap:
    """Edits the map at a path: its next version has one shard more."""
    return append(spark, path, grow(latest(spark, path)))


# rows ---------------------------------------------------------------------------------------


def slotted(docs: DataFrame, slots: int = SLOTS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, vslot: the hash of id, text and the number of the copy decides the slot.

    Only these short columns are shuffled, and copies are counted before that.
    """
    own = docs.select(
        "doc_id", (F.octet_length(text_of()) + 1).cast("long").alias("size"), F.crc32(text_of()).alias("text_crc32"),
        F.xxhash64(F.lit(seed), "doc_id", text_of()).alias("_hash"),
    )
    rows = cut(own.groupBy("doc_id", "size", "text_crc32", "_hash").agg(F.count(F.lit(1)).alias("_n")), "counted")
    number = lambda last: F.explode(F.sequence(F.lit(0).cast("long"), last))
    rows = rows.withColumn("_part", F.lit(0).cast("long"))
    if (rows.agg(F.max("_n").alias("n")).first().n or 0) > COPIES:
        rows = rows.withColumn("_part", number(F.floor((F.col("_n") - 1) / COPIES).cast("long"))).repartition("_hash", "_part")
    left = F.least(F.lit(COPIES), F.col("_n") - F.col("_part") * COPIES)
    rows = rows.withColumn("_copy", number((left - 1).cast("long"))).withColumn("_copy", F.col("_part") * COPIES + F.col("_copy"))
    return rows.select("doc_id", "size", "text_crc32", F.pmod(F.xxhash64("_hash", "_copy"), F.lit(slots)).cast("int").alias("vslot"))


def slot_sums(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot; the driver gathers one row for each slot."""
    size, count = [0] * slots, [0] * slots
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        size[r.vslot], count[r.vslot] = r.b, r.n
    return size, count


def shard(docs: DataFrame, n_shards: int = 8, slots: int = SLOTS, map_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(placed rows, table of the map's versions).

    Placed rows: doc_id, size, text_crc32, law (``bytes``), shard, slot (the row's place in its
    shard, gapless from 0), grown_shard (null under this law), vslot, map_version. A place is its
    virtual slot's offset within the shard plus the rank within the virtual slot.

    Without a map at ``map_path`` one is made and stored there. A map that is there is kept: it is
    grown until it has ``n_shards``, each step a version, and rows go where its last version says.
    """
    spark = docs.sparkSession
    path = map_path or new_map(spark)
    made = latest(spark, path)
    if made is not None and (made.n_shards > n_shards or len(made.shard) != slots):
        raise ValueError(f"the map at {path} has {made.n_shards} shards and {len(made.shard)} slots")
    rows = cut(slotted(docs, slots), "slotted")
    size, count = slot_sums(rows, slots)
    if made is None:
        made = append(spark, path, balanced(size, count, n_shards))
    while made.n_shards < n_shards:
        made = add_shard(spark, path)
    base, filled = [], [0] * n_shards
    for s, n in zip(made.shard, count, strict=True):
        base.append(filled[s])
        filled[s] += n
    places = spark.createDataFrame(list(zip(range(slots), made.shard, base, strict=True)), "vslot int, shard int, base long")
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    placed = rows.withColumn("rank", rank).join(F.broadcast(places), "vslot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.col("rank") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(made.version).alias("map_version"),
    )
    return placed, versions(spark, path)


def with_next(placed: DataFrame, path: str) -> DataFrame:
    """Adds next_shard: where rows go under the next version of the map at ``path``, which has one shard more and is appended here."""
    spark = placed.sparkSession
    after = add_shard(spark, path)
    moved = versions(spark, path).where(F.col("version") == after.version).select("vslot", F.col("shard").alias("next_shard"))
    return placed.join(F.broadcast(moved), "vslot").select(*placed.columns, "next_shard")
