"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records hash by id into a fixed number of slots.  Bytes and rows are summed
per slot (a result bounded by the slot count), the map is edited on those sums
alone, and records take the shard of their slot.  Growing or rebalancing edits
the map; records never rehash.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hydrospark.storage import scratch, write_table

N_SLOTS = 8192
N_SHARDS = 40
ROW_BYTES = 16


@dataclass
class SlotMap:
    """``shard_of[slot]`` at one version; every edit gives the next version."""

    version: int
    n_shards: int
    shard_of: list[int] = field(repr=False)

    @staticmethod
    def initial(n_shards: int = N_SHARDS, n_slots: int = N_SLOTS) -> SlotMap:
        return SlotMap(0, n_shards, [s % n_shards for s in range(n_slots)])

    def rebalanced(self, slot_bytes: dict[int, int], n_shards: int | None = None, tolerance: float = 1e-4) -> SlotMap:
        """Move slots from heavy to light shards until loads agree within ``tolerance`` of their mean.

        Shards shed their largest slots down to the mean, the freed slots go to
        the lightest shards in order of size, then single moves and swaps
        between the heaviest and the lightest shard close what is left.
        ``n_shards`` may grow; slots without bytes stay where they are.
        """
        n = n_shards or self.n_shards
        shard_of = [s if s < n else s % n for s in self.shard_of]
        held: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        load = [0] * n
        for slot, size in slot_bytes.items():
            if size:
                held[shard_of[slot]].append((size, slot))
                load[shard_of[slot]] += size
        mean = sum(load) / n
        freed = []
        for k in range(n):
            held[k].sort()
            while held[k] and load[k] - held[k][-1][0] / 2 > mean:
                size, slot = held[k].pop()
                load[k] -= size
                freed.append((size, slot))
        for size, slot in sorted(freed, reverse=True):
            k = min(range(n), key=load.__getitem__)
            held[k].append((size, slot))
            load[k] += size
        for own in held:
            own.sort()
        for _ in range(20 * n):
            hi, lo = max(range(n), key=load.__getitem__), min(range(n), key=load.__getitem__)
            gap = load[hi] - load[lo]
            if gap <= max(1, tolerance * mean):
                break
            best = None  # (distance of the moved bytes from half the gap, slot of hi, slot of lo)
            for give in held[hi]:
                options = [None]
                i = bisect_left(held[lo], (give[0] - gap // 2, -1))
                options += held[lo][max(0, i - 1) : i + 1]
                for back in options:
                    moved = give[0] - (back[0] if back else 0)
                    if 0 < moved < gap and (best is None or abs(2 * moved - gap) < best[0]):
                        best = (abs(2 * moved - gap), give, back)
            if best is None:
                break
            for item, a, b in ((best[1], hi, lo), (best[2], lo, hi)):
                if item:
                    held[a].remove(item)
                    held[b].insert(bisect_left(held[b], item), item)
                    load[a] -= item[0]
                    load[b] += item[0]
        for k in range(n):
            for _, slot in held[k]:
                shard_of[slot] = k
        return SlotMap(self.version + 1, n, shard_of)

    def save(self, spark: SparkSession, path: str) -> None:
        """Append this version to the map table at ``path``."""
        shards = ",".join(map(str, self.shard_of))
        one = spark.range(1).select(
            F.lit(self.version).alias("version"),
            F.lit(self.n_shards).alias("n_shards"),
            F.posexplode(F.split(F.lit(shards), ",").cast("array<int>")).alias("virtual_slot", "shard"),
        )
        one.write.mode("append").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, the latest by default; at most one row for each slot is read."""
        table = spark.read.parquet(path)
        at = version if version is not None else table.agg(F.max("version")).first()[0]
        rows = sorted((r.virtual_slot, r.shard, r.n_shards) for r in table.where(F.col("version") == at).collect())
        return SlotMap(at, rows[0][2], [r[1] for r in rows])


def ints(values: list[int], kind: str):
    """A constant array column."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def records(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot``; a null text has no bytes, a null id hashes by its text."""
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(F.coalesce("text", F.lit("")))).otherwise(F.xxhash64("doc_id"))
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.pmod(key, F.lit(n_slots)).cast("int").alias("virtual_slot"),
    )


def stored_map(spark: SparkSession, path: str, n_shards: int, n_slots: int) -> SlotMap:
    """The latest map at ``path``; where there is none, the initial one is stored first."""
    try:
        return SlotMap.load(spark, path)
    except AnalysisException:  # no table at the path
        first = SlotMap.initial(n_shards, n_slots)
        first.save(spark, path)
        return first


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """Put every row into a shard and a gapless place within it; the law is ``bytes``.

    The slot map is kept in a table at ``map_path`` (by default a new one in
    the shared folder): its latest version is loaded, edited on the bytes per
    slot, stored as the next version and applied as stored.  A later call on
    the same path moves only the slots that new loads or shards ask for.

    One row comes out for each row that comes in, repeated rows included; rows
    that share an id share a slot.  Null texts have no bytes, null ids hash by
    their text, and a text may be of any length.  An empty table gives an
    empty result.  Equal texts are not kept together: a group of copies may be
    larger than a shard, and the law asks for near equal bytes.  Places are
    ranks within the virtual slot plus the rows of the slots before it in the
    same shard, so no task sorts a whole shard.  Other columns of the input
    are ignored.
    """
    spark = docs.sparkSession
    path = map_path or scratch(spark, "slot-map")
    kept = write_table(records(docs, n_slots), "records").df
    sums = kept.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    sums = {r.virtual_slot: (r.bytes, r.rows) for r in sums.collect()}  # at most n_slots rows
    edited = stored_map(spark, path, n_shards, n_slots).rebalanced({s: b for s, (b, _) in sums.items()}, n_shards)
    edited.save(spark, path)
    new = SlotMap.load(spark, path, edited.version)
    first, filled = [0] * n_slots, [0] * new.n_shards
    for slot in range(n_slots):
        first[slot] = filled[new.shard_of[slot]]
        filled[new.shard_of[slot]] += sums.get(slot, (0, 0))[1]
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    at = F.col("virtual_slot") + 1
    return kept.withColumn("rank", rank).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.element_at(ints(new.shard_of, "int"), at).alias("shard"),
        (F.element_at(ints(first, "bigint"), at) + F.col("rank") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(new.version).alias("map_version"),
    )
