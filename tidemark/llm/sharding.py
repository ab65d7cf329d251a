"""Sharding by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the table: a prime, and over a hundred for each shard, which keeps shares even.
SLOTS = 16381
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The shard number of every slot.

    A shard prefers slots in the order offset, offset + skip, ... modulo `slots`;
    as that is prime, the order is a permutation. Shards take turns, each claiming
    its next free slot, until none is free. A shard that goes gives its slots up
    and few others change.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, at least one")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"{slots} is no prime")
    if slots < len(shards):
        raise ValueError("there are more shards than slots")
    at = [_number(f"offset:{s}") % slots for s in shards]
    skip = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            left -= 1
            if not left:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key; null counts as the empty string."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots))


def lookup_table(spark: SparkSession, shards=SHARDS, slots: int = SLOTS) -> DataFrame:
    rows = [(i, shards[s]) for i, s in enumerate(fill(shards, slots))]
    return spark.createDataFrame(rows, "slot bigint, shard string")


def assign(docs: DataFrame, key: str = "doc_id", shards=SHARDS, slots: int = SLOTS) -> DataFrame:
    """`docs` with `slot` and `shard`; columns of those names are replaced.

    The table has `slots` rows whatever the input, so it is broadcast, and placing a
    row takes one look-up and no shuffle. Equal keys share a shard: repeated rows and
    rows without a key each stay together. Shares of distinct keys are even to within a few
    hundredths; a key that many rows share is not split, so shard by doc_id rather
    than by source. An empty table gives no rows.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in ("slot", "shard")]
    placed = docs.select(*columns, slot_of(F.col(f"`{key}`"), slots).alias("slot"))
    return placed.join(F.broadcast(lookup_table(docs.sparkSession, shards, slots)), "slot").select(
        *columns, "slot", "shard"
    )


def write_shards(docs: DataFrame, path: str, files_per_shard: int = 4, **how) -> None:
    """Write `docs` under `path`, a folder for each shard with up to `files_per_shard` files.

    Rows of a shard are dealt to that many tasks by content, so no shard is the work of one.
    """
    if "shard" in docs.columns:
        raise ValueError("the input has a column named shard")
    placed = assign(docs, **how).drop("slot")
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.lit(files_per_shard))
    placed.withColumn("_part", part).repartition("shard", "_part").drop("_part").write.partitionBy(
        "shard"
    ).parquet(path)
