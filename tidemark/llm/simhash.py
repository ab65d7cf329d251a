"""SimHash near-duplicates: pigeonhole blocks over distinct fingerprints, verified by Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.graph import components
from tidemark.llm.shared import (
    ascii_lower,
    free,
    map_arrow,
    shuffle_partitions,
    spaced_words,
    written,
)

SHINGLE = 3
DISTANCE = 3
BITS = 64
#: Blocks a fingerprint is cut into. Two that differ in DISTANCE bits agree on all other blocks.
BLOCKS = 6
#: Fingerprints in a bucket above which the bucket is cut again by its remaining bits.
LARGE = 4096
#: Hashes whose bits are counted at once.
COUNTED = 1 << 16


# --- fingerprints ----------------------------------------------------------------------


def _majority(lengths: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One fingerprint for each length: the bits that over half of its hashes have."""
    counts = np.zeros((len(lengths), BITS), np.int64)
    ends = np.cumsum(lengths)
    for start in range(0, len(hashes), COUNTED):
        stop = min(start + COUNTED, len(hashes))
        first = int(np.searchsorted(ends, start, side="right"))
        last = int(np.searchsorted(ends, stop - 1, side="right"))
        owners = np.arange(first, last + 1)
        owners = owners[lengths[owners] > 0]
        cuts = np.maximum(ends[owners] - lengths[owners] - start, 0)
        bits = np.unpackbits(hashes[start:stop].astype(">u8").view(np.uint8)).reshape(-1, BITS)
        counts[owners] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
    return np.packbits(2 * counts > lengths[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, text: str = "text", n: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a long; zero for texts without words.

    Hashed are all runs of `n` words, repeats included (XXH64 with seed 42, which is
    Spark's own), or the whole text if it has fewer words.
    """
    words = docs.select("doc_id", spaced_words(ascii_lower(F.col(f"`{text}`"))).alias("w"))
    runs = F.transform(
        F.slice("w", F.lit(1), F.size("w") - (n - 1)),
        lambda x, i: F.xxhash64(F.concat_ws(" ", x, *[F.get("w", i + k) for k in range(1, n)])),
    )
    hashes = (
        F.when(F.size("w") == 0, F.array().cast("array<bigint>"))
        .when(F.size("w") < n, F.array(F.xxhash64(F.array_join("w", " "))))
        .otherwise(runs)
    )
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64)
            fps = _majority(np.diff(offsets).astype(np.int64), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"]
            )

    return map_arrow(words.select("doc_id", hashes.alias("h")), run, f"doc_id {id_type}, fp bigint")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- links -----------------------------------------------------------------------------


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _blocks(places: list[int], parts: int) -> list[list[int]]:
    """`places` in `parts` runs of nearly equal length."""
    return [list(x) for x in np.array_split(np.array(places), parts)]


def masks(places: list[int], parts: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """A mask for each choice of blocks that two close fingerprints can agree on."""
    blocks = _blocks(places, parts)
    return [
        sum(1 << int(b) for block in chosen for b in block)
        for chosen in combinations(blocks, parts - distance)
    ]


def spanning(fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links between distinct fingerprints that join the same ones as all links of `distance` do.

    A walk from each fingerprint takes every one not yet reached that is close to
    it, so n fingerprints give fewer than n links.
    """
    rest, left, right = fps, [], []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= distance
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), at))
                right.append(found)
                queue.extend(found)
                rest = rest[~near]
    if not left:
        return fps[:0], fps[:0]
    return np.concatenate(left), np.concatenate(right)


def _verify(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal keys."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    left, right = [], []
    small = np.repeat((sizes > 1) & (sizes <= 8), sizes)
    index = np.flatnonzero(small)
    for step in range(1, 8):
        index = index[index + step < len(keys)]
        index = index[keys[index] == keys[index + step]]
        near = np.bitwise_count(fps[index] ^ fps[index + step]) <= distance
        left.append(fps[index[near]])
        right.append(fps[index[near] + step])
    for k in np.flatnonzero(sizes > 8):
        a, b = spanning(fps[starts[k] : starts[k] + sizes[k]], distance)
        left.append(a)
        right.append(b)
    return np.concatenate(left), np.concatenate(right)


def _links_in_buckets(buckets: DataFrame, distance: int) -> DataFrame:
    """(a, b) of close fingerprints in rows (key, fp); buckets are no larger than memory allows."""
    n = shuffle_partitions(buckets.sparkSession)
    dealt = buckets.select("key", "fp").repartition(n, "key").sortWithinPartitions("key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def links(end: int) -> pa.RecordBatch:
            a, b = _verify(keys[:end], fps[:end], distance)
            return pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]
            )

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            # the last key's bucket may go on in the next batch
            done = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if done:
                yield links(done)
                keys, fps = keys[done:], fps[done:]
        if len(keys) > 1:
            yield links(len(keys))

    return map_arrow(dealt, run, "a bigint, b bigint")


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links between distinct fingerprints `fp` that connect all within `distance` bits.

    A fingerprint is cut into BLOCKS blocks. Two that differ in at most `distance`
    bits agree on BLOCKS - distance of them, so every choice of as many blocks makes a
    bucket key, and each close pair meets in at least one bucket, where its
    distance is counted. A bucket of over LARGE fingerprints is cut again in the
    same way by the bits outside its key; what then shares a bucket differs in at
    most 18 bits, which bounds it. Buckets give fewer links than members.
    """
    tables = masks(list(range(BITS)), BLOCKS, distance)

    def keyed(rows: DataFrame, choices: Column) -> DataFrame:
        return rows.select("fp", F.explode(choices).alias("key"))

    def bucket(table: int, mask: int, *seed: Column) -> Column:
        # a hash stands for table and masked bits; should two buckets share one, pairs are still verified
        return F.xxhash64(*seed, F.lit(table), F.col("fp").bitwiseAND(F.lit(_signed(mask))))

    rows = keyed(fps.select("fp"), F.array(*[bucket(t, m) for t, m in enumerate(tables)]))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
    wide = written(sizes.where(F.col("n") > LARGE).select("key"), "wide-buckets")
    if wide.isEmpty():
        return _links_in_buckets(rows, distance)
    named = fps.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(t).alias("t"), bucket(t, m).alias("key")) for t, m in enumerate(tables)])
        ).alias("x"),
    ).select("fp", "x.t", "x.key")
    # a later cut takes the bits that the table's own key leaves free
    finer = None
    for t, m in enumerate(tables):
        free = [b for b in range(BITS) if not m >> b & 1]
        cut = F.array(*[bucket(s, x, F.col("key")) for s, x in enumerate(masks(free, BLOCKS, distance))])
        finer = cut if finer is None else F.when(F.col("t") == t, cut).otherwise(finer)
    again = named.join(wide, "key").select("fp", F.explode(finer).alias("key"))
    narrow = named.join(wide, "key", "left_anti").select("fp", "key")
    return _links_in_buckets(narrow, distance).unionByName(_links_in_buckets(again, distance))


# --- groups ----------------------------------------------------------------------------


def near_duplicates(
    docs: DataFrame, text: str = "text", n: int = SHINGLE, distance: int = DISTANCE
) -> DataFrame:
    """(doc_id, fp, component_id) for every row: component_id is the smallest doc_id reachable.

    Only fingerprints are grouped, never texts: equal ones are one class with its
    smallest doc_id, and links run between classes. Texts without words share
    fingerprint zero and are linked like any other. Repeated rows each come back;
    a null doc_id keeps its row, but is no candidate for component_id, which is null
    only where a group has no other id. An empty table gives no rows.
    """
    own = written(fingerprints(docs, text, n), "fingerprints")
    classes = written(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    linked = components(links(classes, distance))
    rooted = classes.join(linked, classes["fp"] == linked["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )
    rooted = written(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.join(smallest, "root").select("fp", "component_id"), "named")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """One document of each group of near duplicates, with its own columns.

    It is the one with the smallest doc_id, of different texts under that id the one with
    the smallest text hash; a null doc_id comes after all others. Rows that agree in doc_id and
    text are one document and one of them stays. Different texts under one doc_id are
    different documents. An empty table gives none.
    """
    key, digest, nth, left = free(docs, "_key", "_digest", "_nth", "_left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashed = F.xxhash64(F.col(f"`{text}`"))
    keyed = docs.select(
        F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("id"), hashed.alias("hash")).alias("doc_id"),
        F.col(f"`{text}`").alias("text"),
    )
    groups = near_duplicates(keyed)
    keepers = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keepers = written(keepers.select(F.col("doc_id.id").alias(left), F.col("doc_id.hash").alias(digest)).distinct(), "keepers")
    rows = docs.select(*columns, hashed.alias(key))
    same = rows["doc_id"].eqNullSafe(keepers[left]) & (rows[key] == keepers[digest])
    once = Window.partitionBy("doc_id", key).orderBy(F.lit(0))
    kept = rows.join(keepers, same).withColumn(nth, F.row_number().over(once)).where(F.col(nth) == 1)
    return kept.select(*columns)
