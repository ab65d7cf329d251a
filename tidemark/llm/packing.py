"""Best-fit decreasing packing of documents into sequences of bounded length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.encoding import encoded
from tidemark.llm.shared import map_arrow, shuffle_partitions, written

MOST, END = 2048, 0
#: Groups of equal length are dealt out to so many buckets for each shuffle partition.
BUCKETS_EACH = 4
#: Bits of a rank among pieces of one length.
RANK_BITS = 46


class Capacities:
    """A segment tree over remaining capacities 0 to `most`: which of them have an open bin."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.open = bytearray(2 * self.leaves)

    def mark(self, capacity: int, is_open: bool) -> None:
        i = self.leaves + capacity
        self.open[i] = is_open
        while i > 1:
            i >>= 1
            self.open[i] = self.open[2 * i] | self.open[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of at least `need` that has an open bin, in logarithmic time."""
        i = self.leaves + need
        if not self.open[i]:
            while i > 1 and (i & 1 or not self.open[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.leaves


def plan(counts: Mapping[int, int], most: int = MOST) -> tuple[np.ndarray, int]:
    """Where best-fit decreasing puts `counts[length]` pieces of each length, and the number of bins.

    Rows are (length, rank, each, bin, filled): pieces of that length from that rank on go
    `each` to a bin, from that bin on, behind `filled` tokens. Pieces of one length stand
    together in the order of packing, and after one of them has gone into the tightest bin
    that bin stays the tightest for the next until it is full; so bins of equal capacity
    are filled as one run and the result is that of placing piece by piece. A length
    splits at most one run and opens at most two, so the plan does not grow with the data.
    """
    tree = Capacities(most)
    runs: dict[int, list[tuple[int, int]]] = {}
    rows, bins = [], 0

    def add(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            runs.setdefault(capacity, []).append((first, n))
            tree.mark(capacity, True)

    for length in sorted(counts, reverse=True):
        if not 0 < length <= most:
            raise ValueError(f"a piece of {length} tokens does not fit")
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, n = most, bins, -(-left // (most // length))
                bins += n
            else:
                first, n = runs[capacity].pop()
                if not runs[capacity]:
                    tree.mark(capacity, False)
            each = min(capacity // length, left)
            filled = min(n, left // each)
            rows.append((length, rank, each, first, most - capacity))
            add(capacity - each * length, first, filled)
            rank, left = rank + filled * each, left - filled * each
            if capacity < most:
                add(capacity, first + filled, n - filled)
            else:
                bins -= n - filled
    return np.array(rows, np.int64).reshape(-1, 5), bins


def pieces(docs: DataFrame, tokenizer: str, most: int = MOST, end: int = END,
           text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): whole texts as ids and the end id, cut at `most`.

    Null and empty texts are the end id alone. With `keep_ids` also `ids`, the piece's ids as
    little-endian unsigned 32-bit integers. Other columns of `docs` are not carried.
    """
    source = docs.select("doc_id", F.col(f"`{text}`").cast("binary").alias("_text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, ids, bounds in encoded(batch.column(1), tokenizer, end):
                n = np.diff(bounds)
                cuts = -(-n // most)
                doc = np.repeat(np.arange(len(n)), cuts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = piece * most
                length = np.minimum(most, n[doc] - start)
                data = ids.astype("<u4").tobytes()
                places = list(zip((bounds[doc] + start) * 4, length * 4, strict=True))
                view = memoryview(data)
                columns = {
                    "doc_id": batch.column(0)[part].take(pa.array(doc)),
                    "piece": pa.array(piece.astype(np.int32)),
                    "start": pa.array(start),
                    "length": pa.array(length),
                    "ids_crc32": pa.array([zlib.crc32(view[a : a + k]) for a, k in places], pa.int64()),
                }
                if keep_ids:
                    columns["ids"] = pa.array([data[a : a + k] for a, k in places], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    ids = ", ids binary" if keep_ids else ""
    return map_arrow(
        source, run, f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint{ids}"
    )


def place(cut: DataFrame, most: int = MOST) -> DataFrame:
    """Adds `sequence_id` and `offset` to a stored table of pieces; `length` is each one's size.

    Only the counts of each length, at most `most` rows, reach the driver, which plans runs of
    bins for them. A piece finds its place by its rank among pieces of its length. Ranks
    are counted in buckets of the row's hash, and the buckets' totals summed before, so a length
    that holds most rows is spread over all tasks. Equal rows are interchangeable. An empty table
    gives none. `cut` must be stored, as it is read three times.
    """
    buckets = BUCKETS_EACH * shuffle_partitions(cut.sparkSession)
    rows = cut.withColumn("_bucket", F.pmod(F.xxhash64(*cut.columns), F.lit(buckets)).cast("int"))
    cells = rows.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    steps, _ = plan(counts, most)
    # rows of one length stand in ascending rank
    steps = steps[np.lexsort((steps[:, 1], steps[:, 0]))]
    keys = (steps[:, 0] << RANK_BITS) + steps[:, 1]
    earlier = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.select(
        "length", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base")
    )
    inside = Window.partitionBy("length", "_bucket").orderBy(*cut.columns)
    ranked = (
        rows.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(bases, ["length", "_bucket"])
        .select(*[F.col(f"`{c}`") for c in cut.columns], (F.col("_base") + F.col("_rank")).alias("_rank"))
    )
    names, at = cut.columns, cut.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column(at).to_numpy(), batch.column(len(names)).to_numpy()
            step = steps[np.searchsorted(keys, (length << RANK_BITS) + rank, "right") - 1]
            beyond = rank - step[:, 1]
            sequence, slot = step[:, 3] + beyond // step[:, 2], beyond % step[:, 2]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(sequence), pa.array(step[:, 4] + slot * length)],
                names=[*names, "sequence_id", "offset"],
            )

    schema = cut.schema.add("sequence_id", "long").add("offset", "long")
    return map_arrow(ranked, run, schema)


def pack(docs: DataFrame, tokenizer: str, most: int = MOST, end: int = END,
         text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    Rows with null or repeated doc_ids are documents of their own; only documents
    longer than `most` are cut.
    """
    return place(written(pieces(docs, tokenizer, most, end, text, keep_ids), "pieces"), most)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, doc_ids, starts, ids): whole sequences of pieces packed with their ids.

    A sequence has at most as many pieces as tokens. `starts` are the pieces' offsets, where
    attention and positions begin anew; `ids` are unsigned 32-bit little-endian.
    """
    held = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(held.alias("p")).select(
        "sequence_id",
        F.aggregate("p.length", F.lit(0).cast("bigint"), lambda a, n: a + n).alias("n_tokens"),
        F.col("p.doc_id").alias("doc_ids"),
        F.col("p.offset").alias("starts"),
        F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"),
    )
