"""Token ids as directly addressable codes: chunk levels, continuation bitmaps, rank directories."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.encoding import bytes_of, encoded
from tidemark.llm.shared import discard, fresh_path, map_arrow, shuffle_partitions, written

END = 1
#: Tokens after which a segment is closed; it always holds whole documents.
SEGMENT_TOKENS = 1 << 19
MAGIC = b"DAC1"
CHUNK = 8
#: Bits of a continuation bitmap to each entry of its rank directory.
RANK_EVERY = 512


# --- the codes -------------------------------------------------------------------------


def pack(ids: np.ndarray) -> bytes:
    """Ids (unsigned, 32 bits) as chunk levels of 8 bits.

    Level 0 holds the low chunk of every id; a set bit in its bitmap says that
    the id goes on in level 1, at the place that the bit's rank gives, and so on.
    The directory has the rank before each block of RANK_EVERY bits.
    """
    rest = np.ascontiguousarray(ids, dtype="<u4")
    levels = []
    while True:
        more = rest >> CHUNK != 0
        bits = np.packbits(more, bitorder="little")
        step = RANK_EVERY // 8
        ones = np.bitwise_count(bits).astype(np.uint32)
        blocks = np.add.reduceat(ones, np.arange(0, len(ones), step)) if len(ones) else ones
        ranks = np.concatenate([[0], np.cumsum(blocks)])[: len(blocks)].astype("<u4")
        levels.append((len(rest), (rest & 0xFF).astype(np.uint8), bits, ranks))
        if not more.any():
            break
        rest = rest[more] >> CHUNK
    out = [MAGIC, struct.pack("<I", len(levels))]
    for n, low, bits, ranks in levels:
        out += [struct.pack("<I", n), low.tobytes(), bits.tobytes(), ranks.tobytes()]
    return b"".join(out)


class Codes:
    """Reads packed ids: any single one in constant time, or a whole range."""

    def __init__(self, packed: bytes):
        if packed[:4] != MAGIC:
            raise ValueError("not a code segment")
        (n_levels,) = struct.unpack_from("<I", packed, 4)
        self.levels, at = [], 8
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<I", packed, at)
            at += 4
            n_bits, n_ranks = -(-n // 8), -(-n // RANK_EVERY)
            low = np.frombuffer(packed, np.uint8, n, at)
            bits = np.frombuffer(packed, np.uint8, n_bits, at + n)
            ranks = np.frombuffer(packed, "<u4", n_ranks, at + n + n_bits)
            at += n + n_bits + 4 * n_ranks
            self.levels.append((low, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        """One id, from one byte, one bit and one rank at each of its levels."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = shift = 0
        for low, bits, ranks in self.levels:
            value |= int(low[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_EVERY
            between = bits[block * (RANK_EVERY // 8) : i >> 3]
            below = int(bits[i >> 3]) & ((1 << (i & 7)) - 1)
            i = int(ranks[block]) + int(np.bitwise_count(between).sum()) + below.bit_count()
            shift += CHUNK
        return value

    def all(self) -> np.ndarray:
        """Every id, by filling the levels from the last one up."""
        upper = np.zeros(0, np.uint32)
        for low, bits, _ in reversed(self.levels):
            value = low.astype(np.uint32)
            more = np.unpackbits(bits, count=len(low), bitorder="little").view(bool)
            value[more] |= upper << np.uint32(CHUNK)
            upper = value
        return upper


# --- encoding --------------------------------------------------------------------------


def encode(docs: DataFrame, path: str, text: str = "text", end: int = END) -> DataFrame:
    """(doc_id, n_tokens, ids): the ids of every whole text and the end id, as little-endian bytes.

    Ids take two bytes each if the vocabulary allows, else four; `width` says which.
    """
    source = docs.select("doc_id", F.col(f"`{text}`").cast("binary").alias("_text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, ids, bounds in encoded(batch.column(1), path, end):
                n, width = len(bounds) - 1, ids.dtype.itemsize
                offsets = pa.py_buffer((bounds * width).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[part],
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array(np.full(n, width, np.int32)),
                        pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(ids)]),
                    ],
                    names=["doc_id", "n_tokens", "width", "ids"],
                )

    return map_arrow(source, run, f"doc_id {id_type}, n_tokens bigint, width int, ids binary")


# --- files -----------------------------------------------------------------------------

def write_files(docs: DataFrame, tokenizer: str, path: str, text: str = "text") -> None:
    """Encode `docs` and write them as segments of directly addressable codes under `path`.

    Files hold documents in ascending doc_id order (null ids first; rows that
    share an id are ordered by their ids and each kept). Encoded texts are written
    once, so that dealing them out by ranges of doc_id repeats no encoding; every
    task writes segments of about SEGMENT_TOKENS tokens. Spark commits a task's
    files as a whole, so a lost executor leaves no half-written segment. Null and
    empty texts are the end id alone; an empty table gives files without rows.
    """
    held_ids = written(encode(docs, tokenizer, text), "encoded")
    id_type = held_ids.schema["doc_id"].dataType
    dealt = held_ids.repartitionByRange(
        shuffle_partitions(docs.sparkSession), "doc_id"
    ).sortWithinPartitions("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, seq = context.partitionId() if context else 0, 0
        doc_ids: list[pa.Array] = []
        counts: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held = before = 0

        def segment() -> pa.RecordBatch:
            ids = pa.concat_arrays(doc_ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([seq], pa.int32()),
                    pa.array([before], pa.int64()),
                    pa.array([held], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    pa.array([np.concatenate(counts)], pa.list_(pa.int64())),
                    pa.array([pack(np.concatenate(parts))], pa.binary()),
                ],
                names=["part", "seq", "before", "n_tokens", "doc_ids", "doc_tokens", "codes"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            # one encoder wrote all rows, so they have one width
            raw, bounds = bytes_of(batch.column(3))
            width = batch.column(2)[0].as_py()
            ids, at = raw.view(f"<u{width}"), bounds // width
            first = 0
            while first < batch.num_rows:
                # the documents from `first` on that the segment still has room for
                end = int(np.searchsorted(at, at[first] + SEGMENT_TOKENS - held, "right")) - 1
                if end <= first and held:
                    yield segment()
                    seq, before, held = seq + 1, before + held, 0
                    doc_ids, counts, parts = [], [], []
                    continue
                end = max(end, first + 1)
                doc_ids.append(batch.column(0).slice(first, end - first))
                counts.append(np.diff(at[first : end + 1]))
                parts.append(ids[at[first] : at[end]])
                held += int(at[end] - at[first])
                first = end
        if doc_ids:
            yield segment()

    map_arrow(dealt, run,
        f"part int, seq int, before bigint, n_tokens bigint, doc_ids array<{id_type.simpleString()}>, "
        "doc_tokens array<bigint>, codes binary",
    ).write.option("compression", "zstd").parquet(path)
    discard(held_ids)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments under `path` with `start`, the number of ids in all segments before each.

    A segment knows the ids before it in its own part. The parts' totals, one row for
    each task that wrote, are summed on the driver and broadcast.
    """
    segments = spark.read.parquet(path)
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before, bases = 0, {}
    for row in totals:
        bases[row["part"]] = before
        before += row["n"]
    base = spark.createDataFrame(list(bases.items()) or [(0, 0)], "part int, base bigint")
    return segments.join(F.broadcast(base), "part").withColumn(
        "start", F.col("base") + F.col("before")
    )


def documents(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the segments."""
    id_type = segments.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start = batch.column(0)[i].as_py()
                counts = batch.column(2)[i].values.to_numpy()
                ids = Codes(batch.column(3)[i].as_py()).all().astype("<u4", copy=False)
                ends = np.cumsum(counts)
                data = memoryview(np.ascontiguousarray(ids).view(np.uint8))
                places = zip((4 * (ends - counts)).tolist(), (4 * ends).tolist(), strict=True)
                crc = [zlib.crc32(data[a:b]) for a, b in places]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1)[i].values,
                        pa.array(start + ends - counts),
                        pa.array(counts),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return map_arrow(
        segments.select("start", "doc_ids", "doc_tokens", "codes"),
        run, f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def lookup(segments: DataFrame, positions: DataFrame, column: str = "position") -> DataFrame:
    """(position, token) of the asked places in the whole token sequence.

    Places are matched to segments through cells of SEGMENT_TOKENS places, and each
    id is read by its address. Null and outside places give no row.
    """
    cell = lambda c: F.floor(c / SEGMENT_TOKENS).cast("long")
    last = F.col("start") + F.col("n_tokens") - 1
    cells = segments.select(
        "part",
        "seq",
        "start",
        "n_tokens",
        F.explode(F.sequence(cell(F.col("start")), cell(last))).alias("_c"),
    )
    asked = positions.select(F.col(f"`{column}`").cast("long").alias("position")).distinct()
    # places of one segment are distinct, so they are no more than its tokens
    places = (
        asked.withColumn("_c", cell(F.col("position")))
        .join(cells, "_c")
        .where("position >= start and position < start + n_tokens")
        .groupBy("part", "seq")
        .agg(F.collect_list(F.col("position") - F.col("start")).alias("at"))
    )
    found = segments.select("part", "seq", "start", "codes").join(places, ["part", "seq"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start, at = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
                codes = Codes(batch.column(1)[i].as_py())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([start + a for a in at], pa.int64()),
                        pa.array([codes[a] for a in at], pa.int64()),
                    ],
                    names=["position", "token"],
                )

    return map_arrow(found.select("start", "codes", "at"), run, "position bigint, token bigint")


def write_and_read(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """What `documents` reads back from files freshly written to the shared folder."""
    path = fresh_path(docs.sparkSession, "token-files")
    write_files(docs, tokenizer, path, text)
    return documents(read_segments(docs.sparkSession, path))
