"""Repeated byte strings, by difference-cover samples and blockwise sorted suffix buckets.

A string of SIZE bytes is the beginning of a suffix, so suffixes need to be told
apart in their first SIZE bytes only. Sorting all of them at once would move a
multiple of the corpus. Instead:

1. Documents are packed, in ascending order, into chunks of a few MB.
2. The suffixes at a difference cover modulo PERIOD (five places in 21) are
   ranked first: those whose first SIZE - PERIOD + 1 bytes stand in one document
   only fall out. For any two places there is a shift under PERIOD that
   takes both onto the cover, so of two equal strings at least one pair of
   sampled suffixes that start in them, at the same distance, agree too.
3. Suffixes with such a repeated sample within their first PERIOD places are
   sorted, one range of suffix buckets after the other, and chunks learn which
   of their strings stand in an earlier chunk.

All keys are hashes that are spread evenly, so a string that very many documents share is
one entry of each chunk that holds it and no bucket is larger than another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import discard, map_arrow, shuffle_partitions, written

SIZE = 50
#: A perfect difference set: every residue but 0 is one difference of two of these.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
#: Bytes of text in a chunk, and most documents in it.
CHUNK_BYTES, CHUNK_DOCS = 3 << 20, 50_000
#: Entries of a bucket, at most about; the number of buckets follows from it.
BUCKET_ENTRIES = 1 << 21
#: Ranges of buckets that are sorted one after the other, for samples and for suffixes.
SAMPLE_ROUNDS, SUFFIX_ROUNDS = 1, 2
#: Places that are hashed at a time, so that what this takes stays in the CPU's cache.
BLOCK = 1 << 14
_LAST = (1 << 63) - 1
_SEEDS = (np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5))
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


# --- strings as numbers ----------------------------------------------------------------


def window_hashes(text: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of the `size` bytes from each place on."""
    return _hashes_at(text, size, np.arange(max(len(text) - size + 1, 0)), (which,))[0]


def _hashes_at(
    text: np.ndarray, size: int, places: np.ndarray, which: tuple[int, ...]
) -> list[np.ndarray]:
    """For each of `which` a 64-bit hash of the `size` bytes from each of `places` (ascending) on.

    The bytes are taken eight at a time; the last eight may overlap those before.
    """
    out = [np.full(len(places), _SEEDS[k]) for k in which]
    if not len(places):
        return out
    raw = text.tobytes() + bytes(8) if size < 8 else text
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    offsets = [*range(0, size - 7, 8)] or [0]
    if size > 8 and size % 8:
        offsets.append(size - 8)
    for start in range(0, len(places), BLOCK):
        own, near = places[start : start + BLOCK], words
        if own[-1] - own[0] < 16 * len(own):
            near, own = words[own[0] : own[-1] + offsets[-1] + 1].copy(), own - own[0]
        for offset in offsets:
            word = near[offset:][own]
            if size < 8:
                word &= np.uint64((1 << 8 * size) - 1)
            for k, hashes in zip(which, out, strict=True):
                part = hashes[start : start + BLOCK]
                part ^= word
                part *= _MULTIPLIERS[k]
                part ^= part >> np.uint64(32)
    return out


def _ordered(keys: np.ndarray, second: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The order of `keys`, then of `second`, then of the places; and the keys in that order.

    The keys' leading bits are sorted with the places behind them in one number. They hardly
    ever leave anything open; if they do, all is sorted.
    """
    width = np.uint64(len(keys).bit_length())
    packed = keys >> width
    packed <<= width
    packed |= np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    packed &= (np.uint64(1) << width) - np.uint64(1)
    order = packed.view(np.int64)
    ordered = keys[order]
    wrong = (ordered[1:] < ordered[:-1]).any()
    if second is not None and not wrong:
        tie = np.flatnonzero(ordered[1:] == ordered[:-1])
        wrong = (second[order[tie]] != second[order[tie + 1]]).any()
    if wrong:
        order = np.argsort(keys, kind="stable") if second is None else np.lexsort((second, keys))
        ordered = keys[order]
    return order, ordered


def _again(keys: np.ndarray, second: np.ndarray | None) -> np.ndarray:
    """Whether each of the ordered keys is the one before it."""
    again = np.zeros(len(keys), bool)
    np.equal(keys[1:], keys[:-1], out=again[1:])
    if second is not None:
        again[1:] &= second[1:] == second[:-1]
    return again


# --- a chunk ---------------------------------------------------------------------------


class Chunk:
    """The documents of one chunk, end to end."""

    def __init__(self, ids: list[int], lengths: list[int], text: bytes):
        self.text = np.frombuffer(text, np.uint8)
        self.ids = np.array(ids, np.int64)
        self.lengths = np.array(lengths, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.doc = np.repeat(np.arange(len(ids), dtype=np.int32), self.lengths)

    def _last(self, size: int) -> np.ndarray:
        """The last place of each document from which `size` bytes stay in it; -1 if it has not SIZE bytes."""
        return np.where(self.lengths >= SIZE, self.starts + self.lengths - size, -1)

    def samples(self, within: tuple[int, int] | None = None) -> Entries:
        """The cover's suffixes, by the bytes that any two equal strings share from there on.

        With `within` only those whose key lies between its two ends, both included.
        """
        size = SIZE - PERIOD + 1
        last = self._last(size)
        long = np.flatnonzero(last >= 0)
        periods = (last[long] - self.starts[long]) // PERIOD + 1
        nth = _ranges(np.zeros(len(long), np.int64), periods)
        begin = np.repeat(self.starts[long], periods) + PERIOD * nth
        places = (begin[:, None] + np.array(COVER)).ravel()
        places = places[places <= np.repeat(last[long], len(COVER) * periods)]
        (keys,) = _hashes_at(self.text, size, places, (0,))
        if within is not None:
            own = _between(keys, within)
            places, keys = places[own], keys[own]
        return Entries(places, keys, None, self._ids_at)

    def suffixes(self, repeated: np.ndarray, within: tuple[int, int] | None = None) -> Entries:
        """The suffixes with a repeated sample in reach, by their first SIZE bytes; `within` as for samples."""
        # the places in reach of each sample that those of the one before don't hold already
        before = np.concatenate([[-1], repeated[:-1]]) if len(repeated) else repeated
        low = np.maximum(repeated - (PERIOD - 1), before + 1)
        places = _ranges(low, repeated + 1)
        places = places[places <= self._last(SIZE)[self.doc[places]]]
        keys, second = _hashes_at(self.text, SIZE, places, (0, 1))
        if within is not None:
            own = _between(keys, within)
            places, keys, second = places[own], keys[own], second[own]
        second = (second >> np.uint64(32)).astype(np.uint32)
        return Entries(places, keys, second, self._ids_at)

    def _ids_at(self, places: np.ndarray) -> np.ndarray:
        return self.ids[self.doc[places]]

    def results(self, removed: np.ndarray) -> dict[str, pa.Array]:
        """n_removed, spans, kept_sha256 and kept of each document; `removed`: starts of strings."""
        ends = self.starts + self.lengths
        at = np.zeros(len(self.text), bool)
        at[removed] = True
        removed = np.flatnonzero(at)
        # strings that overlap or touch in a document are one run
        doc = self.doc[removed]
        new = (np.diff(removed, prepend=-SIZE - 1) > SIZE) | (np.diff(doc, prepend=-1) > 0)
        first = removed[new]
        last = removed[np.append(new[1:], True)[: len(new)]] + SIZE
        steps = np.zeros(len(self.text) + 1, np.int8)
        steps[first] += 1
        steps[last] -= 1
        kept = self.text[np.cumsum(steps[:-1], dtype=np.int8) == 0].tobytes()
        per = np.searchsorted(first, np.append(0, ends)).astype(np.int32)
        sums = np.append(0, np.cumsum(last - first))[per]
        offsets = np.append(0, ends) - sums
        cut = [kept[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        start = self.starts[self.doc[first]]
        spans = np.stack([first - start, last - start], axis=1).ravel()
        pairs = pa.ListArray.from_arrays(
            pa.array(np.arange(0, len(spans) + 1, 2, dtype=np.int32)), pa.array(spans, pa.int64())
        )
        return {
            "n_removed": pa.array(np.diff(sums), pa.int64()),
            "spans": pa.ListArray.from_arrays(pa.array(per), pairs),
            "kept_sha256": pa.array([hashlib.sha256(c).hexdigest() for c in cut], pa.string()),
            "kept": pa.array(cut, pa.binary()),
        }


def _between(keys: np.ndarray, ends: tuple[int, int]) -> np.ndarray:
    return np.flatnonzero((keys >= np.uint64(ends[0])) & (keys <= np.uint64(ends[1])))


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [begin, end), one after the other."""
    sizes = end - begin
    before = np.cumsum(sizes) - sizes
    return np.repeat(begin - before, sizes) + np.arange(int(sizes.sum()))


class Entries:
    """Distinct strings of a chunk in ascending order of their keys, and the places of each."""

    def __init__(self, places, keys, second, ids_at):
        order, keys = _ordered(keys, second)
        self.places = places[order]
        if second is not None:
            second = second[order]
        again = _again(keys, second)
        first = np.flatnonzero(~again)
        self.group = np.cumsum(~again, dtype=np.int32) - 1
        self.keys = keys[first]
        self.second = None if second is None else second[first]
        self.later = np.zeros(len(keys), bool)  # places in a document after the chunk's first one
        self.shared = np.zeros(len(first), bool)  # strings of two or more documents of the chunk
        # a string's places ascend, and so do their documents
        more = np.flatnonzero(again)
        least = ids_at(self.places[first[self.group[more]]])
        more = more[ids_at(self.places[more]) > least]
        self.later[more] = True
        self.shared[self.group[more]] = True

    def __len__(self) -> int:
        return len(self.keys)

    def buckets(self, bits: int) -> np.ndarray:
        """Where each bucket begins, and the end: a bucket is the keys' first `bits` bits."""
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        return np.concatenate([[0], np.searchsorted(self.keys, edges), [len(self.keys)]])


# --- binary columns as arrays ----------------------------------------------------------


def _column(edges: np.ndarray, data: np.ndarray) -> pa.Array:
    """A binary column: row i holds the bytes of data[edges[i]:edges[i + 1]]."""
    offsets = (edges * data.itemsize).astype(np.int32)
    raw = np.ascontiguousarray(data)
    return pa.Array.from_buffers(
        pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)]
    )


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sizes of a binary column's rows, and their bytes one after the other."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize)
    if data is None or ends[0] == ends[-1]:
        return np.diff(ends), np.zeros(0, np.uint8)
    return np.diff(ends), np.frombuffer(data, np.uint8, int(ends[-1] - ends[0]), int(ends[0]))


# --- steps over chunks -----------------------------------------------------------------


def _stored(df: DataFrame, name: str) -> DataFrame:
    """`written`; the shuffle files that it took go at its end, not with a later garbage collection."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return written(df, name)
    finally:
        conf.set(key, before)


def pack_chunks(rows: DataFrame) -> DataFrame:
    """Rows (id, key, raw) as chunks (chunk, ids, keys, lengths, text), ascending like their ids.

    Of rows alike in id and key one is taken, and none if `raw` is null in one of them.
    """
    dealt = rows.repartitionByRange(
        shuffle_partitions(rows.sparkSession), "id"
    ).sortWithinPartitions("id", "key", F.col("raw").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        keys: list[str] = []
        texts: list[bytes] = []
        held, last = 0, None

        def chunk() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {
                    "chunk": pa.array([part << 32 | seq], pa.int64()),
                    "ids": pa.array([ids], pa.list_(pa.int64())),
                    "keys": pa.array([keys], pa.list_(pa.string())),
                    "lengths": pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                    # packed, as it is moved and stored more than once
                    "text": pa.array([pa.compress(b"".join(texts), "zstd", asbytes=True)], pa.binary()),
                }
            )

        for batch in batches:
            for i, key, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if raw is None or (i, key) == last:
                    last = i, key
                    continue
                last = i, key
                # rows of one id stay together, so that an earlier chunk has smaller ids only
                full = held + len(raw) > CHUNK_BYTES or len(ids) >= CHUNK_DOCS
                if ids and full and i != ids[-1]:
                    yield chunk()
                    seq, held, ids, keys, texts = seq + 1, 0, [], [], []
                ids.append(i)
                keys.append(key)
                texts.append(raw)
                held += len(raw)
        if ids:
            yield chunk()

    return map_arrow(
        dealt.select("id", "key", "raw"),
        run,
        "chunk bigint, ids array<bigint>, keys array<string>, lengths array<bigint>, text binary",
    )


def _bits_for(entries: float) -> int:
    """Bits that give buckets of BUCKET_ENTRIES at most, and tasks of even size."""
    return max(8, int(entries / BUCKET_ENTRIES).bit_length())


def _dealt_entries(
    chunks: DataFrame, entries_of: Callable, bits: int, rounds: int, turn: int
) -> DataFrame:
    """(bucket, chunk, keys, second): a chunk's entries of one round's buckets.

    `keys` are the keys without the bucket's bits: of samples 32 bits, as a mistaken one
    only adds suffixes to sort; of suffixes all that are left, and 32 bits of the second hash.
    """
    count = 1 << bits
    first, last = turn * count // rounds, (turn + 1) * count // rounds
    # only the round's own keys are sorted
    within = (first << (64 - bits), (last << (64 - bits)) - 1) if rounds > 1 else None
    columns = chunks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(k)[i].as_py() for k, c in enumerate(columns)}
                entries = entries_of(row, within)
                edges = entries.buckets(bits)
                own = np.flatnonzero(np.diff(edges))
                if not len(own):
                    continue
                edges = np.append(edges[own], len(entries))
                keys, second = entries.keys << np.uint64(bits), entries.second
                if second is None:
                    keys = (keys >> np.uint64(32)).astype(np.uint32)
                    second = np.zeros(0, np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own.astype(np.int32)),
                        pa.array(np.full(len(own), row["chunk"], np.int64)),
                        _column(edges, keys),
                        _column(edges if len(second) else 0 * edges, second),
                    ],
                    names=["bucket", "chunk", "keys", "second"],
                )

    return map_arrow(chunks, run, "bucket int, chunk bigint, keys binary, second binary")


def _repeats(keys: np.ndarray, second: np.ndarray | None) -> np.ndarray:
    """The entries of a bucket that others equal (samples), or that earlier ones do (suffixes)."""
    if second is None:
        packed = keys.astype(np.uint64) << np.uint64(32)
        packed |= np.arange(len(keys), dtype=np.uint64)
        packed.sort()
        again = _again(packed >> np.uint64(32), None)
        again[:-1] |= again[1:]
        return (packed[again] & np.uint64(0xFFFFFFFF)).view(np.int64)
    order, keys = _ordered(keys, second)
    return order[_again(keys, second[order])]


def _sorted_buckets(entries: DataFrame, samples: bool) -> DataFrame:
    """(chunk, bucket, bits): a bit for each entry of a chunk, from sorting one bucket at a time.

    Of samples it says that another chunk has the string, of suffixes that an earlier
    one does. Rows without such an entry are left out.
    """
    n = shuffle_partitions(entries.sparkSession)
    dealt = entries.repartition(n, "bucket").sortWithinPartitions("bucket", "chunk")

    def answer(bucket: int, parts: list[tuple]) -> pa.RecordBatch:
        chunks, sizes = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        keys = np.concatenate([p[2] for p in parts])
        second = None if samples else np.concatenate([p[3] for p in parts])
        # a chunk has a string once, and rows come in ascending order of their chunks
        hits = _repeats(keys, second)
        ends = np.cumsum(sizes)
        row = np.searchsorted(ends, hits, side="right")
        lengths = (sizes + 7) // 8
        begin = np.cumsum(lengths) - lengths
        bits = np.zeros(8 * int(lengths.sum()), bool)
        bits[hits + (8 * begin - (ends - sizes))[row]] = True
        any_hit = np.zeros(len(sizes), bool)
        any_hit[row] = True
        rows = pa.RecordBatch.from_arrays(
            [
                pa.array(chunks),
                pa.array(np.full(len(chunks), bucket, np.int32)),
                _column(np.append(begin, begin[-1] + lengths[-1]), np.packbits(bits)),
            ],
            names=["chunk", "bucket", "bits"],
        )
        return rows.filter(pa.array(any_hit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        for batch in batches:
            buckets = batch.column(0).to_numpy()
            if not len(buckets):
                continue
            starts = np.flatnonzero(np.diff(buckets, prepend=buckets[0] - 1))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(buckets)], strict=True):
                if buckets[a] != at and parts:
                    yield answer(at, parts)
                    parts = []
                at = int(buckets[a])
                own = batch.slice(a, b - a)
                sizes, keys = _bytes(own.column(2))
                keys = keys.view(np.uint32 if samples else np.uint64).copy()
                second = _bytes(own.column(3))[1].view(np.uint32).copy()
                parts.append((own.column(1).to_numpy(), sizes // keys.itemsize, keys, second))
        if parts:
            yield answer(at, parts)

    return map_arrow(
        dealt.select("bucket", "chunk", "keys", "second"), run, "chunk bigint, bucket int, bits binary"
    )


def _rounds(chunks: DataFrame, entries_of: Callable, bits: int, rounds: int, samples: bool):
    """The bits of all buckets, one round of them after the other."""
    out = None
    for turn in range(rounds):
        dealt = _dealt_entries(chunks, entries_of, bits, rounds, turn)
        part = _stored(_sorted_buckets(dealt, samples), "suffix-bits")
        out = part if out is None else out.unionByName(part)
    return out


def _with_bits(chunks: DataFrame, bits: DataFrame, run: Callable, schema: str) -> DataFrame:
    """`run(row, answers)` for each chunk, `answers` being (buckets, sizes, bits) that belong to it."""
    columns = chunks.columns
    rows = chunks.select(*columns, F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("bits"))
    bare = bits.select(
        *[
            F.col("chunk") if c == "chunk" else F.lit(None).cast(chunks.schema[c].dataType).alias(c)
            for c in columns
        ],
        "bucket",
        "bits",
    )
    n = shuffle_partitions(chunks.sparkSession)
    dealt = rows.unionByName(bare).repartition(n, "chunk").sortWithinPartitions("chunk", "bucket")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, own = None, []
        for batch in batches:
            buckets = batch.column(len(columns)).to_numpy()
            heads = np.flatnonzero(buckets == -1).tolist()
            for a, b in zip([-1, *heads], [*heads, len(buckets)], strict=True):
                if a >= 0:
                    if chunk is not None:
                        yield run(chunk, own)
                    chunk = {c: batch.column(k)[a].as_py() for k, c in enumerate(columns)}
                    own = []
                if b > a + 1:
                    sizes, data = _bytes(batch.column(len(columns) + 1).slice(a + 1, b - a - 1))
                    own.append((buckets[a + 1 : b].copy(), sizes, data.copy()))
        if chunk is not None:
            yield run(chunk, own)

    return map_arrow(dealt, over, schema)


def _marked(entries: Entries, bits: int, answers: list[tuple]) -> np.ndarray:
    """The answers' bits for all entries."""
    out, edges = np.zeros(len(entries), bool), entries.buckets(bits)
    for buckets, sizes, data in answers:
        begin, end = edges[buckets], edges[buckets + 1]
        first = 8 * (np.cumsum(sizes) - sizes)
        told = np.unpackbits(data).view(bool)[_ranges(first, first + end - begin)]
        out[_ranges(begin, end)] = told
    return out


def _chunk(row: dict) -> Chunk:
    text = pa.decompress(row["text"], sum(row["lengths"]), "zstd", asbytes=True)
    return Chunk(row["ids"], row["lengths"], text)


def _repeated(row: dict) -> np.ndarray:
    return np.cumsum(np.frombuffer(row["repeated"], "<u4"), dtype=np.uint32).astype(np.int64)


def dedup(docs: DataFrame, text: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256[, kept]) for every row.

    A byte goes if a string of SIZE bytes that covers it also starts in a document
    with a smaller doc_id; all is judged on the texts as they come. `spans` are the
    maximal removed runs as [start, end) in bytes, `kept` the bytes left.

    Equal texts are one class: the one with the smallest doc_id is compared, the others
    lose all their bytes if they have SIZE of them. Rows that repeat a doc_id are
    not smaller than each other. A null doc_id counts as larger than any other, a null
    text as empty; texts under SIZE bytes stay whole. An empty table gives no rows.
    """
    raw = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    keyed = docs.select("doc_id", order.alias("id"), F.md5(raw).alias("key"), raw.alias("raw"))
    rows = _stored(
        keyed.select("doc_id", "id", "key", F.octet_length("raw").cast("long").alias("n_bytes")),
        "suffix-rows",
    )
    least = rows.groupBy("key").agg(F.min("id").alias("id"))
    # only a class's smallest id brings its text; texts are moved once, with a mark beside the others
    copies = rows.join(least, ["key", "id"], "left_anti").select("id", "key")
    texts = keyed.select("id", "key", "raw").unionByName(
        copies.withColumn("raw", F.lit(None).cast("binary"))
    )
    chunks = _stored(pack_chunks(texts), "suffix-chunks")
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]

    # ranks of the cover's suffixes
    bits = _bits_for(total * len(COVER) / PERIOD)
    ranks = _rounds(chunks, lambda row, within: _chunk(row).samples(within), bits, SAMPLE_ROUNDS, True)

    def mark(row: dict, answers: list[tuple]) -> pa.RecordBatch:
        samples = _chunk(row).samples()
        again = _marked(samples, bits, answers) | samples.shared
        places = np.sort(samples.places[again[samples.group]])
        steps = np.diff(places, prepend=0)
        return pa.RecordBatch.from_pydict(
            {
                "chunk": pa.array([row["chunk"]], pa.int64()),
                "ids": pa.array([row["ids"]], pa.list_(pa.int64())),
                "keys": pa.array([row["keys"]], pa.list_(pa.string())),
                "lengths": pa.array([row["lengths"]], pa.list_(pa.int64())),
                "text": pa.array([row["text"]], pa.binary()),
                "repeated": pa.array([steps.astype("<u4").tobytes()], pa.binary()),
                # suffixes in reach, about
                "reach": pa.array([int(np.minimum(steps, PERIOD).sum())], pa.int64()),
            }
        )

    marked = _stored(
        _with_bits(
            chunks,
            ranks,
            mark,
            "chunk bigint, ids array<bigint>, keys array<string>, lengths array<bigint>, "
            "text binary, repeated binary, reach bigint",
        ),
        "suffix-marked",
    )
    discard(chunks)
    discard(ranks)

    # the suffixes with a repeated sample, one range of buckets after the other
    reach = marked.agg(F.coalesce(F.sum("reach"), F.lit(0))).first()[0]
    marked = marked.drop("reach")
    finer = _bits_for(reach)
    entries_of = lambda row, within: _chunk(row).suffixes(_repeated(row), within)
    earlier = _rounds(
        marked.select("chunk", "ids", "lengths", "text", "repeated"),
        entries_of,
        finer,
        SUFFIX_ROUNDS,
        False,
    )

    def remove(row: dict, answers: list[tuple]) -> pa.RecordBatch:
        chunk = _chunk(row)
        suffixes = chunk.suffixes(_repeated(row))
        gone = _marked(suffixes, finer, answers)[suffixes.group] | suffixes.later
        columns = chunk.results(suffixes.places[gone])
        if not with_text:
            del columns["kept"]
        return pa.RecordBatch.from_pydict({"key": pa.array(row["keys"], pa.string()), **columns})

    schema = "key string, n_removed bigint, spans array<array<bigint>>, kept_sha256 string"
    results = _stored(
        _with_bits(marked, earlier, remove, schema + ", kept binary" * with_text), "suffix-results"
    )
    discard(marked)
    discard(earlier)
    copy = (F.col("id") > F.col("least")) & (F.col("n_bytes") >= SIZE)
    whole = F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes")))
    named = results.join(least.withColumnRenamed("id", "least"), "key")
    extra = [F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if with_text else []
    return rows.join(_stored(named, "suffix-named"), "key").select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, 1).otherwise(F.size("spans")).cast("long").alias("n_spans"),
        F.when(copy, whole).otherwise(F.col("spans")).alias("spans"),
        F.when(copy, hashlib.sha256(b"").hexdigest())
        .otherwise(F.col("kept_sha256"))
        .alias("kept_sha256"),
        *extra,
    )
