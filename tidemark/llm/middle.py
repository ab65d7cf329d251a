"""Fill-in-middle: texts cut at random places and put in another order, by select over UTF-8 words.

The bytes of many texts are read as 64-bit words. In each word the bytes that end a
code point are marked by arithmetic and counted with one bit count; running counts find the
word that holds the k-th end, and eight running counts inside that word its byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.encoding import bytes_of, slices
from tidemark.llm.shared import map_arrow

# The marks, and the shares in percent of plain texts and of suffix-first forms.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SUFFIX_FIRST = 90, 20
SEED = "1"
FIM = "fim struct<n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output: string>"
#: Bytes of text indexed at once.
INDEXED_BYTES = 4 << 20
_ONES = np.uint64(0x0101010101010101)


class UnitIndex:
    """Rank and select over the code points of bytes of UTF-8.

    A byte ends a code point if the next one is no continuation byte (10xxxxxx). Of
    malformed bytes, each that is no continuation ends what stands before it.
    """

    def __init__(self, data: np.ndarray):
        self.size = len(data)
        padded = np.zeros(-(-(self.size + 1) // 8) * 8, np.uint8)
        padded[: self.size] = data
        words = padded.view("<u8")
        begins = ~((words >> np.uint64(7)) & ~(words >> np.uint64(6))) & _ONES
        # a byte ends a unit where the next byte, perhaps of the next word, begins one
        self.ends = begins >> np.uint64(8)
        self.ends[:-1] |= begins[1:] << np.uint64(56)
        if self.size:
            # nothing counts behind the text
            self.ends[self.size // 8] &= np.uint64((1 << (8 * (self.size % 8))) - 1)
            self.ends[self.size // 8 + 1 :] = 0
            last = self.size - 1
            self.ends[last // 8] |= np.uint64(1 << (8 * (last % 8)))
        else:
            self.ends[:] = 0
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.ends), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Units that end before each byte place."""
        word, inside = at >> 3, (at & 7).astype(np.uint64)
        below = (np.uint64(1) << (inside * np.uint64(8))) - np.uint64(1)
        ends = np.append(self.ends, np.uint64(0))
        return self.before[word] + np.bitwise_count(ends[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte place behind the k-th unit, counted from 1; 0 for 0."""
        word = np.searchsorted(self.before, k, "left") - 1
        inside = np.maximum(word, 0)
        wanted = np.where(word < 0, 0, k - self.before[inside]).astype(np.uint64)
        # byte j of the product counts the marks in bytes 0 to j
        counts = self.ends[inside] * _ONES
        behind = np.zeros(len(k), np.int64)
        for j in range(8):
            behind += (counts >> np.uint64(8 * j)) & np.uint64(0xFF) < wanted
        return np.where(word < 0, 0, 8 * inside + behind + 1)


def _draws(doc_id: Column) -> list[Column]:
    """h1 to h4, from the sha256 of the seed and the decimal id (null: nothing)."""
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def transform(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the struct `fim`: n, form, prefix_chars, middle_chars, output; all columns stay.

    Texts that are empty or null, that hold one of the marks, or that the draw leaves alone are
    `plain`: their output is the text (null: empty), their lengths null. The draw depends on
    doc_id alone, so rows of one id are cut alike; null ids share one draw. An input column
    `fim` is replaced.
    """
    names = [c for c in docs.columns if c != "fim"]
    whole = F.col(f"`{text}`")
    source = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        (
            F.coalesce(whole.contains(PREFIX) | whole.contains(SUFFIX) | whole.contains(MIDDLE), F.lit(True))
            | (F.length(whole) == 0)
        ).alias("bare"),
        *[h.alias(f"h{i}") for i, h in enumerate(_draws(F.col("doc_id")), 1)],
    )
    marks, at = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)], names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).field(at)
            texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
            texts = texts.fill_null(b"")
            bare = batch.column(1).to_numpy(zero_copy_only=False)
            h = [c.to_numpy() for c in batch.columns[2:]]
            for part in slices(bytes_of(texts)[1], INDEXED_BYTES):
                data, bounds = bytes_of(texts[part])
                index = UnitIndex(data)
                ranks = index.rank(bounds)
                n = np.diff(ranks)
                h1, h2, h3, h4 = (x[part] for x in h)
                first, second = h1 % (n + 1), h2 % (n + 1)
                low, high = np.minimum(first, second), np.maximum(first, second)
                cut1, cut2 = index.select(ranks[:-1] + low), index.select(ranks[:-1] + high)
                plain = bare[part] | (h3 % 100 >= PLAIN_FROM)
                suffix_first = h4 % 100 < SUFFIX_FIRST
                out, raw = [], memoryview(data)
                for i in range(len(n)):
                    a, d = bounds[i], bounds[i + 1]
                    if plain[i]:
                        out.append(raw[a:d])
                        continue
                    b, c = max(a, cut1[i]), max(a, cut2[i])
                    prefix, middle, suffix = raw[a:b], raw[b:c], raw[c:d]
                    if suffix_first[i]:
                        cut = (marks[1], suffix, marks[0], prefix, marks[2], middle)
                    else:
                        cut = (marks[0], prefix, marks[1], suffix, marks[2], middle)
                    out.append(b"".join(cut))
                form = np.where(plain, "plain", np.where(suffix_first, "spm", "psm"))
                fim = pa.StructArray.from_arrays(
                    [
                        pa.array(n),
                        pa.array(form.tolist(), pa.string()),
                        pa.array(low, pa.int64(), mask=plain),
                        pa.array(high - low, pa.int64(), mask=plain),
                        pa.array(out, pa.binary()).view(pa.string()),
                    ],
                    names=["n", "form", "prefix_chars", "middle_chars", "output"],
                )
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], fim], names=["row", "fim"])

    schema = source.select("row").schema.add(StructType.fromDDL(FIM).fields[0])
    done = map_arrow(source, run, schema)
    return done.select(*[F.col(f"row.`{c}`") for c in names], "fim")


def restored(output: Column, form: Column) -> Column:
    """The text again, from the output and its form: each mark stands in it once."""
    def after(x: Column, mark: str) -> Column:
        return F.substring_index(x, mark, -1)

    def until(x: Column, mark: str) -> Column:
        return F.substring_index(x, mark, 1)

    middle = after(output, MIDDLE)
    head = until(output, MIDDLE)
    psm = F.concat(until(after(head, PREFIX), SUFFIX), middle, after(head, SUFFIX))
    spm = F.concat(after(head, PREFIX), middle, until(after(head, SUFFIX), PREFIX))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)
