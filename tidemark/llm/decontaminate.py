"""Benchmark decontamination with an Aho-Corasick automaton over normalised benchmark windows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import free, map_arrow

WINDOW = 13
#: Normalised benchmark text held by one automaton; more items are scanned in further passes.
AUTOMATON_BYTES = 32 << 20

# Normalisation works on UTF-8 bytes: A-Z become a-z, other ASCII characters that are neither
# letters nor digits become spaces, and bytes of non-ASCII characters are word characters.
_TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")


def normalised(text: str | None) -> list[bytes]:
    """The words of a text; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


def windows(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    """Every run of `size` words, framed by spaces; shorter texts are one window, empty ones none."""
    if not words:
        return []
    return [
        b" " + b" ".join(words[i : i + size]) + b" " for i in range(max(1, len(words) - size + 1))
    ]


class Automaton:
    """One automaton over the windows of all items; each window knows its items and its length."""

    def __init__(self, items: tuple[tuple[str, str | None], ...], size: int = WINDOW):
        of_window: dict[bytes, set[str]] = {}
        for item, text in items:
            for window in windows(normalised(text), size):
                of_window.setdefault(window, set()).add(item)
        self.items: list[tuple[str, ...]] = []
        self.lengths: list[int] = []
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for window, owners in of_window.items():
            self.machine.add_word(window.decode("latin-1"), len(self.items))
            self.items.append(tuple(sorted(owners)))
            self.lengths.append(window.count(b" ") - 1)
        if self.items:
            self.machine.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, the merged hit runs as (first word, end word) and the items found."""
        words = normalised(text)
        runs: list[tuple[int, int]] = []
        if not words or not self.items:
            return len(words), runs, set()
        line = b" " + b" ".join(words) + b" "
        found = list(self.machine.iter(line.decode("latin-1")))
        if not found:
            return len(words), runs, set()
        # a match ends with the space after its last word: spaces up to there count the words
        spaces = np.cumsum(np.frombuffer(line, np.uint8) == 32)
        seen: set[int] = set()
        for at, window in found:
            seen.add(window)
            end = int(spaces[at]) - 1
            start = end - self.lengths[window]
            while runs and start <= runs[-1][1]:
                first, last = runs.pop()
                start, end = min(start, first), max(end, last)
            runs.append((start, end))
        return len(words), runs, {item for w in seen for item in self.items[w]}


@lru_cache(maxsize=2)
def _automaton(items: tuple[tuple[str, str | None], ...], size: int) -> Automaton:
    """Kept by the Python worker for the next task."""
    return Automaton(items, size)


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Hit runs of words as (start, end) in code points of the original text."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [(m.start(), m.end()) for m in _WORD.finditer(raw.translate(_TO_WORDS))]
    # a code point starts at every byte that doesn't continue one
    points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(int(points[at[a][0]]), int(points[at[b - 1][1]])) for a, b in runs]


_SCAN = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_PAIRS = pa.list_(pa.list_(pa.int64()))
_ARROW = pa.struct(
    [("n_words", pa.int64()), ("runs", _PAIRS), ("spans", _PAIRS), ("items", pa.list_(pa.string()))]
)


def _blocks(items: list[tuple[str, str | None]]) -> list[tuple[tuple[str, str | None], ...]]:
    """The items in blocks of bounded text size, at least one block."""
    blocks, block, held = [], [], 0
    for item in items:
        # every word stands in up to `WINDOW` windows
        size = len((item[1] or "").encode("utf-8", "surrogatepass")) * WINDOW
        if block and held + size > AUTOMATON_BYTES:
            blocks, block, held = [*blocks, tuple(block)], [], 0
        block.append(item)
        held += size
    return [*blocks, tuple(block)]


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    keep: list[str] | None = None,
    size: int = WINDOW,
) -> DataFrame:
    """Columns `keep` of `docs` (all by default) with a struct `hits`:
    n_words, n_hit, runs, spans, items and `contaminated`.

    A document word is hit if it stands inside any occurrence of a benchmark
    window (`size` consecutive words of one item, or a whole shorter item).
    `runs` are merged hit words as [first, end), `spans` the same as code-point
    offsets in the original text. A document is contaminated if at least one in
    twenty of its words is hit.

    The benchmark is the stated query set: its distinct items travel with the
    tasks in blocks of AUTOMATON_BYTES, and each block's automaton scans a text
    once, so a larger benchmark needs more passes, not larger tasks. Documents
    are neither shuffled nor grouped. Null and wordless texts have no hits; items
    without words match nothing; repeated rows are scanned each for itself;
    items that share an id count once; a null item_id is left out of `items`; an
    empty table on either side gives no hits. A column `hits` of `docs` is
    replaced.
    """
    named = benchmark.select(
        F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text")
    ).distinct()
    items = [(r["item_id"], r["text"]) for r in named.toLocalIterator()]
    blocks = _blocks(sorted(items, key=lambda r: (r[0] is not None, r[0] or "", r[1] or "")))
    columns = [c for c in (docs.columns if keep is None else keep) if c != "hits"]
    scan_, scanned_ = free(docs, "_scan", "_scanned")
    source = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text}`").alias(scanned_))
    schema = T.StructType([source.schema[c] for c in columns] + [T.StructField(scan_, _SCAN)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            scans = [(0, [], set())] * len(texts)
            for block in blocks:
                automaton = _automaton(block, size)
                for i, value in enumerate(texts):
                    n, runs, names = automaton.scan(value)
                    if runs or not scans[i][0]:
                        scans[i] = (n, scans[i][1] + runs, scans[i][2] | names)
            rows = []
            for value, (n, runs, names) in zip(texts, scans, strict=True):
                runs = _merged(runs)
                rows.append(
                    {
                        "n_words": n,
                        "runs": runs,
                        "spans": original_spans(value, runs) if runs else [],
                        "items": sorted(x for x in names if x is not None),
                    }
                )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(rows, type=_ARROW)], names=[*columns, scan_]
            )

    found = F.col(scan_)
    n_hit = F.aggregate(found["runs"], F.lit(0).cast("long"), lambda a, r: a + r[1] - r[0])
    many = 20 * n_hit >= found["n_words"]
    return map_arrow(source, run, schema).select(
        *[F.col(f"`{c}`") for c in columns],
        F.struct(
            found["n_words"].alias("n_words"),
            n_hit.alias("n_hit"),
            found["runs"].alias("runs"),
            found["spans"].alias("spans"),
            found["items"].alias("items"),
            ((n_hit > 0) & many).alias("contaminated"),
        ).alias("hits"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with their own columns only.

    Null and wordless texts stay, repeated rows stay or go together, an empty table gives none.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return scan(docs, benchmark).where(~F.col("hits.contaminated")).select(*columns)
