"""Ranked search with MaxScore, its bounds tightened by stored joint maxima of term pairs.

`build` cuts documents into blocks and stores each block's postings by term. `pair_lists`
works the terms of some queries into one row for each block: their impacts, the maximum
of each term, and for neighbouring terms of a query the largest impact that both together
have in one document, for each range of documents. `search` bounds a query in a block by the
best choice of disjoint pairs and single terms, takes a first threshold from each query's most
promising blocks, and then passes over blocks, ranges and documents that stay below it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.encoding import bytes_of, slices
from tidemark.llm.shared import LOWER, UPPER, discard, map_arrow, ship_package, written

TOP = 20
#: Bytes of text in a block, at most; a longer text is a block of its own.
BLOCK_BYTES = 16 << 20
#: Documents of a range that has its own maxima.
RANGE = 256
#: Bytes of query texts that are searched in one pass.
QUERY_BYTES = 4 << 20
#: Blocks that give a query its first threshold.
FIRST_BLOCKS = 2
# Fixed values of the score.
SCALE, HALF, SHORTEST, SLOPE = 1_000_000_000, 12, 75, 25
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_FOLD = str.maketrans(UPPER, LOWER)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each byte whether it belongs to a word, and its lower case."""
    word, low = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
    for i in range(256):
        word[i] = i >= 128 or chr(i).isalnum()
        if 65 <= i <= 90:
            low[i] = i + 32
    return word, low


_IS_WORD, _LOW = _tables()


# --- the index -------------------------------------------------------------------------


def _postings(texts: pa.Array):
    """(terms in order, list offsets, documents, counts, words of each document) of some texts."""
    data, bounds = bytes_of(texts)
    held = _IS_WORD[data]
    begins = held.copy()
    begins[1:] &= ~held[:-1]
    edges = bounds[:-1][bounds[:-1] < bounds[1:]]
    begins[edges] |= held[edges]
    at = np.flatnonzero(begins)
    words = np.diff(np.searchsorted(at, bounds))
    if not len(at):
        none = np.zeros(0, np.int32)
        return pa.array([], pa.binary()), np.zeros(1, np.int32), none, none, words
    cut = np.append(np.flatnonzero(begins[held]), np.count_nonzero(held)).astype(np.int32)
    letters = pa.py_buffer(np.ascontiguousarray(_LOW[data[held]]))
    coded = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(cut), letters])
    coded = coded.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    keys = (place[coded.indices.to_numpy()] << 32) | np.repeat(np.arange(len(words)), words)
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    counts = np.diff(np.append(first, len(keys))).astype(np.int32)
    keys = keys[first]
    terms = keys >> 32
    offsets = np.searchsorted(terms, np.arange(len(order) + 1)).astype(np.int32)
    docs = (keys & 0xFFFFFFFF).astype(np.int32)
    return coded.dictionary.take(order), offsets, docs, counts, words


def build(docs: DataFrame, path: str, text: str = "text") -> None:
    """Write the index of all terms of whole texts under `path`.

    Each task cuts its documents into blocks; a block is one row for each of its terms,
    in order, with the documents that hold it and how often, and one row without a term that has
    the documents' ids and lengths. Documents are numbered by ascending doc_id (null first)
    within a block. Null texts and texts without words are not documents; rows that
    share a doc_id are documents of their own. Other columns are not stored.
    """
    source = docs.select("doc_id", F.col(f"`{text}`").cast("binary").alias("_text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def rows(batch: pa.RecordBatch, block: int) -> Iterator[pa.RecordBatch]:
        order = pc.sort_indices(batch.column(0), null_placement="at_start")
        batch = batch.take(order)
        terms, offsets, holders, counts, words = _postings(batch.column(1).fill_null(b""))
        known = np.flatnonzero(words)
        if not len(known):
            return
        number = np.cumsum(words > 0, dtype=np.int32) - 1
        ids = batch.column(0).take(pa.array(known))
        lengths = pa.array(words[known].astype(np.int32))
        whole = pa.array([0, len(known)], pa.int32())
        void = pa.array([None], pa.list_(pa.int32()))
        names = ["block", "term", "n_docs", "docs", "counts", "doc_ids", "lengths"]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([block]), pa.array([None], pa.string()), pa.array([len(known)], pa.int32()),
                void, void, pa.ListArray.from_arrays(whole, ids), pa.ListArray.from_arrays(whole, lengths),
            ],
            names=names,
        )
        holders = pa.array(number[holders])
        counts = pa.array(counts)
        for i in range(0, len(terms), 50_000):
            cut = pa.array(offsets[i : i + 50_001])
            n = len(cut) - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, block)), terms[i : i + n].cast(pa.string()), pc.subtract(cut[1:], cut[:-1]),
                    pa.ListArray.from_arrays(cut, holders), pa.ListArray.from_arrays(cut, counts),
                    pa.nulls(n, pa.list_(ids.type)), pa.nulls(n, pa.list_(pa.int32())),
                ],
                names=names,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        block = (context.partitionId() if context else 0) << 32
        for batch in batches:
            for part in slices(bytes_of(batch.column(1).fill_null(b""))[1], BLOCK_BYTES):
                yield from rows(batch.slice(part.start, part.stop - part.start), block)
                block += 1

    map_arrow(source, run,
        "block bigint, term string, n_docs int, docs array<int>, counts array<int>, "
        f"doc_ids array<{id_type}>, lengths array<int>",
    ).write.option("compression", "zstd").parquet(path)


# --- queries ---------------------------------------------------------------------------


@dataclass
class Queries:
    """Some queries' terms in falling weight, as numbers, and the pairs that stand side by side."""

    items: list
    terms: list[str]
    weights: np.ndarray
    of: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    pairs: np.ndarray


def _terms(text: str | None) -> Counter:
    return Counter(WORD.findall((text or "").translate(_FOLD)))


def weight(n_docs: int, holders: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders + 1)))


def _prepare(rows: list, terms: list[str], holders: dict[str, int], n_docs: int) -> Queries:
    """Queries over the terms that some document holds, with a positive weight."""
    weights = np.array([weight(n_docs, holders[t]) if t in holders else 0 for t in terms], np.int64)
    number = {t: i for i, t in enumerate(terms) if weights[i] > 0}
    pairs: dict[tuple[int, int], int] = {}
    items, of = [], []
    for item, text in rows:
        counted = {number[t]: n for t, n in _terms(text).items() if t in number}
        chain = sorted(counted, key=lambda i: (-weights[i], i))
        beside = [pairs.setdefault(p, len(pairs)) for p in zip(chain, chain[1:])]
        items.append(item)
        of.append((np.array(chain, np.int64), np.array([counted[i] for i in chain], np.int64),
                   np.array([*beside, -1], np.int64)))
    return Queries(items, terms, weights, of, np.array(list(pairs), np.int64).reshape(-1, 2))


# --- blocks ----------------------------------------------------------------------------

BLOCK_ROW = (
    "block bigint, doc_ids array<{}>, terms array<int>, starts array<int>, docs array<int>, impacts array<int>, "
    "maxima array<bigint>, pairs array<int>, joint array<bigint>"
)


def _ranges(n_docs: int) -> np.ndarray:
    return np.arange(0, n_docs, RANGE)


def pair_lists(index: DataFrame, wanted: DataFrame, queries: Queries, n_docs: int, n_words: int) -> DataFrame:
    """One row for each block that holds a term of `queries`, impacts and joint maxima worked in.

    `wanted` has the queries' terms as (number, term).

    `maxima` are the weighted impacts' maxima for each term and range of documents, `joint`
    those of the sum of both terms of a pair for each pair that the block holds. The group of a
    block is bounded by the block.
    """
    ship_package(index.sparkSession)
    weights, pairs = queries.weights, queries.pairs
    id_type = index.schema["doc_ids"].dataType.elementType.simpleString()
    found = index.where("term is not null").join(wanted, "term")
    lengths = index.where("term is null").select("block", F.lit(-1).alias("number"), "docs", "counts", "doc_ids", "lengths")
    both = lengths.unionByName(found.select("block", "number", "docs", "counts", "doc_ids", "lengths"))

    def run(group: pa.Table) -> pa.Table:
        numbers = group["number"].to_numpy()
        about = int(np.flatnonzero(numbers < 0)[0])
        length = np.array(group["lengths"][about].values, np.int64)
        ranges = _ranges(len(length))
        spread = SHORTEST + (SLOPE * length * n_docs) // n_words
        held = {}
        for i in np.argsort(numbers, kind="stable"):
            if i == about or weights[numbers[i]] <= 0:
                continue
            docs = group["docs"][int(i)].values.to_numpy()
            count = group["counts"][int(i)].values.to_numpy().astype(np.int64)
            held[int(numbers[i])] = docs, (SCALE * count) // (1000 * count + HALF * spread[docs])
        score = np.zeros(len(length), np.int64)
        maxima = []
        for number, (docs, impact) in held.items():
            score[docs] = weights[number] * impact
            maxima.append(np.maximum.reduceat(score, ranges))
            score[docs] = 0
        kept, joint = [], []
        for i, (a, b) in enumerate(pairs.tolist()):
            if a in held and b in held:
                kept.append(i)
                for number in (a, b):
                    docs, impact = held[number]
                    score[docs] += weights[number] * impact
                joint.append(np.maximum.reduceat(score, ranges))
                score[held[a][0]] = 0
                score[held[b][0]] = 0
        flat = lambda arrays, kind: (
            pa.array([np.concatenate(arrays).astype(kind) if arrays else np.zeros(0, kind)])
        )
        starts = np.cumsum([0, *(len(d) for d, _ in held.values())]).astype(np.int32)
        return pa.table(
            [
                pa.array([group["block"][0].as_py()], pa.int64()),
                pa.array([group["doc_ids"][about]], group["doc_ids"].type),
                flat([np.array(list(held), np.int32)], np.int32),
                flat([starts], np.int32),
                flat([d for d, _ in held.values()], np.int32),
                flat([x for _, x in held.values()], np.int32),
                flat(maxima, np.int64),
                flat([np.array(kept, np.int32)], np.int32),
                flat(joint, np.int64),
            ],
            names=["block", "doc_ids", "terms", "starts", "docs", "impacts", "maxima", "pairs", "joint"],
        )

    return both.groupBy("block").applyInArrow(run, BLOCK_ROW.format(id_type))


class Block:
    """A block's postings and maxima of some queries' terms."""

    def __init__(self, batch: pa.RecordBatch, i: int, weights: np.ndarray):
        of = lambda name: batch[name][i].values.to_numpy(zero_copy_only=False)
        self.n = len(batch["doc_ids"][i].values)
        self.starts, self.docs, self.impacts, self.weights = of("starts"), of("docs"), of("impacts"), weights
        n_ranges = len(_ranges(self.n))
        self.slot = {t: k for k, t in enumerate(of("terms").tolist())}
        self.pair = {p: k for k, p in enumerate(of("pairs").tolist())}
        self.maxima = of("maxima").reshape(-1, n_ranges)
        self.joint = of("joint").reshape(-1, n_ranges)

    def bounds(self, chain, times, beside) -> tuple[list, np.ndarray]:
        """The query's terms here, and for each of them the bound of all from it on, in each range.

        Along the chain a term either stands alone or goes with its neighbour, whichever
        choice of disjoint pairs gives the lowest sum.
        """
        here = [j for j, t in enumerate(chain.tolist()) if t in self.slot]
        rest = np.zeros((len(here) + 1, self.maxima.shape[1]), np.int64)
        after = None
        for k in range(len(here) - 1, -1, -1):
            j = here[k]
            own = self.maxima[self.slot[int(chain[j])]]
            rest[k] = times[j] * own + rest[k + 1]
            pair = self.pair.get(int(beside[j]))
            if pair is not None and after is not None:
                common = min(times[j], times[j + 1])
                both = common * self.joint[pair] + (times[j] - common) * own + (times[j + 1] - common) * after
                rest[k] = np.minimum(rest[k], both + rest[k + 2])
            after = own
        return [(self.slot[int(chain[j])], int(times[j]) * int(self.weights[chain[j]])) for j in here], rest

    def best(self, query, least: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the best `top`, of equal scores the first, of at least `least`."""
        here, rest = self.bounds(*query)
        least = max(least, 1)
        score = np.zeros(self.n, np.int64)
        k = 0
        while k < len(here) and rest[k].max() >= least:
            # a document that no term met so far may still get there
            slot, factor = here[k]
            a, b = self.starts[slot], self.starts[slot + 1]
            score[self.docs[a:b]] += factor * self.impacts[a:b].astype(np.int64)
            if self.n > top:
                least = max(least, int(np.partition(score, self.n - top)[self.n - top]))
            k += 1
        of_range = np.arange(self.n) // RANGE
        docs = np.flatnonzero(score)
        for slot, factor in here[k:]:
            docs = docs[score[docs] + rest[k][of_range[docs]] >= least]
            if not len(docs):
                break
            a, b = self.starts[slot], self.starts[slot + 1]
            own = self.docs[a:b]
            at = np.minimum(np.searchsorted(own, docs), b - a - 1)
            hit = own[at] == docs
            score[docs[hit]] += factor * self.impacts[a:b][at[hit]].astype(np.int64)
            k += 1
        docs = docs[score[docs] >= least]
        docs = docs[np.lexsort((docs, -score[docs]))][:top]
        return docs, score[docs]


# --- search ----------------------------------------------------------------------------


def _bounds(blocks: DataFrame, queries: Queries) -> DataFrame:
    """(item, block, bound) of every query in every block that may have a document for it."""
    weights, of = queries.weights, queries.of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch, i, weights)
                found = np.array([block.bounds(*q)[1][0].max() for q in of], np.int64)
                items = np.flatnonzero(found).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(items), pa.array(np.full(len(items), batch["block"][i].as_py())), pa.array(found[items])],
                    names=["item", "block", "bound"],
                )

    columns = ["block", "doc_ids", "terms", "starts", "docs", "impacts", "maxima", "pairs", "joint"]
    return map_arrow(blocks.select(*columns), run, "item int, block bigint, bound bigint")


def _evaluate(blocks: DataFrame, queries: Queries, chosen: dict, least: dict | None, top: int) -> DataFrame:
    """(item, doc_id, score): the best of each block.

    Without `least` only the queries that `chosen` has for a block, with it only the others.
    """
    weights, of = queries.weights, queries.of
    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, own = Block(batch, i, weights), chosen.get(batch["block"][i].as_py(), set())
                ids = batch["doc_ids"][i].values
                items, docs, scores = [], [], []
                for item in range(len(of)):
                    if (item in own) == (least is None):
                        d, s = block.best(of[item], 1 if least is None else least.get(item, 1), top)
                        items.append(np.full(len(d), item, np.int32))
                        docs.append(d)
                        scores.append(s)
                if items:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(items)), ids.take(pa.array(np.concatenate(docs))),
                         pa.array(np.concatenate(scores))],
                        names=["item", "doc_id", "score"],
                    )

    return map_arrow(blocks, run, f"item int, doc_id {id_type}, score bigint")


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _search(index: DataFrame, rows: list, id_type: str, n_docs: int, n_words: int, top: int) -> DataFrame:
    spark = index.sparkSession
    terms = sorted(set().union(*(_terms(text) for _, text in rows)))
    # stored, so that Spark knows how small it is and need not shuffle the index to join it
    wanted = written(spark.createDataFrame(list(enumerate(terms)), "number int, term string"), "terms-wanted")
    counted = index.where("term is not null").join(wanted, "term").groupBy("term")
    holders = {r["term"]: r["n"] for r in counted.agg(F.sum("n_docs").alias("n")).collect()}
    queries = _prepare(rows, terms, holders, n_docs)
    blocks = written(pair_lists(index, wanted, queries, n_docs, n_words), "pair-lists")
    promising = Window.partitionBy("item").orderBy(F.desc("bound"), "block")
    first = (
        _bounds(blocks, queries)
        .withColumn("_nth", F.row_number().over(promising))
        .where(F.col("_nth") <= FIRST_BLOCKS)
        .select("item", "block")
        .collect()  # at most FIRST_BLOCKS rows for each query of the pass
    )
    chosen: dict[int, set[int]] = {}
    for r in first:
        chosen.setdefault(r["block"], set()).add(r["item"])
    picked = written(spark.createDataFrame([(b,) for b in chosen], "block bigint"), "first-blocks")
    some = blocks.join(picked, "block", "left_semi")
    best = written(_ranked(_evaluate(some, queries, chosen, None, top), top).drop("rank"), "first-best")
    # a query with `top` documents needs no more that score below the last of them
    least = best.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    floor = {r["item"]: r["least"] for r in least.where(F.col("n") >= top).collect()}
    rest = _evaluate(blocks, queries, chosen, floor, top)
    names = spark.createDataFrame(list(enumerate(queries.items)), f"item int, item_id {id_type}")
    ranked = _ranked(best.unionByName(rest), top).join(names, "item")
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(index: DataFrame, queries: DataFrame, top: int = TOP, text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` best documents of each query, equal scores by doc_id.

    `index` is the table that `build` wrote. Distinct rows of (item_id, text) are queries of their own;
    null texts, texts without words and words that no document holds find nothing. Queries travel
    in passes of about QUERY_BYTES. An empty index or an empty set of queries gives no rows.
    """
    spark = index.sparkSession
    asked = queries.select("item_id", F.col(f"`{text}`").alias("text")).where("text is not null").distinct()
    asked = written(asked, "queries")
    id_type = asked.schema["item_id"].dataType.simpleString()
    doc_type = index.schema["doc_ids"].dataType.elementType.simpleString()
    sizes = index.where("term is null").select(
        F.size("lengths").alias("n"),
        F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("words"),
    )
    n_docs, n_words = sizes.agg(F.sum("n"), F.sum("words")).first()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0]
    if not n_docs or not size:
        return spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id {doc_type}, score bigint")
    passes = -(-size // QUERY_BYTES)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    found = []
    for i in range(passes):
        rows = [(r["item_id"], r["text"]) for r in asked.where(part == i).collect()]
        if rows:
            found.append(_search(index, rows, id_type, n_docs, n_words, top))
    discard(asked)
    return reduce(DataFrame.unionByName, found)
