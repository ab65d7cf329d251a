"""Mixing sources to target weights by temperature, realised as budgeted block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import SPACE, free, written

#: Most sources whose totals the driver takes; it raises beyond.
MOST_SOURCES = 1_000_000
#: Tokens of a block, and most blocks of a source (beyond that, blocks grow).
BLOCK_TOKENS, MOST_BLOCKS = 1 << 16, 4096
#: Epochs that no source exceeds.
REPEAT = 1.5
#: Passes of the bisection: the exponent is then exact to a double.
STEPS = 60


@dataclass(frozen=True)
class Share:
    """What a source gives: its tokens, weight, budget, whole epochs and the rest of the budget."""

    source: str | None
    tokens: int
    weight: float
    budget: int
    epochs: int
    rest: int


def weights(tokens: list[int], exponent: float) -> list[float]:
    """Token shares to the power `exponent`, in proportion; 1 keeps the shares, 0 makes them even."""
    total = sum(tokens)
    raised = [(t / total) ** exponent if t else 0.0 for t in tokens]
    return [r / sum(raised) for r in raised]


def entropy(shares: list[float]) -> float:
    return -sum(s * math.log2(s) for s in shares if s > 0)


def _budget(tokens: list[int], shares: list[float], budget: int | None) -> float:
    """Without a budget: as many tokens as let every source be read once at least."""
    if budget is not None:
        return budget
    return max(t / s for t, s in zip(tokens, shares, strict=True) if s > 0)


def exponent_for(
    tokens: list[int],
    repeat: float | None = REPEAT,
    target_entropy: float | None = None,
    budget: int | None = None,
) -> float:
    """The exponent from 0 to 1 that comes closest to even weights within the targets.

    `repeat`: no source is read more often. `target_entropy` (bits): the weights
    are no more even than that. Both fall or rise with the exponent, so it is bisected. If
    even the shares as they are break a target, the exponent is 1.
    """
    tokens = [t for t in tokens if t > 0]

    def within(x: float) -> bool:
        shares = weights(tokens, x)
        if target_entropy is not None and entropy(shares) > target_entropy:
            return False
        size = _budget(tokens, shares, budget)
        return repeat is None or all(
            size * s / t <= repeat for t, s in zip(tokens, shares, strict=True)
        )

    if not tokens or within(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (low, middle) if within(middle) else (middle, high)
    return high


def plan(
    totals: dict[str | None, int],
    repeat: float | None = REPEAT,
    target_entropy: float | None = None,
    budget: int | None = None,
) -> list[Share]:
    """A share for each source. Budgets are whole tokens; sources without tokens are read once."""
    names = sorted((s for s in totals if totals[s] > 0), key=lambda s: (s is not None, s or ""))
    tokens = [totals[s] for s in names]
    if not tokens:
        return [Share(s, 0, 0.0, 0, 1, 0) for s in totals]
    shares = weights(tokens, exponent_for(tokens, repeat, target_entropy, budget))
    size = _budget(tokens, shares, budget)
    out = []
    for name, t, w in zip(names, tokens, shares, strict=True):
        own = math.floor(size * w)
        if budget is None:
            # every source is read at least once as a whole: no rounding may take a token of it
            own = max(own, t)
        out.append(Share(name, t, w, own, own // t, own % t))
    return out + [Share(s, 0, 0.0, 0, 1, 0) for s in totals if totals[s] == 0]


def n_tokens(text: Column) -> Column:
    """Tokens as mixing counts them: words between ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^" + SPACE[1:] + "+")).cast("long")


def _number(*parts: Column) -> Column:
    """A number from 0 to 2**32 that depends on the parts alone."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def draw(
    docs: DataFrame,
    text: str = "text",
    repeat: float | None = REPEAT,
    target_entropy: float | None = None,
    budget: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """(doc_id, hash, source, tokens, epoch, block, place): one row for each reading of a document.

    `hash` is that of the text. Every source is dealt into blocks by document; in
    each epoch its blocks and the documents in them come in another order. Whole epochs
    read everything. The last one reads blocks in their order as long as the rest
    of the budget holds them whole, and of the next block the documents that still fit
    in theirs. `place`, from 0 to 1, is the share of the source's budget read before,
    so in its order any stretch of the mix has about the target weights.

    Rows with the same doc_id, text and source are one document of all their
    tokens, drawn together. A null source is a source, a null doc_id an id; null and empty
    texts have no tokens and are read with their block. Without a budget every document
    is read at least once. An empty table gives no rows.

    A source's totals and its at most MOST_BLOCKS blocks are all that is ever grouped; a source that
    holds most documents is spread over its blocks.
    """
    spark = docs.sparkSession
    rows = (
        docs.select(
            "doc_id",
            F.xxhash64(f"`{text}`").alias("hash"),
            F.col("source").cast("string").alias("source"),
            n_tokens(F.col(f"`{text}`")).alias("one"),
        )
        .groupBy("doc_id", "hash", "source")
        .agg(F.sum("one").alias("tokens"))
    )
    rows = written(rows, "mix-documents")
    sums = rows.groupBy("source").agg(F.sum("tokens").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(sums) > MOST_SOURCES:
        raise ValueError(f"there are more than {MOST_SOURCES} sources")
    shares = plan({r["source"]: r["n"] for r in sums}, repeat, target_entropy, budget)
    sources = spark.createDataFrame(
        [
            (s.source, s.tokens, s.epochs, s.rest,
             max(1, min(MOST_BLOCKS, -(-s.tokens // BLOCK_TOKENS))))
            for s in shares
        ],
        "s string, total bigint, epochs bigint, rest bigint, blocks bigint",
    )
    mark = F.lit(seed)
    rows = rows.join(sources, F.col("source").eqNullSafe(F.col("s"))).withColumn(
        "block", F.pmod(_number(mark, F.lit("block"), F.col("doc_id"), F.col("hash")), F.col("blocks"))
    )
    # every epoch's blocks in their order, with the source's tokens before each in that epoch
    order = Window.partitionBy("s", "epoch").orderBy("turn", "block")
    last = F.when(F.col("rest") > 0, F.col("epochs")).otherwise(F.col("epochs") - 1)
    turns = (
        rows.groupBy("s", "block", "total", "epochs", "rest")
        .agg(F.sum("tokens").alias("held"))
        .where((F.col("epochs") > 0) | (F.col("rest") > 0))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .withColumn("turn", _number(mark, F.lit("turn"), F.col("s"), F.col("epoch"), F.col("block")))
        .withColumn("before", F.sum("held").over(order) - F.col("held"))
        .where((F.col("epoch") < F.col("epochs")) | (F.col("before") < F.col("rest")))
        .select(
            F.col("s").alias("s2"),
            F.col("block").alias("block2"),
            "epoch", "before", "held",
            (F.col("rest") - F.col("before")).alias("room"),
            ((F.col("epoch") < F.col("epochs")) | (F.col("before") + F.col("held") <= F.col("rest")))
            .alias("whole"),
        )
    )
    readings = rows.join(
        written(turns, "mix-blocks"),
        F.col("s").eqNullSafe(F.col("s2")) & (F.col("block") == F.col("block2")),
    ).withColumn("own", _number(mark, F.lit("own"), F.col("epoch"), F.col("doc_id"), F.col("hash")))
    within = Window.partitionBy("s").orderBy("own", "doc_id", "hash")
    edge = (
        readings.where("not whole")
        .withColumn("upto", F.sum("tokens").over(within))
        .where("upto <= room")
        .withColumn("inside", (F.col("upto") - F.col("tokens")).cast("double"))
        .drop("upto")
    )
    read = F.col("epoch") * F.col("total") + F.col("before")
    share = F.col("own") / float(1 << 32)
    place = (read + F.col("inside")) / (F.col("epochs") * F.col("total") + F.col("rest"))
    return (
        readings.where("whole")
        .withColumn("inside", F.col("held") * share)
        .unionByName(edge)
        .select(
            "doc_id", "hash", "source", "tokens", "epoch", "block",
            F.when(F.col("total") > 0, place).otherwise(share).alias("place"),
        )
    )


def mix(docs: DataFrame, text: str = "text", **targets) -> DataFrame:
    """`docs` as drawn: each row once for each reading, with its own columns and no others.

    Rows that share doc_id, text and source are read together; null ids, texts and sources are
    values like any other. An empty table gives none.
    """
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    own, key, digest, group, n, copy = free(docs, "_h", "_id", "_hash", "_source", "_times", "_copy")
    drawn = draw(docs, text, **targets).select(
        F.col("doc_id").alias(key), F.col("hash").alias(digest), F.col("source").alias(group), "epoch"
    )
    # one row for each document, so that texts are joined once and copied afterwards
    times = drawn.groupBy(key, digest, group).agg(F.count("*").cast("int").alias(n))
    d = docs.withColumn(own, F.xxhash64(f"`{text}`")).alias("d")
    same = (
        F.col("d.doc_id").eqNullSafe(F.col(key))
        & (F.col(own) == F.col(digest))
        & F.col("d.source").cast("string").eqNullSafe(F.col(group))
    )
    return (
        d.join(written(times, "mix-times"), same)
        .withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(n))))
        .select(*columns)
    )
