"""Ranked search, held against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from llm.conftest import EDGES
from tidemark.llm import queries_text, ranking, shared

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain_scores(docs, text):
    """(doc_id, score) of every document for one query, unordered."""
    held = [(i, Counter(words(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_words = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    for i, c in held:
        m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_words
        score = 0
        for w in words(text):
            if c[w]:
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                score += weight * ((1000000000 * c[w]) // (1000 * c[w] + 12 * m))
        if score > 0:
            yield i, score


def plain_search(docs, queries, top=20):
    out = []
    for item, text in queries:
        found = sorted(plain_scores(docs, text), key=lambda x: (-x[1], x[0] is not None, x[0]))
        out += [(item, k, i, s) for k, (i, s) in enumerate(found[:top], 1)]
    return sorted(out, key=repr)


def searched(spark, docs, queries, top=20, **names):
    path = shared.fresh_path(spark, "terms")
    ranking.build(docs, path, **names)
    return sorted((tuple(r) for r in ranking.search(spark.read.parquet(path), queries, top).collect()), key=repr)


def test_search_matches_plain_version(spark, some):
    queries = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted((tuple(r) for r in queries_text.op11_ranked_search(spark, SF).collect()), key=repr)
    assert got == plain_search(some[1], queries)


def test_search_with_small_blocks_ranges_and_passes(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK_BYTES", 900)
    monkeypatch.setattr(ranking, "RANGE", 3)
    monkeypatch.setattr(ranking, "QUERY_BYTES", 200)
    rng = random.Random(8)
    draw = lambda n: " ".join(f"w{int(rng.paretovariate(0.6))}"[:4] for _ in range(n))
    docs = [(i, draw(rng.randrange(40))) for i in range(400)]
    docs += [(400 + i, docs[i % 7][1]) for i in range(60)]  # many equal scores
    rng.shuffle(docs)
    queries = [(k, draw(rng.randrange(25))) for k in range(25)] + [(30, docs[3][1]), (31, "zzz"), (32, None), (33, "")]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    asked = spark.createDataFrame(queries, "item_id int, text string")
    assert searched(spark, table, asked, top=7) == plain_search(docs, queries, top=7)


def test_search_on_edges(spark, edges, no_docs):
    queries = [(1, "AGAIN and again w5 éa"), (2, None), (3, " "), (4, "Éa x"), (4, "one"), (None, "another text")]
    asked = spark.createDataFrame(queries, "item_id bigint, text string").withColumn("rank", F.lit("theirs"))
    named = edges.withColumn("block", F.lit("theirs")).withColumn("term", F.lit(1)).withColumnRenamed("text", "my.text")
    got = searched(spark, named, asked.unionByName(asked), text="my.text")
    docs = [(i, t) for i, t, _ in EDGES]
    # equal documents without an id of their own are in no order among themselves
    assert got == plain_search(docs, queries)
    assert searched(spark, no_docs, asked) == []
    assert searched(spark, edges, asked.limit(0)) == []
    texts = spark.createDataFrame([("b", "x y"), ("a", "x z"), (None, "x x y q"), ("c", "q")], "doc_id string, text string")
    got = searched(spark, texts, spark.createDataFrame([("i", "y z")], "item_id string, text string"))
    assert got == plain_search([("b", "x y"), ("a", "x z"), (None, "x x y q"), ("c", "q")], [("i", "y z")])


def block_of(docs, weights, pairs):
    """A Block of term impacts given as {term: {doc: impact}}, with true maxima."""
    n = 1 + max(d for held in docs.values() for d in held)
    ranges = range(0, n, ranking.RANGE)
    top = lambda terms: [
        max(sum(weights[t] * docs[t].get(d, 0) for t in terms) for d in range(r, min(n, r + ranking.RANGE))) for r in ranges
    ]
    kept = [k for k, (a, b) in enumerate(pairs) if a in docs and b in docs]
    flat = lambda rows: [x for row in rows for x in row]
    columns = {
        "doc_ids": [list(range(n))], "terms": [list(docs)], "docs": [flat(sorted(h) for h in docs.values())],
        "starts": [np.cumsum([0, *map(len, docs.values())]).tolist()],
        "impacts": [flat([h[d] for d in sorted(h)] for h in docs.values())],
        "maxima": [flat(top([t]) for t in docs)], "pairs": [kept], "joint": [flat(top(pairs[k]) for k in kept)],
    }
    kinds = {k: pa.int64() if k in ("maxima", "joint", "doc_ids") else pa.int32() for k in columns}
    batch = pa.RecordBatch.from_arrays([pa.array(v, pa.list_(kinds[k])) for k, v in columns.items()], list(columns))
    return ranking.Block(batch, 0, np.array(weights))


def test_pair_bounds_hold_and_are_tighter_than_single_terms(monkeypatch):
    monkeypatch.setattr(ranking, "RANGE", 4)
    rng = random.Random(5)
    tighter = 0
    for _ in range(200):
        n_terms = rng.randrange(2, 8)
        weights = [rng.randrange(1, 9) for _ in range(n_terms)]
        docs = {t: {d: rng.randrange(1, 50) for d in rng.sample(range(20), rng.randrange(1, 8))} for t in range(n_terms)}
        for t in [t for t in docs if t and rng.random() < 0.2]:
            del docs[t]
        pairs = [(t, t + 1) for t in range(n_terms - 1)]
        block = block_of(docs, weights, pairs)
        chain, times = np.arange(n_terms), np.array([rng.randrange(1, 4) for _ in range(n_terms)])
        query = chain, times, np.array([*range(n_terms - 1), -1])
        here, rest = block.bounds(*query)
        present = [t for t in range(n_terms) if t in docs]
        assert len(here) == len(present)
        scores = [[times[t] * weights[t] * docs[t].get(d, 0) for d in range(block.n)] for t in present]
        for k in range(len(present)):
            for r in range(rest.shape[1]):
                part = [sum(s[d] for s in scores[k:]) for d in range(4 * r, min(block.n, 4 * r + 4))]
                alone = sum(max(s[4 * r : 4 * r + 4]) for s in scores[k:])
                assert max(part) <= rest[k][r] <= alone
                tighter += rest[k][r] < alone
        total = np.sum(scores, axis=0)
        want = sorted(((-s, d) for d, s in enumerate(total) if s >= 60))[:3]
        found, score = block.best(query, 60, 3)
        assert [(-s, d) for d, s in zip(found, score)] == want
    assert tighter > 500
