"""Cases that once went wrong, each against a plain version or its stated result."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from llm import brute
from tidemark.llm import decontaminate, licenses, mixing, pii, simhash, urls


def texts_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_labels_and_scores_match_plain_version(spark, some):
    rng = random.Random(9)
    long = [p for p, _ in licenses.NOTICES if len(p.split()) > 8]
    texts = ["of the x " * 16, "of the " * 400, "x " + long[1] + " y"]
    for phrase in long:
        for gaps in (1, 3, 6, 7, 9, 12):
            words = phrase.split()
            for _ in range(gaps):
                at = rng.randrange(1, len(words))
                words[at:at] = [rng.choice(["foo", "of", "the"])]
            texts.append("so " + " ".join(words) + " end")
            for _ in range(gaps // 2):
                del words[rng.randrange(len(words))]
            texts.append(" ".join(words))
        texts.append(" ".join(reversed(phrase.split())))
        texts.append(" ".join(w + " filler words that stand between" for w in phrase.split()))
    texts += [t for _, t in some[1]]
    got = licenses.scan(texts_of(spark, texts)).orderBy("doc_id").select("license.labels", "license.score").collect()
    want = [brute.license_labels(t, licenses.BASE, licenses.NOTICES) for t in texts]
    for text, row, (labels, score) in zip(texts, got, want, strict=True):
        assert (row.labels, row.score) == (labels, pytest.approx(score)), text[:200]
    assert want[0] == want[1] == ("", 0.0)
    assert len({s for _, s in want}) > 5


def test_malformed_escapes_are_no_edges(spark):
    bad = "http://a.org/x?url=https%3A%2F%2Fb.org%2F%zz"
    pages = spark.createDataFrame([(1, bad, None), (2, None, None)], "page_id bigint, url string, html string")
    got = {r.page_id: (r.verdict, r.reason) for r in urls.judge(pages).collect()}
    assert got == {1: ("allow", "default"), 2: ("allow", "default")}


def test_alias_verdicts_match_plain_version(spark):
    rng = random.Random(13)
    hosts = ["a.net", "x.example.net", "example.com", "b.org", "c.io", "d.io", "e.dev"]
    paths = ["/", "/en/p", "/de/q", "/fr/r", "/s"]
    pool = [f"http://{h}{p}{n}" for h in hosts for p in paths for n in range(3)]
    for _ in range(3):
        pages = [(i, rng.choice(pool)) for i in range(60)] + [(90, None), (91, "no scheme")]
        edges = [(rng.choice(pool), rng.choice(pool)) for _ in range(25)]
        table = spark.createDataFrame([(i, u, None) for i, u in pages], "page_id int, url string, html string")
        redirects = spark.createDataFrame(edges, "source string, target string")
        got = {r.page_id: r.verdict for r in urls.judge(table, redirects=redirects).collect()}
        named = spark.createDataFrame([(u,) for u in pool], "u string")
        spelt = {r[0]: r[1] for r in named.select("u", urls.normal_form(F.col("u"))).collect()}
        assert got == brute.alias_verdicts(pages, edges, lambda u: spelt.get(u))


def test_many_matches_in_one_text_take_seconds(spark):
    ips = [f"10.{i >> 16}.{i >> 8 & 255}.{i & 255}" for i in range(40_000)]
    text = " ".join(ips)
    docs = spark.createDataFrame([(1, text), (2, "a@b.c " * 7), (3, "")], "doc_id int, text string")
    began = time.time()
    got = {r.doc_id: r.pii for r in pii.detect(docs).collect()}
    assert time.time() - began < 60
    assert [(s.start, s.end) for s in got[1].ip] == [(a, b) for k, a, b in brute.personal(text) if k == "ip"]
    assert [(s.start, s.end) for s in got[2].email] == [(6 * i, 6 * i + 5) for i in range(7)]
    assert got[3].ip == []


def test_one_of_each_group_stays_whatever_the_ids(spark):
    words = lambda seed: " ".join(random.Random(seed).choices([f"w{i}" for i in range(500)], k=60))
    rows = [
        (5, words(1), "a"), (5, words(2), "b"),  # different texts under one id
        (5, words(1), "c"),  # a repeated row
        (7, words(2), "d"),  # a copy under another id
        (None, words(3), "e"), (None, words(3), "f"), (None, words(4), "g"),  # copies without an id
        (9, words(4), "h"), (8, None, "i"), (6, "", "j"),
    ]
    docs = spark.createDataFrame(rows, "doc_id int, text string, tag string")
    kept = simhash.keep_one(docs).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter(
        {(5, words(1)): 1, (5, words(2)): 1, (None, words(3)): 1, (9, words(4)): 1, (6, ""): 1}
    )
    assert {r.tag for r in kept} <= {r[2] for r in rows}


def test_every_source_keeps_its_one_whole_reading():
    rng = random.Random(17)
    for _ in range(300):
        totals = {f"s{i}": rng.randrange(1, 10 ** rng.randrange(1, 12)) for i in range(5)}
        for share in mixing.plan(totals):
            assert share.epochs >= 1, (totals, share)


CLASHES = ["_scan", "_scanned", "_n_hit", "_id", "_hash", "_hash_of_text", "_n_words", "_license", "n_base", "score", "labels",
           "_times", "_copy", "_h", "_source", "_shares", "_email", "_ip", "_nth", "_key", "_own_id", "hash"]


def test_columns_named_like_inner_ones_come_back_unchanged(spark, some):
    docs = some[0].select("doc_id", "text", "source").limit(40).cache()
    named = docs.select("*", *[F.lit(f"their {c}").alias(c) for c in CLASHES])
    benchmark = docs.select(F.col("doc_id").alias("item_id"), "text").limit(3)
    for plain, run in (
        (True, lambda d: decontaminate.scan(d, benchmark)),
        (True, licenses.scan),
        (True, pii.detect),
        (False, mixing.mix),
        (False, simhash.keep_one),
    ):
        got, want = run(named), run(docs)
        assert got.columns[: len(named.columns)] == named.columns
        assert got.where(" or ".join(f"`{c}` <> 'their {c}'" for c in CLASHES)).isEmpty()
        assert got.drop(*CLASHES).count() == want.count()
        if plain:
            last = want.columns[-1]
            show = lambda d: sorted(repr((r.doc_id, r[last])) for r in d.collect())  # noqa: E731, B023
            assert show(got) == show(want)
