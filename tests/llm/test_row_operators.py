"""Operators that judge each row for itself, and decontamination."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from llm import brute
from llm.conftest import EDGES, rows_of
from tidemark.llm import decontaminate, licenses, pii, quality, queries_text, sharding

SF = "/root/testdata/sf0.001"


def by_id(df):
    return [tuple(r) for r in df.orderBy("doc_id").collect()]


# --- quality ---------------------------------------------------------------------------


def test_quality_matches_plain_version(spark, some):
    got = by_id(queries_text.op8_quality_rules(spark, SF))
    assert [r[1:7] for r in got] == [brute.quality(t) for _, t in some[1]]
    assert all(not r[7] for r in got if r[6])


def test_quality_on_edges(edges, no_docs):
    judged = quality.judge(edges)
    assert judged.columns == [*edges.columns, "quality"]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = rows_of(judged, "doc_id", *[F.col("quality")[n] for n in names])
    assert got == sorted(((i, *brute.quality(t)) for i, t, _ in EDGES), key=repr)
    assert quality.judge(no_docs).count() == 0
    assert quality.keep_good(edges).columns == edges.columns


def test_quality_repeats_with_ties(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = by_id(quality.judge(docs).select("doc_id", "quality.n_repeat_words"))
    assert [r[1] for r in got] == [brute.quality(t)[4] for t in texts]


def test_keep_good_is_the_verdict(some):
    docs, _ = some
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert kept == {r.doc_id for r in quality.judge(docs).where("quality.kept").collect()}
    with pytest.raises(ValueError):
        quality.judge(docs, (quality.Rule("few_words", "n_words", low=10),))


# --- licenses --------------------------------------------------------------------------


def test_licenses_match_plain_version(spark, some):
    got = by_id(queries_text.op2_license_scan(spark, SF))
    assert [r[1:6] for r in got] == [brute.license_base(t) for _, t in some[1]]


def test_license_edges_and_spans(spark, edges, no_docs):
    scanned = licenses.scan(edges)
    assert scanned.count() == len(EDGES) and scanned.columns == [*edges.columns, "license"]
    assert licenses.scan(no_docs).count() == 0
    bent = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "fine software and the associated documentation files"
    )
    texts = ["CC-BY cc by", "All rights. Reserved", "x all rights reserved", bent, "granted free of"]
    docs = spark.createDataFrame(
        [(i, t) for i, t in enumerate(texts)] + [(2, texts[2])], "doc_id bigint, text string"
    )
    got = {
        (r.doc_id, r.n_base, r.first_word, r.last_word, r.labels)
        for r in licenses.scan(docs).select("doc_id", "license.*").collect()
    }
    assert got == {
        (0, 2, 0, 2, "cc-by"),
        (1, 1, 0, 0, "reserved"),
        (2, 1, 1, 1, "reserved"),
        (3, 0, None, None, "mit"),
        (4, 0, None, None, ""),
    }


# --- personal data ---------------------------------------------------------------------

TRICKY = [
    "a@b.c_d@e.f x@y@z.com. no@dot me+tag%1@mail-1.example.co.uk...",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3 9.9.9.9",
    "4111 1111 1111 1111 4111-1111-1111-1112 4785380592391139 12345 " + "7" * 30 + " 4 1 1",
    "+1 (743) 555-3824 +12 +123456789 +1234567890123456 ++49 30 1234567)",
    "é+49 30 123456 ñ@b.com 1.1.1.1é\U0001f600 2.2.2.2",
    "9" * 3000 + "@" + "a" * 3000 + "." + "b." * 500,
    "0 " * 3000,
]


def test_personal_data_matches_plain_version(spark, some):
    got = by_id(queries_text.op9_personal_data(spark, SF))
    for (_, text), row in zip(some[1], got, strict=True):
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in brute.personal(text))
        assert row[5] == hashlib.sha256(shown.encode()).hexdigest()


def test_personal_data_on_edges(spark, edges, no_docs):
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id bigint, text string")
    got = by_id(pii.detect(docs).select("doc_id", pii.shown(kinds=pii.KINDS)))
    assert [r[1] for r in got] == [
        ",".join(f"{k}:{a}:{b}" for k, a, b in brute.personal(t)) for t in TRICKY
    ]
    assert pii.detect(edges).count() == len(EDGES)
    assert pii.detect(no_docs).count() == 0


def test_terms_that_disclose_a_value(spark):
    rng = random.Random(3)
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    filler = lambda n: " ".join(rng.choice(words).replace("0", "") for _ in range(n))
    texts = [f"{filler(6)} zamboni mail joe@corp.example.com {filler(6)}" for _ in range(8)]
    texts += [f"{filler(12)} mail {filler(3)}" for _ in range(80)]
    # copies of one text are one piece of evidence
    texts += ["unusual haberdasher near ann@corp.example.com"] * 9
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = pii.detect(docs).withColumn("clean", pii.sanitised(F.col("text")))
    rows = {r.doc_id: r for r in found.collect()}
    assert "zamboni" not in rows[0].clean and "[EMAIL]" in rows[0].clean
    assert all("mail" in rows[i].clean for i in range(88))
    assert rows[90].clean == "unusual haberdasher near [EMAIL]"


def test_two_different_surroundings_are_evidence_for_a_rare_term(spark):
    filler = lambda i: " ".join(f"plain{chr(97 + (i * 7 + j * 3) % 26)}" for j in range(6))
    texts = [f"{filler(i)} zamboni common joe@corp.example.com {filler(i + 1)}" for i in (1, 5)]
    texts += [f"{filler(i)} common" for i in range(198)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = pii.detect(docs).select(F.expr("transform(pii.term, t -> substring(text, t.start + 1, t.end - t.start))"))
    assert sorted(r[0] for r in found.collect()) == [[]] * 198 + [["zamboni"]] * 2


def test_terms_are_found_in_the_whole_text(spark):
    filler = lambda i, n: " ".join(f"plain{chr(97 + (i * 7 + j * 3) % 26)}" for j in range(n))
    # far from the value, in another case, twice, and only there in one of the documents
    texts = [f"İ Zamboni {filler(i, 60)} joe@corp.example.com {filler(i, 60)} ZAMBONI," for i in (1, 5)]
    texts += [f"{filler(7, 40)} 10.1.2.3 joe@corp.example.com {filler(9, 40)} zamboni"]
    texts += [f"{filler(i, 9)} corp" for i in range(300)]
    docs = spark.createDataFrame([(i % 2, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    found = pii.detect(docs).select("text", "pii.term").collect()
    assert len(found) == len(texts)
    places = lambda t: [(m.start(), m.end()) for m in re.finditer("(?i)zamboni", t)]
    for r in found:
        assert [(x.start, x.end) for x in r.term] == (places(r.text) if "@" in r.text else [])


# --- decontamination -------------------------------------------------------------------


def test_decontamination_matches_plain_version(spark, some):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = by_id(queries_text.op1_benchmark_decontamination(spark, SF))
    assert got == list(brute.contamination(some[1], items))


def test_decontamination_edges(spark, edges, no_docs, monkeypatch):
    items = [(1, "again and again THE same words"), (2, None), (3, ""), (4, "one"), (4, "w1 w2"), (None, "x")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    scanned = decontaminate.scan(edges, benchmark)
    columns = ["doc_id", "hits.n_words", "hits.n_hit", "hits.contaminated"]
    plain = brute.contamination([(i, t) for i, t, _ in EDGES], items)
    want = sorted(((a, b, c, f) for a, b, c, _, _, f in plain), key=repr)
    assert rows_of(scanned, *columns) == want
    # one block of items for each pass gives the same
    monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", 1)
    assert rows_of(decontaminate.scan(edges, benchmark), *columns) == want
    assert decontaminate.scan(no_docs, benchmark).count() == 0
    assert not decontaminate.scan(edges, benchmark.limit(0)).where("hits.contaminated").count()
    for row in scanned.where("hits.n_hit > 0").collect():
        for (a, b), (i, j) in zip(row.hits.spans, row.hits.runs, strict=True):
            assert brute.plain(row.text[a:b]) == brute.plain(row.text)[i:j]


# --- sharding --------------------------------------------------------------------------


def test_sharding_table():
    table = sharding.fill()
    counts = [table.count(i) for i in range(len(sharding.SHARDS))]
    assert max(counts) - min(counts) <= 1 and sum(counts) == sharding.SLOTS
    fewer = sharding.fill(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, fewer, strict=True))
    assert moved < 3 * sharding.SLOTS / len(sharding.SHARDS)
    with pytest.raises(ValueError):
        sharding.fill(slots=100)


def test_sharding_places_equal_keys_together(edges, no_docs, tmp_path):
    placed = sharding.assign(edges)
    assert placed.count() == len(EDGES)
    assert placed.groupBy("doc_id").agg(F.count_distinct("shard").alias("n")).where("n > 1").isEmpty()
    assert sharding.assign(no_docs).count() == 0
    for row in placed.where("doc_id is not null").select("doc_id", "slot").collect():
        digest = hashlib.md5(str(row.doc_id).encode()).hexdigest()[:15]
        assert row.slot == int(digest, 16) % sharding.SLOTS
    sharding.write_shards(edges, str(tmp_path / "out"))
    assert edges.sparkSession.read.parquet(str(tmp_path / "out")).count() == len(EDGES)
