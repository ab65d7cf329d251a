"""Operators over many documents at once, and the pipeline."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from llm import brute
from llm.conftest import EDGES, rows_of
from tidemark.llm import encoding, graph, mixing, queries_text, shared, simhash, suffixes, tokens, urls

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def by_id(df):
    return [tuple(r) for r in df.orderBy("doc_id").collect()]


# --- token files -----------------------------------------------------------------------


def test_token_files_match_whole_text_encoding(spark, some):
    got = by_id(queries_text.op4_token_files(spark, SF))
    assert got == list(brute.token_rows(some[1], Tokenizer.from_file(PATH)))


@pytest.mark.parametrize("most", [0, 200, 255, 256, 70_000, 2**32 - 1])
def test_codes_round_trip_and_random_access(most):
    rng = np.random.default_rng(most)
    for n in (0, 1, 7, 8, 513, 5000):
        ids = (rng.random(n) ** 4 * (most + 1)).astype(np.uint32)
        codes = tokens.Codes(tokens.pack(ids))
        assert len(codes) == n and (codes.all() == ids).all()
        assert all(codes[int(i)] == ids[i] for i in rng.integers(0, n, 40 if n else 0))


def ids_of(texts, encoder=None):
    flat, bounds = (encoder or encoding.encoder(PATH)).encode(pa.array([t.encode() for t in texts], pa.binary()))
    return [flat[i:j].tolist() for i, j in zip(bounds, bounds[1:])]


def wanted(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_letters_that_end_in_a_mark_are_encoded_with_their_punctuation():
    assert encoding.encoder(PATH).apart
    letters = [chr(c) for c in range(128, 0x20000) if chr(c).isalpha() and not 0x3400 <= c <= 0xD7A3]
    words = ["\u09b9\u09df,", "\u09b2\u09dc.", "\u0939\u095c,", "VERG\u0130.", "\ufb2a."]
    words += [x + "." for x in letters] + [f"a{x}!?" for x in letters] + [f"!{x}1" for x in letters]
    for text, got, want in zip(words, ids_of(words), wanted(words), strict=True):
        assert got == want, ascii(text)


def test_piece_encoding_equals_the_tokenizer():
    texts = [
        "Don't stop, it's the dog's <|endoftext|>x <|ENDOFTEXT|>", "a b c\x1cd　e", "ΣΑΣ ς's",
        "é ́x Ångström ﬁ İstanbul ½ Ⅷ x² 12 3a a3", "'s 'S ll'll ### a.b ,,'", "\U0001f600!!‍x",
        "", " ", "日本語 テキスト。the", "tab\tnew\nline\x0bvt", "=\u0338 H\u0331.",
    ]
    assert ids_of(texts) == wanted(texts)


def test_plain_letters_need_no_normaliser():
    words = encoding.WordEncoder(PATH)
    rng = random.Random(5)
    letters = sorted(encoding._PLAIN - {"\n"})
    made = ["".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(3000)] + ["".join(letters)]
    made += [w.lower() for w in made]
    pieces = [w.encode() for w in made if not w.isascii()]
    assert not any(encoding._odd(pieces)) and all(encoding._stays_letters(p) for p in pieces)
    marked = ["\u09b9\u09df", "VERG\u0130", "\ufb2a", "e\u0301", "\u2013", "\u00bd"]
    mixed = [w.encode() for w in marked] + [b"\xff", b"\xc3"] + pieces[:9]
    assert encoding._odd(mixed) == [not encoding._stays_letters(p) for p in mixed]
    flat, bounds = words.encode(pa.array([w.encode() for w in made], pa.binary()))
    whole = [e.ids for e in words.tokenizer.encode_batch_fast(made, add_special_tokens=False)]
    assert [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == whole


def test_random_texts_are_encoded_as_the_tokenizer_does():
    rng = random.Random(11)
    parts = [*"aBé1²½日。ßİΣς!.,-_~< \n\t\x1c\u3000\xa0\0'", "\u0301", "\u0338", "\u09dc", "'s", "<|endoftext|>", "the", "\u200d"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(6000)]
    got = [x for i in range(0, len(texts), 400) for x in ids_of(texts[i : i + 400])]
    assert got == wanted(texts)


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(encoding, "CACHED", 3)
    encoder = encoding.WordEncoder(PATH)
    for text in ("a a b b c c d d e e f g, h!", "a b x", "q r s t u v w a"):
        assert ids_of([text], encoder) == wanted([text])
        assert len(encoder.pieces) <= 3


def test_another_tokenizer_gets_whole_texts(spark, no_docs):
    other = public_tokenizers.path("byte_bpe_50k.json")
    encoder = encoding.WordEncoder(other)
    texts = ["Don't  stop,\n it's", "", "é 123"]
    plain = Tokenizer.from_file(other).encode_batch(texts, add_special_tokens=False)
    assert not encoder.apart and ids_of(texts, encoder) == [e.ids for e in plain]
    assert ids_of([], encoder) == ids_of([]) == []


def test_token_files_on_edges_and_lookup(spark, edges, no_docs, monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENT_TOKENS", 1000)
    path = shared.fresh_path(spark, "tokens")
    tokens.write_files(edges, PATH, path)
    segments = tokens.read_segments(spark, path)
    docs = tokens.documents(segments).collect()
    tokenizer = Tokenizer.from_file(PATH)
    sizes = Counter((i, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, _ in EDGES)
    assert Counter((r.doc_id, r.n_tokens) for r in docs) == sizes
    at = 0
    for r in sorted(docs, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    named = [r.doc_id for r in sorted(docs, key=lambda r: r.start) if r.doc_id is not None]
    assert named == sorted(named)
    whole = []
    for row in segments.orderBy("start").collect():
        whole += tokens.Codes(bytes(row.codes)).all().tolist()
    asked = spark.createDataFrame([(p,) for p in [0, 5, at - 1, at, -1, None, 5]], "position bigint")
    got = {r.position: r.token for r in tokens.lookup(segments, asked).collect()}
    assert got == {p: whole[p] for p in (0, 5, at - 1)}
    assert tokens.write_and_read(no_docs, PATH).count() == 0


# --- near duplicates -------------------------------------------------------------------


def test_near_duplicates_match_plain_version(spark, some):
    got = by_id(queries_text.op5_simhash_near_dedup(spark, SF))
    assert got == brute.near_duplicates(some[1])


def _fps(spark, values):
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    return spark.createDataFrame(signed, "fp bigint")


def _classes(spark, values):
    linked = graph.components(simhash.links(_fps(spark, values))).collect()
    return {(r.node % (1 << 64)): (r.component % (1 << 64)) for r in linked}


def test_links_are_complete_in_dense_groups(spark, monkeypatch):
    rng = random.Random(1)
    values = {0, (1 << 64) - 1}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            v = centre
            for _ in range(rng.randrange(6)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values)
    pairs = [
        (i, j)
        for i in range(len(values))
        for j in range(i)
        if (values[i] ^ values[j]).bit_count() <= 3
    ]
    want = Counter(Counter(brute.roots(len(values), pairs)).values())
    for large in (simhash.LARGE, 5):  # the second cuts nearly every bucket again
        monkeypatch.setattr(simhash, "LARGE", large)
        found = _classes(spark, values)
        sizes = Counter(Counter(found.get(v, v) for v in values).values())
        assert sizes == want


def test_near_duplicates_on_edges(edges, no_docs):
    got = rows_of(simhash.near_duplicates(edges), "doc_id", "component_id")
    ids = {i: c for i, c in got if i is not None}
    assert (ids[1], ids[2], ids[3], ids[6], ids[7]) == (1, 1, 1, 6, 6)
    assert len(got) == len(EDGES)
    kept = simhash.keep_one(edges)
    assert kept.columns == edges.columns
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.keep_one(no_docs).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(60)]
    edges += [(7, 7), (None, 3), (5000, 5001), (5001, 5000)]
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.component for r in graph.components(frame).collect()}
    want = {i: 0 for i in range(41)} | {1000 + i: 1000 for i in range(60)} | {5000: 5000, 5001: 5000}
    assert got == want
    assert graph.components(frame.limit(0)).count() == 0


# --- repeated strings ------------------------------------------------------------------


def test_repeated_strings_match_plain_version(spark, some):
    got = by_id(queries_text.op10_suffix_array_dedup(spark, SF))
    assert got == list(brute.removed(some[1]))


def test_a_round_sorts_its_own_keys_only():
    rng = random.Random(3)
    texts = ["".join(rng.choices("abc ", k=400)).encode() for _ in range(6)]
    texts += [texts[0][50:250] + texts[1][:90]]
    chunk = suffixes.Chunk(list(range(7)), [len(t) for t in texts], b"".join(texts))
    half = 1 << 63
    for entries_of in (chunk.samples, lambda *a: chunk.suffixes(np.arange(0, 2000, 5), *a)):
        whole, parts = entries_of(), [entries_of((0, half - 1)), entries_of((half, 2 * half - 1))]
        assert all(0 < len(p) < len(whole) for p in parts)
        for name in ("keys", "shared", "places"):
            joined = np.concatenate([getattr(p, name) for p in parts])
            order = (lambda a: np.sort(a)) if name == "places" else (lambda a: a)
            assert (order(joined) == order(getattr(whole, name))).all()


def test_repeated_strings_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 2000)
    rng = random.Random(2)
    part = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    shared_parts = [part(n) for n in (30, 48, 49, 50, 51, 60, 70, 71, 90, 400)]
    texts = []
    for i in range(60):
        texts.append(part(rng.randrange(80)) + rng.choice(shared_parts) + part(rng.randrange(80)))
    texts += [texts[3], texts[3] + "!", "z" * 300, "z" * 49, "z" * 50, None, ""]
    docs = list(enumerate(texts))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = by_id(
        suffixes.dedup(frame).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    )
    assert got == list(brute.removed(docs))


def test_buckets_follow_the_suffixes_to_sort(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET_ENTRIES", 1 << 10)
    called = []

    def rounds(chunks, entries_of, bits, count, samples, plain=suffixes._rounds):
        called.append((bits, count))
        return plain(chunks, entries_of, bits, count, samples)

    monkeypatch.setattr(suffixes, "_rounds", rounds)
    rng = random.Random(5)
    docs = [(i, "".join(rng.choices("abcdefgh ", k=4000))) for i in range(50)]
    docs.append((50, "!" + docs[7][1][:100]))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: r.n_removed for r in suffixes.dedup(frame).collect() if r.n_removed}
    assert got == {50: 100}
    # few of 200,000 suffixes have a repeated sample, so no more than the fewest buckets hold them
    assert called[1][0] == 8
    # times that the chunks are read for their entries
    assert sum(count for _, count in called) <= 3


def test_entries_that_leading_bits_leave_open_are_ordered():
    rng = np.random.default_rng(4)
    keys = np.uint64(5 << 61) + rng.integers(0, 40, 3000, dtype=np.uint64)
    second = rng.integers(0, 3, 3000, dtype=np.uint32)
    want = sorted(range(3000), key=lambda i: (keys[i], second[i]))
    order, ordered = suffixes._ordered(keys, second)
    assert order.tolist() == want and (ordered == keys[want]).all()
    order, _ = suffixes._ordered(keys, None)
    assert order.tolist() == sorted(range(3000), key=lambda i: keys[i])
    _, first = np.unique(np.stack([keys, second.astype(np.uint64)]), axis=1, return_index=True)
    assert sorted(suffixes._repeats(keys, second).tolist()) == sorted(set(range(3000)) - set(first.tolist()))


def test_runs_end_with_their_document():
    texts = [b"x" * 60, b"", b"y" * 49, b"z" * 130, b"x" * 60]
    chunk = suffixes.Chunk(list(range(5)), [len(t) for t in texts], b"".join(texts))
    got = chunk.results(np.array([249, 10, 109, 159, 160, 189, 239, 10]))
    assert got["spans"].to_pylist() == [[[10, 60]], [], [], [[0, 130]], [[0, 60]]]
    assert got["n_removed"].to_pylist() == [50, 0, 0, 130, 60]
    assert got["kept"].to_pylist() == [b"x" * 10, b"", b"y" * 49, b"", b""]


def test_repeated_strings_on_edges(edges, no_docs):
    got = suffixes.dedup(edges, with_text=True)
    assert got.count() == len(EDGES)
    by = {r.doc_id: r for r in got.collect()}
    assert by[6].n_removed == 0 and by[7].n_removed == by[7].n_bytes and bytes(by[7].kept) == b""
    assert by[None].n_removed in (0, by[6].n_bytes)
    assert suffixes.dedup(no_docs).count() == 0


def test_a_window_hash_is_of_its_bytes_alone():
    text = np.frombuffer(bytes(range(256)) * 3, np.uint8)
    for size in (1, 2, 30, 50):
        hashes = suffixes.window_hashes(text, size)
        assert len(hashes) == len(text) - size + 1
        assert (hashes[:256] == hashes[256:512]).all() and len(set(hashes[:256].tolist())) == 256
    assert {(a - b) % 21 for a in suffixes.COVER for b in suffixes.COVER} == set(range(21))


# --- URL filters -----------------------------------------------------------------------


def test_url_rules_match_plain_version(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect()
    got = queries_text.op6_url_filters(spark, SF).orderBy("page_id").collect()
    for page, row in zip(pages, got, strict=True):
        host, path, rule, verdict = brute.url_rule(page.url)
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert verdict in (None, row.verdict)


def test_aliases_share_decisions(spark):
    link = '<link rel="canonical" href="{}">'
    pages = [
        (1, "http://a.org/x", link.format("http://b.org/y")),
        (2, "http://b.org/y#part", '<meta http-equiv="refresh" content="0; url=http://bad.net/z">'),
        (3, "http://c.org/?url=https%3A%2F%2Fbad.net%2Fq", None),
        (4, "http://d.org/1", link.format("http://bad.net/q2")),
        (5, "http://d.org/2", link.format("http://d.org/1/")),
        (6, "http://e.example.net/en/ok", link.format("http://d.org/2")),
        (7, "http://lone.org/", ""),
        (8, None, "x"),
        (9, "no scheme", link.format("/z")),
        (10, "HTTP://WWW.Bad.NET", ""),
        (10, "HTTP://WWW.Bad.NET", ""),
    ]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r.page_id: (r.verdict, r.reason) for r in urls.judge(frame).collect()}
    assert got == {
        1: ("block", "alias"),
        2: ("block", "alias"),
        3: ("block", "alias"),
        4: ("allow", "alias"),
        5: ("allow", "alias"),
        6: ("allow", "rule"),
        7: ("allow", "default"),
        8: ("allow", "default"),
        9: ("allow", "default"),
        10: ("allow", "default"),
    }
    more = spark.createDataFrame([("http://lone.org/", "https://bad.net/")], "source string, target string")
    assert urls.judge(frame, redirects=more).where("page_id = 7").first().verdict == "block"
    assert urls.judge(frame.limit(0)).count() == 0


# --- mixing ----------------------------------------------------------------------------


def test_exponent_meets_its_targets():
    totals = [900, 90, 10]
    even = mixing.exponent_for(totals, repeat=None)
    assert even == 0.0
    x = mixing.exponent_for(totals, repeat=2.0)
    w = mixing.weights(totals, x)
    size = max(t / s for t, s in zip(totals, w))
    assert max(size * s / t for t, s in zip(totals, w)) == pytest.approx(2.0)
    x = mixing.exponent_for(totals, repeat=None, target_entropy=1.2)
    assert mixing.entropy(mixing.weights(totals, x)) == pytest.approx(1.2)
    assert mixing.exponent_for(totals, repeat=0.5, budget=10**6) == 1.0


def test_mix_realises_its_budgets(spark, some):
    docs, texts = some
    drawn = queries_text.op3_source_mixing(spark, SF).collect()
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    size = {i: len(brute.spaced(t)) for i, t in texts}
    totals = Counter()
    for i, n in size.items():
        totals[source[i]] += n
    names = sorted(totals)
    w = mixing.weights([totals[s] for s in names], mixing.exponent_for([totals[s] for s in names]))
    scale = max(totals[s] / x for s, x in zip(names, w))
    for s, x in zip(names, w):
        own = [r for r in drawn if r.source == s]
        budget = math.floor(scale * x + 1e-6)
        full, rest = divmod(budget, totals[s])
        times = Counter(r.doc_id for r in own)
        assert set(times) == {i for i in size if source[i] == s} and set(times.values()) <= {full, full + 1}
        last = [r for r in own if r.epoch == full]
        got = sum(r.tokens for r in last)
        assert got <= rest
        # the documents left out don't fit any more in their order
        left = [n for i, n in size.items() if source[i] == s and i not in {r.doc_id for r in last}]
        assert not rest or got + max(left, default=0) > rest
        assert all(0 <= r.place <= 1 for r in own)
        assert all(r.tokens == size[r.doc_id] for r in own)


def test_mix_edges_and_budget(edges, no_docs):
    mixed = mixing.mix(edges)
    assert mixed.columns == edges.columns
    assert mixed.count() >= len(EDGES)
    assert mixing.mix(no_docs).count() == 0
    fewer = mixing.draw(edges, repeat=None, budget=50)
    assert sum(r.tokens for r in fewer.collect()) <= 50


# --- pipeline --------------------------------------------------------------------------


def test_pipeline_matches_plain_stages(spark, some):
    docs, _ = some
    rows = {r.doc_id: (r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()}
    current = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = shared.written(stage(spark, current, SF), f"test-{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        before = sorted({r.doc_id for r in current.select("doc_id").collect()})
        after = [r.doc_id for r in out.select("doc_id").collect()]
        pairs = [(i, rows[i][0]) for i in before]
        if name == "quality rules":
            assert {i for i, t in pairs if brute.quality(t)[5]}.isdisjoint(after)
        if name == "near duplicates":
            assert sorted(after) == sorted({c for _, _, c in brute.near_duplicates(pairs)})
        if name == "benchmark decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert sorted(after) == [r[0] for r in brute.contamination(pairs, items) if not r[5]]
        if name == "source mix":
            assert set(after) == set(before)
            mixed = sorted((i, rows[i][0]) for i in after)
        if name == "token files":
            want = list(brute.token_rows(mixed, Tokenizer.from_file(PATH)))
            assert sorted(tuple(r) for r in out.collect()) == want
        current = out
