"""Fill-in-middle and packing, held against plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm.conftest import EDGES
from tidemark.llm import middle, packing, queries_text

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")

# --- fill-in-middle --------------------------------------------------------------------


def plain_fim(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by slicing strings."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, y, z = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{z}<P>{x}<M>{y}"
    return n, "psm", a, b - a, f"<P>{x}<S>{z}<M>{y}"


def naive_ends(data):
    n = len(data)
    return [i for i in range(n) if i + 1 == n or data[i + 1] & 0xC0 != 0x80]


@pytest.mark.parametrize("kind", ["ascii", "mixed", "bytes"])
def test_select_and_rank_equal_plain_counting(kind):
    rng = random.Random(kind)
    for size in [0, 1, 2, 7, 8, 9, 15, 16, 17, 64, *(rng.randrange(400) for _ in range(60))]:
        if kind == "bytes":
            raw = bytes(rng.randrange(256) for _ in range(size))
        else:
            raw = "".join(rng.choice("a" if kind == "ascii" else "aé日\U0001f600\0") for _ in range(size)).encode()
        ends = naive_ends(raw)
        index = middle.UnitIndex(np.frombuffer(raw, np.uint8))
        k = np.arange(len(ends) + 1)
        assert index.select(k).tolist() == [0, *(e + 1 for e in ends)]
        at = np.arange(len(raw) + 1)
        assert index.rank(at).tolist() == [sum(e < i for e in ends) for i in at]


def test_fill_in_middle_matches_plain_version(spark, some):
    got = queries_text.op12_fill_in_middle(spark, SF).orderBy("doc_id").collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for (i, text), row in zip(some[1], got, strict=True):
        n, form, a, b, output = plain_fim(i, text)
        assert tuple(row) == (i, n, form, a, b, sha(output), sha(text))
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_on_edges(spark, edges, no_docs, monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab é日\U0001f600<PSM>") for _ in range(rng.randrange(30))) for _ in range(300)]
    texts += ["<P>", "a<M>b", "<S", "<" * 9]
    rows = [(i, t, s, 1, "kept") for i, t, s in EDGES] + [(i, t, None, 2, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, edges.schema)
    for clash in ("row", "text", "bare", "h1", "fim"):
        named = docs if clash == "text" else docs.withColumn(clash, F.lit("theirs"))
        cut = middle.transform(named)
        assert cut.columns == [*[c for c in named.columns if c != "fim"], "fim"]
        if clash not in ("text", "fim"):
            assert cut.where(F.col(clash) != "theirs").isEmpty()
    monkeypatch.setattr(middle, "INDEXED_BYTES", 100)
    cut = middle.transform(docs).withColumn("back", middle.restored(F.col("fim.output"), F.col("fim.form")))
    got = Counter((r.doc_id, r.text, r.source, tuple(r.fim), r.back) for r in cut.collect())
    assert got == Counter((i, t, s, plain_fim(i, t), t or "") for i, t, s, *_ in rows)
    assert middle.transform(no_docs).count() == 0
    odd = middle.transform(docs.withColumnRenamed("text", "my.text"), "my.text")
    assert odd.columns[1] == "my.text" and odd.count() == len(rows)


# --- packing ---------------------------------------------------------------------------


def plain_best_fit(sizes, most):
    """The room left in each bin after placing one item at a time."""
    room = []
    for size in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= size]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= size
        else:
            room.append(most - size)
    return room


def test_the_plan_equals_packing_item_by_item():
    rng = random.Random(2)
    for _ in range(300):
        most = rng.choice([1, 5, 16, 63, 64, 100])
        few = [1, (most + 1) // 2, most // 3 + 1, most]
        sizes = [rng.randint(1, most) if rng.random() < 0.7 else rng.choice(few) for _ in range(rng.randrange(200))]
        counts = Counter(sizes)
        rows, bins = packing.plan(counts, most)
        room = [most] * bins
        for length in sorted(counts, reverse=True):
            steps = sorted((r for r in rows.tolist() if r[0] == length), key=lambda r: r[1])
            for step, after in zip(steps, [*steps[1:], [0, counts[length]]]):
                for i in range(after[1] - step[1]):
                    at = step[3] + i // step[2]
                    assert step[4] + i % step[2] * length == most - room[at]
                    room[at] -= length
        assert sorted(room) == sorted(plain_best_fit(sizes, most))
    with pytest.raises(ValueError):
        packing.plan({6: 1}, 5)


def test_the_plan_does_not_grow_with_the_data():
    rng = random.Random(3)
    counts = {n: rng.randrange(1, 100) for n in range(1, 2049)}
    small, _ = packing.plan(counts)
    large, bins = packing.plan({n: c * 10**9 + 7 for n, c in counts.items()})
    assert len(large) < 2 * len(small) + 2048
    assert bins >= sum(n * c for n, c in counts.items()) * 10**9 / 2048


def test_the_tightest_capacity():
    rng = random.Random(6)
    for most in (1, 2, 7, 8, 100):
        tree, is_open = packing.Capacities(most), set()
        for _ in range(200):
            c = rng.randint(0, most)
            is_open ^= {c}
            tree.mark(c, c in is_open)
            need = rng.randint(0, most)
            assert tree.tightest(need) == min((x for x in is_open if x >= need), default=None)


def held_in_order(rows):
    """Sequences are gapless from 0 and documents whole; returns the room left in each."""
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    room = []
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        room.append(2048 - at)
    return room, by_doc


def test_packing_matches_plain_version(spark, some):
    tokenizer = Tokenizer.from_file(PATH)
    rows = queries_text.op13_best_fit_packing(spark, SF).collect()
    room, by_doc = held_in_order(rows)
    sizes, want = [], {}
    for i, text in some[1]:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            piece = ids[k : k + 2048]
            sizes.append(len(piece))
            want[i, k // 2048] = k, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    assert sorted(room) == sorted(plain_best_fit(sizes, 2048))
    assert len(by_doc) == len(some[1])


def test_packed_sequences_hold_the_ids(spark, edges, no_docs):
    tokenizer = Tokenizer.from_file(PATH)
    packed = packing.pack(edges, PATH, most=50, end=7, keep_ids=True)
    rows = packed.collect()
    sizes = Counter()
    for i, text, _ in EDGES:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
        sizes.update((i, k // 50, k, min(50, n - k)) for k in range(0, n, 50))
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in rows) == sizes
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert sum(r.n_tokens for r in whole.values()) == sum(r.length for r in rows)
    for r in rows:
        s = whole[r.sequence_id]
        assert len(s.ids) == 4 * s.n_tokens <= 200 and r.offset in s.starts
        assert s.ids[4 * r.offset : 4 * (r.offset + r.length)] == r.ids
        assert s.doc_ids[s.starts.index(r.offset)] == r.doc_id
    assert packing.pack(no_docs, PATH).count() == 0
    odd = edges.withColumnRenamed("text", "my.text").withColumn("sequence_id", F.lit("theirs"))
    assert packing.pack(odd, PATH, text="my.text").count() >= len(EDGES)
    texts = spark.createDataFrame([("a", "x y"), (None, None), ("a", "x y")], "doc_id string, text string")
    assert {r.sequence_id for r in packing.pack(texts, PATH).collect()} == {0}
