"""Plain versions of the operators, over lists, to hold results against."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPACED = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    return ALNUM.findall((text or "").translate(LOWER))


def spaced(text):
    return SPACED.findall(text or "")


def contamination(docs, items, size=13):
    of = defaultdict(set)
    for item, text in items:
        w = plain(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            of[tuple(w[i : i + size])].add(str(item))
    lengths = {len(w) for w in of}
    for doc_id, text in docs:
        w, hit, found = plain(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in of:
                    hit.update(range(i, i + n))
                    found |= of[key]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        yield doc_id, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)


def fingerprint(text, n=3):
    w = spaced((text or "").translate(LOWER))
    runs = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def near_duplicates(docs, distance=3):
    """docs in ascending doc_id order."""
    fps = [fingerprint(t) for _, t in docs]
    by = sorted(set(fps))
    pairs = [
        (i, j)
        for i in range(len(by))
        for j in range(i)
        if (by[i] ^ by[j]).bit_count() <= distance
    ]
    root = dict(zip(by, roots(len(by), pairs)))
    least = {}
    for (doc_id, _), fp in zip(docs, fps):
        least.setdefault(root[fp], doc_id)
    return [(d, f"{fp:016x}", least[root[fp]]) for (d, _), fp in zip(docs, fps)]


def quality(text):
    text = text or ""
    w = spaced(text)
    lines = [x for x in text.split("\n") if spaced(x)]
    keys = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(keys)
    covered = {j for i, k in enumerate(keys) if count[k] > 1 for j in range(i, i + 5)}
    return (
        len(w),
        sum(map(len, w)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
        len(w) < 10 or 100 * len(covered) > 20 * len(w),
    )


def token_rows(docs, tokenizer, end=1):
    """docs in ascending doc_id order."""
    import numpy as np

    start = 0
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        yield doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def removed(docs, size=50):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of docs in ascending doc_id order."""
    first = {}
    raw = [(d, (t or "").encode()) for d, t in docs]
    for d, b in raw:
        for i in range(len(b) - size + 1):
            first.setdefault(b[i : i + size], d)
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if first[b[i : i + size]] < d:
                gone[i : i + size] = b"\1" * size
        spans = len(re.findall(b"\1+", gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        yield d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()


BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


def license_base(text):
    """(n_words, n_base, first_word, last_word, base_labels)"""
    w, starts, labels = plain(text), [], set()
    for phrase, label in BASE_PHRASES:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    first, last = (min(starts), max(starts)) if starts else (None, None)
    return len(w), len(starts), first, last, ",".join(sorted(labels))


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    """(kind, start, end) of the base."""
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")),
                "card": lambda: 13 <= len(d) <= 19 and luhn(d),
                "phone": lambda: 9 <= len(d) <= 15,
            }[kind]()
            if ok:
                yield kind, m.start(), m.end()


RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def url_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :]).group()


def url_rule(url):
    host, path = url_parts(url)
    fits = [
        (len(r), r, a)
        for r, a in RULES
        for h, _, p in [r.partition("/")]
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p)
    ]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def license_labels(text, base, notices, cover=0.7, drift=6, k=2):
    """(labels, score): whole phrases, and long notices whose k-grams stand within a band of diagonals."""
    w, labels, score = plain(text), set(), 0.0
    for phrase, label in [*base, *notices]:
        p = phrase.split()
        if len(p) <= 8:
            if any(w[i : i + len(p)] == p for i in range(len(w) - len(p) + 1)):
                labels.add(label)
                score = 1.0
            continue
        stands = defaultdict(set)
        for i in range(len(w) - k + 1):
            for j in range(len(p) - k + 1):
                if w[i : i + k] == p[j : j + k]:
                    stands[i - j].add(j)
        for d in stands:
            held = set().union(*[stands[x] for x in range(d, d + drift + 1) if x in stands])
            if len(held) / (len(p) - k + 1) >= cover:
                labels.add(label)
                score = max(score, len(held) / (len(p) - k + 1))
    return ",".join(sorted(labels)), score


def alias_verdicts(pages, edges, normal):
    """{page_id: verdict} of (page_id, url) rows; edges are (url, url), `normal` spells a URL one way."""
    nodes = {normal(u) for _, u in pages if normal(u)} | {normal(u) for e in edges for u in e}
    nodes = sorted(nodes)
    at = {n: i for i, n in enumerate(nodes)}
    root = roots(len(nodes), [(at[normal(a)], at[normal(b)]) for a, b in edges])
    decided = defaultdict(set)
    for u in [u for _, u in pages if normal(u)] + [u for e in edges for u in e]:
        action = url_rule(u)[3]
        if action:
            decided[root[at[normal(u)]]].add(action)
    out = {}
    for page, u in pages:
        own = url_rule(u)[3]
        shared = decided.get(root[at[normal(u)]], set()) if normal(u) else set()
        out[page] = own or ("allow" if "allow" in shared or not shared else "block")
    return out
