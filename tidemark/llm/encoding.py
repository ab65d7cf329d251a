"""Token ids of whole texts, where each distinct piece of many texts is encoded once."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import combining, normalize

import numpy as np
import pyarrow as pa

#: Bytes of text encoded at once.
ENCODED_BYTES = 4 << 20
#: Pieces that a worker keeps, and their longest size: at most 30 MB. A full cache starts anew.
CACHED, CACHED_BYTES = 120_000, 48
# The splitting for which pieces may be encoded apart.
NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

SPACE, LETTER, DIGIT, SIGN, WHOLE = range(5)


def _byte_classes() -> np.ndarray:
    """White space, letters (any byte beyond ASCII too), digits, signs, and bytes that forbid a cut.

    Apostrophes begin contractions, `<` may begin a special token, and control characters
    are rare: a chunk between white space that has one of them is encoded as it stands.
    """
    kinds = np.full(256, WHOLE, np.uint8)
    for i in range(256):
        if i == 32 or 9 <= i <= 13:
            kinds[i] = SPACE
        elif i >= 128 or chr(i).isalpha():
            kinds[i] = LETTER
        elif chr(i).isdigit():
            kinds[i] = DIGIT
        elif 33 <= i < 127 and chr(i) not in "'<":
            kinds[i] = SIGN
    return kinds


_CLASSES = _byte_classes()


def cuts_at_words(state: dict) -> bool:
    """Whether a tokenizer (its JSON) encodes words, digits and runs of signs independently."""
    if (state.get("normalizer") or {}).get("normalizers") != NORMALIZERS:
        return False
    steps = (state.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    first = steps[0]
    return (
        first.get("type") == "Split"
        and first.get("pattern") == {"Regex": WORD_PATTERN}
        and (first.get("behavior"), first.get("invert")) == ("Removed", True)
        and [(s["type"], s.get("use_regex"), s.get("add_prefix_space")) for s in steps[1:]]
        == [("ByteLevel", False, False)]
        and state["model"].get("end_of_word_suffix") == "</w>"
        and all(
            t["content"].startswith("<") and not t["content"].split()[1:] and not t["normalized"]
            for t in state["added_tokens"]
        )
    )


def _stays_letters(piece: bytes) -> bool:
    """Letters before and after normalisation; else a mark of the piece may join its neighbour."""
    word = piece.decode("utf-8", "replace")
    return word.isalpha() and normalize("NFC", word).lower().isalpha()


def _odd(pieces: list[bytes]) -> list[bool]:
    """Which pieces beyond ASCII do not stay letters. Most hold plain letters only, which a set tells."""
    text = b"\n".join(pieces).decode("utf-8", "replace")
    if all(c in _PLAIN for c in set(text)):
        return [False] * len(pieces)
    return [not (_PLAIN.issuperset(w) or _stays_letters(p)) for p, w in zip(pieces, text.split("\n"), strict=True)]


#: Letters that no normalisation changes but that of case, and the line end between pieces.
_PLAIN = frozenset(
    c for c in map(chr, range(0x530))
    if c == "\n" or (c.isalpha() and not combining(c) and normalize("NFC", c) == c and c.lower().isalpha())
)
#: Those that it leaves as they are.
_LOWER = frozenset(c for c in _PLAIN if c.lower() == c and c != "\n")


class WordEncoder:
    """Ids of many texts as one flat array and the offsets of each.

    With a tokenizer that encodes words apart, texts are cut into words, digits and
    runs of signs, and each distinct piece is encoded once. Any other tokenizer gets
    whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            state = json.load(f)
        self.apart = cuts_at_words(state)
        # lower-case letters need no normaliser and no pattern, and ASCII ones are their own bytes
        bare = {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.bare = self.plain = self.tokenizer
        if self.apart:
            self.bare = Tokenizer.from_str(json.dumps(state | bare))
            steps = [bare["pre_tokenizer"], *state["pre_tokenizer"]["pretokenizers"][1:]]
            split = {"pre_tokenizer": {"type": "Sequence", "pretokenizers": steps}}
            self.plain = Tokenizer.from_str(json.dumps(state | bare | split))
        size = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.pieces: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str], tokenizer=None) -> list[list[int]]:
        found = (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)
        return [e.ids for e in found]

    def _ids_of(self, words: list[str], tokenizer) -> list[bytes]:
        """Ids of each piece, many pieces as one text; their ids end at end-of-word tokens."""
        width, out = self.kind.itemsize, []
        groups = [words[i : i + 500] for i in range(0, len(words), 500)]
        joined = self._encode([" ".join(g) for g in groups], tokenizer)
        for group, ids in zip(groups, joined, strict=True):
            ids = np.array(ids, self.kind)
            last = ((np.flatnonzero(self.ends[ids]) + 1) * width).tolist()
            raw = ids.tobytes()
            if len(last) == len(group) and last[-1] == len(raw):
                out += [raw[i:j] for i, j in zip([0, *last[:-1]], last, strict=True)]
            else:
                out += [np.array(x, self.kind).tobytes() for x in self._encode(group)]
        return out

    def _look_up(self, distinct: list[bytes], often: list[bool]) -> list[bytes]:
        """Ids of each distinct piece; short ones that stand there `often` are kept for later texts."""
        found = [self.pieces.get(p) for p in distinct]
        missing = [i for i, x in enumerate(found) if x is None]
        kept = [i for i in missing if often[i] and len(distinct[i]) <= CACHED_BYTES]
        if len(self.pieces) + len(kept) > CACHED:
            self.pieces = {}
        letters, plain, plain_words, others, other_words = [], [], [], [], []
        for i in missing:
            if distinct[i].isalpha():
                letters.append(i)
                continue
            word = distinct[i].decode("utf-8", "replace")
            if _LOWER.issuperset(word):
                plain.append(i)
                plain_words.append(word)
            else:
                others.append(i)
                other_words.append(word)
        for group, words, tokenizer in (
            (letters, [distinct[i].lower().decode() for i in letters], self.bare),
            (plain, plain_words, self.plain),
            (others, other_words, self.tokenizer),
        ):
            for i, ids in zip(group, self._ids_of(words, tokenizer), strict=True):
                found[i] = ids
                if often[i] and len(distinct[i]) <= CACHED_BYTES and len(ids) <= CACHED_BYTES:
                    self.pieces[distinct[i]] = ids
        if len(self.pieces) > CACHED:
            self.pieces = {}
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the offset of each text (one more than texts) of a binary array without nulls."""
        if not self.apart:
            ids = self._encode([t.decode("utf-8", "replace") for t in texts.to_pylist()])
            offsets = np.cumsum([0, *map(len, ids)])
            flat = [np.array(x, self.kind) for x in ids]
            return (np.concatenate(flat) if flat else np.zeros(0, self.kind)), offsets
        data, bounds = bytes_of(texts)
        kinds = _CLASSES[data]
        held = kinds != SPACE
        begins = held.copy()
        begins[1:] &= ~held[:-1]
        edges = bounds[:-1][bounds[:-1] < bounds[1:]]
        begins[edges] |= held[edges]
        upto = np.cumsum(held, dtype=np.int32)
        before = np.where(bounds > 0, upto[np.maximum(bounds, 1) - 1] if len(upto) else 0, 0)
        del upto
        kinds, begins = kinds[held], begins[held]
        starts = begins.copy()
        starts[1:] |= kinds[1:] != kinds[:-1]
        starts |= kinds == DIGIT
        at = np.flatnonzero(starts)
        opens = begins[at]
        chunk = np.cumsum(opens) - 1
        whole = np.zeros(int(chunk[-1]) + 1 if len(chunk) else 0, bool)
        whole[chunk[kinds[at] == WHOLE]] = True
        buffer = pa.py_buffer(np.ascontiguousarray(data[held]))

        def pieces():
            keep = opens | ~whole[chunk]
            cut = at[keep]
            ends = np.append(cut, len(kinds)).astype(np.int32)
            if not len(cut):
                return cut, keep, np.zeros(0, np.int32), []
            array = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(ends), buffer])
            coded = array.dictionary_encode()
            return cut, keep, coded.indices.to_numpy(), coded.dictionary.to_pylist()

        cut, keep, codes, distinct = pieces()
        odd = np.zeros(len(distinct), bool)
        beyond = [i for i, p in enumerate(distinct) if not p.isascii()]
        odd[beyond] = _odd([distinct[i] for i in beyond])
        if odd.any():
            # a mark may join the piece before or after it: no cuts in these chunks
            whole[chunk[keep][odd[codes]]] = True
            cut, keep, codes, distinct = pieces()
        ids = self._look_up(distinct, (np.bincount(codes, minlength=len(distinct)) > 1).tolist())
        lengths = np.array([len(x) for x in ids], np.int64) // self.kind.itemsize
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)),
            pa.array(np.frombuffer(b"".join(ids), self.kind)),
        )
        flat = lists.take(pa.array(codes)).flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(lengths[codes])])
        return flat, ends[np.searchsorted(cut, before)]


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array without nulls, and the offset of each text in them."""
    n = len(texts)
    kind = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    bounds = np.frombuffer(offsets, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of texts of at most `most` bytes together; a longer text stands alone."""
    start, n = 0, len(bounds) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + most, "right")) - 1)
        yield slice(start, end)
        start = end


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """Kept by the Python worker for the next task."""
    return WordEncoder(path)


def encoded(texts: pa.Array, path: str, end: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(texts' slice, flat ids with `end` after each text, offsets); null texts are empty."""
    words = encoder(path)
    texts = texts.fill_null(b"")
    for part in slices(bytes_of(texts)[1], ENCODED_BYTES):
        flat, bounds = words.encode(texts[part])
        flat = np.insert(flat, bounds[1:], np.array(end, flat.dtype))
        yield part, flat, bounds + np.arange(len(bounds))
