"""Exact encoding with a tokenizers file, one piece between white space at a time, each distinct piece once per worker."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa

#: White space as the tokenizers' patterns see it (Unicode White_Space).
SPACE = "\t-\r \x85\xa0  -     　"
#: A run of white space with what follows it up to the next: no token of a byte-level BPE crosses its end.
_UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Latin letters, with a space before them if any, and then marks: two pieces that the tokenizers' patterns and normalisers leave whole.
_WORD_MARKS = re.compile("( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)?([.,;:!?#*$%&|]+)?")
_KEEP = 500_000
#: What a byte is: 0 white space, 1 an ASCII letter, 2 one of the marks above, 3 anything else.
_KINDS = bytes(0 if b in b" \t\n\x0b\x0c\r" else 1 if chr(b).isalpha() and b < 128 else 2 if b in b".,;:!?#*$%&|" else 3 for b in range(256))

_tokenizers: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per worker, on one thread (Spark runs the tasks side by side)."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        _tokenizers[path] = loaded
    return _tokenizers[path]


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level models have for each byte: printable Latin-1 as it is, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in shown)}


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level model stands for."""
    return {c: b for b, c in _byte_letters().items()}


_LETTERS = _byte_letters()
_BYTE_LETTERS = {b: c for b, c in _LETTERS.items() if chr(b) != c}


class PieceCache:
    """Values of pieces of text that the library gives, kept while there is room (at most ``_KEEP`` pieces, and as many words and marks).

    Words and marks that normaliser and pattern pass on whole go straight to the library's model; other pieces are encoded in full.
    """

    def __init__(self, path: str, value: Callable, joined: Callable):
        self.value, self.joined = value, joined
        self.tokenizer = tokenizer(path)
        self.model = self.tokenizer.model
        self.pieces, self.words = {}, {}

    def _word(self, s: str) -> object:
        if s not in self.words:
            letters = s if s.isascii() and s[0] != " " else "".join(map(_LETTERS.__getitem__, s.encode()))
            self.words[s] = self.value([t.id for t in self.model.tokenize(letters)])
        return self.words[s]

    def __call__(self, pieces: Iterable) -> dict:
        """A mapping that holds every one of ``pieces`` (str, or UTF-8 bytes)."""
        if len(self.pieces) > _KEEP:
            self.pieces.clear()
        if len(self.words) > _KEEP:
            self.words.clear()
        known, rest = self.pieces, []
        for p in pieces:
            if p not in known:
                s = p if isinstance(p, str) else p.decode("utf-8", "replace")
                m = _WORD_MARKS.fullmatch(s)
                if not m or not s:
                    rest.append((p, s))
                elif m[1] is None:
                    known[p] = self._word(m[2])
                else:
                    word = self._word(m[1])
                    known[p] = word if m[2] is None else self.joined(word, self._word(m[2]))
        for (p, _), e in zip(rest, self.tokenizer.encode_batch_fast([s for _, s in rest], add_special_tokens=False), strict=True):
            known[p] = self.value(e.ids)
        return known


_counts: dict[str, PieceCache] = {}
_ids: dict[tuple[str, str], dict[bytes, bytes]] = {}


def count_tokens(path: str, texts: list[str]) -> list[int]:
    """Tokens of each text under a byte-level BPE file without normaliser, as encoding the whole text gives them."""
    if path not in _counts:
        _counts[path] = PieceCache(path, len, int.__add__)
    cache = _counts[path]
    units = [_UNIT.findall(t) for t in texts]
    known = cache(set().union(*units))
    return [sum(map(known.__getitem__, u)) for u in units]


def pieces_of(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(each piece's place in the list, the distinct pieces, which of them are whole words of other characters, how many pieces come before each text and before the end).

    A word between ASCII white space that has only Latin letters and common marks is lower-cased and cut into its runs of letters
    and of marks, which no token crosses; any other word is one piece as it is. One pass over the bytes of all texts; distinct pieces meet in Arrow's dictionary.
    """
    texts = texts.cast(pa.binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    joined = bytes(memoryview(texts.buffers()[2] or b"")[bounds[0] : bounds[-1]])
    bounds = bounds - bounds[0]
    raw, low = np.frombuffer(joined, np.uint8), np.frombuffer(joined.lower(), np.uint8).copy()
    kind = np.frombuffer(joined.translate(_KINDS), np.uint8).copy()
    lead = np.flatnonzero(raw == 0xC3)  # U+00C0 to U+00FF: letters but for two
    second = raw[lead + 1]
    lead, second = lead[(second != 0x97) & (second != 0xB7)], second[(second != 0x97) & (second != 0xB7)]
    kind[lead] = kind[lead + 1] = 1
    low[lead + 1] |= np.where(second < 0x9F, 0x20, 0).astype(np.uint8)
    inside = kind != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = bounds[:-1][np.diff(bounds) > 0]
    first[heads] = inside[heads]
    words = np.flatnonzero(first)
    if not len(words):
        return np.zeros(0, np.int64), [], np.zeros(0, bool), np.zeros(len(bounds), np.int64)
    odd = np.logical_or.reduceat(kind == 3, words)
    whole = np.zeros(len(raw), bool)
    whole[words[0] :] = np.repeat(odd, np.diff(np.append(words, len(raw))))
    first[1:] |= (kind[1:] != kind[:-1]) & inside[1:] & ~whole[1:]
    starts = np.flatnonzero(first)
    at = np.append((np.cumsum(inside, dtype=np.int32) - 1)[starts], np.int32(inside.sum())).astype(np.int32)
    found = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.where(whole, raw, low)[inside])]).dictionary_encode()
    place = found.indices.to_numpy()
    other = np.zeros(len(found.dictionary), bool)
    other[place[whole[starts]]] = True
    return place, found.dictionary.to_pylist(), other, np.searchsorted(starts, bounds)


def encode_dropping_space(path: str, texts: pa.Array, kind: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, of numpy type ``kind``; where each text's ids start and the last ones end) of UTF-8 texts under a lower-casing BPE file that drops white space.

    Each text's ids end with ``end_id``. Runs of letters or marks go straight to the library's model, other words through the whole library; at
    most about ``_KEEP`` pieces are kept from one call to the next.
    """
    known = _ids.setdefault((path, kind), {})
    if len(known) > _KEEP:
        known.clear()
    piece, distinct, other, before = pieces_of(texts)
    code, tokenize = kind[-1:] == "2" and "H" or "I", tokenizer(path).model.tokenize
    ids_of = [known.get(w) for w in distinct]
    rest = []
    for k, w in enumerate(distinct):
        if ids_of[k] is None:
            if other[k]:
                rest.append(k)
            else:
                ids_of[k] = known[w] = array(code, [t.id for t in tokenize(w.decode() if w.isascii() else w.decode("latin-1").translate(_BYTE_LETTERS))]).tobytes()
    for k, e in zip(rest, tokenizer(path).encode_batch_fast([distinct[k].decode("utf-8", "replace") for k in rest], add_special_tokens=False), strict=True):
        ids_of[k] = known[distinct[k]] = array(code, e.ids).tobytes()
    ids_of.append(array(code, [end_id]).tobytes())
    flat = np.frombuffer(b"".join(ids_of), kind)
    size = np.fromiter(map(len, ids_of), np.int64, len(ids_of)) // np.dtype(kind).itemsize
    at = np.cumsum(size) - size
    piece = np.insert(piece, before[1:], len(distinct))  # the end id after each text's pieces
    each = size[piece]
    past = np.concatenate(([0], np.cumsum(each)))
    return flat[np.repeat(at[piece] - past[:-1], each) + np.arange(past[-1])], past[before + np.arange(len(before))]
