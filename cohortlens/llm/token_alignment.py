"""Alignment of two tokenizers over the same texts: groups of tokens that end together, and corpus counts of linked ids."""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import byte_slices, require, stored, text_or_empty
from cohortlens.llm.encoding import SPACE, byte_of_letter

#: White space and what follows it, up to a space or line feed after other characters: no token of either tokenizer crosses such a place.
_UNIT = re.compile(f"[{SPACE}]+(?:[^{SPACE}]+(?:(?![ \n])[{SPACE}]+)?)*")
#: Room for units that a worker keeps, in characters with 100 more for each unit, and pairs whose counts are sent to every task; the others are joined.
_ROOM, FREQUENT = 32 << 20, 1 << 16
_STORED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs array<long>, times array<int>"


def successors(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """The last token of each token's group: tokens of A are numbered first, then those of B; a group's last token is one of B.

    ``ends_a`` and ``ends_b`` are rising byte ends that reach the same last byte. Every token points to the overlapping token that reaches
    farthest right: one of A to the one of B over its last byte, one of B to the one of A over its last byte if that ends later, else to itself.
    Successors are doubled for all tokens at once until they stay as they are, which takes the logarithm of the longest chain.
    """
    n = len(ends_a)
    over_a, over_b = np.searchsorted(ends_b, ends_a), np.searchsorted(ends_a, ends_b)
    later = ends_a[over_b] > ends_b
    after = np.concatenate((n + over_a, np.where(later, over_b, n + np.arange(len(ends_b)))))
    while True:
        further = after[after]
        if np.array_equal(further, after):
            return after
        after = further


def _past(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)))


def _sums(values: np.ndarray, past: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring places of ``past``."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[past[1:]] - total[past[:-1]]


class Units:
    """Both tokenizers' tokens of units of text, their groups and links; each distinct unit is aligned once while it is kept."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = byte_of_letter()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab().items():
            self.a_bytes[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        self.digits = list(map(str, range(max(len(self.a_bytes), len(self.b_bytes)))))
        self.blank = self.b.piece_to_id("▁")
        # units part at spaces and line feeds: wrong if a piece holds a line feed, or a space after something else
        self.parts = not any("\n" in p or re.search("[^▁]▁", p) for p in pieces)
        self.clear()

    def clear(self) -> None:
        self.index, self.chars = {}, 0
        self.groups: list[str] = []
        self.sizes = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, and whether both give the unit's bytes
        self.first_link, self.links = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _encode_b(self, units: list[str]) -> list[list[int]]:
        """B puts a space before what it encodes; a unit that starts with a space gives it up, another one's first piece goes."""
        found = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return [[self.blank] if u == " " else ids if u[0] == " " else ids[1:] for u, ids in zip(units, found, strict=True)]

    def add(self, units: list[str]) -> None:
        """Aligns units that aren't there."""
        if not units:
            return
        ids_a, ids_b = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)], self._encode_b(units)
        want = [u.encode() for u in units]
        n_a, n_b, size = (np.fromiter(map(len, x), np.int64, len(units)) for x in (ids_a, ids_b, want))
        flat_a, flat_b = (np.fromiter(itertools.chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((ids_a, n_a), (ids_b, n_b)))
        good = (_sums(self.a_size[flat_a], _past(n_a)) == size) & (_sums(self.b_size[flat_b], _past(n_b)) == size)
        flat_a, flat_b = flat_a[np.repeat(good, n_a)], flat_b[np.repeat(good, n_b)]
        # sizes agree unit by unit, so the bytes of all units together differ if those of one do
        whole = b"".join(itertools.compress(want, good))
        if b"".join(map(self.a_bytes.__getitem__, flat_a.tolist())) != whole or b"".join(map(self.b_bytes.__getitem__, flat_b.tolist())) != whole:
            good &= [b"".join(map(self.a_bytes.__getitem__, a)) == w == b"".join(map(self.b_bytes.__getitem__, b)) for a, b, w in zip(ids_a, ids_b, want, strict=True)]
            flat_a, flat_b = (np.fromiter(itertools.chain.from_iterable(itertools.compress(x, good)), np.int64, int(n[good].sum())) for x, n in ((ids_a, n_a), (ids_b, n_b)))
        groups, links, counts = [""] * len(units), np.zeros(0, np.int64), np.zeros(len(units), np.int64)
        if len(flat_b):
            last = successors(np.cumsum(self.a_size[flat_a]), np.cumsum(self.b_size[flat_b])) - len(flat_a)
            label_a, label_b = last[: len(flat_a)], last[len(flat_a) :]
            terminal = np.flatnonzero(label_b == np.arange(len(flat_b)))
            until_a, until_b = np.searchsorted(label_a, terminal, "right"), terminal + 1
            links = flat_a[until_a - 1] * len(self.b_bytes) + flat_b[until_b - 1]
            text_a, text_b = list(map(self.digits.__getitem__, flat_a.tolist())), list(map(self.digits.__getitem__, flat_b.tolist()))
            at_a, at_b = [0, *until_a.tolist()], [0, *until_b.tolist()]
            texts = [f"{','.join(text_a[a:b])}|{','.join(text_b[c:d])}" for a, b, c, d in zip(at_a, at_a[1:], at_b, at_b[1:], strict=False)]
            until_unit = np.searchsorted(terminal, np.cumsum(n_b[good]) - 1, "right")
            counts[good] = np.diff(until_unit, prepend=0)
            stops = until_unit.tolist()
            for k, a, b in zip(np.flatnonzero(good).tolist(), [0, *stops], stops, strict=False):
                groups[k] = texts[a] if b == a + 1 else ";".join(texts[a:b])
        rows = np.stack((n_a, n_b, counts, np.ones(len(units), np.int64)), axis=1) * good[:, None]
        self.index.update(zip(units, range(len(self.groups), len(self.groups) + len(units)), strict=True))
        self.chars += sum(map(len, units)) + 100 * len(units)
        self.groups += groups
        self.sizes = np.concatenate((self.sizes, rows))
        self.first_link = np.concatenate((self.first_link, self.first_link[-1] + np.cumsum(counts)))
        self.links = np.concatenate((self.links, links))

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the places of all texts' units, where each text's units start and the last ones end)."""
        found = [(_UNIT.findall(" " + t) if self.parts else [" " + t]) if t else [] for t in texts]
        if self.chars > _ROOM:
            self.clear()
        self.add(list({u: None for us in found for u in us if u not in self.index}))
        index = self.index
        return np.array([index[u] for us in found for u in us], np.int64), np.cumsum([0, *map(len, found)])


_units: dict[tuple[str, str], Units] = {}


def aligned(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One stored row per document: how many tokens of A and B, groups and links it has, the groups' digest, and its linked pairs.

    A (a byte-level BPE file) encodes a space and the text, B (a sentencepiece model that puts a space first) the text; special strings are plain text. A pair is
    A's id times B's vocabulary plus B's id; ``pairs`` are distinct and rise, ``times`` says how often each is linked. ``groups`` is
    `a1,a2|b1;a3|b2,b3` if ``keep_groups``, else null; ``groups_sha256`` is its digest. Null and empty texts, and those whose tokens of A or B don't give
    their bytes back, have no tokens: zeros and ''. ``row`` numbers the rows. Repeated rows are each returned, a null id stays null, no rows give no rows.

    Both tokenizers end a token before each space or line feed that follows another character, so texts are cut there and each
    distinct unit is encoded and aligned once per worker.
    """
    require(docs, id_col, text_col)

    def align(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _units.setdefault((a_path, b_path), None) or Units(a_path, b_path)
        _units[a_path, b_path] = units
        row = TaskContext.get().partitionId() << 40
        for part in parts:
            for some in byte_slices(part, "text", 2 << 20):
                texts = some.column("text").to_pylist()
                unit, past = units.of(texts)
                good = _sums(1 - units.sizes[unit, 3], past) == 0
                n_a, n_b, n_groups = (_sums(units.sizes[unit, k], past) * good for k in range(3))
                names = [";".join(map(units.groups.__getitem__, unit[a:b].tolist())) if ok else "" for a, b, ok in zip(past[:-1].tolist(), past[1:].tolist(), good.tolist(), strict=True)]
                digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in names]
                # linked pairs of each text, sorted
                each = (units.first_link[unit + 1] - units.first_link[unit]) * np.repeat(good, np.diff(past))
                at = np.cumsum(each) - each
                pair = units.links[np.repeat(units.first_link[unit] - at, each) + np.arange(each.sum())]
                text = np.repeat(np.repeat(np.arange(len(texts)), np.diff(past)), each)
                order = np.lexsort((pair, text))
                pair, text = pair[order], text[order]
                first = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (text[1:] != text[:-1]))) if len(pair) else np.zeros(0, bool))
                times = np.diff(np.append(first, len(pair))).astype(np.int32)
                edges = pa.array(np.searchsorted(text[first], np.arange(len(texts) + 1)), pa.int32())
                numbers = [pa.array(x) for x in (row + np.arange(len(texts)), n_a, n_b, n_groups, n_groups)]
                columns = [numbers[0], some.column("doc_id"), *numbers[1:], pa.array(digests), pa.array(names if keep_groups else [None] * len(names), pa.string())]
                columns += [pa.ListArray.from_arrays(edges, pa.array(pair[first])), pa.ListArray.from_arrays(edges, pa.array(times))]
                row += len(texts)
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _STORED.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return stored(rows.mapInArrow(align, _STORED), "aligned")


def pair_counts(rows: DataFrame, b_size: int) -> DataFrame:
    """(pair, b, n): how many links of all documents hold each pair of ids; tasks count theirs first, a million pairs at a time."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            pair, place = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            return pair, np.bincount(place, np.concatenate([n for _, n in held]), len(pair)).astype(np.int64)

        def batch(pair: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(pair % b_size), pa.array(n)], ["pair", "b", "n"])

        for part in parts:
            held.append((part.column("pairs").flatten().to_numpy(zero_copy_only=False), part.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)))
            size += len(held[-1][0])
            if size > 2 << 20:
                held = [merged()]
                size = len(held[0][0])
                if size > 1 << 20:
                    yield batch(*held[0])
                    held, size = [], 0
        if size:
            yield batch(*merged())

    return rows.select("pairs", "times").mapInArrow(count, "pair long, b long, n long").groupBy("pair", "b").agg(F.sum("n").alias("n"))


def alignment(docs: DataFrame, a_path: str, b_path: str, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row; see :func:`aligned`.

    ``count_sum`` adds up, over a row's links, how many links of the corpus hold the same pair; ``n_best`` counts links whose pair is
    as frequent as any of its B id. The ``frequent`` commonest pairs, which most links have, are sent to every task and summed there; links of other pairs are
    joined with their counts, so no pair's links meet in one task. The best counts have a row per B id.
    """
    import sentencepiece

    b_size = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    rows = aligned(docs, a_path, b_path, id_col=id_col, text_col=text_col)
    counts = stored(pair_counts(rows, b_size), "pairs")
    best = np.zeros(b_size, np.int64)
    for r in counts.groupBy("b").agg(F.max("n").alias("n")).collect():  # at most B's vocabulary
        best[r.b] = r.n
    top = sorted((r.pair, r.n) for r in counts.orderBy(F.desc("n"), "pair").limit(frequent).collect())
    known, n_known = np.array([p for p, _ in top], np.int64), np.array([n for _, n in top], np.int64)

    def look_up(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which pairs are among the frequent ones, and their places)."""
        if not len(known):
            return np.zeros(len(pair), bool), np.zeros(len(pair), np.int64)
        at = np.minimum(np.searchsorted(known, pair), len(known) - 1)
        return known[at] == pair, at

    def summed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            past = part.column("pairs").offsets.to_numpy().astype(np.int64)
            past = past - past[0]
            pair, times = part.column("pairs").flatten().to_numpy(zero_copy_only=False), part.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            found, at = look_up(pair)
            n = n_known[at] * found if len(known) else np.zeros(len(pair), np.int64)
            is_best = found & (n == best[pair % b_size])
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(_sums(times * is_best, past)), pa.array(_sums(times * n, past))], ["row", "n_best", "count_sum"])

    def others(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            past = part.column("pairs").offsets.to_numpy().astype(np.int64)
            pair, times = part.column("pairs").flatten().to_numpy(zero_copy_only=False), part.column("times").flatten().to_numpy(zero_copy_only=False)
            rare = ~look_up(pair)[0]
            row = np.repeat(part.column("row").to_numpy(), np.diff(past))
            yield pa.RecordBatch.from_arrays([pa.array(row[rare]), pa.array(pair[rare]), pa.array(times[rare]), pa.array(best[pair[rare] % b_size])], ["row", "pair", "times", "best"])

    light = rows.select("row", "pairs", "times")
    rare = light.mapInArrow(others, "row long, pair long, times int, best long").join(counts.select("pair", "n"), "pair")
    rare = rare.select("row", F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0).cast("long").alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    sums = light.mapInArrow(summed, "row long, n_best long, count_sum long").unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.drop("pairs", "times", "groups").join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
