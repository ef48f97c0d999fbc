"""Document fingerprints from improbable byte windows: ranked by the rarity of their entropy, kept in chained Bloom filters."""

from __future__ import annotations

import base64
import hashlib
import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import byte_slices, require, text_or_empty

#: Window widths in bytes, and into how many classes a width's entropies are cut, from none (0) to the greatest.
WIDTHS, CLASSES = (4, 8, 16, 32, 64), 1000
#: Bits that a feature sets, and bytes that are worked on at once.
_HASHES, _CHUNK = 5, 1 << 18


def widths_of(n_bytes: int) -> tuple[int, ...]:
    """The widths of a text's windows: a sixteenth of the power of two below its length, and half of that, so that texts of about equal length share one."""
    w = max(4, min(64, 1 << max(0, n_bytes.bit_length() - 5)))
    return (w,) if w == 4 or n_bytes >= 2048 else (w, w // 2)


def filter_bytes(width: int) -> int:
    """The size of a width's filters; each takes 5/8 as many features as it has bytes."""
    return 256 if width == 64 else 64


def entropy_classes(x: np.ndarray, width: int) -> np.ndarray:
    """The entropy class, 0 to CLASSES, of each window of ``width`` bytes of ``x``.

    A window's entropy follows from the sum of c log2 c over its bytes' counts c. From one window to the next one byte leaves and one enters, which
    changes two counts: as many as equal bytes stand after the one that leaves and before the one that enters. Those are counted by shifted comparisons.
    """
    n = len(x) - width + 1
    if n < 1:
        return np.zeros(0, np.int64)
    c = np.arange(1, width + 1)
    f = np.concatenate(([0], np.round(c * np.log2(c) * (1 << 16)))).astype(np.int64)  # whole numbers, so that sums are exact
    step = np.diff(f)
    before, after = np.zeros(len(x), np.uint8), np.zeros(len(x), np.uint8)
    for d in range(1, width):
        same = (x[d:] == x[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    total = np.empty(n, np.int64)
    total[0] = f[np.bincount(x[:width])].sum()
    total[1:] = step[before[width:]] - step[after[: n - 1]]
    return CLASSES - np.cumsum(total) * CLASSES // int(f[-1])


def _joined(texts: Sequence[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, which windows lie in one text)."""
    x = np.frombuffer(b"".join(texts), np.uint8)
    inside = np.ones(max(0, len(x) - width + 1), bool)
    for end in np.cumsum([len(t) for t in texts])[:-1]:
        inside[max(0, end - width + 1) : end] = False
    return x, inside


def _stretches(texts: Sequence[bytes], width: int, margin: int) -> Iterator[list[tuple[int, bytes, int, int, int]]]:
    """Lots of about _CHUNK bytes of (a text's place, a stretch of it, where the stretch starts, the first window that is to be used, the one after the last).

    A longer text comes in stretches that overlap, with ``margin`` windows before and after those to be used.
    """
    lot, size = [], 0
    for k, t in enumerate(texts):
        n = len(t) - width + 1
        for a in range(0, n, _CHUNK):
            b, low = min(n, a + _CHUNK), max(0, a - margin)
            piece = t[low : b + margin + width - 1]
            if size and size + len(piece) > _CHUNK:
                yield lot
                lot, size = [], 0
            lot.append((k, piece, low, a, b))
            size += len(piece)
    if size:
        yield lot


@dataclass(frozen=True)
class Rarity:
    """For each width, the rank of every entropy class: 1 for the rarest in a corpus; class 0, windows of one byte, has none (0)."""

    ranks: dict[int, np.ndarray]


def rarity(docs: DataFrame, text_col: str = "text") -> Rarity:
    """Ranks from how often each entropy class occurs among the windows of all texts, ties by the higher class; classes that don't occur are rarest.

    Null texts are empty. Without rows classes rank by entropy alone.
    """
    require(docs, text_col)
    place = {w: k for k, w in enumerate(WIDTHS)}

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(WIDTHS), CLASSES + 1), np.int64)
        for part in parts:
            for some in byte_slices(part, "text"):
                by_width: dict[int, list[bytes]] = {}
                for t in some.column("text").cast(pa.binary()).to_pylist():
                    for w in widths_of(len(t)):
                        by_width.setdefault(w, []).append(t)
                for w, texts in by_width.items():
                    for lot in _stretches(texts, w, 0):
                        x, inside = _joined([piece for _, piece, *_ in lot], w)
                        total[place[w]] += np.bincount(entropy_classes(x, w)[inside], minlength=CLASSES + 1)
        at, c = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(total[at, c])], ["at", "c", "n"])

    counts = np.zeros((len(WIDTHS), CLASSES + 1), np.int64)
    found = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(count, "at int, c int, n long").groupBy("at", "c").agg(F.sum("n").alias("n"))
    for r in found.collect():  # a row per width and class at most
        counts[r["at"], r["c"]] = r["n"]
    ranks = {}
    for w, n in zip(WIDTHS, counts, strict=True):
        rank = np.zeros(CLASSES + 1, np.uint32)
        rank[np.lexsort((-np.arange(1, CLASSES + 1), n[1:])) + 1] = np.arange(1, CLASSES + 1)
        ranks[w] = rank
    return Rarity(ranks)


def selected(texts: Sequence[bytes], width: int, rank: np.ndarray) -> list[list[int]]:
    """Offsets of each text's features: windows that are the rarest, the first of several, in a quarter or more of the ``width`` runs of ``width`` windows that hold them."""
    none = np.uint32(0xFFFFFFFF)
    out: list[list[int]] = [[] for _ in texts]
    for lot in _stretches(texts, width, 2 * width):
        pieces = [piece for _, piece, *_ in lot]
        x, inside = _joined(pieces, width)
        found = rank[entropy_classes(x, width)]
        # rank above, place below; runs may reach past a text's ends, and none holds windows of two texts
        low = np.where(inside & (found > 0), found << np.uint32(21) | np.arange(len(found), dtype=np.uint32), none)
        pad = np.full(width - 1, none, np.uint32)
        low = np.concatenate((pad, low, pad))
        k = 1
        while k < width:
            low = np.minimum(low[:-k], low[k:])
            k *= 2
        times = np.bincount(low[low != none] & np.uint32((1 << 21) - 1), minlength=len(found))
        taken = np.flatnonzero(4 * times >= width)
        first = np.concatenate(([0], np.cumsum([len(p) for p in pieces])))
        bounds = np.searchsorted(taken, first)
        for j, (k, _, low_at, a, b) in enumerate(lot):
            at = taken[bounds[j] : bounds[j + 1]] - first[j] + low_at
            out[k] += at[(at >= a) & (at < b)].tolist()
    return out


def chain(features: Sequence[bytes], size: int) -> list[tuple[int, bytes]]:
    """Bloom filters of ``size`` bytes with how many features each holds; a new one starts when 5/8 as many are in. A feature counts once."""
    most, bits = size * 5 // 8, size * 8
    hashes = list(dict.fromkeys(map(xxhash.xxh64_intdigest, features)))
    h = np.array(hashes, np.uint64)
    place = (h[:, None] >> (np.uint64(12) * np.arange(_HASHES, dtype=np.uint64)) & np.uint64(bits - 1)).astype(np.int64)
    n = -(-len(h) // most)
    on = np.zeros((n, bits), bool)
    on[np.arange(len(h))[:, None] // most, place] = True
    return [(min(most, len(h) - k * most), bytes(np.packbits(on[k]))) for k in range(n)]


Digest = dict[int, list[tuple[int, bytes]]]


def digests(texts: Sequence[bytes], rarity: Rarity) -> list[Digest]:
    """For each text, by width, its chain of filters. A text without features has its whole bytes as the one feature, of width 0; an empty text has none."""
    out: list[Digest] = [{} for _ in texts]
    for w in WIDTHS:
        some = [k for k, t in enumerate(texts) if w in widths_of(len(t))]
        for k, at in zip(some, selected([texts[k] for k in some], w, rarity.ranks[w]), strict=True):
            if at:
                out[k][w] = chain([texts[k][a : a + w] for a in at], filter_bytes(w))
    for t, d in zip(texts, out, strict=True):
        if t and not d:
            d[0] = chain([t], filter_bytes(0))
    return out


def write(digest: Digest) -> str:
    """`width:features.filter.features.filter;...` with filters in base 64; '' for an empty text."""
    return ";".join(f"{w}:" + ".".join(f"{n}.{base64.b64encode(f).decode()}" for n, f in filters) for w, filters in sorted(digest.items()))


def parse(fingerprint: str) -> Digest:
    out: Digest = {}
    for part in filter(None, fingerprint.split(";")):
        w, filters = part.split(":")
        fields = filters.split(".")
        out[int(w)] = [(int(n), base64.b64decode(f)) for n, f in zip(fields[::2], fields[1::2], strict=True)]
    return out


def _overlap(one: list[tuple[int, bytes]], other: list[tuple[int, bytes]]) -> float:
    """The mean over the shorter chain's filters, by their features, of the greatest likeness with a filter of the other chain.

    Two filters' likeness is the bits they share beyond those that chance gives, over the most they could share beyond them.
    """
    if (len(one), sum(n for n, _ in one), one) > (len(other), sum(n for n, _ in other), other):
        one, other = other, one
    many = np.frombuffer(b"".join(f for _, f in other), np.uint8).reshape(len(other), -1)
    set_many = np.bitwise_count(many).sum(1, dtype=np.int64)
    bits, total = many.shape[1] * 8, 0.0
    for n, f in one:
        x = np.frombuffer(f, np.uint8)
        shared, here = np.bitwise_count(many & x).sum(1, dtype=np.int64), int(np.bitwise_count(x).sum(dtype=np.int64))
        chance = here * set_many / bits
        room = np.minimum(here, set_many) - chance
        total += n * float(np.max(np.clip((shared - chance) / np.maximum(room, 1e-9), 0.0, 1.0)))
    return total / sum(n for n, _ in one)


def likeness(a: Digest, b: Digest) -> float:
    """0 to 1: the overlap at the greatest width that both have; 1 for equal digests, two empty ones among them, 0 without a common width."""
    if a == b:
        return 1.0
    both = a.keys() & b.keys()
    return _overlap(a[max(both)], b[max(both)]) if both else 0.0


def fingerprints(docs: DataFrame, rarity: Rarity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row, without a shuffle; equal texts have equal fingerprints, a null text that of the empty one."""
    require(docs, id_col, text_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for some in byte_slices(part, "text", 1 << 20):
                found = digests(some.column("text").cast(pa.binary()).to_pylist(), rarity)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(map(write, found), pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def compared(pairs: DataFrame, a: str = "fingerprint", b: str = "other_fingerprint", into: str = "likeness") -> DataFrame:
    """``pairs`` with the likeness of two columns of fingerprints; a null fingerprint counts as that of the empty text."""

    def near(x, y):
        return x.combine(y, lambda p, q: likeness(parse(p or ""), parse(q or "")))

    return pairs.withColumn(into, F.pandas_udf(near, "double")(require(pairs, a, b)[a], pairs[b]))


def in_order(docs: DataFrame, ranges: int, id_col: str, text_col: str) -> DataFrame:
    """(range, after, doc_id, h, text): rows in ranges of the order by id, then by a hash of the text; each range also gets the row that follows its last (``after``), the last one the first of all.

    Bounds come from a sample of some twenty ids per range, and only decide where ranges end. Null ids come first. Rows equal in id and text stay in one range.
    """
    key = F.struct(F.col(id_col).isNotNull().alias("has"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("h"))
    kind = "array<struct<has:boolean,id:bigint,h:bigint>>"
    n = docs.select(id_col).count()
    share = max(1, n // (20 * ranges))
    sample = sorted(tuple(r.k) for r in docs.select(key.alias("k")).where(F.pmod(F.xxhash64("k.id", "k.h"), F.lit(share)) == 0).distinct().collect())  # about 20 a range
    bounds = sample[:: max(1, math.ceil(len(sample) / ranges))]

    def literal(value: list, kind: str) -> Column:
        return F.from_json(F.lit(json.dumps(value)), kind)  # folded into one constant

    def named(k: tuple) -> dict:
        return dict(zip(("has", "id", "h"), k, strict=True))

    def upto(keys: Column, k: Column) -> Column:
        return F.size(F.filter(keys, lambda x: x <= k))

    # the range is the number of bounds up to the key: first by every sqrt(n)-th bound, then among those before the next
    step = max(1, math.isqrt(len(bounds)))
    blocks = [list(map(named, bounds[k : k + step])) for k in range(0, len(bounds), step)] or [[]]
    rows = docs.select(key.alias("k"), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    ranged = rows.withColumn("block", F.greatest(upto(literal([b[0] for b in blocks if b], kind), F.col("k")) - 1, F.lit(0)))
    inner = F.get(literal(blocks, f"array<{kind}>"), F.col("block"))
    ranged = ranged.withColumn("range", F.greatest(F.col("block") * step + upto(inner, F.col("k")) - 1, F.lit(0)))
    firsts = sorted((r["range"], tuple(r["k"])) for r in ranged.groupBy("range").agg(F.min("k").alias("k")).collect())  # a row per range
    # by range, its first row's key and the range before it, where that row goes besides
    starts: list[dict | None] = [None] * (len(bounds) + 1)
    for k, (r, first) in enumerate(firsts):
        starts[r] = named(first) | {"to": firsts[k - 1][0]}
    again = ranged.withColumn("start", F.get(literal(starts, "array<struct<has:boolean,id:bigint,h:bigint,to:int>>"), F.col("range")))
    is_first = (F.col("start.has") == F.col("k.has")) & (F.col("start.id") == F.col("k.id")) & (F.col("start.h") == F.col("k.h"))
    here = F.struct(F.col("range"), F.lit(False).alias("after"))
    there = F.struct(F.col("start.to").alias("range"), F.lit(True).alias("after"))
    return again.withColumn("place", F.explode(F.when(is_first, F.array(here, there)).otherwise(F.array(here)))).select("place.range", "place.after", "doc_id", "k", "text")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit_likeness(docs: DataFrame, rarity: Rarity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How like each document's fingerprint is to that of its edited text and to that of the next document, by ascending id (the last one's next is the first).

    The edited text has its last quarter of code points (rounded down) replaced by as many first ones of the next document, or by all it has. Rows of one id
    are ordered by a hash of their texts; null ids come first, null texts are empty, a lone row is its own next, no rows give no rows.
    Texts move once, into ranges that are read in order and hold two documents and a slice at a time.
    """
    require(docs, id_col, text_col)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pending = None, None  # the range, and the last row that has no next yet: id, text, digest
        for part in parts:
            for some in byte_slices(part, "text", 1 << 20):
                texts = some.column("text").to_pylist()
                found = digests([t.encode() for t in texts], rarity)
                pairs = []
                for where, after, doc, text, digest in zip(some.column("range").to_pylist(), some.column("after").to_pylist(), some.column("doc_id").to_pylist(), texts, found, strict=True):
                    if where != at:
                        at, pending = where, None
                    elif pending is not None:
                        cut = len(pending[1]) // 4
                        pairs.append((*pending, pending[1][: len(pending[1]) - cut] + text[:cut], digest))
                    elif after:  # equal to the row that closed the range
                        continue
                    pending = None if after else (doc, text, digest)
                edited = digests([p[3].encode() for p in pairs], rarity)
                out = [(doc, len(text), hashlib.sha256(new.encode()).hexdigest(), write(d), write(e), likeness(d, e), likeness(d, after)) for (doc, text, d, new, after), e in zip(pairs, edited, strict=True)]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)

    names = [c.split()[0] for c in RESULT.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in RESULT.split(", ")])
    ordered = in_order(docs, 4 * n, id_col, text_col).repartition(n, "range").sortWithinPartitions("range", "after", "k")
    return ordered.select("range", "after", "doc_id", "text").mapInArrow(run, RESULT)
