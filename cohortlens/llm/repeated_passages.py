"""Removal of long passages that repeat across documents, by longest-previous-factor arrays.

A passage is found again through its anchors: the least hashed piece of ``PIECE`` bytes in each run of ``span``
bytes. Equal runs have equal anchors at equal places, so documents that share a run meet at an anchor's hash, and only the runs whose
anchor is shared are sorted. Suffix order, with the previous and next smaller document in it, then gives
for each run the longest factor that an earlier document has.

Texts and stretches of text that are equal byte for byte travel once, with the least and the greatest of their documents; both go into the
arrays, and what they say of the greatest holds for all but the least.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import byte_slices, require, shared_dir, stored, text_or_empty

PIECE = 20
_NO_ID = 2**63 - 1
_AT = np.uint64((1 << 24) - 1)
_KEY = np.dtype("V16")


# ---- anchors --------------------------------------------------------------------------------------------


def _piece_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``PIECE`` bytes from each position on."""
    a = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
    one = (raw.astype(np.uint64) + np.uint64(1)) * a[0]
    sums, width = {1: one}, 1
    while width < 16:
        x = sums[width]
        sums[2 * width] = x[:-width] * a[int(math.log2(width)) + 1] + x[width:]
        width *= 2
    n = len(raw) - PIECE + 1
    x = sums[16][:n] * a[1] + sums[4][16 : 16 + n]
    x = (x ^ (x >> np.uint64(31))) * a[0]
    return x ^ (x >> np.uint64(29))


def _anchors(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor of the texts raw[start:end], ascending: position, hash, position of the first run it is the least piece of, and how many such runs follow one another; raw has under 2^24 bytes."""
    n = len(raw) - span + 1
    long = ends - starts >= span
    if n <= 0 or not long.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = _piece_hashes(raw)
    least = (hashes & ~_AT) | np.arange(len(hashes), dtype=np.uint64)
    pieces, width = span - PIECE + 1, 1
    while 2 * width <= pieces:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < pieces:
        least = np.minimum(least[: len(least) - (pieces - width)], least[pieces - width :])
    inside = np.zeros(n + 1, np.int8)
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - span + 1, -1)
    runs = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8) > 0)
    at = (least[runs] & _AT).astype(np.int64)
    head = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    at = at[head]
    return at, hashes[at], runs[head], np.diff(np.append(head, len(runs)))


def anchors_of(texts: list[bytes], span: int) -> tuple[np.ndarray, ...]:
    """(text, position in it, hash, first run, number of runs) of every anchor; texts of any length, taken about 2 MB at a time."""
    most, out, some, held = 1 << 21, [], [], 0

    def take() -> None:
        raw = np.frombuffer(b"".join(t[a:b] for _, t, a, b in some), np.uint8)
        ends = np.cumsum([b - a for _, _, a, b in some])
        starts = ends - [b - a for _, _, a, b in some]
        at, h, first, runs = _anchors(raw, starts, ends, span)
        part = np.searchsorted(ends, at, "right")
        which, off = np.array([k for k, *_ in some]), np.array([a for _, _, a, _ in some])
        move = off[part] - starts[part]
        out.append((which[part], at + move, h, first + move, runs))

    for k, t in enumerate(texts):
        for a in range(0, max(1, len(t) - span + 1), most):
            b = min(len(t), a + most + span - 1)
            some.append((k, t, a, b))
            held += b - a
            if held >= most:
                take()
                some, held = [], 0
    if some:
        take()
    if not out:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 2
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


# ---- longest previous factors ---------------------------------------------------------------------------


def suffix_order(suffixes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of bytes, then by owner; and each one's common prefix with the one before."""
    width = suffixes.shape[1]
    keys = np.zeros((len(suffixes), -(-width // 8) * 8), np.uint8)
    keys[:, :width] = suffixes
    order = np.lexsort((owner, *keys.view(">u8").astype(np.uint64).T[::-1]))
    same = suffixes[order]
    same = same[1:] == same[:-1]
    return order, np.concatenate(([0], np.where(same.all(axis=1), width, same.argmin(axis=1))))


def _nearest_smaller(value: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """For each place, the common prefix with the nearest earlier place of smaller value, or 0 once it falls under ``least``; lcp[i] is shared by i-1 and i."""
    n = len(value)
    to, common = np.arange(n) - 1, lcp.copy()
    found = np.zeros(n, np.int64)
    todo = np.flatnonzero(common >= least)
    while len(todo):
        hit = value[to[todo]] < value[todo]
        found[todo[hit]] = common[todo[hit]]
        todo = todo[~hit]
        over = to[todo]  # nothing between it and its own next stop is smaller than it, so than us
        common[todo], to[todo] = np.minimum(common[todo], common[over]), to[over]
        todo = todo[(to[todo] >= 0) & (common[todo] >= least)]
    return found


def longest_previous_factor(windows: np.ndarray, counts: np.ndarray, owners: np.ndarray, width: int, most: int = 200_000) -> np.ndarray:
    """For the first ``counts`` places of each row of bytes, one row after the other: the longest prefix of the ``width`` bytes from there on, 0 if it isn't whole, that a row of a smaller owner has.

    Previous and next smaller owners in suffix order give the two candidates; the longer counts. Suffixes are sorted by their first eight bytes, and
    then about ``most`` at a time, never apart from those they share eight bytes with.
    """
    row = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    place = (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
    out = np.zeros(len(row), np.int16)
    if not len(row):
        return out
    flat = np.ascontiguousarray(windows).reshape(-1)
    views, eights = (np.lib.stride_tricks.sliding_window_view(flat, n) for n in (width, 8))
    at = lambda some: row[some].astype(np.int64) * windows.shape[1] + place[some]
    lead = np.concatenate([np.ascontiguousarray(eights[at(slice(k, k + most))]).view(">u8")[:, 0].astype(np.uint64) for k in range(0, len(row), most)])
    order = np.argsort(lead, kind="stable")
    edges = np.append(np.flatnonzero(np.diff(lead[order])) + 1, len(order))  # where a part may end
    done = 0
    while done < len(order):
        end = int(edges[min(len(edges) - 1, np.searchsorted(edges, done + most))])
        some = order[done:end]
        owner = owners[row[some]]
        inner, lcp = suffix_order(views[at(some)], owner)
        ranked = owner[inner]
        before = _nearest_smaller(ranked, lcp, width)
        after = _nearest_smaller(ranked[::-1], np.concatenate(([0], lcp[1:][::-1])), width)[::-1]
        out[some[inner]] = np.maximum(before, after)
        done = end
    return out


# ---- the job --------------------------------------------------------------------------------------------


def _keys(column: pa.Array) -> np.ndarray:
    """The 16-byte values of a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), _KEY)


def _binary(keys: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(np.arange(0, 16 * len(keys) + 1, 16, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(keys).tobytes())])


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where a new group starts in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _blobs(bucket: int, *columns: np.ndarray) -> list[pa.Array]:
    return [pa.array([bucket], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in columns]]


def _code(h: np.ndarray, buckets: int) -> np.ndarray:
    """A hash's bucket and its low 32 bits: all that is sent of it."""
    return ((h >> np.uint64(33)).astype(np.int64) % buckets << 32) | (h & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _shared_anchors(texts: DataFrame, span: int, buckets: int, hot: int) -> DataFrame:
    """(key, pos) of anchors whose hash is found with two ids, pos being position, place of the anchor in its first run, and runs less 1; (code, null key) for hashes found in over ``hot`` texts."""
    names = ["b", "keys", "ids", "runs", "hashes", "at", "places", "weights"]
    schema = "b int, " + ", ".join(f"{n} binary" for n in names[1:])

    def packed(b: np.ndarray, keys: np.ndarray, which: np.ndarray, ids: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of one bucket each; a text's key and id are sent once in a row."""
        order = np.lexsort((which, b))
        for some in np.split(order, np.flatnonzero(np.diff(b[order])) + 1):
            if len(some):
                head = _heads(which[some])
                runs = np.diff(np.append(head, len(some))).astype("<u4")
                yield pa.RecordBatch.from_arrays(_blobs(int(b[some[0]]), keys[which[some[head]]], ids[some[head]], runs, *[c[some] for c in columns]), names)

    def local(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (some for whole in parts for some in byte_slices(whole, "text")):
            which, at, h, first, runs = anchors_of(part.column("text").cast(pa.binary()).to_pylist(), span)
            if not len(h):
                continue
            keys, low, top = _keys(part.column("key")), part.column("first_id").to_numpy()[which], part.column("last_id").to_numpy()[which]
            places, at = ((at - first) << 8 | (runs - 1)).astype("<u2"), at.astype("<u4")
            order = np.lexsort((low, h))
            head = _heads(h[order])
            size = np.diff(np.append(head, len(order)))
            known = low[order][head] < np.maximum.reduceat(top[order], head)  # another id has the piece
            weight = np.ones(len(order), "<u4")
            weight[head] = np.where(known, np.maximum(size, 2), 1)
            many = np.repeat(known, size)
            keep = ~many
            keep[head] = True  # of a piece with several ids, one goes on for all
            sent = order[keep]
            code = _code(h[sent], buckets)
            yield from packed(code >> 32, keys, which[sent], low[sent], (code & 0xFFFFFFFF).astype("<u4"), at[sent], places[sent], weight[keep])
            done = order[many]
            yield from packed(which[done] % buckets, keys, which[done], low[done], np.zeros(len(done), "<u4"), at[done], places[done], np.zeros(len(done), "<u4"))

    def joined(key: tuple, table: pa.Table) -> pa.Table:
        new: dict[str, list] = {n: [] for n in ("keys", "ids", "hashes", "at", "places", "weights")}
        kinds = {"keys": _KEY, "ids": "<i8", "hashes": "<u4", "at": "<u4", "places": "<u2", "weights": "<u4"}
        for row in table.to_pylist():
            runs = np.frombuffer(row["runs"], "<u4")
            for n, v in new.items():
                x = np.frombuffer(row[n], kinds[n])
                v.append(np.repeat(x, runs) if n in ("keys", "ids") else x)
        keys, ids, h, at, places, weight = (np.concatenate(v) for v in new.values())
        order = np.lexsort((h, weight == 0))
        order, done = order[: np.count_nonzero(weight)], order[np.count_nonzero(weight) :]
        flagged, often = [done], np.zeros(0, np.int64)
        if len(order):
            head = _heads(h[order])
            ranked, heavy = ids[order], weight[order].astype(np.int64)
            shared = (np.minimum.reduceat(ranked, head) < np.maximum.reduceat(ranked, head)) | (np.maximum.reduceat(heavy, head) > 1)
            flagged.append(order[np.repeat(shared, np.diff(np.append(head, len(order))))])
            often = h[order][head][np.add.reduceat(heavy, head) > hot].astype(np.int64) | int(key[0].as_py()) << 32
        some = np.concatenate(flagged)
        pos = at[some].astype(np.int64) << 16 | places[some]
        return pa.table({"key": pa.concat_arrays([_binary(keys[some]), pa.nulls(len(often), pa.binary())]), "pos": np.concatenate((pos, often))})

    return texts.mapInArrow(local, schema).groupBy("b").applyInArrow(joined, "key binary, pos long")


def _fold(windows: np.ndarray, counts: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, where groups start in it) that brings equal windows together, least ids first."""
    words = windows.view("<u8")
    odd = (np.arange(1, words.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    h = ((words ^ (words >> np.uint64(32))) * odd).sum(axis=1, dtype=np.uint64) + counts.astype(np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.lexsort((low, h))
    new = np.ones(len(order), bool)
    new[1:] = (words[order[1:]] != words[order[:-1]]).any(axis=1) | (counts[order[1:]] != counts[order[:-1]])
    return order, np.flatnonzero(new)


def _spans(texts: DataFrame, flagged: DataFrame, span: int, buckets: int, often: np.ndarray) -> DataFrame:
    """(key, later, from, to): byte ranges that a smaller id has too, of a text's first row, and of its later rows (equal text, greater id)."""
    wide = -(-(2 * span - PIECE) // 8) * 8
    names = ["b", "windows", "counts", "low", "top", "times", "keys", "at", "kinds"]
    schema = "b int, " + ", ".join(f"{n} binary" for n in names[1:])

    def pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (some for whole in parts for some in byte_slices(whole, "text", 4 << 20)):
            lists = part.column("at")
            pos = lists.flatten().to_numpy()
            text = np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()))
            column = part.column("text").cast(pa.binary())
            bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(part) + 1].astype(np.int64)
            raw = np.frombuffer(bytes(memoryview(column.buffers()[2])[bounds[0] : bounds[-1]]) + bytes(wide), np.uint8)
            anchor, counts = bounds[text] - bounds[0] + (pos >> 16), (pos & 255) + 1
            start = anchor - (pos >> 8 & 255)
            h = np.concatenate([_piece_hashes(np.lib.stride_tricks.sliding_window_view(raw, PIECE)[anchor[k : k + 100_000]].reshape(-1))[::PIECE] for k in range(0, len(anchor), 100_000)])
            bucket = _code(h, buckets) >> 32
            if len(often):  # too many different surroundings for one task: each run by itself
                alone = np.isin(_code(h, buckets), often)
                each = np.where(alone, counts, 1)
                step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                text, start, bucket = (np.repeat(x, each) for x in (text, start, bucket))
                start, alone, counts = start + step, np.repeat(alone, each), np.repeat(np.where(alone, 1, counts), each)
            else:
                alone = np.zeros(len(start), bool)
            first, last, keys = part.column("first_id").to_numpy()[text], part.column("last_id").to_numpy()[text], _keys(part.column("key"))
            for some in np.split(np.arange(len(start)), range(200_000, len(start), 200_000)):
                windows = np.lib.stride_tricks.sliding_window_view(raw, wide)[start[some]]
                windows = np.where(np.arange(wide) < (counts[some] + span - 1)[:, None], windows, np.uint8(0))
                order, head = _fold(windows, counts[some], first[some])
                times = np.diff(np.append(head, len(order)))
                member = some[order]
                low, top = first[member][head], np.maximum.reduceat(last[member], head)
                group = np.repeat(np.arange(len(head)), times)
                kind = (first[member] > low[group]).astype(np.uint8)  # 0: of the least id, 1: of a greater one
                copied = np.flatnonzero(last[member] > first[member])  # and 3: of the text's later rows
                group, member, kind = np.concatenate((group, group[copied])), np.concatenate((member, member[copied])), np.concatenate((kind, np.full(len(copied), 3, np.uint8)))
                content = windows[order[head]]
                to = bucket[some[order[head]]]
                by_content = alone[some[order[head]]]
                if by_content.any():
                    to[by_content] = _code(_mixed(content[by_content]), buckets) >> 32
                by = np.lexsort((group, to[group]))
                at_group = np.argsort(to, kind="stable")
                size = np.bincount(group, minlength=len(head)).astype("<u4")
                cut = _heads(to[at_group])
                ends = np.append(cut, len(at_group))
                taken = np.concatenate(([0], np.cumsum(size[at_group], dtype=np.int64)))
                at = (start[member] - (bounds[text[member]] - bounds[0])).astype("<u4")
                for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    g, m = at_group[i:j], by[taken[i] : taken[j]]
                    yield pa.RecordBatch.from_arrays(_blobs(int(to[g[0]]), content[g], counts[some[order[head[g]]]].astype(np.uint8), low[g], top[g], size[g], keys[text[member[m]]], at[m], kind[m]), names)

    def factors(key: tuple, table: pa.Table) -> pa.Table:
        kinds = ("u1", "u1", "<i8", "<i8", "<u4", _KEY, "<u4", "u1")
        windows, counts, low, top, times, keys, at, kind = (np.concatenate([np.frombuffer(x, k) for x in table.column(n).to_pylist()]) for n, k in zip(names[1:], kinds, strict=True))
        windows, counts = windows.reshape(-1, wide), counts.astype(np.int64)
        order, head = _fold(windows, counts, low)
        least, most = low[order][head], np.maximum.reduceat(top[order], head)
        folded = np.empty(len(order), np.int64)
        folded[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(order))))
        content, runs = windows[order[head]], counts[order[head]]
        two = np.flatnonzero(most > least)
        again = np.full(len(head), -1)
        again[two] = len(head) + np.arange(len(two))
        rows, owners = np.concatenate((np.arange(len(head)), two)), np.concatenate((least, most[two]))
        hits = longest_previous_factor(content[rows], runs[rows], owners, span) >= span
        row = np.repeat(np.arange(len(rows)), runs[rows])[hits]
        place = (np.arange(len(hits)) - np.repeat(np.cumsum(runs[rows]) - runs[rows], runs[rows]))[hits]
        low_at, high_at = np.full(len(rows), wide), np.full(len(rows), -1)  # runs of a window are fewer than span apart, so hits join up
        np.minimum.at(low_at, row, place)
        np.maximum.at(high_at, row, place)
        window = np.repeat(np.arange(len(order)), times)
        first = (kind == 0) & (low[window] == least[folded[window]])
        entry = np.where(first, folded[window], again[folded[window]])
        found = np.flatnonzero(high_at[entry] >= 0)
        later, entry = kind[found] == 3, entry[found]
        a, b = at[found] + low_at[entry], at[found] + high_at[entry] + span
        halves = keys[found].copy().view("<u8").reshape(-1, 2)
        by = np.lexsort((a, later, halves[:, 1], halves[:, 0]))
        keys, later, a, b = keys[found][by], later[by], a[by], b[by]
        group = np.zeros(len(by), np.int64)
        if len(by):
            group[_heads(halves[by][:, 0], halves[by][:, 1], later)[1:]] = 1
        group = np.cumsum(group)
        reach = np.maximum.accumulate(b + (group << 40)) - (group << 40)
        new = np.ones(len(by), bool)
        new[1:] = (group[1:] != group[:-1]) | (a[1:] > reach[:-1])
        heads = np.flatnonzero(new)
        ends = reach[np.append(heads[1:] - 1, len(by) - 1)] if len(by) else reach
        return pa.table({"key": _binary(keys[heads]), "later": later[heads], "from": a[heads], "to": ends})

    at = flagged.groupBy("key").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    cut = texts.join(at, "key").select("key", "first_id", "last_id", "text", "at").mapInArrow(pieces, schema)
    return cut.groupBy("b").applyInArrow(factors, "key binary, later boolean, from long, to long")


def _mixed(windows: np.ndarray) -> np.ndarray:
    """A hash of each row of bytes."""
    words = np.ascontiguousarray(windows).view("<u8")
    h = np.full(len(words), 0x165667B19E3779F9, np.uint64)
    for k in range(words.shape[1]):
        h = (h ^ words[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _removed(raw: bytes, spans: list[tuple[int, int]]) -> tuple:
    """(text left, bytes removed, spans, SHA-256 of the bytes left)."""
    kept, at, gone = [], 0, _merged(spans)
    for a, b in gone:
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    left = b"".join(kept)
    return left.decode("utf-8", "ignore"), len(raw) - len(left), len(gone), hashlib.sha256(left).hexdigest()


def remove_repeats(docs: DataFrame, span: int = 50, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 4 << 20, most_hot: int = 2_000_000, hot: int = 100_000) -> DataFrame:
    """The rows of ``docs`` with their text after removal, and n_bytes, n_removed, n_spans, kept_sha256.

    Removed is each byte of the UTF-8 text covered by a string of ``span`` bytes that also starts in a row of smaller id;
    strings are judged on the input. Rows of one id, and rows without id, never remove each other's bytes; a row
    without id comes after all others. A null text is empty. What is left of a character cut by a removal is dropped from
    the text but counted in ``kept_sha256``, which is over the remaining bytes. A column of the input with the name of an
    added one is replaced. No rows give no rows.

    Equal texts are taken once, by 128 bits of their SHA-256, and stored bucketed by it in the shared folder, so that cutting needs no shuffle of texts. An
    anchor in very many texts reaches a task once per batch of texts; if it is in over ``hot`` texts (or over the share
    that keeps their list under ``most_hot`` entries), its runs are dealt one by one by their content, and sorted all the same.
    """
    require(docs, id_col, text_col)
    if not PIECE <= span <= PIECE + 200:
        raise ValueError(f"span must be from {PIECE} to {PIECE + 200} bytes")
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    added = {"n_bytes", "n_removed", "n_spans", "kept_sha256"}
    rest = [c for c in docs.columns if c != text_col and c not in added]
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    key = F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))

    name = f"repeats_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = docs.select(key.alias("key"), ident.alias("id"), text.alias("text")).groupBy("key").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.first("text").alias("text"))
    distinct.write.bucketBy(parts, "key").sortBy("key").option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    texts = spark.table(name)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, math.ceil(total / bucket_bytes))
    hot = max(hot, total // 16 // most_hot)
    flagged = stored(_shared_anchors(texts, span, buckets, hot), "anchors")
    often = np.array([r.pos for r in flagged.where("key is null").select("pos").collect()], np.int64)  # at most most_hot
    spans = _spans(texts, flagged.where("key is not null"), span, buckets, often)
    by_text = spans.groupBy("key").agg(F.collect_list(F.struct("later", "from", "to")).alias("spans"))

    def apply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "first_id", "n_bytes", *[f"{x}{k}" for k in (1, 2) for x in ("text", "removed", "spans", "sha")]]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        for part in (some for whole in parts for some in byte_slices(whole, "text")):
            out = []
            for first, last, raw, found in zip(*(part.column(n).to_pylist() for n in ("first_id", "last_id")), part.column("text").cast(pa.binary()).to_pylist(), part.column("spans").to_pylist(), strict=True):
                both = [_removed(raw, [(s["from"], s["to"]) for s in found or () if s["later"] == later]) if not later or last > first else (None,) * 4 for later in (False, True)]
                out.append((len(raw), *both[0], *both[1]))
            cols = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("first_id"), *[pa.array(c, k) for c, k in zip(cols, (pa.int64(), *kinds, *kinds), strict=True)]], names)

    done = texts.join(by_text, "key", "left").select("key", "first_id", "last_id", "text", "spans").mapInArrow(apply, "key binary, first_id long, n_bytes long, " + ", ".join(f"text{k} string, removed{k} long, spans{k} long, sha{k} string" for k in (1, 2)))
    done = done.select(*[F.col(c).alias(f"__{c}") for c in done.columns])
    rows = docs.select(*[F.col(c) for c in rest], key.alias("__key"), ident.alias("__id")).join(done, "__key")
    of = lambda name: F.when(F.col("__id") == F.col("__first_id"), F.col(f"__{name}1")).otherwise(F.col(f"__{name}2"))
    return rows.select(*rest, of("text").alias(text_col), F.col("__n_bytes").alias("n_bytes"), of("removed").alias("n_removed"), of("spans").alias("n_spans"), of("sha").alias("kept_sha256"))
