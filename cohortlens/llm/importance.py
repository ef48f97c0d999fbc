"""Importance resampling towards a target: hashed n-gram counts of both sides give each document a weight, and noise by id draws them."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import byte_slices, require, stored, text_or_empty

#: Which bytes are of a word: digits, small letters, and all of characters beyond ASCII.
_IN_WORD = np.array([chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" or b > 127 for b in range(256)])


def _crc_shifts(powers: int = 40) -> np.ndarray:
    """[k, byte, value]: what a CRC-32 with this value in this byte becomes when 2^k zero bytes follow. A CRC is linear, so the four bytes' results add up by XOR."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = (step >> np.uint32(1)) ^ np.where(step & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    value = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    tables = [step[value & 255] ^ (value >> np.uint32(8))]
    for _ in range(powers - 1):
        tables.append(_apply(tables[-1], tables[-1]))
    return np.stack(tables)


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> np.uint32(8) & 255] ^ table[2][crc >> np.uint32(16) & 255] ^ table[3][crc >> np.uint32(24)]


_SHIFTS = _crc_shifts()


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRC-32s of strings after ``n_bytes`` more bytes, but for what those bytes add: crc(a + b) = shifted(crc(a), len(b)) ^ crc(b)."""
    crc = crc.copy()
    for k in range(int(n_bytes.max(initial=0)).bit_length()):
        odd = np.flatnonzero(n_bytes >> k & 1)
        crc[odd] = _apply(_SHIFTS[k], crc[odd])
    return crc


class Words:
    """The words of some texts, in order: ``text`` and ``line`` say where each is; ``buckets(n)`` hashes runs of n of them."""

    def __init__(self, texts: pa.Array):
        """Of UTF-8 texts whose A-Z are lower-cased already."""
        joined = b"\n".join(texts.cast(pa.binary()).to_pylist()) + b"\n"
        raw = np.frombuffer(joined, np.uint8)
        inside = _IN_WORD[raw]
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
        start, self.size = edge[::2], edge[1::2] - edge[::2]
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        self.text = np.searchsorted(ends, start, "right")
        self.line = np.cumsum(raw == 10)[start]  # a text ends its line
        self.past = np.searchsorted(self.text, np.arange(len(texts) + 1))
        at = np.concatenate(([0], np.cumsum(self.size))).astype(np.int32)
        found = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(raw[inside])]).dictionary_encode()
        place, distinct = found.indices.to_numpy(), found.dictionary.to_pylist()
        self.alone = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct))[place]
        self.after_space = np.fromiter((zlib.crc32(b" " + w) for w in distinct), np.uint32, len(distinct))[place]

    def buckets(self, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(the first word's place, the bucket) of each run of 1 to ``n`` words of one text; runs of k words stand before those of k + 1."""
        first, crc, places, out = np.arange(len(self.alone)), self.alone, [], []
        for k in range(n):
            if k:
                whole = first + k < len(self.alone)
                first, crc = first[whole], crc[whole]
                same = self.text[first] == self.text[first + k]
                first, crc = first[same], crc[same]
                crc = shifted(crc, self.size[first + k] + 1) ^ self.after_space[first + k]
            places.append(first)
            out.append((crc % np.uint32(buckets)).astype(np.int64))
        return np.concatenate(places), np.concatenate(out)

    def last(self, n: int) -> np.ndarray:
        """The last word's place of each run of ``buckets``."""
        ends, first = [], np.arange(len(self.alone))
        for k in range(n):
            if k:
                first = first[first + k < len(self.alone)]
                first = first[self.text[first] == self.text[first + k]]
            ends.append(first + k)
        return np.concatenate(ends)


def bucket_counts(docs: DataFrame, n: int = 2, buckets: int = 10_000, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket.

    Features are runs of 1 to ``n`` neighbouring words joined by one space; a feature's bucket is its CRC-32 modulo ``buckets``. Words are runs of digits, letters a-z (A-Z are
    lower-cased) and characters beyond ASCII, so line feeds part them: texts are cut into lines, equal lines are brought together, and each distinct line's
    features are counted once and multiplied by its occurrences. Runs that cross lines are counted apart, in the texts. Null texts have none.
    """
    require(docs, text_col)

    def lines(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, across = ["line", "bucket", "n"], np.zeros(buckets, np.int64)
        for part in parts:
            for some in byte_slices(part, "text"):
                texts = pc.ascii_lower(some.column("text"))
                found = pc.value_counts(pc.split_pattern(texts, "\n").flatten())
                line = found.field("values")
                yield pa.RecordBatch.from_arrays([line, pa.array(np.full(len(line), -1, np.int32)), found.field("counts")], names)
                if n > 1:
                    words = Words(texts)
                    first, bucket = words.buckets(n, buckets)
                    across += np.bincount(bucket[words.line[first] != words.line[words.last(n)]], minlength=buckets)
        held = np.flatnonzero(across)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(held), pa.string()), pa.array(held.astype(np.int32)), pa.array(across[held])], names)

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in parts:
            bucket, times = part.column("bucket").to_numpy(), part.column("n").to_numpy()
            np.add.at(total, bucket[bucket >= 0], times[bucket >= 0])
            for some in byte_slices(part.filter(pa.array(bucket < 0)), "line"):
                words, each = Words(some.column("line")), some.column("n").to_numpy()
                first, at = words.buckets(n, buckets)
                np.add.at(total, at, each[words.text[first]])
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])

    parts = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(lines, "line string, bucket int, n long").groupBy("line", "bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in parts.mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row per bucket
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's floor(1000 ln of its smoothed share in the target over that in the source)."""
    b, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, n: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row: the floored mean of the gains of its features, 0 without any."""
    require(docs, id_col, text_col)

    def weigh(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for some in byte_slices(part, "text"):
                words = Words(pc.ascii_lower(some.column("text")))
                first, bucket = words.buckets(n, len(gain))
                text = words.text[first]
                n_features = np.bincount(text, minlength=len(some))
                total = np.zeros(len(some), np.int64)
                np.add.at(total, text, gain[bucket])
                weight = np.where(n_features > 0, total // np.maximum(n_features, 1), 0)  # towards minus infinity
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(np.diff(words.past)), pa.array(n_features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, n: int = 2, buckets: int = 10_000, seed: int = 7, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``; the drawn ones, ``percent`` of those with ``least_words`` words or more, have ranks from 1.

    The score is the weight and Gumbel noise from SHA-256 of `seed:doc_id`; the highest scores are drawn, ties by the smaller id, then by fewer features.
    A null id has the noise of the empty string and comes last in ties; rows equal in all columns have neighbouring ranks. Null texts are empty: weight 0, never drawn.
    No rows give no rows.

    Rows equal in all columns are counted first. The table of how many rows each score has (scores are whole numbers of some ten thousand values)
    gives each score's first rank; only the drawn rows are numbered, inside their score.
    """
    gain = gains(bucket_counts(docs, n, buckets, text_col), bucket_counts(target, n, buckets, text_col))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    rows = stored(weights(docs, gain, n, id_col, text_col).withColumn("score", F.col("weight") + noise), "weights")
    enough = F.col("n_words") >= least_words
    draw = rows.where(enough).count() * percent // 100
    before = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)  # a row per score
    first = rows.where(enough).groupBy("score").agg(F.count("*").alias("size")).select("score", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first")).where(F.col("first") < draw)
    kinds = ["doc_id", "n_words", "n_features", "weight", "score"]
    likely = rows.where(enough).groupBy(*kinds).agg(F.count("*").alias("copies")).join(first, "score")
    inside = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "n_words", "weight").rowsBetween(Window.unboundedPreceding, -1)
    placed = likely.withColumn("first", F.col("first") + F.coalesce(F.sum("copies").over(inside), F.lit(0))).withColumn("rank", F.explode(F.sequence(F.col("first") + 1, F.col("first") + F.col("copies"))))
    drawn = placed.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    rest = rows.where(~enough).withColumn("rank", F.lit(None).cast("long")).unionByName(rows.where(enough).join(first.select("score"), "score", "left_anti").withColumn("rank", F.lit(None).cast("long")))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank").unionByName(rest.select("doc_id", "n_features", "weight", "score", "rank"))


def drawn(docs: DataFrame, ranks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id has a rank in the result of :func:`resample`, with all their columns."""
    ids = ranks.where(F.col("rank").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(ids, F.col(id_col).cast("long") == F.col("__drawn"), "left_semi")
