"""Benchmark decontamination by spaced seeds: hashes over fixed masks that ignore some word positions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import byte_slices, require, stored, text_or_empty

#: Fixed masks: 1 is a word that must agree, 0 one that may differ.
MASKS = ("111111", "11010111", "1101001011", "1001101101")
#: Fixed masks for items of 5 to 11 words: whichever fifth of the words differs (as far as a passage may), one of them fits beside it.
SHORT_MASKS = ("1111", "110011")
_MARKS = re.compile(r"[^\w]+")
_KEEP = 200_000
#: The filter has 2^24 bits, or more for a large benchmark, up to 2^28 (32 MB); its three probes are read from these places of a seed's hash.
_FILTER_BITS = (24, 28)
_PROBES = (36, 18, 0)
#: Parts into which the items that hit one document may be split.
_SPLIT = 16
_word_hashes: dict[bytes, int] = {}


def _word_hash(raw: bytes) -> int:
    """Hash of a word without marks, lower-cased; 0 if nothing is left."""
    w = _MARKS.sub("", raw.decode("utf-8", "replace").lower())
    return (xxhash.xxh64_intdigest(w) | 1) if w else 0


def word_hashes(text: bytes) -> np.ndarray:
    """One hash per word that has a letter or digit; marks and case don't count."""
    words = text.split()
    if len(_word_hashes) > _KEEP:
        _word_hashes.clear()
    for w in set(words):
        if w not in _word_hashes:
            _word_hashes[w] = _word_hash(w)
    h = np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))
    return h[h != 0]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at every position where it fits; masks of one length and other gaps hash apart."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, xxhash.xxh64_intdigest(mask), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    return _mixed(h)


def best_overlap(a: np.ndarray, b: np.ndarray, share: float) -> tuple[int, int, int]:
    """(start, end, agreeing) of the run of places, of which at least ``share`` agree, that has most agreeing ones; it starts and ends with one."""
    same = a == b
    at = np.flatnonzero(same)
    best = (0, 0, 0)
    if not len(at):
        return best
    balance = np.concatenate(([0.0], np.cumsum(same - share)))
    low = np.minimum.accumulate(balance[at])  # the least balance at a start so far
    first = np.searchsorted(-low, -(balance[at + 1] + 1e-9))  # earliest start whose balance isn't above the end's
    for j in range(len(at)):
        i = int(first[j])
        if i <= j and j - i + 1 > best[2]:
            best = (int(at[i]), int(at[j]) + 1, j - i + 1)
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, share: float = 0.8, least: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Every row's doc_id, contaminated, n_passages, n_words (agreeing words of its passages) and item_ids (ascending).

    A passage is a run of words on one diagonal of a document and an item, of which at least ``share`` agree; it counts if the
    agreeing words are ``least`` or, for a shorter item, ``share`` of its words (five at least; all of an item of fewer than five
    words). Diagonals come from the seeds: those of the benchmark are joined with those of the documents
    that pass a filter made from the benchmark, and the words of a document with hits go along whole, to be
    compared. Null texts and items without words match nothing; repeated rows and items
    are each judged; a row without id is judged too; no rows give no rows.
    """
    require(docs, id_col, text_col)
    require(benchmark, item_col, text_col)
    spark = docs.sparkSession

    def item_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for item, text in zip(part.column("item").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                words = word_hashes(text)
                use = masks if len(words) >= 12 else SHORT_MASKS if len(words) >= 5 else ("1" * len(words),) if len(words) else ()
                found = [(s, p, m) for m in use for p, s in enumerate(seeds(words, m).view(np.int64).tolist())]
                some = [[x[k] for x in found] for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array([item], pa.int64()), pa.array([words.astype("<u8").tobytes()]), *[pa.array([x], pa.list_(k)) for x, k in zip(some, (pa.int64(), pa.int32(), pa.string()), strict=True)]], ["item", "item_words", "seeds", "places", "masks"])

    items = benchmark.select(F.col(item_col).cast("long").alias("item"), text_or_empty(text_col).alias("text"))
    items = stored(items.mapInArrow(item_rows, "item long, item_words binary, seeds array<long>, places array<int>, masks array<string>"), "items")
    used = sorted(r[0] for r in items.select(F.explode("masks")).distinct().collect())  # documents are hashed by the masks that items use
    keyed = items.select(F.xxhash64("item", "item_words").alias("item_key"), F.explode(F.arrays_zip("seeds", "places")).alias("s")).select("item_key", F.col("s.seeds").alias("seed"), F.col("s.places").alias("place")).distinct()
    bits = min(max(_FILTER_BITS[0], (32 * keyed.count()).bit_length()), _FILTER_BITS[1])
    probes = F.array(*[F.shiftrightunsigned("seed", k).bitwiseAND(F.lit((1 << bits) - 1)) for k in _PROBES])
    marked = keyed.select(F.explode(probes).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(bit & 63)))").alias("value")).toArrow()  # at most 2^22 rows
    passing = np.zeros(1 << (bits - 6), np.int64)
    passing[marked.column("word").to_numpy()] = marked.column("value").to_numpy()
    shared = spark.sparkContext.broadcast(passing.view(np.uint8))  # 2 to 32 MB

    def regions(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed, mask = shared.value, np.uint64((1 << bits) - 1)
        for part in (some for whole in parts for some in byte_slices(whole, "text")):
            out: list[tuple] = []
            for key, text in zip(part.column("key").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                words = word_hashes(text)
                ats, hashes = [], []
                for m in used:
                    h = seeds(words, m)
                    hit = np.arange(len(h))
                    for k in _PROBES:
                        bit = (h[hit] >> np.uint64(k)) & mask
                        hit = hit[(allowed[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                    ats.append(hit)
                    hashes.append(h[hit])
                at = np.concatenate(ats) if ats else ()
                if len(at):
                    out.append((key, words.astype("<u8").tobytes(), np.concatenate(hashes).view(np.int64), at))
            if out:
                cols = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "words", "seeds", "places"])

    text = text_or_empty(text_col)
    key = F.xxhash64(F.col(id_col), text).alias("key")
    found = stored(docs.select(key, text.alias("text")).mapInArrow(regions, "key long, words binary, seeds array<long>, places array<long>"), "regions")
    found = found.dropDuplicates(["key"])  # repeated rows
    hits = found.select("key", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select("key", F.col("s.seeds").alias("seed"), F.col("s.places").alias("at"))
    lines = hits.join(keyed, "seed").groupBy("key", "item_key").agg(F.collect_set(F.col("at") - F.col("place")).alias("diagonals"))
    words = items.select(F.xxhash64("item", "item_words").alias("item_key"), "item", "item_words").distinct()
    by_doc = lines.join(words, "item_key").groupBy("key", F.pmod("item_key", F.lit(_SPLIT)).alias("part")).agg(F.collect_list(F.struct("item", "item_words", "diagonals")).alias("items"))

    def verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[tuple[int, int, int, int, int]] = []
            for row in range(part.num_rows):
                key, raw, near = (part.column(n)[row].as_py() for n in ("key", "words", "items"))
                doc = np.frombuffer(raw, "<u8")
                for x in near:
                    item = np.frombuffer(x["item_words"], "<u8")
                    need = min(len(item), max(5, min(least, int(np.ceil(share * len(item) - 1e-9)))))
                    for d in x["diagonals"]:
                        a, b = max(0, d), min(len(doc), d + len(item))
                        i, j, n = best_overlap(doc[a:b], item[a - d : b - d], share)
                        if n >= need:
                            out.append((key, x["item"], a + i, a + j, n))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["key", "item", "from", "to", "n"])

    passages = by_doc.join(found.select("key", "words"), "key").mapInArrow(verify, "key long, item long, from long, to long, n long").distinct()
    by_doc = passages.groupBy("key").agg(F.count("*").alias("n_passages"), F.sum("n").alias("n_words"), F.array_sort(F.collect_set("item")).alias("item_ids"))
    rows = docs.select(F.col(id_col).alias("doc_id"), key)
    zero = F.lit(0).cast("long")
    return rows.join(by_doc, "key", "left").select("doc_id", F.col("n_passages").isNotNull().alias("contaminated"), F.coalesce("n_passages", zero).alias("n_passages"), F.coalesce("n_words", zero).alias("n_words"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), "key")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark."""
    bad = contaminated(docs, benchmark, id_col=id_col, text_col=text_col, **how).where("contaminated").select("key").distinct()
    return docs.withColumn("__key", F.xxhash64(F.col(id_col), text_or_empty(text_col))).join(bad.withColumnRenamed("key", "__key"), "__key", "left_anti").drop("__key")
