"""SimHash fingerprints and near-duplicate groups by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import byte_slices, require, stored, text_or_empty

BITS = 64


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def covering_masks(radius: int, bits: int = BITS, seed: int = 42) -> list[int]:
    """2^(radius+1) - 1 bit masks; any ``radius`` positions are left out by at least one of them.

    Each position gets a vector of radius+1 bits, and the mask of a non-zero vector v holds the positions whose
    vector has odd parity with v. Fewer than radius+1 vectors never span the space, so some v has even
    parity with all of them. Position vectors are the non-zero ones in turn, in an order that ``seed`` fixes.
    """
    space = (1 << (radius + 1)) - 1
    order = np.random.RandomState(seed).permutation(bits)
    vector = np.zeros(bits, int)
    vector[order] = 1 + np.arange(bits) % space
    return [sum(1 << i for i in range(bits) if bin(int(vector[i]) & v).count("1") % 2) for v in range(1, space + 1)]


def simhash(texts: list[bytes], n: int = 3) -> np.ndarray:
    """64-bit fingerprints of UTF-8 texts: bit b is set when over half of the shingles' hashes have it.

    A-Z is lower-cased; words are runs without ASCII white space; shingles are runs of ``n`` words joined by
    one space, repeats counted (fewer words: all of them). No words give 0. The hash is XXH64 with seed 42.
    """
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    place = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for k, text in enumerate(texts):
        words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
        if not words:
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        first = np.concatenate(([0], ends[:-1]))
        last = ends - 1
        m = max(1, len(words) - n + 1)
        a, b = first[:m].tolist(), last[-m:].tolist()
        votes, done = np.zeros(64, np.int64), 0
        while done < m:
            some = slice(done, done + 50_000)
            h = np.fromiter((digest(line[i:j], 42) for i, j in zip(a[some], b[some], strict=True)), np.uint64, min(m, done + 50_000) - done)
            votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            done += 50_000
        out[k] = place[votes * 2 > m].sum()
    return out


def fingerprints(docs: DataFrame, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, same, fp): a hash of each row's text and its fingerprint as a signed long; a null text is empty."""

    def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for some in byte_slices(part, "text"):
                fps = simhash(some.column("text").cast(pa.binary()).to_pylist(), n)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("same"), pa.array(fps.view(np.int64))], ["doc_id", "same", "fp"])

    require(docs, id_col, text_col)
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("same"), text.alias("text")).mapInArrow(hashed, "doc_id long, same long, fp long")


def links(fps: DataFrame, radius: int = 2, most: int = 24, seed: int = 42) -> DataFrame:
    """(a, b) with a < b: links that connect distinct fingerprints (column ``fp``) within ``radius`` differing bits.

    Every such pair falls into one bucket of some covering mask. Buckets of up to ``most`` fingerprints are compared
    inside. Members of larger ones are looked up exactly by their balls instead (radius 2 only): two fingerprints are
    within 2 bits if and only if the balls of radius 1 round them meet, and a meeting point has at most 65
    members, all within 2 bits of each other; it links each to its least. So no bucket is expanded into its
    pairs, none is cut, and the components are those of all pairs within the radius.
    """
    if radius != 2:
        most = 1 << 30
    masks = covering_masks(radius, seed=seed)
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("masked")) for t, m in enumerate(masks)])).alias("k")).select("fp", "k.t", "k.masked")
    sizes = keyed.groupBy("t", "masked").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(keyed.join(sizes, ["t", "masked"]), "buckets")
    member = shared.where(F.col("n") <= most).groupBy("t", "masked").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= radius
    pairs = F.flatten(F.transform("fps", lambda x: F.transform(F.filter("fps", lambda y: (y > x) & near(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    compared = member.select(F.explode(pairs).alias("p")).select("p.a", "p.b")
    if radius != 2:
        return compared.distinct()
    balls = shared.where(F.col("n") > most).select("fp").distinct().select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(BITS)])).alias("point"))
    met = balls.groupBy("point").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    return compared.union(stars).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node that each node of ``edges`` (a, b) reaches.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until the edges stay as they are; each
    round is written to the shared folder. A node's neighbours are never gathered: an aggregation takes their least, and a join hands it on.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, small: bool) -> DataFrame:
        e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")) if small else both(e)
        low = e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        e = e.join(low, "a")
        kept = e.where("b != m" if small else "b > a")
        out = kept.select(F.col("b").alias("x"), F.col("m").alias("y"))
        if small:
            out = out.union(low.select(F.col("a").alias("x"), F.col("m").alias("y")))
        return out.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    edges = stored(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        edges = stored(star(star(edges, False), True), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        if now == state:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select("a", "a")).distinct()
        state = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _in_components(docs: DataFrame, n: int, radius: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """((doc_id, same, fp) of every row, ``same`` a hash of its text; (fp, root) of every fingerprint)."""
    rows = stored(fingerprints(docs, n, id_col, text_col), "fingerprints")
    nodes = rows.select("fp").distinct()
    roots = components(links(nodes, radius))
    return rows, stored(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "roots")


def near_duplicate_components(docs: DataFrame, n: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's fingerprint (16 hex digits) and component_id, the least id that links reach from it, its own included.

    Links join fingerprints within ``radius`` bits; texts without words have fingerprint 0 and are linked like
    others. Equal fingerprints are one node, so copies are never paired. Null ids never name a component unless all its
    rows lack one; repeated rows are each returned. No rows give no rows.
    """
    rows, roots = _in_components(docs, n, radius, id_col, text_col)
    named = rows.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = roots.join(names, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_component(docs: DataFrame, n: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate group of ``docs``, with all its columns: the one of least id, a row without id after all others.

    Rows of one id and different texts are different rows: each is judged by its own group. If several rows of a group share
    the least id, or all lack one, the one whose text has the least hash stays; of rows equal in id and text, one. Null texts are empty, and texts without
    words are one group. No rows give no rows.
    """
    rows, roots = _in_components(docs, n, radius, id_col, text_col)
    first = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same")).alias("first"))
    stays = first.join(roots, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.coalesce("first.doc_id", F.lit(0)).alias("__id"), F.col("first.none").alias("__none"), F.col("first.same").alias("__same"))
    keys = ["__id", "__none", "__same"]
    ident = F.col(id_col).cast("long")
    keyed = docs.withColumns({"__id": F.coalesce(ident, F.lit(0)), "__none": ident.isNull(), "__same": F.xxhash64(text_or_empty(text_col))})
    return keyed.dropDuplicates(keys).join(stays, keys, "left_semi").select(*docs.columns)
