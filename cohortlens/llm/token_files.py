"""Token ids in files: frequency ranks in a byte-aligned code with its control bytes apart."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import byte_slices, require, shared_dir, stored, text_or_empty
from cohortlens.llm.encoding import encode_dropping_space, tokenizer

BLOCKS = "shard int, block int, first_id_at long, n_ids long, doc_ids array<long>, doc_lens array<int>, control binary, data binary"
#: Byte lengths of the four numbers of a control byte, two bits each, lowest first.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def encode_numbers(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit numbers: two control bits for each length, then the low bytes."""
    n = np.ascontiguousarray(numbers, "<u4")
    size = 1 + (n > 0xFF).astype(np.uint8) + (n > 0xFFFF) + (n > 0xFFFFFF)
    code = np.zeros(-(-len(n) // 4) * 4, np.uint8)
    code[: len(n)] = size - 1
    control = code.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    data = n.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_numbers(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The first ``n`` numbers of a block; lengths come from one table lookup per control byte."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data, np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if len(more):
            out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_ids(docs: DataFrame, tokenizer_path: str, out: str | None = None, end_id: int = 1, block_ids: int = 1 << 17, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encodes every text, appends ``end_id``, and writes the ids in ascending order of id; returns the folder.

    ``vocab`` holds (rank, id): the ids by falling count over all documents, ties by id; it has at most
    as many rows as the vocabulary. ``blocks`` holds, per shard and block, the documents' ids and lengths, the number
    of ids before the block in its shard, and the ranks' control and data bytes. Shards are ranges of
    document ids. Null ids come first; rows that repeat an id stay together, in the order of their ids' bytes; a
    null or empty text is the end id alone. No rows give empty tables.
    """
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    out = out or f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    top = max(tokenizer(tokenizer_path).get_vocab_size(), end_id + 1)
    kind = "<u2" if top <= 1 << 16 else "<u4"
    item = np.dtype(kind).itemsize

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(top, np.int64)
        names, none = ["doc_id", "ids", "seen", "times"], [pa.nulls(1, k) for k in (pa.int64(), pa.binary())]
        for part in parts:
            for some in byte_slices(part, "text"):
                ids, past = encode_dropping_space(tokenizer_path, some.column("text"), kind, end_id)
                total += np.bincount(ids, minlength=top)
                held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(past * item), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), held, *[pa.nulls(len(some), pa.list_(pa.int64()))] * 2], names)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([*none, pa.array([seen]), pa.array([total[seen]])], names)  # the task's counts

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    written = stored(rows.mapInArrow(encode, "doc_id long, ids binary, seen array<long>, times array<long>"), "encoded")
    encoded = written.where("seen is null").select("doc_id", "ids")
    counts = written.select(F.explode(F.arrays_zip("seen", "times")).alias("c")).groupBy(F.col("c.seen").alias("id")).agg(F.sum("c.times").alias("n")).collect()  # at most the vocabulary
    ranked = [r.id for r in sorted(counts, key=lambda r: (-r.n, r.id))]
    spark.createDataFrame(list(enumerate(ranked)), "rank int, id int").coalesce(1).write.parquet(f"{out}/vocab")
    rank = np.zeros(top, np.uint32)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint32)

    def blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, before, ids, texts, held = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def row() -> pa.RecordBatch:
            numbers = np.frombuffer(b"".join(texts), kind)
            control, data = encode_numbers(rank[numbers])
            width = np.dtype(kind).itemsize
            values = [[shard], [block], [before], [len(numbers)], [ids], [[len(t) // width for t in texts]], [control], [data]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])

        for part in parts:
            for doc, x in zip(part.column("doc_id").to_pylist(), part.column("ids").to_pylist(), strict=True):
                ids.append(doc)
                texts.append(x)
                held += len(x)
                if held >= block_ids * np.dtype(kind).itemsize:
                    yield row()
                    block, before, ids, texts, held = block + 1, before + held // np.dtype(kind).itemsize, [], [], 0
        if ids:
            yield row()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = encoded.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    ordered.mapInArrow(blocks, BLOCKS).write.parquet(f"{out}/blocks")
    return out


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before the document), n_tokens and ids_crc32, decoded from the files of :func:`write_ids`."""
    vocab = spark.read.schema("rank int, id int").parquet(f"{path}/vocab").collect()  # at most the vocabulary
    id_of = np.zeros(max(1, len(vocab)), "<u4")
    for r in vocab:
        id_of[r.rank] = r.id
    files = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # one row per shard, that is per task that wrote
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shard_at"))

    def decode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in part.to_pylist():
                ids = id_of[decode_numbers(r["control"], r["data"], r["n_ids"])]
                lens = np.array(r["doc_lens"], np.int64)
                ends = np.cumsum(lens)
                crcs = [zlib.crc32(ids[e - k : e]) for e, k in zip(ends.tolist(), lens.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r["shard"]] * len(lens), pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(ends - lens + r["first_id_at"]), pa.array(lens), pa.array(crcs, pa.int64())], ["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    docs = files.mapInArrow(decode, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(shards), "shard").select("doc_id", (F.col("shard_at") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def decoded_texts(spark: SparkSession, path: str, tokenizer_path: str) -> DataFrame:
    """doc_id and text as the tokenizer renders the stored ids (lower case, white space as the tokenizer leaves it)."""
    vocab = {r.rank: r.id for r in spark.read.schema("rank int, id int").parquet(f"{path}/vocab").collect()}  # at most the vocabulary
    id_of = np.array([vocab[k] for k in range(len(vocab))] or [0], "<u4")

    def decode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in part.to_pylist():
                ids = id_of[decode_numbers(r["control"], r["data"], r["n_ids"])]
                docs = np.split(ids, np.cumsum(r["doc_lens"])[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array([tokenizer(tokenizer_path).decode(d[:-1].tolist()) for d in docs])], ["doc_id", "text"])

    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").mapInArrow(decode, "doc_id long, text string")
