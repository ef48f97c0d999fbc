"""Sharding by a hierarchical weighted hash tree (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cohortlens.llm.common import require, text_or_empty

Tree = Mapping[str, Mapping[str, Mapping[int, float]]]


def even_tree(n_shards: int, per_rack: int = 4, racks: int = 2) -> Tree:
    """``n_shards`` shards of weight 1, filling racks and regions in order; a shard beyond the full regions opens a region."""
    tree: dict[str, dict[str, dict[int, float]]] = {}
    for s in range(n_shards):
        region, rack = f"g{s // (per_rack * racks)}", f"r{s // per_rack}"
        tree.setdefault(region, {}).setdefault(rack, {})[s] = 1.0
    return tree


def _draw(key: Column, children: Mapping[str, float]) -> Column:
    """The child with the least exponential draw -ln(u)/weight; a change of one weight moves rows to or from that child only."""
    draws = []
    for name, weight in sorted(children.items()):
        # 52 bits of the hash, moved off 0 and 1
        u = (F.shiftrightunsigned(F.xxhash64(F.concat(F.lit(f"{name}|"), key)), 12) + F.lit(0.5)) / F.lit(2.0**52)
        draws.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("d"), F.lit(name).alias("name")))
    return (F.array_min(F.array(*draws)) if len(draws) > 1 else draws[0])["name"]


def _weight(node: float | Mapping) -> float:
    return float(node) if not isinstance(node, Mapping) else sum(_weight(x) for x in node.values())


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a key: one weighted draw among regions, one among the region's racks, one among the rack's shards.

    A subtree's weight is the sum of its shards' weights. When weights change, only rows that enter or
    leave the changed subtrees move.
    """
    live = {g: {r: {s: w for s, w in ss.items() if w > 0} for r, ss in rs.items() if _weight(ss) > 0} for g, rs in tree.items() if _weight(rs) > 0}
    if not live:
        raise ValueError("the tree has no shard of positive weight")
    region = _draw(key, {g: _weight(rs) for g, rs in live.items()})

    def pick(chosen: Column, branches: dict[str, Column]) -> Column:
        *first, last = sorted(branches)
        out = branches[last]
        for name in reversed(first):
            out = F.when(chosen == name, branches[name]).otherwise(out)
        return out

    def shards(g: str) -> Column:
        racks = live[g]
        rack = _draw(key, {f"{g}/{r}": _weight(ss) for r, ss in racks.items()})
        return pick(rack, {f"{g}/{r}": _draw(key, {f"{g}/{r}/{s}": w for s, w in ss.items()}) for r, ss in racks.items()})

    path = pick(region, {g: shards(g) for g in live})
    return F.element_at(F.split(path, "/"), -1).cast("int")


def assign_shards(docs: DataFrame, tree: Tree, grown: Tree | None = None, id_col: str = "doc_id", text_col: str = "text", buckets: int = 4096) -> DataFrame:
    """Every row with its shard, a gapless slot in it, and the shard under a grown tree.

    Returns id, size (UTF-8 bytes plus 8), text_crc32, law, shard, slot, grown_shard. The id alone decides the
    shard, so rows that repeat an id, and all rows without an id, share one; a null text counts as
    empty. Slots follow (bucket of the id, id, checksum, size); equal rows get neighbouring slots in
    any order. Other columns are ignored. No rows give no rows.

    Slots are numbered inside ``buckets`` hash buckets per shard and moved by the sizes of the earlier
    buckets, so that no task holds a whole shard; the table of bucket sizes has at most
    shards x ``buckets`` rows.
    """
    require(docs, id_col, text_col)
    text = text_or_empty(text_col)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))

    def placed(rows: DataFrame, *more: Column) -> DataFrame:
        return rows.select(F.col(id_col).alias("doc_id"), *more, shard_of(key, tree).alias("shard"), F.pmod(F.xxhash64(F.concat(F.lit("slot|"), key)), F.lit(buckets)).cast("int").alias("bucket"), (shard_of(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"))

    rows = placed(docs, (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    sizes = placed(docs).groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_slot"))
    inside = Window.partitionBy("shard", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    numbered = rows.withColumn("at", F.row_number().over(inside) - 1)
    # at most shards x buckets rows of 16 bytes
    return numbered.join(F.broadcast(starts), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first_slot") + F.col("at")).cast("long").alias("slot"), "grown_shard")
