"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import WORD, require, text_or_empty

SIZES = (512, 1024, 2048, 4096)
SCHEMA = "doc_id long, has_id boolean, piece int, piece_start long, piece_len long, bin_id long, bin_pos int, bin_start long, bin_size int, bin_fill long, opened_size int"
_COPIES = 1000  # rows equal in id and length that stay together


def bin_cost(size: int, overhead: float = 64.0, quadratic: float = 2.0**-18) -> float:
    """Cost of running one sequence: its tokens, a fixed charge, and a share that grows with its square. A full bin is cheapest per token at 4096."""
    return size + overhead + quadratic * size * size


def attention_cost(size: int) -> float:
    """:func:`bin_cost` where attention counts for more: a full bin is cheapest per token at 1024, where the fixed charge and the square weigh alike."""
    return bin_cost(size, quadratic=2.0**-14)


def pack_lengths(lengths: Sequence[int], sizes: Sequence[int] = SIZES, price_of: Callable[[int], float] = bin_cost) -> tuple[list[int], list[int], list[int], list[int]]:
    """Best fit of ``lengths`` (longest first, none above the largest size) into bins: (bin of each; of each bin its final size, fill, and the size it opened at).

    An item goes to the open bin with the least room that holds it. With none, a bin opens at the size of least cost per token
    that it is expected to hold in the end: the item, and as much of the room beside it as the later items short enough for it come to;
    ties take the smaller. Other bins may get those items, so at the end each bin shrinks to the least permitted size that holds its contents.
    """
    sizes = sorted(sizes)
    cost = {c: price_of(c) for c in sizes}
    room: dict[int, list[int]] = {}
    open_rooms = 0  # bit r is set while a bin with room r exists
    bins, fill, opened = [], [], []
    rest = [0, *itertools.accumulate(reversed(lengths))]  # rest[k]: the k shortest items together
    ascending = lengths[::-1]
    for at, n in enumerate(lengths):
        fits = open_rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms &= ~(1 << r)
        else:
            later = len(lengths) - at - 1

            def price(c: int) -> tuple[float, int]:
                short = rest[min(later, bisect.bisect_right(ascending, c - n))]
                return cost[c] / max(1, n + min(c - n, short)), c

            r = min((c for c in sizes if c >= n), key=price)
            b = len(fill)
            fill.append(0)
            opened.append(r)
        fill[b] += n
        r -= n
        room.setdefault(r, []).append(b)
        open_rooms |= 1 << r
        bins.append(b)
    return bins, [next(c for c in sizes if c >= f) for f in fill], fill, opened


def pack(docs: DataFrame, length: str | Column | None = None, sizes: Sequence[int] = SIZES, group_rows: int = 50_000, id_col: str = "doc_id", price_of: Callable[[int], float] = attention_cost) -> DataFrame:
    """Each document's pieces with the bin that holds them; ``price_of`` a size is what one bin of it costs.

    ``length`` is the number of tokens of a row; by default the words of ``text`` plus one end mark. A
    document above the largest size is cut into pieces of that size and a rest; one of length 0 or less
    becomes a piece of length 0. Rows equal in id and length are counted first, and cut into lots of ``_COPIES`` at most; lots are dealt by a hash into groups of about
    ``group_rows`` rows, each packed by itself in one task of fixed memory, so the result depends on
    neither file layout nor cluster size, and no id (nor the rows without one) fills a group. A row is one piece: ``piece_start`` counts tokens in the
    document, ``bin_start`` in the bin; ``opened_size`` is the bin's size before it shrank. A null id is kept as null, a null text counts as empty, repeated rows
    are packed once each, no rows give no rows, other columns are ignored.
    """
    if length is None:
        require(docs, id_col, "text")
        length = F.regexp_count(text_or_empty("text"), F.lit(WORD)) + 1
    elif isinstance(length, str):
        require(docs, id_col, length)
        length = F.col(length)
    top, sizes = max(sizes), tuple(sizes)
    n_groups = max(1, math.ceil(docs.count() / group_rows))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc_id"), F.col(id_col).isNotNull().alias("has_id"), F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    lots = rows.groupBy("doc_id", "has_id", "n").agg(F.count("*").alias("copies")).withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / _COPIES))))
    rows = lots.select("doc_id", "has_id", "n", F.least(F.lit(_COPIES), F.col("copies") - _COPIES * F.col("lot")).cast("int").alias("copies"), F.pmod(F.xxhash64("doc_id", "n", "lot"), F.lit(n_groups)).cast("int").alias("g"))

    def one_group(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = zip(frame["doc_id"], frame["has_id"], frame["n"], frame["copies"], strict=True)
        items = [(-min(top, n - k * top), has, doc, k) for doc, has, n, copies in rows for k in range(max(1, math.ceil(n / top))) for _ in range(copies)]
        items.sort()
        bins, caps, fill, opened = pack_lengths([-x[0] for x in items], sizes, price_of)
        at, pos, out = [0] * len(fill), [0] * len(fill), []
        for (minus, has, doc, k), b in zip(items, bins, strict=True):
            out.append((doc, has, k, k * top, -minus, (int(key[0]) << 32) + b, pos[b], at[b], caps[b], fill[b], opened[b]))
            at[b] -= minus
            pos[b] += 1
        return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    packed = rows.groupBy("g").applyInPandas(one_group, SCHEMA)
    return packed.withColumn("doc_id", F.when(F.col("has_id"), F.col("doc_id"))).drop("has_id")
