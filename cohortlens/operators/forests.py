"""Random forests whose upper nodes are split from counts of all rows and whose lower parts are grown where their rows are brought together."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.many import _lists
from cohortlens.sources.shared import stored

#: Values of a feature are told apart by so many quantiles of the train rows.
BINS = 32
#: Drawn rows of a node that one task grows the rest of the tree from.
_TOGETHER = 1 << 15
#: The shares of Poisson(1) up to 0, 1, 2... times that a row is drawn.
_UPTO = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


def _drawn(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row, by a hash of row, tree and seed."""
    z = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((tree * 0xD1342543DE82EF95 + seed * 0x2545F4914F6CDD1D + 0x632BE59BD9B4E019) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53
    return np.searchsorted(_UPTO, u, side="right").astype(np.uint8)


def _some_features(rng: np.random.Generator, n: int, width: int) -> np.ndarray:
    """For each of ``n`` nodes the root of the number of features, without repeats."""
    few = max(1, math.ceil(math.sqrt(width)))
    return np.argpartition(rng.random((n, width)), few - 1, axis=1)[:, :few] if few < width else np.tile(np.arange(width), (n, 1))


def _splits(bins: np.ndarray, y: np.ndarray, w: np.ndarray, node: np.ndarray, feats: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, feature, last bin of the left side) of each node's best split by Gini impurity, the first of several; the gain is 0 where none is valid."""
    k, few, n = counts.shape[1], feats.shape[1], len(counts)
    where = np.arange(len(node))
    keys = [((((node * few + j) * BINS + bins[where, feats[node, j]]) * k + y) << 6) | w for j in range(few)]
    keys = np.sort(np.concatenate(keys))  # by node, feature, bin and class; the last bits say how often the row is drawn
    times, cell = keys & 63, (keys >> 6) // k
    label = (keys >> 6) - cell * k
    last = np.flatnonzero(np.append(cell[1:] != cell[:-1], True)) if len(cell) else np.zeros(0, np.int64)
    sums = np.stack([np.cumsum(np.where(label == c, times, 0))[last] for c in range(k)], axis=1).astype(float)
    cell = cell[last]
    pair, of = cell // BINS, cell // (BINS * few)
    begins = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
    before = np.concatenate([np.zeros((1, k)), sums])[begins]
    left = sums - np.repeat(before, np.diff(np.append(begins, len(pair))), axis=0)
    right = counts[of] - left
    a, b, total = left.sum(axis=1), right.sum(axis=1), counts.sum(axis=1)
    valid = (a >= max(least, 1)) & (b >= max(least, 1))
    worth = np.where(valid, (left**2).sum(axis=1) / np.maximum(a, 1) + (right**2).sum(axis=1) / np.maximum(b, 1), -1.0)
    gain, feature, at = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(of):
        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        best = np.maximum.reduceat(worth, starts)
        hits = np.flatnonzero(worth == np.repeat(best, np.diff(np.append(starts, len(of)))))
        nodes, first = np.unique(of[hits], return_index=True)
        pick = hits[first]
        t = np.maximum(total[nodes], 1e-300)
        g = np.where(worth[pick] < 0, 0.0, (worth[pick] - (counts[nodes] ** 2).sum(axis=1) / t) / t)
        gain[nodes], feature[nodes], at[nodes] = np.where(g > 1e-12, g, 0.0), feats[nodes, pair[pick] % few], cell[pick] % BINS
    return gain, feature, at


def _grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, others: np.ndarray, k: int, least: int, depth: int, depths: Sequence[int], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The part of a tree below a node at ``depth``, level by level: (for each of ``depths`` above ``depth`` and each of ``others`` the shares of the leaf that it comes to, the gains of splits times their rows by depth and feature)."""
    width, held = bins.shape[1], [i for i, d in enumerate(depths) if d > depth]
    said, worth = np.zeros((len(depths), len(others), k)), np.zeros((len(depths), width))
    rows, node, theirs, at = np.arange(len(y)), np.zeros(len(y), np.int64), np.arange(len(others)), np.zeros(len(others), np.int64)
    n = 1
    while held and n:
        counts = np.bincount(node * k + y[rows], w[rows], n * k).reshape(n, k)
        total = counts.sum(axis=1)
        shares = counts / np.maximum(total, 1e-300)[:, None]
        for i in [i for i in held if depths[i] == depth]:
            said[i, theirs] = shares[at]
        held = [i for i in held if depths[i] > depth]
        gain = np.zeros(n)
        mixed = (total >= 2 * least) & (counts.max(axis=1) < total)
        if held and mixed.any():
            number = np.cumsum(mixed) - 1
            mine = mixed[node]
            feats = _some_features(rng, int(mixed.sum()), width)
            found = _splits(bins[rows[mine]], y[rows[mine]].astype(np.int64), w[rows[mine]].astype(np.int64), number[node[mine]], feats, counts[mixed], least)
            gain[mixed] = found[0]
            feature, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
            feature[mixed], last[mixed] = found[1:]
        split = gain > 0
        ends = ~split[at]
        for i in held:
            said[i, theirs[ends]] = shares[at[ends]]
            if split.any():
                np.add.at(worth[i], feature[split], (gain * total)[split])
        if not split.any():
            break
        number = 2 * (np.cumsum(split) - 1)
        go, keep = split[node], ~ends
        rows, node, theirs, at = rows[go], node[go], theirs[keep], at[keep]
        node = number[node] + (bins[rows, feature[node]] > last[node])
        at = number[at] + (others[theirs, feature[at]] > last[at])
        n, depth = 2 * int(split.sum()), depth + 1
    return said, worth


class _Top:
    """The upper nodes of one tree: children follow each other, a node without has -1; ``open`` ones have more rows than one task grows from."""

    def __init__(self, k: int):
        self.feature, self.last, self.child, self.depth, self.counts, self.open = [-1], [0], [-1], [0], [np.zeros(k)], [0]

    def walk(self, bins: np.ndarray, upto: int = 99) -> np.ndarray:
        """The node that each row comes to, at most ``upto`` levels down."""
        feature, last, child = np.array(self.feature), np.array(self.last), np.array(self.child)
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(min(upto, max(self.depth))):
            at = np.where(child[at] < 0, at, child[at] + (bins[rows, feature[at].clip(0)] > last[at]))
        return at

    def split(self, node: int, feature: int, last: int, sides: Sequence[np.ndarray], least: int, deepest: int) -> None:
        self.feature[node], self.last[node], self.child[node] = feature, last, len(self.child)
        for counts in sides:
            if counts.sum() > _TOGETHER and counts.max() < counts.sum() and counts.sum() >= 2 * least and self.depth[node] + 1 < deepest:
                self.open.append(len(self.child))
            for held, x in ((self.feature, -1), (self.last, 0), (self.child, -1), (self.depth, self.depth[node] + 1), (self.counts, counts)):
                held.append(x)

    def shares(self) -> np.ndarray:
        return np.array([c / max(c.sum(), 1e-300) for c in self.counts])

    def ended(self, least: int) -> np.ndarray:
        """Whether a node without children ends the tree: it has been tried, or has one class or too few rows."""
        n, top = np.array([c.sum() for c in self.counts]), np.array([c.max() for c in self.counts])
        return (np.array(self.child) < 0) & (n > 0) & ((top == n) | (n < 2 * least) | (n > _TOGETHER))

    def gains(self, depths: Sequence[int], width: int) -> np.ndarray:
        """The gains of its splits times their rows, by depth and feature."""
        out, spread = np.zeros((len(depths), width)), lambda c: (c**2).sum() / max(c.sum(), 1e-300)
        for node, child in enumerate(self.child):
            if child >= 0:
                out[[i for i, d in enumerate(depths) if d > self.depth[node]], self.feature[node]] += spread(self.counts[child]) + spread(self.counts[child + 1]) - spread(self.counts[node])
        return out


def _binned(cuts: list[np.ndarray]):
    """Batches of rows as one record each: bins of the features, the class (-1: to be scored) and the key, each a run of bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _lists(batch.column("x"))[1].reshape(batch.num_rows, len(cuts))
                bins = np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], axis=1).astype(np.uint8)
                y, key = batch.column("y").to_numpy().astype(np.int32), batch.column("key").to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (bins, y, key)], ["x", "y", "key"])

    return pack


def _unpacked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            x, y, key = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("x", np.uint8), ("y", np.int32), ("key", np.int64)))
            yield x.reshape(-1, width), y, key


class Forest:
    """A random forest over (features, label_idx): rows drawn as often as Poisson(1) says, the root of the number of features tried at each node, Gini impurity, 32 bins a feature, at least ``least`` drawn rows on each side.

    Its trees are a function of the rows and the seed and aren't kept: rows to be scored go down with the train rows, and shallower forests are the same trees cut off. While a node has more
    than 32,768 drawn rows, tasks send its counts by bin and class; then its rows meet in one task. So neither the driver nor a task holds a tree or all rows.
    """

    def __init__(self, train: DataFrame, depth: int, least: int, trees: int, seed: int):
        self.train, self.depth, self.least, self.trees, self.seed = train, depth, least, trees, seed
        self.importance: dict[int, np.ndarray] = {}

    @property
    def getNumTrees(self) -> int:  # noqa: N802 - Spark ML's name
        return self.trees

    @property
    def numFeatures(self) -> int:  # noqa: N802 - Spark ML's name
        return len(self.featureImportances)

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 - Spark ML's name
        """Gains by feature, their sum 1 in each tree, averaged over the trees."""
        if self.depth not in self.importance:
            self.votes(self.train.limit(0), [self.depth])
        return Vectors.dense(self.importance[self.depth])

    def cut(self, depth: int) -> Forest:
        """The same trees down to ``depth``."""
        out = Forest(self.train, depth, self.least, self.trees, self.seed)
        out.importance = self.importance
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with rawPrediction, probability and prediction, the first of the likeliest; the trees are grown again."""
        out = self.votes(df, [self.depth]).withColumnRenamed(f"votes {self.depth}", "__v")
        total = F.aggregate("__v", F.lit(0.0), lambda x, y: x + y)
        p = F.transform("__v", lambda x: F.when(total > 0, x / total).otherwise(0.0))
        best = (F.array_position("__v", F.array_max("__v")) - 1).cast("double")
        return out.withColumns({"rawPrediction": array_to_vector("__v"), "probability": array_to_vector(p), "prediction": best}).drop("__v")

    def votes(self, df: DataFrame, depths: Sequence[int]) -> DataFrame:
        """``df`` with an array "votes d" for each of ``depths``: the sums over the trees of the shares of classes in its leaf."""
        depths = sorted(set(depths))
        keyed = stored(df.withColumn("__key", F.monotonically_increasing_id()), "forest-scored")
        whole = vector_to_array(F.col("features"))
        train = stored(self.train.where("label_idx is not null").select(whole.alias("x"), F.col("label_idx").cast("int").alias("y"), F.monotonically_increasing_id().alias("key")), "forest-train")
        width, k, n = (v or 0 for v in train.agg(F.max(F.size("x")), F.max("y") + 1, F.count("*")).first())
        if not n:
            raise ValueError("no rows to learn from")
        columns = train.select(*[F.get("x", F.lit(i)).alias(f"f{i}") for i in range(width)])
        cuts = [np.unique(q) for q in columns.approxQuantile(columns.columns, [i / BINS for i in range(1, BINS)], 0.001)]
        rows = train.unionByName(keyed.select(whole.alias("x"), F.lit(-1).alias("y"), F.col("__key").alias("key")))
        tasks = max(2, 2 * df.sparkSession.sparkContext.defaultParallelism)
        rows = rows.repartition(tasks).mapInArrow(_binned(cuts), "x binary, y binary, key binary").cache()
        try:
            tops = self._tops(rows, width, k, n, max(depths))
            names = [f"v{i}" for i in range(len(depths) * k)]
            sums = stored(self._grown(rows, tops, width, k, depths, tasks).groupBy("key").agg(*[F.sum(v).alias(v) for v in names]), "forest-votes")
        finally:
            rows.unpersist()
        gains = np.stack([t.gains(depths, width) for t in tops])
        for r in sums.where("key < 0").select("key", "v0").collect():  # a row per tree, depth and feature
            gains.reshape(-1)[-1 - r.key] += r.v0
        for d, each in zip(depths, gains.transpose(1, 0, 2), strict=True):
            each = each / np.maximum(each.sum(axis=1, keepdims=True), 1e-300)
            self.importance[d] = each.sum(axis=0) / max(each.sum(), 1e-300)
        sums = sums.where("key >= 0").withColumnRenamed("key", "__key")
        out = keyed.join(sums, "__key", "left")
        return out.withColumns({f"votes {d}": F.array(*[F.coalesce(v, F.lit(0.0)) for v in names[i * k : i * k + k]]) for i, d in enumerate(depths)}).drop("__key", *names)

    def _tops(self, rows: DataFrame, width: int, k: int, n: int, deepest: int) -> list[_Top]:
        """The upper part of every tree: a pass for each level."""
        trees, seed, least, few = self.trees, self.seed, self.least, max(1, math.ceil(math.sqrt(width)))
        tops = [_Top(k) for _ in range(trees)]
        if n <= 0.9 * _TOGETHER:
            return tops
        sc = rows.sparkSession.sparkContext
        feats = lambda tree, node: _some_features(np.random.default_rng([seed, tree, node]), 1, width)[0]
        while todo := [t for t in range(trees) if tops[t].open]:
            sent = sc.broadcast(tops)  # at most two nodes for each 32,768 rows and tree

            def count(batches: Iterator[pa.RecordBatch], todo: list = todo, sent=sent) -> Iterator[pa.RecordBatch]:
                sums: dict[int, np.ndarray] = {}
                for x, y, key in _unpacked(batches, width):
                    mine = y >= 0
                    x, y, key = x[mine], y[mine], key[mine]
                    for t in todo:
                        top, w = sent.value[t], _drawn(key, t, seed)
                        number = np.full(len(top.child), -1)
                        number[top.open] = np.arange(len(top.open))
                        node = number[top.walk(x)]
                        held = np.flatnonzero((node >= 0) & (w > 0))
                        node, size = node[held], len(top.open) * few * BINS * k
                        which = np.stack([feats(t, o) for o in top.open])
                        found = sums.setdefault(t, np.zeros(size))
                        for j in range(few):
                            found += np.bincount(((node * few + j) * BINS + x[held, which[node, j]]) * k + y[held], w[held], size)
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["tree", "sums"])

            def add(table: pa.Table) -> pa.Table:
                return pa.table({"tree": table.column("tree").slice(0, 1), "sums": pa.array([np.sum([np.frombuffer(b.as_buffer()) for b in table.column("sums")], axis=0).tobytes()], pa.binary())})

            for r in rows.mapInArrow(count, "tree int, sums binary").groupBy("tree").applyInArrow(add, "tree int, sums binary").toLocalIterator():  # a row per tree
                top = tops[r.tree]
                nodes, top.open = top.open, []
                left = np.frombuffer(r.sums).reshape(len(nodes), few, BINS, k).cumsum(axis=2)
                for node, upto in zip(nodes, left, strict=True):
                    counts = upto[0, -1]
                    top.counts[node] = counts
                    a, rest = upto.sum(axis=2), counts - upto
                    b = rest.sum(axis=2)
                    worth = np.where((a >= max(least, 1)) & (b >= max(least, 1)), (upto**2).sum(axis=2) / np.maximum(a, 1) + (rest**2).sum(axis=2) / np.maximum(b, 1), -1.0)
                    j, at = np.unravel_index(int(worth.argmax()), worth.shape)
                    if counts.sum() > _TOGETHER and worth[j, at] - (counts**2).sum() / counts.sum() > 1e-12 * counts.sum():
                        top.split(node, int(feats(r.tree, node)[j]), int(at), (upto[j, at], rest[j, at]), least, deepest)
            sent.destroy()
        return tops

    def _grown(self, rows: DataFrame, tops: list[_Top], width: int, k: int, depths: list[int], tasks: int) -> DataFrame:
        """(key, v0, v1...): parts of the votes by depth and class of each row to be scored; under a key below zero a tree's gains of a feature, see :meth:`_place`."""
        trees, seed, least = self.trees, self.seed, self.least
        sent = rows.sparkSession.sparkContext.broadcast(tops)
        names = [f"v{i}" for i in range(len(depths) * k)]

        def say(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """What the upper nodes say, added over the trees."""
            for x, y, key in _unpacked(batches, width):
                x, key = x[y < 0], key[y < 0]
                said = np.zeros((len(depths) * k, len(key)))
                for top in sent.value:
                    shares, ended, theirs = top.shares(), top.ended(least), top.walk(x)
                    for i, d in enumerate(depths):
                        known = np.flatnonzero(ended[theirs] | (np.array(top.depth)[theirs] >= d))
                        said[i * k : i * k + k, known] += shares[top.walk(x[known], d)].T
                yield pa.RecordBatch.from_arrays([pa.array(key), *map(pa.array, said)], ["key", *names])

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The rows of each node that ends the upper part of a tree but not the tree."""
            for x, y, key in _unpacked(batches, width):
                learn, other = np.flatnonzero(y >= 0), np.flatnonzero(y < 0)
                for t, top in enumerate(sent.value):
                    w = _drawn(key[learn], t, seed)
                    mine, w = learn[w > 0], w[w > 0]
                    at, theirs = top.walk(x[mine]), top.walk(x[other])
                    for node in np.flatnonzero((np.array(top.child) < 0) & ~top.ended(least)).tolist():
                        i, j = at == node, theirs == node
                        if i.any() or j.any():
                            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([node], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in (x[mine[i]], y[mine[i]], w[i], x[other[j]], key[other[j]])]], ["tree", "node", "x", "y", "w", "others", "keys"])

        def grow(table: pa.Table) -> pa.Table:
            t, node = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
            x, y, w, others, keys = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("x", np.uint8), ("y", np.int32), ("w", np.uint8), ("others", np.uint8), ("keys", np.int64)))
            said, worth = _grow(x.reshape(-1, width), y, w, others.reshape(-1, width), k, least, sent.value[t].depth[node], depths, np.random.default_rng([seed, t, node, 1]))
            said = said.transpose(0, 2, 1).reshape(len(names), -1)
            gains = np.zeros((len(names), worth.size))
            gains[0] = worth.ravel()
            return pa.table([pa.array(np.append(keys, _place(t, len(depths), width))), *[pa.array(np.append(*v)) for v in zip(said, gains, strict=True)]], ["key", *names])

        kinds = ", ".join(["key long", *[f"{v} double" for v in names]])
        dealt = rows.mapInArrow(deal, "tree int, node int, x binary, y binary, w binary, others binary, keys binary").repartition(tasks, "tree", "node")
        out = dealt.groupBy("tree", "node").applyInArrow(grow, kinds)
        return out.unionByName(rows.mapInArrow(say, kinds)) if any(t.child[0] >= 0 or t.ended(least)[0] for t in tops) else out


def _place(tree: int, depths: int, width: int) -> np.ndarray:
    """The keys of a tree's gains by depth and feature."""
    return -1 - (tree * depths * width + np.arange(depths * width, dtype=np.int64))
