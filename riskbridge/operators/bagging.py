"""Random forests grown level by level on all rows.

Every tree weighs every row by a Poisson draw from a hash of row and tree, so neither partitions nor machines shape the trees. A level
is one Spark job: each task drops its rows down all trees at once and adds up weight and target per node, feature and
bin; the sums meet in Spark, where the best cut of each node is chosen. Only cuts, a few per node, reach the driver. The target is
rounded to 2^-20 of its spread, so its sums are whole numbers that addition in any order gives alike.

Rows whose inputs share all bins (a cell) go the same way in every tree. Where cells hold several rows, each tree's weight and target are
added up per cell in one pass over the rows, and the levels go over cells, whose number has a bound whatever the rows.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskbridge.functions.durable import durable
from riskbridge.functions.order import bin_edges
from riskbridge.functions.skew import hot_keys

BINS = 32
BIN_BITS = 5
LEAST = 1.5  # rows per cell from which cells are worth adding up
CELLS = 1 << 15  # that a task holds before it sends their sums on, 26 MB of 50 trees
TASKS = 1024  # a task's sums are a few MB whatever its rows, so more tasks only send more of them
STEP = 2.0**-20


def mixed(rows: np.ndarray, salt: int) -> np.ndarray:
    """64 bits that look random, from 64-bit hashes of rows and a salt."""
    with np.errstate(over="ignore"):
        z = rows.view(np.uint64) ^ (np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15))
        some = np.empty_like(z)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z ^= np.right_shift(z, np.uint64(shift), out=some)
            z *= np.uint64(factor)
        z ^= np.right_shift(z, np.uint64(31), out=some)
    return z


def uniform(rows: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) that look random, from 64-bit hashes of rows and a salt."""
    return (mixed(rows, salt) >> np.uint64(11)).astype(float) * 2.0**-53


def _poisson_limits(rate: float) -> np.ndarray:
    """A uniform number draws as many as there are limits at or below it."""
    return np.cumsum(np.exp(-rate) * np.cumprod(np.concatenate([[1.0], rate / np.arange(1, 40)])))


def poisson(u: np.ndarray, rate: float) -> np.ndarray:
    """Poisson draws by inversion of uniform numbers."""
    out, most = np.zeros(len(u)), u.max(initial=0.0)
    for upto in _poisson_limits(rate):
        if upto > most:  # few terms do, as draws are small
            break
        out += u >= upto
    return out


def poisson_draws(rate: float) -> Callable[[np.ndarray, int], np.ndarray]:
    """`poisson(uniform(rows, salt), rate)` by a table of the first twelve bits; the few numbers that share them with a limit are compared."""
    low = np.arange(4096) / 4096
    table, last = poisson(low, rate), poisson(np.nextafter(low + 1 / 4096, 0), rate)
    limits, open_ = _poisson_limits(rate), table != last

    def draws(rows: np.ndarray, salt: int) -> np.ndarray:
        z = mixed(rows, salt)
        first = (z >> np.uint64(52)).view(np.int64)
        out = table.take(first)
        at = np.flatnonzero(open_.take(first))
        if len(at):
            out[at] = np.searchsorted(limits, (z[at] >> np.uint64(11)).astype(float) * 2.0**-53, "right")
        return out

    return draws


@dataclass(frozen=True)
class Forest:
    """Trees as heaps: node i has the children 2i + 1 and 2i + 2; feature -1 is a leaf. `value` is in units of the target."""

    inputs: tuple[str, ...]
    feature: np.ndarray  # (trees, nodes)
    cut: np.ndarray
    value: np.ndarray
    weight: np.ndarray
    gain: np.ndarray

    def nodes(self, x: np.ndarray, tree: int, depth: int) -> np.ndarray:
        """The node that each row reaches in `depth` steps, or its leaf."""
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        feature, cut = self.feature[tree], self.cut[tree]
        for _ in range(depth):
            f = feature[at]
            at = np.where(f < 0, at, 2 * at + np.where(x[rows, np.maximum(f, 0)] <= cut[at], 1, 2))
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        """One tree after the other; below a leaf its value is repeated, so that every row takes the same number of steps."""
        n, depth = len(x), int(np.log2(self.feature.shape[1] + 1)) - 1
        columns, row = np.ascontiguousarray(x.T).reshape(-1), np.arange(n)
        total = np.zeros(n)
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            value = value.copy()
            for i in np.flatnonzero(feature[: 2**depth - 1] < 0):  # parents come first
                value[2 * i + 1 : 2 * i + 3] = value[i]
            start, at = np.maximum(feature, 0) * n, np.zeros(n, np.intp)
            for _ in range(depth):
                right = ~(columns.take(start.take(at) + row) <= cut.take(at))
                at = 2 * at + 1 + right
            total += value.take(at)
        return total / len(self.feature)

    def importances(self) -> np.ndarray:
        """Share of the gain by feature, averaged over trees; they add up to 1 if any tree has a cut."""
        each = np.stack([np.where(self.feature == f, self.gain, 0.0).sum(axis=1) for f in range(len(self.inputs))], axis=1)
        whole = each.sum(axis=1, keepdims=True)
        shares = (each / np.where(whole > 0, whole, 1.0)).mean(axis=0)
        return shares / (shares.sum() or 1.0)

    def predicted(self) -> Column:
        """The forest's mean for the input columns of a row."""

        @F.pandas_udf("double")
        def predict(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for series in batches:
                yield pd.Series(self.predict(np.column_stack([s.to_numpy(float) for s in series])))

        return predict(*self.inputs)


def best_cuts(sums: np.ndarray, allowed: np.ndarray) -> tuple:
    """(feature, bin, gain, weight, target, weight left, target left) of the best cut of one node.

    sums: (features, bins, 2) of weight and target. The gain is the fall of the squared error; no cut gives feature -1.
    """
    whole = sums[0].sum(axis=0)
    left = sums.cumsum(axis=1)[:, :-1]
    right = whole - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[..., 1] ** 2 / left[..., 0] + right[..., 1] ** 2 / right[..., 0] - whole[1] ** 2 / whole[0]
    gain = np.where((left[..., 0] > 0) & (right[..., 0] > 0) & allowed[:, None], gain, -1.0)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape) if gain.size else (-1, 0)
    if not gain.size or gain[f, b] <= 1e-9 * max(whole[0], 1.0):
        return -1, 0, 0.0, *whole, 0.0, 0.0
    return int(f), int(b), float(gain[f, b]), *whole, *left[f, b]


def _tree_weights(h: np.ndarray, y: np.ndarray, weights: Callable[[np.ndarray, int], np.ndarray], trees: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Weight and weighted target of rows in each tree."""
    for t in range(trees):
        w = weights(h, t)
        yield w, w * y


def _cell_sums(
    data: DataFrame, inputs: list[str], cuts: list[np.ndarray], target: str, each: Callable[[np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]], trees: int
) -> DataFrame | None:
    """Weight `_w` and weighted target `_wy` of each tree (from `each`), added up over the rows of a cell; None if cells hold about one row.

    Inputs become the upper edges of their bins, which pass all cuts as the rows do. Rows are dealt by cell, those of hot cells over
    several tasks; a cell may come several times.
    """
    if len(inputs) * BIN_BITS > 60:
        return None
    edges = [np.append(c, np.inf) for c in cuts]

    @F.pandas_udf("long")
    def cell(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for series in batches:
            out = np.zeros(len(series[0]), np.int64)
            for s, c in zip(series, cuts, strict=True):
                out = (out << BIN_BITS) | np.searchsorted(c, s.to_numpy(float), "left")
            yield pd.Series(out)

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots: dict[int, int] = {}
        sums = np.zeros((0, 2 * trees))

        def taken() -> pd.DataFrame:
            cells, found = np.fromiter(slots, np.int64, len(slots)), sums[: len(slots)]
            out = {c: e[(cells >> (BIN_BITS * i)) & (BINS - 1)] for i, (c, e) in enumerate(zip(inputs[::-1], edges[::-1], strict=True))}
            return pd.DataFrame({**{c: out[c] for c in inputs}, "_w": list(found[:, :trees]), "_wy": list(found[:, trees:])})

        for pdf in batches:
            cells, at = np.unique(pdf["_cell"].to_numpy(), return_inverse=True)
            mine = [slots.setdefault(c, len(slots)) for c in cells.tolist()]
            if len(slots) > len(sums):
                sums = np.concatenate([sums, np.zeros((max(len(slots), 2 * len(sums)) - len(sums), 2 * trees))])
            part = np.empty((2 * trees, len(cells)))
            for t, (w, wy) in enumerate(each(pdf["_h"].to_numpy(), pdf[target].to_numpy(float))):
                part[t], part[trees + t] = np.bincount(at, w, len(cells)), np.bincount(at, wy, len(cells))
            sums[mine] += part.T
            if len(slots) > CELLS:
                yield taken()
                slots, sums = {}, np.zeros((0, 2 * trees))
        if slots:
            yield taken()

    rows = durable(data.select(cell(*inputs).alias("_cell"), F.col(target).cast("double").alias(target), "_h"))
    counts = durable(rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("_rows")))
    found = counts.agg(F.count(F.lit(1)).alias("cells"), F.sum("_rows").alias("rows")).first()
    if found.rows is None or found.rows < LEAST * found.cells:
        return None
    hot = hot_keys(rows, ["_cell"], counts=counts)
    piece = F.lit(0)
    if hot is not None:
        rows, piece = rows.join(hot, "_cell", "left"), F.coalesce(F.pmod(F.xxhash64("_h"), F.col("_parts")), F.lit(0))
    dealt = rows.withColumn("_piece", piece).repartition("_cell", "_piece").select("_cell", target, "_h")
    schema = ", ".join(f"`{c}` double" for c in inputs) + ", _w array<double>, _wy array<double>"
    return durable(dealt.mapInPandas(added, schema))


def fit_forest(
    rows: DataFrame, inputs: list[str], target: str, trees: int = 50, depth: int = 5, rate: float = 1.0, features_per_node: int | None = None, seed: int = 42
) -> Forest:
    """Grow trees on (inputs, target); each weighs rows by Poisson draws of mean `rate`. Nulls must have been filled."""
    edges = bin_edges(rows, inputs)
    cuts = [np.array(edges[c], float) for c in inputs]
    stats = rows.agg(F.avg(target).alias("m"), F.stddev_pop(target).alias("s")).first()
    # powers of two and whole steps, so that the last digits of mean and spread don't matter
    spread = 2.0 ** np.ceil(np.log2(stats.s)) if stats.s else 1.0
    middle = round((stats.m or 0.0) / spread * 1024) / 1024 * spread
    data = rows.select(*inputs, target, F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns], F.lit(seed)).alias("_h"))

    def salt(tree: int) -> int:
        return seed * 1_000_003 + tree

    draws = poisson_draws(rate)

    def weights(h: np.ndarray, tree: int) -> np.ndarray:
        return draws(h, salt(tree))

    def units(y: np.ndarray) -> np.ndarray:
        return np.round((y - middle) / spread / STEP)

    @F.pandas_udf("boolean")
    def drawn(h: pd.Series) -> pd.Series:
        return pd.Series(np.any([uniform(h.to_numpy(), salt(t)) >= np.exp(-rate) for t in range(trees)], axis=0))

    if rate * trees < 1:  # most rows are in no tree; only hashes go to Python
        data = durable(data.filter(drawn("_h")))
    summed_cells = _cell_sums(data, inputs, cuts, target, lambda h, y: _tree_weights(h, units(y), weights, trees), trees)
    by_cell = summed_cells is not None
    data = summed_cells if by_cell else data if rate * trees < 1 else durable(data)
    parts = data.rdd.getNumPartitions()
    data = data.coalesce(TASKS) if parts > TASKS else data
    n_nodes, n = 2 ** (depth + 1) - 1, len(inputs)
    forest = Forest(tuple(inputs), np.full((trees, n_nodes), -1), *[np.zeros((trees, n_nodes)) for _ in range(4)])
    live = np.zeros((trees, n_nodes), bool)
    live[:, 0] = True
    bin_of = np.zeros((trees, n_nodes), np.uint8)  # a cut by the bin it follows
    m = min(features_per_node or n, n)

    def looked_at(tree: int, node: int) -> np.ndarray:
        """The features that a node may be cut by."""
        order = np.argsort(uniform(np.arange(n, dtype=np.uint64) + np.uint64(node * n), seed * 7_919 + tree))
        return np.sort(order[:m])

    for level in range(depth):
        first, wide = 2**level - 1, 2**level
        seen = np.stack([np.stack([looked_at(t, first + i) for i in range(wide)]) for t in range(trees)])

        def work(batches: Iterator[pd.DataFrame], level=level, first=first, wide=wide, seen=seen) -> Iterator[pd.DataFrame]:
            sums = np.zeros((trees, wide, m, BINS, 2))
            for pdf in batches:
                if not len(pdf):
                    continue
                if by_cell:
                    each = zip(*(np.ascontiguousarray(np.stack(pdf[c]).T) for c in ("_w", "_wy")), strict=True)
                else:
                    each = _tree_weights(pdf["_h"].to_numpy(), units(pdf[target].to_numpy(float)), weights, trees)
                bins = np.concatenate([np.searchsorted(c, pdf[i].to_numpy(float), "left").astype(np.uint8) for i, c in zip(inputs, cuts, strict=True)])
                for t, (w, wy) in enumerate(each):
                    row = np.flatnonzero(w > 0)
                    start, at = np.maximum(forest.feature[t], 0) * len(pdf), np.zeros(len(row), np.intp)
                    for _ in range(level):  # below a leaf no node is live, so those rows may go on
                        at = 2 * at + 1 + (bins.take(start.take(at) + row) > bin_of[t].take(at))
                    alive = live[t].take(at)
                    if not alive.all():
                        row, at = row[alive], at[alive]
                    at, mine, mine_y, flat = at - first, w.take(row), wy.take(row), sums[t].reshape(-1, 2)
                    for k in range(m):
                        cell = (at * m + k) * BINS + bins.take((seen[t, :, k] * len(pdf)).take(at) + row)
                        flat[:, 0] += np.bincount(cell, mine, minlength=len(flat))
                        flat[:, 1] += np.bincount(cell, mine_y, minlength=len(flat))
            for t, i in zip(*np.nonzero(live[:, first : first + wide]), strict=True):
                if sums[t, i, :, :, 0].any():
                    yield pd.DataFrame({"tree": [int(t)], "node": [int(i) + first], "sums": [sums[t, i].reshape(-1).tolist()]})

        def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for t, i, s in zip(pdf["tree"].tolist(), pdf["node"].tolist(), pdf["sums"], strict=True):
                    f, *cut = best_cuts(np.asarray(s).reshape(m, BINS, 2), np.ones(m, bool))
                    out.append((t, i, int(looked_at(t, i)[f]) if f >= 0 else -1, *cut))
                yield pd.DataFrame(out, columns=["tree", "node", "feature", "bin", "gain", "w", "y", "wl", "yl"])

        summed = data.mapInPandas(work, "tree int, node int, sums array<double>").select("tree", "node", array_to_vector("sums").alias("sums"))
        total = summed.groupBy("tree", "node").agg(Summarizer.metrics("sum").summary(F.col("sums")).getField("sum").alias("sums"))
        found = total.select("tree", "node", vector_to_array("sums").alias("sums")).mapInPandas(choose, "tree int, node int, feature int, bin int, gain double, w double, y double, wl double, yl double")
        for r in found.collect():  # one row per node
            t, i = r.tree, r.node
            parts_of = [(i, r.w, r.y)]
            if r.feature >= 0:
                forest.feature[t, i], forest.cut[t, i], forest.gain[t, i], bin_of[t, i] = r.feature, cuts[r.feature][r.bin], r.gain, r.bin
                parts_of += [(2 * i + 1, r.wl, r.yl), (2 * i + 2, r.w - r.wl, r.y - r.yl)]
                live[t, 2 * i + 1 : 2 * i + 3] = True
            for node, w, y in parts_of:
                forest.weight[t, node], forest.value[t, node] = w, middle + y / w * STEP * spread
        if not live[:, 2 * first + 1 : 2 * (first + wide) + 1].any():
            break
    return forest
