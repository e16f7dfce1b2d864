"""K-means from several starts. All starts share each pass: one scan, one aggregate of at most starts * k groups.

Starts are seeded and settled on a bounded draw of rows; the passes over all rows follow until the centres rest. The start with the
lowest sum of squared distances wins.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskbridge.functions.collapse import repeats
from riskbridge.functions.durable import durable

Centres = list[list[float]]


@dataclass(frozen=True)
class Fit:
    """Centres of the best start, and each start's sum of squared distances."""

    names: list[str]
    centres: Centres
    inertia: list[float]

    def label(self, cols: dict[str, Column]) -> Column:
        """Number of the nearest centre, the lowest of equally near ones."""
        each = F.array(*distances(cols, self.centres))
        return (F.array_position(each, F.array_min(each)) - 1).cast("int")

    def ordered(self, order: list[int]) -> "Fit":
        return Fit(self.names, [self.centres[i] for i in order], self.inertia)


def distances(cols: dict[str, Column], centres: Centres) -> list[Column]:
    """Squared distance to each centre."""
    return [sum(((x - F.lit(v)) * (x - F.lit(v)) for x, v in zip(cols.values(), c, strict=True)), F.lit(0.0)) for c in centres]


def _seeds(points: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Rows drawn with chances by weight and squared distance from the rows drawn before."""
    chance, chosen = weight, []
    far = np.full(len(points), np.inf)
    for _ in range(k):
        if not chance.sum() > 0:
            chance = np.ones(len(points))
        chosen.append(points[rng.choice(len(points), p=chance / chance.sum())])
        far = np.minimum(far, ((points - chosen[-1]) ** 2).sum(axis=1))
        chance = weight * far
    return np.array(chosen)


def _settled(points: np.ndarray, weight: np.ndarray, centres: np.ndarray, passes: int = 100) -> np.ndarray:
    for _ in range(passes):
        label = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        mass = np.bincount(label, weight, len(centres))
        sums = np.stack([np.bincount(label, weight * x, len(centres)) for x in points.T], axis=1)
        new = np.where(mass[:, None] > 0, sums / np.where(mass > 0, mass, 1)[:, None], centres)
        if np.array_equal(new, centres):
            break
        centres = new
    return centres


def _partial(centres: dict[int, Centres], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Weights, distances and sums per start and nearest centre of a task's rows: one row for each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(next(iter(centres.values()))[0])
        mass, far, sums = np.zeros((len(centres), k)), np.zeros((len(centres), k)), np.zeros((width, len(centres), k))
        for batch in batches:
            *x, w = (c.to_numpy() for c in batch.columns)
            for i, c in enumerate(centres.values()):
                d = np.zeros((k, len(w)))
                for values, places in zip(x, np.array(c).T, strict=True):
                    d += (values - places[:, None]) ** 2
                label = d.argmin(axis=0)
                mass[i] += np.bincount(label, w, k)
                far[i] += np.bincount(label, w * d.min(axis=0), k)
                for j, values in enumerate(x):
                    sums[j, i] += np.bincount(label, w * values, k)
        start, label = np.repeat(list(centres), k), np.tile(np.arange(k), len(centres))
        arrays = [start.astype(np.int32), label.astype(np.int32), mass.ravel(), far.ravel(), *(v.ravel() for v in sums)]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in arrays], names=["start", "label", "mass", "far", *(f"s{j}" for j in range(width))])

    return run


def _pass(data: DataFrame, names: list[str], centres: dict[int, Centres]) -> dict[int, tuple[Centres, float]]:
    """The next centres of each start, and its sum of squared distances to the present ones."""
    sums = [f"s{j}" for j in range(len(names))]
    k = len(next(iter(centres.values())))
    found = (
        data.mapInArrow(_partial(centres, k), "start int, label int, " + ", ".join(f"{c} double" for c in ("mass", "far", *sums)))
        .groupBy("start", "label")
        .agg(*[F.sum(c).alias(c) for c in ("mass", "far", *sums)])
        .collect()  # one row per start and cluster
    )
    out = {s: ([list(c) for c in old], 0.0) for s, old in centres.items()}
    for r in sorted(found, key=lambda r: (r.start, r.label)):
        new, total = out[r.start]
        if r.mass > 0:  # an empty cluster keeps its centre; ten digits are above the noise of addition
            new[r.label] = [float(f"{r[c] / r.mass:.10g}") for c in sums]
        out[r.start] = (new, total + r.far)
    return out


def fit_kmeans(
    rows: DataFrame, cols: dict[str, Column], k: int, weight: Column | None = None, starts: int = 3, seed: int = 42, draw: int = 4096,
    passes: int = 40, tolerance: float = 1e-4,
) -> Fit:
    """Fit on all rows; `cols` are the inputs by name, without nulls.

    `draw` distinct points with the smallest hashes, so the same on every layout, seed and settle the `starts`. A start rests when its
    centres moved by less than `tolerance` of the inputs' mean spread, squared, or after `passes` passes; resting starts
    leave the passes, and a last one takes the sums of all. Equal points pass as one, with their weight, where that halves the rows at least.
    """
    names = list(cols)
    data = rows.select(*[c.cast("double").alias(n) for n, c in cols.items()], (F.lit(1.0) if weight is None else weight.cast("double")).alias("_w"))
    hashed = data.withColumn("_h", F.shiftrightunsigned(F.xxhash64(*names, F.lit(seed)), 1))
    distinct = hashed.agg(F.approx_count_distinct("_h", 0.02).alias("n")).first().n
    # a point that many rows share is drawn once, with the rows' weight; only twice the drawn points are grouped
    slice_ = hashed.filter(F.col("_h") <= F.lit((2**63 - 1) * 2 * draw // max(2 * draw, distinct)))
    points = slice_.groupBy("_h", *names).agg(F.sum("_w").alias("_w")).orderBy("_h", *names).limit(draw).collect()
    if not points:
        raise ValueError("no rows to cluster")
    x, w = np.array([[p[n] for n in names] for p in points]), np.array([p["_w"] for p in points])
    if repeats(data, names):
        data = durable(data.groupBy(*names).agg(F.sum("_w").alias("_w")))
    spread = float(np.average(x.var(axis=0)))
    moving = {s: _settled(x, w, _seeds(x, w, k, np.random.default_rng([seed, s]))).tolist() for s in range(starts)}
    resting: dict[int, Centres] = {}
    for _ in range(passes):
        for s, (new, _total) in _pass(data, names, moving).items():
            shift = float(((np.array(new) - np.array(moving[s])) ** 2).sum(axis=1).max())
            moving[s] = new
            if shift <= tolerance * spread:
                resting[s] = moving.pop(s)
        if not moving:
            break
    ends = resting | moving
    inertia = {s: total for s, (_, total) in _pass(data, names, ends).items()}
    best = min(inertia, key=lambda s: (inertia[s], s))
    return Fit(names, ends[best], [inertia[s] for s in sorted(inertia)])


def checks(labelled: DataFrame, label: str, cols: dict[str, Column], fit: Fit) -> DataFrame:
    """One row of facts: rows, clusters, rows that lie nearer another centre, and whether the labelled rows' squared distances sum
    up to the least sum of all starts."""
    ds = F.array(*distances(cols, fit.centres))
    own = F.element_at(ds, F.col(label) + 1)
    best = min(fit.inertia)
    return labelled.agg(
        F.count(F.lit(1)).alias("ROWS"),
        F.countDistinct(label).alias("CLUSTERS"),
        F.count_if(own > F.array_min(ds)).alias("NEARER_ANOTHER"),
        (F.abs(F.sum(own) - best) <= best * 1e-9 + 1e-9).alias("SUMS_AGREE"),
    )
