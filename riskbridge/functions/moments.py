"""Count, means and covariances of several columns."""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Moments:
    """Rows, means and sample covariances."""

    names: list[str]
    count: int
    means: np.ndarray
    covariance: np.ndarray

    def components(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k directions of largest variance as rows, their largest entry positive, and their shares of the variance."""
        values, vectors = np.linalg.eigh(self.covariance)
        top = vectors[:, ::-1][:, :k].T
        signs = np.sign(top[np.arange(k), np.abs(top).argmax(axis=1)])
        whole = self.covariance.trace()
        return top * signs[:, None], values[::-1][:k] / whole if whole > 0 else np.zeros(k)


def moments(df: DataFrame, cols: dict[str, Column]) -> Moments:
    """Moments of the named columns over all rows, which hold no nulls; fewer than two rows have no covariance (0).

    Two scans, the means first: products about them are plain sums, which Spark compiles to short methods, unlike `covar_samp` of every pair.
    """
    names = list(cols)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    rows = df.select(*[c.cast("double").alias(n) for n, c in cols.items()])
    first = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(n).alias(f"m_{n}") for n in names]).first()
    means = {n: first[f"m_{n}"] or 0.0 for n in names}
    about = rows.select(*[(F.col(n) - F.lit(m)).alias(n) for n, m in means.items()])
    sums = about.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"c_{a}_{b}") for a, b in pairs]).first()
    table = np.zeros((len(names), len(names)))
    for a, b in pairs:
        i, j = names.index(a), names.index(b)
        table[i, j] = table[j, i] = (sums[f"c_{a}_{b}"] or 0.0) / max(first["n"] - 1, 1)
    return Moments(names, first["n"], np.array(list(means.values())), table)
