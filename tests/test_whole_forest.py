"""The shift between months is learned from all rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskbridge import schema as S
from riskbridge.functions.order import bin_edges
from riskbridge.operators import bagging, forests
from riskbridge.operators.features import RISK_FEATURES, ROW_KEYS


def test_shift_weighs_all_rows(spark, monkeypatch):
    """More rows than the 10,000 that a tree drew before: every tree has about the weight of all of them."""
    fits = []
    real = forests.fit_forest
    monkeypatch.setattr(forests, "fit_forest", lambda *a, **k: fits.append(real(*a, **k)) or fits[-1])
    n = 30_000
    keys = [F.col("id").cast("string").alias(c) for c in ROW_KEYS if c not in S.EXTRACT]
    values = [F.xxhash64("id", F.lit(i)).cast("double").alias(c) for i, c in enumerate(RISK_FEATURES)]
    rows = spark.range(n).select(F.when(F.col("id") % 2 == 0, S.PRIOR).otherwise(S.CURRENT).alias("PERIOD"), F.lit("s").alias("SEGMENT"), *keys, *values)
    forests.covariate_shift(rows, trees=3, depth=2)
    assert fits[0].weight[:, 0] == pytest.approx(n, rel=0.05)


def test_table_draws_are_the_draws(spark):
    h = np.random.default_rng(1).integers(-(2**62), 2**62, 50_000)
    for rate in (0.01, 0.5, 1.0, 3.0):
        got = bagging.poisson_draws(rate)(h, 7)
        assert (got == bagging.poisson(bagging.uniform(h, 7), rate)).all() and got.mean() == pytest.approx(rate, rel=0.1)


def test_cuts_are_the_best_among_the_features_looked_at(spark):
    """A node that looks at one feature of three cuts by that one, as well as a forest of that feature alone does."""
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.normal(size=(2_000, 3)), columns=list("abc"))
    pdf["y"] = (pdf.a > 0) * 1.0 + (pdf.b > 0.5) * 2.0 + pdf.c
    df = spark.createDataFrame(pdf)
    forest = bagging.fit_forest(df, list("abc"), "y", trees=6, depth=1, features_per_node=1)
    edges = bin_edges(df, list("abc"))
    assert len(set(forest.feature[:, 0])) > 1
    h = np.array([r[0] for r in df.select(F.xxhash64(*df.columns, F.lit(42))).collect()])
    for t in range(6):
        f, w = forest.feature[t, 0], bagging.poisson(bagging.uniform(h, 42 * 1_000_003 + t), 1.0)
        x, y, best = pdf.iloc[:, f].to_numpy(), pdf.y.to_numpy(), forest.cut[t, 0]

        def error(cut):
            return sum((w[s] * (y[s] - np.average(y[s], weights=w[s])) ** 2).sum() for s in (x <= cut, x > cut))

        assert forest.weight[t, 0] == w.sum() and all(error(best) <= error(c) + 1e-6 for c in edges[df.columns[f]])
