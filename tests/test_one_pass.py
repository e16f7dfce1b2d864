"""Work per row that must not come back: passes of the forest, wide rows to Python, methods that the JVM does not compile."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskbridge import schema as S
from riskbridge.functions import moments as moments_module
from riskbridge.functions.columns import clean_numbers
from riskbridge.operators import bagging, features, forests
from riskbridge.plans import queries as plans


def _table(spark, n=3000):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"a": rng.integers(0, 6, n) / 4, "b": rng.integers(0, 9, n).astype(float), "id": np.arange(n)})
    pdf["y"] = pdf.a * 3 + (pdf.b > 4) * 2 + rng.normal(size=n)
    return spark.createDataFrame(pdf)


def _fit(df):
    return bagging.fit_forest(df, ["a", "b"], "y", trees=4, depth=3, features_per_node=1)


@pytest.mark.parametrize("hot_rows", [None, "20"])
def test_levels_go_over_cells_and_grow_the_same_trees(spark, monkeypatch, hot_rows):
    df, cells = _table(spark), []
    real = bagging._cell_sums
    monkeypatch.setattr(bagging, "_cell_sums", lambda *a: cells.append(real(*a)) or cells[-1])
    if hot_rows:
        spark.conf.set("riskbridge.hotRows", hot_rows)
    try:
        by_cell = _fit(df)
        few = cells[0].count()
    finally:
        spark.conf.unset("riskbridge.hotRows")
    assert cells[0] is not None and few < (3000 if hot_rows else 55)  # 6 * 9 cells, those of hot ones come in pieces
    monkeypatch.setattr(bagging, "CELLS", 5)
    in_chunks = _fit(df)
    monkeypatch.setattr(bagging, "LEAST", float("inf"))
    by_row = _fit(df)
    assert cells[-1] is None
    for other in (in_chunks, by_row):
        for name in ("feature", "cut", "value", "weight", "gain"):
            assert (getattr(by_cell, name) == getattr(other, name)).all(), name


def test_prediction_follows_the_nodes(spark):
    forest = _fit(_table(spark))
    x = np.random.default_rng(5).normal(size=(500, 2)) * 5
    x[0] = np.nan
    want = np.mean([forest.value[t][forest.nodes(x, t, 4)] for t in range(4)], axis=0)
    assert forest.predict(x) == pytest.approx(want)


def test_r2_lands_only_what_the_forest_reads(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(forests, "benchmark_premium", lambda r: seen.append(r.columns) or r.withColumn("BENCHMARK_PREMIUM", F.lit(0.0)))
    plans.queries()["r2"](spark, "/root/testdata/sf0.001").collect()
    assert seen == [[*features.ROW_KEYS, *features.BENCHMARK_FEATURES, "BLANPREAMT"]]


def test_a_draw_sends_only_hashes_to_python(spark, monkeypatch):
    drawn = []
    real = bagging.durable
    monkeypatch.setattr(bagging, "durable", lambda df: drawn.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    bagging.fit_forest(_table(spark), ["a", "b"], "y", trees=4, depth=2, rate=0.05)
    assert "MapInPandas" not in drawn[0]
    assert re.search(r"drawn\((_h|xxhash64\()", drawn[0])


def test_moments_are_plain_sums(spark, monkeypatch):
    monkeypatch.delattr(moments_module.F, "covar_samp")
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 3)) + [1e6, -5.0, 0.0]
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc"))).repartition(7)
    found = moments_module.moments(df, {c: F.col(c) for c in "abc"})
    assert found.count == 400 and found.means == pytest.approx(x.mean(axis=0))
    assert found.covariance == pytest.approx(np.cov(x.T), rel=1e-7, abs=1e-8)
    assert (moments_module.moments(df.limit(1), {"a": F.col("a")}).covariance == 0).all()


def test_number_rules_are_compiled(spark):
    cols = [c for c in S.LOCATION_COLUMNS if c in S.NUMBER_COLUMNS]
    texts = [" 12 ", "1d", "0x1p3", "1e3", ".5", "5.", "\x015", "-Inf", "nan", "1 2", None, "", "+7\t"]
    df = spark.createDataFrame([[t] * len(cols) for t in texts], ", ".join(f"{c} string" for c in cols)).repartition(2)
    out = clean_numbers(df)
    want = [12.0, 0.0, 0.0, 1000.0, 0.5, 5.0, 0.0, -np.inf, 0.0, 0.0, 0.0, 0.0, 7.0]
    for c in (cols[0], cols[-1]):
        assert sorted(r[c] for r in out.select(c).collect()) == sorted(want)
    assert out.columns == cols and sorted(r[cols[3]] for r in out.collect()) == sorted(want)
    debug = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$")
    sizes = re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(out._jdf.queryExecution().executedPlan()))
    assert all(int(n) < 8000 for n in sizes)  # above, HotSpot interprets a method
