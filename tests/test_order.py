import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskbridge.functions.order import LEVELS, order_bucket, quantiles, running_counts, running_totals, sample_n, widest_gap
from riskbridge.operators.stats import histogram, kernel_density, kolmogorov_p, ks_two_sample, path_share, psi

number = st.one_of(
    st.sampled_from([0.0, 1.0, 1.0 + 1e-9, -1.0, 2.0, 100.25]),
    st.floats(-1e9, 1e9, allow_nan=False).map(lambda x: x if abs(x) > 1e-300 else 0.0),
)
samples = st.lists(st.tuples(number, st.integers(1, 4)), min_size=1, max_size=25)
slow = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@slow
@given(groups=st.lists(samples, min_size=4, max_size=8))
def test_quantiles_are_exact(spark, groups):
    rows = [(g, x, w) for g, part in enumerate(groups) for x, w in part]
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.97, "e": 1.0}
    got = {r.g: r for r in quantiles(spark.createDataFrame(rows, "g int, x double, w long"), ["g"], "x", probs, "w").collect()}
    for g, part in enumerate(groups):
        flat = np.repeat([x for x, _ in part], [w for _, w in part])
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.percentile(flat, 100 * p), rel=1e-12, abs=1e-12)


@slow
@given(groups=st.lists(st.tuples(samples, samples), min_size=3, max_size=6))
def test_widest_gap(spark, groups):
    rows = [(g, x, w, 0) for g, (a, _) in enumerate(groups) for x, w in a]
    rows += [(g, x, 0, w) for g, (_, b) in enumerate(groups) for x, w in b]
    got = {r.g: r for r in widest_gap(spark.createDataFrame(rows, "g int, x double, l long, r long"), ["g"], "x", "l", "r").collect()}
    for g, (a, b) in enumerate(groups):
        fa, fb = (np.sort(np.repeat([x for x, _ in s], [w for _, w in s])) for s in (a, b))
        at = np.concatenate([fa, fb])
        gap = np.abs(np.searchsorted(fa, at, "right") / len(fa) - np.searchsorted(fb, at, "right") / len(fb)).max()
        assert got[g].gap == pytest.approx(gap) and (got[g].n_left, got[g].n_right) == (len(fa), len(fb))


@slow
@given(values=st.lists(number, min_size=2, max_size=60))
def test_buckets_and_running_counts_follow_the_order(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    b = [r.b for r in df.select("x", order_bucket(F.col("x")).alias("b")).orderBy("x").collect()]
    assert b == sorted(b)
    for r in running_counts(df, [], "x").collect():
        assert (r.n, r.upto, r.total) == (values.count(r.x), sum(v <= r.x for v in values), len(values))


def test_extreme_values_have_buckets(spark):
    xs = [-math.inf, -1.7e308, -5e-324, 0.0, 5e-324, 1e-5, 1.7e308, math.inf]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    b = [r[0] for r in df.orderBy("x").select(order_bucket(F.col("x"))).collect()]
    assert b == sorted(b)


@pytest.fixture
def narrow(spark):
    """Sort at most 16 values at once."""
    spark.conf.set("riskbridge.sortedValues", "16")
    yield
    spark.conf.unset("riskbridge.sortedValues")


def crowded(rng, n=1500):
    """Values of one bucket: clusters of different width inside it, neighbouring doubles, and many copies of one value."""
    near = 1.0 + rng.integers(0, 400, n) * 2.0**-30
    dense = 1.0 + 2.0**-14 + rng.integers(0, 300, n) * 2.0**-52
    return np.concatenate([near, dense, np.full(n, 1.0 + 2.0**-15), 1.0 + rng.random(n) * 2.0**-13])


@pytest.mark.parametrize("sign", [1, -1])
def test_one_crowded_bucket_is_an_index_of_its_own(spark, narrow, sign):
    rng = np.random.default_rng(4)
    left, right = sign * crowded(rng), sign * crowded(rng)
    wide = sign * 2.0 ** rng.uniform(-40, 40, 300)
    rows = [("all", float(x), 1, 0) for x in [*left, *wide]] + [("all", float(x), 0, 1) for x in right]
    df = spark.createDataFrame(rows, "g string, x double, l long, r long")
    assert df.filter("abs(x) between 1 and 1.001").select(order_bucket(F.col("x")).alias("b")).distinct().count() <= 2
    both = np.concatenate([left, wide, right])
    probs = {f"p{i}": i / 20 for i in range(21)}
    got = quantiles(df, ["g"], "x", probs).first()
    assert [got[n] for n in probs] == pytest.approx([np.percentile(both, 100 * p) for p in probs.values()], rel=1e-15)
    upto = {r.x: (r.n, r.upto, r.total) for r in running_counts(df, [], "x").collect()}
    ordered = np.sort(both)
    assert upto == {x: (int((both == x).sum()), int(np.searchsorted(ordered, x, "right")), len(both)) for x in set(both.tolist())}
    fa, fb = np.sort(np.concatenate([left, wide])), np.sort(right)
    gap = np.abs(np.searchsorted(fa, ordered, "right") / len(fa) - np.searchsorted(fb, ordered, "right") / len(fb)).max()
    assert widest_gap(df, ["g"], "x", "l", "r").first().gap == pytest.approx(gap, rel=1e-12)


def test_no_sort_exceeds_the_budget(spark, narrow):
    xs = sorted({float(x) for x in 1.0 + np.random.default_rng(5).integers(0, 1 << 20, 4000) * 2.0**-34})
    values = spark.createDataFrame([(x, 1) for x in xs], "_v double, _w long")
    got = running_totals(values, [], ["_w"]).orderBy("_v").collect()
    assert [r._w_upto for r in got] == list(range(1, len(xs) + 1))
    assert values.groupBy(order_bucket(F.col("_v"))).count().agg(F.max("count")).first()[0] > 500
    assert max(r._size for r in got) <= 16
    # the last level leaves no more than the doubles of one of its buckets
    b = order_bucket(F.col("x"), LEVELS - 1)
    edge = spark.createDataFrame([(x, x * (1 + 2.0**-35)) for x in (1.7, 1e-300, 3e9, 1e300)], "x double, y double")
    assert all(r.a < r.b for r in edge.select(b.alias("a"), order_bucket(F.col("y"), LEVELS - 1).alias("b")).collect())


def brute_psi(prior, curr, bins=10):
    edges = np.percentile(prior, np.linspace(0, 100, bins + 1))
    edges[0], edges[-1] = edges[0] - 1e-5, edges[-1] + 1e-5
    edges = np.unique(edges)
    shares = [np.clip(np.histogram(s, edges)[0] / len(s), 1e-4, 1) for s in (prior, curr)]
    return float(((shares[1] - shares[0]) * np.log(shares[1] / shares[0])).sum())


def test_psi_edges(spark):
    rng = np.random.default_rng(1)
    cases = {
        "constant": ([3.0] * 20, [3.0] * 20),
        "moved": ([3.0] * 20, [4.0] * 20),
        "outside": (list(rng.normal(0, 1, 20)), list(rng.normal(5, 1, 20))),
        "repeated": ([0.0] * 12 + [1.0] * 5 + [2.0, 3.0, 9.0], [0.0] * 5 + [1.0] * 10 + [2.0] * 5),
        "plain": (list(rng.normal(0, 1, 300)), list(rng.normal(0.3, 1.2, 200))),
        "same": (list(range(20)), list(range(20))),
        "no_curr": ([1.0, 2.0], []),
    }
    rows = [(k, float(x), 1, 0) for k, (p, _) in cases.items() for x in p]
    rows += [(k, float(x), 0, 1) for k, (_, c) in cases.items() for x in c]
    got = {r.FEATURE: r.PSI_SCORE for r in psi(spark.createDataFrame(rows, "FEATURE string, VALUE double, W_PRIOR int, W_CURR int")).collect()}
    assert got.pop("no_curr") == 0.0
    for k, v in got.items():
        assert v == pytest.approx(brute_psi(*map(np.array, cases[k])), abs=1e-9), k
    assert got["same"] == 0.0 and all(v >= 0 for v in got.values())


def test_p_values(spark):
    # classic points of the limit distribution, reached for large samples
    df = spark.createDataFrame([(1.3581,), (1.6276,), (0.5,), (0.0,)], "k double")
    n = F.lit(10**12)
    got = [r[0] for r in df.select(kolmogorov_p(F.col("k") / F.sqrt(n / 2), n, n)).collect()]
    assert got == pytest.approx([0.05, 0.01, 0.9639, 1.0], abs=2e-4)


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(5000).withColumn("x", F.col("id") % 10).repartition(7)
    a = sample_n(df, 137, ["id"])
    assert a.count() == 137 and sorted(a.collect()) == sorted(sample_n(df.repartition(3), 137, ["id"]).collect())
    assert sample_n(df, 10_000, ["id"]).count() == 5000
    assert sorted(a.collect()) != sorted(sample_n(df, 137, ["id"], seed=1).collect())
    copies = spark.range(300).select(F.lit(1).alias("id"))
    assert sample_n(copies, 7, ["id"]).count() == 7


def test_histogram_and_density(spark):
    xs = [0.0, 0.5, 1.0, 2.5, 3.0]
    df = spark.createDataFrame([("g", x, 1.0) for x in xs] + [("one", 2.0, 1.0)], "g string, x double, w double")
    got = {(r.g, r.BIN): r.ROWS for r in histogram(df, ["g"], "x", 3).collect()}
    assert got == {("g", 0): 2, ("g", 1): 1, ("g", 2): 2, ("one", 1): 1}
    curve = kernel_density(df, ["g"], "x", "w", grid=400, cut=6).orderBy("X").collect()
    assert {r.g for r in curve} == {"g"}
    step = curve[1].X - curve[0].X
    assert sum(r.DENSITY for r in curve) * step == pytest.approx(1, abs=1e-3)
    h = np.std(xs, ddof=1) * len(xs) ** -0.2
    mid = curve[200]
    exact = np.mean([math.exp(-0.5 * ((mid.X - x) / h) ** 2) for x in xs]) / (h * math.sqrt(2 * math.pi))
    assert mid.DENSITY == pytest.approx(exact, rel=1e-3)


@pytest.mark.parametrize("outlier", [None, 5000.0])
def test_density_is_that_of_the_rows(spark, outlier):
    rng = np.random.default_rng(2)
    xs = np.concatenate([rng.normal(1, 0.1, 3000), rng.exponential(0.3, 1000), [] if outlier is None else [outlier]])
    w = rng.integers(1, 4, len(xs))
    df = spark.createDataFrame([("g", float(x), int(n)) for x, n in zip(xs, w)] + [("g", None, 1), ("flat", 2.0, 3), ("lone", 1.0, 1)], "g string, x double, w int")
    got = {r.X: r.DENSITY for r in kernel_density(df, ["g"], "x", "w").collect()}
    n, mean = w.sum(), np.average(xs, weights=w)
    h = np.sqrt((w * (xs - mean) ** 2).sum() / (n - 1)) * n**-0.2
    grid = np.linspace(xs.min() - 3 * h, xs.max() + 3 * h, 200)
    exact = [(w * np.exp(-0.5 * ((g - xs) / h) ** 2)).sum() / (n * h * math.sqrt(2 * math.pi)) for g in grid]
    assert sorted(got) == pytest.approx(list(grid), rel=1e-9, abs=1e-9)
    assert [got[x] for x in sorted(got)] == pytest.approx(exact, abs=1e-7 * max(exact))
    ungrouped = kernel_density(df.filter("g = 'g'"), [], "x", "w").collect()
    assert sorted(r.DENSITY for r in ungrouped) == pytest.approx(sorted(got.values()), abs=1e-12)


def test_exact_gap_p_values(spark):
    """Against whole-number counts of the paths that stay under the gap."""
    from math import comb

    for m, n in ((1, 1), (3, 5), (6, 6), (7, 20), (12, 9)):
        for k in range(m * n + 1):
            ways = {(0, 0): 1}
            for i in range(m + 1):
                for j in range(n + 1):
                    if i + j:
                        ways[i, j] = 0 if abs(i * n - j * m) >= k else ways.get((i - 1, j), 0) + ways.get((i, j - 1), 0)
            inside = ways[m, n] if k > 0 else 0
            assert path_share(k / (m * n), m, n) == pytest.approx(1 - inside / comb(m + n, m), rel=1e-9, abs=1e-13)
    assert path_share(1.0, 40, 40) == pytest.approx(2 / comb(80, 40), rel=1e-9)  # no digits lost in small ones
    rows = [("a", float(i % 7), 1, int(i % 3 == 0)) for i in range(30)] + [("only", 1.0, 1, 0)]
    df = spark.createDataFrame(rows, "FEATURE string, VALUE double, W_PRIOR int, W_CURR int")
    got = {r.FEATURE: r for r in ks_two_sample(df).collect()}
    assert got["a"].P_VALUE == pytest.approx(path_share(got["a"].KS_STATISTIC, 30, 10)) and got["only"].P_VALUE is None
    series = {r.FEATURE: r.P_VALUE for r in ks_two_sample(df, exact_up_to=29).collect()}
    want = spark.range(1).select(kolmogorov_p(F.lit(got["a"].KS_STATISTIC), F.lit(30), F.lit(10))).first()[0]
    assert series["a"] == pytest.approx(want)
