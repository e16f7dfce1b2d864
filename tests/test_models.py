import numpy as np
import pandas as pd
import pytest
from conftest import SF
from pyspark.sql import functions as F

from riskbridge.functions.durable import durable
from riskbridge.functions.moments import moments
from riskbridge.functions.scaling import fit_robust, fit_standard, scaled
from riskbridge.operators import bagging, clusters, features, forests, neural
from riskbridge.operators.features import RISK_FEATURES
from riskbridge.operators.kmeans import checks, fit_kmeans
from riskbridge.operators.neural import Net
from riskbridge.sources.fixtures import locations, policies


@pytest.fixture(scope="module")
def both(spark):
    return features.model_rows(durable(locations(spark, SF)), durable(policies(spark, SF)), None)


@pytest.fixture(scope="module")
def rows(both):
    return durable(both.filter("PERIOD = 'curr'"))


def test_imputed_age(frame):
    loc = frame("ACCNTNUM LOCNUM YEARBUILT", [("A", i, y) for i, y in enumerate([0, 1799, 1800, 1900, 2000, 2040])])
    pol = frame("ACCNTNUM POLICYNUM", [("A", 1)])
    got = [r.AGE for r in features.features(loc, pol).orderBy("LOCNUM").collect()]
    assert got == [26.0, 26.0, 150.0, 126.0, 26.0, 0.0]
    unknown = loc.filter("YEARBUILT = 0")
    assert features.features(unknown, pol).first().AGE == 31.0


def test_scaling(spark):
    df = spark.createDataFrame([(float(i), 5.0, 0.0 if i else 9.0) for i in range(5)], "a double, b double, c double")
    assert fit_robust(df, ["a", "b", "c"]) == {"a": (2.0, 2.0), "b": (5.0, 1.0), "c": (0.0, 1.0)}
    assert fit_standard(df, ["a", "b"]) == {"a": (2.0, pytest.approx(2**0.5)), "b": (5.0, 1.0)}
    z = scaled(fit_robust(df, ["c"]))["c"]
    assert df.select(F.max(z)).first()[0] == 9.0


def test_clusters(rows):
    c = clusters.risk_clusters(rows)
    profile = clusters.cluster_profiles(c).orderBy("CLUSTER_ID").collect()
    assert [p.CLUSTER_ID for p in profile] == list(range(len(profile))) and len(profile) <= 4
    assert [p.AVG_TIV for p in profile] == sorted((p.AVG_TIV for p in profile), reverse=True)
    assert sum(p.COUNT for p in profile) == rows.count() and profile[0].ARCHETYPE == clusters.ARCHETYPES[0]
    again = clusters.cluster_profiles(clusters.risk_clusters(rows)).orderBy("CLUSTER_ID").collect()
    assert [p.COUNT for p in again] == [p.COUNT for p in profile]
    assert -1 <= clusters.silhouette(rows).first().SILHOUETTE <= 1


def test_starts_and_layouts(spark):
    """Planted groups, one of them a third of all rows at one point: found alike from 1 and 13 partitions."""
    rng = np.random.default_rng(1)
    spots = [(0, 0), (40, 0), (0, 40), (40, 40)]
    rows = [(float(x + rng.normal()), float(y + rng.normal()), 1.0) for x, y in spots for _ in range(100)] + [(41.0, 41.0, 1.0)] * 200
    df = spark.createDataFrame(rows, "x double, y double, w double")
    cols = {"x": F.col("x"), "y": F.col("y")}
    fits = [fit_kmeans(df.repartition(n), cols, 4, starts=5) for n in (1, 13)]
    assert fits[0].centres == fits[1].centres and fits[0].inertia == pytest.approx(fits[1].inertia)
    found = {tuple(round(v / 40) * 40 for v in c) for c in fits[0].centres}
    assert found == set(spots) and len(fits[0].inertia) == 5
    fact = checks(df.withColumn("c", fits[0].label(cols)), "c", cols, fits[0]).first()
    assert (fact.ROWS, fact.CLUSTERS, fact.NEARER_ANOTHER, fact.SUMS_AGREE) == (600, 4, 0, True)
    heavy = fit_kmeans(df, cols, 1, F.when(F.col("x") > 20, 3.0).otherwise(1.0))
    x = np.array(rows)[:, 0]
    assert heavy.centres[0][0] == pytest.approx(np.average(x, weights=np.where(x > 20, 3.0, 1.0)), rel=1e-9)
    same = fit_kmeans(df.filter("x = 41"), cols, 3)  # fewer points than clusters
    assert same.inertia == [0.0] * 3 and same.centres == [[41.0, 41.0]] * 3


def test_silhouette_by_brute_force(spark):
    rng = np.random.default_rng(2)
    x, c = rng.normal(size=(300, len(RISK_FEATURES))), [0] * 99 + [1] * 200 + [2]
    cols = "CLUSTER_ID int, " + ", ".join(f"{k} string" for k in features.ROW_KEYS) + ", " + ", ".join(f"{f} double" for f in RISK_FEATURES)
    df = spark.createDataFrame([(g, *(str(i) for _ in features.ROW_KEYS), *map(float, r)) for i, (g, r) in enumerate(zip(c, x, strict=True))], cols)
    score = []
    for i in range(300):
        far = {g: [float(np.linalg.norm(x[i] - x[j])) for j in range(300) if c[j] == g and j != i] for g in range(3)}
        a, b = far[c[i]], min(np.mean(far[g]) for g in range(3) if g != c[i])
        score.append((b - np.mean(a)) / max(b, np.mean(a)) if a else 0.0)
    got = clusters.silhouette(df, 3, inputs={f: F.col(f) for f in RISK_FEATURES}).first().SILHOUETTE
    assert got == pytest.approx(np.mean(score), rel=1e-9)


def test_moments(spark):
    x = np.random.default_rng(3).normal(1e6, 1, (500, 3)) @ np.diag([1, 5, 0.1])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").repartition(7)
    m = moments(df, {n: F.col(n) for n in "abc"})
    assert m.count == 500 and m.means == pytest.approx(x.mean(axis=0)) and m.covariance == pytest.approx(np.cov(x.T), rel=1e-6, abs=1e-6)
    loads, shares = m.components(3)
    assert shares.sum() == pytest.approx(1) and list(shares) == sorted(shares, reverse=True) and loads @ loads.T == pytest.approx(np.eye(3), abs=1e-9)
    none = moments(df.limit(0), {n: F.col(n) for n in "abc"})
    assert none.count == 0 and not none.covariance.any() and not none.components(2)[1].any()


def test_components(rows):
    p = clusters.pca_2d(rows).agg(F.avg("PCA1"), F.avg("PCA2"), F.corr("PCA1", "PCA2"), F.var_samp("PCA1"), F.var_samp("PCA2")).first()
    assert [p[0], p[1], p[2]] == pytest.approx([0, 0, 0], abs=1e-6) and p[3] >= p[4]
    v = clusters.pca_variance(rows).collect()
    assert sum(r.EXPLAINED_VARIANCE_PCT for r in v) <= 100.0001
    loads = np.array([[r[c] for c in RISK_FEATURES] for r in v])
    assert loads @ loads.T == pytest.approx(np.eye(2), abs=1e-9) and all(max(row, key=abs) > 0 for row in loads)


def test_zones(rows):
    for weighted in (False, True):
        z = clusters.geo_zones(rows, weighted=weighted).collect()
        assert len(z) == 6 and [r.GEO_ZONE_ID for r in sorted(z, key=lambda r: -r.MEAN_LOC_TIV)] == list(range(6))
        assert sum(r.LOCATIONS for r in z) == rows.filter("LATITUDE != 0 and LONGITUDE != 0").count()
        assert sum(r.ZONE_TIV_SHARE_PCT for r in z) < 100


def test_forests(both, rows):
    shift = forests.covariate_shift(both).collect()
    assert {r.FEATURE for r in shift} == set(RISK_FEATURES)
    assert sum(r.DRIFT_IMPORTANCE_PCT for r in shift) == pytest.approx(100)
    b = durable(forests.benchmark_premium(rows))
    r = b.first()
    assert r.PREMIUM_RESIDUAL == pytest.approx(r.BLANPREAMT - r.BENCHMARK_PREMIUM)
    assert forests.r2(b, "BLANPREAMT", "BENCHMARK_PREMIUM").first().R2 <= 1
    m = forests.mispricing(b, "BENCHMARK_PREMIUM", "PRICING_DEVIATION_PCT").first()
    assert m.UNDERPRICED_ROWS == b.filter("PRICING_DEVIATION_PCT < -30").count() and m.UNDERPRICED_ACCOUNTS <= m.UNDERPRICED_ROWS


def test_forest_is_the_same_on_any_partitions(spark, both):
    data = both.select(*RISK_FEATURES, (F.col("PERIOD") == "curr").cast("double").alias("y"), *features.ROW_KEYS)
    fits = [bagging.fit_forest(data.repartition(n), RISK_FEATURES, "y", trees=4, depth=3, rate=0.5, features_per_node=3) for n in (2, 60)]
    for name in ("feature", "cut", "value", "weight", "gain"):
        assert (getattr(fits[0], name) == getattr(fits[1], name)).all(), name
    assert fits[0].importances().sum() == pytest.approx(1)
    # children share out the weight of their parent, whose value is their mean
    f = fits[0]
    for t, i in zip(*np.nonzero(f.feature >= 0)):
        left, right = 2 * i + 1, 2 * i + 2
        assert f.weight[t, left] + f.weight[t, right] == f.weight[t, i]
        assert (f.weight[t, [left, right]] * f.value[t, [left, right]]).sum() / f.weight[t, i] == pytest.approx(f.value[t, i], abs=1e-6)


def test_forest_against_brute_force(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"a": rng.integers(0, 20, 300) / 4, "b": rng.normal(size=300)})
    pdf["y"] = np.where(pdf.a > 2, 3.0, 0.0) + (pdf.b > 0.3) * 1.5 + rng.normal(size=300) * 0.1
    df = spark.createDataFrame(pdf)
    h = np.array([r[0] for r in df.select(F.xxhash64("a", "b", "y", F.lit(42))).collect()])
    forest = bagging.fit_forest(df, ["a", "b"], "y", trees=3, depth=2)
    from riskbridge.functions.order import bin_edges

    edges = bin_edges(df, ["a", "b"])
    for t in range(3):
        w = bagging.poisson(bagging.uniform(h, 42 * 1_000_003 + t), 1.0)
        best = {}
        for c in ("a", "b"):
            for e in edges[c]:
                low = (pdf[c] <= e).to_numpy()
                if w[low].sum() and w[~low].sum():
                    error = sum((w[s] * (pdf.y[s] - np.average(pdf.y[s], weights=w[s])) ** 2).sum() for s in (low, ~low))
                    best[error] = (c, e)
        c, e = best[min(best)]
        assert (forest.inputs[forest.feature[t, 0]], forest.cut[t, 0]) == (c, e)
        assert forest.value[t, 0] == pytest.approx(np.average(pdf.y, weights=w), abs=1e-4)
    fitted = ((forest.predict(pdf[["a", "b"]].to_numpy()) - pdf.y) ** 2).mean() / pdf.y.var()
    assert fitted < 0.05
    got = df.withColumn("p", forest.predicted()).toPandas()
    assert got.p.to_numpy() == pytest.approx(forest.predict(got[["a", "b"]].to_numpy()))


def test_poisson_draws():
    u = bagging.uniform(np.arange(200_000, dtype=np.int64), 3)
    assert u.mean() == pytest.approx(0.5, abs=0.005) and 0 <= u.min() and u.max() < 1
    for rate in (0.05, 1.0, 3.0):
        k = bagging.poisson(u, rate)
        assert k.mean() == pytest.approx(rate, rel=0.05) and k.var() == pytest.approx(rate, rel=0.05)


def test_isolation_forest_finds_a_planted_outlier(spark, rows):
    odd = rows.limit(1).withColumns({c: F.lit(1e9) for c in RISK_FEATURES}).withColumn("LOCNUM", F.lit("odd"))
    data = durable(rows.unionByName(odd))
    got = forests.isolation_forest(data, trees=30, samples=256)
    n = data.count()
    assert got.filter("ANOMALY_LABEL = -1").count() == pytest.approx(0.03 * n, abs=2)
    assert got.orderBy("ANOMALY_SCORE").first().LOCNUM == "odd"
    assert got.count() == n
    std = forests.isolation_forest(data, trees=10, samples=64, scaling="standard")
    assert std.count() == n


def test_tree_path_lengths():
    tree = forests.grow_tree(np.zeros((5, 2)), 1)
    assert tree["feature"] == [-1] and tree["length"] == [pytest.approx(forests.path_norm(5))]
    assert forests.path_norm(1) == 0 and forests.path_norm(2) == 1
    tree = forests.grow_tree(np.array([[0.0], [1.0]]), 1)
    assert sorted(tree["feature"]) == [-1, -1, 0] and tree["length"][1:] == [1.0, 1.0]


def test_gradient():
    rng = np.random.default_rng(0)
    net = Net.start((3, 4, 2))
    x, y = rng.normal(size=(6, 3)), rng.normal(size=(6, 2))

    def loss(theta):
        moved = Net(net.sizes, theta)
        decay = sum((w**2).sum() for w, _ in moved.layers()) * neural.DECAY / 2 / len(x)
        return ((moved.predict(x) - y) ** 2).sum() / 2 / len(x) + decay

    g = net.gradient(x, y)
    for i in range(0, len(g), 5):
        step = np.zeros_like(g)
        step[i] = 1e-6
        assert g[i] == pytest.approx((loss(net.theta + step) - loss(net.theta - step)) / 2e-6, abs=1e-5)


def test_networks(spark):
    xs = spark.range(40_000).select(
        F.lit("curr").alias("PERIOD"), F.lit("Commercial").alias("SEGMENT"), F.col("id").cast("string").alias("ACCNTNUM"),
        F.lit("p").alias("POLICYNUM"), F.lit("l").alias("LOCNUM"), F.randn(1).alias("a"), F.randn(2).alias("b"),
    )
    data = durable(xs.withColumn("y", F.col("a") * 0.8 - F.abs("b") * 0.5).repartition(4))
    net = neural.fit_net(data, ["a", "b"], ["y"], (16, 8), 40)
    pdf = data.toPandas()
    err = ((net.predict(pdf[["a", "b"]].to_numpy())[:, 0] - pdf["y"]) ** 2).mean() / pdf["y"].var()
    assert err < 0.02


def test_networks_do_not_depend_on_the_layout(spark):
    xs = spark.range(6_000).select(
        F.lit("curr").alias("PERIOD"), F.lit("Commercial").alias("SEGMENT"), F.col("id").cast("string").alias("ACCNTNUM"),
        F.lit("p").alias("POLICYNUM"), F.lit("l").alias("LOCNUM"), F.randn(1).alias("a"), F.randn(2).alias("b"),
    )
    data = durable(xs.withColumn("y", F.col("a") * 0.8 - F.abs("b") * 0.5))
    fits = []
    for parts, batch in ((1, 10_000), (8, 700), (64, 10_000), (150, 3000)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        fits.append(neural.fit_net(data.repartition(parts, "a"), ["a", "b"], ["y"], (16, 8), 8).theta)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for other in fits[1:]:
        assert other == pytest.approx(fits[0], rel=1e-9, abs=1e-9)


def test_one_pass_sums_all_rows(spark):
    pdf = pd.DataFrame(np.random.default_rng(1).normal(size=(500, 3)), columns=["a", "b", "y"])
    pdf["_hold"] = np.arange(500) % 10 == 0
    net = Net.start((2, 5, 1))
    got = neural.one_pass(spark.createDataFrame(pdf).repartition(3), net, ["a", "b"], ["y"])
    fit, held = pdf[~pdf._hold], pdf[pdf._hold]
    x, y = fit[["a", "b"]].to_numpy(), fit[["y"]].to_numpy()
    assert got.gradient == pytest.approx(net.gradient(x, y), rel=1e-9, abs=1e-12)
    assert got.score == pytest.approx(1 - ((net.predict(held[["a", "b"]].to_numpy())[:, 0] - held.y) ** 2).sum() / (held.y.var(ddof=0) * len(held)))
    assert (got.rows, got.held) == (450, 50)


def test_forests_do_not_depend_on_partitions(rows):
    def flagged(data):
        found = forests.isolation_forest(data, trees=10, samples=64).filter("ANOMALY_LABEL = -1")
        return sorted(found.select("ACCNTNUM", "POLICYNUM", "LOCNUM").collect())

    two, seven = rows.repartition(2), rows.repartition(7)
    assert flagged(two) == flagged(seven)
    fits = [forests.benchmark_premium(x, trees=3, depth=3).groupBy().agg(F.round(F.sum("BENCHMARK_PREMIUM"), 3)).first() for x in (two, seven)]
    assert fits[0] == fits[1]


def test_neural_operators(rows):
    deep = neural.autoencoder_scores(rows, epochs=2)
    n = rows.count()
    flagged = deep.filter("DEEP_ANOMALY_FLAG = -1").count()
    assert flagged == pytest.approx(0.03 * n, abs=2)
    top = neural.top_anomalies(deep).collect()
    assert len(top) == 5 and top[0].AUTOENCODER_MSE == deep.agg(F.max("AUTOENCODER_MSE")).first()[0]
    priced = neural.neural_pricing(rows, epochs=2)
    assert priced.filter("NEURAL_PREDICTED_PREM < 0").count() == 0 and priced.count() == n
    both = neural.anomalies(deep, forests.isolation_forest(rows, trees=10, samples=64))
    assert {r[0] for r in both.select("METHOD").distinct().collect()} == {"AUTOENCODER", "ISOLATION_FOREST"}


def test_few_rows(rows):
    few = durable(rows.limit(4))
    assert clusters.risk_clusters(few).count() == 0 and "CLUSTER_ID" in clusters.risk_clusters(few).columns
    assert clusters.pca_2d(few).count() == 0 and clusters.pca_variance(few).count() == 0
    assert clusters.geo_zones(few).count() == 0 and forests.covariate_shift(few).count() == 0
    assert forests.isolation_forest(few).count() == 0 and forests.benchmark_premium(few).count() == 0
    assert neural.autoencoder_scores(few).count() == 0 and neural.neural_pricing(few).count() == 0
    assert clusters.silhouette(few).first().SILHOUETTE == 0.0


def test_equal_inputs_pass_as_one(spark):
    """Loss, gradient and score of rows added up by their inputs are those of the rows, with and without targets among the inputs."""
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"a": rng.integers(0, 4, 900) / 2, "b": rng.integers(0, 3, 900) - 1.0, "y": rng.normal(size=900)})
    pdf["_hold"] = rng.random(900) < 0.2
    df = spark.createDataFrame(pdf).repartition(3)
    for targets in (["y"], ["a", "b"]):
        net = Net.start((2, 5, len(targets)))
        small = neural.collapsed(df, ["a", "b"], targets)
        assert small.count() <= 24
        one, all_ = neural.one_pass(small, net, ["a", "b"], targets), neural.one_pass(df, net, ["a", "b"], targets)
        assert one.gradient == pytest.approx(all_.gradient, rel=1e-9, abs=1e-12)
        assert (one.loss, one.score) == (pytest.approx(all_.loss, rel=1e-9), pytest.approx(all_.score, rel=1e-9))
        assert (one.rows, one.held) == (all_.rows, all_.held)


def test_repeated_rows_are_not_passed_again(spark, monkeypatch):
    """Ten policies a location: networks and centres go over each location once, and learn what all rows say."""
    xs = spark.range(3_000).select(
        F.lit("curr").alias("PERIOD"), F.lit("Commercial").alias("SEGMENT"), F.col("id").cast("string").alias("ACCNTNUM"),
        F.lit("p").alias("POLICYNUM"), F.lit("l").alias("LOCNUM"), (F.col("id") % 50 / 10).alias("a"), F.randn(2).alias("y"),
    )
    data = durable(xs)
    from riskbridge.operators import kmeans

    seen = []
    real, real_pass = neural.one_pass, kmeans._pass
    monkeypatch.setattr(neural, "one_pass", lambda d, *more: seen.append(d.count()) or real(d, *more))
    monkeypatch.setattr(kmeans, "_pass", lambda d, *more: seen.append(d.count()) or real_pass(d, *more))
    neural.fit_net(data, ["a"], ["y"], (4,), 2)
    fit = fit_kmeans(data, {"a": F.col("a")}, 3)
    assert max(seen) <= 100
    monkeypatch.setattr(kmeans, "repeats", lambda *_: False)
    assert fit_kmeans(data, {"a": F.col("a")}, 3).centres == fit.centres


def test_only_what_models_need_is_landed(spark, monkeypatch, tmp_path):
    from riskbridge.operators.features import LOCATION_INPUTS
    from riskbridge.plans import queries as q

    landed = []
    monkeypatch.setattr(q, "durable", lambda df: landed.append(df) or df)
    q.queries()["audit_by_value"](spark, SF)
    loc, pol = landed
    assert set(loc.columns) == {"PERIOD", "SEGMENT", "ACCNTNUM", *LOCATION_INPUTS} and len(pol.columns) == 6
    assert {r[0] for r in loc.select("PERIOD").distinct().collect()} == {"curr"}


def test_path_lengths():
    """Alike to walking down each tree row by row, missing values to the right."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3)).round(1)
    x[::50, 1], x[7, 2] = np.nan, np.inf
    grown = [forests.grow_tree(rng.normal(size=(64, 3)), s) for s in range(4)]
    got = forests.path_lengths(x, [tuple(np.asarray(g[k]) for k in ("feature", "cut", "left", "length")) for g in grown], 6)
    for r, row in enumerate(x):
        for t, g in enumerate(grown):
            at = 0
            while g["feature"][at] >= 0:
                at = g["left" if row[g["feature"][at]] <= g["cut"][at] else "right"][at]
            assert got[r, t] == g["length"][at]
