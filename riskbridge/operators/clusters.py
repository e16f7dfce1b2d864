"""Risk clusters, their plane projection and quality, and geographic zones."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskbridge.functions.moments import moments
from riskbridge.functions.order import sample_n
from riskbridge.functions.scaling import fit_robust, scaled
from riskbridge.operators.features import RISK_FEATURES, ROW_KEYS, nothing, too_few
from riskbridge.operators.kmeans import Fit, checks, fit_kmeans

# Names of the clusters in falling order of mean value.
ARCHETYPES = [
    "High-Value Commercial Mega-Risks",
    "Mid-Market Commercial Real Estate",
    "Light Industrial / Low Stories",
    "Standard Residential High-Volume",
]
OTHER_ARCHETYPE = "Risk Segment"
SEED = 42
BLOCK = 256


def risk_inputs(rows: DataFrame) -> dict[str, Column]:
    """The scaled features; fitting them costs a pass, so several models of one table may share them."""
    return scaled(fit_robust(rows, RISK_FEATURES))


def _by_value(rows: DataFrame, cols: dict[str, Column], fit: Fit) -> Fit:
    """The fit with its centres in falling order of the rows' mean value."""
    means = {r.c: r.t for r in rows.groupBy(fit.label(cols).alias("c")).agg(F.avg("TIV_TOTAL").alias("t")).collect()}  # one row per cluster
    order = sorted(means, key=lambda c: (-means[c], c))
    return fit.ordered(order)  # centres without rows are left out


def fit_risk(rows: DataFrame, inputs: dict[str, Column], k: int = 4) -> Fit:
    return _by_value(rows, inputs, fit_kmeans(rows, inputs, k, seed=SEED))


def risk_clusters(rows: DataFrame, k: int = 4, inputs: dict[str, Column] | None = None) -> DataFrame:
    """Model rows with CLUSTER_ID; cluster 0 has the largest mean value."""
    if too_few(rows):
        return nothing(rows, CLUSTER_ID="int")
    inputs = inputs or risk_inputs(rows)
    return rows.withColumn("CLUSTER_ID", fit_risk(rows, inputs, k).label(inputs))


def cluster_checks(rows: DataFrame, k: int = 4) -> DataFrame:
    """Facts about the clusters that hold whatever the fit found."""
    inputs = risk_inputs(rows)
    fit = fit_risk(rows, inputs, k)
    return checks(rows.withColumn("CLUSTER_ID", fit.label(inputs)), "CLUSTER_ID", inputs, fit)


def cluster_profiles(clustered: DataFrame) -> DataFrame:
    """Size, means and archetype name of each cluster."""
    names = F.create_map(*[F.lit(x) for i, n in enumerate(ARCHETYPES) for x in (i, n)])
    return (
        clustered.groupBy("CLUSTER_ID")
        .agg(
            F.count("LOCNUM").alias("COUNT"),
            F.avg("TIV_TOTAL").alias("AVG_TIV"),
            F.avg("BLANPREAMT").alias("AVG_PREMIUM"),
            F.avg("FLOORAREA").alias("AVG_FLOORAREA"),
            F.avg("NUMSTORIES").alias("AVG_STORIES"),
            F.avg("RATE_ON_LINE_BPS").alias("AVG_ROL_BPS"),
        )
        .withColumn("ARCHETYPE", F.coalesce(F.try_element_at(names, F.col("CLUSTER_ID")), F.lit(OTHER_ARCHETYPE)))
    )


def silhouette(rows: DataFrame, k: int = 4, sample: int = 3000, inputs: dict[str, Column] | None = None) -> DataFrame:
    """Mean silhouette by Euclidean distance over a draw of `sample` rows; 0 if all of them share a cluster.

    Rows that hold a CLUSTER_ID keep it, others are clustered first. Distances run from blocks of the drawn rows to all of them, so a
    task holds a block times the draw whatever the table's size; a cluster of one row scores 0.
    """
    spark = rows.sparkSession
    score = 0.0
    if not too_few(rows, k + 1):
        inputs = inputs or risk_inputs(rows)
        named = rows if "CLUSTER_ID" in rows.columns else risk_clusters(rows, k, inputs)
        drawn = sample_n(named, sample, ROW_KEYS, RISK_FEATURES)
        rows_of = drawn.select(F.col("CLUSTER_ID").alias("c"), F.array(*inputs.values()).alias("x"))
        points = rows_of.collect()  # `sample` rows
        x, label = np.array([p.x for p in points]), np.unique([p.c for p in points], return_inverse=True)[1]
        if label.max() > 0:
            starts = spark.range(0, len(x), BLOCK, (len(x) + BLOCK - 1) // BLOCK)
            score = starts.mapInPandas(_block_silhouettes(x, label), "s double").agg(F.avg("s").alias("s")).first().s
    return spark.createDataFrame([(k, float(score))], "K int, SILHOUETTE double")


def _block_silhouettes(x: np.ndarray, label: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    member = np.eye(label.max() + 1)[label]
    size = member.sum(axis=0)

    def run(starts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lo in (int(i) for batch in starts for i in batch["id"]):
            block, own = x[lo : lo + BLOCK], label[lo : lo + BLOCK]
            squares = np.zeros((len(block), len(x)))
            for a, b in zip(block.T, x.T, strict=True):
                squares += (a[:, None] - b) ** 2
            sums, at = np.sqrt(squares) @ member, np.arange(len(block))
            inside = sums[at, own] / np.maximum(size[own] - 1, 1)
            means = sums / size
            means[at, own] = np.inf
            outside = means.min(axis=1)
            wide = np.maximum(inside, outside)
            yield pd.DataFrame({"s": np.where((size[own] > 1) & (wide > 0), (outside - inside) / np.where(wide > 0, wide, 1), 0.0)})

    return run


def pca_2d(rows: DataFrame, inputs: dict[str, Column] | None = None) -> DataFrame:
    """Model rows with their first two principal components."""
    if too_few(rows):
        return nothing(rows, PCA1="double", PCA2="double")
    inputs = inputs or risk_inputs(rows)
    found = moments(rows, inputs)
    loadings, _ = found.components(2)
    centred = [c - F.lit(float(m)) for c, m in zip(inputs.values(), found.means, strict=True)]
    return rows.withColumns({f"PCA{j + 1}": sum((c * F.lit(float(w)) for c, w in zip(centred, loadings[j], strict=True)), F.lit(0.0)) for j in (0, 1)})


def pca_variance(rows: DataFrame, inputs: dict[str, Column] | None = None) -> DataFrame:
    """Share of variance and loadings of the first two components."""
    schema = "COMPONENT string, EXPLAINED_VARIANCE_PCT double, " + ", ".join(f"{c} double" for c in RISK_FEATURES)
    if too_few(rows):
        return rows.sparkSession.createDataFrame([], schema)
    loadings, shares = moments(rows, inputs or risk_inputs(rows)).components(2)
    return rows.sparkSession.createDataFrame([(f"PC{j + 1}", float(shares[j]) * 100, *map(float, loadings[j])) for j in (0, 1)], schema)


def geo_zones(rows: DataFrame, k: int = 6, weighted: bool = False) -> DataFrame:
    """Zones of located rows, with their share of the whole portfolio's value.

    Clusters are unweighted by default; `weighted` counts each row by its insured value.
    """
    placed = rows.filter("LATITUDE != 0 AND LONGITUDE != 0")
    schema = (
        "GEO_ZONE_ID int, LOCATIONS bigint, CENTER_LAT double, CENTER_LON double, "
        "TOTAL_ZONE_TIV double, MEAN_LOC_TIV double, ZONE_TIV_SHARE_PCT double"
    )
    if too_few(placed, 11):
        return rows.sparkSession.createDataFrame([], schema)
    fit = fit_zones(placed, k, weighted)
    return zone_profile(placed.withColumn("GEO_ZONE_ID", fit.label(_place())), rows)


def _place() -> dict[str, Column]:
    return {c: F.col(c) for c in ("LATITUDE", "LONGITUDE")}


def fit_zones(placed: DataFrame, k: int = 6, weighted: bool = False) -> Fit:
    return _by_value(placed, _place(), fit_kmeans(placed, _place(), k, F.col("TIV_TOTAL") if weighted else None, seed=SEED))


def zone_checks(rows: DataFrame, k: int = 6) -> DataFrame:
    """Facts about the zones that hold whatever the fit found."""
    placed = rows.filter("LATITUDE != 0 AND LONGITUDE != 0")
    fit = fit_zones(placed, k)
    return checks(placed.withColumn("GEO_ZONE_ID", fit.label(_place())), "GEO_ZONE_ID", _place(), fit)


def zone_profile(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Size, centre and value of each GEO_ZONE_ID, with its share of the value of all `rows`."""
    whole = rows.agg(F.sum("TIV_TOTAL").alias("t")).scalar()
    return (
        found.groupBy("GEO_ZONE_ID")
        .agg(
            F.count("LOCNUM").alias("LOCATIONS"),
            F.avg("LATITUDE").alias("CENTER_LAT"),
            F.avg("LONGITUDE").alias("CENTER_LON"),
            F.sum("TIV_TOTAL").alias("TOTAL_ZONE_TIV"),
            F.avg("TIV_TOTAL").alias("MEAN_LOC_TIV"),
        )
        .withColumn("ZONE_TIV_SHARE_PCT", F.when(whole > 0, F.col("TOTAL_ZONE_TIV") / whole * 100).otherwise(0.0))
        .orderBy(F.desc("TOTAL_ZONE_TIV"), "GEO_ZONE_ID")
    )
