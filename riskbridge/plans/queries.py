"""Registered queries: each operator over the star-schema tables, rounded for comparison."""

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskbridge import schema as S
from riskbridge.functions.columns import conform, normalize
from riskbridge.functions.durable import DROP_SHUFFLES, durable, scratch_dir, settings
from riskbridge.functions.order import sample_n
from riskbridge.functions.scaling import fit_robust, fit_standard, scaled
from riskbridge.operators import clusters, features, forests, merge, mom, neural, profile, stats
from riskbridge.operators.features import BENCHMARK_FEATURES, EXTRA, LOCATION_INPUTS, POLICY_INPUTS, RISK_FEATURES, model_rows
from riskbridge.sources.fixtures import locations, policies
from riskbridge.sources.ingest import Extract, read_extract

Query = Callable[[SparkSession, str], DataFrame]
_LOC_WIDTH = len(S.LOCATION_COLUMNS) + len(S.TIV_COLUMNS)
_POL_WIDTH = len(S.POLICY_COLUMNS)
_ROW = ["SEGMENT", "ACCNTNUM", "POLICYNUM", "LOCNUM"]
# A task writes both segments at once instead of sorting its rows by segment; its shuffle files go when the write is done.
_UNSORTED = {"spark.sql.maxConcurrentOutputFileWriters": "2", "spark.sql.optimizer.plannedWrite.enabled": "false", **DROP_SHUFFLES}


def rounded(df: DataFrame, digits: int, *cols: str, **special: int) -> DataFrame:
    """Round the named columns; keyword arguments give other digits.

    Amounts have four decimals, so their sums are rounded to four: at fewer, a sum can lie on a
    rounding edge and the order of addition decides. Sums over large parts of the portfolio, from 10⁹ on, where
    doubles no longer hold four decimals, are rounded to one or none.
    """
    plan = {c: digits for c in cols} | special
    return df.withColumns({c: F.round(c, d) for c, d in plan.items()})


def _on_locations(op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: op(locations(spark, sf))


def _on_policies(op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: op(policies(spark, sf))


def _on_both(op: Callable[[DataFrame, DataFrame], DataFrame], account: str = "customer") -> Query:
    return lambda spark, sf: op(locations(spark, sf, account), policies(spark, sf, account))


def _on_landed(
    op: Callable[[DataFrame, DataFrame], DataFrame], of_loc: list[str] | None = None, of_pol: list[str] | None = None, period: str | None = None,
    bucketed: bool = False,
) -> Query:
    """For operators that read their inputs several times: the normalised tables are written first.

    Only the named columns beside the account's, and the rows of the period, if they are given: what an operator doesn't read
    isn't written. `bucketed` lays out locations by account, for operators that join all their columns.
    """

    def landed(rows: DataFrame, cols: list[str] | None, **layout: list[str]) -> DataFrame:
        rows = rows if period is None else rows.filter(F.col("PERIOD") == period)
        return durable(rows if cols is None else rows.select(*S.ACCOUNT, *[c for c in cols if c not in S.ACCOUNT]), **layout)

    by_account = {"bucket_by": S.ACCOUNT} if bucketed else {}
    return lambda spark, sf: op(landed(locations(spark, sf), of_loc, **by_account), landed(policies(spark, sf), of_pol))


def _on_model_rows(
    op: Callable[[DataFrame], DataFrame], period: str | None = S.CURRENT, extra: list[str] = EXTRA, inputs: list[str] = RISK_FEATURES
) -> Query:
    return _on_landed(lambda l, p: op(model_rows(l, p, period, extra, inputs)), LOCATION_INPUTS, POLICY_INPUTS, period)


def _on_drift_values(op: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return _on_landed(op, ["LOCNUM", *stats.LOCATION_FEATURES], ["BLANPREAMT"])


def _csv_roundtrip(table: Callable[..., DataFrame], columns: list[str]) -> Query:
    """Rows of both segments and periods written as untidy CSV extracts, read and normalised again."""

    def untidy(c: str) -> Column:
        if c in S.NUMBER_COLUMNS:
            turn = F.pmod(F.xxhash64("ACCNTNUM", *{"LOCNUM", "POLICYNUM"}.intersection(columns)), F.lit(3))
            junk = F.when(turn == 0, "n/a").when(turn == 1, "1d").otherwise("")
            return F.when(F.col(c) == 0, junk).otherwise(F.concat(F.lit(" "), F.col(c).cast("string")))
        return F.concat(F.lit("  "), F.col(c), F.lit(" ")) if c in S.TEXT_COLUMNS else F.col(c)

    def query(spark: SparkSession, sf: str) -> DataFrame:
        headers = {c: (f" {c.title()}" if i % 2 else f"{c.lower()} ") for i, c in enumerate(columns)}
        root = f"{scratch_dir(spark)}/riskbridge-csv-{uuid.uuid4().hex}"
        rows = table(spark, sf).select("SEGMENT", "PERIOD", *[untidy(c).alias(headers[c]) for c in columns])
        # one pass for both segments; compressed, as the text is several times the size of the tables
        with settings(spark, **_UNSORTED):
            text = rows.write.partitionBy("SEGMENT").option("header", True).option("compression", "gzip")
            text.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(root)
        out = None
        for segment in (S.COMMERCIAL, S.STANDARD):
            try:
                raw = read_extract(spark, Extract("roundtrip", S.PRIOR, segment, f"{root}/SEGMENT={segment}"))
            except FileNotFoundError:  # no rows of the segment
                continue
            again = normalize(raw)
            again = conform(again.withColumn("SEGMENT", F.lit(segment)))
            out = again if out is None else out.unionByName(again)
        return table(spark, sf).limit(0) if out is None else out

    return query


def _key_integrity(loc: DataFrame, pol: DataFrame) -> DataFrame:
    return profile.key_integrity(loc).withColumn("TYPE", F.lit("Location")).unionByName(
        profile.key_integrity(pol).withColumn("TYPE", F.lit("Policy"))
    )


def _missingness(loc: DataFrame) -> DataFrame:
    gaps = profile.missingness(loc.drop(*S.TIV_COLUMNS), _LOC_WIDTH)
    return rounded(gaps, 6, "NULL_PCT", "TOTAL_NULL_PCT")


def _sample(loc: DataFrame, pol: DataFrame) -> DataFrame:
    now = F.col("PERIOD") == S.CURRENT
    rows = merge.merge_exposure(loc.filter(now), pol.filter(now)).select(*_ROW, "TIV_TOTAL", "FLOORAREA")
    return sample_n(rows, 5000, _ROW, ["TIV_TOTAL", "FLOORAREA"])


def _features(loc: DataFrame, pol: DataFrame) -> DataFrame:
    cols = [*RISK_FEATURES, "STORIES_AREA_INTERACTION"]
    return rounded(features.features(loc, pol).select(*_ROW, *cols), 6, "RATE_ON_LINE_BPS", "STORIES_AREA_INTERACTION")


def _scaled(fit: Callable) -> Query:
    def op(rows):
        cols = scaled(fit(rows, RISK_FEATURES))
        return rows.select(*_ROW, *[F.round(c, 6).alias(n) for n, c in cols.items()])

    return _on_model_rows(op)


def _flagged(rows: DataFrame) -> DataFrame:
    return neural.flag_top_pct(rows.withColumn("AUTOENCODER_MSE", F.col("TIV_TOTAL")), "AUTOENCODER_MSE", 0.97, "DEEP_ANOMALY_FLAG")


def _plain_price(rows: DataFrame) -> DataFrame:
    plain = rows.withColumn("PREDICTED", 900 + F.col("TIV_TOTAL") * 0.01)
    return forests.add_deviation(plain, "BLANPREAMT", "PREDICTED", "RESIDUAL", "DEVIATION")


def _top(n_account: str) -> Query:
    return _on_both(lambda l, p: rounded(mom.top_accounts(l, p), 4, "MEAN_LOC_TIV"), n_account)


def _drift(key: str) -> Query:
    return _on_both(
        lambda l, p: rounded(mom.exposure_drift(l, p, key), 1, "PRIOR_TIV", "CURR_TIV", "TIV_DELTA", TIV_GROWTH_PCT=6)
    )


def _lob(keep_lapsed: bool) -> Query:
    return _on_both(
        lambda l, p: rounded(
            mom.lob_rollforward(l, p, keep_lapsed), 4, "PRIOR_PREMIUM", "CURR_PREMIUM", PRIOR_TIV=1, CURR_TIV=1, TIV_DELTA=0
        )
    )


def _waterfall(measure: str) -> Query:
    return _on_both(lambda l, p: rounded(mom.waterfall(l, p, measure), 1, "AMOUNT"))


def _kpis(loc: DataFrame, pol: DataFrame) -> DataFrame:
    return rounded(
        mom.kpis(loc, pol), 1, "Total_TIV_USD", "Total_Premium_USD", "Total_Limit_USD",
        Mean_TIV_per_Loc_USD=4, Mean_Prem_per_Acc_USD=4, Portfolio_RoL_Pct=4,
    )


def _priced(rows: DataFrame) -> DataFrame:
    return forests.mispricing(neural.neural_pricing(rows), "NEURAL_PREDICTED_PREM", "NEURAL_DEV_PCT")


def queries() -> dict[str, Query]:
    ws = S.WS_VALUES
    eras = [f"{n}_PCT" for n in profile.ERAS]
    return {
        "sql_top_accounts": _top("order"),
        "sql_top_accounts_fan_out": _top("customer"),
        "normalize_locations": _on_locations(lambda l: l),
        "normalize_policies": _on_policies(lambda p: p),
        "csv_roundtrip": _csv_roundtrip(locations, S.LOCATION_COLUMNS),
        "csv_roundtrip_policies": _csv_roundtrip(policies, S.POLICY_COLUMNS),
        "key_integrity": _on_both(_key_integrity),
        "missingness": _on_locations(_missingness),
        "eda_summary": _on_both(
            lambda l, p: rounded(
                profile.eda_summary(l, p, _LOC_WIDTH, _POL_WIDTH), 4, "TOTAL_TIV_USD", "TOTAL_PREMIUM_USD", "TOTAL_LIMIT_USD", "MEAN_TIV_USD"
            )
        ),
        "profile_locations": _on_locations(
            lambda l: rounded(profile.profile_locations(l), 4, "MEAN_TIV", "MAX_TIV", "MEDIAN_TIV", "P90_TIV", "P99_TIV", "TOTAL_TIV")
        ),
        "profile_policies": _on_policies(
            lambda p: rounded(
                profile.profile_policies(p), 4, "MEAN_PREMIUM", "MAX_PREMIUM", "MEAN_LIMIT",
                TOTAL_PREMIUM=4, TOTAL_LIMIT=4, MEDIAN_PREMIUM=5, P90_PREMIUM=5, RATE_ON_LIMIT_PCT=6,
            )
        ),
        "coverage_split": _on_locations(
            lambda l: rounded(profile.coverage_split(l), 4, "TOTAL_TIV", *ws, **{f"{c}_PCT": 6 for c in ws})
        ),
        "physical_profile": _on_locations(lambda l: rounded(profile.physical_profile(l), 4, "MEAN_FLOOR_AREA", "MEAN_STORIES")),
        "construction_eras": _on_locations(lambda l: rounded(profile.construction_eras(l), 6, *eras)),
        "geocode_quality": _on_locations(lambda l: rounded(profile.geocode_quality(l), 6, "VALID_PCT")),
        "top_values_locations": _on_locations(profile.top_values),
        "top_values_policies": _on_policies(profile.top_values),
        "merge_exposure": _on_landed(
            lambda l, p: merge.merge_exposure(l, p, digits={"RATE_ON_LINE_PCT": 6, "LIMIT_TO_TIV_RATIO": 6, "ACCOUNT_TIV": 4}),
            S.MERGED_LOCATION_COLUMNS, S.MERGED_POLICY_COLUMNS, bucketed=True,
        ),
        "portfolio": _on_landed(lambda l, p: rounded(merge.portfolio(merge.merge_exposure(l, p)), 0, "TIV_TOTAL")),
        "account_sets": _on_both(merge.account_sets),
        "match_diagnostics": _on_both(
            lambda l, p: rounded(merge.match_diagnostics(l, p), 6, "POLICY_MATCH_PCT", "LOCATION_MATCH_PCT")
        ),
        "merged_financials": _on_both(
            lambda l, p: rounded(
                merge.merged_financials(l, p), 6, "AVG_LOCS_PER_ACCOUNT", "PORTFOLIO_ROL_PCT", "LIMIT_TO_TIV_PCT",
                TOTAL_TIV=4, TOTAL_PREMIUM=4, TOTAL_LIMIT=4, AVG_TIV_PER_LOC=4,
            )
        ),
        "hhi": _on_both(lambda l, p: rounded(merge.hhi(l, p), 4, "HHI", TOP_SHARE_PCT=6)),
        "valuation_flags": _on_both(lambda l, p: rounded(merge.valuation_flags(l, p), 1, "TIV")),
        "rate_on_limit": _on_policies(
            lambda p: rounded(merge.rate_on_limit(p), 6, "RATE_ON_LIMIT_PCT").select(
                *S.ACCOUNT, "POLICYNUM", "BLANPREAMT", "BLANLIMAMT", "RATE_ON_LIMIT_PCT"
            )
        ),
        "account_first": _on_both(lambda l, p: rounded(mom.account_first(l, p), 4, "TIV")),
        "kpis": _on_landed(_kpis),
        "kpi_comparison": _on_landed(
            lambda l, p: rounded(mom.kpi_comparison(l, p), 0, "PRIOR_VALUE", "CURRENT_VALUE", "DELTA", GROWTH_PCT=6)
        ),
        "rollforward": _on_both(lambda l, p: rounded(mom.rollforward(l, p), 6, "CHURN_PCT", "RETENTION_PCT", "INFLOW_PCT")),
        "waterfall_tiv": _waterfall("TIV"),
        "waterfall_premium": _waterfall("PREMIUM"),
        "state_drift": _drift("STATE"),
        "lob_drift": _drift("LOBNAME"),
        "cedant_drift": _drift("CEDANTNAME"),
        "producer_drift": _drift("PRODNAME"),
        "lob_rollforward_sql": _lob(False),
        "lob_rollforward_full": _lob(True),
        "coverage_by_state": _on_both(lambda l, p: rounded(mom.coverage_by_state(l, p), 4, *ws, "TIV_TOTAL")),
        "coverage_by_period": _on_both(lambda l, p: rounded(mom.coverage_by_period(l, p), 6, "VALUE_MUSD")),
        "chart_states": _on_both(lambda l, p: rounded(mom.chart_states(l, p), 6, "PRIOR_MUSD", "CURR_MUSD")),
        "top_class_exposure": _on_both(lambda l, p: rounded(mom.top_class_exposure(l, p), 6, "PRIOR_MUSD", "CURR_MUSD")),
        "tail_risk": _on_landed(lambda l, p: rounded(stats.tail_risk(l, p), 4, "VAR", "TVAR")),
        "ep_curve": _on_landed(lambda l, p: rounded(stats.ep_curve(l, p), 8, "EXCEEDANCE_PCT")),
        "psi": _on_drift_values(lambda l, p: rounded(stats.psi(stats.drift_values(l, p)), 6, "PSI_SCORE")),
        "ks_two_sample": _on_drift_values(
            lambda l, p: rounded(stats.ks_two_sample(stats.drift_values(l, p)), 6, "P_VALUE", KS_STATISTIC=8)
        ),
        "drift_matrix": _on_drift_values(stats.drift_matrix),
        "stress_tests": _on_both(lambda l, p: rounded(stats.stress_tests(l, p), 1, "BASE", "STRESSED", "UPLIFT", MEAN_ROL_BPS=6)),
        "rate_density": _on_landed(lambda l, p: rounded(stats.rate_density(l, p), 6, "BIN_START", "BIN_END")),
        "kernel_density": _on_landed(
            lambda l, p: rounded(
                stats.kernel_density(merge.exposed_policies(l, p), ["PERIOD"], "RATE_ON_LINE_PCT", "WEIGHT"), 6, "X", "DENSITY"
            )
        ),
        "sample_n": _on_landed(_sample),
        "features": _on_landed(_features),
        "standard_scaled": _scaled(fit_standard),
        "robust_scaled": _scaled(fit_robust),
        "risk_clusters": _on_model_rows(clusters.risk_clusters),
        "cluster_profiles": _on_model_rows(lambda r: clusters.cluster_profiles(clusters.risk_clusters(r))),
        "pca_2d": _on_model_rows(clusters.pca_2d),
        "pca_variance": _on_model_rows(lambda r: rounded(clusters.pca_variance(r), 4, "EXPLAINED_VARIANCE_PCT", *RISK_FEATURES)),
        "cluster_checks": _on_model_rows(clusters.cluster_checks),
        "zone_checks": _on_model_rows(clusters.zone_checks),
        "silhouette_by_stories": _on_model_rows(
            lambda r: rounded(clusters.silhouette(r.withColumn("CLUSTER_ID", F.col("NUMSTORIES").cast("int") % 5), 5), 6, "SILHOUETTE")
        ),
        "silhouette": _on_model_rows(clusters.silhouette),
        "geo_zones": _on_model_rows(clusters.geo_zones),
        "geo_zones_weighted": _on_model_rows(lambda r: clusters.geo_zones(r, weighted=True)),
        "covariate_shift": _on_model_rows(forests.covariate_shift, None, []),
        "benchmark_premium": _on_model_rows(forests.benchmark_premium),
        "r2": _on_model_rows(
            lambda r: forests.r2(forests.benchmark_premium(r), "BLANPREAMT", "BENCHMARK_PREMIUM"), extra=[], inputs=[*BENCHMARK_FEATURES, "BLANPREAMT"]
        ),
        "isolation_forest": _on_model_rows(forests.isolation_forest),
        "autoencoder_scores": _on_model_rows(neural.autoencoder_scores),
        "neural_pricing": _on_model_rows(neural.neural_pricing),
        "anomalies": _on_model_rows(lambda r: neural.anomalies(neural.autoencoder_scores(r), forests.isolation_forest(r))),
        "top_anomalies": _on_model_rows(lambda r: neural.top_anomalies(neural.autoencoder_scores(r))),
        "mispricing": _on_model_rows(_priced),
        # what follows a model, over labels, scores and predictions that SQL can state
        "profiles_by_stories": _on_model_rows(
            lambda r: rounded(
                clusters.cluster_profiles(r.withColumn("CLUSTER_ID", F.col("NUMSTORIES").cast("int") % 5)), 4,
                "AVG_TIV", "AVG_PREMIUM", "AVG_FLOORAREA", "AVG_STORIES", "AVG_ROL_BPS",
            )
        ),
        "zones_by_latitude": _on_model_rows(
            lambda r: rounded(
                clusters.zone_profile(
                    r.filter("LATITUDE != 0 AND LONGITUDE != 0").withColumn("GEO_ZONE_ID", F.col("LATITUDE").cast("int") % 6), r
                ),
                4, "CENTER_LAT", "CENTER_LON", "MEAN_LOC_TIV", TOTAL_ZONE_TIV=1, ZONE_TIV_SHARE_PCT=6,
            )
        ),
        "flagged_by_value": _on_model_rows(lambda r: _flagged(r).groupBy("DEEP_ANOMALY_FLAG").agg(
            F.count(F.lit(1)).alias("ROWS"), F.min("AUTOENCODER_MSE").alias("LOWEST"), F.max("AUTOENCODER_MSE").alias("HIGHEST")
        )),
        "top_by_value": _on_model_rows(lambda r: neural.top_anomalies(_flagged(r))),
        "audit_by_value": _on_model_rows(lambda r: neural.anomalies(
            _flagged(r), r.withColumn("ANOMALY_SCORE", 48_500 - F.col("FLOORAREA")).withColumn("ANOMALY_LABEL", F.when(F.col("FLOORAREA") > 48_500, -1).otherwise(1))
        )),
        "r2_of_plain_price": _on_model_rows(lambda r: rounded(forests.r2(_plain_price(r), "BLANPREAMT", "PREDICTED"), 6, "R2")),
        "mispricing_of_plain_price": _on_model_rows(lambda r: rounded(forests.mispricing(_plain_price(r), "PREDICTED", "DEVIATION"), 6, "R2")),
    }
