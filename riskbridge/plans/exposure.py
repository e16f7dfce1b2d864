"""The whole analysis over a catalog of extracts."""

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskbridge import schema as S
from riskbridge.functions.columns import table_kind
from riskbridge.functions.durable import scratch_dir, durable
from riskbridge.functions.order import sample_n
from riskbridge.operators import clusters, features, forests, merge, mom, neural, profile, stats
from riskbridge.operators.features import ROW_KEYS
from riskbridge.sources.ingest import Extract, land, load_catalog, register, stack
from riskbridge.sources.sinks import write_audit

# Short names of segments in view names.
SEGMENT_VIEWS = {S.COMMERCIAL: "com", S.STANDARD: "std"}


class Exposure:
    """Two months of extracts as DataFrames and SQL views.

    Views: one per extract; merged_<period>_<segment>, portfolio_<period> after merge();
    drift_state_mom and drift_lob_mom after compare().
    """

    def __init__(self, spark: SparkSession, extracts: Iterable[Extract], land_at: str | None = None):
        self.spark = spark
        self.extracts = list(extracts)
        self.land_at = land_at
        self.raw: dict[str, DataFrame] = {}
        self.tables: dict[str, DataFrame] = {}
        self.loc: DataFrame | None = None
        self.pol: DataFrame | None = None
        self.results: dict[str, dict[str, DataFrame]] = {}

    def load(self) -> "Exposure":
        for name, (raw, table) in load_catalog(self.spark, self.extracts).items():
            self.raw[name], self.tables[name] = raw, register(name, table)
        root = self.land_at or f"{scratch_dir(self.spark)}/riskbridge-landed-{uuid.uuid4().hex}"
        self.loc = land(stack(self.extracts, self.tables, "Location"), f"{root}/locations")
        self.pol = land(stack(self.extracts, self.tables, "Policy"), f"{root}/policies")
        return self

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text)

    def _width(self, kind: str) -> int:
        return max(len(t.columns) for t in self.tables.values() if table_kind(t) == kind)

    def profile(self) -> dict[str, DataFrame]:
        loc, pol = self.loc, self.pol
        gaps = [
            profile.missingness(x.tag(self.raw[x.name]), len(self.tables[x.name].columns)).withColumn("DATASET", F.lit(x.name))
            for x in self.extracts
        ]
        missing = gaps[0]
        for g in gaps[1:]:
            missing = missing.unionByName(g)
        return {
            "summary": profile.eda_summary(loc, pol, self._width("Location"), self._width("Policy")),
            "location_keys": profile.key_integrity(loc),
            "policy_keys": profile.key_integrity(pol),
            "missingness": missing,
            "locations": profile.profile_locations(loc),
            "policies": profile.profile_policies(pol),
            "coverage": profile.coverage_split(loc),
            "physical": profile.physical_profile(loc),
            "eras": profile.construction_eras(loc),
            "geocoding": profile.geocode_quality(loc),
            "location_values": profile.top_values(loc),
            "policy_values": profile.top_values(pol),
        }

    def merge(self) -> dict[str, DataFrame]:
        loc, pol = self.loc, self.pol
        merged = merge.merge_exposure(loc, pol)
        for period in (S.PRIOR, S.CURRENT):
            rows = register(f"portfolio_{period}", merged.filter(F.col("PERIOD") == period))
            for segment, short in SEGMENT_VIEWS.items():
                register(f"merged_{period}_{short}", rows.filter(F.col("SEGMENT") == segment))
        return {
            "merged": merged,
            "match": merge.match_diagnostics(loc, pol),
            "financials": merge.merged_financials(loc, pol),
            "hhi": merge.hhi(loc, pol),
            "valuation": merge.valuation_flags(loc, pol),
        }

    def compare(self) -> dict[str, DataFrame]:
        loc, pol = self.loc, self.pol
        return {
            "kpis": mom.kpi_comparison(loc, pol),
            "rollforward": mom.rollforward(loc, pol),
            "waterfall_tiv": mom.waterfall(loc, pol, "TIV"),
            "waterfall_premium": mom.waterfall(loc, pol, "PREMIUM"),
            "state_drift": register("drift_state_mom", mom.exposure_drift(loc, pol, "STATE")),
            "lob_drift": register("drift_lob_mom", mom.exposure_drift(loc, pol, "LOBNAME")),
            "cedant_drift": mom.exposure_drift(loc, pol, "CEDANTNAME"),
            "producer_drift": mom.exposure_drift(loc, pol, "PRODNAME"),
        }

    def sql_reports(self) -> dict[str, DataFrame]:
        return {
            "top_accounts": mom.top_accounts(self.loc, self.pol),
            "lob_rollforward": mom.lob_rollforward(self.loc, self.pol),
            "lob_rollforward_full": mom.lob_rollforward(self.loc, self.pol, keep_lapsed=True),
            "coverage_by_state": mom.coverage_by_state(self.loc, self.pol),
        }

    def statistics(self) -> dict[str, DataFrame]:
        return {
            "tail_risk": stats.tail_risk(self.loc, self.pol),
            "ep_curve": stats.ep_curve(self.loc, self.pol),
            "drift_matrix": stats.drift_matrix(self.loc, self.pol),
            "stress": stats.stress_tests(self.loc, self.pol),
            "rate_density": stats.rate_density(self.loc, self.pol),
        }

    def models(self) -> dict[str, DataFrame]:
        """All models of the current period, and the shift between the periods."""
        both = features.model_rows(self.loc, self.pol, None)
        rows = durable(both.filter(F.col("PERIOD") == S.CURRENT))
        inputs = clusters.risk_inputs(rows)
        clustered = clusters.risk_clusters(rows, inputs=inputs)
        deep = neural.autoencoder_scores(rows)
        isolated = forests.isolation_forest(rows)
        priced = neural.neural_pricing(rows)
        benchmark = forests.benchmark_premium(rows)
        return {
            "clusters": clustered,
            "cluster_profiles": clusters.cluster_profiles(clustered),
            "pca": clusters.pca_2d(clustered, inputs),
            "pca_variance": clusters.pca_variance(rows, inputs),
            "silhouette": clusters.silhouette(clustered, inputs=inputs),
            "geo_zones": clusters.geo_zones(rows),
            "autoencoder": deep,
            "isolation_forest": isolated,
            "anomalies": neural.anomalies(deep, isolated),
            "neural_pricing": priced,
            "mispricing": forests.mispricing(priced, "NEURAL_PREDICTED_PREM", "NEURAL_DEV_PCT"),
            "benchmark_premium": benchmark,
            "benchmark_fit": forests.mispricing(benchmark, "BENCHMARK_PREMIUM", "PRICING_DEVIATION_PCT"),
            "covariate_shift": forests.covariate_shift(both),
        }

    def charts(self, models: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """The data behind the charts that other results do not hold already."""
        deep, priced = models["autoencoder"], models["neural_pricing"]
        return {
            "states": mom.chart_states(self.loc, self.pol),
            "coverage": mom.coverage_by_period(self.loc, self.pol),
            "rate_curve": stats.kernel_density(
                merge.exposed_policies(self.loc, self.pol), ["PERIOD"], "RATE_ON_LINE_PCT", "WEIGHT"
            ),
            "classes": mom.top_class_exposure(self.loc, self.pol),
            "mse_histogram": stats.histogram(deep.withColumn("ALL", F.lit(1)), ["ALL"], "AUTOENCODER_MSE", 40).drop("ALL"),
            "premium_sample": sample_n(priced.select(*ROW_KEYS, "NEURAL_PREDICTED_PREM", "BLANPREAMT"), 5000, ROW_KEYS),
            "anomaly_sample": sample_n(
                models["isolation_forest"].select(*ROW_KEYS, "FLOORAREA", "TIV_TOTAL", "ANOMALY_LABEL"), 5000, ROW_KEYS
            ),
            "pca_sample": sample_n(models["pca"].select(*ROW_KEYS, "CLUSTER_ID", "PCA1", "PCA2"), 5000, ROW_KEYS),
        }

    def run(self, out: str) -> dict[str, bool]:
        """Everything: all frames by part and name in `results`, and the audit files under `out`; which files were written."""
        self.load()
        months, figures, models = self.compare(), self.statistics(), self.models()
        self.results = {
            "profile": self.profile(), "merge": self.merge(), "months": months, "sql": self.sql_reports(),
            "statistics": figures, "models": models, "charts": self.charts(models),
        }
        return {
            "anomalies_audit": write_audit(models["anomalies"], f"{out}/anomalies_audit", skip_empty=True),
            "statistical_drift": write_audit(figures["drift_matrix"], f"{out}/statistical_drift"),
            "cat_zones": write_audit(models["geo_zones"], f"{out}/cat_zones", skip_empty=True),
            "state_drift": write_audit(months["state_drift"], f"{out}/state_drift"),
            "kpi_comparison": write_audit(months["kpis"], f"{out}/kpi_comparison"),
        }
