"""Model features of merged rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskbridge import schema as S
from riskbridge.functions.durable import durable
from riskbridge.functions.order import quantiles
from riskbridge.operators.merge import by_location, merge_exposure

# The inputs of the models.
RISK_FEATURES = ["TIV_TOTAL", "BLANPREAMT", "FLOORAREA", "NUMSTORIES", "AGE", "TIV_PER_SQFT", "RATE_ON_LINE_BPS"]
PRICING_FEATURES = ["TIV_TOTAL", "FLOORAREA", "NUMSTORIES", "AGE", "STORIES_AREA_INTERACTION"]
BENCHMARK_FEATURES = ["TIV_TOTAL", "FLOORAREA", "NUMSTORIES", "AGE"]
ROW_KEYS = [*S.EXTRACT, "ACCNTNUM", "POLICYNUM", "LOCNUM"]
# What the feature table needs of each input.
LOCATION_INPUTS = ["LOCNUM", "STATE", "BLDGCLASS", "LATITUDE", "LONGITUDE", "YEARBUILT", "FLOORAREA", "NUMSTORIES", "TIV_TOTAL"]
POLICY_INPUTS = ["POLICYNUM", "BLANPREAMT", "BLANLIMAMT"]
EXTRA = ["STATE", "BLDGCLASS", "LATITUDE", "LONGITUDE", "STORIES_AREA_INTERACTION"]
DEFAULT_YEAR = 1995.0
MIN_ROWS = 5


def features(loc: DataFrame, pol: DataFrame, period: str | None = S.CURRENT, as_of: int = 2026) -> DataFrame:
    """Merged rows with AGE, RATE_ON_LINE_BPS and STORIES_AREA_INTERACTION.

    A year before 1800 is replaced by the period's median valid year. The median comes from
    the merged rows per year, added up by account, so the merged rows themselves are built once.
    """
    if period is not None:
        loc, pol = (df.filter(F.col("PERIOD") == period) for df in (loc, pol))
    years = durable(by_location(loc.filter("YEARBUILT > 1800"), pol, ["PERIOD", "YEARBUILT"], {}))  # one row per period and year
    medians = quantiles(years, ["PERIOD"], "YEARBUILT", {"_median": 0.5}, "ROWS")  # one row per period
    year = F.when(F.col("YEARBUILT") < 1800, F.coalesce("_median", F.lit(DEFAULT_YEAR))).otherwise(F.col("YEARBUILT"))
    return (
        merge_exposure(loc, pol)
        .join(F.broadcast(medians), "PERIOD", "left")
        .withColumns(
            {
                "AGE": F.least(F.greatest(F.lit(float(as_of)) - year, F.lit(0.0)), F.lit(150.0)),
                "RATE_ON_LINE_BPS": F.col("RATE_ON_LINE_PCT") * 100,
                "STORIES_AREA_INTERACTION": F.col("NUMSTORIES") * F.log1p("FLOORAREA"),
            }
        )
        .drop("_median")
    )


def model_rows(loc: DataFrame, pol: DataFrame, period: str | None = S.CURRENT, extra: list[str] = EXTRA, inputs: list[str] = RISK_FEATURES) -> DataFrame:
    """The feature table that models read many times, written once in the shared folder."""
    return durable(features(loc, pol, period).select(*ROW_KEYS, *extra, *inputs).fillna(0.0))


def too_few(rows: DataFrame, least: int = MIN_ROWS) -> bool:
    return rows.limit(least).count() < least


def nothing(rows: DataFrame, **added: str) -> DataFrame:
    """No rows, with the columns a model would have added."""
    return rows.limit(0).withColumns({n: F.lit(None).cast(t) for n, t in added.items()})
