"""Quality profiles of single extracts. Grouped by period and segment, so all extracts share a pass."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskbridge import schema as S
from riskbridge.functions.columns import ratio, table_kind
from riskbridge.functions.order import quantiles

# First and last year of each construction era (None: open).
ERAS = {"PRE_1980": (1800, 1980), "FROM_1980": (1980, 1995), "FROM_1995": (1995, 2002), "FROM_2002": (2002, None)}
# Category columns profiled per kind of table.
LOCATION_CATEGORIES = ["BLDGCLASS", "OCCTYPE", "ROOFSYS", "ROOFGEOM", "ROOFANCH", "CLADSYS", "RESISTOPEN", "STATE"]
POLICY_CATEGORIES = ["LOBNAME", "CEDANTNAME", "PRODNAME", "POLICYTYPE"]


def entity(df: DataFrame) -> str:
    return "LOCNUM" if table_kind(df) == "Location" else "POLICYNUM"


def key_integrity(df: DataFrame) -> DataFrame:
    """Whether (account, entity) is a key, how many keys collide, and distinct counts."""
    keys = df.groupBy(*S.ACCOUNT, F.col(entity(df)).alias("ENTITY")).agg(F.count(F.lit(1)).alias("_n"))
    return keys.groupBy(*S.EXTRACT).agg(
        F.sum("_n").alias("ROWS"),
        F.count(F.lit(1)).alias("DISTINCT_KEYS"),
        F.count_if(F.col("_n") > 1).alias("COLLIDING_KEYS"),
        (F.max("_n") == 1).alias("KEY_UNIQUE"),
        F.count_distinct("ACCNTNUM").alias("UNIQUE_ACCOUNTS"),
        F.count_distinct("ENTITY").alias("UNIQUE_ENTITIES"),
    )


def missingness(raw: DataFrame, width: int | None = None) -> DataFrame:
    """Nulls per column of raw extracts, most first, with the totals of the extract.

    `width` is the number of columns after normalising, the base of the total percentage.
    """
    cols = [c for c in raw.columns if c not in S.EXTRACT]
    width = width or len(cols)
    counts = raw.groupBy(*S.EXTRACT).agg(
        F.count(F.lit(1)).alias("ROWS"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols]
    )
    whole = W.partitionBy(*S.EXTRACT)
    # one row per extract and column
    return (
        counts.unpivot([*S.EXTRACT, "ROWS"], cols, "COLUMN_NAME", "NULLS")
        .filter("NULLS > 0")
        .withColumns(
            {
                "NULL_PCT": ratio(F.col("NULLS"), F.col("ROWS"), 100),
                "TOTAL_NULLS": F.sum("NULLS").over(whole),
                "COLUMNS_WITH_NULLS": F.count(F.lit(1)).over(whole),
            }
        )
        .withColumn("TOTAL_NULL_PCT", ratio(F.col("TOTAL_NULLS"), F.col("ROWS") * width, 100))
        .orderBy(*S.EXTRACT, F.desc("NULLS"), "COLUMN_NAME")
    )


def _value_profile(df: DataFrame, column: str, name: str, probs: dict[str, float]) -> DataFrame:
    c = F.col(column)
    moments = df.groupBy(*S.EXTRACT).agg(
        F.count(F.lit(1)).alias("ROWS"),
        F.sum(c).alias(f"TOTAL_{name}"),
        F.avg(c).alias(f"MEAN_{name}"),
        F.max(c).alias(f"MAX_{name}"),
    )
    points = quantiles(df, S.EXTRACT, column, {f"{k}_{name}": p for k, p in probs.items()})
    return moments.join(points, S.EXTRACT)


def profile_locations(loc: DataFrame) -> DataFrame:
    """Total, mean, median, 90th and 99th percentile and maximum of the insured value."""
    return _value_profile(loc, "TIV_TOTAL", "TIV", {"MEDIAN": 0.5, "P90": 0.9, "P99": 0.99})


def profile_policies(pol: DataFrame) -> DataFrame:
    """Premium distribution, limits and the aggregate rate on limit."""
    limits = pol.groupBy(*S.EXTRACT).agg(F.sum("BLANLIMAMT").alias("TOTAL_LIMIT"), F.avg("BLANLIMAMT").alias("MEAN_LIMIT"))
    return (
        _value_profile(pol, "BLANPREAMT", "PREMIUM", {"MEDIAN": 0.5, "P90": 0.9})
        .join(limits, S.EXTRACT)
        .withColumn("RATE_ON_LIMIT_PCT", ratio(F.col("TOTAL_PREMIUM"), F.col("TOTAL_LIMIT"), 100))
    )


def coverage_split(loc: DataFrame) -> DataFrame:
    """Windstorm value by coverage and its share of the total insured value."""
    sums = loc.groupBy(*S.EXTRACT).agg(
        F.sum("TIV_TOTAL").alias("TOTAL_TIV"), *[F.sum(c).alias(c) for c in S.WS_VALUES]
    )
    return sums.withColumns({f"{c}_PCT": ratio(F.col(c), F.col("TOTAL_TIV"), 100) for c in S.WS_VALUES})


def physical_profile(loc: DataFrame) -> DataFrame:
    """Mean floor area and stories, and the mean of valid years built, cut to a whole year."""
    year = F.col("YEARBUILT")
    return loc.groupBy(*S.EXTRACT).agg(
        F.avg("FLOORAREA").alias("MEAN_FLOOR_AREA"),
        F.avg("NUMSTORIES").alias("MEAN_STORIES"),
        F.avg(F.when(year > 1800, year)).cast("int").alias("MEAN_YEAR_BUILT"),
    )


def _in_era(first: int, last: int | None) -> Column:
    year = F.col("YEARBUILT")
    # 1800 itself counts as unknown
    begun = year > first if first == 1800 else year >= first
    return begun if last is None else begun & (year < last)


def construction_eras(loc: DataFrame) -> DataFrame:
    """Locations per construction era, and their share of all rows."""
    rows = F.count(F.lit(1))
    aggs = []
    for name, (first, last) in ERAS.items():
        n = F.count_if(_in_era(first, last))
        aggs += [n.alias(name), (n / rows * 100).alias(f"{name}_PCT")]
    return loc.groupBy(*S.EXTRACT).agg(rows.alias("ROWS"), *aggs)


def geocode_quality(loc: DataFrame) -> DataFrame:
    """Valid and zero coordinates, and their range."""
    lat, lon = F.col("LATITUDE"), F.col("LONGITUDE")
    valid = F.count_if(lat.between(-90, 90) & lon.between(-180, 180) & (lat != 0))
    rows = F.count(F.lit(1))
    return loc.groupBy(*S.EXTRACT).agg(
        rows.alias("ROWS"),
        valid.alias("VALID_COORDINATES"),
        (valid / rows * 100).alias("VALID_PCT"),
        F.count_if((lat == 0) | (lon == 0)).alias("ZERO_COORDINATES"),
        F.min(lat).alias("MIN_LATITUDE"),
        F.max(lat).alias("MAX_LATITUDE"),
        F.min(lon).alias("MIN_LONGITUDE"),
        F.max(lon).alias("MAX_LONGITUDE"),
    )


def top_values(df: DataFrame, n: int = 3) -> DataFrame:
    """Most frequent values of each category column; blanks take a place and are then dropped."""
    known = LOCATION_CATEGORIES if table_kind(df) == "Location" else POLICY_CATEGORIES
    cats = [c for c in known if c in df.columns]
    order = W.partitionBy(*S.EXTRACT, "CATEGORY").orderBy(F.desc("ROWS"), "VALUE")
    return (
        df.select(*S.EXTRACT, *cats)
        .unpivot(S.EXTRACT, cats, "CATEGORY", "VALUE")
        .filter("VALUE is not null")
        .groupBy(*S.EXTRACT, "CATEGORY", "VALUE")
        .agg(F.count(F.lit(1)).alias("ROWS"))
        .withColumn("POSITION", F.row_number().over(order))
        .filter((F.col("POSITION") <= n) & (F.trim("VALUE") != ""))
    )


def eda_summary(loc: DataFrame, pol: DataFrame, loc_width: int, pol_width: int) -> DataFrame:
    """One row per extract and kind; measures of the other kind are null."""

    def part(df, kind, width, *aggs):
        return df.groupBy(*S.EXTRACT).agg(
            F.lit(kind).alias("TYPE"),
            F.count(F.lit(1)).alias("ROWS"),
            F.lit(width).alias("COLS"),
            F.count_distinct("ACCNTNUM").alias("UNIQUE_ACCOUNTS"),
            F.count_distinct(entity(df)).alias("UNIQUE_ENTITIES"),
            *aggs,
        )

    return part(
        loc, "Location", loc_width, F.sum("TIV_TOTAL").alias("TOTAL_TIV_USD"), F.avg("TIV_TOTAL").alias("MEAN_TIV_USD")
    ).unionByName(
        part(
            pol,
            "Policy",
            pol_width,
            F.sum("BLANPREAMT").alias("TOTAL_PREMIUM_USD"),
            F.sum("BLANLIMAMT").alias("TOTAL_LIMIT_USD"),
        ),
        allowMissingColumns=True,
    )
