"""Joining locations to policies, and portfolio measures that need the join.

The join is many to many: an account with P policies and L locations has P*L merged rows. Only
`merge_exposure` builds those rows. Every aggregate over them is computed from one row per account
on each side instead: a location counts P times, a policy L times.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskbridge import schema as S
from riskbridge.functions.columns import location_ratios, policy_ratios, ratio
from riskbridge.functions.durable import durable
from riskbridge.functions.skew import attach, grid_join


def location_totals(loc: DataFrame, *extra: Column) -> DataFrame:
    """One row per account: LOCS, LOC_TIV and any further aggregates."""
    return loc.groupBy(*S.ACCOUNT).agg(F.count("LOCNUM").alias("LOCS"), F.sum("TIV_TOTAL").alias("LOC_TIV"), *extra)


def policy_totals(pol: DataFrame, *extra: Column) -> DataFrame:
    """One row per account: POLICIES and any further aggregates."""
    return pol.groupBy(*S.ACCOUNT).agg(F.count(F.lit(1)).alias("POLICIES"), *extra)


def first_policy() -> Column:
    """Aggregate: the account's first policy, in the order segment, policy number.

    Amounts end the order so that doubled policy numbers also have one first row.
    """
    return F.min(F.struct("SEGMENT", "POLICYNUM", "BLANPREAMT", "BLANLIMAMT"))


def account_rollup(
    loc: DataFrame, pol: DataFrame, loc_extra: list[Column] = (), pol_extra: list[Column] = ()
) -> DataFrame:
    """Accounts that have both locations and policies, with the totals of their merged rows."""
    return (
        location_totals(loc, *loc_extra)
        .join(policy_totals(pol, *pol_extra), S.ACCOUNT)
        .withColumns(
            {"ACCOUNT_TIV": F.col("LOC_TIV") * F.col("POLICIES"), "LOC_COUNT": F.col("LOCS") * F.col("POLICIES")}
        )
    )


def exposed_locations(loc: DataFrame, pol: DataFrame) -> DataFrame:
    """Locations of insured accounts; WEIGHT is the number of merged rows each stands for."""
    return attach(loc, policy_totals(pol).withColumnRenamed("POLICIES", "WEIGHT"), S.ACCOUNT)


def exposed_policies(loc: DataFrame, pol: DataFrame) -> DataFrame:
    """Policies of accounts with locations: ACCOUNT_TIV, LOC_COUNT and the merged rows as WEIGHT."""
    totals = account_rollup(loc, pol).select(*S.ACCOUNT, F.col("LOCS").alias("WEIGHT"), "ACCOUNT_TIV", "LOC_COUNT")
    return attach(pol, totals, S.ACCOUNT).withColumn(
        "RATE_ON_LINE_PCT", ratio(F.col("BLANPREAMT"), F.col("ACCOUNT_TIV"), 100)
    )


def merge_exposure(loc: DataFrame, pol: DataFrame, drop_blank_keys: bool = False, digits: dict[str, int] | None = None) -> DataFrame:
    """Policy and location rows joined on the account, with account totals and ratios.

    Blank account numbers match each other unless drop_blank_keys is set. Ratios are taken on the side they belong to, before rows
    multiply; `digits` rounds ACCOUNT_TIV and the policy's ratios there. Columns that an input lacks are left out.
    """
    if drop_blank_keys:
        loc, pol = loc.filter("ACCNTNUM != ''"), pol.filter("ACCNTNUM != ''")
    rollup = durable(account_rollup(loc, pol))  # one row per account, read three times
    totals = rollup.select(*S.ACCOUNT, "ACCOUNT_TIV", "LOC_COUNT")
    pol_cols = [c for c in S.MERGED_POLICY_COLUMNS if c in pol.columns and c not in S.ACCOUNT]
    loc_cols = [c for c in S.MERGED_LOCATION_COLUMNS if c in loc.columns]
    counts = rollup.select(*S.ACCOUNT, F.col("POLICIES").alias("_rows"))
    rich = policy_ratios(attach(pol.select(*S.ACCOUNT, *pol_cols), totals, S.ACCOUNT, counts))
    rich = rich.withColumns({c: F.round(c, n) for c, n in (digits or {}).items()})
    sized = location_ratios(loc.select(*S.ACCOUNT, *loc_cols))
    return grid_join(sized, rich, S.ACCOUNT, rollup, ("LOCS", "POLICIES")).select(
        *S.ACCOUNT, *pol_cols, *loc_cols,
        "ACCOUNT_TIV", "LOC_COUNT", "RATE_ON_LINE_PCT", "LIMIT_TO_TIV_RATIO", "TIV_PER_SQFT",
    )


def portfolio(merged: DataFrame) -> DataFrame:
    """Row counts and value per period and segment of merged rows."""
    return merged.groupBy(*S.EXTRACT).agg(
        F.count(F.lit(1)).alias("MERGED_ROWS"), F.sum("TIV_TOTAL").alias("TIV_TOTAL")
    )


def _presence(loc: DataFrame, pol: DataFrame) -> DataFrame:
    """Distinct accounts of each side in one row per account."""
    marks = loc.select(*S.ACCOUNT, F.lit(1).alias("_l"), F.lit(0).alias("_p")).unionByName(
        pol.select(*S.ACCOUNT, F.lit(0).alias("_l"), F.lit(1).alias("_p"))
    )
    return marks.groupBy(*S.ACCOUNT).agg(F.sum("_l").alias("LOC_ROWS"), F.sum("_p").alias("POL_ROWS"))


def account_sets(loc: DataFrame, pol: DataFrame) -> DataFrame:
    """Each account once, as COMMON, ORPHAN_LOCATION or ORPHAN_POLICY."""
    return _presence(loc, pol).select(
        *S.ACCOUNT,
        F.when(F.col("POL_ROWS") == 0, "ORPHAN_LOCATION")
        .when(F.col("LOC_ROWS") == 0, "ORPHAN_POLICY")
        .otherwise("COMMON")
        .alias("MEMBERSHIP"),
    )


def match_diagnostics(loc: DataFrame, pol: DataFrame) -> DataFrame:
    """Match rates, orphans, fan-out and blank keys per extract."""
    both = (F.col("LOC_ROWS") > 0) & (F.col("POL_ROWS") > 0)
    blank = F.col("ACCNTNUM") == ""

    def pct(a, b):
        return ratio(F.col(a), F.col(b), 100)

    return (
        _presence(loc, pol)
        .groupBy(*S.EXTRACT)
        .agg(
            F.count_if(F.col("POL_ROWS") > 0).alias("POLICY_ACCOUNTS"),
            F.count_if(F.col("LOC_ROWS") > 0).alias("LOCATION_ACCOUNTS"),
            F.count_if(both).alias("COMMON_ACCOUNTS"),
            F.count_if(F.col("POL_ROWS") == 0).alias("ORPHAN_LOCATION_ACCOUNTS"),
            F.count_if(F.col("LOC_ROWS") == 0).alias("ORPHAN_POLICY_ACCOUNTS"),
            F.sum(F.col("LOC_ROWS") * F.col("POL_ROWS")).alias("MERGED_ROWS"),
            F.max(F.when(both, F.col("POL_ROWS"))).alias("MAX_POLICIES_PER_ACCOUNT"),
            F.sum(F.when(blank, F.col("LOC_ROWS") + F.col("POL_ROWS")).otherwise(0)).alias("BLANK_KEY_ROWS"),
        )
        .withColumns(
            {
                "POLICY_MATCH_PCT": pct("COMMON_ACCOUNTS", "POLICY_ACCOUNTS"),
                "LOCATION_MATCH_PCT": pct("COMMON_ACCOUNTS", "LOCATION_ACCOUNTS"),
            }
        )
    )


def merged_financials(loc: DataFrame, pol: DataFrame) -> DataFrame:
    """Value, first premium and first limit per account, summed per extract, and their ratios."""
    tiv, prem, lim = F.col("TOTAL_TIV"), F.col("TOTAL_PREMIUM"), F.col("TOTAL_LIMIT")
    return (
        account_rollup(loc, pol, pol_extra=[first_policy().alias("FIRST")])
        .groupBy(*S.EXTRACT)
        .agg(
            F.sum("ACCOUNT_TIV").alias("TOTAL_TIV"),
            F.sum("FIRST.BLANPREAMT").alias("TOTAL_PREMIUM"),
            F.sum("FIRST.BLANLIMAMT").alias("TOTAL_LIMIT"),
            # LOC_COUNT appears on each of the account's LOC_COUNT rows
            (F.sum(F.col("LOC_COUNT") * F.col("LOC_COUNT")) / F.sum("LOC_COUNT")).alias("AVG_LOCS_PER_ACCOUNT"),
            (F.sum("ACCOUNT_TIV") / F.sum("LOC_COUNT")).alias("AVG_TIV_PER_LOC"),
        )
        .withColumns(
            {"PORTFOLIO_ROL_PCT": ratio(prem, tiv, 100), "LIMIT_TO_TIV_PCT": ratio(lim, tiv, 100)}
        )
    )


def by_location(loc: DataFrame, pol: DataFrame, dims: list[str], values: dict[str, Column]) -> DataFrame:
    """Sums over merged rows by columns of the location, with ROWS.

    Locations are added up per account and dimension first, so a large account reaches the join as
    a few rows. `dims` should be columns with few values per account.
    """
    parts = loc.groupBy(*S.ACCOUNT, *[d for d in dims if d not in S.ACCOUNT]).agg(
        F.count(F.lit(1)).alias("ROWS"), *[F.sum(c).alias(n) for n, c in values.items()]
    )
    times = F.col("POLICIES")
    return (
        parts.join(policy_totals(pol), S.ACCOUNT)
        .groupBy(*dims)
        .agg(F.sum(F.col("ROWS") * times).alias("ROWS"), *[F.sum(F.col(n) * times).alias(n) for n in values])
    )


def by_policy(loc: DataFrame, pol: DataFrame, dims: list[str]) -> DataFrame:
    """Rows, value and premium over merged rows by columns of the policy, with distinct accounts."""
    parts = pol.groupBy(*S.ACCOUNT, *[d for d in dims if d not in S.ACCOUNT]).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("BLANPREAMT").alias("_prem")
    )
    return (
        parts.join(location_totals(loc), S.ACCOUNT)
        .groupBy(*dims)
        .agg(
            F.sum(F.col("_n") * F.col("LOCS")).alias("ROWS"),
            F.sum(F.col("_n") * F.col("LOC_TIV")).alias("TIV"),
            F.sum(F.col("_prem") * F.col("LOCS")).alias("PREMIUM"),
            F.count_distinct("ACCNTNUM").alias("ACCOUNTS"),
        )
    )


def hhi(loc: DataFrame, pol: DataFrame, column: str = "STATE") -> DataFrame:
    """Concentration of value over a location column per extract, and its largest member."""
    shares = by_location(loc, pol, [*S.EXTRACT, column], {"TIV": F.col("TIV_TOTAL")})
    # one row per extract and member from here on
    totals = shares.groupBy(*S.EXTRACT).agg(F.sum("TIV").alias("_all"))
    share = F.col("TIV") / F.col("_all") * 100
    top = F.min(F.struct((-F.col("TIV")).alias("_order"), F.col(column).alias("_name")))
    return (
        shares.join(totals.filter("_all > 0"), S.EXTRACT)
        .groupBy(*S.EXTRACT)
        .agg(
            F.sum(share * share).alias("HHI"),
            top.getField("_name").alias("TOP_MEMBER"),
            F.max(share).alias("TOP_SHARE_PCT"),
        )
    )


def valuation_flags(loc: DataFrame, pol: DataFrame, low: float = 50.0, high: float = 1500.0) -> DataFrame:
    """Locations flagged by value per square foot, counted as merged rows per extract."""
    psf = ratio(F.col("TIV_TOTAL"), F.col("FLOORAREA"))
    flag = (
        F.when(F.col("FLOORAREA") <= 0, "NO AREA").when(psf < low, "LOW").when(psf > high, "HIGH").otherwise("NORMAL")
    )
    return by_location(
        loc.withColumn("VALUATION", flag), pol, [*S.EXTRACT, "VALUATION"], {"TIV": F.col("TIV_TOTAL")}
    )


def rate_on_limit(pol: DataFrame) -> DataFrame:
    """Premium over blanket limit of each policy, in percent."""
    return pol.withColumn("RATE_ON_LIMIT_PCT", ratio(F.col("BLANPREAMT"), F.col("BLANLIMAMT"), 100))
