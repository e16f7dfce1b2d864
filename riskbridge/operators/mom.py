"""One month against the next: KPIs, roll-forward, bridges and drift."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskbridge import schema as S
from riskbridge.functions.columns import growth_pct, ratio
from riskbridge.functions.skew import attach
from riskbridge.operators.merge import account_rollup, by_location, by_policy, first_policy, policy_totals

# The portfolio measures, in report order.
KPI_NAMES = [
    "Total_Accounts", "Total_Policies", "Total_Locations", "Total_TIV_USD", "Total_Premium_USD", "Total_Limit_USD",
    "Mean_TIV_per_Loc_USD", "Mean_Prem_per_Acc_USD", "Portfolio_RoL_Pct",
]


def _accounts_by_period(loc: DataFrame, pol: DataFrame) -> DataFrame:
    """One row per period and account over both segments."""
    return (
        account_rollup(loc, pol, pol_extra=[first_policy().alias("FIRST")])
        .groupBy("PERIOD", "ACCNTNUM")
        .agg(
            F.sum("ACCOUNT_TIV").alias("TIV"),
            F.sum("LOC_COUNT").alias("ROWS"),
            F.min("FIRST").alias("FIRST"),  # commercial sorts before standard
        )
    )


def account_first(loc: DataFrame, pol: DataFrame) -> DataFrame:
    """One row per period and account with its first policy's premium and limit."""
    return _accounts_by_period(loc, pol).select(
        "PERIOD", "ACCNTNUM", "TIV", "ROWS",
        F.col("FIRST.POLICYNUM").alias("POLICYNUM"),
        F.col("FIRST.BLANPREAMT").alias("PREMIUM"),
        F.col("FIRST.BLANLIMAMT").alias("LIMIT"),
    )


def kpis(loc: DataFrame, pol: DataFrame) -> DataFrame:
    """One row of portfolio measures per period."""
    money = account_first(loc, pol).groupBy("PERIOD").agg(
        F.count(F.lit(1)).alias("Total_Accounts"),
        F.sum("TIV").alias("Total_TIV_USD"),
        F.sum("PREMIUM").alias("Total_Premium_USD"),
        F.sum("LIMIT").alias("Total_Limit_USD"),
        (F.sum("TIV") / F.sum("ROWS")).alias("Mean_TIV_per_Loc_USD"),
        F.avg("PREMIUM").alias("Mean_Prem_per_Acc_USD"),
    )
    with_loc = attach(pol.select(*S.ACCOUNT, "POLICYNUM"), loc.select(*S.ACCOUNT).distinct(), S.ACCOUNT)
    with_pol = attach(loc.select(*S.ACCOUNT, "LOCNUM"), policy_totals(pol).select(*S.ACCOUNT), S.ACCOUNT)
    pols = with_loc.groupBy("PERIOD").agg(F.count_distinct("POLICYNUM").alias("Total_Policies"))
    locs = with_pol.groupBy("PERIOD").agg(
        F.count_distinct("LOCNUM").alias("Total_Locations"),
        F.count_distinct("ACCNTNUM", "LOCNUM").alias("Total_Location_Keys"),
    )
    return (
        money.join(pols, "PERIOD")
        .join(locs, "PERIOD")
        .withColumn("Portfolio_RoL_Pct", ratio(F.col("Total_Premium_USD"), F.col("Total_TIV_USD"), 100))
        .select("PERIOD", *KPI_NAMES, "Total_Location_Keys")
    )


def kpi_comparison(loc: DataFrame, pol: DataFrame) -> DataFrame:
    """KPIs as rows, both periods as columns, with change and growth."""
    table = kpis(loc, pol).select("PERIOD", *[F.col(k).cast("double").alias(k) for k in KPI_NAMES])
    prior, curr = F.col("PRIOR_VALUE"), F.col("CURRENT_VALUE")
    return (
        table.unpivot(["PERIOD"], KPI_NAMES, "KPI", "VALUE")
        .groupBy("KPI")
        .agg(
            F.max(F.when(F.col("PERIOD") == S.PRIOR, F.col("VALUE"))).alias("PRIOR_VALUE"),
            F.max(F.when(F.col("PERIOD") == S.CURRENT, F.col("VALUE"))).alias("CURRENT_VALUE"),
        )
        .withColumns(
            {
                "DELTA": curr - prior,
                "GROWTH_PCT": F.when(prior != 0, (curr - prior) / prior * 100).otherwise(F.lit(0.0)),
            }
        )
    )


def _movements(loc: DataFrame, pol: DataFrame) -> DataFrame:
    """One row per account: value and first premium in each period, null where it is absent."""
    prior, curr = F.col("PERIOD") == S.PRIOR, F.col("PERIOD") == S.CURRENT
    return account_first(loc, pol).groupBy("ACCNTNUM").agg(
        F.max(F.when(prior, F.col("TIV"))).alias("PRIOR_TIV"),
        F.max(F.when(curr, F.col("TIV"))).alias("CURR_TIV"),
        F.max(F.when(prior, F.col("PREMIUM"))).alias("PRIOR_PREMIUM"),
        F.max(F.when(curr, F.col("PREMIUM"))).alias("CURR_PREMIUM"),
    )


def _status() -> dict[str, Column]:
    was, is_ = F.col("PRIOR_TIV").isNotNull(), F.col("CURR_TIV").isNotNull()
    return {"baseline": was, "lapsed": was & ~is_, "retained": was & is_, "new": is_ & ~was, "ending": is_}


def rollforward(loc: DataFrame, pol: DataFrame) -> DataFrame:
    """Accounts kept, lost and won, and their rates on the prior number."""
    on = _status()
    counts = _movements(loc, pol).agg(
        F.count_if(on["baseline"]).alias("BASELINE_ACCOUNTS"),
        F.count_if(on["lapsed"]).alias("LAPSED_ACCOUNTS"),
        F.count_if(on["retained"]).alias("RETAINED_ACCOUNTS"),
        F.count_if(on["new"]).alias("NEW_ACCOUNTS"),
        F.count_if(on["ending"]).alias("ENDING_ACCOUNTS"),
    )
    base = F.greatest(F.col("BASELINE_ACCOUNTS"), F.lit(1))
    return counts.withColumns(
        {
            "CHURN_PCT": F.col("LAPSED_ACCOUNTS") / base * 100,
            "RETENTION_PCT": F.col("RETAINED_ACCOUNTS") / base * 100,
            "INFLOW_PCT": F.col("NEW_ACCOUNTS") / base * 100,
            "NET_CHANGE": F.col("ENDING_ACCOUNTS") - F.col("BASELINE_ACCOUNTS"),
        }
    )


def waterfall(loc: DataFrame, pol: DataFrame, measure: str = "TIV") -> DataFrame:
    """Bridge from the prior to the current total: five steps, then net change in value and percent."""
    prior, curr, on = F.col(f"PRIOR_{measure}"), F.col(f"CURR_{measure}"), _status()

    def total(c, when=None):
        return F.coalesce(F.sum(c if when is None else F.when(when, c)), F.lit(0.0))

    sums = _movements(loc, pol).agg(
        total(prior).alias("BASELINE"),
        (-total(prior, on["lapsed"])).alias("LAPSED"),
        total(curr, on["new"]).alias("NEW"),
        (total(curr, on["retained"]) - total(prior, on["retained"])).alias("RETAINED_DRIFT"),
        total(curr).alias("ENDING"),
    )
    change = F.col("ENDING") - F.col("BASELINE")
    steps = ["BASELINE", "LAPSED", "NEW", "RETAINED_DRIFT", "ENDING", "NET_CHANGE", "NET_CHANGE_PCT"]
    return (
        sums.withColumns({"NET_CHANGE": change, "NET_CHANGE_PCT": F.when(F.col("BASELINE") > 0, change / F.col("BASELINE") * 100)})
        .unpivot([], steps, "STEP", "AMOUNT")
        .withColumn("MEASURE", F.lit(measure))
        .select("MEASURE", "STEP", "AMOUNT")
    )


def exposure_drift(loc: DataFrame, pol: DataFrame, key: str) -> DataFrame:
    """Value and merged rows by a location or policy column in both periods, largest current first.

    A member of one period only counts as 0 in the other.
    """
    if key in loc.columns and key not in S.MERGED_POLICY_COLUMNS:
        sums = by_location(loc, pol, ["PERIOD", key], {"TIV": F.col("TIV_TOTAL")})
    else:
        sums = by_policy(loc, pol, ["PERIOD", key])

    def of(period, column):
        zero = F.lit(0.0) if column == "TIV" else F.lit(0)
        return F.coalesce(F.sum(F.when(F.col("PERIOD") == period, F.col(column))), zero)

    prior, curr = F.col("PRIOR_TIV"), F.col("CURR_TIV")
    return (
        sums.groupBy(key)
        .agg(
            of(S.PRIOR, "TIV").alias("PRIOR_TIV"),
            of(S.PRIOR, "ROWS").alias("PRIOR_LOCS"),
            of(S.CURRENT, "TIV").alias("CURR_TIV"),
            of(S.CURRENT, "ROWS").alias("CURR_LOCS"),
        )
        .withColumns(
            {
                "TIV_DELTA": curr - prior,
                "TIV_GROWTH_PCT": growth_pct(curr, prior),
                "LOC_DELTA": F.col("CURR_LOCS") - F.col("PRIOR_LOCS"),
            }
        )
        .orderBy(F.desc("CURR_TIV"), key)
    )


def coverage_by_period(loc: DataFrame, pol: DataFrame) -> DataFrame:
    """Windstorm value by coverage and period over merged rows, in millions."""
    sums = account_rollup(loc, pol, loc_extra=[F.sum(c).alias(c) for c in S.WS_VALUES])
    return (
        sums.groupBy("PERIOD")
        .agg(*[(F.sum(F.col(c) * F.col("POLICIES")) / 1e6).alias(c) for c in S.WS_VALUES])
        .unpivot(["PERIOD"], S.WS_VALUES, "COVERAGE", "VALUE_MUSD")
    )


def chart_states(loc: DataFrame, pol: DataFrame, n: int = 7) -> DataFrame:
    """The largest states now, with both periods' value in millions."""
    return (
        exposure_drift(loc, pol, "STATE")
        .limit(n)
        .select("STATE", (F.col("PRIOR_TIV") / 1e6).alias("PRIOR_MUSD"), (F.col("CURR_TIV") / 1e6).alias("CURR_MUSD"))
    )


def top_class_exposure(loc: DataFrame, pol: DataFrame, n: int = 5) -> DataFrame:
    """The classes with most merged rows now, and their value per period in millions."""
    drift = exposure_drift(loc, pol, "BLDGCLASS")
    return (
        drift.filter("CURR_LOCS > 0")
        .orderBy(F.desc("CURR_LOCS"), "BLDGCLASS")
        .limit(n)
        .select(
            "BLDGCLASS",
            F.col("CURR_LOCS").alias("CURR_ROWS"),
            (F.col("PRIOR_TIV") / 1e6).alias("PRIOR_MUSD"),
            (F.col("CURR_TIV") / 1e6).alias("CURR_MUSD"),
        )
    )


def coverage_by_state(loc: DataFrame, pol: DataFrame) -> DataFrame:
    """Windstorm value by state, period and coverage over merged rows."""
    return by_location(loc, pol, ["PERIOD", "STATE"], {c: F.col(c) for c in S.WS_VALUES + ["TIV_TOTAL"]})


def top_accounts(loc: DataFrame, pol: DataFrame, n: int = 5, period: str = S.CURRENT) -> DataFrame:
    """Account and policy-term groups with the largest value, ranked; equal values share a rank.

    An account whose policies differ in terms shows up once per set of terms, each with the
    account's whole value per policy.
    """
    terms = ["ACCNTNAME", "PRODNAME", "CEDANTNAME", "LOBNAME", "BLANPREAMT", "BLANLIMAMT"]
    now = F.col("PERIOD") == period
    groups = pol.filter(now).groupBy(*S.ACCOUNT, *terms).agg(F.count(F.lit(1)).alias("_n"))
    values = loc.filter(now).groupBy(*S.ACCOUNT).agg(
        F.count("LOCNUM").alias("_locs"), F.sum("TIV_TOTAL").alias("_tiv"), F.max("TIV_TOTAL").alias("_max")
    )
    # an account may have any number of terms; the segment is no part of the group
    totals = (
        attach(groups, values, S.ACCOUNT)
        .groupBy("ACCNTNUM", *terms)
        .agg(
            F.sum(F.col("_n") * F.col("_locs")).alias("TOTAL_LOCATIONS"),
            F.round(F.sum(F.col("_n") * F.col("_tiv")), 2).alias("AGGREGATE_TIV"),
            F.max("_max").alias("MAX_LOC_TIV"),
        )
    )
    # ranks of the first n need no window over all accounts
    first = totals.orderBy(F.desc("AGGREGATE_TIV"), "BLANPREAMT", "ACCNTNUM").limit(n)
    return first.select(
        "ACCNTNUM", "ACCNTNAME", "PRODNAME", "CEDANTNAME", "TOTAL_LOCATIONS", "AGGREGATE_TIV",
        F.try_divide("AGGREGATE_TIV", "TOTAL_LOCATIONS").alias("MEAN_LOC_TIV"),
        "MAX_LOC_TIV",
        F.col("BLANPREAMT").alias("BLANKET_PREMIUM"),
        F.round(F.col("BLANPREAMT") / F.nullif("AGGREGATE_TIV", F.lit(0)) * 100, 4).alias("RATE_ON_LINE_PCT"),
        F.expr("rank() over (order by AGGREGATE_TIV desc)").alias("TIV_RANK"),
    )


def lob_rollforward(loc: DataFrame, pol: DataFrame, keep_lapsed: bool = False) -> DataFrame:
    """Lines of business now against the prior period; changes are null without a prior line.

    Lines that are gone are left out unless keep_lapsed is set.
    """
    sums = by_policy(loc, pol, ["PERIOD", "LOBNAME"])

    def side(period, prefix):
        return sums.filter(F.col("PERIOD") == period).select(
            "LOBNAME",
            F.col("ACCOUNTS").alias(f"{prefix}_ACCOUNTS"),
            F.col("ROWS").alias(f"{prefix}_LOCATIONS"),
            F.col("TIV").alias(f"{prefix}_TIV"),
            F.col("PREMIUM").alias(f"{prefix}_PREMIUM"),
        )

    change = F.col("CURR_TIV") - F.col("PRIOR_TIV")
    return (
        side(S.CURRENT, "CURR")
        .join(side(S.PRIOR, "PRIOR"), "LOBNAME", "full" if keep_lapsed else "left")
        .select(
            F.col("LOBNAME").alias("LINE_OF_BUSINESS"),
            "PRIOR_ACCOUNTS", "CURR_ACCOUNTS", "PRIOR_LOCATIONS", "CURR_LOCATIONS",
            (F.col("CURR_LOCATIONS") - F.col("PRIOR_LOCATIONS")).alias("LOC_DELTA"),
            "PRIOR_TIV", "CURR_TIV", "PRIOR_PREMIUM", "CURR_PREMIUM",
            F.round(change, 2).alias("TIV_DELTA"),
            F.round(change / F.nullif("PRIOR_TIV", F.lit(0)) * 100, 2).alias("TIV_GROWTH_PCT"),
        )
        .orderBy(F.desc_nulls_last("CURR_TIV"))
    )
