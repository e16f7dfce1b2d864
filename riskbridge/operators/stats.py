"""Tail risk, distribution drift, stress scenarios and report densities."""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskbridge import schema as S
from riskbridge.functions.columns import band, ratio
from riskbridge.functions.durable import durable
from riskbridge.functions.order import long_form, quantiles, running_counts, widest_gap
from riskbridge.operators.merge import account_rollup, exposed_locations, exposed_policies, first_policy

# Tail levels, drift features and drift bands.
TAIL_LEVELS = [0.95, 0.99, 0.995]
LOCATION_FEATURES = ["TIV_TOTAL", "FLOORAREA", "NUMSTORIES", "YEARBUILT", "WSCV4VAL", "WSCV6VAL"]
POLICY_FEATURES = ["BLANPREAMT", "RATE_ON_LINE_PCT"]
DRIFT_BANDS = [(0.10, "STABLE"), (0.25, "MODERATE DRIFT")]
DRIFT_ABOVE = "SIGNIFICANT DRIFT"


def _current(df: DataFrame) -> DataFrame:
    return df.filter(F.col("PERIOD") == S.CURRENT)


def tail_risk(loc: DataFrame, pol: DataFrame, levels: list[float] = TAIL_LEVELS) -> DataFrame:
    """Value at risk of single-location value per level, and the mean at or above it."""
    rows = exposed_locations(_current(loc), _current(pol)).select("TIV_TOTAL", "WEIGHT")
    names = [f"v{i}" for i in range(len(levels))]
    var = quantiles(rows, [], "TIV_TOTAL", dict(zip(names, levels)), "WEIGHT")
    points = var.agg(F.struct(*[F.max(n).alias(n) for n in names])).scalar()  # one row

    def tail(name, c):
        return F.sum(F.when(F.col("TIV_TOTAL") >= F.col(f"_points.{name}"), c))

    w = F.col("WEIGHT")
    sums = rows.withColumn("_points", points).agg(
        *[F.max(f"_points.{n}").alias(n) for n in names],
        *[(tail(n, F.col("TIV_TOTAL") * w) / tail(n, w)).alias(f"t{n}") for n in names],
        *[tail(n, w).alias(f"c{n}") for n in names],
    )
    each = [
        F.struct(F.lit(float(p)).alias("LEVEL"), F.col(n).alias("VAR"), F.col(f"t{n}").alias("TVAR"), F.col(f"c{n}").alias("TAIL_ROWS"))
        for n, p in zip(names, levels)
    ]
    return sums.select(F.inline(F.array(*each)))


def ep_curve(loc: DataFrame, pol: DataFrame, points: int | None = None) -> DataFrame:
    """Exceedance probability of single-location value; one row per distinct value.

    `points` keeps about that many, evenly spread over the probability.
    """
    rows = exposed_locations(_current(loc), _current(pol))
    curve = running_counts(rows, [], "TIV_TOTAL", "WEIGHT").select(
        "TIV_TOTAL",
        F.col("n").alias("ROWS_AT_VALUE"),
        (F.col("total") - F.col("upto") + F.col("n")).alias("ROWS_AT_OR_ABOVE"),
        "total",
    )
    above, total = F.col("ROWS_AT_OR_ABOVE"), F.col("total")
    if points:
        step = F.floor(above * points / total)
        curve = curve.filter((step > F.floor((above - F.col("ROWS_AT_VALUE")) * points / total)) | (above == 1))
    return curve.withColumn("EXCEEDANCE_PCT", above / total * 100).drop("total")


def drift_values(loc: DataFrame, pol: DataFrame) -> DataFrame:
    """FEATURE, VALUE and the merged rows it stands for in each period.

    Index and gap read these rows several times, so the joined columns are written once.
    """
    keep = ["PERIOD", "WEIGHT"]
    of_loc = durable(exposed_locations(loc, pol).select(*keep, *LOCATION_FEATURES))
    of_pol = durable(exposed_policies(loc, pol).select(*keep, *POLICY_FEATURES))
    values = long_form(of_loc, keep, LOCATION_FEATURES).unionByName(long_form(of_pol, keep, POLICY_FEATURES))
    return values.select(
        "FEATURE",
        "VALUE",
        F.when(F.col("PERIOD") == S.PRIOR, F.col("WEIGHT")).otherwise(0).alias("W_PRIOR"),
        F.when(F.col("PERIOD") == S.CURRENT, F.col("WEIGHT")).otherwise(0).alias("W_CURR"),
    )


def psi(values: DataFrame, bins: int = 10) -> DataFrame:
    """Population stability index per feature, over quantile bins of the prior values.

    The outer edges are moved out by 1e-5 and equal edges merged. Bins are closed on the left, the
    last on both sides. Current values outside all bins still count in the total. Shares are kept
    within [1e-4, 1]. A feature with one edge, or no rows in a period, has index 0.
    """
    names = [f"e{i}" for i in range(bins + 1)]
    edges = quantiles(
        values.filter("W_PRIOR > 0"), ["FEATURE"], "VALUE", {n: i / bins for i, n in enumerate(names)}, "W_PRIOR"
    )
    shifted = [F.col(names[0]) - 1e-5, *[F.col(n) for n in names[1:-1]], F.col(names[-1]) + 1e-5]
    cuts = edges.select("FEATURE", F.array_sort(F.array_distinct(F.array(*shifted))).alias("_all"))
    # one row per feature; merged edges leave nulls at the end
    cuts = cuts.select(
        "FEATURE",
        F.size("_all").alias("_edges"),
        F.element_at("_all", -1).alias("_top"),
        *[F.try_element_at("_all", F.lit(i + 1)).alias(f"_c{i}") for i in range(bins + 1)],
    )
    x, last = F.col("VALUE"), F.col("_edges")
    passed = sum((F.when(x >= F.col(f"_c{i}"), 1).otherwise(0) for i in range(bins + 1)), F.lit(0))
    bin_ = F.when(x == F.col("_top"), last - 1).when((passed > 0) & (passed < last), passed).otherwise(0)
    counts = (
        values.join(F.broadcast(cuts), "FEATURE", "left")
        .groupBy("FEATURE", bin_.alias("BIN"))
        .agg(F.sum("W_PRIOR").alias("E"), F.sum("W_CURR").alias("A"), F.max(F.coalesce(last, F.lit(0))).alias("EDGES"))
    )
    # every bin takes part, also one that holds no row
    per_feature = counts.groupBy("FEATURE").agg(
        F.sum("E").alias("N_PRIOR"),
        F.sum("A").alias("N_CURR"),
        F.max("EDGES").alias("EDGES"),
        F.map_from_entries(F.collect_list(F.struct("BIN", F.struct("E", "A").alias("n")))).alias("BINS"),  # <= bins + 1 entries
    )

    def share(n, total):
        return F.least(F.greatest(F.coalesce(n, F.lit(0)) / total, F.lit(1e-4)), F.lit(1.0))

    def term(b):
        n = F.try_element_at("BINS", b)
        e, a = share(n.getField("E"), F.col("N_PRIOR")), share(n.getField("A"), F.col("N_CURR"))
        return (a - e) * F.ln(a / e)

    total = F.aggregate(F.sequence(F.lit(1), F.col("EDGES") - 1), F.lit(0.0), lambda acc, b: acc + term(b))
    usable = (F.col("EDGES") > 1) & (F.col("N_PRIOR") > 0) & (F.col("N_CURR") > 0)
    return per_feature.select("FEATURE", F.when(usable, total).otherwise(F.lit(0.0)).alias("PSI_SCORE"))


def kolmogorov_p(d: Column, n1: Column, n2: Column) -> Column:
    """Two-sided p-value of a two-sample statistic: Kolmogorov's series with a finite-sample shift."""
    n1, n2 = n1.cast("double"), n2.cast("double")
    en = n1 * n2 / (n1 + n2)
    x = d * F.sqrt(en)
    x = x + 1 / (6 * F.sqrt(en)) + (x - 1) / (4 * en)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x),
    )
    # below 0.2 the series is 1 to twelve digits but converges slowly
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def path_share(d: float, n1: int, n2: int) -> float:
    """Exact p-value of a two-sample gap d: the share of lattice paths from (0, 0) to (n1, n2) that reach a gap of d or more.

    A path draws one value after the other from what is left of both samples. Chances run over the diagonals, and what reaches the
    gap is taken out and added up, so small p-values keep their digits. Takes (n1 + n2) steps on n1 + 1 numbers.
    """
    if n1 > n2:
        n1, n2 = n2, n1
    least = round(d * n1 * n2)  # gaps are multiples of 1 / (n1 * n2)
    if least <= 0:
        return 1.0
    i = np.arange(n1 + 1)
    chance, reached = np.zeros(n1 + 1), 0.0
    chance[0] = 1.0
    for drawn in range(n1 + n2):
        right = chance * (n1 - i) / (n1 + n2 - drawn)
        chance = chance - right
        chance[1:] += right[:-1]
        out = np.abs(i * n2 - (drawn + 1 - i) * n1) >= least
        reached += chance[out].sum()
        chance[out] = 0.0
    return float(min(1.0, reached))


def exact_p(most: int) -> Callable[[Column, Column, Column], Column]:
    """Column function of gap and sample sizes: the exact p-value where both samples have at most `most` values, else null."""

    @F.pandas_udf("double")
    def run(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
        known = d.notna() & (n1 > 0) & (n2 > 0) & (n1 <= most) & (n2 <= most)
        return pd.Series([path_share(g, int(a), int(b)) if ok else None for g, a, b, ok in zip(d, n1, n2, known, strict=True)], dtype="float64")

    return run


def ks_two_sample(values: DataFrame, exact_up_to: int = 10_000) -> DataFrame:
    """Largest distribution gap per feature between the periods, and its p-value.

    Samples of at most `exact_up_to` values get the exact p-value, larger ones Kolmogorov's series.
    """
    gaps = widest_gap(values, ["FEATURE"], "VALUE", "W_PRIOR", "W_CURR")  # one row per feature
    d, n1, n2 = F.col("gap"), F.col("n_left").cast("double"), F.col("n_right").cast("double")
    p = F.coalesce(exact_p(exact_up_to)(d, n1, n2), kolmogorov_p(d, n1, n2))
    return gaps.select("FEATURE", d.alias("KS_STATISTIC"), F.when((n1 > 0) & (n2 > 0), p).alias("P_VALUE"))


def drift_matrix(loc: DataFrame, pol: DataFrame) -> DataFrame:
    """Stability index, distribution gap and drift band per feature, most drift first."""
    values = drift_values(loc, pol)
    return (
        psi(values)
        .join(ks_two_sample(values), "FEATURE")
        .select(
            "FEATURE",
            F.round("PSI_SCORE", 4).alias("PSI_SCORE"),
            F.round("KS_STATISTIC", 4).alias("KS_STATISTIC"),
            F.round("P_VALUE", 4).alias("P_VALUE"),
            band(F.col("PSI_SCORE"), DRIFT_BANDS, DRIFT_ABOVE).alias("DRIFT_STATUS"),
        )
        .orderBy(F.desc("PSI_SCORE"), "FEATURE")
    )


def stress_tests(
    loc: DataFrame,
    pol: DataFrame,
    surge: float = 0.15,
    code_penalty: float = 0.25,
    code_year: int = 2002,
    rate_bps: float = 25.0,
    unknown_year_exempt: bool = False,
    coastal_states: list[str] | None = None,
) -> DataFrame:
    """Three scenarios against the current portfolio: value surge, old-code penalty, rate hardening.

    The penalty applies to every location built before code_year, unknown years (0) included,
    unless they are exempted; a state list limits it to those states.
    """
    old = F.col("YEARBUILT") < code_year
    if unknown_year_exempt:
        old = old & (F.col("YEARBUILT") > 0)
    if coastal_states is not None:
        old = old & F.col("STATE").isin(coastal_states)
    accounts = account_rollup(
        _current(loc),
        _current(pol),
        loc_extra=[F.sum(F.when(old, F.col("TIV_TOTAL")).otherwise(0.0)).alias("OLD_TIV")],
        pol_extra=[F.sum("BLANPREAMT").alias("ALL_PREMIUM"), first_policy().alias("FIRST")],
    )
    # the mean over merged rows of rate on line, in basis points
    rates = ratio(F.col("ALL_PREMIUM"), F.col("ACCOUNT_TIV"), 10_000) * F.col("LOCS")
    per_account = accounts.groupBy("ACCNTNUM").agg(
        F.sum("ACCOUNT_TIV").alias("tiv"),
        F.sum(F.col("OLD_TIV") * F.col("POLICIES")).alias("old"),
        F.sum(rates).alias("rates"),
        F.sum("LOC_COUNT").alias("rows"),
        F.min("FIRST").getField("BLANPREAMT").alias("premium"),
    )
    base = per_account.agg(
        F.sum("tiv").alias("tiv"),
        F.sum("old").alias("old"),
        (F.sum("rates") / F.sum("rows")).alias("bps"),
        F.sum("premium").alias("premium"),
    )
    tiv, prem = F.col("tiv"), F.col("premium")

    def case(name, start, value):
        return F.struct(
            F.lit(name).alias("SCENARIO"), start.alias("BASE"), value.alias("STRESSED"), (value - start).alias("UPLIFT")
        )

    cases = [
        case("A_VALUE_SURGE", tiv, tiv * (1 + surge)),
        case("B_OLD_CODE_PENALTY", tiv, tiv + F.col("old") * code_penalty),
        case("C_RATE_HARDENING", prem, tiv * (F.col("bps") + rate_bps) / 10_000),
    ]
    return base.select(F.inline(F.array(*cases)), F.col("bps").alias("MEAN_ROL_BPS"))


def histogram(df: DataFrame, by: list[str], value: str, bins: int, weight: str | None = None) -> DataFrame:
    """Equal-width counts per group between its smallest and largest value; the last bin is closed."""
    w = F.col(weight) if weight else F.lit(1)
    x = F.col(value)
    limits = df.groupBy(*by).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))  # one row per group
    # a single value gets a bin range of width 1 around it
    flat = F.col("_lo") == F.col("_hi")
    limits = limits.select(
        *by,
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"),
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    number = F.least(F.floor((x - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    return (
        df.join(limits, by)
        .groupBy(*by, number.alias("BIN"), "_lo", "_hi")
        .agg(F.sum(w).alias("ROWS"))
        .select(
            *by, "BIN",
            (F.col("_lo") + F.col("BIN") * width).alias("BIN_START"),
            (F.col("_lo") + (F.col("BIN") + 1) * width).alias("BIN_END"),
            "ROWS",
        )
    )


def rate_density(loc: DataFrame, pol: DataFrame, bins: int = 30) -> DataFrame:
    """Rate-on-line histogram per period over merged rows."""
    return histogram(exposed_policies(loc, pol), ["PERIOD"], "RATE_ON_LINE_PCT", bins, "WEIGHT")


def kernel_density(
    df: DataFrame, by: list[str], value: str, weight: str | None = None, grid: int = 200, cut: float = 3.0, fineness: int = 8, reach: float = 9.0
) -> DataFrame:
    """Gaussian density of all rows on a grid per group, with Scott's bandwidth.

    Rows fall into bins of 1/`fineness` bandwidth; only bins that hold rows exist, however far the values spread. A bin keeps the
    moments of its rows about its middle, and adds its kernels as a series of Hermite polynomials to the grid points within
    `reach` bandwidths, beyond which a kernel is less than 10^-17. What the series leaves out is below 10^-7 of a row's kernel. Null
    values are left out; groups of one row or one value have no density.
    """
    moments = 5
    rows = df.select(*by, F.col(value).cast("double").alias("_x"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"))
    rows = rows.filter("_x is not null and _w > 0")
    x, w, h = F.col("_x"), F.col("_w"), F.col("_h")
    # one row per group: range and mean, then the spread about the mean
    ranges = rows.groupBy(*by).agg(F.sum(w).alias("_n"), F.min(x).alias("_lo"), F.max(x).alias("_hi"), (F.sum(w * x) / F.sum(w)).alias("_m"))
    about = rows.join(ranges, by) if by else rows.join(ranges)
    spread = about.groupBy(*by, "_n", "_lo", "_hi").agg(F.sum(w * (x - F.col("_m")) * (x - F.col("_m"))).alias("_ss"))
    shape = spread.filter("_n > 1 and _ss > 0").withColumn("_h", F.sqrt(F.col("_ss") / (F.col("_n") - 1)) * F.pow("_n", F.lit(-0.2)))
    start, end = F.col("_lo") - cut * h, F.col("_hi") + cut * h
    shape = shape.select(*by, "_n", "_h", "_lo", start.alias("_start"), ((end - start) / (grid - 1)).alias("_step"))
    placed = (rows.join(shape, by) if by else rows.join(shape)).withColumn("_b", F.floor((x - F.col("_lo")) / h * fineness))
    middle = F.col("_lo") + (F.col("_b") + 0.5) * h / fineness
    placed = placed.withColumn("_c", middle).withColumn("_d", (x - F.col("_c")) / h)
    bins = placed.groupBy(*by, "_c", "_h", "_start", "_step").agg(*[F.sum(w * F.pow("_d", F.lit(m))).alias(f"_m{m}") for m in range(moments)])
    first = F.greatest(F.ceil((F.col("_c") - reach * h - F.col("_start")) / F.col("_step")), F.lit(0))
    last = F.least(F.floor((F.col("_c") + reach * h - F.col("_start")) / F.col("_step")), F.lit(grid - 1))
    near = bins.filter(first <= last).withColumn("_i", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    near = near.withColumn("_u", (F.col("_start") + F.col("_step") * F.col("_i") - F.col("_c")) / h)
    u = F.col("_u")
    hermite, factorial = [F.lit(1.0), u], 1.0
    for m in range(2, moments):
        hermite.append(u * hermite[-1] - (m - 1) * hermite[-2])
    series = F.lit(0.0)
    for m in range(moments):
        factorial *= max(m, 1)
        series = series + F.col(f"_m{m}") * hermite[m] / factorial
    sums = near.groupBy(*by, "_i").agg(F.sum(series * F.exp(-0.5 * u * u)).alias("_sum"))
    points = shape.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    density = F.coalesce(F.greatest(F.col("_sum"), F.lit(0.0)), F.lit(0.0)) / (F.col("_n") * h * 2.5066282746310002)
    return points.join(sums, [*by, "_i"], "left").select(*by, (F.col("_start") + F.col("_step") * F.col("_i")).alias("X"), density.alias("DENSITY"))
