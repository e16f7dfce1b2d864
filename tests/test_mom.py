import pytest
from conftest import SF, rows_of
from pyspark.sql import functions as F

from riskbridge import schema as S
from riskbridge.operators import merge, mom, profile, stats
from riskbridge.sources.fixtures import locations, policies

POL = "ACCNTNUM POLICYNUM LOBNAME CEDANTNAME BLANPREAMT BLANLIMAMT"
LOC = "ACCNTNUM LOCNUM STATE WSCV4VAL YEARBUILT"


@pytest.fixture
def months(frame):
    loc = frame(LOC, [("gone", 1, "FL", 100, 1990), ("kept", 2, "TX", 50, 2005)], S.PRIOR).unionByName(
        frame(LOC, [("kept", 2, "TX", 80, 2005), ("new", 3, "LA", 30, 0)])
    )
    pol = frame(POL, [("gone", 1, "OLD", "c", 10, 1), ("kept", 2, "BOTH", "c", 5, 1)], S.PRIOR).unionByName(
        frame(POL, [("kept", 2, "BOTH", "c", 6, 1), ("new", 3, "NEW", "d", 3, 1)])
    )
    return loc, pol


def test_rollforward_and_bridges(months):
    r = mom.rollforward(*months).first()
    assert (r.BASELINE_ACCOUNTS, r.LAPSED_ACCOUNTS, r.RETAINED_ACCOUNTS, r.NEW_ACCOUNTS, r.ENDING_ACCOUNTS) == (2, 1, 1, 1, 2)
    assert (r.CHURN_PCT, r.RETENTION_PCT, r.INFLOW_PCT) == (50.0, 50.0, 50.0)
    tiv = {s.STEP: s.AMOUNT for s in mom.waterfall(*months, "TIV").collect()}
    assert tiv["BASELINE"] + tiv["LAPSED"] + tiv["NEW"] + tiv["RETAINED_DRIFT"] == tiv["ENDING"] == 110.0
    prem = {s.STEP: s.AMOUNT for s in mom.waterfall(*months, "PREMIUM").collect()}
    assert prem["BASELINE"] + prem["LAPSED"] + prem["NEW"] + prem["RETAINED_DRIFT"] == prem["ENDING"] == 9.0


def test_members_of_one_period(months):
    drift = rows_of(mom.exposure_drift(*months, "LOBNAME"), "LOBNAME", "PRIOR_TIV", "CURR_TIV", "TIV_GROWTH_PCT", "LOC_DELTA")
    assert drift == [("BOTH", 50.0, 80.0, 60.0, 0), ("NEW", 0.0, 30.0, 0.0, 1), ("OLD", 100.0, 0.0, -100.0, -1)]
    lob = {r.LINE_OF_BUSINESS: r for r in mom.lob_rollforward(*months).collect()}
    assert set(lob) == {"BOTH", "NEW"} and lob["NEW"].TIV_GROWTH_PCT is None and lob["BOTH"].TIV_GROWTH_PCT == 60.0
    assert set(r.LINE_OF_BUSINESS for r in mom.lob_rollforward(*months, keep_lapsed=True).collect()) == {"BOTH", "NEW", "OLD"}
    assert [r.STATE for r in mom.exposure_drift(*months, "STATE").collect()] == ["TX", "LA", "FL"]


def test_same_month_twice(spark):
    one = lambda df: df.filter(F.col("PERIOD") == S.CURRENT)
    as_prior = lambda df: df.withColumn("PERIOD", F.lit(S.PRIOR))
    loc, pol = one(locations(spark, SF)), one(policies(spark, SF))
    loc, pol = loc.unionByName(as_prior(loc)), pol.unionByName(as_prior(pol))
    # sums of doubles may differ in the last digits with the order of rows
    assert mom.exposure_drift(loc, pol, "STATE").filter("abs(TIV_DELTA) > 1e-4 or LOC_DELTA != 0").count() == 0
    assert mom.kpi_comparison(loc, pol).filter("abs(DELTA) > 1e-4").count() == 0
    drift = stats.drift_matrix(loc, pol).collect()
    assert len(drift) == 8 and all((r.PSI_SCORE, r.KS_STATISTIC, r.P_VALUE, r.DRIFT_STATUS) == (0.0, 0.0, 1.0, "STABLE") for r in drift)


def test_stress_unknown_years(months):
    r = {s.SCENARIO: s for s in stats.stress_tests(*months).collect()}
    assert r["A_VALUE_SURGE"].STRESSED == pytest.approx(126.5)
    assert r["B_OLD_CODE_PENALTY"].UPLIFT == pytest.approx(7.5)  # the location of unknown year
    exempt = {s.SCENARIO: s for s in stats.stress_tests(*months, unknown_year_exempt=True).collect()}
    assert exempt["B_OLD_CODE_PENALTY"].UPLIFT == 0.0
    coast = {s.SCENARIO: s for s in stats.stress_tests(*months, coastal_states=["FL"]).collect()}
    assert coast["B_OLD_CODE_PENALTY"].UPLIFT == 0.0
    bps = (6 / 80 + 3 / 30) / 2 * 1e4
    assert r["C_RATE_HARDENING"].STRESSED == pytest.approx(110 * (bps + 25) / 1e4) and r["C_RATE_HARDENING"].BASE == 9.0


def test_eras_and_profile(frame):
    loc = frame(LOC, [("A", i, "FL", 1, y) for i, y in enumerate([0, 1799, 1800, 1801, 1979, 1980, 2002])])
    r = profile.construction_eras(loc).first()
    assert (r.PRE_1980, r.FROM_1980, r.FROM_1995, r.FROM_2002) == (2, 1, 0, 1) and r.PRE_1980_PCT == pytest.approx(200 / 7)
    assert profile.physical_profile(loc).first().MEAN_YEAR_BUILT == (1801 + 1979 + 1980 + 2002) // 4


def test_top_values_drop_blanks_after_the_cut(frame):
    pol = frame(POL, [("A", i, lob, "c", 1, 1) for i, lob in enumerate(["", "", "x", "x", "a", "b"])])
    got = rows_of(profile.top_values(pol).filter("CATEGORY = 'LOBNAME'"), "POSITION", "VALUE", "ROWS")
    assert got == [(2, "x", 2), (3, "a", 1)]


def test_key_integrity(frame):
    r = profile.key_integrity(frame(LOC, [("A", 1, "", 0, 0), ("A", 1, "", 0, 0), ("B", 1, "", 0, 0)])).first()
    assert (r.ROWS, r.DISTINCT_KEYS, r.COLLIDING_KEYS, r.KEY_UNIQUE, r.UNIQUE_ACCOUNTS, r.UNIQUE_ENTITIES) == (3, 2, 1, False, 2, 1)


def test_weighted_rows_equal_merged_rows(spark):
    loc, pol = locations(spark, SF), policies(spark, SF)
    m = merge.merge_exposure(loc, pol).agg(F.count("*").alias("n"), F.sum("TIV_TOTAL").alias("t"), F.avg("RATE_ON_LINE_PCT").alias("r")).first()
    w = merge.exposed_locations(loc, pol).agg(F.sum("WEIGHT").alias("n"), F.sum(F.col("WEIGHT") * F.col("TIV_TOTAL")).alias("t")).first()
    p = merge.exposed_policies(loc, pol).agg(F.sum("WEIGHT").alias("n"), (F.sum(F.col("WEIGHT") * F.col("RATE_ON_LINE_PCT")) / F.sum("WEIGHT")).alias("r")).first()
    assert m.n == w.n == p.n and m.t == pytest.approx(w.t) and m.r == pytest.approx(p.r)
