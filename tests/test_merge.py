import pytest
from conftest import rows_of

from riskbridge import schema as S
from riskbridge.functions import skew
from riskbridge.operators import merge, mom

POL = "ACCNTNUM POLICYNUM LOBNAME BLANPREAMT BLANLIMAMT"
LOC = "ACCNTNUM LOCNUM STATE WSCV4VAL FLOORAREA YEARBUILT"


@pytest.fixture
def fan_out(frame):
    loc = frame(LOC, [("A", 1, "FL", 100, 10, 2000), ("A", 2, "FL", 200, 0, 2010), ("A", 3, "TX", 300, 3, 0)])
    pol = frame(POL, [("A", "P2", "X", 12, 900), ("A", "P1", "Y", 6, 600)])
    return loc, pol


def test_fan_out(fan_out):
    loc, pol = fan_out
    m = merge.merge_exposure(loc, pol)
    got = rows_of(m, "POLICYNUM", "LOCNUM", "ACCOUNT_TIV", "LOC_COUNT", "RATE_ON_LINE_PCT", "TIV_PER_SQFT")
    assert len(got) == 6 and got[0] == ("P1", "1", 1200.0, 6, 0.5, 10.0) and got[1][-1] == 0.0
    f = merge.merged_financials(loc, pol).first()
    assert (f.TOTAL_TIV, f.TOTAL_PREMIUM, f.TOTAL_LIMIT, f.AVG_LOCS_PER_ACCOUNT) == (1200.0, 6.0, 600.0, 6.0)
    d = merge.match_diagnostics(loc, pol).first()
    assert (d.MERGED_ROWS, d.MAX_POLICIES_PER_ACCOUNT) == (6, 2)
    h = merge.hhi(loc, pol).first()
    assert (h.HHI, h.TOP_MEMBER, h.TOP_SHARE_PCT) == (5000.0, "FL", 50.0)


def test_top_accounts_repeat_an_account_per_terms(fan_out):
    got = rows_of(mom.top_accounts(*fan_out), "TIV_RANK", "BLANKET_PREMIUM", "TOTAL_LOCATIONS", "AGGREGATE_TIV", "RATE_ON_LINE_PCT")
    assert got == [(1, 6.0, 3, 600.0, 1.0), (1, 12.0, 3, 600.0, 2.0)]


def test_first_policy_is_commercial(frame):
    loc = frame(LOC, [("A", 1, "FL", 100, 1, 2000)]).unionByName(frame(LOC, [("A", 1, "FL", 50, 1, 2000)], segment=S.STANDARD))
    pol = frame(POL, [("A", "Z", "X", 7, 70)]).unionByName(frame(POL, [("A", "B", "X", 9, 90)], segment=S.STANDARD))
    k = mom.kpis(loc, pol).first()
    assert (k.Total_Accounts, k.Total_Policies, k.Total_Locations, k.Total_Premium_USD, k.Total_TIV_USD) == (1, 2, 1, 7.0, 150.0)


def test_zero_denominators(frame):
    loc = frame(LOC, [("A", 1, "FL", 0, 0, 0)])
    pol = frame(POL, [("A", "P", "X", 5, 0)])
    r = merge.merge_exposure(loc, pol).first()
    assert (r.RATE_ON_LINE_PCT, r.LIMIT_TO_TIV_RATIO, r.TIV_PER_SQFT) == (0.0, 0.0, 0.0)
    assert merge.rate_on_limit(pol).first().RATE_ON_LIMIT_PCT == 0.0
    assert merge.hhi(loc, pol).count() == 0


def test_orphans_and_blank_keys(frame):
    loc = frame(LOC, [("A", 1, "FL", 1, 1, 1), ("L", 2, "FL", 1, 1, 1), (None, 3, "FL", 1, 1, 1), (" nan ", 4, "FL", 1, 1, 1)])
    pol = frame(POL, [("A", "P", "X", 1, 1), ("Q", "P2", "X", 1, 1), ("", "P3", "X", 1, 1)])
    assert rows_of(merge.account_sets(loc, pol), "ACCNTNUM", "MEMBERSHIP") == [
        ("", "COMMON"), ("A", "COMMON"), ("L", "ORPHAN_LOCATION"), ("Q", "ORPHAN_POLICY"),
    ]
    d = merge.match_diagnostics(loc, pol).first()
    assert (d.ORPHAN_LOCATION_ACCOUNTS, d.ORPHAN_POLICY_ACCOUNTS, d.BLANK_KEY_ROWS, d.COMMON_ACCOUNTS) == (1, 1, 3, 2)
    assert merge.merge_exposure(loc, pol).count() == 3
    assert merge.merge_exposure(loc, pol, drop_blank_keys=True).count() == 1


def test_valuation_flags(frame):
    loc = frame(LOC, [("A", i, "FL", v, a, 0) for i, (v, a) in enumerate([(49, 1), (50, 1), (1500, 1), (1501, 1), (5, 0)])])
    pol = frame(POL, [("A", "P", "X", 1, 1)])
    assert rows_of(merge.valuation_flags(loc, pol), "VALUATION", "ROWS") == [("HIGH", 1), ("LOW", 1), ("NO AREA", 1), ("NORMAL", 2)]


def crowded(frame):
    """A hot account on both sides, with copies of one row, and some small ones."""
    locs = [("H", i % 7, "FL", 10 + i % 7, 1, 2000) for i in range(30)] + [("H", "copy", "TX", 5, 1, 1990)] * 11
    locs += [(f"a{i}", 1, "FL", i, 1, 2001) for i in range(5)]
    pols = [("H", f"P{i % 4}", "X", i, 100) for i in range(9)] + [("H", "same", "Y", 1, 1)] * 5
    pols += [(f"a{i}", "P", "X", i, 10) for i in range(3)]
    return frame(LOC, locs), frame(POL, pols)


def test_hot_keys_change_nothing(spark, frame, hot, monkeypatch):
    monkeypatch.setattr(skew, "COPIES", 3)
    monkeypatch.setattr(skew, "MAX_HOT", 1000)
    loc, pol = crowded(frame)
    assert skew.hot_keys(loc, S.ACCOUNT).count() == 1 and skew.hot_keys(pol, S.ACCOUNT).count() == 1
    split = [merge.merge_exposure(loc, pol), merge.exposed_locations(loc, pol), merge.exposed_policies(loc, pol)]
    spark.conf.set("riskbridge.hotRows", "1000000")
    assert skew.hot_keys(loc, S.ACCOUNT) is None
    plain = [merge.merge_exposure(loc, pol), merge.exposed_locations(loc, pol), merge.exposed_policies(loc, pol)]
    for a, b in zip(split, plain):
        key = lambda r: tuple(str(v) for v in r)
        cols = sorted(a.columns)
        assert sorted(map(tuple, a.select(*cols).collect()), key=key) == sorted(map(tuple, b.select(*cols).collect()), key=key)
    assert split[0].count() == 41 * 14 + 3


def test_one_hot_side(spark, frame, hot):
    loc, pol = crowded(frame)
    few = pol.filter("POLICYNUM = 'same'").limit(1)
    assert merge.merge_exposure(loc, few).count() == 41
    assert merge.merge_exposure(loc.filter("LOCNUM = '1' and ACCNTNUM != 'H'"), pol).count() == 3


def test_hot_account_with_many_terms(spark, frame, hot):
    loc, pol = crowded(frame)
    split = rows_of(mom.top_accounts(loc, pol, n=20), "TIV_RANK", "ACCNTNUM", "BLANKET_PREMIUM", "AGGREGATE_TIV", "TOTAL_LOCATIONS")
    spark.conf.set("riskbridge.hotRows", "1000000")
    plain = rows_of(mom.top_accounts(loc, pol, n=20), "TIV_RANK", "ACCNTNUM", "BLANKET_PREMIUM", "AGGREGATE_TIV", "TOTAL_LOCATIONS")
    assert split == plain and len(plain) == 13
