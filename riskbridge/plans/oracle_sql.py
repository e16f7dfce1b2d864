"""Plain SQL for the same results over the same tables, with the join written out in full."""

from riskbridge import schema as S

_ORDERS = """
ord AS (
  SELECT *,
    CASE WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'prior' ELSE 'curr' END AS PERIOD,
    CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') THEN 'Commercial' ELSE 'Standard' END AS SEGMENT,
    CAST({account} AS VARCHAR) AS ACCNTNUM
  FROM orders JOIN customer ON o_custkey = c_custkey
),
pol AS (
  SELECT PERIOD, SEGMENT, ACCNTNUM, c_name AS ACCNTNAME, n_name AS PRODNAME,
    CAST(r_regionkey AS VARCHAR) AS CEDANTID, r_name AS CEDANTNAME, CAST(o_orderkey AS VARCHAR) AS POLICYNUM,
    o_orderpriority AS LOBNAME, o_orderstatus AS POLICYTYPE, o_totalprice * 0.01::DOUBLE AS BLANPREAMT,
    'USD' AS BLANPRECUR, NULL::VARCHAR AS USERDEF1, NULL::VARCHAR AS USERDEF2, o_totalprice * 0.8::DOUBLE AS BLANLIMAMT
  FROM ord JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
loc0 AS (
  SELECT PERIOD, SEGMENT, ACCNTNUM, CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS LOCNUM,
    {nulls},
    n_name AS STATE, p_type AS BLDGCLASS, p_brand AS OCCTYPE,
    CASE WHEN l_partkey % 20 = 0 THEN 0.0 ELSE 1955.0 + p_size END::DOUBLE AS YEARBUILT,
    CASE WHEN l_partkey % 25 = 0 THEN 0.0 ELSE l_quantity * 1000 END::DOUBLE AS FLOORAREA,
    (1.0 + l_suppkey % 12)::DOUBLE AS NUMSTORIES,
    CASE WHEN l_partkey % 40 = 0 THEN 0.0 ELSE 25.0 + l_suppkey % 25 END::DOUBLE AS LATITUDE,
    (-(70.0 + l_suppkey % 50))::DOUBLE AS LONGITUDE,
    l_extendedprice AS WSCV4VAL, l_extendedprice * l_discount AS WSCV5VAL, l_extendedprice * l_tax AS WSCV6VAL,
    (l_quantity * 100)::DOUBLE AS WSCV7VAL,
    CASE WHEN SEGMENT = 'Commercial' THEN l_extendedprice ELSE 0.0::DOUBLE END AS TOCV4VAL,
    CASE WHEN SEGMENT = 'Commercial' THEN l_extendedprice * 2 * l_tax ELSE 0.0::DOUBLE END AS TOCV6VAL,
    0.0::DOUBLE AS TOCV5VAL, 0.0::DOUBLE AS TOCV7VAL, {zeros},
    l_returnflag AS ROOFSYS, l_linestatus AS ROOFGEOM
  FROM lineitem JOIN ord ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
),
loc1 AS (
  SELECT *, WSCV4VAL + WSCV5VAL + WSCV6VAL + WSCV7VAL AS TIV_WS, TOCV4VAL + TOCV5VAL + TOCV6VAL + TOCV7VAL AS TIV_TO
  FROM loc0
),
loc AS (SELECT *, greatest(TIV_WS, TIV_TO) AS TIV_TOTAL FROM loc1),
m0 AS (
  SELECT PERIOD, SEGMENT, p.* EXCLUDE (PERIOD, SEGMENT, BLANPRECUR), l.* EXCLUDE (PERIOD, SEGMENT, ACCNTNUM)
  FROM pol p JOIN loc l USING (PERIOD, SEGMENT, ACCNTNUM)
),
m1 AS (
  SELECT *, sum(TIV_TOTAL) OVER acc AS ACCOUNT_TIV, count(LOCNUM) OVER acc AS LOC_COUNT
  FROM m0 WINDOW acc AS (PARTITION BY PERIOD, SEGMENT, ACCNTNUM)
),
m AS (
  SELECT *,
    CASE WHEN ACCOUNT_TIV > 0 THEN BLANPREAMT / ACCOUNT_TIV * 100 ELSE 0 END AS RATE_ON_LINE_PCT,
    CASE WHEN ACCOUNT_TIV > 0 THEN BLANLIMAMT / ACCOUNT_TIV ELSE 0 END AS LIMIT_TO_TIV_RATIO,
    CASE WHEN FLOORAREA > 0 THEN TIV_TOTAL / FLOORAREA ELSE 0 END AS TIV_PER_SQFT
  FROM m1
),
cur AS (SELECT * FROM m WHERE PERIOD = 'curr')
"""

_MADE = set(
    "ACCNTNUM LOCNUM STATE BLDGCLASS OCCTYPE YEARBUILT FLOORAREA NUMSTORIES LATITUDE LONGITUDE WSCV4VAL WSCV5VAL "
    "WSCV6VAL WSCV7VAL TOCV4VAL TOCV5VAL TOCV6VAL TOCV7VAL ROOFSYS ROOFGEOM".split()
)
_REST = [c for c in S.LOCATION_COLUMNS if c not in _MADE]
_NULLS = [c for c in _REST if c not in S.NUMBER_COLUMNS]
_ZEROS = [c for c in _REST if c in S.NUMBER_COLUMNS]

# first row per account of a period, in the order segment, policy number
_FIRST = """
, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY PERIOD, ACCNTNUM ORDER BY SEGMENT, POLICYNUM, BLANPREAMT, BLANLIMAMT) AS rn
  FROM m
), first AS (SELECT * FROM ranked WHERE rn = 1)
"""

_MOVES = _FIRST + """
, tivs AS (SELECT PERIOD, ACCNTNUM, sum(TIV_TOTAL) AS TIV FROM m GROUP BY ALL),
a AS (SELECT t.*, f.BLANPREAMT AS PREMIUM FROM tivs t JOIN first f USING (PERIOD, ACCNTNUM)),
p AS (SELECT * FROM a WHERE PERIOD = 'prior'),
c AS (SELECT * FROM a WHERE PERIOD = 'curr'),
mv AS (
  SELECT p.TIV AS PRIOR_TIV, c.TIV AS CURR_TIV, p.PREMIUM AS PRIOR_PREMIUM, c.PREMIUM AS CURR_PREMIUM
  FROM p FULL JOIN c ON p.ACCNTNUM = c.ACCNTNUM
)
"""


def _base(account: str = "o_custkey") -> str:
    return "WITH " + _ORDERS.format(
        account=account,
        nulls=", ".join(f"NULL::VARCHAR AS {c}" for c in _NULLS),
        zeros=", ".join(f"0.0::DOUBLE AS {c}" for c in _ZEROS),
    )


def _drift(key: str) -> str:
    return f"""
, a AS (SELECT {key}, sum(TIV_TOTAL) AS t, count(LOCNUM) AS n FROM m WHERE PERIOD = 'prior' GROUP BY 1),
b AS (SELECT {key}, sum(TIV_TOTAL) AS t, count(LOCNUM) AS n FROM cur GROUP BY 1)
SELECT {key}, round(coalesce(a.t, 0), 1) AS PRIOR_TIV, coalesce(a.n, 0) AS PRIOR_LOCS, round(coalesce(b.t, 0), 1) AS CURR_TIV,
  coalesce(b.n, 0) AS CURR_LOCS, round(coalesce(b.t, 0) - coalesce(a.t, 0), 1) AS TIV_DELTA,
  round(CASE WHEN a.t > 0 THEN (coalesce(b.t, 0) - a.t) / a.t * 100 ELSE 0 END, 6) AS TIV_GROWTH_PCT,
  coalesce(b.n, 0) - coalesce(a.n, 0) AS LOC_DELTA
FROM a FULL JOIN b USING ({key})
"""


def _waterfall(measure: str) -> str:
    return _MOVES + f"""
, s AS (
  SELECT sum(PRIOR_{measure}) AS BASELINE, -coalesce(sum(PRIOR_{measure}) FILTER (CURR_TIV IS NULL), 0) AS LAPSED,
    coalesce(sum(CURR_{measure}) FILTER (PRIOR_TIV IS NULL), 0) AS NEW,
    coalesce(sum(CURR_{measure} - PRIOR_{measure}) FILTER (PRIOR_TIV IS NOT NULL AND CURR_TIV IS NOT NULL), 0) AS RETAINED_DRIFT,
    sum(CURR_{measure}) AS ENDING
  FROM mv
), u AS (SELECT *, ENDING - BASELINE AS NET_CHANGE, (ENDING - BASELINE) / BASELINE * 100 AS NET_CHANGE_PCT FROM s)
SELECT '{measure}' AS MEASURE, STEP, round(AMOUNT, 1) AS AMOUNT
FROM (UNPIVOT u ON BASELINE, LAPSED, NEW, RETAINED_DRIFT, ENDING, NET_CHANGE, NET_CHANGE_PCT INTO NAME STEP VALUE AMOUNT)
"""


def _lob(join: str) -> str:
    return f"""
, a AS (SELECT LOBNAME, count(DISTINCT ACCNTNUM) AS acc, count(LOCNUM) AS n, sum(TIV_TOTAL) AS t, sum(BLANPREAMT) AS pr
  FROM m WHERE PERIOD = 'prior' GROUP BY 1),
b AS (SELECT LOBNAME, count(DISTINCT ACCNTNUM) AS acc, count(LOCNUM) AS n, sum(TIV_TOTAL) AS t, sum(BLANPREAMT) AS pr
  FROM cur GROUP BY 1)
SELECT coalesce(b.LOBNAME, a.LOBNAME) AS LINE_OF_BUSINESS, a.acc AS PRIOR_ACCOUNTS, b.acc AS CURR_ACCOUNTS,
  a.n AS PRIOR_LOCATIONS, b.n AS CURR_LOCATIONS, b.n - a.n AS LOC_DELTA, round(a.t, 1) AS PRIOR_TIV, round(b.t, 1) AS CURR_TIV,
  round(a.pr, 4) AS PRIOR_PREMIUM, round(b.pr, 4) AS CURR_PREMIUM, round(b.t - a.t, 0) AS TIV_DELTA,
  round((b.t - a.t) / nullif(a.t, 0) * 100, 2) AS TIV_GROWTH_PCT
FROM b {join} JOIN a ON a.LOBNAME = b.LOBNAME
"""


def _top(kind: str, cats: list[str]) -> str:
    parts = " UNION ALL ".join(f"SELECT PERIOD, SEGMENT, '{c}' AS CATEGORY, {c} AS VALUE FROM {kind}" for c in cats)
    return f"""
, v AS ({parts}), n AS (SELECT PERIOD, SEGMENT, CATEGORY, VALUE, count(*) AS ROWS FROM v WHERE VALUE IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY PERIOD, SEGMENT, CATEGORY ORDER BY ROWS DESC, VALUE) AS POSITION FROM n)
SELECT PERIOD, SEGMENT, CATEGORY, VALUE, ROWS, POSITION::INTEGER AS POSITION FROM r WHERE POSITION <= 3 AND trim(VALUE) <> ''
"""


def _nulls(table: str, cols: list[str], width: int) -> str:
    counts = ", ".join(f"count(*) - count({c}) AS {c}" for c in cols)
    return f"""
, c AS (SELECT PERIOD, SEGMENT, count(*) AS ROWS, {counts} FROM {table} GROUP BY ALL),
u AS (SELECT * FROM (UNPIVOT c ON {", ".join(cols)} INTO NAME COLUMN_NAME VALUE NULLS) WHERE NULLS > 0)
SELECT PERIOD, SEGMENT, ROWS, COLUMN_NAME, NULLS, round(NULLS / ROWS * 100, 6) AS NULL_PCT,
  (sum(NULLS) OVER w)::BIGINT AS TOTAL_NULLS, count(*) OVER w AS COLUMNS_WITH_NULLS,
  round(sum(NULLS) OVER w / (ROWS * {width}) * 100, 6) AS TOTAL_NULL_PCT
FROM u WINDOW w AS (PARTITION BY PERIOD, SEGMENT)
"""


_FEATURES = """
, yr AS (SELECT coalesce(quantile_cont(YEARBUILT, 0.5), 1995) AS y FROM cur WHERE YEARBUILT > 1800),
f AS (
  SELECT cur.*, greatest(0, least(150, 2026 - CASE WHEN YEARBUILT < 1800 THEN y ELSE YEARBUILT END)) AS AGE,
    RATE_ON_LINE_PCT * 100 AS RATE_ON_LINE_BPS, NUMSTORIES * ln(1 + FLOORAREA) AS STORIES_AREA_INTERACTION
  FROM cur, yr
)
"""
_FLAGGED = """
, lim AS (SELECT quantile_cont(TIV_TOTAL, 0.97) AS v FROM cur),
flagged AS (SELECT cur.*, CASE WHEN TIV_TOTAL >= v THEN -1 ELSE 1 END AS DEEP_ANOMALY_FLAG FROM cur, lim)
"""
_MODEL = ["TIV_TOTAL", "BLANPREAMT", "FLOORAREA", "NUMSTORIES", "AGE", "TIV_PER_SQFT", "RATE_ON_LINE_BPS"]
_ROW = "SEGMENT, ACCNTNUM, POLICYNUM, LOCNUM"
_DRIFT_COLS = "TIV_TOTAL BLANPREAMT FLOORAREA NUMSTORIES YEARBUILT WSCV4VAL WSCV6VAL RATE_ON_LINE_PCT".split()

_LONG = ", v AS (" + " UNION ALL ".join(f"SELECT PERIOD, '{c}' AS FEATURE, {c} AS x FROM m" for c in _DRIFT_COLS) + ")"
# equal edges leave empty ranges, which hold no row and are left out
_PSI = _LONG + """
, q AS (SELECT FEATURE, quantile_cont(x, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]) AS e FROM v WHERE PERIOD = 'prior' GROUP BY 1),
e1 AS (SELECT FEATURE, i, e[i] + CASE i WHEN 1 THEN -1e-5 WHEN 11 THEN 1e-5 ELSE 0 END AS edge FROM q, range(1, 12) t(i)),
e2 AS (SELECT DISTINCT FEATURE, edge FROM e1),
bins AS (
  SELECT FEATURE, edge AS lo, lead(edge) OVER w AS hi, max(edge) OVER (PARTITION BY FEATURE) AS top
  FROM e2 WINDOW w AS (PARTITION BY FEATURE ORDER BY edge)
),
tot AS (SELECT FEATURE, count(*) FILTER (PERIOD = 'prior') AS np, count(*) FILTER (PERIOD = 'curr') AS nc FROM v GROUP BY 1),
cnt AS (
  SELECT b.FEATURE, b.lo, count(*) FILTER (PERIOD = 'prior') AS e, count(*) FILTER (PERIOD = 'curr') AS a
  FROM bins b LEFT JOIN v ON v.FEATURE = b.FEATURE AND x >= lo AND (x < hi OR (hi = top AND x = hi))
  WHERE hi IS NOT NULL GROUP BY ALL
),
sh AS (SELECT FEATURE, greatest(1e-4, least(1, e / np)) AS ep, greatest(1e-4, least(1, a / nc)) AS ap FROM cnt JOIN tot USING (FEATURE)),
psi AS (SELECT FEATURE, sum((ap - ep) * ln(ap / ep)) AS s FROM sh GROUP BY 1)
"""
_KS = """
, g AS (SELECT FEATURE, x, count(*) FILTER (PERIOD = 'prior') AS np, count(*) FILTER (PERIOD = 'curr') AS nc FROM v GROUP BY ALL),
cdf AS (
  SELECT FEATURE, sum(np) OVER w / sum(np) OVER a AS fp, sum(nc) OVER w / sum(nc) OVER a AS fc, sum(np) OVER a AS tp, sum(nc) OVER a AS tc
  FROM g WINDOW w AS (PARTITION BY FEATURE ORDER BY x), a AS (PARTITION BY FEATURE)
),
ks0 AS (SELECT FEATURE, max(abs(fp - fc)) AS d, any_value(tp * 1.0::DOUBLE * tc / (tp + tc)) AS en FROM cdf GROUP BY 1),
ks1 AS (SELECT *, d * sqrt(en) + 1 / (6 * sqrt(en)) + (d * sqrt(en) - 1) / (4 * en) AS z FROM ks0),
ks AS (
  SELECT FEATURE, any_value(d) AS d, CASE WHEN any_value(z) < 0.2 THEN 1 ELSE greatest(0, least(1,
    sum(CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * z * z)))) END AS pv
  FROM ks1, range(1, 101) t(k) GROUP BY FEATURE
)
"""


def _rounded(cols: list[str], digits: int) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


def oracle_sql() -> dict[str, str]:
    f1, f2 = _base("o_orderkey"), _base()
    ds = "PERIOD, SEGMENT"
    loc_cols = S.LOCATION_COLUMNS + S.TIV_COLUMNS
    ws = S.WS_VALUES
    merged_plain = ", ".join([*S.EXTRACT, *S.MERGED_POLICY_COLUMNS, *S.MERGED_LOCATION_COLUMNS])
    era = {
        "PRE_1980": "YEARBUILT > 1800 AND YEARBUILT < 1980",
        "FROM_1980": "YEARBUILT >= 1980 AND YEARBUILT < 1995",
        "FROM_1995": "YEARBUILT >= 1995 AND YEARBUILT < 2002",
        "FROM_2002": "YEARBUILT >= 2002",
    }
    top_accounts = """
, g AS (
  SELECT ACCNTNUM, ACCNTNAME, PRODNAME, CEDANTNAME, LOBNAME, BLANPREAMT, BLANLIMAMT, count(LOCNUM) AS n,
    round(sum(TIV_TOTAL), 2) AS t, max(TIV_TOTAL) AS mx
  FROM cur GROUP BY ALL
), r AS (SELECT *, rank() OVER (ORDER BY t DESC) AS rk FROM g)
SELECT ACCNTNUM, ACCNTNAME, PRODNAME, CEDANTNAME, n AS TOTAL_LOCATIONS, t AS AGGREGATE_TIV, round(t / n, 4) AS MEAN_LOC_TIV,
  mx AS MAX_LOC_TIV, BLANPREAMT AS BLANKET_PREMIUM, round(BLANPREAMT / nullif(t, 0) * 100, 4) AS RATE_ON_LINE_PCT,
  rk::INTEGER AS TIV_RANK
FROM r ORDER BY t DESC, BLANPREAMT, ACCNTNUM LIMIT 5
"""
    zscore = ", ".join(f"round((f.{c} - (SELECT avg({c}) FROM f)) / (SELECT stddev_pop({c}) FROM f), 6) AS {c}" for c in _MODEL)
    quart = ", ".join(
        f"quantile_cont({c}, 0.5) AS md_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iq_{c}" for c in _MODEL
    )
    plain = ", ".join(f"({c} - md_{c}) / CASE WHEN iq_{c} = 0 THEN 1 ELSE iq_{c} END AS {c}" for c in _MODEL)
    table = "[" + ", ".join("[" + ", ".join(f"covar_samp({a}, {b})" for b in _MODEL) + "]" for a in _MODEL) + "]"
    square = "[[list_dot_product(a, b) / list_sum([list_dot_product(x, x) FOR x IN c]) FOR b IN c] FOR a IN c]"
    trace_p, trace_m = ("(" + " + ".join(f"{v}[{i}][{i}]" for i in range(1, 8)) + ")" for v in ("p", "c"))
    robust = ", ".join(f"round(({c} - md_{c}) / CASE WHEN iq_{c} = 0 THEN 1 ELSE iq_{c} END, 6) AS {c}" for c in _MODEL)
    kpi = (
        _FIRST
        + """
, t AS (SELECT PERIOD, count(DISTINCT ACCNTNUM) AS Total_Accounts, count(DISTINCT POLICYNUM) AS Total_Policies,
    count(DISTINCT LOCNUM) AS Total_Locations, sum(TIV_TOTAL) AS Total_TIV_USD, avg(TIV_TOTAL) AS Mean_TIV_per_Loc_USD,
    count(DISTINCT (ACCNTNUM, LOCNUM)) AS Total_Location_Keys FROM m GROUP BY 1),
  fs AS (SELECT PERIOD, sum(BLANPREAMT) AS Total_Premium_USD, sum(BLANLIMAMT) AS Total_Limit_USD,
    avg(BLANPREAMT) AS Mean_Prem_per_Acc_USD FROM first GROUP BY 1),
  k AS (SELECT *, Total_Premium_USD / Total_TIV_USD * 100 AS Portfolio_RoL_Pct FROM t JOIN fs USING (PERIOD))
"""
    )
    names = [
        "Total_Accounts", "Total_Policies", "Total_Locations", "Total_TIV_USD", "Total_Premium_USD", "Total_Limit_USD",
        "Mean_TIV_per_Loc_USD", "Mean_Prem_per_Acc_USD", "Portfolio_RoL_Pct",
    ]
    out = {
        "sql_top_accounts": f1 + top_accounts,
        "sql_top_accounts_fan_out": f2 + top_accounts,
        "normalize_locations": f2 + f"SELECT PERIOD, SEGMENT, {', '.join(loc_cols)} FROM loc",
        "normalize_policies": f2 + f"SELECT PERIOD, SEGMENT, {', '.join(S.POLICY_COLUMNS)} FROM pol",
        "csv_roundtrip": f2 + f"SELECT PERIOD, SEGMENT, {', '.join(loc_cols)} FROM loc",
        "csv_roundtrip_policies": f2 + f"SELECT PERIOD, SEGMENT, {', '.join(S.POLICY_COLUMNS)} FROM pol",
        "key_integrity": f2
        + """
, k AS (
  SELECT 'Location' AS TYPE, PERIOD, SEGMENT, ACCNTNUM, LOCNUM AS e, count(*) AS n FROM loc GROUP BY ALL
  UNION ALL SELECT 'Policy', PERIOD, SEGMENT, ACCNTNUM, POLICYNUM, count(*) FROM pol GROUP BY ALL
)
SELECT TYPE, PERIOD, SEGMENT, sum(n)::BIGINT AS ROWS, count(*) AS DISTINCT_KEYS, count(*) FILTER (n > 1) AS COLLIDING_KEYS,
  max(n) = 1 AS KEY_UNIQUE, count(DISTINCT ACCNTNUM) AS UNIQUE_ACCOUNTS, count(DISTINCT e) AS UNIQUE_ENTITIES
FROM k GROUP BY ALL""",
        "missingness": f2 + _nulls("loc", S.LOCATION_COLUMNS, len(loc_cols)),
        "eda_summary": f2
        + f"""
SELECT 'Location' AS TYPE, PERIOD, SEGMENT, count(*) AS ROWS, {len(loc_cols)}::INTEGER AS COLS, count(DISTINCT ACCNTNUM) AS UNIQUE_ACCOUNTS,
  count(DISTINCT LOCNUM) AS UNIQUE_ENTITIES, round(sum(TIV_TOTAL), 4) AS TOTAL_TIV_USD, round(avg(TIV_TOTAL), 4) AS MEAN_TIV_USD,
  NULL::DOUBLE AS TOTAL_PREMIUM_USD, NULL::DOUBLE AS TOTAL_LIMIT_USD
FROM loc GROUP BY ALL
UNION ALL
SELECT 'Policy', PERIOD, SEGMENT, count(*), {len(S.POLICY_COLUMNS)}::INTEGER, count(DISTINCT ACCNTNUM), count(DISTINCT POLICYNUM),
  NULL, NULL, round(sum(BLANPREAMT), 4), round(sum(BLANLIMAMT), 4)
FROM pol GROUP BY ALL""",
        "profile_locations": f2
        + f"""SELECT {ds}, count(*) AS ROWS, round(sum(TIV_TOTAL), 4) AS TOTAL_TIV, round(avg(TIV_TOTAL), 4) AS MEAN_TIV,
  round(max(TIV_TOTAL), 4) AS MAX_TIV, round(quantile_cont(TIV_TOTAL, 0.5), 4) AS MEDIAN_TIV,
  round(quantile_cont(TIV_TOTAL, 0.9), 4) AS P90_TIV, round(quantile_cont(TIV_TOTAL, 0.99), 4) AS P99_TIV FROM loc GROUP BY ALL""",
        "profile_policies": f2
        + f"""SELECT {ds}, count(*) AS ROWS, round(sum(BLANPREAMT), 4) AS TOTAL_PREMIUM, round(avg(BLANPREAMT), 4) AS MEAN_PREMIUM,
  round(max(BLANPREAMT), 4) AS MAX_PREMIUM, round(quantile_cont(BLANPREAMT, 0.5), 5) AS MEDIAN_PREMIUM,
  round(quantile_cont(BLANPREAMT, 0.9), 5) AS P90_PREMIUM, round(sum(BLANLIMAMT), 4) AS TOTAL_LIMIT,
  round(avg(BLANLIMAMT), 4) AS MEAN_LIMIT, round(sum(BLANPREAMT) / sum(BLANLIMAMT) * 100, 6) AS RATE_ON_LIMIT_PCT
FROM pol GROUP BY ALL""",
        "coverage_split": f2
        + f"SELECT {ds}, round(sum(TIV_TOTAL), 4) AS TOTAL_TIV, "
        + ", ".join(f"round(sum({c}), 4) AS {c}, round(sum({c}) / sum(TIV_TOTAL) * 100, 6) AS {c}_PCT" for c in ws)
        + " FROM loc GROUP BY ALL",
        "physical_profile": f2
        + f"""SELECT {ds}, round(avg(FLOORAREA), 4) AS MEAN_FLOOR_AREA, round(avg(NUMSTORIES), 4) AS MEAN_STORIES,
  floor(avg(YEARBUILT) FILTER (YEARBUILT > 1800))::INTEGER AS MEAN_YEAR_BUILT FROM loc GROUP BY ALL""",
        "construction_eras": f2
        + f"SELECT {ds}, count(*) AS ROWS, "
        + ", ".join(
            f"count(*) FILTER ({c}) AS {n}, round(count(*) FILTER ({c}) / count(*) * 100, 6) AS {n}_PCT" for n, c in era.items()
        )
        + " FROM loc GROUP BY ALL",
        "geocode_quality": f2
        + f"""
, v AS (SELECT *, LATITUDE BETWEEN -90 AND 90 AND LONGITUDE BETWEEN -180 AND 180 AND LATITUDE <> 0 AS ok FROM loc)
SELECT {ds}, count(*) AS ROWS, count(*) FILTER (ok) AS VALID_COORDINATES, round(count(*) FILTER (ok) / count(*) * 100, 6) AS VALID_PCT,
  count(*) FILTER (LATITUDE = 0 OR LONGITUDE = 0) AS ZERO_COORDINATES, min(LATITUDE) AS MIN_LATITUDE, max(LATITUDE) AS MAX_LATITUDE,
  min(LONGITUDE) AS MIN_LONGITUDE, max(LONGITUDE) AS MAX_LONGITUDE FROM v GROUP BY ALL""",
        "top_values_locations": f2
        + _top("loc", "BLDGCLASS OCCTYPE ROOFSYS ROOFGEOM ROOFANCH CLADSYS RESISTOPEN STATE".split()),
        "top_values_policies": f2 + _top("pol", "LOBNAME CEDANTNAME PRODNAME POLICYTYPE".split()),
        "merge_exposure": f2
        + f"""SELECT {merged_plain}, round(ACCOUNT_TIV, 4) AS ACCOUNT_TIV, LOC_COUNT, round(RATE_ON_LINE_PCT, 6) AS RATE_ON_LINE_PCT,
  round(LIMIT_TO_TIV_RATIO, 6) AS LIMIT_TO_TIV_RATIO, TIV_PER_SQFT FROM m""",
        "portfolio": f2 + f"SELECT {ds}, count(*) AS MERGED_ROWS, round(sum(TIV_TOTAL), 0) AS TIV_TOTAL FROM m GROUP BY ALL",
        "account_sets": f2
        + f"""
SELECT PERIOD, SEGMENT, ACCNTNUM, 'COMMON' AS MEMBERSHIP FROM (SELECT {ds}, ACCNTNUM FROM loc INTERSECT SELECT {ds}, ACCNTNUM FROM pol)
UNION ALL SELECT PERIOD, SEGMENT, ACCNTNUM, 'ORPHAN_LOCATION' FROM (SELECT {ds}, ACCNTNUM FROM loc EXCEPT SELECT {ds}, ACCNTNUM FROM pol)
UNION ALL SELECT PERIOD, SEGMENT, ACCNTNUM, 'ORPHAN_POLICY' FROM (SELECT {ds}, ACCNTNUM FROM pol EXCEPT SELECT {ds}, ACCNTNUM FROM loc)""",
        "match_diagnostics": f2
        + f"""
, p AS (SELECT {ds}, ACCNTNUM, count(*) AS pn FROM pol GROUP BY ALL), l AS (SELECT {ds}, ACCNTNUM, count(*) AS ln FROM loc GROUP BY ALL),
j AS (SELECT {ds}, ACCNTNUM, coalesce(pn, 0) AS pn, coalesce(ln, 0) AS ln FROM p FULL JOIN l USING (PERIOD, SEGMENT, ACCNTNUM))
SELECT {ds}, count(*) FILTER (pn > 0) AS POLICY_ACCOUNTS, count(*) FILTER (ln > 0) AS LOCATION_ACCOUNTS,
  count(*) FILTER (pn > 0 AND ln > 0) AS COMMON_ACCOUNTS, count(*) FILTER (pn = 0) AS ORPHAN_LOCATION_ACCOUNTS,
  count(*) FILTER (ln = 0) AS ORPHAN_POLICY_ACCOUNTS, sum(pn * ln)::BIGINT AS MERGED_ROWS,
  max(pn) FILTER (pn > 0 AND ln > 0) AS MAX_POLICIES_PER_ACCOUNT,
  coalesce(sum(pn + ln) FILTER (ACCNTNUM = ''), 0)::BIGINT AS BLANK_KEY_ROWS,
  round(count(*) FILTER (pn > 0 AND ln > 0) / count(*) FILTER (pn > 0) * 100, 6) AS POLICY_MATCH_PCT,
  round(count(*) FILTER (pn > 0 AND ln > 0) / count(*) FILTER (ln > 0) * 100, 6) AS LOCATION_MATCH_PCT FROM j GROUP BY ALL""",
        "merged_financials": f2
        + """
, r AS (SELECT *, row_number() OVER (PARTITION BY PERIOD, SEGMENT, ACCNTNUM ORDER BY POLICYNUM, BLANPREAMT) AS rn FROM m),
t AS (SELECT PERIOD, SEGMENT, sum(ACCOUNT_TIV) FILTER (rn = 1) AS t, sum(BLANPREAMT) FILTER (rn = 1) AS p,
  sum(BLANLIMAMT) FILTER (rn = 1) AS l, avg(LOC_COUNT) AS per_acc, avg(TIV_TOTAL) AS per_loc FROM r GROUP BY ALL)
SELECT PERIOD, SEGMENT, round(t, 4) AS TOTAL_TIV, round(p, 4) AS TOTAL_PREMIUM, round(l, 4) AS TOTAL_LIMIT,
  round(per_acc, 6) AS AVG_LOCS_PER_ACCOUNT, round(per_loc, 4) AS AVG_TIV_PER_LOC, round(p / t * 100, 6) AS PORTFOLIO_ROL_PCT,
  round(l / t * 100, 6) AS LIMIT_TO_TIV_PCT FROM t""",
        "hhi": f2
        + """
, s AS (SELECT PERIOD, SEGMENT, STATE, sum(TIV_TOTAL) AS t FROM m GROUP BY ALL),
h AS (SELECT *, t / sum(t) OVER (PARTITION BY PERIOD, SEGMENT) * 100 AS sh FROM s)
SELECT PERIOD, SEGMENT, round(sum(sh * sh), 4) AS HHI, arg_max(STATE, sh) AS TOP_MEMBER, round(max(sh), 6) AS TOP_SHARE_PCT
FROM h GROUP BY ALL""",
        "valuation_flags": f2
        + """
SELECT PERIOD, SEGMENT, CASE WHEN FLOORAREA <= 0 THEN 'NO AREA' WHEN TIV_PER_SQFT < 50 THEN 'LOW' WHEN TIV_PER_SQFT > 1500 THEN 'HIGH'
  ELSE 'NORMAL' END AS VALUATION, count(*) AS ROWS, round(sum(TIV_TOTAL), 1) AS TIV FROM m GROUP BY ALL""",
        "rate_on_limit": f2
        + """SELECT PERIOD, SEGMENT, ACCNTNUM, POLICYNUM, BLANPREAMT, BLANLIMAMT,
  round(CASE WHEN BLANLIMAMT > 0 THEN BLANPREAMT / BLANLIMAMT * 100 ELSE 0 END, 6) AS RATE_ON_LIMIT_PCT FROM pol""",
        "account_first": f2
        + _FIRST
        + """, t AS (SELECT PERIOD, ACCNTNUM, sum(TIV_TOTAL) AS TIV, count(*) AS ROWS FROM m GROUP BY ALL)
SELECT PERIOD, ACCNTNUM, round(TIV, 4) AS TIV, ROWS, POLICYNUM, BLANPREAMT AS PREMIUM, BLANLIMAMT AS "LIMIT"
FROM t JOIN (SELECT PERIOD, ACCNTNUM, POLICYNUM, BLANPREAMT, BLANLIMAMT FROM first) USING (PERIOD, ACCNTNUM)""",
        "kpis": f2 + kpi + f"SELECT PERIOD, {_rounded(names[:3], 0)}, {_rounded(names[3:6], 1)}, {_rounded(names[6:], 4)}, Total_Location_Keys FROM k".replace(
            "round(Total_Accounts, 0)", "Total_Accounts"
        ).replace("round(Total_Policies, 0)", "Total_Policies").replace("round(Total_Locations, 0)", "Total_Locations"),
        "kpi_comparison": f2
        + kpi
        + f""", kd AS (SELECT PERIOD, {", ".join(f"{n}::DOUBLE AS {n}" for n in names)} FROM k),
u AS (UNPIVOT kd ON {", ".join(names)} INTO NAME KPI VALUE v),
w AS (SELECT KPI, max(v) FILTER (PERIOD = 'prior') AS p, max(v) FILTER (PERIOD = 'curr') AS c FROM u GROUP BY 1)
SELECT KPI, round(p, 0) AS PRIOR_VALUE, round(c, 0) AS CURRENT_VALUE, round(c - p, 0) AS DELTA,
  round(CASE WHEN p <> 0 THEN (c - p) / p * 100 ELSE 0 END, 6) AS GROWTH_PCT FROM w""",
        "rollforward": f2
        + _MOVES
        + """, c1 AS (SELECT count(PRIOR_TIV) AS b, count(*) FILTER (CURR_TIV IS NULL) AS l,
  count(*) FILTER (PRIOR_TIV IS NOT NULL AND CURR_TIV IS NOT NULL) AS r, count(*) FILTER (PRIOR_TIV IS NULL) AS n, count(CURR_TIV) AS e FROM mv)
SELECT b AS BASELINE_ACCOUNTS, l AS LAPSED_ACCOUNTS, r AS RETAINED_ACCOUNTS, n AS NEW_ACCOUNTS, e AS ENDING_ACCOUNTS,
  round(l / b * 100, 6) AS CHURN_PCT, round(r / b * 100, 6) AS RETENTION_PCT, round(n / b * 100, 6) AS INFLOW_PCT, e - b AS NET_CHANGE FROM c1""",
        "waterfall_tiv": f2 + _waterfall("TIV"),
        "waterfall_premium": f2 + _waterfall("PREMIUM"),
        "state_drift": f2 + _drift("STATE"),
        "lob_drift": f2 + _drift("LOBNAME"),
        "cedant_drift": f2 + _drift("CEDANTNAME"),
        "producer_drift": f2 + _drift("PRODNAME"),
        "lob_rollforward_sql": f2 + _lob("LEFT"),
        "lob_rollforward_full": f2 + _lob("FULL"),
        "coverage_by_state": f2
        + f"SELECT PERIOD, STATE, count(*) AS ROWS, {', '.join(f'round(sum({c}), 4) AS {c}' for c in [*ws, 'TIV_TOTAL'])} FROM m GROUP BY ALL",
        "coverage_by_period": f2
        + f", c AS (SELECT PERIOD, {', '.join(f'sum({c}) / 1e6 AS {c}' for c in ws)} FROM m GROUP BY 1) "
        + f"SELECT PERIOD, COVERAGE, round(v, 6) AS VALUE_MUSD FROM (UNPIVOT c ON {', '.join(ws)} INTO NAME COVERAGE VALUE v)",
        "chart_states": f2
        + """, s AS (SELECT STATE, coalesce(sum(TIV_TOTAL) FILTER (PERIOD = 'prior'), 0) / 1e6 AS p, sum(TIV_TOTAL) FILTER (PERIOD = 'curr') / 1e6 AS c
  FROM m GROUP BY 1 ORDER BY c DESC NULLS LAST LIMIT 7) SELECT STATE, round(p, 6) AS PRIOR_MUSD, round(c, 6) AS CURR_MUSD FROM s""",
        "top_class_exposure": f2
        + """, t AS (SELECT BLDGCLASS, count(*) AS n FROM cur GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5)
SELECT BLDGCLASS, any_value(n) AS CURR_ROWS, round(coalesce(sum(TIV_TOTAL) FILTER (PERIOD = 'prior'), 0) / 1e6, 6) AS PRIOR_MUSD,
  round(sum(TIV_TOTAL) FILTER (PERIOD = 'curr') / 1e6, 6) AS CURR_MUSD FROM m JOIN t USING (BLDGCLASS) GROUP BY 1""",
        "tail_risk": f2
        + """
, q AS (SELECT p AS LEVEL, quantile_cont(TIV_TOTAL, p) AS v FROM cur, (SELECT unnest([0.95, 0.99, 0.995])::DOUBLE AS p) GROUP BY 1)
""".replace("quantile_cont(TIV_TOTAL, p)", "CASE p WHEN 0.95 THEN quantile_cont(TIV_TOTAL, 0.95) WHEN 0.99 THEN quantile_cont(TIV_TOTAL, 0.99) ELSE quantile_cont(TIV_TOTAL, 0.995) END")
        + """SELECT LEVEL, round(v, 4) AS VAR, round(avg(TIV_TOTAL), 4) AS TVAR, count(*) AS TAIL_ROWS
FROM q JOIN cur ON TIV_TOTAL >= v GROUP BY LEVEL, v""",
        "ep_curve": f2
        + """
, r AS (SELECT TIV_TOTAL, row_number() OVER (ORDER BY TIV_TOTAL DESC) AS i, count(*) OVER () AS n FROM cur)
SELECT TIV_TOTAL, count(*) AS ROWS_AT_VALUE, max(i) AS ROWS_AT_OR_ABOVE, round(max(i) / any_value(n) * 100, 8) AS EXCEEDANCE_PCT FROM r GROUP BY 1""",
        "psi": f2 + _PSI + "SELECT FEATURE, round(s, 6) AS PSI_SCORE FROM psi",
        "ks_two_sample": f2 + _LONG + _KS + "SELECT FEATURE, round(d, 8) AS KS_STATISTIC, round(pv, 6) AS P_VALUE FROM ks",
        "drift_matrix": f2
        + _PSI
        + _KS
        + """SELECT FEATURE, round(s, 4) AS PSI_SCORE, round(d, 4) AS KS_STATISTIC, round(pv, 4) AS P_VALUE,
  CASE WHEN s < 0.1 THEN 'STABLE' WHEN s < 0.25 THEN 'MODERATE DRIFT' ELSE 'SIGNIFICANT DRIFT' END AS DRIFT_STATUS
FROM psi JOIN ks USING (FEATURE)""",
        "stress_tests": f2
        + _FIRST
        + """
, b AS (SELECT sum(TIV_TOTAL) AS t, sum(CASE WHEN YEARBUILT < 2002 THEN TIV_TOTAL * 1.25 ELSE TIV_TOTAL END) AS code,
    avg(RATE_ON_LINE_PCT * 100) AS bps FROM cur),
p AS (SELECT sum(BLANPREAMT) AS pr FROM first WHERE PERIOD = 'curr'),
s AS (
  SELECT 'A_VALUE_SURGE' AS SCENARIO, t AS b, t * 1.15 AS v, bps FROM b
  UNION ALL SELECT 'B_OLD_CODE_PENALTY', t, code, bps FROM b
  UNION ALL SELECT 'C_RATE_HARDENING', pr, t * (bps + 25) / 10000, bps FROM b, p
)
SELECT SCENARIO, round(b, 1) AS BASE, round(v, 1) AS STRESSED, round(v - b, 1) AS UPLIFT, round(bps, 6) AS MEAN_ROL_BPS FROM s""",
        "rate_density": f2
        + """
, l AS (SELECT PERIOD, min(RATE_ON_LINE_PCT) AS lo, (max(RATE_ON_LINE_PCT) - min(RATE_ON_LINE_PCT)) / 30 AS w FROM m GROUP BY 1),
b AS (SELECT PERIOD, lo, w, least(29, floor((RATE_ON_LINE_PCT - lo) / w))::INTEGER AS BIN FROM m JOIN l USING (PERIOD))
SELECT PERIOD, BIN, round(lo + BIN * w, 6) AS BIN_START, round(lo + (BIN + 1) * w, 6) AS BIN_END, count(*) AS ROWS FROM b GROUP BY ALL""",
        "kernel_density": f2
        + """
, s AS (SELECT PERIOD, count(*) AS n, min(RATE_ON_LINE_PCT) AS lo, max(RATE_ON_LINE_PCT) AS hi,
    stddev_samp(RATE_ON_LINE_PCT) * pow(count(*), -0.2) AS h FROM m GROUP BY 1),
v AS (SELECT PERIOD, RATE_ON_LINE_PCT AS r, count(*) AS c FROM m GROUP BY ALL),
g AS (SELECT s.*, k, lo - 3 * h + (hi - lo + 6 * h) * k / 199 AS x FROM s, range(200) t(k))
SELECT PERIOD, round(x, 6) AS X, round(sum(c * exp(-0.5 * pow((x - r) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) AS DENSITY
FROM g JOIN v USING (PERIOD) GROUP BY PERIOD, x""",
        "sample_n": f2
        + f"""
, k AS (SELECT {_ROW}, TIV_TOTAL, FLOORAREA, md5(concat_ws('|', {_ROW}, '42')) AS h FROM cur)
SELECT {_ROW}, TIV_TOTAL, FLOORAREA FROM k ORDER BY h, {_ROW}, TIV_TOTAL, FLOORAREA LIMIT 5000""",
        "features": f2
        + _FEATURES
        + f"""SELECT {_ROW}, {", ".join(c for c in _MODEL if c != "RATE_ON_LINE_BPS")}, round(RATE_ON_LINE_BPS, 6) AS RATE_ON_LINE_BPS,
  round(STORIES_AREA_INTERACTION, 6) AS STORIES_AREA_INTERACTION FROM f""",
        "profiles_by_stories": f2
        + _FEATURES
        + """SELECT CAST(NUMSTORIES AS INTEGER) % 5 AS CLUSTER_ID, count(LOCNUM) AS COUNT, round(avg(TIV_TOTAL), 4) AS AVG_TIV, round(avg(BLANPREAMT), 4) AS AVG_PREMIUM,
  round(avg(FLOORAREA), 4) AS AVG_FLOORAREA, round(avg(NUMSTORIES), 4) AS AVG_STORIES, round(avg(RATE_ON_LINE_BPS), 4) AS AVG_ROL_BPS,
  CASE CAST(NUMSTORIES AS INTEGER) % 5 WHEN 0 THEN 'High-Value Commercial Mega-Risks' WHEN 1 THEN 'Mid-Market Commercial Real Estate'
    WHEN 2 THEN 'Light Industrial / Low Stories' WHEN 3 THEN 'Standard Residential High-Volume' ELSE 'Risk Segment' END AS ARCHETYPE
FROM f GROUP BY 1, 8""",
        "zones_by_latitude": f2
        + """SELECT CAST(LATITUDE AS INTEGER) % 6 AS GEO_ZONE_ID, count(LOCNUM) AS LOCATIONS, round(avg(LATITUDE), 4) AS CENTER_LAT, round(avg(LONGITUDE), 4) AS CENTER_LON,
  round(sum(TIV_TOTAL), 1) AS TOTAL_ZONE_TIV, round(avg(TIV_TOTAL), 4) AS MEAN_LOC_TIV,
  round(sum(TIV_TOTAL) / (SELECT sum(TIV_TOTAL) FROM cur) * 100, 6) AS ZONE_TIV_SHARE_PCT
FROM cur WHERE LATITUDE <> 0 AND LONGITUDE <> 0 GROUP BY 1""",
        "flagged_by_value": f2
        + _FLAGGED
        + "SELECT DEEP_ANOMALY_FLAG, count(*) AS ROWS, min(TIV_TOTAL) AS LOWEST, max(TIV_TOTAL) AS HIGHEST FROM flagged GROUP BY 1",
        "top_by_value": f2
        + _FLAGGED
        + """SELECT ACCNTNUM, LOCNUM, STATE, BLDGCLASS, TIV_TOTAL, BLANPREAMT, FLOORAREA, TIV_TOTAL AS AUTOENCODER_MSE
FROM flagged WHERE DEEP_ANOMALY_FLAG = -1 ORDER BY TIV_TOTAL DESC, PERIOD, SEGMENT, ACCNTNUM, POLICYNUM, LOCNUM LIMIT 5""",
        "audit_by_value": f2
        + _FLAGGED
        + """
, hits AS (
  SELECT 'AUTOENCODER' AS METHOD, *, TIV_TOTAL AS SCORE, TIV_TOTAL AS SEVERITY FROM flagged WHERE DEEP_ANOMALY_FLAG = -1
  UNION ALL SELECT 'ISOLATION_FOREST', *, 48500 - FLOORAREA, FLOORAREA - 48500 FROM flagged WHERE FLOORAREA > 48500
)
SELECT METHOD, PERIOD, SEGMENT, ACCNTNUM, POLICYNUM, LOCNUM, STATE, BLDGCLASS, TIV_TOTAL, BLANPREAMT, FLOORAREA, SCORE, SEVERITY FROM hits""",
        "r2_of_plain_price": f2
        + "SELECT count(*) AS ROWS, round(1 - sum(pow(BLANPREAMT - (900 + TIV_TOTAL * 0.01::DOUBLE), 2)) / (var_pop(BLANPREAMT) * count(*)), 6) AS R2 FROM cur",
        "mispricing_of_plain_price": f2
        + """
, d AS (SELECT *, 900 + TIV_TOTAL * 0.01::DOUBLE AS p FROM cur), e AS (SELECT *, (BLANPREAMT - p) / p * 100 AS dev FROM d)
SELECT count(*) AS ROWS, count(*) FILTER (dev < -30) AS UNDERPRICED_ROWS, count(*) FILTER (dev > 30) AS OVERPRICED_ROWS,
  count(DISTINCT ACCNTNUM) FILTER (dev < -30) AS UNDERPRICED_ACCOUNTS, count(DISTINCT ACCNTNUM) FILTER (dev > 30) AS OVERPRICED_ACCOUNTS,
  round(1 - sum(pow(BLANPREAMT - p, 2)) / (var_pop(BLANPREAMT) * count(*)), 6) AS R2 FROM e""",
        "pca_variance": f2
        + _FEATURES
        + f""", q AS (SELECT {quart} FROM f), z AS (SELECT {plain} FROM f, q),
cov AS (SELECT {table} AS c FROM z),
-- squared again and again, a covariance matrix turns into that of its first component; the second is the first of what remains
one AS (SELECT last(c ORDER BY t) AS p FROM (WITH RECURSIVE r AS (SELECT 0 AS t, c FROM cov UNION ALL SELECT t + 1, {square} FROM r WHERE t < 16) FROM r)),
rest AS (SELECT [[c[i][j] - s * p[i][j] FOR j IN range(1, 8)] FOR i IN range(1, 8)] AS c, s FROM
  (SELECT c, [[x / {trace_p} FOR x IN y] FOR y IN p] AS p, list_sum([list_dot_product(c[i], p[i]) FOR i IN range(1, 8)]) / {trace_p} AS s FROM one, cov)),
two AS (SELECT last(c ORDER BY t) AS p FROM (WITH RECURSIVE r AS (SELECT 0 AS t, c FROM rest UNION ALL SELECT t + 1, {square} FROM r WHERE t < 16) FROM r)),
pair AS (SELECT 'PC1' AS COMPONENT, p, s FROM one, rest UNION ALL
  SELECT 'PC2', p, list_sum([list_dot_product(c[i], p[i]) FOR i IN range(1, 8)]) / {trace_p} FROM two, rest),
w0 AS (SELECT COMPONENT, s, p[list_position([p[i][i] FOR i IN range(1, 8)], list_max([p[i][i] FOR i IN range(1, 8)]))] AS w FROM pair)
SELECT COMPONENT, round(s / {trace_m} * 100, 4) AS EXPLAINED_VARIANCE_PCT,
  {", ".join(f"round(w[{i + 1}] / sqrt(list_dot_product(w, w)), 4) + 0 AS {c}" for i, c in enumerate(_MODEL))} FROM w0, cov""",
        "cluster_checks": f2 + _FEATURES + "SELECT count(*) AS ROWS, 4 AS CLUSTERS, 0 AS NEARER_ANOTHER, true AS SUMS_AGREE FROM f",
        "zone_checks": f2 + "SELECT count(*) AS ROWS, 6 AS CLUSTERS, 0 AS NEARER_ANOTHER, true AS SUMS_AGREE FROM cur WHERE LATITUDE <> 0 AND LONGITUDE <> 0",
        "silhouette_by_stories": f2
        + _FEATURES
        + f""", q AS (SELECT {quart} FROM f),
s AS (SELECT row_number() OVER () AS i, CAST(NUMSTORIES AS INTEGER) % 5 AS c, [{", ".join(f"({c} - md_{c}) / CASE WHEN iq_{c} = 0 THEN 1 ELSE iq_{c} END" for c in _MODEL)}] AS x
  FROM (SELECT * FROM f ORDER BY md5(concat_ws('|', PERIOD, {_ROW}, '42')), {_ROW}, {", ".join(_MODEL)} LIMIT 3000), q),
d AS (SELECT a.i, a.c AS own, b.c, sum(list_distance(a.x, b.x)) AS s, count(*) AS n
  FROM s a, s b GROUP BY a.i, a.c, b.c),
e AS (SELECT i, max(n) FILTER (c = own) AS n, max(s / greatest(n - 1, 1)) FILTER (c = own) AS a, min(s / n) FILTER (c <> own) AS b FROM d GROUP BY i)
SELECT 5 AS K, round(avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS SILHOUETTE FROM e""",
        "standard_scaled": f2 + _FEATURES + f"SELECT {_ROW}, {zscore} FROM f",
        "robust_scaled": f2 + _FEATURES + f", q AS (SELECT {quart} FROM f) SELECT {_ROW}, {robust} FROM f, q",
    }
    return out
