"""Every registered query against its plain SQL, and the whole analysis over CSV extracts."""

import sys
from pathlib import Path

import pytest
from conftest import SF

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
import __spark_entry__ as entry  # noqa: E402
import compare  # noqa: E402
from riskbridge import schema as S  # noqa: E402
from riskbridge.plans.exposure import Exposure  # noqa: E402
from riskbridge.sources.fixtures import locations, policies  # noqa: E402
from riskbridge.sources.ingest import Extract  # noqa: E402

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", SQL)
def test_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    names, _, expected = compare.oracle(con, SQL[name])
    assert compare.difference(compare.canonical(df.columns, [tuple(r) for r in df.collect()]), compare.canonical(names, expected)) is None


def test_registry():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 5 and df.columns[-1] == "TIV_RANK"


def test_whole_analysis(spark, tmp_path):
    extracts = []
    for period in (S.PRIOR, S.CURRENT):
        for segment, short in ((S.COMMERCIAL, "com"), (S.STANDARD, "std")):
            for kind, table in (("loc", locations), ("pol", policies)):
                path = f"{tmp_path}/{period}_{short}_{kind}"
                df = table(spark, SF).filter(f"PERIOD = '{period}' and SEGMENT = '{segment}'")
                df.drop("PERIOD", "SEGMENT", *S.TIV_COLUMNS).write.option("header", True).csv(path)
                extracts.append(Extract(f"{period}_{short}_{kind}", period, segment, path))
    book = Exposure(spark, extracts)
    written = book.run(f"{tmp_path}/out")
    assert all(written.values()) and len(written) == 5
    kpis = spark.read.csv(f"{tmp_path}/out/kpi_comparison", header=True)
    assert kpis.count() == 9
    assert spark.read.csv(f"{tmp_path}/out/cat_zones", header=True).count() == 6
    # a user's own SQL over the merged rows agrees with the report that never builds them
    own = book.sql("SELECT LOBNAME, sum(TIV_TOTAL) AS t, count(LOCNUM) AS n FROM portfolio_curr GROUP BY LOBNAME")
    report = {r.LINE_OF_BUSINESS: r for r in book.sql_reports()["lob_rollforward"].collect()}
    rows = own.collect()
    assert rows and all(report[r.LOBNAME].CURR_TIV == pytest.approx(r.t) and report[r.LOBNAME].CURR_LOCATIONS == r.n for r in rows)
    assert book.sql("SELECT * FROM drift_state_mom").count() > 0 and book.sql("SELECT * FROM curr_std_loc").count() > 0
    summary = book.profile()["summary"].collect()
    assert set(book.results) == {"profile", "merge", "months", "sql", "statistics", "models", "charts"}
    curve = book.results["statistics"]["ep_curve"]
    assert curve.count() == curve.select("TIV_TOTAL").distinct().count() > 1000
    assert "CLUSTER_ID" in book.results["charts"]["pca_sample"].columns
    assert len(summary) == 8 and {r.COLS for r in summary} == {53, 13}
