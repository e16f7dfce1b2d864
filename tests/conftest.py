import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from riskbridge import schema as S  # noqa: E402
from riskbridge.functions.columns import conform, normalize  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def hot(spark):
    """Treat every key with more than two rows as hot."""
    spark.conf.set("riskbridge.hotRows", "2")
    yield
    spark.conf.unset("riskbridge.hotRows")


@pytest.fixture
def frame(spark):
    """Text rows under the given headers, normalised and tagged, as an extract would be."""

    def make(headers, rows, period=S.CURRENT, segment=S.COMMERCIAL):
        names = headers.split() if isinstance(headers, str) else headers
        schema = ", ".join(f"`{n}` string" for n in names)
        text = [tuple(None if v is None else str(v) for v in r) for r in rows]
        df = conform(normalize(spark.createDataFrame(text, schema)))
        return df.select(F.lit(period).alias("PERIOD"), F.lit(segment).alias("SEGMENT"), "*")

    return make


def rows_of(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())
