"""Rows are gone over once for what a few of them decide."""

from pyspark.sql import functions as F

from riskbridge.functions import order
from riskbridge.operators import merge


def test_policy_ratios_are_rounded_before_rows_multiply(frame):
    loc = frame("ACCNTNUM LOCNUM WSCV4VAL", [("A", i, 10 / 3) for i in range(3)])
    pol = frame("ACCNTNUM POLICYNUM BLANPREAMT BLANLIMAMT", [("A", i, 1 + i, 7) for i in range(2)])
    digits = {"RATE_ON_LINE_PCT": 2, "LIMIT_TO_TIV_RATIO": 2, "ACCOUNT_TIV": 1}
    early = merge.merge_exposure(loc, pol, digits=digits)
    late = merge.merge_exposure(loc, pol).withColumns({c: F.round(c, n) for c, n in digits.items()})
    assert sorted(early.collect(), key=str) == sorted(late.select(*early.columns).collect(), key=str)
    assert early.count() == 6


def test_inner_values_are_written_once(spark, monkeypatch):
    """Levels of crowded buckets read the written values, not the rows: one scan for the totals, one for the values."""
    written = []
    monkeypatch.setattr(order, "durable", lambda df: written.append(df) or spark.createDataFrame(df.collect(), df.schema))
    spark.conf.set("riskbridge.sortedValues", "4")
    rows = spark.range(900).select(F.lit("f").alias("g"), (1 + F.col("id") / 1e7).alias("x"), (F.col("id") % 2).alias("l"), (F.col("id") % 3).alias("r"))
    gap, mid = order.widest_gap(rows, ["g"], "x", "l", "r"), order.quantiles(rows, ["g"], "x", {"m": 0.5})
    for df in (gap, mid):
        assert "Range (0, 900" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert len(written) == 4 and mid.first().m == 1 + 449.5 / 1e7
    spark.conf.unset("riskbridge.sortedValues")
