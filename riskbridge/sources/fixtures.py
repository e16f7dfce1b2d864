"""The star-schema test tables seen as location and policy schedules."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskbridge import schema as S
from riskbridge.functions.columns import add_tiv, conform

# Market segments taken as commercial business.
COMMERCIAL_MARKETS = ["BUILDING", "MACHINERY", "AUTOMOBILE"]


# Columns used of each table. Declared, so that no file is opened to learn them.
TABLES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "part": "p_partkey bigint, p_brand string, p_type string, p_size int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str, account: str) -> DataFrame:
    """All orders with their account, period (before 2000, or from then on) and segment."""
    orders = _read(spark, sf_dir, "orders")
    customer = _read(spark, sf_dir, "customer")
    key = {"order": "o_orderkey", "customer": "o_custkey"}[account]
    return orders.join(customer, orders.o_custkey == customer.c_custkey).withColumns(
        {
            "PERIOD": F.when(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"), S.PRIOR).otherwise(S.CURRENT),
            "SEGMENT": F.when(F.col("c_mktsegment").isin(COMMERCIAL_MARKETS), S.COMMERCIAL).otherwise(S.STANDARD),
            "ACCNTNUM": F.col(key).cast("string"),
        }
    )


def policies(spark: SparkSession, sf_dir: str, account: str = "customer") -> DataFrame:
    """One policy per order; the account is the customer or the order itself."""
    # nation and region are fixed lists of 25 and 5 rows, whatever the scale
    nation = F.broadcast(_read(spark, sf_dir, "nation"))
    region = F.broadcast(_read(spark, sf_dir, "region"))
    rows = (
        _orders(spark, sf_dir, account)
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return conform(
        rows.select(
            *S.ACCOUNT,
            F.col("c_name").alias("ACCNTNAME"),
            F.col("n_name").alias("PRODNAME"),
            F.col("r_regionkey").cast("string").alias("CEDANTID"),
            F.col("r_name").alias("CEDANTNAME"),
            F.col("o_orderkey").cast("string").alias("POLICYNUM"),
            F.col("o_orderpriority").alias("LOBNAME"),
            F.col("o_orderstatus").alias("POLICYTYPE"),
            (F.col("o_totalprice") * 0.01).alias("BLANPREAMT"),
            F.lit("USD").alias("BLANPRECUR"),
            (F.col("o_totalprice") * 0.8).alias("BLANLIMAMT"),
        )
    )


def locations(spark: SparkSession, sf_dir: str, account: str = "customer") -> DataFrame:
    """One location per line item."""
    nation = F.broadcast(_read(spark, sf_dir, "nation"))
    orders = _orders(spark, sf_dir, account).select("o_orderkey", *S.ACCOUNT)
    rows = (
        _read(spark, sf_dir, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(_read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(_read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    price, tax = F.col("l_extendedprice"), F.col("l_tax")
    commercial = F.col("SEGMENT") == S.COMMERCIAL

    def unless_multiple(n, value):
        return F.when(F.col("l_partkey") % n == 0, 0.0).otherwise(value)

    return conform(
        add_tiv(
            rows.select(
                *S.ACCOUNT,
                (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("LOCNUM"),
                F.col("n_name").alias("STATE"),
                F.col("p_type").alias("BLDGCLASS"),
                F.col("p_brand").alias("OCCTYPE"),
                unless_multiple(20, 1955.0 + F.col("p_size")).alias("YEARBUILT"),
                unless_multiple(25, F.col("l_quantity") * 1000.0).alias("FLOORAREA"),
                (1.0 + F.col("l_suppkey") % 12).alias("NUMSTORIES"),
                unless_multiple(40, 25.0 + F.col("l_suppkey") % 25).alias("LATITUDE"),
                (-(70.0 + F.col("l_suppkey") % 50)).alias("LONGITUDE"),
                price.alias("WSCV4VAL"),
                (price * F.col("l_discount")).alias("WSCV5VAL"),
                (price * tax).alias("WSCV6VAL"),
                (F.col("l_quantity") * 100.0).alias("WSCV7VAL"),
                F.when(commercial, price).otherwise(0.0).alias("TOCV4VAL"),
                F.when(commercial, price * 2 * tax).otherwise(0.0).alias("TOCV6VAL"),
                F.col("l_returnflag").alias("ROOFSYS"),
                F.col("l_linestatus").alias("ROOFGEOM"),
            )
        )
    )
