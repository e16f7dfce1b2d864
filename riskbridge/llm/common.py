"""What the text operators share: inputs, keys of rows, and small tables that may be broadcast."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskbridge.functions.durable import durable

# White space of the contracts, as a Java pattern.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def row_key(ident: Column, text: Column) -> Column:
    """128 bits that stand for a row by its id and text; repeated rows share them."""
    return F.unhex(F.md5(F.concat_ws("\u0000", F.coalesce(ident.cast("string"), F.lit("null")), text)))


def packed(df: DataFrame) -> DataFrame:
    """The whole row as one column, so that its own columns can't clash with those of an operator."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def rows_by_key(df: DataFrame, key: Column, stay: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key is in `stay` (key), one for each; `keys` holds the key of every row. Columns as they were."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), key.alias("key"))
    repeated = durable(keys.join(stay, "key", "left_semi").groupBy("key").count().filter("count > 1").select("key"))
    if repeated.isEmpty():
        return rows.join(stay, "key", "left_semi").select("row.*")
    once = rows.join(stay.join(repeated, "key", "left_anti"), "key", "left_semi").select("row")
    one = rows.join(repeated, "key", "left_semi").groupBy("key").agg(F.first("row").alias("row")).select("row")
    return once.unionByName(one).select("row.*")


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 500_000) -> DataFrame:
    """Broadcast a table of at most `limit` rows of a few numbers; a larger one is joined by shuffling."""
    return F.broadcast(df) if rows <= limit else df
