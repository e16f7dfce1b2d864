"""Written intermediate results, for plans that are read several times."""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Spark deletes the shuffle files of a finished query at once, not when the driver's garbage collection gets to it.
DROP_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the time of a block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str | None:
    """The shared folder named by spark.checkpoint.dir; None in a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or None


def scratch_dir(spark: SparkSession) -> str:
    """A folder that all executors share, for files that must be files: the named one, else the warehouse."""
    return shared_dir(spark) or spark.conf.get("spark.sql.warehouse.dir")


def durable(df: DataFrame, partition_by: list[str] | None = None, bucket_by: list[str] | None = None) -> DataFrame:
    """Write the rows as Parquet in the shared folder and read them back.

    The result has no lineage to recompute, outlives lost executors, and keeps column pruning and
    filter pushdown for the passes that follow. A local session without such a folder keeps the rows
    in Spark's own storage instead, with their lineage. With `bucket_by` rows lie in as many buckets of these columns as a shuffle has
    partitions, so that joins and groups by them don't shuffle the rows again.
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    if folder is None:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = f"{folder}/riskbridge-{uuid.uuid4().hex}"
    with settings(spark, **DROP_SHUFFLES):  # what was written needs them no more
        if bucket_by:
            name = f"riskbridge_{uuid.uuid4().hex}"
            df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *bucket_by).option("path", path).saveAsTable(name, format="parquet")
            return spark.table(name)
        df.write.partitionBy(*(partition_by or [])).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
