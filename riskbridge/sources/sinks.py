"""Audit files."""

from pyspark.sql import DataFrame


def write_audit(df: DataFrame, path: str, skip_empty: bool = False) -> bool:
    """Write a result as CSV with a header; returns whether anything was written."""
    if skip_empty and df.isEmpty():
        return False
    df.write.mode("overwrite").option("header", True).csv(path)
    return True
