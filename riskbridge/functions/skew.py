"""Joins that hold up when a few keys own a large share of the rows.

A key is hot when it has more than ``riskbridge.hotRows`` rows (a session setting, 1,000,000 by
default) and more than 1/10,000 of the table, so there are at most 10,000 hot keys and a table of
them is always small enough to broadcast. Hot keys are looked up when a join is built, by counting
rows per key; without any, the join is a plain one. The lookup only decides how rows are spread:
results are whole whatever it finds.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_HOT = 10_000
#: Copies of one row that stay together when a hot key is cut up.
COPIES = 10_000


def hot_keys(rows: DataFrame, on: list[str], parts: str = "_parts", counts: DataFrame | None = None) -> DataFrame | None:
    """Hot keys, with the number of tasks their rows should be cut into; None if there are none.

    `counts`, with `_rows` per key, spares the pass that counts.
    """
    spark = rows.sparkSession
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")) if counts is None else counts
    total = counts.agg(F.sum("_rows")).scalar()
    hot_rows = int(spark.conf.get("riskbridge.hotRows", "1000000"))
    cutoff = F.greatest(F.lit(hot_rows), F.ceil(total / F.lit(MAX_HOT)))
    hot = counts.withColumn("_cutoff", cutoff).filter("_rows > _cutoff")
    hot = hot.select(*on, F.ceil(F.col("_rows") / F.col("_cutoff")).cast("int").alias(parts))
    found = hot.collect()  # at most MAX_HOT rows
    return F.broadcast(spark.createDataFrame(found, hot.schema)) if found else None


def attach(rows: DataFrame, summary: DataFrame, on: list[str], counts: DataFrame | None = None) -> DataFrame:
    """Inner join to a summary that has one row per key.

    Rows of hot keys stay where they are and meet a broadcast of the hot keys' summary; only the
    other rows are shuffled. `counts`: the number of rows per key of the summary as `_rows`, if it is known.
    """
    hot = hot_keys(rows, on, counts=counts)
    if hot is None:
        return rows.join(summary, on)
    keys = hot.select(*on)
    of_hot = F.broadcast(summary.join(keys, on, "left_semi"))
    return rows.join(keys, on, "left_anti").join(summary, on).unionByName(rows.join(of_hot, on))


def _tiles(rows: DataFrame, own: tuple[str, str], other: tuple[str, str], copies: str) -> DataFrame:
    """Cut hot keys into their own tiles, and repeat each piece for every tile of the other side.

    Equal rows are counted and the counts cut into chunks, so that copies of one row spread out
    too. The tile depends on the row's content only: a task that is run again gives the same rows.
    """
    (own_parts, own_tile), (other_parts, other_tile) = own, other
    n = F.col(copies)
    content = list(rows.columns)
    return (
        rows.groupBy(*content)
        .agg(F.count(F.lit(1)).alias(copies))
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / COPIES).cast("int"))))
        .withColumn(copies, F.least(F.lit(COPIES), n - F.col("_chunk") * COPIES))
        .withColumn(own_tile, F.pmod(F.xxhash64(*content, "_chunk"), F.col(own_parts)).cast("int"))
        .withColumn(other_tile, F.explode(F.sequence(F.lit(0), F.col(other_parts) - 1)))
        .drop("_chunk", own_parts, other_parts)
    )


def hot_pairs(counts: DataFrame, on: list[str], left: str, right: str) -> DataFrame | None:
    """Keys with more pairs than a task should make, with the tiles (_lp, _rp) to cut each side into.

    `counts` has one row per key with both sides' numbers of rows. The budget of pairs is ``riskbridge.hotRows`` to
    the power 1.25 (3·10⁷ by default) or 1/10,000 of all pairs, whichever is larger, so there are at most MAX_HOT such
    keys; a tile has about a budget of pairs. Rows count as many pairs as make ``riskbridge.hotRows`` of them a budget, so that
    a key with few pairs but many rows is cut up as well.
    """
    spark = counts.sparkSession
    hot_rows = float(spark.conf.get("riskbridge.hotRows", "1000000"))
    l, r = F.col(left).cast("double"), F.col(right).cast("double")
    weight = F.greatest(l * r, (l + r) * hot_rows**0.25)
    pairs = counts.select(*on, F.col(left).alias("_l"), F.col(right).alias("_r"), weight.alias("_n"))
    total = pairs.agg(F.sum("_n")).scalar()
    budget = F.greatest(F.lit(hot_rows**1.25), total / F.lit(float(MAX_HOT)))
    hot = pairs.withColumn("_tiles", F.col("_n") / budget).filter("_tiles > 1")
    # tiles as square as the sides allow
    side = F.ceil(F.sqrt(F.col("_tiles") * F.col("_l") / F.col("_r")))
    hot = hot.withColumn("_lp", F.greatest(F.lit(1), F.least(side, F.col("_l"), F.ceil(F.col("_tiles")))).cast("int"))
    hot = hot.withColumn("_rp", F.greatest(F.lit(1), F.least(F.ceil(F.col("_tiles") / F.col("_lp")), F.col("_r"))).cast("int")).select(*on, "_lp", "_rp")
    found = hot.collect()  # at most MAX_HOT rows
    return F.broadcast(spark.createDataFrame(found, hot.schema)) if found else None


def grid_join(left: DataFrame, right: DataFrame, on: list[str], counts: DataFrame, sides: tuple[str, str]) -> DataFrame:
    """Inner many-to-many join; the pairs of a hot key are laid out over a grid of tasks.

    `counts` has one row per key with the numbers of left and right rows in the columns `sides`.
    """
    hot = hot_pairs(counts, on, *sides)
    if hot is None:
        return left.join(right, on)
    one = F.lit(1)
    keys = F.broadcast(hot.select(*on))
    cold = left.join(keys, on, "left_anti").join(right.join(keys, on, "left_anti"), on)
    pairs = (
        _tiles(left.join(hot, on), ("_lp", "_lt"), ("_rp", "_rt"), "_lc")
        .join(_tiles(right.join(hot, on), ("_rp", "_rt"), ("_lp", "_lt"), "_rc"), [*on, "_lt", "_rt"])
        .withColumn("_l", F.explode(F.sequence(one.cast("long"), "_lc")))
        .withColumn("_r", F.explode(F.sequence(one.cast("long"), "_rc")))
    )
    return cold.unionByName(pairs.select(*cold.columns))
