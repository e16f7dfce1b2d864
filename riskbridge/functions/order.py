"""Exact order statistics without sorting a column in one task.

Values fall into buckets whose number follows the value order (4,096 per doubling). Bucket totals
are a small table, bounded by the range of the values and not by the number of rows, so running
totals over buckets are cheap; a second pass then looks only into the buckets that matter.

A bucket that holds more values than one task should sort is an index of its own: its range falls into 4,096 buckets, and so do
theirs. At the third level a bucket spans 2^-36 of a doubling, where there are no more than about 2^17 doubles, so that no sort
is larger than that or the budget, however narrow the column is.
"""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskbridge.functions.durable import durable

LEVEL_BITS = 12
LEVELS = 3
PER_OCTAVE = 1 << LEVEL_BITS
OPEN_BUCKETS = 1 << 18  # buckets that are broadcast, a few MB
SORTED_VALUES = 1 << 18  # different values of a bucket that one task sorts; riskbridge.sortedValues overrides it


def order_bucket(x: Column, level: int = 0) -> Column:
    """A whole number that never decreases as x grows; a level's buckets lie inside those of the level before."""
    per_octave = PER_OCTAVE << (LEVEL_BITS * level)
    size = F.floor(F.least(F.log2(F.abs(x)), F.lit(1025.0)) * per_octave) + 1100 * per_octave  # above |log2| of any finite double
    return F.when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0).cast("long"))


def _budget(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("riskbridge.sortedValues", str(SORTED_VALUES)))


def long_form(df: DataFrame, keep: list[str], values: list[str]) -> DataFrame:
    """One row per value: keep columns, FEATURE, VALUE."""
    return df.select(*keep, *values).unpivot(keep, values, "FEATURE", "VALUE")


def bucket_totals(rows: DataFrame, by: list[str], weights: list[str]) -> DataFrame:
    """Weights per bucket `_b`, with `<w>_upto` (running, inclusive) and `<w>_all` totals."""
    totals = rows.groupBy(*by, "_b").agg(*[F.sum(w).alias(w) for w in weights])
    running = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(*by)
    return totals.withColumns(
        {f"{w}_upto": F.sum(w).over(running) for w in weights} | {f"{w}_all": F.sum(w).over(whole) for w in weights}
    )


def running_totals(values: DataFrame, by: list[str], weights: list[str], level: int = 0) -> DataFrame:
    """Different values `_v` of each group with `<w>_upto`, the weights at or below them, `<w>_all`, and `_size`, the values sorted with them.

    Buckets within the budget are sorted whole, others by the buckets of the next level.
    """
    b, last = f"_b{level}", level == LEVELS - 1
    at = values.withColumn(b, order_bucket(F.col("_v"), level))
    totals = at.groupBy(*by, b).agg(F.count(F.lit(1)).alias("_size"), *[F.sum(w).alias(f"{w}_in{level}") for w in weights])
    before = W.partitionBy(*by).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(f"{w}_in{level}").over(before), F.lit(0)).alias(f"{w}_below{level}") for w in weights]
    whole = {} if level else {f"{w}_all": F.sum(f"{w}_in{level}").over(W.partitionBy(*by)) for w in weights}
    offsets = totals.select(*by, b, "_size", *sums, *[c.alias(n) for n, c in whole.items()])
    placed = at.join(offsets, [*by, b])
    running = W.partitionBy(*by, b).orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    small = placed if last else placed.filter(F.col("_size") <= _budget(values))
    upto = {w: F.col(f"{w}_below{level}") + F.sum(w).over(running) for w in weights}
    done = small.select(*values.columns, *[c.alias(f"{w}_upto") for w, c in upto.items()], "_size", *whole)
    if last:
        return done
    large = placed.filter(F.col("_size") > _budget(values)).drop("_size")
    inner = running_totals(large, [*by, b], weights, level + 1)
    shifted = [(F.col(f"{w}_below{level}") + F.col(f"{w}_upto")).alias(f"{w}_upto") for w in weights]
    return done.unionByName(inner.select(*values.columns, *shifted, "_size", *whole))


def quantiles(
    df: DataFrame, by: list[str], value: str, probs: dict[str, float], weight: str | None = None
) -> DataFrame:
    """Exact quantiles with linear interpolation; one row per group, one column per probability.

    A weight counts its row that many times. Null values are left out.
    """
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    v = F.col(value).cast("double")
    rows = df.select(*by, v.alias("_v"), w.alias("_w")).filter("_v is not null and _w > 0")
    rows = rows.withColumn("_b", order_bucket(F.col("_v")))
    n = F.col("_w_all")
    ranks = []  # two per probability
    for p in probs.values():
        low = F.floor((n - 1) * F.lit(float(p)))
        ranks += [low, F.least(low + 1, n - 1)]
    slot_array = F.array(*[F.struct(F.lit(i).alias("slot"), r.alias("rank")) for i, r in enumerate(ranks)])
    below = F.col("_w_upto") - F.col("_w")
    wanted = reduce(or_, [(r >= below) & (r < F.col("_w_upto")) for r in ranks])
    # at most two rows per group and probability; written, as the rows that follow meet it twice
    picked = durable(
        bucket_totals(rows.withColumn("_rows", F.lit(1)), by, ["_w", "_rows"])
        .filter(wanted)
        .withColumn("_slots", F.filter(slot_array, lambda s: (s["rank"] >= below) & (s["rank"] < F.col("_w_upto"))))
        .select(*by, "_b", below.alias("_below"), n.alias("_n"), "_slots", "_rows")
    )
    inside = rows.join(F.broadcast(picked.select(*by, "_b")), [*by, "_b"], "left_semi").groupBy(*by, "_b", "_v").agg(F.sum("_w").alias("_w"))
    running = W.partitionBy(*by, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = durable(inside.join(F.broadcast(picked), [*by, "_b"]))  # else each level of `many` goes over all rows again
    few = found.filter(F.col("_rows") <= _budget(df)).withColumn("_w_upto", F.sum("_w").over(running))
    many = running_totals(found.filter(F.col("_rows") > _budget(df)), [*by, "_b"], ["_w"], 1).drop("_size")
    ranked = (
        few.unionByName(many)
        .withColumn("_upto", F.col("_below") + F.col("_w_upto"))
        .withColumn(
            "_slot",
            F.explode(
                F.filter("_slots", lambda s: (s["rank"] >= F.col("_upto") - F.col("_w")) & (s["rank"] < F.col("_upto")))
            ),
        )
    )
    outs = [F.max("_n").alias("_n")]
    for i in range(2 * len(probs)):
        outs.append(F.max(F.when(F.col("_slot.slot") == i, F.col("_v"))).alias(f"_s{i}"))
    wide = ranked.groupBy(*by).agg(*outs)
    cols = []
    for i, (name, p) in enumerate(probs.items()):
        position = (F.col("_n") - 1) * F.lit(float(p))
        low, high = F.col(f"_s{2 * i}"), F.col(f"_s{2 * i + 1}")
        cols.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return wide.select(*by, *cols)


def running_counts(df: DataFrame, by: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Distinct values with `n` rows, `upto` rows at or below the value, and `total` rows."""
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    rows = df.select(*by, F.col(value).alias("_v"), w.alias("_w"))
    counts = rows.groupBy(*by, "_v").agg(F.sum("_w").alias("_w"))
    return running_totals(counts, by, ["_w"]).select(
        *by, F.col("_v").alias(value), F.col("_w").alias("n"), F.col("_w_upto").alias("upto"), F.col("_w_all").alias("total")
    )


def widest_gap(df: DataFrame, by: list[str], value: str, left: str, right: str) -> DataFrame:
    """Largest gap between the two empirical distributions weighted by `left` and `right`.

    Bucket totals bound the gap inside each bucket; only buckets that could beat the largest gap
    seen at bucket edges are looked into value by value. Columns: by, `gap`, `n_left`, `n_right`.
    """
    rows = df.select(*by, F.col(value).alias("_v"), F.col(left).cast("long").alias("_l"), F.col(right).cast("long").alias("_r"))
    rows = rows.withColumn("_b", order_bucket(F.col("_v")))

    def share(side, upto):
        return F.when(F.col(f"{side}_all") > 0, upto / F.col(f"{side}_all")).otherwise(0.0)

    edges = bucket_totals(rows.withColumn("_rows", F.lit(1)), by, ["_l", "_r", "_rows"]).select(
        *by,
        "_b",
        "_rows",
        F.col("_l_all"),
        F.col("_r_all"),
        (F.col("_l_upto") - F.col("_l")).alias("_l_below"),
        (F.col("_r_upto") - F.col("_r")).alias("_r_below"),
        share("_l", F.col("_l_upto")).alias("_le"),
        share("_r", F.col("_r_upto")).alias("_re"),
        share("_l", F.col("_l_upto") - F.col("_l")).alias("_ls"),
        share("_r", F.col("_r_upto") - F.col("_r")).alias("_rs"),
    )
    # one row per bucket, whatever the number of rows
    at_edges = durable(
        edges.withColumns(
            {
                "_seen": F.max(F.abs(F.col("_le") - F.col("_re"))).over(W.partitionBy(*by)),
                "_most": F.greatest(F.col("_le") - F.col("_rs"), F.col("_re") - F.col("_ls")),
            }
        )
    )
    open_ = at_edges.filter(F.col("_most") > F.col("_seen")).select(*by, "_b", "_rows", "_l_all", "_r_all", "_l_below", "_r_below")
    wanted = open_.select(*by, "_b")
    if wanted.limit(OPEN_BUCKETS + 1).count() <= OPEN_BUCKETS:  # so that the rows of other buckets aren't shuffled
        wanted = F.broadcast(wanted)
    inside = (
        rows.join(wanted, [*by, "_b"], "left_semi")
        .groupBy(*by, "_b", "_v")
        .agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    )
    running = W.partitionBy(*by, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = durable(inside.join(open_, [*by, "_b"]))  # different values of open buckets; each level of `many` reads them
    sums = {f"{w}_upto": F.sum(w).over(running) for w in ("_l", "_r")}
    few = found.filter(F.col("_rows") <= _budget(df)).withColumns(sums)
    many = running_totals(found.filter(F.col("_rows") > _budget(df)), [*by, "_b"], ["_l", "_r"], 1).drop("_size")
    at_values = few.unionByName(many).select(
        *by,
        F.abs(share("_l", F.col("_l_below") + F.col("_l_upto")) - share("_r", F.col("_r_below") + F.col("_r_upto"))).alias("gap"),
        F.lit(None).cast("long").alias("n_left"),
        F.lit(None).cast("long").alias("n_right"),
    )
    known = at_edges.select(*by, F.col("_seen").alias("gap"), F.col("_l_all").alias("n_left"), F.col("_r_all").alias("n_right"))
    return known.unionByName(at_values).groupBy(*by).agg(
        F.max("gap").alias("gap"), F.max("n_left").alias("n_left"), F.max("n_right").alias("n_right")
    )


def bin_edges(df: DataFrame, cols: list[str], bins: int = 32) -> dict[str, list[float]]:
    """Upper edges, fewer than `bins` per column, that cut its values into about equal counts.

    An edge is the largest value of the value bucket that holds the wanted rank, so bucket totals are all that is needed.
    """
    rows = long_form(df, [], cols).select("FEATURE", F.col("VALUE").cast("double").alias("_v")).filter("_v is not null")
    totals = rows.withColumn("_b", order_bucket(F.col("_v"))).groupBy("FEATURE", "_b").agg(F.count(F.lit(1)).alias("n"), F.max("_v").alias("top"))
    running = W.partitionBy("FEATURE").orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = totals.withColumns({"upto": F.sum("n").over(running), "all": F.sum("n").over(W.partitionBy("FEATURE"))})
    crossed = F.floor(F.col("upto") * bins / F.col("all")) > F.floor((F.col("upto") - F.col("n")) * bins / F.col("all"))
    found = placed.filter(crossed & (F.col("upto") < F.col("all"))).select("FEATURE", "top").collect()  # fewer than bins per column
    return {c: sorted({r.top for r in found if r.FEATURE == c}) for c in cols}


def sample_n(df: DataFrame, n: int, key: list[str], ties: list[str] = (), seed: int = 42) -> DataFrame:
    """Seeded sample of exactly n rows (all rows if there are fewer), the same on every run.

    Rows are ordered by a digest of their key, rows of one key by the ties columns. Counts per digest prefix find the prefix that holds
    the n-th row, so only about n rows reach the final sort.
    """
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(str(seed))))
    rows = df.withColumn("_h", digest).withColumn("_p", F.substring("_h", 1, 5))
    counts = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # at most 16^5 rows
    running = W.partitionBy().orderBy("_p").rowsBetween(W.unboundedPreceding, W.currentRow)
    cut = (
        counts.withColumn("_upto", F.sum("_n").over(running))
        .filter(F.col("_upto") - F.col("_n") < n)
        .agg(F.max("_p").alias("_p"))
        .scalar()
    )
    return rows.filter(F.col("_p") <= cut).orderBy("_h", *key, *ties).limit(n).drop("_h", "_p")
