"""Benchmark decontamination by winnowing.

A text's k-word grams are hashed; of each sliding window of `window - k + 1` grams the smallest hash is kept. A shared
passage of `window` words has the same grams on both sides, so it keeps the same gram on both sides: no shared window
can be missed. Kept grams of documents are matched with those of the benchmark; around each match the document's
windows are compared with the benchmark's windows word for word.

Arrays are exploded by the outer forms: the plain ones infer a filter on the array, which Spark pushes below the
projections and so computes every nested array anew for each element.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskbridge.functions.durable import durable
from riskbridge.llm.common import LOWER, UPPER, broadcast_if_small, packed, row_key, text_of

# What separates words, as a Java pattern.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, GRAM = 10, 5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), SEPARATORS, -1), "")


def _gram_hashes(rows: DataFrame, k: int) -> DataFrame:
    """Adds `g`: the hash of every k-word gram of `w`; empty if there are fewer words."""
    hashed = rows.withColumn("wh", F.transform("w", lambda x: F.xxhash64(x)))
    gram = lambda i: F.xxhash64(*[F.get("wh", i + j) for j in range(k)])
    return hashed.withColumn("g", F.when(F.size("wh") >= k, F.transform(F.sequence(F.lit(0), F.size("wh") - k), gram)).otherwise(F.array().cast("array<bigint>"))).drop("wh")


def _fingerprints(rows: DataFrame, window: int, k: int) -> DataFrame:
    """Adds `f`: array of (pos, h), each gram that is the smallest of some sliding window of grams."""
    span = window - k + 1
    rows = _gram_hashes(rows, k)
    least = F.when(F.size("g") <= span, F.array(F.array_min("g"))).otherwise(
        F.transform(F.sequence(F.lit(1), F.size("g") - (span - 1)), lambda i: F.array_min(F.slice("g", i, span)))
    )
    rows = rows.withColumn("m", least)
    pairs = F.transform("g", lambda h, i: F.struct(i.alias("pos"), h.alias("h")))
    # gram i lies in the windows i - span + 1 to i; none of their minima is larger than it
    of = lambda p: F.slice("m", F.greatest(p - (span - 2), F.lit(1)), F.least(p + 1, F.size("m")) - F.greatest(p - (span - 2), F.lit(1)) + 1)
    kept = F.filter(pairs, lambda s: F.array_max(of(s["pos"])) == s["h"])
    return rows.withColumn("f", F.when(F.size("g") > 0, kept).otherwise(F.array().cast("array<struct<pos:int,h:bigint>>"))).drop("g", "m")


def _bench_windows(bench: DataFrame, window: int) -> DataFrame:
    """item_id, n (words), body (words joined): every window of every item; an item of fewer words is one window."""
    items = bench.select("item_id", words_of(text_of()).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    return items.select("item_id", "w", F.explode_outer(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), window).alias("w")).select(
        "item_id", F.size("w").alias("n"), F.array_join("w", " ").alias("body")
    ).distinct()


def _seeds(docs: DataFrame, windows: DataFrame, window: int, k: int) -> DataFrame:
    """key, start, n: places of documents where a window of n words may start."""
    words = docs.select("key", words_of(F.col("text")).alias("w"))
    full = windows.filter(F.col("n") == window).select("body").distinct().withColumn("w", F.split("body", " "))
    grams = durable(_fingerprints(full, window, k).select(F.explode_outer("f").alias("f")).select("f.h").distinct())
    found = _fingerprints(words, window, k).select("key", F.explode_outer("f").alias("f")).select("key", "f.pos", "f.h")
    found = found.join(broadcast_if_small(grams, grams.count()), "h", "left_semi")
    out = found.groupBy("key").agg(F.collect_set("pos").alias("at")).select("key", F.explode_outer("at").alias("pos")).select(
        "key", F.explode_outer(F.sequence(F.col("pos") - (window - k), F.col("pos"))).alias("start"), F.lit(window).alias("n")
    ).filter("start >= 0").distinct()
    for n in [r.n for r in windows.filter(F.col("n") < window).select("n").distinct().collect()]:  # at most window - 1 lengths
        short = durable(_gram_hashes(windows.filter(F.col("n") == n).select("body").distinct().withColumn("w", F.split("body", " ")), n).select(F.explode_outer("g").alias("h")).distinct())
        all_grams = _gram_hashes(words, n).select("key", F.posexplode_outer("g").alias("start", "h"))
        out = out.unionByName(all_grams.join(broadcast_if_small(short, short.count()), "h", "left_semi").select("key", "start", F.lit(n).alias("n")).distinct())
    return out


def _hits(docs: DataFrame, bench: DataFrame, window: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(spans: key, start, end, body) of window occurrences in documents, and the windows by item. docs: key, text."""
    windows = durable(_bench_windows(bench, window))
    seeds = durable(_seeds(docs, windows, window, k).groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("seeds")))
    keys = seeds.select("key")
    near = docs.join(broadcast_if_small(keys, keys.count()), "key", "left_semi").dropDuplicates(["key"]).join(seeds, "key")
    near = near.select("key", "seeds", words_of(F.col("text")).alias("w"))
    spans = near.select("key", "w", F.explode_outer("seeds").alias("s")).filter(F.col("s.start") + F.col("s.n") <= F.size("w")).select(
        "key", F.col("s.start").alias("start"), (F.col("s.start") + F.col("s.n")).alias("end"), F.array_join(F.slice("w", F.col("s.start") + 1, F.col("s.n")), " ").alias("body")
    )
    return durable(spans.join(windows.select("body").distinct(), "body", "left_semi")), windows


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, k: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null text has no words; items without words have no windows; null item ids are not counted or listed, but their
    windows hit. Repeated documents get equal rows. Empty tables give no hits. Other columns are ignored.
    """
    keyed = docs.select("doc_id", row_key(F.col("doc_id"), text_of()).alias("key"), text_of().alias("text"))
    spans, windows = _hits(keyed.drop("doc_id"), bench, window, k)
    places = spans.select("key", F.explode_outer(F.sequence(F.col("start"), F.col("end") - 1)).alias("at")).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_hit"))
    items = spans.select("key", "body").distinct().join(windows.select("body", "item_id"), "body").filter("item_id is not null").select("key", F.col("item_id").cast("string").alias("item")).distinct()
    items = items.groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    rows = keyed.select("doc_id", "key", F.size(words_of(F.col("text"))).cast("long").alias("n_words")).join(places, "key", "left").join(items, "key", "left")
    items_of = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return rows.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW, k: int = GRAM) -> DataFrame:
    """The documents without any benchmark window, with all their columns as they were."""
    rows = packed(docs).select("row", row_key(F.col("row.doc_id"), text_of("row.text")).alias("key"))
    keyed = docs.select(row_key(F.col("doc_id"), text_of()).alias("key"), text_of().alias("text"))
    spans, _ = _hits(keyed, bench, window, k)
    bad = spans.select("key").distinct()
    return rows.join(bad, "key", "left_anti").select("row.*")
