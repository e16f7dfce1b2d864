"""Exact duplicates: equal texts after white space is made uniform.

Rows are grouped by a 128-bit hash of the text and by the bytes themselves, so two texts that share a hash stay
apart. Copies collapse inside each map task before anything is shuffled; a text with a third of all rows then sends
one row per task.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskbridge.functions.durable import durable
from riskbridge.llm.common import SPACE, text_of


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def normalized(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def _classes(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """A row for each different text: hash, smallest id, number of rows, SHA-256; no text."""
    rows = docs.select(F.col("doc_id"), normalized(text_of()).alias("body")).select("doc_id", "body", digest(F.col("body")).alias("h"))
    found = rows.groupBy("h", "body").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return found.select("h", "keep_id", "group_size", F.sha2("body", 256).alias("text_sha256"))


def _with_class(rows: DataFrame, docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """rows has `h` and `body`. Hashes of one text are joined by hash alone, those of several also by the bytes."""
    classes = durable(_classes(docs, digest))
    shared = classes.groupBy("h").count().filter("count > 1").select("h")
    if shared.isEmpty():
        return rows.join(classes, "h").drop("h", "body")
    shared = durable(shared)
    single = rows.join(classes.join(shared, "h", "left_anti"), "h")
    several = rows.join(shared, "h", "left_semi").withColumn("text_sha256", F.sha2("body", 256))
    bodies = several.groupBy("h", "body").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    exact = several.join(bodies, ["h", "body"]).select(*single.columns)
    return single.unionByName(exact).drop("h", "body")


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts are empty texts. A null doc_id is larger than all others; it stays only where all ids of its group
    are null. Rows that repeat an id and its text count in group_size and share the decision. Other columns are ignored.
    """
    body = normalized(text_of())
    rows = docs.select("doc_id", body.alias("body")).select("doc_id", "body", digest(F.col("body")).alias("h"))
    out = _with_class(rows, docs, digest)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The rows of documents that stay, one for each different text, with all their columns as they were.

    Of rows that share the smallest id and the text one stays: the first by a hash of the whole row.
    """
    cols = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*cols).alias("row"), F.col("doc_id"), normalized(text_of()).alias("body"), F.xxhash64(*cols).alias("k"))
    key = F.xxhash64("doc_id", F.md5("body"))
    rows = rows.select("row", "doc_id", "body", "k", digest(F.col("body")).alias("h"))
    repeated = durable(rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("k")).filter("n > 1").select("key", "k"))
    out = _with_class(rows, docs, digest).filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    if repeated.isEmpty():
        return out.select("row.*")
    out = out.withColumn("key", F.xxhash64("doc_id", F.md5(normalized(text_of("row.text")))))
    once = out.join(repeated, "key", "left_anti").select("row")
    one = out.join(repeated, ["key", "k"], "left_semi").groupBy("key").agg(F.first("row").alias("row")).select("row")
    return once.unionByName(one).select("row.*")
