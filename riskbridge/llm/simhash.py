"""Near duplicates by SimHash fingerprints.

Fingerprints that differ in few bits are found by their bit counts in segments of four bits: the Manhattan distance of
two count vectors is a lower bound of the number of differing bits. Every fingerprint goes to the grid cell of its own
counts and to the cells one step away, so two vectors at most two steps apart meet in a cell. Pairs that meet are then
verified on all bits. A cell with many fingerprints is refined to segments of one bit, where a cell holds at most 65 and
all that meet are close. Equal fingerprints are one from the start, so copies never make pairs.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskbridge.functions.durable import durable
from riskbridge.llm.arrow import per_batch, utf8
from riskbridge.llm.common import rows_by_key

SHINGLE = 3
SEGMENTS, SEGMENT_BITS = 16, 4
CELL_PAIRS = 32  # cells of more fingerprints are refined


def words_in(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(words parted by one space, first byte of each, byte after each, text of each); white space is ASCII's."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    after_word = np.concatenate([[False], ~blank])
    starts = np.flatnonzero(~blank & ~(after_word[:-1] & ~edge[:-1]))
    ends = np.flatnonzero(after_word[1:] & (np.concatenate([blank[1:], [True]]) | edge[1:])) + 1 if len(data) else np.zeros(0, np.int64)
    text = np.searchsorted(offsets, starts, side="right") - 1
    size = ends - starts
    at = np.cumsum(size + 1) - size - 1
    out = np.full(int((size + 1).sum()), 32, np.uint8)
    inside = np.flatnonzero(~blank)
    out[np.repeat(at - starts, size) + inside] = data[inside]
    return out.tobytes(), at, at + size, text


def fingerprints(column: pa.Array, shingle: int = SHINGLE, piece: int = 1 << 17) -> np.ndarray:
    """A 64-bit fingerprint of each text; zero without words."""
    data, offsets = utf8(column)
    capital = (data >= 65) & (data <= 90)
    data = np.where(capital, data + np.uint8(32), data).astype(np.uint8)
    words, starts, ends, text = words_in(data, offsets)
    n = len(column)
    count = np.bincount(text, minlength=n)
    first_word = np.cumsum(count) - count
    last = np.minimum(np.arange(len(starts)) + shingle, (first_word + count)[text]) - 1
    # all shingles of full length, and the whole of a text with fewer words
    keep = np.flatnonzero((np.arange(len(starts)) + shingle <= (first_word + count)[text]) | (np.arange(len(starts)) == first_word[text]))
    of, lo, hi = text[keep], starts[keep], ends[last[keep]]
    ones, total = np.zeros((n, 64), np.int64), np.bincount(of, minlength=n)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(keep), piece):
        a, b, t = lo[at : at + piece].tolist(), hi[at : at + piece].tolist(), of[at : at + piece]
        h = np.fromiter((digest(words[i:j], 42) for i, j in zip(a, b, strict=True)), np.uint64, len(a))
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.diff(t, prepend=-1))
        ones[t[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The columns of docs but `text`, with `fp` (bigint, the fingerprint's bits)."""
    return per_batch(docs, "text", lambda c: {"fp": pa.array(fingerprints(c, shingle).view(np.int64))}, "fp bigint")


def _counts(fp: Column) -> list[Column]:
    mask = (1 << SEGMENT_BITS) - 1
    return [F.bit_count(F.shiftrightunsigned(fp, SEGMENT_BITS * i).bitwiseAND(F.lit(mask))).cast("long") for i in range(SEGMENTS)]


def _cells(fps: DataFrame) -> DataFrame:
    """(cell, fp): the cell of its counts, and those one step away in one segment."""
    wide = 3  # bits of a count from 0 to 4
    counts = fps.select("fp", F.array(*_counts(F.col("fp"))).alias("c"))
    home = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, wide).bitwiseOR(x))
    counts = counts.select("fp", "c", home.alias("home"))
    step = [F.lit(1 << wide * (SEGMENTS - 1 - i)).cast("long") for i in range(SEGMENTS)]
    near = [F.when(F.get("c", i) > 0, F.col("home") - step[i]) for i in range(SEGMENTS)] + [F.when(F.get("c", i) < SEGMENT_BITS, F.col("home") + step[i]) for i in range(SEGMENTS)]
    return counts.select(F.explode_outer(F.array(F.col("home"), *near)).alias("cell"), "fp").filter("cell is not null")


def close_pairs(fps: DataFrame, most: int = 2, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """Pairs (a, b), a < b, that join all different fingerprints at most `most` (2 or fewer) bits apart into the same components."""
    if most > 2:
        raise ValueError("cells one step away meet at distances of 2 or fewer")
    cells = _cells(fps)
    busy = durable(cells.groupBy("cell").count().filter("count > 1"))
    met = durable(cells.join(busy, "cell"))
    gathered = met.filter(F.col("count") <= cell_pairs).groupBy("cell").agg(F.sort_array(F.collect_list("fp")).alias("m"))
    pairs = gathered.select(F.explode_outer("m").alias("a"), "m").select("a", F.explode_outer("m").alias("b"))
    distance = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
    pairs = pairs.filter((F.col("a") < F.col("b")) & (distance("a", "b") <= most)).distinct()
    crowd = met.filter(F.col("count") > cell_pairs).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    spots = crowd.select("fp", F.explode_outer(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("spot"))
    stars = spots.groupBy("spot").agg(F.collect_list("fp").alias("m")).filter(F.size("m") > 1)  # 65 at most
    fine = stars.select(F.explode_outer("m").alias("a"), "m").select("a", F.explode_outer("m").alias("b"))
    fine = fine.filter((F.col("a") < F.col("b")) & (distance("a", "b") <= most)).distinct()
    return pairs.unionByName(fine).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that can be reached, for every node of an edge (a, b).

    Large and small stars in turns: each round links a node's larger, then its smaller neighbours to its smallest.
    Rounds grow with the logarithm of the nodes; each is written, so no lineage builds up.
    """
    edges = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = durable(small.filter("u <> v").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select("v", "v").distinct().toDF("node", "root"))
        seen = state


def _roots(prints: DataFrame, most: int) -> DataFrame:
    """(fp, root, component_id) from (doc_id, fp): what links can reach, by its smallest fingerprint and its smallest id."""
    fps = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(close_pairs(fps.select("fp"), most))
    rooted = fps.join(roots, fps.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, most: int = 2, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id.

    Null and empty texts have no words and fingerprint zero, which links like any other. A null doc_id is never the
    smallest, unless all of a component are null. Repeated rows are copies of each other. Other columns are ignored.
    """
    prints = durable(with_fingerprint(docs.select("doc_id", "text"), shingle))
    out = prints.join(_roots(prints, most), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, most: int = 2, shingle: int = SHINGLE) -> DataFrame:
    """One row of each component, one of its smallest document's, with all its columns as they were.

    Null and empty texts are one component. Rows are told apart by their whole content, not by doc_id alone: of rows that share the
    smallest id the first by a hash of the row stays, and of equal rows one. A null doc_id stays only where all of a component are null.
    """
    key = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    prints = durable(with_fingerprint(docs.select("doc_id", "text", key.alias("key")), shingle))
    rooted = prints.join(_roots(prints, most), "fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = durable(rooted.groupBy("root").agg(F.min("key").alias("key")).select("key"))
    return rows_by_key(docs, key, stay, prints)
