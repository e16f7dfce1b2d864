"""Near duplicates by HyperMinHash registers over word shingles.

A text's set of shingle hashes falls into 128 buckets by its first seven bits. A bucket's register holds the leading zeros of
its smallest hash and the ten bits behind the first one, 16 bits in all; an empty bucket borrows the register of the full
bucket that a fixed order of buckets names first, so that equal registers stay as likely as the sets are alike. Four registers
are a band; texts that agree in one of the 32 bands meet in its cell (a pair of similarity 0.8 misses all of them
with probability 5 in 10^8). Pairs that meet are estimated from the registers, corrected for registers that collide by
chance, and those within six standard errors of the limit are verified on their full sets. Equal sets are one from the start.

A cell of a few texts makes all its pairs. In a crowded cell every text is held against the cell's most central one
only, and texts that this leaves in different components are looked up again exactly: similar sets must share one of their
rarest shingles (a prefix of each set in the order of frequency), early enough for the rest to reach the limit.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskbridge.functions.durable import durable
from riskbridge.llm.arrow import per_batch, utf8
from riskbridge.llm.common import packed
from riskbridge.llm.simhash import components, words_in

SHINGLE, SIMILAR = 2, 0.8
REGISTERS, MANTISSA, BAND_ROWS = 128, 10, 4
BANDS = REGISTERS // BAND_ROWS
FEW = 8  # texts of a cell that are all paired
BLOCK = 512  # partners of one text that one task verifies
ERRORS = 6.0  # standard errors that an estimate may lie below the limit

_ODD = np.frombuffer(b"".join(xxhash.xxh64_digest(f"factor {i}") for i in range(BANDS)), np.uint64) | np.uint64(1)
# for each bucket, the order in which it asks the others
_ORDER = np.argsort(np.frombuffer(b"".join(xxhash.xxh64_digest(f"order {i}") for i in range(REGISTERS**2)), np.uint64).reshape(REGISTERS, -1), axis=1).argsort(axis=1).astype(np.int16)


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The different shingle hashes of each text, sorted; a text of fewer words is one shingle, one without words none."""
    data, offsets = utf8(column)
    capital = (data >= 65) & (data <= 90)
    words, starts, ends, text = words_in(np.where(capital, data + np.uint8(32), data).astype(np.uint8), offsets)
    count = np.bincount(text, minlength=len(column))
    first, digest, out = np.cumsum(count) - count, xxhash.xxh64_intdigest, []
    for i, n in zip(first.tolist(), count.tolist(), strict=True):
        full = max(n - shingle + 1, min(n, 1))
        lo, hi = starts[i : i + full].tolist(), ends[i + min(shingle, n) - 1 : i + n].tolist() if n else []
        out.append(np.unique(np.fromiter((digest(words[a:b], 42) for a, b in zip(lo, hi, strict=True)), np.uint64, full)))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of registers for each set of sorted hashes; a set without hashes has zeros."""
    size = np.array([len(s) for s in sets], np.int64)
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    if not size.sum():
        return out
    h = np.concatenate(sets)
    at = np.repeat(np.arange(len(sets)) * REGISTERS, size) + (h >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))  # sorted: the first hash of a bucket is its smallest
    rest = h[first] << np.uint64(7)
    zeros = np.where(rest > 0, 64 - np.frexp(np.maximum(rest >> np.uint64(11), 1).astype(np.float64))[1] - 11, 57)
    behind = (rest << np.minimum(zeros + 1, 63).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    full = np.zeros(out.size, bool)
    full[at[first]] = True
    out.reshape(-1)[at[first]] = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | behind.astype(np.uint16)
    full = full.reshape(out.shape)
    for i in np.flatnonzero((size > 0) & ~full.all(axis=1)):
        there, gaps = np.flatnonzero(full[i]), np.flatnonzero(~full[i])
        out[i, gaps] = out[i, there[np.argmin(_ORDER[np.ix_(gaps, there)], axis=1)]]
    return out


def band_cells(regs: np.ndarray) -> np.ndarray:
    """One number for each band of each row: its four registers, mixed with the band."""
    cells = (np.ascontiguousarray(regs).view(np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)) * _ODD
    cells ^= cells >> np.uint64(29)
    return (cells * _ODD[0]).view(np.int64)


def _mark(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def with_registers(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The columns of docs but `text`, with `mark` (128 bits that stand for the set), `n` (its size) and `regs`."""

    def made(column: pa.Array) -> dict[str, pa.Array]:
        sets = shingle_sets(column, shingle)
        regs = registers(sets)
        return {"mark": pa.array(map(_mark, sets), pa.binary()), "n": pa.array([len(s) for s in sets], pa.int64()), "regs": pa.array([r.tobytes() for r in regs], pa.binary())}

    return per_batch(docs, "text", made, "mark binary, n bigint, regs binary")


def _with_hashes(docs: DataFrame, shingle: int) -> DataFrame:
    def made(column: pa.Array) -> dict[str, pa.Array]:
        sets = shingle_sets(column, shingle)
        return {"mark": pa.array(map(_mark, sets), pa.binary()), "hashes": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))}

    return per_batch(docs, "text", made, "mark binary, hashes array<bigint>")


def _with_cells(sets: DataFrame) -> DataFrame:
    """(mark, n, cell), a row for each band of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = band_cells(np.frombuffer(b"".join(batch["regs"].to_pylist()), np.uint16).reshape(-1, REGISTERS))
            each = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
            yield pa.RecordBatch.from_arrays([batch["mark"].take(each), batch["n"].take(each), pa.array(cells.reshape(-1))], names=["mark", "n", "cell"])

    return sets.select("mark", "n", "regs").mapInArrow(run, "mark binary, n bigint, cell bigint")


def equal_registers(a: pd.Series, b: pd.Series) -> pd.Series:
    left, right = (np.frombuffer(b"".join(x), np.uint16).reshape(-1, REGISTERS) for x in (a, b))
    return pd.Series((left == right).sum(axis=1, dtype=np.int32))


def estimated(equal: Column, na: Column, nb: Column) -> Column:
    """Jaccard similarity from equal registers, without the share that is equal by chance.

    Smallest hashes x of two separate sets fall into one register with probability E[x] of order 2^-mantissa; averaged over where
    x lies between two powers of two that is 1 / (2 ln 2) * 2^-mantissa * na nb / (na + nb)^2.
    """
    chance = na * nb / ((na + nb) * (na + nb)) * (0.7213475204444817 / (1 << MANTISSA))
    return F.greatest((equal / REGISTERS - chance) / (1 - chance), F.lit(0.0))


def likely(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Those of the pairs (a, b) whose sizes and registers allow the similarity."""
    side = lambda k: sets.select(F.col("mark").alias(k), F.col("n").alias(f"n{k}"), F.col("regs").alias(f"r{k}"))
    least = similar - ERRORS * (similar * (1 - similar) / REGISTERS) ** 0.5
    both = _salted(pairs, side("a")).join(side("b"), "b")
    equal = F.pandas_udf(equal_registers, "int")
    return both.filter(estimated(equal("ra", "rb"), F.col("na"), F.col("nb")) >= least).select("a", "b")


def _salted(pairs: DataFrame, left: DataFrame) -> DataFrame:
    """pairs joined to their `a`; the pairs of one `a` are dealt over several keys if they are many."""
    blocks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    many = blocks.filter("blocks > 1")
    dealt = pairs.join(many, "a", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"), F.lit(0))).drop("blocks")
    spread = left.join(blocks, "a").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return dealt.join(spread, ["a", "block"]).drop("block")


def verified(pairs: DataFrame, hashes: DataFrame, similar: float) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    side = lambda k: hashes.select(F.col("mark").alias(k), F.col("hashes").alias(f"h{k}"))
    both = F.size(F.array_intersect("ha", "hb"))
    of = F.size("ha") + F.size("hb") - both
    # in whole hundredths, so that a limit such as 0.8 is met exactly
    return _salted(pairs, side("a")).join(side("b"), "b").filter(both * 100 >= of * round(100 * similar)).select("a", "b")


def _by_size(similar: float) -> Column:
    return F.least("na", "nb") * 100 >= F.greatest("na", "nb") * round(100 * similar)


def _rooted(marks: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return marks.withColumn("root", F.col("mark"))
    return marks.join(roots.withColumnRenamed("node", "mark"), "mark", "left").withColumn("root", F.coalesce("root", "mark"))


def _prefix_pairs(crowd: DataFrame, hashes: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b) of the crowd (mark, root), of different roots, that share a shingle early enough to be similar.

    Each set's shingles are ordered by their number of sets in the crowd. The smaller set of a similar pair has a shared one among its
    first n - ceil(2 s / (1 + s) n) + 1, the larger one among its first n - ceil(s n) + 1.
    """
    h = round(100 * similar)
    short = F.col("n") - F.ceil(F.col("n") * 2 * h / (100 + h)) + 1
    far = F.col("n") - F.ceil(F.col("n") * h / 100) + 1
    each = hashes.join(crowd.select("mark"), "mark", "left_semi").select("mark", F.size("hashes").alias("n"), F.explode("hashes").alias("s"))
    seen = each.groupBy("s").count()
    ordered = each.join(seen, "s").groupBy("mark", "n").agg(F.sort_array(F.collect_list(F.struct("count", "s"))).alias("o"))
    heads = ordered.select("mark", "n", F.posexplode(F.slice("o", F.lit(1), far.cast("int"))).alias("p", "e"))
    heads = heads.select("mark", "n", "p", F.col("e.s").alias("s"), (F.col("p") < short).alias("early")).join(crowd, "mark")
    # texts of the root that holds most of a shingle's texts need no pairs among themselves
    roots = heads.groupBy("s", "root").count().groupBy("s").agg(F.max(F.struct("count", "root")).getField("root").alias("main"), F.count(F.lit(1)).alias("roots"))
    heads = durable(heads.join(roots.filter("roots > 1").select("s", "main"), "s"))
    need = F.ceil((F.col("na") + F.col("nb")) * h / (100 + h))
    reach = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= need
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    early = F.when(smaller, F.col("ea")).otherwise(F.col("eb"))
    side = lambda k: [F.col("mark").alias(k), F.col("n").alias(f"n{k}"), F.col("p").alias(f"p{k}"), F.col("root").alias(f"t{k}"), F.col("early").alias(f"e{k}")]
    apart = heads.filter("root <> main").select("s", *side("a"))
    every = heads.select("s", *side("b"), (F.col("root") == F.col("main")).alias("mb"))
    met = apart.join(every, "s").filter((F.col("ta") != F.col("tb")) & (F.col("mb") | (F.col("a") < F.col("b"))) & early & _by_size(similar) & reach)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def linked(sets: DataFrame, hashes_of, similar: float = SIMILAR) -> DataFrame | None:
    """(node, root) for all marks that similar pairs join; None without any.

    sets has mark, n, regs; hashes_of gives (mark, hashes) for a table of marks.
    """
    cells = durable(_with_cells(sets.filter("n > 0")))
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    met = durable(cells.join(sizes, "cell"))
    hashes = durable(hashes_of(met.select("mark").distinct()))
    gathered = met.filter(F.col("c") <= FEW).groupBy("cell").agg(F.collect_list(F.struct("mark", "n")).alias("m"))
    few = gathered.select(F.explode("m").alias("x"), "m").select("x", F.explode("m").alias("y"))
    few = few.select(F.col("x.mark").alias("a"), F.col("x.n").alias("na"), F.col("y.mark").alias("b"), F.col("y.n").alias("nb"))
    few = few.filter((F.col("a") < F.col("b")) & _by_size(similar)).select("a", "b")
    crowded = met.filter(F.col("c") > FEW)
    central = crowded.groupBy("mark").agg(F.sum("c").alias("near"))  # the text that meets most others leads its cells
    crowded = durable(crowded.join(central, "mark"))
    lead = crowded.groupBy("cell").agg(F.max(F.struct("near", "mark", "n")).alias("l"))
    star = crowded.join(lead, "cell").select(F.col("l.mark").alias("a"), F.col("l.n").alias("na"), F.col("mark").alias("b"), F.col("n").alias("nb"))
    star = star.filter((F.col("a") != F.col("b")) & _by_size(similar)).select("a", "b")
    pairs = durable(few.unionByName(star).distinct())
    edges = durable(verified(durable(likely(pairs, sets, similar)), hashes, similar))
    roots = None if edges.isEmpty() else durable(components(edges))
    mixed = _rooted(crowded.select("cell", "mark"), roots)
    open_ = mixed.groupBy("cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("cell")
    crowd = durable(mixed.join(open_, "cell", "left_semi").select("mark", "root").distinct())
    if crowd.isEmpty():
        return roots
    late = durable(verified(durable(likely(_prefix_pairs(crowd, hashes, similar), sets, similar)), hashes, similar))
    if late.isEmpty():
        return roots
    known = late if roots is None else late.unionByName(roots.filter("node <> root").toDF("a", "b"))
    return durable(components(known))


def _classes(docs: DataFrame, similar: float, shingle: int) -> tuple[DataFrame, DataFrame]:
    """((doc_id, mark, n) for each row, (mark, root, component_id) for sets that hold a shingle)."""
    rows = durable(with_registers(docs.select("doc_id", "text", F.xxhash64("text").alias("key")), shingle))
    sets = durable(rows.filter("n > 0").groupBy("mark").agg(F.min("doc_id").alias("first"), F.min("key").alias("key"), F.first("n").alias("n"), F.first("regs").alias("regs")))

    def hashes_of(marks: DataFrame) -> DataFrame:
        keys = sets.join(marks, "mark", "left_semi").select("key")
        texts = docs.select("text", F.xxhash64("text").alias("key")).join(keys, "key", "left_semi")
        return _with_hashes(texts.groupBy("key").agg(F.first("text").alias("text")).select("text"), shingle).dropDuplicates(["mark"])

    rooted = _rooted(sets.select("mark", "first"), linked(sets, hashes_of, similar))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.select("doc_id", "mark", "n"), rooted.join(ids, "root").select("mark", "root", "component_id")


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Null and empty texts, and texts without words, have no shingles and are linked with nothing: each is its own component.
    A null doc_id is never the smallest, unless all of a component are null. Rows that repeat an id and its text share the
    result, each with its own row. Other columns are ignored.
    """
    rows, classes = _classes(docs, similar, shingle)
    some = rows.filter("n > 0").join(classes, "mark").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    none = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dedup(docs: DataFrame, similar: float = SIMILAR, shingle: int = SHINGLE) -> DataFrame:
    """One row of each component, that of its smallest doc_id, with all its columns; texts without shingles all stay.

    Of rows that share the id and the set of shingles one stays, which is the first by a hash of the whole row.
    """
    _, classes = _classes(docs, similar, shingle)
    rows = packed(docs).select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.text").cast("string").alias("text"), F.xxhash64("row").alias("h"))
    rows = with_registers(rows, shingle).drop("regs")
    smallest = rows.join(classes, "mark").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    one = smallest.groupBy("root").agg(F.min_by("row", F.struct("h", "mark")).alias("row"))
    return one.select("row.*").unionByName(rows.filter("n = 0").select("row.*"))
