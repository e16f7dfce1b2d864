"""Spelling variants: words that one edit turns into a far more frequent word.

The words are indexed by grams of variable length. Grams of two to six code points (words get a mark at either end) that hold
more than a fixed share of all places form the dictionary of frequent grams; at each place a word's gram is the shortest one
that isn't frequent, so its list stays short, or the longest one allowed. One edit can only affect grams that reach over its
place: for every place the grams left of it and right of it are bound to stay as they are. So for every place the lists of
the rarest such gram on either side are merged, which is a key of two grams with their places, counted from the end they
stand at. Two near words share the key of the place of their edit; words that share a key are verified by edit distance.

The dictionary is pruned by share, not by number, so it has at most (LONGEST - 1) / SHARE grams however many words there are.
"""

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskbridge.functions.durable import durable
from riskbridge.llm.common import LOWER, UPPER, text_of

# The letters of a word.
LETTERS = "[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, RATIO, DAMAGE = 7, 2, 10, 31
SHORTEST, LONGEST = 2, 6
SHARE = 1e-5
START, END = "^", "$"
LONG = 40  # code points of a word that is held by its digest in the index


def words_of(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damage: int = DAMAGE) -> DataFrame:
    """(word, n): the lower-cased runs of letters after the fixed damage, with their number of occurrences."""
    runs = F.regexp_extract_all(F.translate(text_of(), UPPER, LOWER), F.lit(f"({LETTERS}{{{least_length},}})"), 1)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"), F.explode(runs).alias("run"))
    h, size = F.crc32(F.concat("id", F.lit(":"), "run")), F.length("run")
    at = F.pmod(h, size).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, size))
    words = rows.select(F.when(h % damage == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter((F.length("word") >= least_length) & (F.col("n") >= least_count))


def frequent_grams(words: DataFrame, share: float = SHARE, shortest: int = SHORTEST, longest: int = LONGEST) -> dict[str, int]:
    """The grams that hold more than this share of all places in the marked words, at most (longest - shortest + 1) / share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter()
            for word in batch["word"].to_pylist():
                x = START + word + END
                for q in range(shortest, longest + 1):
                    seen.update([x[p : p + q] for p in range(len(x) - q + 1)])
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["g", "n"])

    places = words.agg(F.sum(F.length("word") + 2)).first()[0] or 0
    counted = words.select("word").mapInArrow(run, "g string, n bigint").groupBy("g").agg(F.sum("n").alias("n"))
    return {r.g: r.n for r in counted.filter(F.col("n") > F.lit(share * places)).collect()}


def index_keys(word: str, frequent: dict[str, int], longest: int = LONGEST) -> tuple[set[int], set[int]]:
    """(keys of the word's own places, keys of its gaps), each a number for length, gram left of it and gram right of it.

    A replaced or lost code point stands at one of the word's places, one that it lacks in one of its gaps; the keys of gaps have
    the length of the word that has one more. Two words that one edit makes equal share a key of the same place.
    """
    x = START + word + END
    size = len(x)
    get = frequent.get
    grams = []  # (start, counts of the gram by its number of code points); the last count is that of the gram itself
    for p in range(size - 1):
        counts = [get(x[p : p + 2], 0)]
        while counts[-1] and len(counts) < longest - 1 and p + len(counts) + 1 < size:
            counts.append(get(x[p : p + len(counts) + 2], 0))
        grams.append(counts)
    none = (1 << 62, 0, 0)
    right = [none] * (size + 1)  # the rarest gram that starts here or later, as (count, code points from its start to the end, its end)
    for p in range(size - 2, -1, -1):
        right[p] = min(right[p + 1], (grams[p][-1], size - p, p + len(grams[p]) + 1))
    left, whole = [none] * (size + 1), none  # the rarest gram that ends here or earlier, as (count, start, end)
    for end in range(2, size + 1):
        best = whole
        for p in range(max(0, end - longest), end - 1):
            counts = grams[p]
            if p + len(counts) + 1 == end:
                whole = min(whole, (counts[-1], p, end))
                best = min(best, whole)
            elif p + len(counts) + 1 > end:
                best = min(best, (counts[end - p - 2], p, end))  # cut off where the sure part ends
        left[end] = best
    own, gaps, digest = set(), set(), xxhash.xxh64_intdigest
    for keys, behind, length in ((own, 1, size), (gaps, 0, size + 1)):
        pairs = {(left[i][1:], right[i + behind][1:]) for i in range(1, size - behind)}
        for (a, b), (c, d) in pairs:
            keys.add(digest(f"{length} {a} {c} {x[a:b]} {x[size - c:d] if c else ''}") - (1 << 63))
    return own, gaps


def reference(word: Column) -> Column:
    """What stands for a word in the index: the word, or for a long one its digest, so that rows stay small."""
    return F.when(F.length(word) <= LONG, word).otherwise(F.concat(F.lit("#"), F.md5(word)))


def _with_keys(words: DataFrame, frequent: dict[str, int], longest: int) -> DataFrame:
    """(key, own, ref, n), a row for each key of each word."""
    shared = words.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                rows, keys, own = [], [], []
                for i, word in enumerate(part["word"].to_pylist()):
                    mine, gaps = index_keys(word, grams, longest)
                    rows += [i] * (len(mine) + len(gaps))
                    keys += [*mine, *gaps]
                    own += [True] * len(mine) + [False] * len(gaps)
                each = pa.array(rows, pa.int32())
                columns = [pa.array(keys, pa.int64()), pa.array(own, pa.bool_()), part["ref"].take(each), part["n"].take(each)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "own", "ref", "n"])

    return words.select("word", reference(F.col("word")).alias("ref"), "n").mapInArrow(run, "key bigint, own boolean, ref string, n bigint")


def near_words(words: DataFrame, share: float = SHARE, longest: int = LONGEST) -> DataFrame:
    """(a, na, b, nb) for all pairs of different words (word, n) that one edit makes equal, each pair once."""
    keys = durable(_with_keys(words, frequent_grams(words, share, longest=longest), longest))
    met = keys.groupBy("key").agg(F.count_if("own").alias("owns"), F.count(F.lit(1)).alias("all")).filter("owns > 0 and all > 1").select("key")
    busy = durable(keys.join(met, "key", "left_semi"))
    one = busy.filter("own").select("key", F.col("ref").alias("a"), F.col("n").alias("na"))
    other = busy.select("key", "own", F.col("ref").alias("b"), F.col("n").alias("nb"))
    # a key holds the length: its own places pair with those of words as long, and with the gaps of words shorter by one
    pairs = one.join(other, "key").filter(~F.col("own") | (F.col("a") < F.col("b"))).select("a", "na", "b", "nb")
    digested = F.col("a").startswith("#") | F.col("b").startswith("#")
    plain = pairs.filter(~digested & (F.levenshtein("a", "b", 1) == 1)).distinct()
    texts = words.filter(F.length("word") > LONG).select(reference(F.col("word")).alias("ref"), "word")
    long = pairs.filter(digested).distinct()
    for side in "ab":
        of = texts.toDF(side, f"w{side}")
        long = long.join(of, side, "left").withColumn(side, F.coalesce(f"w{side}", side)).drop(f"w{side}")
    return plain.unionByName(long.filter(F.levenshtein("a", "b", 1) == 1).select("a", "na", "b", "nb"))


def roots_of(links: DataFrame) -> DataFrame:
    """(word, root) for (word, form): where the chain of forms ends. Chains are doubled, so rounds grow with the logarithm of their length."""
    hops = durable(links.select("word", F.col("form").alias("root")))
    while True:
        further = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = durable(hops.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if longer.filter("moved").isEmpty():
            return longer.select("word", "root")
        hops = longer.select("word", "root")


def spelling_variants(docs: DataFrame, ratio: int = RATIO, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, share: float = SHARE) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Null and empty texts have no words; a null doc_id counts as the text "null" where ids choose the damage. Repeated rows count again. Of
    equally frequent near words the smallest in code-point order is the form. No words, no rows. Other columns are ignored.
    """
    words = durable(words_of(docs, least_length, least_count))
    pairs = durable(near_words(words, share))
    flipped = pairs.select(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb"))
    best = F.min(F.struct((-F.col("nb")).alias("less"), F.col("b").alias("word")))
    near = pairs.unionByName(flipped).groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    near = near.select("word", "n_near", F.col("best.word").alias("best"), (-F.col("best.less")).alias("best_n"))
    out = words.join(near, "word", "left")
    far = F.col("best_n") >= ratio * F.col("n")
    out = durable(out.select("word", F.when(far, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(far, F.col("best_n")).alias("form_n")))
    roots = roots_of(out.filter("form is not null").select("word", "form"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
