"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to three bytes long. A context gives a symbol seen after it its share of
the counts, and escapes to the next shorter context for the others (method C, with exclusion), down to equal shares for
all symbols. Statistics are frozen after training, so a symbol's code length depends on the three bytes before it alone
and is worked out once per context and symbol. A text belongs to the language that codes it in the fewest bits.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskbridge.llm.arrow import kept, per_batch, utf8
from riskbridge.llm.common import packed

UND = "und"
DEPTH = 3


def _symbols() -> np.ndarray:
    """Bytes to symbols: 0 for all ASCII but letters, 1 to 26 for letters of either case, then the other 128 bytes."""
    out = np.zeros(256, np.uint8)
    for base in (65, 97):
        out[base : base + 26] = np.arange(1, 27)
    out[128:] = np.arange(27, 155)
    return out


SYMBOLS = _symbols()
ALPHABET = 155
_C3 = int(SYMBOLS[0xC3])


def coded(data: np.ndarray) -> np.ndarray:
    """Symbols of UTF-8 bytes, the accented Latin-1 capitals as small letters."""
    s = SYMBOLS[data]
    upper = (s[:-1] == _C3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    s[1:][upper] += 0x20
    return s


def contexts(s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each symbol the three before it as one number; before a text's start stand zeros."""
    gone = np.zeros((DEPTH, len(s)), bool)
    for back in range(DEPTH):  # the symbol back + 1 places before lies in an earlier text
        for j in range(back + 1):
            at = starts + j
            gone[back, at[at < len(s)]] = True
    c = np.zeros(len(s), np.int32)
    for back in reversed(range(DEPTH)):
        p = np.zeros(len(s), np.int32)
        p[back + 1 :] = s[: len(s) - back - 1]
        p[gone[back]] = 0
        c = c * ALPHABET + p
    return c


@dataclass(frozen=True)
class Model:
    languages: list[str]
    state: np.ndarray  # three symbols -> the longest context in the tree that they end in
    bits: np.ndarray  # context * ALPHABET + symbol -> nats for each language

    def costs(self, column: pa.Array, step: int = 1 << 19) -> np.ndarray:
        """Code length of each text under each language."""
        data, offsets = utf8(column)
        out = np.zeros((len(column), len(self.languages)))
        full = np.flatnonzero(np.diff(offsets))  # texts that aren't empty
        starts = offsets[:-1][full]
        for lo in range(0, len(data), step):
            hi = min(lo + step, len(data))
            back = max(lo - DEPTH - 1, 0)
            s = coded(data[back:hi])
            inside = starts[(starts >= back) & (starts < hi)] - back
            at = self.state[contexts(s, inside)] * np.int32(ALPHABET) + s
            cost = self.bits[at[lo - back :]]
            first = np.searchsorted(starts, lo, side="right") - 1
            texts = np.arange(first, np.searchsorted(starts, hi))
            out[full[texts]] += np.add.reduceat(cost, np.maximum(starts[texts], lo) - lo, axis=0, dtype=np.float64)
        return out


def fit(texts: dict[str, list[str]], contexts_kept: int = 16_000, least: int = 4) -> Model:
    """Trees of the contexts with the greatest share in any one language, so that a language of few texts has its own. texts: by language."""
    languages = sorted(texts)
    counted = {}
    for name in languages:
        data, offsets = utf8(pa.array(texts[name], pa.string()))
        s = coded(data)
        c = contexts(s, offsets[:-1][np.diff(offsets) > 0])
        counted[name] = np.unique(c.astype(np.int64) * ALPHABET + s, return_counts=True)
    cells = [ALPHABET**k for k in range(DEPTH + 1)]
    # contexts of k symbols are numbered by their last k symbols; the empty one is state 0
    totals = [sum(np.bincount(g // ALPHABET % cells[k], n, cells[k]) for g, n in counted.values()) for k in range(DEPTH + 1)]
    chosen = [np.zeros(1, np.int64), np.flatnonzero(totals[1])]
    for k in range(2, DEPTH + 1):
        seen = np.flatnonzero(totals[k] >= least)
        share = np.max([np.bincount(g // ALPHABET % cells[k], n, cells[k])[seen] / max(n.sum(), 1) for g, n in counted.values()], axis=0)
        best = seen[np.argsort(-share, kind="stable")][: contexts_kept // (DEPTH - 1)]
        chosen.append(np.sort(best))
    first = np.cumsum([0] + [len(c) for c in chosen])
    longest = np.zeros(1, np.int32)  # context of k symbols -> its state, or that of its longest suffix in the tree
    suffix = np.zeros(first[-1], np.int64)
    for k in range(1, DEPTH + 1):
        longest = np.tile(longest, ALPHABET)
        suffix[first[k] : first[k + 1]] = longest[chosen[k]]
        longest[chosen[k]] = np.arange(first[k], first[k + 1])
    bits = np.empty((first[-1] * ALPHABET, len(languages)), np.float32)
    for j, name in enumerate(languages):
        g, n = counted[name]
        p = np.full((first[-1], ALPHABET), 1.0 / ALPHABET)
        for k in range(DEPTH + 1):
            of = np.full(cells[k], -1, np.int64)
            of[chosen[k]] = np.arange(len(chosen[k]))
            row = of[g // ALPHABET % cells[k]]
            count = np.bincount((row * ALPHABET + g % ALPHABET)[row >= 0], n[row >= 0], len(chosen[k]) * ALPHABET).reshape(-1, ALPHABET)
            total, kinds = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
            lower = p[suffix[first[k] : first[k + 1]]] if k else np.full((1, ALPHABET), 1.0 / ALPHABET)
            rest = np.where(count > 0, 0.0, lower)
            left = rest.sum(1, keepdims=True)
            escape = np.where(left > 0, kinds / np.maximum(total + kinds, 1), 0.0)
            mine = np.where(count > 0, count / np.maximum(total, 1) * (1 - escape), rest / np.where(left > 0, left, 1) * escape)
            p[first[k] : first[k + 1]] = np.where(total > 0, mine, lower)
        bits[:, j] = -np.log(p).reshape(-1)
    return Model(languages, longest, bits)


def sampled(docs: DataFrame, per_language: int) -> dict[str, list[str]]:
    """At most per_language whole training texts of each language, drawn by a hash of the id, then of the text."""
    rows = docs.filter("lang is not null and text is not null").select("lang", "text", F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)).alias("draw"), F.xxhash64("text").alias("mark"))
    drawn = rows.select("lang", "draw", "mark").distinct().withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "mark"))).filter(F.col("r") <= per_language)
    # as many rows as languages times per_language; rows that repeat id and text count once
    texts = rows.join(F.broadcast(drawn.drop("r")), ["lang", "draw", "mark"]).select("lang", "draw", "mark", "text").dropDuplicates(["lang", "draw", "mark"])
    out: dict[str, list[str]] = {}
    for r in texts.sort("lang", "draw", "mark").collect():
        out.setdefault(r.lang, []).append(r.text)
    return out


def held_out(modulus: int, rest: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == rest, F.lit(False))


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def identify(docs: DataFrame, training: DataFrame, per_language: int = 300) -> DataFrame:
    """The columns of docs but `text`, with lang_pred and score (0 to 1) of each whole text.

    The model is fitted on a bounded sample of `training`: at most per_language whole texts of each
    language. A null text or one without a letter is `und` with score 0; so is every text if there is nothing to learn
    from. Ties go to the language that is first by name. Texts of any length are scored in pieces of bounded size.
    """
    texts = sampled(training, per_language)
    model = docs.sparkSession.sparkContext.broadcast(fit(texts) if texts else None)

    def label(column: pa.Array) -> dict[str, pa.Array]:
        m = kept(("language", id(model)), lambda: model.value)
        if m is None:
            return {"lang_pred": pa.array([UND] * len(column), pa.string()), "score": pa.array(np.zeros(len(column)))}
        cost = m.costs(column)
        data, offsets = utf8(column)
        letters = np.concatenate([[0], np.cumsum((SYMBOLS[data] > 0) & (data < 128))])
        known = letters[offsets[1:]] > letters[offsets[:-1]]
        for i in np.flatnonzero(~known & (np.diff(offsets) > 0)):
            known[i] = _has_letter(column[int(i)].as_py())
        best = cost.argmin(1)
        gap = (cost - cost.min(1, keepdims=True)) / np.sqrt(np.maximum(np.diff(offsets), 1))[:, None]
        score = np.where(known, 1 / np.exp(-np.minimum(gap, 700)).sum(1), 0.0)
        return {"lang_pred": pa.array([m.languages[b] if k else UND for b, k in zip(best, known, strict=True)], pa.string()), "score": pa.array(score)}

    return per_batch(docs, "text", label, "lang_pred string, score double")


def language_of(docs: DataFrame, per_language: int = 300) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from documents whose crc32(doc_id) mod 4 is not 2, null ids among them."""
    rows = docs.select("doc_id", "text", "lang", held_out(4, 2).alias("held_out"))
    return identify(rows.drop("lang"), rows.filter("not held_out"), per_language)


def with_language(docs: DataFrame, per_language: int = 300) -> DataFrame:
    """The documents that are in one of the learned languages, with all their columns as they were; `und` ones are rejected."""
    rows = packed(docs).select("row", F.col("row.text").alias("text"))
    training = docs.select("doc_id", "text", "lang").filter(~held_out(4, 2))
    return identify(rows, training, per_language).filter(F.col("lang_pred") != UND).select("row.*")
