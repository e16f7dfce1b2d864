"""Substring dedup over words by relative Lempel-Ziv parsing.

The reference blocks are the passages of smaller documents, grouped by anchor and indexed by their windows. A document's
passage is parsed against its block greedily: where a window is in the index, the factor runs on for as long as the
reference agrees; all windows inside the factor are duplicates. Windows across a factor's end are looked up one by one,
as another reference may hold them.
"""

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from riskbridge.llm.passages import Hashes, Plan, Units, covered, repeated_windows, with_runs
from riskbridge.llm.simhash import words_in

WINDOW, GRAM = 13, 4


def word_units(data: np.ndarray, offsets: np.ndarray) -> Units:
    words, lo, hi, text = words_in(data, offsets)
    buffer = np.frombuffer(words, np.uint8)
    value = Hashes(buffer.astype(np.uint64) + np.uint64(1)).of(lo, hi)
    return Units(buffer, value, text, lo, hi, np.searchsorted(text, np.arange(len(offsets) - 1)))


def parse(words: list[bytes], starts: int, doc: int, index: dict[bytes, tuple[int, list[bytes], int]], window: int) -> list[tuple[int, int]]:
    """Runs (first start, starts) of windows that a smaller document holds; new windows enter the index.

    Documents come in order, so the index holds each window's smallest document.
    """
    runs, i = [], 0
    while i < starts:
        body = b" ".join(words[i : i + window])
        held = index.setdefault(body, (doc, words, i))
        if held[0] >= doc:
            i += 1
            continue
        _, reference, at = held
        n = window
        while i + n < len(words) and at + n < len(reference) and words[i + n] == reference[at + n]:
            n += 1
        inside = min(n - window + 1, starts - i)
        runs.append((i, inside))
        i += inside
    return runs


def factored(p: dict, plan: Plan) -> list[np.ndarray]:
    order = np.lexsort((p["place"], p["id"], p["anchor"]))
    out, index, anchor = [], {}, None
    raw = p["bytes"].tobytes()
    for i, a, doc, key, place, starts, at, size in zip(*(x.tolist() for x in (order, *(p[c][order] for c in ("anchor", "id", "key", "place", "count", "at", "size")))), strict=True):
        if a != anchor:
            index, anchor = {}, a
        out += [(doc, key, place + j, n) for j, n in parse(raw[at : at + size].split(b" "), starts, doc, index, plan.window)]
    return list(np.array(out, np.int64).reshape(-1, 4).T)


def shared_spans(docs: DataFrame, window: int = WINDOW, crowd: int = 48) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept (its other words, parted by one space).

    Removed is each word inside a window of `window` words whose words also start in a document with a smaller id. Null
    texts have no words. A null id is larger than all others; rows with equal ids are one document, not earlier ones of
    each other. Texts shorter than a window stay whole. Other columns are ignored.
    """
    runs = repeated_windows(docs, word_units, factored, window, GRAM, False, crowd)
    both = with_runs(docs, runs)

    def kept(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
        for text, places, counts in zip(*(batch.column(c).to_pylist() for c in ("text", "places", "counts")), strict=True):
            words = (text or "").encode().split()
            gone = covered(places, counts, window, len(words))
            left = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if places else words)
            for c, v in zip(out, (len(words), int(gone.sum()), sha256(left).hexdigest(), left.decode()), strict=True):
                out[c].append(v)
        return out

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            made = kept(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made["n_words"], pa.int64()), pa.array(made["n_removed"], pa.int64()), pa.array(made["kept_sha256"], pa.string()), pa.array(made["kept"], pa.string())], names=["doc_id", *made])

    return both.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_removed bigint, kept_sha256 string, kept string")


def span_digests(docs: DataFrame) -> DataFrame:
    return shared_spans(docs).drop("kept")
