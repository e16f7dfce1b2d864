"""Byte-level dedup by a collection's Burrows-Wheeler transform, built column by column.

Passages that share an anchor are aligned at it, so equal windows start in the same column. From the last column to the
first, each round puts one symbol before every passage: a stable sort of the symbols in the present order gives the next
order (the column's part of the transform), and the common prefix of two neighbours becomes one more than the least
between their places before, or nought where the symbols differ. Neighbours with a common prefix of a window's length
start the same string; all but the first of such a run are marked. The rounds are as many as a passage is long, at most
two windows, whatever the length of texts.
"""

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from riskbridge.llm.passages import Plan, Units, covered, repeated_windows, unzipped, with_runs

WINDOW, GRAM = 100, 20
_VALUES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)


def byte_units(data: np.ndarray, offsets: np.ndarray) -> Units:
    at = np.arange(len(data))
    return Units(data, _VALUES[data], np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets)), at, at + 1, offsets[:-1])


def least_between(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of x[lo:hi] of each pair, hi > lo, from minima over powers of two."""
    size = hi - lo
    out = np.empty(len(lo), x.dtype)
    level, table = 0, x
    while True:
        own = np.flatnonzero((size >> level) == 1)
        out[own] = np.minimum(table[lo[own]], table[hi[own] - (1 << level)])
        if not (size >> (level + 1)).any():
            return out
        table = np.minimum(table[: -(1 << level)], table[1 << level :])
        level += 1


def rounds(symbols: np.ndarray):  # noqa: ANN201
    """Yields (column, order, common prefix with the row before) from the last column to the first; symbol 0 ends a passage."""
    m, width = symbols.shape
    order = np.arange(m)
    prefix = np.zeros(m, np.int16)
    for column in range(width - 1, -1, -1):
        bwt = symbols[order, column]
        nxt = np.argsort(bwt, kind="stable")
        c = bwt[nxt]
        new = np.zeros(m, np.int16)
        same = np.flatnonzero((c[1:] == c[:-1]) & (c[1:] > 0)) + 1
        if len(same):
            new[same] = least_between(prefix, nxt[same - 1] + 1, nxt[same] + 1) + 1
        order, prefix = order[nxt], new
        yield column, order, prefix


def repeated(p: dict, plan: Plan) -> list[np.ndarray]:
    out = []
    order = np.argsort(p["anchor"], kind="stable")
    cut = np.flatnonzero(np.diff(p["anchor"][order])) + 1
    bounds = np.concatenate([[0], cut, [len(order)]])
    # passages of one anchor stay together; a piece has about 16,000 passages, more only if an anchor has
    pieces, lo = [], 0
    for hi in bounds[1:]:
        if hi - lo >= 16_000 or hi == len(order):
            pieces.append(order[lo:hi])
            lo = hi
    reach = plan.window - plan.gram
    for rows in pieces:
        left, size = p["left"][rows].astype(np.int64), p["size"][rows].astype(np.int64)
        symbols = np.zeros((len(rows), reach + plan.window), np.uint16)
        row = np.repeat(np.arange(len(rows)), size)
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        symbols[row, np.repeat(reach - left, size) + inside] = p["bytes"][np.repeat(p["at"][rows], size) + inside].astype(np.uint16) + 1
        rank = np.empty(len(rows), np.int64)
        ordered = np.lexsort((p["place"][rows] + left, p["id"][rows]))
        ids, places = p["id"][rows][ordered], (p["place"][rows] + left)[ordered]
        step = np.ones(len(rows), np.int64)
        step[1:] = (ids[1:] != ids[:-1]) | (places[1:] != places[:-1])
        rank[ordered] = np.cumsum(step)  # equal ranks: the same place of repeated rows
        hit_row, hit_column = [], []
        for column, at, prefix in rounds(symbols):
            if column > reach or not (long := prefix >= plan.window).any():
                continue
            member = long.copy()
            member[:-1] |= long[1:]
            member = np.flatnonzero(member)
            heads = np.flatnonzero(~long[member])
            first = np.minimum.reduceat(rank[at[member]], heads)
            later = rank[at[member]] > np.repeat(first, np.diff(np.append(heads, len(member))))
            hit_row.append(at[member[later]])
            hit_column.append(np.full(int(later.sum()), column))
        if not hit_row:
            continue
        r, c = np.concatenate(hit_row), np.concatenate(hit_column)
        by = np.lexsort((c, r))
        r, c = r[by], c[by]
        head = np.ones(len(r), bool)
        head[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1] + 1)
        heads = np.flatnonzero(head)
        r, c, n = r[heads], c[heads], np.diff(np.append(heads, len(head)))
        src = rows[r]
        out.append([p["id"][src], p["key"][src], p["place"][src] + c - reach + left[r], n])
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4


def byte_digests(docs: DataFrame, window: int = WINDOW, crowd: int = 48) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Removed is each byte inside a string of `window` bytes that also starts earlier: in a smaller id, or before in the same
    document. Null texts are empty; a null id comes after all others; rows that repeat id and place are not earlier than
    each other. Other columns are ignored.
    """
    runs = repeated_windows(docs, byte_units, repeated, window, min(GRAM, window), True, crowd, ask_first=True)
    both = with_runs(docs, runs, small=True)

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            rows = []
            texts = unzipped(batch.column("text")).to_pylist()
            for text, places, counts in zip(texts, *(batch.column(c).to_pylist() for c in ("places", "counts")), strict=True):
                data = text or b""
                if not places:
                    rows.append((len(data), 0, 0, sha256(data).hexdigest()))
                    continue
                gone = covered(places, counts, window, len(data))
                left = np.frombuffer(data, np.uint8)[~gone].tobytes()
                spans = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[0])
                rows.append((len(data), int(gone.sum()), spans, sha256(left).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return both.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
