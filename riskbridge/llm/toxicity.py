"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as the sum of vectors for the word itself and for the characters that it begins and ends with, so forms of
a stem that training never saw are still told apart. The network reads windows of 32 words that start every 24 words, so
all of a text is read, and attention pools a window's states. A text's score is a logistic function of its highest
window. Everything is trained in NumPy on a bounded sample; scoring runs in Spark's tasks.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskbridge.llm.arrow import per_batch, utf8
from riskbridge.llm.language_id import held_out
from riskbridge.llm.passages import Hashes, mixed

WINDOW, STEP = 32, 16
BUCKETS, WIDTH, HIDDEN, ATTEND = 1 << 14, 10, 6, 4
ENDS = [(3, 0), (4, 0), (5, 0), (0, 3), (0, 4)]  # characters at a word's start, at its end
SLOTS = 1 + len(ENDS)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, text of each word, SLOTS bucket numbers of each word). Words are runs of letters, in small letters."""
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint8)
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], letter[:-1]]) & ~edge[:-1] if len(data) else np.zeros(0, bool)
    after = np.concatenate([letter[1:], [False]]) & ~edge[1:] if len(data) else np.zeros(0, bool)
    lo, hi = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
    text = np.searchsorted(offsets, lo, side="right") - 1
    h = Hashes(low.astype(np.uint64) + np.uint64(1))
    whole = h.of(lo, hi)
    kinds, first, which = np.unique(whole, return_index=True, return_inverse=True)
    a, b = lo[first], hi[first]
    parts = [kinds] + [h.of(a, np.minimum(a + n, b)) if n else h.of(np.maximum(b - m, a), b) for n, m in ENDS]
    slots = np.stack([(mixed(p + np.uint64(i * 7919 + 1)) % np.uint64(BUCKETS)).astype(np.int32) + i * BUCKETS for i, p in enumerate(parts)], 1)
    return which, text, slots


def windows(which: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(window -> its WINDOW words, window -> its text); -1 pads. Every text has a window."""
    n = np.bincount(text, minlength=texts)
    many = np.maximum(-(-(n - WINDOW) // STEP), 0) + 1
    of = np.repeat(np.arange(texts), many)
    start = (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)) * STEP
    at = start[:, None] + np.arange(WINDOW)
    inside = at < n[of][:, None]
    first = (np.cumsum(n) - n)[of]
    padded = np.append(which, -1)
    return np.where(inside, padded[np.minimum(first[:, None] + at, len(which))], -1), of


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def _gru(x: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of each step; x: (steps, windows, 3 HIDDEN) input parts of the update and reset gates and the new state."""
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    out = np.empty((*x.shape[:2], HIDDEN), np.float32)
    for t in range(len(x)):
        p = h @ u
        zr = _sigmoid(x[t, :, : 2 * HIDDEN] + p[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        new = np.tanh(x[t, :, 2 * HIDDEN :] + r * p[:, 2 * HIDDEN :])
        if keep is not None:
            keep.append((h, z, r, new, p[:, 2 * HIDDEN :]))
        h = new + z * (h - new)
        out[t] = h
    return out


def _gru_back(d_out: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    dx = np.empty((*d_out.shape[:2], 3 * HIDDEN), np.float32)
    du, dh = np.zeros_like(u), np.zeros(d_out.shape[1:], np.float32)
    for t in range(len(d_out) - 1, -1, -1):
        h, z, r, new, pn = kept[t]
        dh = dh + d_out[t]
        d_new = dh * (1 - z) * (1 - new * new)
        dx[t, :, :HIDDEN] = dh * (h - new) * z * (1 - z)
        dx[t, :, HIDDEN : 2 * HIDDEN] = d_new * pn * r * (1 - r)
        dx[t, :, 2 * HIDDEN :] = d_new
        dp = dx[t].copy()
        dp[:, 2 * HIDDEN :] = d_new * r
        du += h.T @ dp
        dh = dh * z + dp @ u.T
    return dx, du


@dataclass
class Network:
    p: dict[str, np.ndarray]
    slope: float = 1.0
    offset: float = 0.0

    def _inputs(self, slots: np.ndarray) -> np.ndarray:
        """Vectors of words, and last that of padding."""
        return np.concatenate([self.p["vectors"][slots].sum(1), self.p["pad"]])

    def _pooled(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = np.tanh(states @ self.p["attend"] + self.p["attend_bias"])
        e = s @ self.p["focus"]
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        return s, a, (a[:, :, None] * states).sum(0)

    def logits(self, slots: np.ndarray, win: np.ndarray, chunk: int = 2048) -> np.ndarray:
        parts = self._inputs(slots) @ self.p["enter"] + self.p["bias"]  # of each different word, once
        ahead, back = np.ascontiguousarray(parts[:, : 3 * HIDDEN]), np.ascontiguousarray(parts[:, 3 * HIDDEN :])
        out = np.empty(len(win), np.float32)
        for at in range(0, len(win), chunk):
            w = win[at : at + chunk].T
            states = np.concatenate([_gru(ahead[w], self.p["u_ahead"]), _gru(back[w[::-1]], self.p["u_back"])[::-1]], 2)
            out[at : at + chunk] = self._pooled(states)[2] @ self.p["out"] + self.p["out_bias"]
        return out

    def gradients(self, slots: np.ndarray, win: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p, w = self.p, win.T
        x = self._inputs(slots)[w]
        parts = x @ p["enter"] + p["bias"]
        ka, kb = [], []
        states = np.concatenate([_gru(parts[:, :, : 3 * HIDDEN], p["u_ahead"], ka), _gru(parts[::-1, :, 3 * HIDDEN :], p["u_back"], kb)[::-1]], 2)
        s, a, pooled = self._pooled(states)
        d = ((_sigmoid(pooled @ p["out"] + p["out_bias"]) - label) / len(label)).astype(np.float32)
        g = {"out": pooled.T @ d, "out_bias": d.sum(keepdims=True)}
        d_pooled = d[:, None] * p["out"]
        d_a = np.einsum("nh,tnh->tn", d_pooled, states)
        d_e = a * (d_a - (a * d_a).sum(0))
        d_s = d_e[:, :, None] * p["focus"] * (1 - s * s)
        g["focus"], g["attend"], g["attend_bias"] = np.einsum("tn,tnk->k", d_e, s), np.einsum("tnh,tnk->hk", states, d_s), d_s.sum((0, 1))
        d_states = a[:, :, None] * d_pooled + d_s @ p["attend"].T
        dx_a, g["u_ahead"] = _gru_back(np.ascontiguousarray(d_states[:, :, :HIDDEN]), p["u_ahead"], ka)
        dx_b, g["u_back"] = _gru_back(np.ascontiguousarray(d_states[::-1, :, HIDDEN:]), p["u_back"], kb)
        d_parts = np.concatenate([dx_a, dx_b[::-1]], 2)
        g["bias"], g["enter"] = d_parts.sum((0, 1)), np.einsum("tnd,tnk->dk", x, d_parts)
        d_x = d_parts @ p["enter"].T
        flat, real = w.reshape(-1), w.reshape(-1) >= 0
        d_flat = d_x.reshape(-1, WIDTH)
        g["pad"] = d_flat[~real].sum(0, keepdims=True)
        ids = slots[flat[real]]
        rows = np.repeat(d_flat[real], SLOTS, 0)
        g["vectors"] = np.stack([np.bincount(ids.reshape(-1), rows[:, j], SLOTS * BUCKETS) for j in range(WIDTH)], 1).astype(np.float32)
        return g


def _new(rng: np.random.Generator) -> dict[str, np.ndarray]:
    shape = {
        "vectors": (SLOTS * BUCKETS, WIDTH), "pad": (1, WIDTH), "enter": (WIDTH, 6 * HIDDEN), "u_ahead": (HIDDEN, 3 * HIDDEN), "u_back": (HIDDEN, 3 * HIDDEN),
        "attend": (2 * HIDDEN, ATTEND), "focus": (ATTEND,), "out": (2 * HIDDEN,),
    }
    zero = {"bias": (6 * HIDDEN,), "attend_bias": (ATTEND,), "out_bias": (1,)}
    return {k: (rng.normal(0, 0.35, s) * (k != "vectors")).astype(np.float32) for k, s in shape.items()} | {k: np.zeros(s, np.float32) for k, s in zero.items()}


def _highest(logit: np.ndarray, of: np.ndarray, texts: int) -> np.ndarray:
    out = np.full(texts, -np.inf, np.float32)
    np.maximum.at(out, of, logit)
    return out


def _seen_often(slots: np.ndarray, which: np.ndarray, text: np.ndarray, least: int) -> np.ndarray:
    """Buckets that occur in at least `least` texts."""
    pairs = np.unique(text.astype(np.int64) * len(slots) + which)
    seen = slots[pairs % len(slots)].astype(np.int64) + (pairs // len(slots) * SLOTS * BUCKETS)[:, None]
    return np.bincount(np.unique(seen) % (SLOTS * BUCKETS), minlength=SLOTS * BUCKETS) >= least


def _cut(top: np.ndarray, label: np.ndarray, weight: float) -> tuple[float, float]:
    """Slope and offset that put score 0.5 where the weighted errors are fewest, in the middle of the widest such gap."""
    order = np.argsort(top, kind="stable")
    top, label = top[order], label[order]
    missed = np.concatenate([[0], np.cumsum(label)])
    raised = np.concatenate([[0], np.cumsum(1 - label)])
    errors = missed + weight * (raised[-1] - raised)
    edges = np.concatenate([[top[0] - 1], top, [top[-1] + 1]])
    gap = np.diff(edges)
    best = max(range(len(gap)), key=lambda i: (-errors[i], gap[i]))
    return 1.0, -float(edges[best] + edges[best + 1]) / 2


def train(texts: list[str], toxic: list[int], epochs: int = 8, batch: int = 128, rate: float = 0.02, decay: float = 1e-3, negative_weight: float = 3.0, least: int = 4, seed: int = 11) -> Network:
    """Adam on each text's windows that the network finds most toxic, at first on any; then the scale of a text's score.

    A text is toxic for its worst windows, so only those learn from its label. Buckets in fewer than `least` texts stay
    neutral, as do those never seen. A fifth of the texts is kept for the score's cut.
    """
    rng = np.random.default_rng(seed)
    net = Network(_new(rng))
    label = np.array(toxic, np.float32)
    which, text, slots = words(*utf8(pa.array(texts, pa.string())))
    win, of = windows(which, text, len(texts))
    often = _seen_often(slots, which, text, least)
    own = rng.random(len(texts)) < 0.8
    own[[int(np.flatnonzero(label == y)[0]) for y in (0, 1)]] = True
    ours = np.flatnonzero(own[of])
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        worth = rng.random(len(ours)) if epoch < 2 else net.logits(slots, win[ours])
        ranked = ours[np.lexsort((-worth, of[ours]))]
        place = np.arange(len(ranked)) - np.searchsorted(of[ranked], of[ranked])
        picked = ranked[place < (4 if epoch < 2 else 2)]
        for rows in np.array_split(rng.permutation(picked), max(1, len(picked) // batch)):
            step += 1
            for k, g in net.gradients(slots, win[rows], label[of[rows]]).items():
                if k == "vectors":
                    g[~often] = 0
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                net.p[k] -= (rate * 0.8**epoch * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6) + decay * net.p[k]).astype(np.float32)
    top = _highest(net.logits(slots, win), of, len(texts)).astype(np.float64)
    kept = ~own if len(set(label[~own])) == 2 else own
    net.slope, net.offset = _cut(top[kept], label[kept], negative_weight)
    return net


def sampled(docs: DataFrame, labels: DataFrame, per_label: int) -> tuple[list[str], list[int]]:
    """The whole texts of at most per_label toxic and three times as many other documents of docs, drawn by a hash of the id."""
    known = labels.filter("toxic is not null").select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)").distinct()
    known = known.join(docs.select(F.col("doc_id").alias("id")), "id", "left_semi")
    drawn = None
    for value in (0, 1):
        part = known.filter(F.col("toxic") == value).orderBy(F.xxhash64(F.col("id").cast("string"), F.lit(3)), "id").limit(per_label * (3 if value == 0 else 1))
        drawn = part if drawn is None else drawn.unionByName(part)
    rows = docs.join(F.broadcast(drawn), F.col("doc_id") == F.col("id")).select("text", "toxic", "id")  # 4 per_label rows at most
    rows = rows.orderBy(F.xxhash64(F.col("id").cast("string"), F.lit(3)), "id", "text").collect()
    return [r.text for r in rows], [r.toxic for r in rows]


def scored(docs: DataFrame, net: Network | None) -> DataFrame:
    """The columns of docs but `text`, with score (0 to 1) of each whole text; 0 without a network."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(column: pa.Array) -> dict[str, pa.Array]:
        n = shared.value
        if n is None or not len(column):
            return {"score": pa.array(np.zeros(len(column)))}
        data, offsets = utf8(column)
        which, text, slots = words(data, offsets)
        top = np.full(len(column), -np.inf)
        per = np.bincount(text, minlength=len(column))
        cut = np.unique(np.concatenate([[0, len(column)], np.searchsorted(np.cumsum(per), np.arange(200_000, len(which), 200_000))]))
        first = np.concatenate([[0], np.cumsum(per)])
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            win, of = windows(which[first[a] : first[b]], text[first[a] : first[b]] - a, b - a)
            top[a:b] = _highest(n.logits(slots, win), of, b - a)
        return {"score": pa.array(1 / (1 + np.exp(-np.clip(n.slope * top + n.offset, -30, 30))))}

    return per_batch(docs, "text", run, "score double")


def toxicity(docs: DataFrame, labels: DataFrame, per_label: int = 700, epochs: int = 8) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Learns from the whole texts of labelled documents whose crc32(doc_id) mod 5 is not 0: at most per_label toxic ones and three times as
    many others. Null texts are empty; an empty text is a window of padding. If either label has no training text all scores
    are 0. Null ids are never trained on. Conflicting labels of an id both count; repeated rows are scored alike. Other columns are ignored.
    """
    rows = docs.select("doc_id", "text", held_out(5, 0).alias("held_out"))
    texts, toxic = sampled(rows.filter("not held_out and text is not null"), labels, per_label)
    net = train(texts, toxic, epochs) if len(set(toxic)) == 2 else None
    return scored(rows, net).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
