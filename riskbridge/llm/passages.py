"""Windows of a fixed number of units (words or bytes) that also start earlier in the corpus, found exactly.

Each window is represented by its anchor, the gram with the smallest hash in it, so equal windows have equal anchors at
equal places. All windows of an anchor's occurrence are sent once, as the passage that they cover, to the partition of
the anchor; there a method (`llm.spans`, `llm.columns`) compares passages of equal anchors.

Hot passages: equal passages of a batch of texts are sent once, the later ones are marked on the spot. An anchor with
many different passages in some batch is not sent as passages but window by window, keyed by the window's content, and
its own partition hands on what other batches sent there; so one anchor gets at most `crowd` passages from a batch, and
the windows are counted by an ordinary grouping. No passage is dropped.
"""

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from riskbridge.functions.durable import durable
from riskbridge.llm.arrow import utf8
from riskbridge.llm.common import text_of

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = (1 << 24) - 1  # low bits of a packed hash hold the gram's place in the chunk
CHUNK = 1 << 21
BUCKET = 1 << 25  # bytes of text a bucket stands for, where buckets grow with the input
NO_ID = (1 << 63) - 1  # stands for a null id, after all others


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(29))


def zipped(docs: DataFrame) -> DataFrame:
    """The rows with each text compressed on its own, for joins that move texts; short texts compress better so than in the shuffle's blocks."""
    names, at = docs.columns, docs.columns.index("text")
    schema = StructType([StructField("text", BinaryType()) if f.name == "text" else f for f in docs.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            raw = [None if x is None else x.encode() for x in batch.column(at).to_pylist()]
            small = pa.array([None if x is None else len(x).to_bytes(8, "little") + codec.compress(x, asbytes=True) for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([small if c == "text" else batch.column(i) for i, c in enumerate(names)], names=names)

    return docs.mapInArrow(run, schema)


def unzipped(column: pa.Array) -> pa.Array:
    return pa.array([None if b is None else pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True) for b in column.to_pylist()], pa.large_binary())


class Hashes:
    """Hashes of runs of units, from running sums of powers."""

    def __init__(self, units: np.ndarray) -> None:
        n = len(units)
        powers = np.full(n + 1, _BASE, U)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(units * powers[:-1], out=self.sums[1:])
        self.inverse = np.full(n + 1, _INVERSE, U)
        self.inverse[0] = 1
        np.multiply.accumulate(self.inverse, out=self.inverse)

    def of(self, lo: np.ndarray | slice, hi: np.ndarray | slice) -> np.ndarray:
        return mixed((self.sums[hi] - self.sums[lo]) * self.inverse[lo])


@dataclass
class Units:
    """A batch's units: value, text, bytes in `buffer`, and each text's first unit."""

    buffer: np.ndarray
    value: np.ndarray
    text: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray


@dataclass(frozen=True)
class Plan:
    window: int
    gram: int
    by_place: bool  # earlier: a smaller id, or the same id and an earlier start; else a smaller id alone
    buckets: int
    crowd: int = 48


def sliding_min(x: np.ndarray, span: int) -> np.ndarray:
    s = 1
    while 2 * s <= span:
        x = np.minimum(x[:-s], x[s:])
        s *= 2
    return np.minimum(x[: len(x) - (span - s)], x[span - s :]) if span > s else x


def gathered(buffer: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    at = np.cumsum(size) - size
    return buffer[np.repeat(lo - at, size) + np.arange(int(size.sum()))]


def pack(p: dict) -> bytes:
    raw = pickle.dumps(p, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(b: bytes) -> dict:
    return pickle.loads(pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True))  # noqa: S301  written by pack


def _later(u: Units, h: np.ndarray, ids: np.ndarray, place: np.ndarray, lo: np.ndarray, size: np.ndarray, by_place: bool) -> np.ndarray:
    """Which strings of a chunk also stand earlier in it. Equal hashes are compared byte by byte."""
    order = np.lexsort((place, ids, h))
    head = np.ones(len(order), bool)
    head[1:] = h[order][1:] != h[order][:-1]
    of = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]  # each one's first of equal hash
    later = ids[order] > ids[of]
    if by_place:
        later |= (ids[order] == ids[of]) & (place[order] > place[of])
    later &= size[order] == size[of]
    twin = np.flatnonzero(later)
    if len(twin):
        n = size[order[twin]]
        differ = gathered(u.buffer, lo[order[twin]], n) != gathered(u.buffer, lo[of[twin]], n)
        later[twin] &= ~np.logical_or.reduceat(differ, np.cumsum(n) - n)
    out = np.zeros(len(order), bool)
    out[order] = later
    return out


def _anchored(u: Units, plan: Plan, lo: int, hi: int) -> tuple | None:
    """Hashes, anchor places, and of each run of windows with one anchor: first start, windows, end, anchor. Starts are from lo to hi."""
    w, k = plan.window, plan.gram
    stop = min(hi + w - 1, len(u.value))
    n = stop - lo - w + 1
    if n <= 0:
        return None
    text = u.text[lo:stop]
    hashes = Hashes(u.value[lo:stop])
    grams = hashes.of(slice(0, stop - lo - k + 1), slice(k, None))
    least = sliding_min((grams & U(~_PLACE & (2**64 - 1))) | np.arange(len(grams), dtype=U), w - k + 1)
    at = (least & U(_PLACE)).astype(np.int64)
    valid = text[:n] == text[w - 1 :]
    new = valid.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    begin = np.flatnonzero(new)
    ends = np.flatnonzero(valid & ~np.concatenate([valid[1:] & ~new[1:], [False]]))
    return hashes, at, begin, ends - begin + 1, ends + w, grams[at[begin]]


def _short(anchor: np.ndarray) -> np.ndarray:
    return (anchor >> U(32)).astype(np.uint32)


def _passages(u: Units, ids: np.ndarray, plan: Plan, lo: int, hi: int, kept: np.ndarray | None = None) -> Iterator[tuple[int, dict]]:
    """Payloads by bucket for the windows that start at units lo to hi; with `kept`, only of anchors that a text's list there holds."""
    w, text = plan.window, u.text[lo:]
    found = _anchored(u, plan, lo, hi)
    if found is None:
        return
    hashes, at, begin, count, last, anchor = found
    if kept is not None:
        met = np.isin((text[begin].astype(U) << U(32)) | _short(anchor), kept)
        begin, count, last, anchor = begin[met], count[met], last[met], anchor[met]
    whole = hashes.of(begin, last) ^ mixed((last - begin).astype(U))
    t = text[begin]
    b_lo, b_size = u.lo[lo + begin], u.hi[lo + last - 1] - u.lo[lo + begin]
    place = lo + begin - u.first[t]
    later = _later(u, whole ^ mixed((at[begin] - begin).astype(U)), ids[t], place, b_lo, b_size, plan.by_place)
    marked, sent = np.flatnonzero(later), np.flatnonzero(~later)
    bucket = (anchor % U(plan.buckets)).astype(np.int64)
    kinds, which, many = np.unique(anchor[sent], return_inverse=True, return_counts=True)
    crowded = many[which] > plan.crowd
    loose = sent[crowded]
    sent = sent[~crowded]
    bring: dict[int, dict] = {}

    def share(name: str, rows: np.ndarray, key: np.ndarray, make: Callable[[np.ndarray], dict]) -> None:
        rows = rows[np.argsort(key, kind="stable")]
        key = np.sort(key)
        for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(key)) + 1) if len(rows) else []:
            bring.setdefault(int(key[part[0]]), {})[name] = make(rows[part])

    share("passages", sent, bucket[sent], lambda r: {
        "anchor": (anchor[r] >> U(32)).astype(np.uint32), "left": (at[begin[r]] - begin[r]).astype(np.int16), "count": count[r].astype(np.int16), "size": b_size[r].astype(np.int32),
        "bytes": gathered(u.buffer, b_lo[r], b_size[r]).tobytes(), "text": t[r].astype(np.int32), "place": place[r],
    })
    share("notices", np.flatnonzero(many > plan.crowd), (kinds[many > plan.crowd] % U(plan.buckets)).astype(np.int64), lambda r: (kinds[r] >> U(32)).astype(np.uint32))
    share("marked", marked, t[marked] % plan.buckets, lambda r: {"text": t[r].astype(np.int32), "place": place[r], "count": count[r]})
    of = np.repeat(loose, count[loose])
    step = np.arange(len(of)) - np.repeat(np.cumsum(count[loose]) - count[loose], count[loose])
    start, where = begin[of] + step, place[of] + step
    w_lo, w_hi = u.lo[lo + start], u.hi[lo + start + w - 1]
    later = _later(u, hashes.of(start, start + w), ids[t[of]], where, w_lo, w_hi - w_lo, plan.by_place)
    again, fresh = np.flatnonzero(later), np.flatnonzero(~later)
    if len(again):  # those that follow each other are one run
        again = again[np.lexsort((where[again], t[of[again]]))]
        head = np.ones(len(again), bool)
        head[1:] = (np.diff(t[of[again]]) != 0) | (np.diff(where[again]) != 1)
        heads = np.flatnonzero(head)
        runs, size = again[heads], np.diff(np.append(heads, len(again)))
        share("again", np.arange(len(runs)), t[of[runs]] % plan.buckets, lambda r: {"text": t[of[runs[r]]].astype(np.int32), "place": where[runs[r]], "count": size[r]})

    def windows(r: np.ndarray) -> dict:
        return {"text": t[of[r]].astype(np.int32), "place": where[r], "window": [u.buffer[i:j].tobytes() for i, j in zip(w_lo[r], w_hi[r], strict=True)]}

    share("windows", fresh, of[fresh] % plan.buckets, windows)
    yield from bring.items()


def _chunks(batches: Iterator[pa.RecordBatch], units: Callable[[np.ndarray, np.ndarray], Units]) -> Iterator[tuple[Units, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Units, ids, keys and rows of about CHUNK bytes of text."""
    for batch in batches:
        text = batch.column(2)
        data, offsets = utf8(unzipped(text).cast(pa.large_string()) if pa.types.is_binary(text.type) else text)
        cuts = np.unique(np.concatenate([[0, batch.num_rows], np.searchsorted(offsets, np.arange(CHUNK, len(data), CHUNK))]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # whole texts, so a chunk is longer only if one text is
            rows = batch.slice(a, b - a)
            yield units(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), rows.column(0).fill_null(NO_ID).to_numpy(), rows.column(1).to_numpy(), rows


def _payloads(made: list[tuple[int, dict]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in made], pa.int32()), pa.array([pack(p) for _, p in made], pa.binary())], names=["bucket", "payload"])


def _asked(units: Callable[[np.ndarray, np.ndarray], Units], plan: Plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Anchors without their passages. One that a chunk holds once asks in its bucket; one that it holds more often is announced there
    once, and its texts get it by their id, so that a hot anchor costs its bucket one entry a chunk."""

    def entries(text: np.ndarray, short: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> dict:
        docs, n = np.unique(text, return_counts=True)
        return {"id": ids[docs], "key": keys[docs], "n": n.astype(np.uint32), "short": short[np.argsort(text, kind="stable")]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, ids, keys, _ in _chunks(batches, units):
            for lo in range(0, len(u.value), CHUNK):
                found = _anchored(u, plan, lo, lo + CHUNK)
                if found is None:
                    continue
                begin, anchor = found[2], found[5]
                text, bucket = u.text[lo + begin], (anchor % U(plan.buckets)).astype(np.int64)
                kinds, which, many = np.unique(anchor, return_inverse=True, return_counts=True)
                once = many[which] == 1
                bring: dict[int, dict] = {}

                def share(name: str, key: np.ndarray, make: Callable[[np.ndarray], object], bring: dict[int, dict] = bring) -> None:
                    order = np.argsort(key, kind="stable")
                    for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(order) else []:
                        bring.setdefault(int(key[part[0]]), {})[name] = make(part)

                short = _short(anchor)
                asks, (t, s) = np.flatnonzero(once), np.unique(np.stack([text[~once].astype(np.int64), short[~once].astype(np.int64)]), axis=1)
                share("asks", bucket[asks], lambda r, i=asks, text=text, short=short, ids=ids, keys=keys: entries(text[i[r]], short[i[r]], ids, keys))
                known = kinds[many > 1]
                share("known", (known % U(plan.buckets)).astype(np.int64), lambda r, known=known: _short(known[r]))
                share("own", t % plan.buckets, lambda r, t=t, s=s, ids=ids, keys=keys: entries(t[r], s[r].astype(np.uint32), ids, keys))
                yield _payloads(list(bring.items()))

    return run


_LISTS = "id bigint, key int, anchors binary"


def _answered(table: pa.Table) -> pa.Table:
    """The anchors of each text that the corpus holds more than once, four bytes each."""
    payloads = [unpack(p.as_py()) for p in table.column("payload")]

    def all_of(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [p[name] for p in payloads if name in p]
        ids, keys = (np.concatenate([np.repeat(p[c], p["n"]) for p in parts] or [np.zeros(0, t)]) for c, t in (("id", np.int64), ("key", np.int32)))
        return ids, keys, np.concatenate([p["short"] for p in parts] or [np.zeros(0, np.uint32)])

    asks = all_of("asks")
    known = np.concatenate([p["known"] for p in payloads if "known" in p] or [np.zeros(0, np.uint32)])
    _, which, many = np.unique(asks[2], return_inverse=True, return_counts=True)
    met = (many[which] > 1) | np.isin(asks[2], known)
    ids, keys, short = (np.concatenate([a[met], o]) for a, o in zip(asks, all_of("own"), strict=True))
    order = np.lexsort((keys, ids))
    ids, keys, short = ids[order], keys[order], short[order]
    head = np.ones(len(ids), bool)
    head[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
    heads = np.flatnonzero(head)
    raw = short.tobytes()
    ends = np.append(heads, len(ids)) * 4
    lists = pa.array([raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
    return pa.table({"id": pa.array(ids[heads], pa.int64()), "key": pa.array(keys[heads], pa.int32()), "anchors": lists})


def _met(rows: pa.RecordBatch) -> np.ndarray:
    """Text number and anchor of all lists of a chunk's rows, packed."""
    out = [np.zeros(0, U)]
    for i, parts in enumerate(rows.column(3).to_pylist()):
        out += [np.frombuffer(b, np.uint32).astype(U) | U(i << 32) for b in parts]
    return np.concatenate(out)


def _sent(units: Callable[[np.ndarray, np.ndarray], Units], plan: Plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, ids, keys, rows in _chunks(batches, units):
            kept = _met(rows) if rows.num_columns > 3 else None
            for lo in range(0, len(u.value), CHUNK):
                made = list(_passages(u, ids, plan, lo, lo + CHUNK, kept))
                for _, p in made:
                    for part in p.values():
                        if isinstance(part, dict):
                            texts = part.pop("text")
                            part["id"], part["key"] = ids[texts], keys[texts]
                yield _payloads(made)

    return run


_FOUND = "id bigint, key int, place bigint, count bigint, window binary"


def _found(compare: Callable[[dict, Plan], list[np.ndarray]], plan: Plan) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        payloads = [unpack(p.as_py()) for p in table.column("payload")]
        marked = [p[c] for p in payloads for c in ("marked", "again") if c in p]
        loose = [p["windows"] for p in payloads if "windows" in p]
        out = [[np.concatenate([m[c] for m in marked]) if marked else np.zeros(0, np.int64) for c in ("id", "key", "place", "count")]]
        sent = [p["passages"] for p in payloads if "passages" in p]
        windows: list[tuple] = [(i, k, at, w) for m in loose for i, k, at, w in zip(m["id"], m["key"], m["place"], m["window"], strict=True)]
        if sent:
            whole = np.frombuffer(b"".join(p["bytes"] for p in sent), np.uint8)
            rows = {c: np.concatenate([p[c] for p in sent]) for c in sent[0] if c != "bytes"}
            rows["at"] = np.cumsum(rows["size"].astype(np.int64)) - rows["size"]
            _, which, many = np.unique(rows["anchor"], return_inverse=True, return_counts=True)
            notices = np.concatenate([p["notices"] for p in payloads if "notices" in p] or [np.zeros(0, np.uint32)])
            crowded = np.isin(rows["anchor"], notices)
            take = {c: v[(many[which] > 1) & ~crowded] for c, v in rows.items()}
            if len(take["id"]):
                out.append(compare(take | {"bytes": whole}, plan))
            for i in np.flatnonzero(crowded):
                passage = whole[rows["at"][i] : rows["at"][i] + rows["size"][i]].tobytes()
                windows += [(rows["id"][i], rows["key"][i], rows["place"][i] + j, x) for j, x in enumerate(plan_windows(passage, plan, int(rows["count"][i])))]
        first, again, ties = {}, [], []
        for row in sorted(windows, key=lambda r: (r[0], r[2])):
            held = first.setdefault(row[3], row)
            if held[0] < row[0] or (plan.by_place and held[0] == row[0] and held[2] < row[2]):
                again.append((*row[:3], 1))
            elif held is not row:
                ties.append(row)
        out.append(list(np.array(again, np.int64).reshape(-1, 4).T))
        i, k, at, n = (np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True))
        more = list(zip(*first.values(), *ties, strict=True)) or [[], [], [], []]
        return pa.table({
            "id": np.concatenate([i, np.array(more[0], np.int64)]), "key": np.concatenate([k, np.array(more[1], np.int64)]).astype(np.int32),
            "place": np.concatenate([at, np.array(more[2], np.int64)]), "count": np.concatenate([n, np.ones(len(more[0]), np.int64)]),
            "window": pa.array([None] * len(i) + list(more[3]), pa.binary()),
        })

    return run


def plan_windows(passage: bytes, plan: Plan, count: int) -> list[bytes]:
    if plan.by_place:
        return [passage[j : j + plan.window] for j in range(count)]
    words = passage.split(b" ")
    return [b" ".join(words[j : j + plan.window]) for j in range(count)]


def text_key() -> Column:
    """Tells rows apart that share an id but not the text."""
    return F.hash(text_of())


def repeated_windows(docs: DataFrame, units: Callable[[np.ndarray, np.ndarray], Units], compare: Callable[[dict, Plan], list[np.ndarray]], window: int, gram: int, by_place: bool, crowd: int = 48, ask_first: bool = False) -> DataFrame:
    """(id, key, runs): for each document with any, the runs (first start, number of starts) of windows that also start earlier.

    id is the doc_id (NO_ID for null), key a hash of the text. Documents that repeat both share their runs. With `ask_first` a
    pass over the anchors alone finds those that the corpus holds more than once, and only their passages are sent; the buckets
    then grow with the bytes of text.
    """
    buckets = 4 * max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), text_key().alias("key"), F.col("text"))
    if ask_first:
        buckets = max(buckets, (docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0) // BUCKET)
    plan = Plan(window, gram, by_place, buckets, crowd)
    if ask_first:
        asked = rows.mapInArrow(_asked(units, plan), "bucket int, payload binary")
        lists = asked.groupBy("bucket").applyInArrow(_answered, _LISTS).groupBy("id", "key").agg(F.collect_list("anchors").alias("anchors"))
        rows = zipped(rows.withColumn("id", F.coalesce("id", F.lit(NO_ID)))).join(lists, ["id", "key"])
    sent = rows.mapInArrow(_sent(units, plan), "bucket int, payload binary")
    found = durable(sent.groupBy("bucket").applyInArrow(_found(compare, plan), _FOUND))
    loose = found.filter("window is not null")
    where = F.struct("id", "place") if by_place else F.struct("id")
    first = loose.groupBy("window").agg(F.min(where).alias("first"))
    again = loose.join(first, "window").filter(where > F.col("first")).select("id", "key", "place", "count")
    marks = found.filter("window is null").select("id", "key", "place", "count").unionByName(again)
    return marks.groupBy("id", "key").agg(F.collect_set(F.struct("place", "count")).alias("runs"))


def with_runs(docs: DataFrame, runs: DataFrame, small: bool = False) -> DataFrame:
    """(doc_id, text, places, counts) of every document; both null where nothing repeats. With `small` the texts come `zipped`."""
    rows = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), text_key().alias("key"))
    rows = zipped(rows) if small else rows
    return rows.join(runs, ["id", "key"], "left").select("doc_id", "text", F.col("runs.place").alias("places"), F.col("runs.count").alias("counts"))


def covered(places: list[int] | None, counts: list[int] | None, window: int, n: int) -> np.ndarray:
    """Which of a text's n units lie in a window that starts at one of the runs."""
    edge = np.zeros(n + 1, np.int64)
    if places:
        at = np.array(places)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + np.array(counts) - 1 + window, -1)
    return np.cumsum(edge)[:n] > 0
