"""HyperMinHash near duplicates against all pairs compared by brute force."""

import random
import re

import numpy as np
import pytest

pytest.importorskip("riskbridge.llm")
from pyspark.sql import functions as F  # noqa: E402

from riskbridge.llm import hyperminhash  # noqa: E402
from riskbridge.llm.hyperminhash import near_dedup, near_duplicates  # noqa: E402


def shingles(text, k=2):
    lower = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
    w = re.findall(rb"[^\x20\x09-\x0d]+", lower)
    return {tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, min(len(w), 1)))}


def brute(docs: dict[int, str], k=2) -> dict[int, tuple]:
    sets = {i: shingles(t, k) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in docs}


def corpus(seed: int) -> dict[int, str]:
    """Pairs around the limit, a chain, a crowd of copies of one text, and crowds just under the limit."""
    rng = random.Random(seed)
    text = lambda n, of=5000: [f"w{rng.randrange(of)}" for _ in range(n)]
    out = []
    for k in range(80):
        a = text(rng.choice([5, 12, 60, 150]))
        b = list(a)
        for at in rng.sample(range(len(a)), min(len(a) - 1, k % 8)):
            b[at] = "edit"
        out += [a, b]
    chain = text(100)
    for _ in range(15):
        chain = [*chain[5:], *text(5)]
        out.append(chain)
    for size, edits in ((60, 3), (150, 9), (150, 14), (20, 2)):
        base = text(size)
        for _ in range(40):
            b = list(base)
            for at in rng.sample(range(size), rng.randrange(edits + 1)):
                b[at] = f"x{rng.randrange(100_000)}"
            out.append(b)
    out += [["of", "the", *text(4)] for _ in range(40)] + [["one", "two"], ["One", "Two"], ["one"], [], [], ["one"]]
    rng.shuffle(out)
    return {i: " ".join(w) for i, w in enumerate(out)}


@pytest.mark.parametrize("few, seed", [(8, 5), (2, 6)])
def test_equals_all_pairs(spark, monkeypatch, few, seed):
    monkeypatch.setattr(hyperminhash, "FEW", few)
    monkeypatch.setattr(hyperminhash, "BLOCK", 7)
    docs = corpus(seed)
    rows = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(rows).collect()}
    assert got == brute(docs)


def test_odd_rows(spark):
    long = "word " + " ".join(f"v{i}" for i in range(40_000))
    data = [(1, None), (2, ""), (3, " \t\n"), (4, "A b c"), (None, "a B c"), (5, "a b c"), (5, "a b c"), (6, long), (7, long + " end"), (8, "ä b"), (8, "unlike it")]
    rows = spark.createDataFrame([(i, t, 1, "m", "k", 2.0) for i, t in data], "doc_id bigint, text string, n int, mark string, key string, component_id double")
    got = sorted(map(tuple, near_duplicates(rows).collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 2, 4, True), (None, 2, 4, False), (5, 2, 4, False), (5, 2, 4, False),
        (6, 40_000, 6, True), (7, 40_001, 6, False), (8, 1, 8, True), (8, 1, 8, True)], key=str)
    kept = near_dedup(rows)
    assert kept.columns == rows.columns
    assert sorted((r.doc_id, r.text) for r in kept.select("doc_id", F.substring("text", 1, 9).alias("text")).collect() if r.text) == [(3, " \t\n"), (4, "A b c"), (6, "word v0 v"), (8, "unlike it"), (8, "ä b")]
    assert near_duplicates(rows.filter("false")).count() == 0 and near_dedup(rows.filter("false")).count() == 0


def test_one_of_repeated_rows_stays(spark):
    rows = spark.createDataFrame([(5, "a b c", "x"), (5, "a b c", "y"), (5, "a b c", "y"), (9, "a b c", "z")], "doc_id bigint, text string, lang string")
    assert near_dedup(rows).count() == 1


def test_estimate_is_near_the_similarity(spark):
    rng = np.random.default_rng(3)
    pool = np.unique(rng.integers(0, 1 << 63, 4000, np.uint64) << np.uint64(1))
    for share in (0.5, 0.8, 0.95):
        equal = []
        for _ in range(40):
            s = rng.permutation(pool)[:1000]
            extra = int(1000 * (1 - share) / 2)
            a, b = np.sort(s[extra:]), np.sort(s[: 1000 - extra])
            r = hyperminhash.registers([a, b])
            equal.append((r[0] == r[1]).mean())
        assert abs(np.mean(equal) - share) < 0.02


def test_registers_hold_zeros_and_mantissa():
    h = np.array([(3 << 57) | (0b0001_1010_1100_11 << 43)], np.uint64)
    assert hyperminhash.registers([h])[0, 3] == (3 << 10) | 0b1010110011
    assert (hyperminhash.registers([h])[0] == hyperminhash.registers([h])[0, 3]).all()  # borrowed everywhere
