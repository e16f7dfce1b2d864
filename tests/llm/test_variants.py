"""Spelling variants against brute force over all words."""

import collections
import random
import re
import zlib

import pytest
from conftest import SF

pytest.importorskip("riskbridge.llm")
from riskbridge.llm import variants  # noqa: E402

FIELDS = ("word", "form", "root", "n", "n_near", "form_n")


def words(rows):
    count = collections.Counter()
    for i, text in rows:
        lower = (text or "").translate(str.maketrans(variants.UPPER, variants.LOWER))
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            at = h % len(run)
            count[run[:at] + run[at + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def edits(w):
    """Patterns of all texts that one edit of w gives, by length and with a hole."""
    return {("hole", w[:i] + "\0" + w[i + 1 :]) for i in range(len(w))}, {w[:i] + w[i + 1 :] for i in range(len(w))}


def brute(rows):
    n = words(rows)
    near = collections.defaultdict(set)
    holes = collections.defaultdict(list)
    for w in n:
        replaced, lost = edits(w)
        for h in replaced:
            holes[h].append(w)
        for x in lost & n.keys():
            near[w].add(x)
            near[x].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= set(group) - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def got(df):
    rows = [tuple(r[f] for f in FIELDS) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_equals_brute_force_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(variants.spelling_variants(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("share", [1e-5, 1e-3, 0.05, 1.0])
def test_any_dictionary_finds_all(spark, share):
    rng = random.Random(7)
    base = ["".join(rng.choice(["an", "en", "ti", "o", "s", "é", "aa"]) for _ in range(rng.randrange(4, 8))) for _ in range(60)]
    text = []
    for w in base:
        text += [w] * rng.choice([1, 3, 40, 500])
        for _ in range(6):
            i = rng.randrange(len(w))
            text += [rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("anoe") + w[i:], w[:i] + rng.choice("anoe") + w[i + 1 :]])] * rng.choice([2, 5, 30])
    rng.shuffle(text)
    rows = [(i, " ".join(text[i::20])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(variants.spelling_variants(docs, share=share)) == brute(rows)


def test_odd_rows(spark):
    data = [(1, None), (2, ""), (3, "1234 ab"), (4, "LETTERS letters lettres"), (4, "LETTERS letters lettres"), (None, "letters Ünlikely ünlikely ÜNLIKELY"), (None, "Ünlikely ünlikely"),
        (6, "x" * 60_000 + " " + "x" * 60_000), (7, "x" * 60_000), (8, "aaaaaaa aaaaaaaa " * 3), (9, "letters " * 400)]
    rows = spark.createDataFrame([(i, t, "w", 1, "k") for i, t in data], "doc_id bigint, text string, word string, n int, `key` string")
    assert got(variants.spelling_variants(rows)) == brute(data)
    assert variants.spelling_variants(rows.filter("false")).count() == 0


def test_chains_of_forms_end_at_the_root(spark):
    text = " ".join(["chainedword"] * 2 + ["chainedwor"] * 30 + ["chainedwo"] * 400 + ["chainedw"] * 6000)
    found = {r.word: r for r in variants.spelling_variants(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()}
    counts = words([(1, text)])
    for w in found:
        assert found[w].n == counts[w]
    assert got(variants.spelling_variants(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))) == brute([(1, text)])
    assert len({r.root for r in found.values()}) == 1
