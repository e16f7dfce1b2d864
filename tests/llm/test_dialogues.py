"""Repair of conversations against a search over all edits from the end, and round trips."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest
from conftest import SF

pytest.importorskip("riskbridge.llm")
from riskbridge.llm import dialogues  # noqa: E402

FIELDS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """(cost, audit, lines) by trying all edits; rows are (role, text, fault)."""

    @cache
    def best(i, state, inserts):
        ways = []
        if i == len(rows) and state in ("", "a"):
            ways.append((0, "", ()))
        if inserts:
            for role in ("user", "assistant"):
                if (state, role[0]) in NEXT:
                    c, a, x = best(i, NEXT[state, role[0]], inserts - 1)
                    ways.append((c + 2, "I" + a, (f"{role}:", *x)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, a, x = best(i + 1, state, 3)
            ways.append((c + 3, "D" + a, x))
            if fault not in ("blank", "duplicate"):
                for edit, to in (("K", role), ("R", "user"), ("R", "assistant")):
                    if (state, to[:1]) in NEXT:
                        c, a, x = best(i + 1, NEXT[state, to[:1]], 3)
                        ways.append((c + (edit == "R") * 2 + (fault == "truncated"), edit + a, (f"{to}:{text}", *x)))
        return min(ways, default=(10**9, "", ()))

    return best(0, "", 3)


def brute(data):
    out = []
    key = lambda c: " " if c is None else str(c)
    for conv in {r[0] for r in data}:
        rows = []
        for _, turn, role, text in (r for r in data if r[0] == conv):
            role, text = (" " if v is None else v for v in (role, text))
            kind = zlib.crc32(f"{key(conv)}:{key(turn)}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faulty = set(), []
        for _, role, text in rows:
            solid = re.findall(r"[^\x20\x09-\x0d]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = {t for t, _, _ in rows if t is not None}
        cost, audit, lines = cheapest(tuple(faulty))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        count = [sum(f == x for _, _, f in faulty) for x in ("blank", "duplicate", "truncated")]
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[f] for f in FIELDS) for r in df.collect()), key=str)


def corpus(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "Bot", None])
            text = rng.choice(["Yes.", "No", f"line {t}.", f"line {t}", " \t", "", None, "Why?  ", "ü!"])
            rows.append((c, rng.choice([t, t, t + 3, None, 2]), role, text))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_equals_brute_force_on_the_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert got(dialogues.repaired_digests(df)) == brute([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])


@pytest.mark.parametrize("pack", [1 << 16, 3])
def test_equals_brute_force_on_odd_conversations(spark, monkeypatch, pack):
    monkeypatch.setattr(dialogues, "PACK", pack)
    rows = corpus(3, 400, 9) + [(None, 1, "user", "Who?"), (None, None, None, None), (None, 2, "assistant", "Me.")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(dialogues.repaired_digests(df)) == brute(rows)


def test_search_equals_brute_force():
    rng = random.Random(1)
    names = {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}
    steps = dialogues.Steps()
    for _ in range(3000):
        rows = tuple((rng.choice(["user", "assistant", "system", "x", ""]), "t", rng.choice(["", "", "truncated", "blank", "duplicate"])) for _ in range(rng.randrange(14)))
        search = dialogues.Search(steps)
        for role, text, fault in rows:
            search.add(None, role, text, names[fault])
        cost, audit, lines = cheapest(rows)
        assert search.result()[5:] == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    assert len(steps.steps) < 20_000  # few states, however long the conversations


def test_giant_conversation_streams(spark):
    n = 200_000
    df = spark.range(n).selectExpr("7L AS conv_id", "id AS turn", "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('line ', id, '.') AS text")
    (row,) = dialogues.repaired_digests(df).collect()
    assert len(row.audit.replace("I", "")) > 0.9 * n and row.blank > 0 and row.duplicate > 0


def test_rows_hash_to_the_digest(spark):
    rows = corpus(5, 60, 9) + [(None, 1, "user", "Who?"), (None, 2, "assistant", "Me.")]
    damaged = dialogues.damaged(spark.createDataFrame(rows, SCHEMA))
    lines = {}
    for r in sorted(dialogues.repaired_rows(damaged).collect(), key=lambda r: r.place):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in dialogues.repairs(damaged).collect():
        assert hashlib.sha256("\n".join(lines.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256


def test_odd_tables(spark):
    extra = [(1, 0, "user", "Hi.", "n", 1, True), (2, None, None, None, "n", 2, False), (3, 5, "user", "x" * 300_000 + " " * 300_000, "n", 3, None)]
    df = spark.createDataFrame(extra, SCHEMA + ", name string, fault int, gone boolean")
    assert got(dialogues.repaired_digests(df)) == brute([r[:4] for r in extra])
    assert dialogues.repaired_digests(df.filter("false")).count() == 0
    text = spark.createDataFrame([("a", 1, "user", "Hi."), ("a", 2, "assistant", "Ho.")], "conv_id string, turn int, role string, text string")
    assert got(dialogues.repaired_digests(text)) == brute([("a", 1, "user", "Hi."), ("a", 2, "assistant", "Ho.")])
