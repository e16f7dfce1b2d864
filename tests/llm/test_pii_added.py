"""What boosted trees add beside the fixed patterns: hidden forms of known spans, and nothing else."""

import random
import re

from riskbridge.llm import pii


def corpus(plain: bool) -> tuple[list[tuple[int, str]], set[tuple[int, str, int, int]], set[tuple[int, int, int]]]:
    """Texts with a hidden address, a phone without its plus, and decoys; places of the hidden spans and of the decoys."""
    rng = random.Random(9)
    rows, hidden, decoys = [], set(), set()
    for i in range(400):
        text = ""

        def put(piece: str, kind: str | None = None) -> None:
            nonlocal text  # noqa: B023
            text += rng.choice(["talk to ", "see ", "then, "])
            if kind:
                (decoys if kind == "decoy" else hidden).add((i, len(text), len(text) + len(piece)) if kind == "decoy" else (i, kind, len(text), len(text) + len(piece)))  # noqa: B023
            text += piece + rng.choice([" and so on. ", " or not. "])

        number = f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        if plain:
            put(f"user{i}@host{i}.org")
            put(f"+1 {number}")
        put(f"user{i}" + rng.choice([f" (at) host{i} (dot) org", f"(at)host{i}.org"]), "email")
        put(f"1 {number}", "phone")
        put(f"{rng.randint(1, 9)} @ {rng.randint(1, 9)}.50", "decoy")
        put(f"x{rng.randint(10**9, 10**10 - 1)}f", "decoy")
        put(f"{rng.randint(10**9, 10**10 - 1)}", "decoy")
        put(f"2024-{rng.randint(10, 12)}-{rng.randint(10, 28)} {rng.randint(10, 23)}", "decoy")
        rows.append((i, text))
    return rows, hidden, decoys


def added(spark, rows) -> set[tuple[int, str, int, int]]:
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = set()
    for r in pii.personal_data(df).collect():
        spans = [(r.doc_id, k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert spans == sorted(spans, key=lambda s: (s[2], pii.KINDS.index(s[1])))
        fixed = re.compile(r"[\w.]+@[\w-]+(?:\.[\w-]+)+|\+1 \(\d+\) [\d-]+")
        held = {m.span() for m in fixed.finditer(rows[r.doc_id][1])}
        out |= {s for s in spans if (s[2], s[3]) not in held}
    return out


def test_hidden_forms_are_found_and_decoys_left(spark):
    rows, hidden, decoys = corpus(plain=True)
    got = added(spark, rows)
    assert len(got & hidden) >= 0.9 * len(hidden) and len(got & hidden) >= 0.95 * len(got)
    assert not {(i, a, b) for i, _, a, b in got} & decoys


def test_without_known_spans_nothing_is_learnt(spark):
    rows, _, _ = corpus(plain=False)
    assert added(spark, rows) == set()


def test_unknown_vectors_count_only_where_nothing_known_looks_alike():
    base = dict.fromkeys(["kind", *pii.FEATURES], 1)
    rows = [base | dict(fold=0, label=pii.GOOD, n=5), base | dict(fold=1, label=pii.UNKNOWN, n=7), base | dict(fold=0, label=pii.BAD, n=2), base | dict(marks=3, fold=1, label=pii.UNKNOWN, n=4)]
    assert [(r["fold"], r["n"], r["good"]) for r in pii.examples(rows)] == [(0, 7, 5), (1, 4, 0)]
