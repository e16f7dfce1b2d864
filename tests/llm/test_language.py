"""Code lengths of the fast model against prediction by partial matching as the textbook has it; what a model learns from."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from riskbridge.llm import language_id


def plain_costs(training: dict[str, list[str]], text: str) -> list[float]:
    def symbols(t: str) -> list[int]:
        return language_id.coded(np.frombuffer(t.encode(), np.uint8)).tolist()

    out = []
    for name in sorted(training):
        seen: dict[tuple, Counter] = defaultdict(Counter)
        for t in training[name]:
            s = [0, 0, 0, *symbols(t)]
            for i in range(3, len(s)):
                for k in range(4):
                    seen[tuple(s[i - k : i])][s[i]] += 1

        def chances(context: tuple | None, seen: dict[tuple, Counter] = seen) -> list[float]:
            if context is None:
                return [1 / language_id.ALPHABET] * language_id.ALPHABET
            lower = chances(context[1:] if context else None)
            if context not in seen:
                return lower
            n = seen[context]
            total, kinds = sum(n.values()), len(n)
            left = sum(p for x, p in enumerate(lower) if x not in n)
            return [n[x] / (total + kinds) if x in n else kinds / (total + kinds) * lower[x] / left for x in range(language_id.ALPHABET)]

        s = [0, 0, 0, *symbols(text)]
        out.append(sum(-np.log(chances(tuple(s[i - 3 : i]))[s[i]]) for i in range(3, len(s))))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_costs_equal_plain_matching(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcéñÜ xy.9") for _ in range(rng.randint(0, 30)))
    training = {name: [word() for _ in range(6)] for name in ("p", "q", "r")}
    model = language_id.fit(training, contexts_kept=1 << 40, least=1)
    texts = [word() for _ in range(12)]
    assert np.allclose(model.costs(pa.array(texts)), [plain_costs(training, t) for t in texts], rtol=1e-4)


def test_small_language_keeps_its_contexts():
    rng = random.Random(1)
    prose = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    small = "qjxkw zvqjx " * 6
    model = language_id.fit({"big": [prose("abcdefghijklmnop", 20_000)], "small": [small]}, contexts_kept=200)
    code = language_id.coded(np.frombuffer(small.encode(), np.uint8))
    states = model.state[language_id.contexts(code, np.array([0]))[3:]]
    bounds = 1 + np.unique(code).size + 16  # states of contexts of two and three symbols come after those of one
    assert (states >= bounds).mean() > 0.9


def test_learns_from_the_end_of_texts_and_from_null_ids(spark):
    rows = [(None, "der die und ist " * 40, "de"), (None, "der die und ist " * 40, "de"), (None, "the of and is " * 40, "en")]
    df = spark.createDataFrame([*rows, (2, "der ist die und", None), (5, "the is of and", None)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.language_of(df).collect() if r.doc_id}
    assert got == {2: "de", 5: "en"}
    texts = language_id.sampled(df.filter("lang is not null"), 300)
    assert {k: len(v) for k, v in texts.items()} == {"de": 1, "en": 1}
    late = spark.createDataFrame([(1, "a" * 30_000 + "zq" * 20, "x")], "doc_id bigint, text string, lang string")
    assert language_id.sampled(late, 5)["x"][0].endswith("zqzq")
