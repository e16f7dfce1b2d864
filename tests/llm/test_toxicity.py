"""Toxicity: what the labels of whole texts teach, wherever the insult stands."""

import random

import pytest

pytest.importorskip("riskbridge.llm")
from riskbridge.llm import toxicity  # noqa: E402


def test_late_insults_are_learned_and_found(spark):
    rng = random.Random(8)
    clean = [f"w{''.join(rng.choice('abcdefghij') for _ in range(5))}" for _ in range(300)]
    insults = ["you utter idiot", "shut up moron", "stupid worthless fool"]
    docs, labels = [], []
    for i in range(300):
        text = [rng.choice(clean) for _ in range(800)]
        if i % 3 == 0:
            text[750:750] = rng.choice(insults).split()
        docs.append((i, " ".join(text)))
        labels.append((i, int(i % 3 == 0)))
    df, lab = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = [r for r in toxicity.toxicity(df, lab).collect() if r.held_out]
    bad = [r.predicted for r in got if r.doc_id % 3 == 0]
    fine = [r.predicted for r in got if r.doc_id % 3]
    assert len(bad) >= 15 and sum(bad) >= 0.9 * len(bad) and sum(fine) <= 0.05 * len(fine)


def test_labels_of_other_documents_take_no_place(spark):
    docs = [(i, "you idiot" if i % 2 else "a fine day") for i in range(200)]
    labels = [(i, int(i % 2 == 1)) for i in range(200)] + [(i, i % 2) for i in range(10_000, 14_000)]
    df, lab = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    texts, toxic = toxicity.sampled(df, lab, 30)
    assert len(texts) == 120 and sum(toxic) == 30


def test_without_a_model_nothing_is_toxic(spark):
    df = spark.createDataFrame([(1, "some text"), (2, None), (3, "")], "doc_id bigint, text string")
    got = toxicity.toxicity(df, spark.createDataFrame([], "doc_id bigint, toxic int")).collect()
    assert {(r.score, r.predicted) for r in got} == {(0.0, 0)}
