"""Partitions of the input change no result; the new queries are registered."""

import random

import __spark_entry__ as entry
from wiretide.llm import toxicity


def test_partitions_change_no_score(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("klmnopqr") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, say(rng.randint(10, 60)) + (" vile scum" if i % 5 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").cache()
    labels = spark.createDataFrame([(i, 1) for i in range(0, 300, 10)], "doc_id long, toxic int")
    fit = toxicity.Fit(epochs=4, batch=32)
    first, *others = (sorted(map(tuple, toxicity.score(docs, toxicity.model(docs.repartition(n), labels, fit)).collect())) for n in (1, 3, 7))
    assert len({s for _, s in first}) > 10 and all(x == first for x in others)


def test_queries_of_the_new_operators_are_registered():
    known = entry.queries()
    assert {"op11_token_alignment", "op12_secret_scan", "op13_hard_negatives"} <= set(known) and len([k for k in known if k.startswith("op")]) == 13
