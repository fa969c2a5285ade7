"""The factorization machine learns pairs and rare terms: no term is selected beforehand."""

import numpy as np
from dealgrid.llm import toxicity


def _learn(spark, texts, toxic):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic)], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.train(docs, labels)).where("held_out").collect()
    assert len(rows) > len(texts) // 8
    return [(r.predicted, int(toxic[r.doc_id])) for r in rows]


def _texts(rng, n):
    return [[f"w{j}" for j in rng.integers(0, 300, 30)] for _ in range(n)]


def test_words_that_matter_only_in_pairs(spark):
    """Toxic exactly when one of two words stands without the other: neither tells anything alone."""
    rng = np.random.default_rng(1)
    texts, has = _texts(rng, 4000), rng.random((4000, 2)) < 0.5
    texts = [" ".join(t + ["left"] * int(a) + ["right"] * int(b)) for t, (a, b) in zip(texts, has)]
    out = _learn(spark, texts, has[:, 0] != has[:, 1])
    assert sum(p == t for p, t in out) >= 0.95 * len(out)


def test_rare_terms(spark):
    rng = np.random.default_rng(2)
    texts, toxic = _texts(rng, 3000), np.zeros(3000, bool)
    for k in range(2):
        for i in rng.choice(3000, 30, replace=False):
            texts[i], toxic[i] = texts[i] + [f"slur{k}"], True
    out = _learn(spark, [" ".join(t) for t in texts], toxic)
    assert sum(t for _, t in out) > 5 and sum(p == t for p, t in out) >= 0.99 * len(out)
    assert sum(p for p, t in out if t) >= 0.8 * sum(t for _, t in out)


def test_null_empty_long_and_repeated_texts(spark):
    long = " ".join(f"x{i}" for i in range(100_000))
    texts = ["bad word"] * 40 + ["good word"] * 40 + ["", None, long, long + " bad"]
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)] + [(None, "bad")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(rows) == len(texts) + 1 and all(0 <= r.score <= 1 for r in rows)
    assert {r.predicted for r in rows if r.doc_id is not None and r.doc_id < 20} == {1}
    assert {r.predicted for r in rows if r.doc_id is not None and 20 <= r.doc_id < 40} == {0}


def test_training_holds_few_copies_of_the_terms(spark):
    """The sample's terms take 4 bytes each on the driver, and passes over them go in pieces."""
    import tracemalloc
    rng, terms = np.random.default_rng(6), 800
    texts = [" ".join(f"w{j}" for j in rng.choice(4000, terms, replace=False)) + (" bad" if i % 4 == 0 else "") for i in range(2500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(2500)], "doc_id long, toxic int")
    tracemalloc.start()
    toxicity.train(docs, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * 2000 * terms
