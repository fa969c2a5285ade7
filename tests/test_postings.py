"""Posting lists and the bounded top-k against brute force; lists of common terms stay closed."""

import math
import random
import re
from collections import Counter

from dealgrid.operators import postings as po

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(t):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(questions, chunks, k):
    tf = {c: Counter(split(t)) for c, t in chunks}
    df = Counter(x for v in tf.values() for x in v)
    idf = {x: round(1000 * math.log((len(tf) + 1) / (n + 1))) for x, n in df.items()}
    vec = {c: {x: n * idf[x] for x, n in v.items() if idf[x] > 0} for c, v in tf.items()}
    out = set()
    for q, text in questions:
        w = {x: n * idf[x] for x, n in Counter(split(text)).items() if idf.get(x, 0) > 0}
        qn = sum(v * v for v in w.values())
        scored = []
        for c, v in vec.items():
            dot = sum(w[x] * v[x] for x in w if x in v)
            if dot:
                scored.append((-math.floor(dot / (math.sqrt(qn) * math.sqrt(sum(y * y for y in v.values()))) * po.UNIT), c))
        out |= {(q, i + 1, c, -s) for i, (s, c) in enumerate(sorted(scored)[:k])}
    return out


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weight = [1 / (i + 1) for i in range(300)]
    chunks = [(f"c{i:04d}", " ".join(rng.choices(words, weight, k=rng.randint(3, 60)))) for i in range(n)]
    chunks += [(f"d{i:04d}", "common Passage, shared by a third of all chunks") for i in range(n // 2)]
    chunks += [("e1", None), ("e2", ""), ("e3", "... !"), ("e4", "Ünïcode größe 漢字 w1"), ("e5", "w1 " * 3000)]
    questions = [(i, " ".join(rng.choices(words, weight, k=rng.randint(1, 12)))) for i in range(40)]
    return chunks, questions + [(100, None), (101, "unknown terms"), (102, "shared passage w299"), (103, "common"), (104, "größe 漢字")]


def frames(spark, chunks, questions):
    c = spark.createDataFrame([(i, t, "x", 1) for i, t in chunks], "chunk_id string, document string, term string, weight int")
    return c.repartition(6), spark.createDataFrame([(i, t, "y") for i, t in questions], "question_id long, text string, term string")


def test_topk_equals_brute_force(spark):
    chunks, questions = corpus()
    c, q = frames(spark, chunks, questions)
    for k in (1, 5):
        rows = po.topk(q, *po.build_postings(c), k).collect()
        assert {(r.question_id, r["rank"], r.chunk_id, r.score) for r in rows} == brute(questions, chunks, k)


def test_lists_of_common_terms_are_not_read(spark):
    chunks, _ = corpus()
    # "shared" is in a third of all chunks; three chunks hold it beside a rare name.
    chunks += [(f"z{i}", "shared quixotic zephyr") for i in range(5)]
    c, q = frames(spark, chunks, [(1, "shared quixotic zephyr")])
    postings, table = po.build_postings(c)
    terms = po.question_terms(q, table)
    floors = spark.createDataFrame([(1, 0.9)], "question_id long, floor double")
    lead = {r.term for r in po.split_terms(terms, floors).collect() if r.lead}
    assert "shared" not in lead and lead
    hits = po.topk(q, postings, table, 5).collect()
    assert {r.chunk_id for r in hits} == {f"z{i}" for i in range(5)} and all(r.score >= po.UNIT - 2 for r in hits)


def test_no_dense_vectors_and_empty_sides(spark):
    chunks, questions = corpus(50)
    c, q = frames(spark, chunks, questions)
    postings, table = po.build_postings(c)
    assert postings.columns == ["term", "chunk_id", "weight", "norm2"]
    assert po.topk(q.limit(0), postings, table).count() == 0
    none = po.build_postings(c.limit(0))
    assert none[0].count() == 0 == po.topk(q, *none).count()


def test_repeated_ids_are_one_text_over_batches_and_partitions(spark):
    chunks = [("a", "one two"), ("a", "two three"), ("b", "two"), (None, "one"), ("c", None)] + [(f"x{i}", f"word{i} one") for i in range(30)]
    rows = spark.createDataFrame(chunks, "chunk_id string, document string").repartition(9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        lists = po._count_lists(rows, "chunk_id", "document").collect()
        postings, _ = po.build_postings(rows)
        got = {(r.term, r.chunk_id, r.weight) for r in postings.where("chunk_id in ('a', 'b')").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(len(r.terms) == len(set(r.terms)) for r in lists) and {r.id for r in lists} == {c for c, _ in chunks if c}
    idf = {t: round(1000 * math.log(34 / (n + 1))) for t, n in (("one", 31), ("two", 2), ("three", 1))}
    assert got == {("one", "a", idf["one"]), ("two", "a", 2 * idf["two"]), ("three", "a", idf["three"]), ("two", "b", idf["two"])}


def test_a_block_of_chunks_gives_only_the_best_of_each_question(spark, monkeypatch):
    chunks, questions = corpus()
    c, q = frames(spark, chunks, questions)
    monkeypatch.setattr(po, "BLOCK_LISTS", 2000)
    monkeypatch.setattr(po, "BLOCK_QUESTIONS", 60)
    postings, table = po.build_postings(c)
    terms = po.question_terms(q, table)
    split = po.split_terms(terms, spark.createDataFrame([], "question_id long, floor double"))
    blocks = -(-postings.join(terms.select("term").distinct(), "term").count() // 2000)
    found = po._candidates(split, postings, 5).groupBy("question_id").count().collect()
    assert blocks > 2 and found and all(r["count"] <= 5 * blocks for r in found)
    rows = po.topk(q, postings, table, 5).collect()
    assert {(r.question_id, r["rank"], r.chunk_id, r.score) for r in rows} == brute(questions, chunks, 5)
