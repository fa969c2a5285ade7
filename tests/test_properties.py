"""Property-based checks: each example is a whole batch evaluated in one Spark job."""

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dealgrid.functions.core import half_up_ratio, split_words
from dealgrid.operators import ranking as rk
from dealgrid.operators import retrieval as rv

SETTINGS = settings(max_examples=6, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])


@SETTINGS
@given(st.lists(st.tuples(st.integers(-10**9, 10**9), st.integers(1, 10**6)), min_size=1, max_size=300),
       st.integers(0, 4))
def test_half_up_ratio_equals_decimal(spark, pairs, digits):
    df = spark.createDataFrame(pairs, "n long, d long")
    got = [r[0] for r in df.select(half_up_ratio("n", "d", digits)).collect()]
    q = Decimal(1).scaleb(-digits)
    want = [float((Decimal(n) / Decimal(d)).quantize(q, rounding=ROUND_HALF_UP)) for n, d in pairs]
    assert got == want


WORD = st.text(alphabet=st.characters(blacklist_categories=("Cs",), blacklist_characters="\x00"),
               min_size=0, max_size=6)


@SETTINGS
@given(st.lists(st.lists(WORD, max_size=1400), min_size=1, max_size=6))
def test_chunks_cover_random_texts(spark, docs):
    """500-word windows whose neighbours share 50 words and that join back to the text."""
    texts = [" 　".join(ws) if i % 2 else "\n".join(ws) for i, ws in enumerate(docs)]
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)],
                               "doc_id long, source string, text string")
    got = {}
    for r in rv.chunk_documents(df).collect():
        got.setdefault(r["doc_id"], {})[r["chunk_index"]] = r["document"].split(" ")
    for i, t in enumerate(texts):
        words, chunks = t.split(), got.get(i, {})
        assert len(chunks) == (0 if not words else 1 + max(0, -(-(len(words) - 500) // 450)))
        assert sorted(chunks) == list(range(len(chunks)))
        joined = []
        for j in range(len(chunks)):
            assert len(chunks[j]) == 500 or j == len(chunks) - 1
            assert j == 0 or chunks[j][:50] == joined[-50:]
            joined += chunks[j][50 if j else 0:]
        assert joined == words
    words = [r[0] for r in df.orderBy("doc_id").select(split_words("text")).collect()]
    assert words == [t.split() for t in texts]


@SETTINGS
@given(st.lists(st.integers(0, 20), min_size=1, max_size=400))
def test_rank_equals_pandas_first(spark, scores):
    ids = [f"K{i:05d}" for i in range(len(scores))]
    df = spark.createDataFrame(list(zip(ids, [s / 10 for s in scores])), "key string, score double")
    got = {r["key"]: r["rank"] for r in
           rk.global_row_number(df, [F.col("score").desc(), F.col("key").asc()], "rank").collect()}
    pdf = pd.DataFrame({"key": ids, "score": [s / 10 for s in scores]})
    pdf["rank"] = pdf["score"].rank(ascending=False, method="first").astype(int)
    assert got == dict(zip(pdf["key"], pdf["rank"]))


def test_half_up_ratio_of_sums_over_a_trillion_rows(spark):
    n = 10**12
    got = spark.sql(f"SELECT {n} * 2000 AS s, {n} * 10000 AS t, {n} AS n").select(
        *[half_up_ratio("s", "t", d).alias(f"r{d}") for d in (0, 1, 3, 4, 6)], half_up_ratio("s", "n", 1, scale=100).alias("p")).first()
    assert tuple(got) == (0.0, 0.2, 0.2, 0.2, 0.2, 200000.0)
