"""The registered vector queries ask every vector of the table, whatever its id."""

import os

import numpy as np
import pytest
from conftest import SF_SMALL
from oracle_check import compare, duck_conn, duck_rows, spark_rows

IDS = [20 * i + i % 3 for i in range(70)]  # two of three are not divisible by 20


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The small tables, with embeddings of 70 vectors and one without an id."""
    top = tmp_path_factory.mktemp("vectors")
    for t in os.listdir(SF_SMALL):
        if t != "embeddings.parquet":
            os.symlink(f"{SF_SMALL}/{t}", top / t)
    rows = [(i, x.tolist(), i % 7) for i, x in zip(IDS, vectors())] + [(None, [1.0] * 6, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1) \
        .write.parquet(str(top / "made"))
    part = next(f for f in os.listdir(top / "made") if f.endswith(".parquet"))
    os.symlink(top / "made" / part, top / "embeddings.parquet")
    return str(top)


def vectors():
    return np.random.default_rng(4).normal(size=(len(IDS), 6))


def nearest():
    """id -> (id, similarity) of the five nearest others, best first, by brute force."""
    unit = vectors() / np.linalg.norm(vectors(), axis=1, keepdims=True)
    sims = unit @ unit.T - 9 * np.eye(len(IDS))
    return {i: [(IDS[j], sims[n][j]) for j in np.argsort(-sims[n])[:5]] for n, i in enumerate(IDS)}


def result(spark, folder, name):
    from __spark_entry__ import queries
    return queries()[name](spark, folder)


def differs_from_sql(df, folder, name):
    from __spark_entry__ import oracle_sql
    return compare(*spark_rows(df), *duck_rows(duck_conn(folder), oracle_sql()[name]))


def test_topk_cosine_asks_every_vector(spark, folder):
    df = result(spark, folder, "topk_cosine")
    got = {}
    for r in df.orderBy("rank").collect():
        got.setdefault(r["question_id"], []).append(r["chunk_id"])
    assert got == {i: [c for c, _ in near] for i, near in nearest().items()}
    assert differs_from_sql(df, folder, "topk_cosine") is None


def test_retrieval_sources_of_every_vector(spark, folder):
    df = result(spark, folder, "retrieval_sources")
    assert {r["question_id"]: r["sources"] for r in df.collect()} == {
        i: sorted({str(c % 7) for c, _ in near}) for i, near in nearest().items()}
    assert differs_from_sql(df, folder, "retrieval_sources") is None


def prompts(floor):
    """id -> context text of its neighbours of at least that similarity, and the question."""
    return {i: "Context:\n" + "\n\n---\n\n".join(f"[Source: {c % 7}]\nvector {c}" for c, s in near if s >= floor)
            + f"\n\nQuestion: neighbours of {i}" for i, near in nearest().items()}


def test_context_assembly_of_every_vector(spark, folder):
    df = result(spark, folder, "context_assembly_vectors")
    assert {r["question_id"]: r["prompt"] for r in df.collect()} == prompts(-1)
    assert differs_from_sql(df, folder, "context_assembly_vectors") is None


def test_context_supported_of_every_vector(spark, folder):
    df = result(spark, folder, "context_supported_vectors")
    assert {r["question_id"]: r["prompt"] for r in df.collect()} == {**prompts(0.35), None: None}
    assert differs_from_sql(df, folder, "context_supported_vectors") is None


def test_block_pair_equals_brute_force_on_odd_vectors():
    """Repeated ids, equal vectors, zero vectors and vectors with gaps, in more rows than one group of maxima has."""
    import pyarrow as pa

    from dealgrid.operators import retrieval as rv
    rng = np.random.default_rng(8)
    schema = pa.schema([("_qid", pa.int64()), ("_cid", pa.int64()), ("_sim", pa.float64())])
    for odd in (False, True):
        c, q = rng.normal(size=(3000, 4)), rng.normal(size=(40, 4))
        c[rng.integers(0, 3000, 400)] = c[7]
        q[0] = c[7]
        if odd:
            c[5], c[6, 1], q[3] = 0, np.nan, 0
        cid = rng.integers(0, 1500, 3000)
        want = []
        with np.errstate(invalid="ignore"):
            sims = np.round((q @ c.T) / np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)), 12)
        for i in range(40):
            best = {}
            for j in np.flatnonzero((cid != i) & np.isfinite(sims[i])):
                best[cid[j]] = max(best.get(cid[j], -2), sims[i, j])
            want += [(i, x, s) for x, s in sorted(best.items(), key=lambda b: (-b[1], b[0]))[:5]]
        vectors_of = lambda v: pa.array(v.tolist(), pa.list_(pa.float64()))
        got = rv._block_pair(5, True, schema)((pa.scalar(4),), pa.table({"_qid": np.arange(40), "_vec": vectors_of(q)}),
                                              pa.table({"_cid": cid, "_vec": vectors_of(c)})).to_pydict()
        assert list(zip(got["_qid"], got["_cid"])) == [w[:2] for w in want]
        assert np.allclose(got["_sim"], [w[2] for w in want], atol=1e-11)
