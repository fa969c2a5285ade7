"""Inverted file of cells: all rows indexed, recall against the exact top-k, hot cells, edges."""

import numpy as np
import pytest

from dealgrid.operators import ivf, retrieval as rv

SF = "/root/testdata/sf0.001"
SCHEMA = "chunk_id long, embedding array<double>"


def vectors(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def grouped(n=900, groups=12, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    at = rng.standard_normal((groups, dim)) * 4
    return [(i, (at[i % groups] + rng.standard_normal(dim)).tolist()) for i in range(n)]


def as_questions(df):
    return df.withColumnRenamed("chunk_id", "question_id")


def test_recall_of_registered_query(spark):
    from __spark_entry__ import queries
    row = queries()["topk_cosine_ivf_recall"](spark, SF).first()
    assert row.recall_reached and row.indexed_rows == 500 and row.questions == 25 and row.wanted == 125


def test_grouped_vectors_need_few_probes(spark, tmp_path):
    c = vectors(spark, grouped())
    centres = ivf.fit_centres(c, cells=12)
    index = ivf.build_index(c, centres, str(tmp_path / "i"))
    probes = ivf.probes_for(index, centres)
    assert index.count() == 900 and probes <= 4
    q = as_questions(c.where("chunk_id % 20 = 0"))
    hits, exact = ivf.search(q, index, centres, 5, probes, exclude_self=True), rv.topk_cosine(q, c, 5, exclude_self=True)
    assert ivf.recall(hits, exact).first().recall >= 0.9


def test_all_cells_equal_the_exact_search_also_when_cells_are_cut(spark, tmp_path, monkeypatch):
    rows = grouped(300) + [(1000 + i, [1.0] * 16) for i in range(150)]  # a hot cell of equal vectors
    c = vectors(spark, rows).repartition(5)
    centres = ivf.fit_centres(c, cells=6)
    index = ivf.build_index(c, centres, str(tmp_path / "i"))
    monkeypatch.setattr(ivf, "PART_ROWS", 40)
    got = ivf.search(as_questions(c), index, centres, 3, len(centres), exclude_self=True)
    want = rv.topk_cosine(as_questions(c), c, 3, exclude_self=True)
    key = lambda r: (r.question_id, r.rank, r.chunk_id, round(r.similarity, 9))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_rows_that_cannot_be_compared_and_empty_tables(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (2, [1.0, 0.1]), (None, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0])]
    c = vectors(spark, rows)
    centres = ivf.fit_centres(c)
    index = ivf.build_index(c, centres, str(tmp_path / "i"))
    assert sorted(r._id for r in index.collect()) == [1, 2, 2]
    hits = ivf.search(as_questions(c), index, centres, 5, 9).collect()
    assert {(r.question_id, r.chunk_id) for r in hits} == {(a, b) for a in (1, 2) for b in (1, 2)}
    none = c.limit(0)
    assert ivf.fit_centres(none).size == 0
    assert ivf.search(as_questions(none), index, centres, 5, 2).count() == 0


def test_other_lengths_fail(spark, tmp_path):
    centres = ivf.fit_centres(vectors(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])]))
    with pytest.raises(Exception):
        ivf.assign(vectors(spark, [(1, [1.0, 0.0, 2.0])]), centres).count()


def test_index_is_written_by_cell(spark, tmp_path):
    c = vectors(spark, grouped(200))
    index = ivf.build_index(c, ivf.fit_centres(c, cells=5), str(tmp_path / "i"))
    plan = index.where("cell = 2")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan
