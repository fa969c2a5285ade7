"""A group of near copies leaves the comparing tasks as rows in proportion to its size."""

import random

import numpy as np
import pyarrow as pa

from dealgrid.llm import jaccard_join


def group(n, seed=1):
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(200)]
    out = []
    for i in range(n):
        at = rng.randrange(188)
        out.append((i, " ".join(base[:at] + [f"n{i}x{j}" for j in range(12)] + base[at + 12:])))
    return out


def components_of(rows):
    sets = [{tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    old, new = max(root[i], root[j]), min(root[i], root[j])
                    root = [new if r == old else r for r in root]
    return root


def test_candidates_grow_with_the_group(spark, monkeypatch):
    real, seen = jaccard_join.written, []

    def counting(df, name):
        out = real(df, name)
        if name == "jaccard-near":
            seen[-1] += out.count()  # rows that leave the comparing tasks
        return out
    monkeypatch.setattr(jaccard_join, "written", counting)
    for n in (150, 300, 600):
        seen.append(0)
        rows = group(n)
        got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        if n < 600:
            assert [got[i] for i in range(n)] == components_of(rows)
    assert seen[2] <= 3 * max(seen[1], 600) and seen[1] <= 3 * max(seen[0], 300), seen


def test_forest_spans_each_group():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 62, 120, dtype=np.uint64))]
    sets += [np.sort(np.concatenate([sets[0][:-6], rng.integers(0, 1 << 62, 6, dtype=np.uint64)])) for _ in range(30)]
    rows = [(g, i, min(i, 3) if g == 8 else i, len(s), -1, jaccard_join.dense_sketch(s)) for g in (7, 8) for i, s in enumerate(sets)]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)],
                                       ["g", "node", "root", "n", "side", "sketch"])
    out = [e for x in jaccard_join._nearest_pairs(80, 100)(iter([batch])) for e in zip(*(c.to_pylist() for c in x.columns))]
    assert sum(g == 7 for g, _, _ in out) == 30 and {x for g, *e in out if g == 7 for x in e} == set(range(31))
    assert sum(g == 8 for g, _, _ in out) == 3  # four components are left to be joined
