"""Operators 11 to 13 against brute force, with nulls, empty and very long texts, ties, repeated
rows, empty tables and clashing column names."""

import hashlib
import itertools
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken

from conftest import ROOT
from dealgrid.llm import byte_bpe, filter_audit, registry, whitening

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# --- 11: whitening ---------------------------------------------------------------------------

def dense(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, dtype=float)).astype(np.int64) + 100000
    y = x - x.mean(axis=0)
    e, q = np.linalg.eigh(y.T @ y / len(x))
    total = [int(v) for v in x.sum(axis=0)]
    deviation = [sum((len(x) * int(a) - b) ** 2 for a, b in zip(r, total)) for r in x]
    return e[::-1][:k], (y @ q[:, ::-1][:, :k]) / np.sqrt(e[::-1][:k]), deviation, e.sum()


def check_whitened(df, vectors, k=8):
    rows = df.toPandas().sort_values(["vec_id", "component"])
    e, expected, deviation, trace = dense(vectors, k)
    got = rows.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    sign = np.sign((got * expected).sum(axis=0))
    assert np.abs(got * sign - expected).max() < 1e-8
    first = rows[rows.component == 1]
    assert first.deviation.tolist() == deviation and set(rows.n) == {len(vectors)}
    assert np.allclose(rows[rows.vec_id == rows.vec_id.min()].explained, e / trace, rtol=1e-9)
    assert rows.identity_error.nunique() == 1 and rows.identity_error.max() < 1e-9


@pytest.mark.parametrize("block", [5, 8])
def test_whitening_equals_dense_eigenvectors(spark, block):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").limit(200).cache()
    vectors = [r.embedding for r in e.orderBy("vec_id").collect()]
    check_whitened(whitening.whiten(e, block=block), vectors)


def test_whitening_leaves_out_nulls_and_ignores_other_columns(spark):
    rng = np.random.default_rng(3)
    good = (rng.standard_normal((60, 10)) * np.arange(1, 11)).tolist()
    bad = [None, [None] + good[0][1:], [float("nan")] + good[0][1:], [float("inf")] * 10]
    rows = [(i, v, "x") for i, v in enumerate(good + bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string")
    check_whitened(whitening.whiten(df.repartition(7)), good)
    check_whitened(whitening.whiten(df, block=1), good)
    nulls = spark.createDataFrame([(None, v) for v in good], "vec_id long, embedding array<double>")
    assert whitening.whiten(nulls).count() == 60 * 8


def test_whitening_repeated_eigenvalues_and_lack_of_rank(spark):
    cross = np.vstack([np.eye(12) * 3, -np.eye(12) * 3]).tolist()
    df = spark.createDataFrame(list(enumerate(cross)), "vec_id long, embedding array<double>")
    rows = whitening.whiten(df).toPandas()
    assert len(rows) == 24 * 8 and rows.identity_error.max() < 1e-9
    flat = [[float(a), float(b), 1.0] for a, b in itertools.product(range(4), range(4))]
    df = spark.createDataFrame(list(enumerate(flat)), "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(df).select("component").distinct().collect()} == {1, 2}
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).count() == 0 == whitening.whiten(same.limit(0)).count()


def test_whitening_uneven_and_wide_vectors(spark):
    short = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0]), (3, [])], "vec_id long, embedding array<double>")
    check_whitened(whitening.whiten(short), [[1.0, 2.0], [3.0, 0.0], [0.0, 0.0]], 2)
    wide = spark.createDataFrame([(1, [2.0 ** 30]), (2, [0.0])], "vec_id long, embedding array<double>")
    assert [r.deviation for r in whitening.whiten(wide).collect()] == [None, None]


# --- 12: filter interaction audit ------------------------------------------------------------

def brute_audit(docs, labels):
    good = {i for i, q, t in labels if q == 1 and i is not None}
    toxic = {i for i, q, t in labels if t == 1 and i is not None}
    fails = []
    for doc_id, text, source in docs:
        text = text or ""
        words = [w for w in "".join(c if c not in "\t\n\x0b\x0c\r" else " " for c in text).split(" ") if w]
        own = set()
        if len(words) < 200:
            own.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            own.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text):
            own.add("C")
        if any(c in "#$%&*|" for c in text):
            own.add("D")
        if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in docs):
            own.add("E")
        fails.append((source or "", doc_id, own))
    out = {}
    for part in {s for s, _, _ in fails}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = [(i, own) for s, i, own in fails if s == part]
            every = left
            for step, f in enumerate(order):
                gone = [(i, own) for i, own in left if f in own]
                stay = [(i, own) for i, own in left if f not in own]
                shapley[f] += len(gone)
                out[part, "".join(order), step + 1] = [
                    len(stay), len(gone), sum(f in own for _, own in every) - len(gone), sum(own == {f} for _, own in every),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                left = stay
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def test_audit_equals_brute_force(spark):
    rng = random.Random(5)
    long = " ".join(f"w{i}" for i in range(230))
    texts = [None, "", "same text", "SHOUT", "a # b", long, long + " #", long.upper(), "x " * 400, "x\x1cy z " * 300, long * 30]
    docs = [(rng.choice([i, i, 7, None]), rng.choice(texts), rng.choice(["s1", "s2", None, ""])) for i in range(120)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    d = spark.createDataFrame([(*r, "z", 1) for r in docs], "doc_id long, text string, source string, part string, bits int").repartition(5)
    rows = filter_audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}
    assert len(rows) == len(got) and got == brute_audit(docs, labels)


def test_audit_of_an_empty_table(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string")
    assert filter_audit.audit(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# --- 13: byte-level BPE ----------------------------------------------------------------------

@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.load_ranks(RANKS)


@pytest.fixture(scope="module")
def encoding(vocabulary):
    ranks = {t: i for i, t in enumerate(vocabulary.tokens)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def some_texts():
    rng = random.Random(9)
    mixed = ["a", "b", "é", " ", "\n", "漢", "字", "の", "1", "2", "!", "-", " ", "　", "'s", "'ll", "😀", "ß", "Ω", "\x85", "\t", "e", "t", "h"]
    out = [None, "", "", " ", "a" * 5000, "-" * 777, " " * 1000, "ab" * 3000 + "c", "漢字" * 2000, "<|endoftext|> x", "I'll we've 's"]
    out.append("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60000)))
    out += ["".join(rng.choice(mixed) for _ in range(rng.randint(1, 80))) for _ in range(800)]
    return out + ["".join(chr(rng.choice([rng.randint(1, 0x17f), rng.randint(0x370, 0x52f), rng.randint(0x3041, 0x9fff)])) for _ in range(30)) for _ in range(200)]


@pytest.mark.parametrize("block", [1, 500, byte_bpe.BLOCK_PIECES])
def test_bpe_equals_tiktoken_and_decodes(spark, vocabulary, encoding, block):
    texts = some_texts() if block > 1 else some_texts()[:200]
    d = spark.createDataFrame(pa.table({"doc_id": list(range(len(texts))), "text": texts, "ids": ["x"] * len(texts)})).repartition(3)
    rows = byte_bpe.decode(byte_bpe.encode(d, vocabulary, public_tokenizers.PATTERN, block_pieces=block), vocabulary).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        assert list(r.ids) == encoding.encode_ordinary(text) and bytes(r.decoded) == text.encode()


def test_bpe_report_is_the_digest_of_both(spark, vocabulary, encoding):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in registry.op13_byte_bpe(spark, SF).collect()}
    for d in docs.collect():
        ids = encoding.encode_ordinary(d.text or "")
        r = rows[d.doc_id]
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_bpe_edges(spark, vocabulary):
    d = spark.createDataFrame([(None, "the the"), (1, None), (1, "the the"), (1, "the the")], "doc_id long, text string")
    rows = byte_bpe.encode(d, vocabulary, public_tokenizers.PATTERN).collect()
    assert sorted(len(r.ids) for r in rows) == [0, 2, 2, 2] and sum(r.doc_id is None for r in rows) == 1
    assert byte_bpe.encode(d.limit(0), vocabulary, public_tokenizers.PATTERN).count() == 0
    odd = spark.createDataFrame([(1, [70, -1, 10 ** 6, None, 71]), (2, []), (3, None)], "k long, ids array<int>")
    out = {r.k: r.decoded for r in byte_bpe.decode(odd, vocabulary).collect()}
    assert bytes(out[1]) == vocabulary.tokens[70] + vocabulary.tokens[71] and bytes(out[2]) == b"" and out[3] is None


def test_bpe_refuses_ranks_out_of_order():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"abc": 299}
    with pytest.raises(ValueError):
        byte_bpe.Vocabulary(ranks)


# --- all three travel with the job -----------------------------------------------------------

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from dealgrid.session import get_session
from dealgrid.llm import registry
spark = get_session("local[2]", shuffle_partitions=2)
for q in (registry.op11_embedding_whitening, registry.op12_filter_audit, registry.op13_byte_bpe):
    assert q(spark, sys.argv[2]).count() > 0
print("shipped")
"""


def test_runs_from_another_folder(tmp_path):
    import os
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT, ROOT, SF], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0 and "shipped" in out.stdout, out.stderr[-2000:]


@pytest.mark.parametrize("share", [1, 3, 1 << 16])
def test_line_dedup_without_room_for_a_broadcast(spark, monkeypatch, share):
    """Frequent keys beyond the broadcast bound: hot ones are broadcast, the rest is shuffled; same rows."""
    from dealgrid.llm import line_dedup
    hot = "a line that a third of all the documents hold, word for word"
    rows = [(i, "\n".join(([hot] if i % 3 == 0 else []) + [f"line {i % 11} that some of the documents hold, word for word",
                                                            f"own line {i} of this document that nobody else has at all"])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(tuple(r) for r in line_dedup.line_dedup_report(docs, batches=3).collect())
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(line_dedup, "HOT_SHARE", share)
    assert sorted(tuple(r) for r in line_dedup.line_dedup_report(docs, batches=3).collect()) == want
    assert sum(r[2] for r in want) == 39 + 120 - 11
