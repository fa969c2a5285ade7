"""Sparse text retrieval: posting lists with exact integer weights and a bounded top-k.

A term is a run of ASCII letters and digits and of characters beyond ASCII, A-Z as a-z.  Its
weight in a text is its count times an integer idf, round(1000 ln((n + 1) / (df + 1))) over n
chunks, df of them with the term; a text is the sparse vector of its weights, and scores are
cosines, kept as whole billionths.  Everything is counted in integers, so the same texts give
the same scores in any engine and under any partitioning.

The search never opens the posting list of a term that cannot matter.  A term's share of a
score is at most its weight in the question times its largest share of any chunk, which the term
table holds.  The rarest terms of a question give k first candidates, whose k-th full score is
a floor: terms whose bounds add up to less than the floor cannot bring a chunk into the top k
alone, so only the others' lists are read at first; candidates whose partial score plus that sum
stays below the floor go too, and the rest is completed.  This is done block by block of chunks, and
only the k best of each block leave it.  The result is exact.
"""

from __future__ import annotations

import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from dealgrid.schemas import TOP_K
from dealgrid.session import scratch_path
from dealgrid.sources.files import write_parquet

# Worker functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A-Z as a-z; ASCII that is neither letter nor digit as a space.
BYTES = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
BLOCK_POSTINGS = 1 << 19
# Rows of question terms and of postings that meet in one task of a search.
BLOCK_QUESTIONS = 1 << 16
BLOCK_LISTS = 1 << 20
FIRST_TERMS = 2
MARGIN = 1e-9  # against rounding in sums of bounds
UNIT = 1_000_000_000


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    write_parquet(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _lists(flat: pa.Array, lengths: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))), pa.int32()), flat)


def _count_texts(batches):
    """(id, terms, counts): the terms of the texts of one id in a batch.  On UTF-8 bytes a term is
    a run of ASCII letters and digits and of bytes beyond ASCII."""
    for batch in batches:
        of: dict = {}
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = of.get(key)
            if found is None:
                found = of[key] = Counter()
            if text:
                found.update(text.translate(BYTES).split())
        found = of.values()
        flat = pa.array([t for c in found for t in c], pa.binary()).cast(pa.string())
        lengths = [len(c) for c in found]
        counts = pa.array([n for c in found for n in c.values()], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(of), batch.column(0).type), _lists(flat, lengths), _lists(counts, lengths)], ["id", "terms", "counts"])


def _count_lists(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, terms, counts) of texts with an id; an id of several batches has several rows."""
    schema = T.StructType([T.StructField("id", texts.schema[id_col].dataType), T.StructField("terms", T.ArrayType(T.StringType())),
                           T.StructField("counts", T.ArrayType(T.LongType()))])
    rows = texts.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_count_texts, schema)


def _counts(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    pairs = _count_lists(texts, id_col, text_col).select("id", F.explode(F.arrays_zip("terms", "counts")).alias("p"))
    return pairs.groupBy("id", F.col("p.terms").alias("term")).agg(F.sum("p.counts").alias("tf"))


def _block_counts(rows: pa.Table):
    """(ids, id code, terms, term code, tf) of one block's count lists, ordered by id code: every
    id has all its rows in one block, repeated ones are added up."""
    rows = rows.combine_chunks()
    ids, lists, counts = (rows[c].chunk(0) if rows.num_rows else rows[c].combine_chunks() for c in ("id", "terms", "counts"))
    ids, own = ids.dictionary_encode(), lists.flatten().dictionary_encode()
    row_id = ids.indices.to_numpy().astype(np.int64)
    at = np.repeat(row_id, lists.value_lengths().to_numpy())
    term, tf = own.indices.to_numpy().astype(np.int64), counts.flatten().to_numpy()
    if len(ids.dictionary) < len(row_id):
        width = max(1, len(own.dictionary))
        pair, inverse = np.unique(at * width + term, return_inverse=True)
        summed = np.zeros(len(pair), np.int64)
        np.add.at(summed, inverse, tf)
        at, term, tf = pair // width, pair % width, summed
    return ids.dictionary, at, own.dictionary, term, tf


def _block_terms(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    _, _, names, term, _ = _block_counts(rows)
    return pa.table({"block": pa.array(np.full(len(names), key[0].as_py()), pa.int32()), "term": names,
                     "df": pa.array(np.bincount(term, minlength=len(names)), pa.int64())})


def _block_postings(schema: pa.Schema):
    def run(key, rows: pa.Table, idfs: pa.Table) -> pa.Table:
        ids, at, names, term, tf = _block_counts(rows)
        idfs = idfs.combine_chunks()
        place = pc.index_in(names, value_set=idfs["term"].combine_chunks())
        idf = np.asarray(idfs["idf"].combine_chunks().take(place).fill_null(0)).astype(np.int64)[term]
        at, term, weight = at[idf > 0], term[idf > 0], (tf * idf)[idf > 0]
        if not len(at):
            return schema.empty_table()
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        norm2 = np.repeat(np.add.reduceat(weight * weight, first), np.diff(np.append(first, len(at))))
        return pa.Table.from_arrays([names.take(pa.array(term)), ids.take(pa.array(at)), pa.array(weight), pa.array(norm2)],
                                    names=schema.names).cast(schema)
    return run


def build_postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "document") -> tuple[DataFrame, DataFrame]:
    """(postings, term table), both written.

    postings: term, chunk_id, weight, norm2 (the chunk's sum of squared weights); weights of 0
    (terms of every chunk) are left out.  Term table: term, df, idf, top (largest weight over
    norm of any chunk).  Chunks without an id are left out, null and empty texts have no
    postings but count for n; chunk ids should be unique: repeated ones count as one text.

    Terms are counted once per text and kept as one row per text.  The rows are dealt into
    blocks of about BLOCK_POSTINGS postings by their id; only a block's distinct terms are
    shuffled to be counted over all blocks and to fetch their idf, not the postings.
    """
    lists = _written(_count_lists(chunks, id_col, text_col), "postings-counts")
    n = lists.agg(F.countDistinct("id")).scalar()
    blocks = lists.agg(F.expr(f"cast(greatest(1, ceil(coalesce(sum(size(terms)), 0) / {BLOCK_POSTINGS})) as int)")).scalar()
    lists = lists.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    block_terms = _written(lists.groupBy("block").applyInArrow(_block_terms, "block int, term string, df long"), "postings-block-terms")
    df = _written(block_terms.groupBy("term").agg(F.sum("df").alias("df")).withColumn(
        "idf", F.round(1000 * F.log((n + 1) / (F.col("df") + 1))).cast("long")).where("idf > 0"), "postings-df")
    idfs = block_terms.select("block", "term").join(df.select("term", "idf"), "term")
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("chunk_id", chunks.schema[id_col].dataType),
                           T.StructField("weight", T.LongType()), T.StructField("norm2", T.LongType())])
    postings = _written(lists.groupBy("block").cogroup(idfs.groupBy("block")).applyInArrow(
        _block_postings(to_arrow_schema(schema)), schema), "postings")
    top = postings.groupBy("term").agg(F.max(F.col("weight") / F.sqrt(F.col("norm2").cast("double"))).alias("top"))
    return postings, _written(df.join(top, "term"), "postings-terms")


def _score(dot: Column, q_norm2: Column, c_norm2: Column) -> Column:
    return dot.cast("double") / (F.sqrt(q_norm2.cast("double")) * F.sqrt(c_norm2.cast("double")))


def question_terms(questions: DataFrame, term_table: DataFrame, id_col: str = "question_id", text_col: str = "text") -> DataFrame:
    """(question_id, term, q_weight, q_norm2, df, bound): terms that the corpus has."""
    q = _written(_counts(questions, id_col, text_col), "topk-counts").join(term_table, "term").select(
        F.col("id").alias("question_id"), "term", (F.col("tf") * F.col("idf")).alias("q_weight"), "df", "top")
    q = q.withColumn("q_norm2", F.sum(F.col("q_weight") * F.col("q_weight")).over(Window.partitionBy("question_id")))
    return q.withColumn("bound", F.col("q_weight") * F.col("top") / F.sqrt(F.col("q_norm2").cast("double"))).drop("top")


def _partial(q: DataFrame, postings: DataFrame) -> DataFrame:
    """(question_id, chunk_id, dot, q_norm2, norm2) over the given terms' lists."""
    return q.join(postings, "term").groupBy("question_id", "chunk_id").agg(
        F.sum(F.col("q_weight") * F.col("weight")).alias("dot"), F.first("q_norm2").alias("q_norm2"), F.first("norm2").alias("norm2"))


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("question_id").orderBy(F.col("score").desc(), F.col("chunk_id").asc())
    return scored.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def split_terms(q: DataFrame, floors: DataFrame) -> DataFrame:
    """``q`` with the question's floor, ``rest`` (bounds of the terms that cannot matter alone)
    and ``lead`` (whether the term's list must be read)."""
    up = Window.partitionBy("question_id").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    q = q.join(floors, "question_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    q = q.withColumn("lead", F.sum("bound").over(up) + MARGIN >= F.col("floor"))
    return q.withColumn("rest", F.coalesce(F.sum(F.when(~F.col("lead"), F.col("bound"))).over(Window.partitionBy("question_id")), F.lit(0.0)))


def _block_best(k: int, schema: pa.Schema):
    """The k best chunks of a block for each question of a block, with their dot products.  The
    lead terms' lists give partial scores; the k-th best of them is a floor like the
    question's own, as full scores are at least the partial ones.  The other lists are read
    only where a chunk can still reach the floor."""
    def run(key, q: pa.Table, lists: pa.Table) -> pa.Table:
        if not q.num_rows or not lists.num_rows:
            return schema.empty_table()
        q, lists = q.combine_chunks(), lists.combine_chunks()
        q = q.take(pc.sort_indices(q, [("question_id", "ascending")]))
        code = q["question_id"].combine_chunks().dictionary_encode().indices.to_numpy()
        begin = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        end = np.append(begin[1:], len(code))
        one = q.take(pa.array(begin))
        qn, floor, rest = (one[c].to_numpy() for c in ("q_norm2", "floor", "rest"))
        names, lead, q_weight = q["term"].combine_chunks().dictionary_encode(), q["lead"].to_numpy(), q["q_weight"].to_numpy()
        q_term = names.indices.to_numpy()
        found = pc.index_in(lists["term"].combine_chunks(), value_set=names.dictionary).fill_null(len(names.dictionary)).to_numpy()
        order = np.argsort(found, kind="stable")
        starts = np.searchsorted(found[order], np.arange(len(names.dictionary) + 1))
        chunks = lists["chunk_id"].combine_chunks().dictionary_encode()
        chunk, weight = chunks.indices.to_numpy()[order], lists["weight"].to_numpy()[order]
        cn = np.zeros(len(chunks.dictionary), np.int64)
        cn[chunk] = lists["norm2"].to_numpy()[order]
        place = np.empty(len(cn), np.int64)
        place[pc.sort_indices(chunks.dictionary).to_numpy()] = np.arange(len(cn))
        root, out = np.sqrt(cn.astype(np.float64)), []
        for i in range(len(begin)):
            dot, mine = np.zeros(len(cn), np.int64), np.arange(begin[i], end[i])

            def add(rows):
                for t, w in zip(q_term[rows], q_weight[rows]):  # a term's list holds a chunk once
                    dot[chunk[starts[t]:starts[t + 1]]] += w * weight[starts[t]:starts[t + 1]]

            def scores(hit):
                return dot[hit] / (np.sqrt(float(qn[i])) * root[hit])

            add(mine[lead[mine]])
            hit = np.flatnonzero(dot)
            score = scores(hit)
            least = max(floor[i], np.partition(score, len(hit) - k)[len(hit) - k]) if len(hit) >= k else floor[i]
            hit = hit[score + rest[i] + MARGIN >= least]
            if len(hit):
                add(mine[~lead[mine]])
                hit = hit[np.lexsort((place[hit], -np.floor(scores(hit) * UNIT)))[:k]]
            out.append((np.full(len(hit), i), hit, dot[hit]))
        i, hit, dot = (np.concatenate(x) for x in zip(*out))
        return pa.Table.from_arrays([one["question_id"].take(pa.array(i)), chunks.dictionary.take(pa.array(hit)), pa.array(dot),
                                     pa.array(qn[i]), pa.array(cn[hit])], names=schema.names).cast(schema)
    return run


def _candidates(split: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """(question_id, chunk_id, dot, q_norm2, norm2): the k best chunks of each question in each
    block.  Questions and their terms' lists are cut into blocks of bounded rows; a chunk's
    postings are in one block, and each pair of blocks meets in one task."""
    def blocks(rows: DataFrame, most: int):
        return rows.agg(F.expr(f"cast(greatest(1, ceil(count(*) / {most})) as int)")).scalar()

    names = _written(split.select("term").distinct(), "topk-asked")
    nq, nc = blocks(split, BLOCK_QUESTIONS), blocks(postings.select("term").join(names, "term", "left_semi"), BLOCK_LISTS)
    q = (split.select("question_id", "term", "q_weight", "q_norm2", "floor", "rest", "lead")
         .withColumn("_i", F.pmod(F.xxhash64("question_id"), nq).cast("int"))
         .withColumn("_j", F.explode(F.sequence(F.lit(0), nc - 1))))
    lists = (postings.join(names, "term", "left_semi").withColumn("_j", F.pmod(F.xxhash64("chunk_id"), nc).cast("int"))
             .withColumn("_i", F.explode(F.sequence(F.lit(0), nq - 1))))
    types = {"question_id": split.schema["question_id"].dataType, "chunk_id": postings.schema["chunk_id"].dataType}
    schema = T.StructType([T.StructField(c, types.get(c, T.LongType())) for c in ("question_id", "chunk_id", "dot", "q_norm2", "norm2")])
    return q.groupBy("_i", "_j").cogroup(lists.groupBy("_i", "_j")).applyInArrow(_block_best(k, to_arrow_schema(schema)), schema)


def topk(questions: DataFrame, postings: DataFrame, term_table: DataFrame, k: int = TOP_K, id_col: str = "question_id",
         text_col: str = "text") -> DataFrame:
    """(question_id, rank, chunk_id, score): the k best chunks of each question, score in whole
    billionths of a cosine, ties by chunk id.  A question without a term of the corpus has no
    row; chunks that share no term with it are no hits."""
    q = _written(question_terms(questions, term_table, id_col, text_col), "topk-terms")
    rare = Window.partitionBy("question_id").orderBy("df", "term")
    # The questions' side of every join with the postings is written: where it is small, the postings are not shuffled.
    seeds = _written(q.withColumn("i", F.row_number().over(rare)).where(F.col("i") <= FIRST_TERMS).drop("i"), "topk-seeds")
    first = _best(_partial(seeds, postings).withColumn("score", _score(F.col("dot"), F.col("q_norm2"), F.col("norm2"))), k)
    first = _written(q.join(_written(first.select("question_id", "chunk_id"), "topk-first"), "question_id"), "topk-first-terms")
    full = first.join(postings, ["chunk_id", "term"]).groupBy("question_id", "chunk_id").agg(
        F.sum(F.col("q_weight") * F.col("weight")).alias("dot"), F.first("q_norm2").alias("q_norm2"), F.first("norm2").alias("norm2"))
    floors = full.withColumn("score", _score(F.col("dot"), F.col("q_norm2"), F.col("norm2"))).groupBy("question_id").agg(
        F.when(F.count("*") >= k, F.min("score")).otherwise(0.0).alias("floor"))
    split = _written(split_terms(q, floors), "topk-split")
    scored = _candidates(split, postings, k)
    scored = scored.withColumn("score", F.floor(_score(F.col("dot"), F.col("q_norm2"), F.col("norm2")) * UNIT).cast("long"))
    return _best(scored, k).select("question_id", "rank", "chunk_id", "score")
