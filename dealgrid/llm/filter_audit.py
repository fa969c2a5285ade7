"""How filters interact: what each removes in every order (operator 12).

Four filters look at a document alone, the fifth (E) at the whole table: it fails a document
whose text some smaller doc_id has too.  E is an existential self-join: a left-semi join on
the text's hash, the exact text and a smaller doc_id.  Only texts whose hash two doc_ids share
enter it, and of equal texts only the smallest doc_id stands on the other side, so a group of
copies costs one row per copy, never a pair of copies.

The ids that fail any filter are brought together in one union and aggregated to bit
combinations: at most 2^5 a part.  Whatever the order of the filters, what a step keeps,
removes or would have removed depends on those counts alone; no document is read again.
"""

from __future__ import annotations

import hashlib
import sys
from itertools import permutations

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from dealgrid.llm.common import small_side, written

# The functions of this module travel with the job: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_SYMBOLS = b"#$%&*|"


def _bits(raw: bytes) -> int:
    """Bits of the filters A to D that a text fails (words: runs of other bytes than the six
    ASCII blanks, which is what bytes.split cuts at)."""
    words = raw.split()
    bits = BIT["A"] if len(words) < 200 else 0
    if 100 * len(set(words)) < 50 * len(words):
        bits |= BIT["B"]
    points = len(raw.decode("utf-8", "replace"))
    if 100 * len(raw.translate(None, _NOT_UPPER)) > 2 * points:
        bits |= BIT["C"]
    return bits | BIT["D"] if len(raw.translate(None, _SYMBOLS)) < len(raw) else bits


def _examine(batches):
    for batch in batches:
        texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
             pa.array([_bits(t) for t in texts], pa.int32())], ["doc_id", "part", "hash", "bits"])


def failures(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ledger, repeats): a row per input row with doc_id, part, hash and the bits of A to D;
    and the (doc_id, part, hash) that fail E, once or more.  Both are written tables."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ledger = written(rows.mapInArrow(_examine, "doc_id long, part string, hash binary, bits int"), "audit-ledger")
    # Hashes that two doc_ids share; only their texts are compared.
    shared = written(ledger.where("doc_id is not null").groupBy("hash").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
                     .where("low < high").select("hash"), "audit-shared")
    hashed = rows.where("doc_id is not null").withColumn("hash", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    twins = written(hashed.join(small_side(shared, 48), "hash", "left_semi"), "audit-twins")
    first = written(twins.groupBy("hash", "text").agg(F.min("doc_id").alias("least")), "audit-first")
    other = first.select(F.col("hash").alias("h"), F.col("text").alias("t"), "least")
    repeats = twins.join(other, (F.col("hash") == F.col("h")) & (F.col("text") == F.col("t")) & (F.col("least") < F.col("doc_id")),
                         "left_semi").select("doc_id", "part", "hash")
    return ledger, written(repeats, "audit-repeats")


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits, good, toxic, docs): documents of each part by the filters that they fail and
    their labels."""
    ledger, repeats = failures(docs)
    both = ledger.withColumn("docs", F.lit(1).cast("long")).unionByName(
        repeats.withColumns({"bits": F.lit(BIT["E"]), "docs": F.lit(0).cast("long")}))
    each = both.groupBy("doc_id", "part", "hash").agg(F.bit_or("bits").alias("bits"), F.sum("docs").alias("docs"))
    flags = written(labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")).where("good or toxic"), "audit-labels")
    each = written(each, "audit-bits")
    flagged = each.join(small_side(flags, 24), F.col("doc_id") == F.col("id"), "left")
    return flagged.groupBy("part", "bits", F.coalesce("good", F.lit(False)).alias("good"),
                           F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.sum("docs").alias("docs"))


def _total(when: Column) -> Column:
    return F.coalesce(F.sum(F.when(when, F.col("docs"))), F.lit(0)).cast("long")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley.

    ``docs`` has doc_id, text, source; ``labels`` doc_id, quality, toxic.  Rows are counted as
    they come, also repeated ones; a row is no copy of one with the same doc_id.  Rows with a
    null doc_id never fail E, are no other row's smaller id and have no labels.  A null text is
    empty; a null source is the part "".  Of several labels of a document any counts.  An empty
    table gives no rows; extra columns are ignored.
    """
    counts = written(combinations(docs, labels), "audit-counts")  # parts x 2^5 x 4 rows at most
    # A step depends on the set of filters before it, not on their order: 5 x 2^4 cases.
    cases = [(before, f) for f in FILTERS for before in range(1 << len(FILTERS)) if not before & BIT[f]]
    case = F.array(*[F.struct(F.lit(b).alias("before"), F.lit(BIT[f]).alias("own")) for b, f in cases])
    rows = counts.select("part", "bits", "good", "toxic", "docs", F.inline(case))
    fails = F.col("bits").bitwiseAND(F.col("own")) != 0
    earlier = F.col("bits").bitwiseAND(F.col("before")) != 0
    gone = fails & ~earlier
    # Of all orders, the share where the filter comes before the others that a document fails.
    orders = len(list(permutations(FILTERS)))
    turns = F.expr(f"docs * {orders} div greatest(bit_count(bits), 1)")
    measured = rows.groupBy("part", "before", "own").agg(
        _total(~fails & ~earlier).alias("kept"), _total(gone).alias("removed"), _total(fails & earlier).alias("redundant"),
        _total(F.col("bits") == F.col("own")).alias("unique_fails"), _total(gone & F.col("good")).alias("good_lost"),
        _total(gone & F.col("toxic")).alias("toxic_lost"), F.coalesce(F.sum(F.when(fails, turns)), F.lit(0)).cast("long").alias("shapley"))
    of: dict[int, list[str]] = {}  # a case and the orders that come to it
    for order in map("".join, permutations(FILTERS)):
        for i, f in enumerate(order):
            of.setdefault(sum(BIT[x] for x in order[:i]) * 32 + BIT[f], []).append(order)
    named = F.create_map(*[F.lit(x) for case, names in of.items() for x in (case, " ".join(names))])
    orders_of = F.explode(F.split(F.element_at(named, F.col("before") * 32 + F.col("own")), " "))
    return measured.select("part", orders_of.alias("filter_order"), (F.bit_count("before") + 1).cast("int").alias("step"),
                           "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
