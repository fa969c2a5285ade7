"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 9).

Each document draws an exponential key with its quality weight as the rate.  A source whose
target is ``e`` times its size and a rest takes every document ``e`` times (complete epochs)
and then, in the order of the keys, documents up to the rest: a weighted sample without
replacement.  The draw is a hash of the doc_id and a seed, so reruns agree.

The order inside a source is never sorted as a whole: word counts are summed per slice of
the key's distribution (a source of any size has at most ``SLICES`` sums), and only the
slice that holds the end of the budget is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dealgrid.llm.common import text_only, written

SLICES = 4096
CAP = 3
CYCLE = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Words of a text, as runs of characters other than blanks (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cycle: tuple = CYCLE, cap: int = CAP) -> DataFrame:
    """(source, source_size, weight, target) from (source, size) rows.

    Sources are numbered by code point, null last, and weigh ``cycle`` in turn.  Targets share
    the sum of all sizes by weight, at most ``cap`` times a source's own size; what is cut
    off goes to the others by weight until none is above.  In order of cap over weight the
    capped sources come first, so the level is found by running sums (one row per source).
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), F.pmod(F.col("number") - 1, F.lit(len(cycle))).cast("int") + 1)
    per = per.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))).withColumn("weight", w)
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "number")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    per = (per.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
           .withColumn("cut", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap)
           .withColumn("rest", F.sum("weight").over(after))
           .withColumn("level", (F.col("total") - F.col("cut")) / F.col("rest")))
    # The level of the first source that stays below its cap holds for all after it.
    free = F.col("level") * F.col("weight") <= F.col("source_size") * cap
    level = F.min(F.when(free, F.struct("rank", "level"))).over(Window.partitionBy())
    per = per.withColumn("rank", F.row_number().over(order)).withColumn("at", level)
    return per.select("source", "source_size", "weight", F.when(
        F.col("at").isNull() | (F.col("rank") < F.col("at.rank")), (F.col("source_size") * cap).cast("double"))
        .otherwise(F.col("at.level") * F.col("weight")).alias("target"))


def exponential_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u from a hash of the id (the same in any engine that has md5)."""
    digits = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def mix(docs: DataFrame, weights: DataFrame | None = None, seed: int = 17, cycle: tuple = CYCLE, cap: int = CAP) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken.

    ``docs`` has doc_id, text, source; ``weights`` (doc_id, weight > 0), at most one row
    a document, default 1.  taken is the number of the document's words in the mix, repeats
    counted: size times the complete epochs, once more if it is in the weighted sample.  The
    document at the end of the budget is taken if that comes nearer to the target.

    A null text has size 0.  A null source is a source of its own.  Repeated rows and rows
    with a null doc_id draw the same key and are ordered by size and text hash; full ties are
    taken one after another.  Empty tables give no rows; extra columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    if weights is not None:
        rows = rows.join(weights.select(F.col("doc_id").cast("long").alias("doc_id"), "weight"), "doc_id", "left")
    else:
        rows = rows.withColumn("weight", F.lit(None).cast("double"))
    key = exponential_key(F.col("doc_id"), F.coalesce("weight", F.lit(1.0)), seed)
    rows = rows.withColumn("key", key).withColumn(
        "slice", F.least(F.lit(SLICES - 1), F.floor((1 - F.exp(-F.col("key"))) * SLICES)).cast("int")).drop("weight")
    rows = written(rows, "mix-rows")
    targets = source_targets(rows.select("source", "size"), cycle, cap)
    plan = targets.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.least(
        F.lit(cap), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long").alias("epochs"))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    # Running sums over the slices of a source: at most SLICES rows each.
    sums = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("slice_size").over(upto), F.lit(0)))
    slices = written(sums.join(plan, sums["source"].eqNullSafe(plan["source"])).select(
        sums["source"].alias("s_source"), F.col("slice").alias("s_slice"), "slice_size", "before", "source_size", "target", "epochs", "rest"),
        "mix-slices")
    # Every document meets its slice's row: a hot source is spread over SLICES keys.
    out = rows.join(slices, rows["source"].eqNullSafe(slices["s_source"]) & (rows["slice"] == slices["s_slice"]))
    whole = F.col("before") + F.col("slice_size") <= F.col("rest")
    none = F.col("before") >= F.col("rest")
    sure = out.where(whole | none).withColumn("more", F.when(whole & (F.col("size") > 0), 1).otherwise(0))
    inside = (Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size", "tie")
              .rowsBetween(Window.unboundedPreceding, -1))
    edge = out.where(~(whole | none)).withColumn("from", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    edge = edge.withColumn("more", F.when(F.col("from") + F.col("size") / 2 <= F.col("rest"), 1).otherwise(0)).drop("from")
    return sure.unionByName(edge).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + F.col("more"))).alias("taken"))


def label_weights(labels: DataFrame, good: float = 2.0, bad: float = 0.5) -> DataFrame:
    """Quality weights of labelled documents (the best label of each counts)."""
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("q")).select(
        "doc_id", F.when(F.col("q") > 0, F.lit(good)).otherwise(F.lit(bad)).alias("weight"))
