"""Global ranking, rule scores and score ranking.

Scores of four places are ranked by counting (``counting_rank``, one lazy plan).  Ranks in
any other order, or of rows that are dear to compute, are taken without an un-partitioned
window too: rows are range partitioned on the full ordering key (score, id) -- a hot score value is split
across partitions because the id breaks it up -- sorted within partitions and
numbered there; the numbered frame is checkpointed to the shared folder so the
numbers are fixed, and per-partition row counts (one row per partition) give
each partition's offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealgrid.schemas import (BASE_WIN_RATE, COMPANY_SIZE_MULTIPLIERS, CONVERSION_CAP,
                              INDUSTRY_MULTIPLIERS, N_OVERPERFORMERS, OVERPERFORMER_WIN_MULTIPLIER,
                              PEAK_MONTHS, SLOW_MONTHS, SOURCE_CONVERSION_RATES,
                              STALE_CONTACT_DAYS, STALE_CONTACT_MULTIPLIER, WIN_CAP)
from dealgrid.session import scratch_path, shared_dir

_LOW_BITS = (1 << 33) - 1


def global_row_number(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Add a 1-based position in ``order`` (must be a total order, e.g. end with an id)."""
    spark = df.sparkSession
    shared_dir(spark)  # checkpoint folder: the configured one, or a scratch one in tests
    numbered = (df.repartitionByRange(*order).sortWithinPartitions(*order)
                .withColumn("_pos", F.monotonically_increasing_id())
                .checkpoint(eager=True))
    part = F.shiftright(F.col("_pos"), 33)
    counts = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: bounded by the partition count, safe to broadcast
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    out = numbered.join(F.broadcast(offsets), part == offsets._part)
    return out.withColumn(name, (F.col("_off") + F.col("_pos").bitwiseAND(F.lit(_LOW_BITS)) + 1)
                          .cast("long")).drop("_pos", "_part", "_off")


BOUND_EVERY = 1 << 20  # one id in so many is a bound of an id range
_STEPS = [1 << k for k in range(20, -1, -1)]


def with_id_ranges(df: DataFrame, score: str, id_col: str, every: int = BOUND_EVERY) -> DataFrame:
    """Adds ``__s``, the score with null as minus infinity, and ``__g``, a number that grows with
    the id inside a score and cuts a hot score into ranges of about ``every`` rows.

    The bounds are the rows whose id's hash is divisible by ``every``: a millionth of the rows, in
    one sorted array in which every row finds its place by halving (2^21 bounds at most are used)."""
    at = F.struct(F.col(score).alias("s"), F.col(id_col).alias("i"))
    bounds = df.where(F.pmod(F.xxhash64(id_col), F.lit(every)) == 0).agg(F.array_sort(F.collect_set(at))).scalar()
    place = F.aggregate(F.array(*[F.lit(k) for k in _STEPS]), F.lit(0),
                        lambda pos, k: F.when(F.get(F.col("__bounds"), pos + k - 1) < at, pos + k).otherwise(pos))
    # never null: the join on it adds no filter that would evaluate the search a second time
    return df.withColumn("__bounds", bounds).withColumn("__g", F.coalesce(place, F.lit(0))).drop("__bounds").withColumn(
        "__s", F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))))


def counting_rank(df: DataFrame, score: str, id_col: str, name: str = "rank", every: int = BOUND_EVERY) -> DataFrame:
    """Add the 1-based position by ``score`` descending, then ``id_col`` (unique): nothing runs
    and nothing is written while the plan is built.

    Rows are counted per (score, id range) and numbered inside; the running sum of the counts
    is each group's offset.  ``score`` has few distinct values (4 places: 10,001), so the
    offsets are a small table, one row per group.  The input is evaluated three times (bounds,
    counts, rows): write it first if it is dear.  Null scores come last, null ids first within
    their score."""
    placed = with_id_ranges(df, score, id_col, every)
    groups = placed.groupBy("__s", "__g").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(F.col("__s").desc(), F.col("__g")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("__s", "__g", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = F.row_number().over(Window.partitionBy("__s", "__g").orderBy(id_col))
    return placed.withColumn("__pos", inside).join(offsets, ["__s", "__g"]).withColumn(
        name, (F.col("__off") + F.col("__pos")).cast("long")).drop("__s", "__g", "__pos", "__off")


def dense_codes(df: DataFrame, col: str, name: str) -> DataFrame:
    """(value, code): 0-based position of each distinct non-NULL value in sorted order."""
    vals = df.select(F.col(col).alias("value")).where(F.col("value").isNotNull()).distinct()
    ranked = global_row_number(vals, [F.col("value").asc()], "_r")
    return ranked.select("value", (F.col("_r") - 1).cast("int").alias(name))


def dense_codes_many(df: DataFrame, cols: list[str], name: str) -> dict[str, DataFrame]:
    """``dense_codes`` of several columns of one type from a single pass: the
    distinct (column, value) pairs are ranked once (one distributed rank, one
    checkpoint) and each column's codes restart at 0 (its first rank is
    subtracted; one row per column).  The codes are written, so that a join with
    them is planned from their size."""
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("_col"), F.col(c).alias("value")) for c in cols])).alias("_p")) \
        .select("_p._col", "_p.value").where(F.col("value").isNotNull()).distinct()
    ranked = global_row_number(pairs, [F.col("_col").asc(), F.col("value").asc()], "_r")
    first = ranked.groupBy("_col").agg(F.min("_r").alias("_first"))
    codes = ranked.join(F.broadcast(first), "_col").select(
        "_col", "value", (F.col("_r") - F.col("_first")).cast("int").alias(name))
    path = scratch_path(df.sparkSession, "codes")
    codes.write.parquet(path)
    codes = df.sparkSession.read.schema(codes.schema).parquet(path)
    return {c: codes.where(F.col("_col") == c).select("value", name) for c in cols}


# ---------------------------------------------------------------------------
# Rule scores (exact decimal arithmetic, rounded to 4 places)
# ---------------------------------------------------------------------------

def _dec(v: float) -> Column:
    """An exact decimal literal of a rule constant (via its shortest text form)."""
    return F.lit(repr(float(v))).cast("decimal(3,2)")


def _lookup(col: str, mapping: dict[str, float]) -> Column:
    out = None
    for key, val in mapping.items():
        cond = F.col(col) == key
        out = F.when(cond, _dec(val)) if out is None else out.when(cond, _dec(val))
    return out


def lead_rule_score(source: str = "source", company_size: str = "company_size",
                    industry: str = "industry", month: Column | None = None) -> Column:
    """Conversion probability rule: base(source) * mult(size) * mult(industry)
    * season(month), capped, rounded to 4 places; NULL for values outside the domains."""
    m = month if month is not None else F.month("created_at")
    p = _lookup(source, SOURCE_CONVERSION_RATES) * _lookup(company_size, COMPANY_SIZE_MULTIPLIERS) \
        * _lookup(industry, INDUSTRY_MULTIPLIERS)
    season = None
    for mon, mult in {**SLOW_MONTHS, **PEAK_MONTHS}.items():
        season = (F.when(m == mon, _dec(mult)) if season is None
                  else season.when(m == mon, _dec(mult)))
    p = p * season.otherwise(_dec(1.0))
    return F.round(F.least(p, _dec(CONVERSION_CAP)), 4).cast("double")


def overperformer_reps(reps: DataFrame) -> DataFrame:
    """The first reps in natural id order (at most N rows: safe to broadcast)."""
    return (reps.select("rep_id").orderBy(F.length("rep_id"), "rep_id").limit(N_OVERPERFORMERS)
            .withColumn("_over", F.lit(True)))


def deal_rule_risk(days_stale: Column, overperformer: Column) -> Column:
    """1 - win probability: base win rate, times the stale penalty when the gap
    to the last contact exceeds the limit, times the over-performer multiplier
    (capped); rounded to 4 places."""
    p = F.when(days_stale > STALE_CONTACT_DAYS,
               _dec(BASE_WIN_RATE) * _dec(STALE_CONTACT_MULTIPLIER)).otherwise(_dec(BASE_WIN_RATE))
    p = F.when(overperformer, F.least(p * _dec(OVERPERFORMER_WIN_MULTIPLIER), _dec(WIN_CAP))) \
        .otherwise(p)
    return F.round(F.lit(1).cast("decimal(3,2)") - p, 4).cast("double")


def with_overperformer(deals: DataFrame, reps: DataFrame) -> DataFrame:
    over = overperformer_reps(reps)
    j = deals.join(F.broadcast(over.withColumnRenamed("rep_id", "_rid")),
                   deals.rep_id == F.col("_rid"), "left")
    return j.withColumn("_over", F.coalesce("_over", F.lit(False))).drop("_rid")


def _restrict(df: DataFrame, id_col: str, ids: DataFrame | None) -> DataFrame:
    """Keep rows whose id is in ``ids`` (a one-column frame); error when none match."""
    if ids is None:
        return df
    keys = ids.select(F.col(ids.columns[0]).alias("_id")).distinct()
    out = df.join(keys, df[id_col] == keys._id, "left_semi")
    if out.limit(1).count() == 0:
        raise ValueError(f"No matching rows found for provided {id_col}s.")
    return out


def score_leads(leads: DataFrame, lead_ids: DataFrame | None = None) -> DataFrame:
    """(lead_id, score, rank): rule score of every (or every listed) lead, rank 1 =
    highest score, ties by lead_id."""
    scored = _restrict(leads, "lead_id", lead_ids).select(
        "lead_id", lead_rule_score().alias("score"))
    return counting_rank(scored, "score", "lead_id", "rank")


def deal_risk_scores(deals: DataFrame, reps: DataFrame,
                     deal_ids: DataFrame | None = None) -> DataFrame:
    """(deal_id, risk_score) for closed deals (or the listed ones), unranked."""
    closed = deals.where(F.col("outcome") != "open")
    closed = _restrict(closed, "deal_id", deal_ids)
    d = with_overperformer(closed, reps)
    stale = F.datediff("close_date", "last_contact_date")
    return d.select("deal_id", deal_rule_risk(stale, F.col("_over")).alias("risk_score"))


def score_deals(deals: DataFrame, reps: DataFrame, deal_ids: DataFrame | None = None) -> DataFrame:
    """(deal_id, risk_score, risk_rank) for closed deals (or the listed ones)."""
    scored = deal_risk_scores(deals, reps, deal_ids)
    return counting_rank(scored, "risk_score", "deal_id", "risk_rank")


def score_open_deals(open_features: DataFrame, deals: DataFrame, reps: DataFrame) -> DataFrame:
    """(deal_id, risk_score) of open deals; silence is measured against the
    dataset's latest contact date (``days_since_last_contact`` of the features)."""
    d = with_overperformer(deals.where(F.col("outcome") == "open").select("deal_id", "rep_id"), reps)
    j = open_features.select("deal_id", "days_since_last_contact").join(
        d.select("deal_id", "_over"), "deal_id")
    return j.select("deal_id", deal_rule_risk(F.col("days_since_last_contact"), F.col("_over"))
                    .alias("risk_score"))


def top_n(scored: DataFrame, score: str, id_col: str, rank: str, n: int = 10) -> DataFrame:
    """The n rows of highest score (ties by id) with their rank: every task keeps its n
    best, and only those n rows are numbered."""
    order = [F.col(score).desc(), F.col(id_col).asc()]
    top = scored.orderBy(*order).limit(n)
    return top.withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("long"))


