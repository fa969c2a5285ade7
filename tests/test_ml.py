"""Models: planted silence signal is learnt; exact AUC equals a brute-force count."""

import itertools

from pyspark.sql import functions as F

from dealgrid.operators import ml


def test_exact_auc_matches_pairs(spark):
    rows = [(0.1, 0), (0.4, 1), (0.4, 0), (0.35, 1), (0.8, 1), (0.2, 0), (0.8, 0)]
    df = spark.createDataFrame(rows, "score double, label int")
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    wins = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    assert ml.auc_rank_sum(df).first()[0] == round(wins / (len(pos) * len(neg)), 6)


def test_deal_model_learns_planted_silence(spark, tmp_path):
    # closed deals: long silence before the close -> lost
    df = spark.range(600).select(
        F.format_string("D%04d", "id").alias("deal_id"),
        ((F.col("id") * 7) % 40).cast("int").alias("days_since_last_contact"),
        ((F.col("id") * 13) % 90).cast("int").alias("deal_age_days"),
        ((F.col("id") * 3) % 15).cast("long").alias("engagement_count"),
        ((F.col("id") * 5) % 4).cast("long").alias("meeting_count"),
        (((F.col("id") * 11) % 10) / 10.0).alias("email_reply_rate"),
        (50000 + (F.col("id") * 7919) % 400000).cast("int").alias("deal_value"))
    df = df.withColumn("is_at_risk", (F.col("days_since_last_contact") > 14).cast("int"))
    cols = ["days_since_last_contact", "deal_age_days", "engagement_count", "meeting_count",
            "email_reply_rate", "deal_value"]
    model, train, test, metrics = ml.train_model(df, cols, "is_at_risk", "deal_id",
                                                 params={"maxIter": 20})
    m = {r["metric"]: r["value"] for r in metrics.collect()}
    assert m["roc_auc"] >= ml.MIN_ROC_AUC
    imp = {r["feature"]: r["importance"] for r in ml.feature_importances(model, cols).collect()}
    assert max(imp, key=imp.get) == "days_since_last_contact"
    base = str(tmp_path / "models")
    ml.save_model(model, spark, base)
    ml.save_model(model, spark, base)
    assert ml.list_versions(spark, base) == [1, 2]
    scored = ml.score(ml.load_latest(spark, base), df, cols, "deal_id", "risk_score", "risk_rank")
    assert scored.count() == 600
    assert scored.agg(F.min("risk_score") >= 0, F.max("risk_score") <= 1).first() == (True, True)


def test_split_is_stratified_in_expectation(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 4 == 0).alias("y"))
    s = ml.stratified_split(df, "k")
    for y in (True, False):
        part = s.where(F.col("y") == y)
        share = part.where("is_test").count() / part.count()
        assert abs(share - 0.2) < 0.02


def test_split_exact_per_class(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("k"),
                                   (F.col("id") % 10 == 0).cast("int").alias("y"))
    s = ml.stratified_split(df, "k", label="y")
    for y in (0, 1):
        part = s.where(F.col("y") == y)
        share = part.where("is_test").count() / part.count()
        assert abs(share - 0.2) < 0.002
    again = ml.stratified_split(df.repartition(7), "k", label="y")
    assert sorted(s.where("is_test").select("k").collect()) == sorted(again.where("is_test").select("k").collect())


def test_exact_auc_range_partitioned(spark):
    """Many distinct scores over many range partitions and small Arrow batches,
    with ties across labels: equals the pair count."""
    import random
    rnd = random.Random(7)
    rows = [(rnd.choice([rnd.random(), round(rnd.random(), 2)]), rnd.randint(0, 1)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "score double, label int").repartition(6)
    pos = sorted(s for s, y in rows if y == 1)
    neg = sorted(s for s, y in rows if y == 0)
    import bisect
    wins = sum(bisect.bisect_left(neg, p) + 0.5 * (bisect.bisect_right(neg, p) - bisect.bisect_left(neg, p))
               for p in pos)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ml.auc_rank_sum(df, places=None).first()[0]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == round(wins / (len(pos) * len(neg)), 6)


def _share(n):
    return (n * 2000 + 5000) // 10000


def test_split_takes_the_exact_share_of_each_class(spark):
    """Also of classes of one and three rows and of rows without a label; rows of one id stay together."""
    sizes = {0: 7001, 1: 1003, 2: 3, 3: 1, None: 58}
    rows = [(f"K{y}-{i}", y) for y, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k string, y int").repartition(9)
    got = {(r["y"], r["is_test"]): r["n"] for r in ml.stratified_split(df, "k", label="y").groupBy("y", "is_test")
           .agg(F.count("*").alias("n")).collect()}
    for y, n in sizes.items():
        assert got.get((y, True), 0) == _share(n) and got.get((y, False), 0) == n - _share(n)
    hashes = {r["k"]: r["h"] for r in df.select("k", ml.split_hash("k").alias("h")).collect()}
    one = sorted(hashes[f"K1-{i}"] for i in range(1003))[:_share(1003)]
    test = {r["k"] for r in ml.stratified_split(df, "k", label="y").where("is_test and y = 1").collect()}
    assert test == {k for k, h in hashes.items() if k.startswith("K1-") and h <= one[-1]}
    twice = ml.stratified_split(df.unionByName(df).unionByName(df.where("k = 'K0-5'")), "k", label="y")
    assert twice.groupBy("k").agg(F.count_distinct("is_test").alias("n")).where("n > 1").isEmpty()
    assert ml.stratified_split(df.limit(0), "k", label="y").count() == 0


def test_next_row_is_a_derangement(spark):
    df = spark.range(500).select(F.format_string("K%03d", "id").alias("k"), F.col("id").alias("v"))
    got = ml.with_next_row(df, "k", ["v"]).collect()
    assert sorted(r["__next"]["v"] for r in got) == list(range(500))
    assert all(r["__next"]["v"] != r["v"] for r in got)


def test_permutation_importance_equals_pair_counts(spark):
    """Score = a / 10: only column a matters; the loss of AUC equals the one counted over pairs."""
    df = spark.range(200).select(F.format_string("K%03d", "id").alias("k"), (F.col("id") * 7 % 10).cast("int").alias("a"),
                                 (F.col("id") * 3 % 4).cast("int").alias("b"),
                                 ((F.col("id") * 7 % 10 > 4) != (F.col("id") % 9 == 0)).cast("int").alias("y"))
    got = {r["feature"]: r for r in ml.permutation_importance(
        df, "k", ["a", "b"], "y", lambda d: d.withColumn("score", F.col("a") / 10)).collect()}

    def auc(pairs):
        pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
        return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    moved = ml.with_next_row(df, "k", ["a"]).collect()
    base, permuted = auc([(r["a"], r["y"]) for r in moved]), auc([(r["__next"]["a"], r["y"]) for r in moved])
    assert got["b"]["importance"] == 0.0 and abs(got["a"]["base_auc"] - base) < 1e-6
    assert abs(got["a"]["permuted_auc"] - permuted) < 1e-6 and abs(got["a"]["importance"] - (base - permuted)) < 2e-6
    assert ml.permutation_importance(df.limit(0), "k", ["a", "b"], "y",
                                     lambda d: d.withColumn("score", F.col("a") / 10)).count() == 0


def test_equal_training_rows_are_merged_with_their_whole_weight(spark):
    rows = spark.range(6000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).alias("a"), (F.col("id") % 2).alias("b"),
                                    (F.col("id") % 5 == 0).cast("int").alias("y"))
    train = ml.with_class_weight(ml.feature_matrix(rows, ["a", "b"], "y", "k"))
    merged = ml.merged_rows(train, "k", above=1000)
    assert merged.count() <= 6 * 2 * ml.SHARES < train.count()
    per = [{(r[0], r[1]): r[2] for r in d.groupBy("features", "label").agg(F.sum("weight")).collect()} for d in (train, merged)]
    assert per[0].keys() == per[1].keys() and all(abs(per[1][k] - w) < 1e-6 * w for k, w in per[0].items())
    assert ml.merged_rows(train, "k") is train
    single = ml.with_class_weight(ml.feature_matrix(rows.withColumn("a", F.col("k").cast("int")), ["a", "b"], "y", "k"))
    assert ml.merged_rows(single, "k", above=1000) is single


def test_scoring_reads_the_features_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def watched(x):
        seen.add(1)
        return x
    rows = spark.range(300).select(F.col("id").cast("string").alias("k"), (F.col("id") % 7).cast("int").alias("a"),
                                   (F.col("id") % 7 > 3).cast("int").alias("y"))
    model = ml.train_gbt(ml.with_class_weight(ml.feature_matrix(rows, ["a"], "y", "k")), {"maxIter": 2})
    out = ml.score(model, rows.repartition(4).withColumn("a", watched.asNondeterministic()("a")), ["a"], "k", "score", "rank").collect()
    assert sorted(r["rank"] for r in out) == list(range(1, 301)) and seen.value == 300
