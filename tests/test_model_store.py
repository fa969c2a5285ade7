"""Model versions: claims are exclusive, half-written versions are never loaded."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler

from dealgrid.operators import ml


def model(spark, name):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    return Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol=name)]).fit(df)


def out_col(m):
    return m.stages[0].getOutputCol()


def test_two_savers_get_two_versions(spark, tmp_path):
    base = str(tmp_path / "m")
    with ThreadPoolExecutor(4) as pool:
        claims = list(pool.map(lambda _: ml.claim_version(spark, base), range(8)))
    assert sorted(claims) == list(range(1, 9))
    paths = [ml.save_model(model(spark, n), spark, base) for n in ("first", "second")]
    assert len(set(paths)) == 2 and out_col(ml.load_latest(spark, base)) == "second"


def test_half_written_versions_are_not_loaded(spark, tmp_path):
    base = str(tmp_path / "m")
    with pytest.raises(FileNotFoundError):
        ml.load_latest(spark, base)
    ml.save_model(model(spark, "good"), spark, base)
    half = f"{base}/v={ml.claim_version(spark, base)}"
    model(spark, "half").save(half)  # a saver that died before its marker
    assert ml.list_versions(spark, base) == [1] and out_col(ml.load_latest(spark, base)) == "good"
    ml.save_model(model(spark, "next"), spark, base)
    assert out_col(ml.load_latest(spark, base)) == "next"
