from dealgrid.session import cluster_conf, scratch_path, shared_dir


def test_cluster_conf_scales_with_input():
    small = cluster_conf(10 << 30, 64)
    big = cluster_conf(100 << 40, 8000)
    assert int(small["spark.sql.shuffle.partitions"]) == 128  # two waves of 64 cores
    assert int(big["spark.sql.shuffle.partitions"]) % 8000 == 0
    assert int(big["spark.sql.shuffle.partitions"]) >= (100 << 40) // (256 << 20)
    assert big["spark.sql.adaptive.enabled"] == "true"


def test_shared_dir_reused(spark):
    d = shared_dir(spark)
    assert shared_dir(spark) == d
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(d.rstrip("/"))
