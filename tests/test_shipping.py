"""Jobs with Python workers run where the package is on the driver's path only."""

import os
import subprocess
import sys

from conftest import ROOT

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from dealgrid.session import get_session
from dealgrid.operators import ml, retrieval as rv
spark = get_session("local[2]", shuffle_partitions=2)
rows = [(i, [float(i), 1.0]) for i in range(1, 9)]
q = spark.createDataFrame(rows, "question_id long, embedding array<double>")
hits = rv.topk_cosine(q, q.withColumnRenamed("question_id", "chunk_id"), 2, exclude_self=True)
assert hits.count() == 16
scored = spark.createDataFrame([(i / 7.0, i % 2) for i in range(200)], "score double, label int")
assert ml.auc_rank_sum(scored, places=None).first()["roc_auc"] > 0
print("shipped")
"""


def test_runs_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT, ROOT], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=240)
    assert out.returncode == 0 and "shipped" in out.stdout, out.stderr[-2000:]
