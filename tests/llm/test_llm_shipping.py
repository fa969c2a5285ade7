"""The training-data operators run where workers have no copy of the package."""

import os
import subprocess
import sys

from conftest import ROOT

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as e
from dealgrid.session import get_session
spark = get_session("local[4]", shuffle_partitions=4)
for name in sys.argv[2:]:
    assert e.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("shipped")
"""
NAMES = ["op1_benchmark_decontamination", "op2_url_filter", "op3_toxicity", "op4_ngram_jaccard_join", "op5_line_dedup",
         "op6_language_id", "op7_license_scan", "op8_warc", "op9_source_mixing", "op10_quality_rules",
         "op11_embedding_whitening", "op12_filter_audit", "op13_byte_bpe", "pipeline"]


def test_operators_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT, ROOT, *NAMES], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=900)
    assert out.returncode == 0 and "shipped" in out.stdout, out.stderr[-2000:]
