"""Tasks find the package although their workers start elsewhere."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {shared!r}).getOrCreate())
print("rows", entry.queries()["op3_html_text"](spark, "/root/testdata/sf0.001").count())
print("rows", entry.queries()["op1_suffix_dedup"](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""


def test_workers_get_the_package(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(root=str(ROOT), shared=str(tmp_path / "shared")))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert [line for line in done.stdout.splitlines() if line.startswith("rows")][1] == "rows 200"
