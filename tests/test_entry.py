"""The entry points where the operators over documents, or what they need, are missing."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
RUN = """
import os, sys
os.environ["PYSPARK_PYTHON"] = sys.executable
import __spark_entry__ as e
from pyspark.sql import SparkSession
names = e.queries()
assert "all_features" in names and not any(n.startswith("op1") for n in names) and "pipeline" not in names and set(e.oracle_sql()) <= set(names)
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
assert names["card__count_1h"](spark, "/root/testdata/sf0.001").count() == 1000
assert e.entry(spark).columns
"""


@pytest.mark.parametrize("missing", ["public_tokenizers", "ahocorasick", "folders"])
def test_other_queries_work_without(tmp_path, missing):
    (tmp_path / "tidemark").mkdir()
    for p in (ROOT / "tidemark").iterdir():
        if p.name != "llm" or missing != "folders":
            (tmp_path / "tidemark" / p.name).symlink_to(p)
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if missing != "folders" and (ROOT / "corpus_pipeline.py").exists() else [])):
        (tmp_path / name).write_text((ROOT / name).read_text())
    block = "" if missing == "folders" else f"import sys; sys.modules[{missing!r}] = None\n"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", block + RUN], cwd=tmp_path, check=True, env=env, timeout=300)
