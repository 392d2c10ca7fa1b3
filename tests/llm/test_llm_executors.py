"""Every query runs on executors that cannot import the package."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

pytest.importorskip("public_tokenizers")
REPO = str(Path(__file__).parents[2])
CODE = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "3g").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")

def seen(batches):
    import importlib.util
    for b in batches:
        assert importlib.util.find_spec("switchyard") is None
        yield b

spark.range(4).mapInPandas(seen, "id long").count()
from switchyard.llm import queries
for name, query in queries.queries().items():
    print(name, len(query(spark, sys.argv[1]).collect()), flush=True)
"""


def test_queries_run_where_the_package_is_missing(spark, tmp_path):
    rows = [(k, f"word{k % 7} some text of document {k % 40} " * (1 + k % 5), ("en", "de")[k % 2], f"src{k % 3}", 10) for k in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, k % 3 // 2) for k in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, rows[3][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, f"http://a{k}.example.org/en/{k}", f"<p>{k % 9}</p>") for k in range(60)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    env["PYTHONPATH"] = os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and not p.startswith(REPO))
    out = subprocess.run([sys.executable, "-c", CODE, f"file://{tmp_path}"], capture_output=True, text=True, cwd=tmp_path, env=env, timeout=900)
    assert out.returncode == 0, out.stderr[-3000:]
    counts = dict(line.split() for line in out.stdout.splitlines() if line.startswith("op"))
    assert len(counts) == 13 and all(int(n) > 0 for n in counts.values())
