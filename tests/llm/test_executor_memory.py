"""Executors collect their garbage while an operator writes many tables, and before each stage of the pipeline."""

import importlib.util
import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]

RUN = """
import sys
from pyspark.sql import SparkSession
import corpus_pipeline
from glyphmill.llm import common

spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "512m").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", f"file://{sys.argv[1]}/shared").config("spark.executor.extraJavaOptions", f"-XX:+UseG1GC -Xlog:gc:file={sys.argv[1]}/gc-%p.log").getOrCreate()
spark.range(100).repartition(20).count()
if sys.argv[2] == "tables":
    scratch = common.Scratch(spark, "garbage")
    for i in range(common.GARBAGE):
        scratch.cut(spark.range(i))
else:
    docs = spark.createDataFrame([(1, "one two three", "en", "web", 13)], "doc_id long, text string, lang string, source string, n_chars int")
    corpus_pipeline.encoded(spark, docs, "")
spark.stop()
"""


def collections(tmp_path, what):
    """Full collections that were asked for, in each executor of a cluster of two."""
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)  # executors' logs go there
    for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYTHONPATH": str(ROOT), "PYSPARK_PYTHON": sys.executable}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    subprocess.run([sys.executable, "-c", RUN, str(tmp_path), what], env=env, cwd=tmp_path, check=True, timeout=240)
    return [p.read_text().count("Pause Full (System.gc())") for p in tmp_path.glob("gc-*.log")]


def test_executors_collect_between_tables(tmp_path):
    got = collections(tmp_path, "tables")
    assert len(got) == 2 and min(got) >= 1


def test_executors_collect_before_a_stage(tmp_path):
    got = collections(tmp_path, "stage")
    assert len(got) == 2 and min(got) >= 1
