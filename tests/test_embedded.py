"""The embedded database, in one process and over executors of their own."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest

from sigloom.sources import embedded, formats

CLUSTER = """
import sys
from pyspark.sql import SparkSession
from sigloom.plans import catalog
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.checkpoint.dir": sys.argv[2], "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
print("rows", catalog.queries()["source_jdbc"](spark, sys.argv[1]).count())
"""


def test_executors_read_what_was_written(spark, sf, tmp_path):
    home, repo = tmp_path / "home", Path(__file__).resolve().parents[1]
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():  # the executors work below Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYTHONPATH": str(repo), "PYSPARK_PYTHON": sys.executable}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    run = subprocess.run([sys.executable, "-c", CLUSTER, sf, f"file://{tmp_path}/shared"], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=180)
    want = spark.read.parquet(f"{sf}/customer.parquet").filter("c_acctbal > 500").count()
    assert f"rows {want}" in run.stdout, run.stderr[-3000:]


def test_odd_texts_and_nulls(spark):
    texts = ["a", "", None, " b ", 'q"uo"te', "co,mma", "new\nline", "cr\r\nx", "\\back\\", "é漢😀", '"', '""', "\\N", "null", "\t"]
    rows = [(k if k != 3 else None, t, k / 3 if k != 5 else None, k % 2 == 0) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id bigint, name string, v double, even boolean").repartition(3)
    back = formats.read_jdbc(spark, embedded.write_embedded(df, "odd"), "odd", embedded.DRIVER, "id", 0, 14, 4)
    assert back.dtypes == df.dtypes
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    assert formats.read_jdbc(spark, embedded.write_embedded(df.limit(0), "odd"), "odd", embedded.DRIVER).isEmpty()


def test_a_folder_that_is_no_files_is_refused(spark, monkeypatch):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./in", "file:///tmp")
    monkeypatch.setattr(embedded, "fresh_dir", lambda *_: "viewfs://store/in/x")
    with pytest.raises(ValueError, match="mounted as files"):
        embedded.write_embedded(spark.range(1), "one")


def test_a_database_that_all_reach(spark, tmp_path):
    url = f"jdbc:derby:memory:{tmp_path.name};create=true"
    formats.write_jdbc(spark.range(10), url, "ten", embedded.DRIVER)
    assert formats.read_jdbc(spark, url, "ten", embedded.DRIVER, "id", 0, 9, 3).count() == 10
