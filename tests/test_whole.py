"""Whole inputs: results that a cut of the rows, of the ids or of the rounds would change."""

import ast
import os
import subprocess
import sys
import time
from itertools import product
from pathlib import Path

import pyarrow.parquet as pq
import pyspark

from millrace.plans.catalog import QUERIES
from millrace.sources import readers
from millrace.sources import writers as W


def holds(sequence, pattern):
    at = iter(sequence)
    return all(x in at for x in pattern)


def test_sequential_patterns_mine_whole_sequences(spark, data):
    users = {}
    for r in sorted(pq.read_table(Path(data) / "events.parquet", columns=["user_id", "event_id", "event_type"]).to_pylist(), key=lambda r: r["event_id"]):
        users.setdefault(r["user_id"], []).append(r["event_type"])
    kinds = sorted({k for s in users.values() for k in s})
    want = {p: n for k in (1, 2, 3) for p in product(kinds, repeat=k) if (n := sum(holds(s, p) for s in users.values())) >= 0.9 * len(users)}
    got = {tuple(x for (x,) in r["sequence"]): r["freq"] for r in QUERIES["sequential_patterns"](spark, data).collect() if all(len(x) == 1 for x in r["sequence"])}
    assert max(map(len, users.values())) > 20 and got == want


def test_itemsets_are_over_the_suppliers(spark, tmp_path):
    rows = [(o, s) for o in range(10) for s in ((5, 25) if o % 2 else (25, 45))]
    spark.createDataFrame(rows, "l_orderkey bigint, l_suppkey bigint").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {tuple(r["items"]): r["freq"] for r in QUERIES["fpgrowth"](spark, str(tmp_path)).collect()}
    assert got == {("s25",): 10, ("s45",): 5, ("s5",): 5, ("s25", "s45"): 5, ("s25", "s5"): 5}


def test_fixed_records_take_linear_time(spark, tmp_path):
    content = b"".join(b"%09d\n" % i for i in range(800_000)) + b"rest"
    (tmp_path / "a.bin").write_bytes(content)
    (tmp_path / "b.bin").write_bytes(b"")
    began = time.time()
    got = readers.fixed_records(spark, str(tmp_path / "*.bin"), 10).select("n", "record").toPandas()
    assert time.time() - began < 30  # a copy of the file for each record is 6.4 TB
    assert list(got["n"]) == list(range(800_001)) and b"".join(map(bytes, got["record"])) == content


def test_fixed_records_hold_any_key_and_name(spark, tmp_path):
    rows = [(1, None), (None, "a"), (-5, ""), (12345678901, "  b  "), (-(2**63), "é" * 31), (2**63 - 1, "\U0001f600" * 31), (7, "c\nd\n"), (8, "x" * 41)]
    spark.createDataFrame(rows, "c_custkey bigint, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    got = QUERIES["io_fixed_records"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == {(k, v and v[:30]) for k, v in rows} and len(got) == len(rows)


ODD = [(1, None, 1.5), (None, "a", 2.0), (-5, "", None), (2**63 - 1, "  b  ", -3.0), (-(2**63), "é,\U0001f600", 0.1), (7, 'c"\n\r\nd\n', 1e300), (8, "\\", 0.0), (9, '"', 5.0)]


def test_derby_archive_keeps_values(spark, tmp_path):
    df = spark.createDataFrame(ODD, "k bigint, name string, v double").repartition(3)
    url = W.derby_archive(df, f"file:{tmp_path}", "odd")
    got = readers.jdbc(spark, url, 'SELECT "k", "name", "v" FROM odd').collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, ODD))
    assert [p.name for p in tmp_path.iterdir()] == ["db.jar"]


CLUSTER = """
import sys
from pyspark.sql import SparkSession
from millrace.plans.catalog import QUERIES
folder = sys.argv[1]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "512m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": f"file://{folder}/shared", "spark.local.dir": f"{folder}/local"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
print("ROWS", [tuple(r) for r in QUERIES["io_jdbc"](spark, folder).collect()], flush=True)
spark.stop()
"""


def test_jdbc_with_executors_of_their_own(spark, tmp_path):
    spark.createDataFrame(ODD, "c_custkey bigint, c_name string, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():  # the executors log to Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    root = str(Path(__file__).resolve().parent.parent)
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_", "SPARK_"))}
    env |= {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYTHONPATH": root, "PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", CLUSTER, str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    got = [x for x in run.stdout.splitlines() if x.startswith("ROWS ")]
    assert got, run.stderr[-2000:]
    assert sorted(map(repr, ast.literal_eval(got[0][5:]))) == sorted(repr(r) for r in ODD if (r[2] or 0) > 0)
