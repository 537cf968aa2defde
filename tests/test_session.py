"""The shared folder, with and without a setting, in sessions of their own."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

REPO = Path(__file__).resolve().parent.parent

SCRIPT = """
import os, sys
from pyspark.sql import functions as F

from headway import session
spark = session.local_session(1, "1g", "headway-session")
named = sys.argv[1] if len(sys.argv) > 1 else None
assert spark.conf.get("spark.checkpoint.dir", None) == named, spark.conf.get("spark.checkpoint.dir", None)
root = session.shared_root(spark)
assert root == (named or root) and root == session.shared_root(spark.newSession())
one = session.materialise(spark.range(5), "one")
two = session.materialise(one.selectExpr("id + 1 AS id"), "two")
own = session.own_root(spark).removeprefix("file:")
assert sorted(n.split("-")[0] for n in os.listdir(own)) == ["one", "two"]
session.discard(one, spark.range(3))
assert [n.split("-")[0] for n in os.listdir(own)] == ["two"]
assert sorted(r.id for r in two.collect()) == [1, 2, 3, 4, 5]
session.clean_up(spark)
assert not os.path.exists(own)
session.remove(spark, own)
print("fine")
"""


@pytest.mark.parametrize("named", [False, True])
def test_written_tables_with_and_without_a_shared_folder(tmp_path, named):
    conf = tmp_path / "conf"
    conf.mkdir()
    folder = f"file:{tmp_path}/shared"
    if named:
        (conf / "spark-defaults.conf").write_text(f"spark.checkpoint.dir {folder}\n")
    env = os.environ | {"SPARK_CONF_DIR": str(conf), "PYTHONPATH": str(REPO), "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", SCRIPT, *([folder] if named else [])], env=env, cwd=tmp_path,
                          capture_output=True, text=True, timeout=180)
    assert done.returncode == 0 and "fine" in done.stdout, done.stderr[-2000:]


def test_a_small_join_keeps_a_task_for_every_core(spark):
    left = spark.range(40_000).selectExpr("id % 2000 AS a", "id")
    right = spark.range(40_000).selectExpr("id % 2000 AS b", "id AS other")
    joined = left.hint("merge").join(right.hint("merge"), F.col("a") == F.col("b"))
    assert joined.rdd.getNumPartitions() >= 3
