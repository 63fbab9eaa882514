"""The shared folder: where it may be, and that nothing needs one to be preset in a session of one process."""

from __future__ import annotations

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from tickloom import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PLAIN = """
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert e.entry(spark).count() > 0
for name in ("w9_rsi", "j1_asof_per_symbol", "g1_cot_monitor", "p1_order_blocks", "st7_latest_quotes"):
    assert e.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
"""


def test_a_session_without_any_setting(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}
    run = subprocess.run([sys.executable, "-c", PLAIN.format(root=ROOT)], env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-2000:]


def fake(master: str, default: str = "file:///", **conf: str):
    uri = SimpleNamespace(getScheme=lambda: default.split(":")[0])
    fs = SimpleNamespace(FileSystem=SimpleNamespace(getDefaultUri=lambda _: uri))
    jvm = SimpleNamespace(org=SimpleNamespace(apache=SimpleNamespace(hadoop=SimpleNamespace(fs=fs))))
    sc = SimpleNamespace(master=master, applicationId="a", _jvm=jvm, _jsc=SimpleNamespace(hadoopConfiguration=lambda: None))
    return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d=None: conf.get(k.replace(".", "_"), d)))


def test_a_cluster_needs_a_shared_folder():
    for bad in (fake("yarn"), fake("spark://h:7077", spark_checkpoint_dir="/tmp/x"), fake("local-cluster[2,1,512]", tickloom_shared_dir="/tmp/x")):
        with pytest.raises(ValueError):
            session.shared_dir(bad)
    assert session.shared_dir(fake("yarn", "hdfs://n", spark_checkpoint_dir="/x")) == "/x"
    assert session.shared_dir(fake("yarn", spark_checkpoint_dir="file:///mnt/x")) == "file:///mnt/x"
    assert session.shared_dir(fake("yarn", tickloom_shared_dir="s3a://b/x", spark_checkpoint_dir="file:///mnt/x")) == "s3a://b/x"
    assert session.shared_dir(fake("local[4]", spark_checkpoint_dir="/tmp/x")) == "/tmp/x"


def test_the_checkpoint_folder_of_a_cluster_on_one_machine():
    assert session.shared_dir(fake("local-cluster[2,1,512]", spark_checkpoint_dir="/tmp/x")) == "/tmp/x"
    with pytest.raises(ValueError):
        session.shared_dir(fake("local-cluster[2,1,512]"))


CLUSTER = """
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
conf = {{"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "512m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1",
        "spark.sql.shuffle.partitions": "2", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": {shared!r}}}
spark = SparkSession.builder.config(map=conf).getOrCreate()
for name in ("a1_daily_bars", "a1_four_hour_bars", "a10_market_breadth"):
    assert e.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
spark.stop()
"""


def test_bars_on_a_cluster_whose_checkpoint_folder_has_no_scheme(tmp_path):
    run = subprocess.run([sys.executable, "-c", CLUSTER.format(root=ROOT, shared=str(tmp_path))], capture_output=True, text=True, timeout=600, cwd=tmp_path)
    assert run.returncode == 0, run.stderr[-2000:]


def test_scratch_is_removed(spark, monkeypatch):
    root = f"{session.scratch_root(spark)}/own"
    monkeypatch.setattr(session, "scratch_root", lambda _: root)
    df = session.materialize(spark.range(3), "t")
    assert df.count() == 3
    name = df.inputFiles()[0]
    session.clear_scratch(spark)
    assert not os.path.exists(name.removeprefix("file:"))


def test_a_folder_of_another_user_beside_the_scratch(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "shared_dir", lambda *_: str(tmp_path))
    (tmp_path / "tickloom").write_text("not ours, and nothing can be made below it")
    assert session.materialize(spark.range(3), "t").count() == 3
    session.clear_scratch(spark)
    assert [x.name for x in tmp_path.iterdir()] == ["tickloom"]


PLAIN_ON_CLUSTER = """
import os, sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
from tickloom import session
top = {top!r}
conf = {{"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "512m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1",
        "spark.sql.shuffle.partitions": "2", "spark.sql.session.timeZone": "UTC", "spark.sql.warehouse.dir": f"{{top}}/tables"}}
spark = SparkSession.builder.config(map=conf).getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
for path in (f"{{top}}/plain", f"{{top}}/tables"):
    os.makedirs(path, exist_ok=True)
assert session.shared_dir(spark) == f"{{top}}/tables"
assert session.shared_dir(spark, f"{{top}}/plain") == f"{{top}}/plain"
assert len(session._SHARING[spark.sparkContext.applicationId, f"{{top}}/plain"]) == 3
try:
    session.shared_dir(spark, "/proc/self/cwd/own")
except ValueError:
    pass
else:
    raise AssertionError("a folder of each process passes for a shared one")
spark.sparkContext.setCheckpointDir(f"{{top}}/set")
assert session.shared_dir(spark) == f"{{top}}/set"
spark.conf.set("tickloom.shared.dir", f"{{top}}/plain")
assert e.queries()["a1_daily_bars"](spark, "/root/testdata/sf0.001").count() > 0
found = os.listdir(f"{{top}}/plain")
assert found == [f"tickloom-{{spark.sparkContext.applicationId}}"], found
spark.stop()
"""


def test_plain_folders_on_a_cluster(tmp_path):
    (conf := tmp_path / "conf").mkdir()
    run = subprocess.run([sys.executable, "-c", PLAIN_ON_CLUSTER.format(root=ROOT, top=str(tmp_path))], env=os.environ | {"SPARK_CONF_DIR": str(conf)}, capture_output=True, text=True, timeout=600, cwd=tmp_path)
    assert run.returncode == 0, run.stderr[-2000:]


def test_a_cluster_falls_back_on_no_local_folder_unseen():
    for bad in (fake("yarn", spark_sql_warehouse_dir="file:/home/a/spark-warehouse"), fake("local-cluster[2,1,512]", spark_sql_warehouse_dir="/tmp/x")):
        with pytest.raises(ValueError):
            session.shared_dir(bad)
    assert session.shared_dir(fake("yarn", spark_sql_warehouse_dir="hdfs://n/tables")) == "hdfs://n/tables"
