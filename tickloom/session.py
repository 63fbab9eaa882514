"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import socket
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
SHARED_CONF = "tickloom.shared.dir"
WAREHOUSE_CONF = "spark.sql.warehouse.dir"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tickloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TICKLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_PRIVATE: dict[str, str] = {}

#: By application and plain folder: the executors that were found to share it with the driver.
_SHARING: dict[tuple[str, str], set[str]] = {}
PROBES = 5


def _is_machine_local(spark: SparkSession, path: str) -> bool:
    """True where a path that names no scheme resolves to the local file system."""
    if "://" in path or path.startswith("file:"):
        return False
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(conf).getScheme() in (None, "file")


def _plain(path: str) -> str:
    return re.sub("^file:/+", "/", path)


def _checkpoint_dir(spark: SparkSession) -> str | None:
    """The folder given to ``setCheckpointDir`` if that was called, else the session's ``spark.checkpoint.dir``."""
    sc, named = spark.sparkContext, spark.conf.get(CHECKPOINT_CONF, None)
    ask = getattr(sc, "getCheckpointDir", None)
    current = ask() if ask else None
    if not current:
        return named
    folder, start = current.rpartition("/")[0], sc.getConf().get(CHECKPOINT_CONF)  # Spark adds a part of its own
    if start:
        at = sc._jvm.org.apache.hadoop.fs.Path(start)
        if at.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(at).toString() == folder:
            return named
    return _plain(folder)


def _executors(spark: SparkSession) -> set[str]:
    """Those registered now, and the driver."""
    return {f"{x.host()}:{x.port()}" for x in spark.sparkContext._jsc.sc().statusTracker().getExecutorInfos()}


def _is_shared(spark: SparkSession, path: str) -> bool:
    """True where every executor sees what the driver wrote to a plain folder, and the driver what each of them wrote.

    Asked again when executors have joined.
    """
    sc = spark.sparkContext
    key = (sc.applicationId, path)
    if key in _SHARING and _executors(spark) <= _SHARING[key]:
        return True
    probe = f"{path}/tickloom-probe-{uuid.uuid4().hex}"

    def look(_):
        time.sleep(0.1)  # long enough for tasks to be dealt to all executors
        own = uuid.uuid4().hex
        seen = os.path.exists(f"{probe}/driver")
        if seen:
            open(f"{probe}/{own}", "w").close()
        yield f"{socket.gethostname()} {os.getcwd()} {os.getppid()}", seen, own

    processes = set()
    os.makedirs(probe)
    try:
        open(f"{probe}/driver", "w").close()
        for _ in range(PROBES):
            there = _executors(spark)
            n = 2 * max(sc.defaultParallelism, len(there))
            for process, seen, own in sc.parallelize(range(n), n).mapPartitions(look).collect():
                if not seen or not os.path.exists(f"{probe}/{own}"):
                    return False
                processes.add(process)
            if _executors(spark) == there and len(processes) >= len(there) - 1:
                _SHARING[key] = there
                return True
        return False
    finally:
        shutil.rmtree(probe, ignore_errors=True)


def shared_dir(spark: SparkSession, path: str | None = None) -> str:
    """The folder for materialised tables.

    Taken from the argument, else the session's ``tickloom.shared.dir``, else ``spark.checkpoint.dir``. A session in one
    process may go without: it gets a private folder that ends with the process. On a cluster the folder of ``setCheckpointDir``
    goes before the setting, and the warehouse serves where there is neither. A plain path may mean another disk on every
    executor there: it is an error unless a short job finds that the driver and all executors see each other's files in it
    (a mount that all machines share may be named ``file:///...``, which is not looked at).
    The executors of a ``local-cluster`` run on the driver's machine, so its checkpoint folder is one folder to all.
    """
    named = path or spark.conf.get(SHARED_CONF, None)
    one_machine = spark.sparkContext.master.startswith("local-cluster")
    if spark.sparkContext.master.startswith("local") and not one_machine:
        path = named or spark.conf.get(CHECKPOINT_CONF, None)
        if path:
            return path
        app = spark.sparkContext.applicationId
        if app not in _PRIVATE:
            _PRIVATE[app] = os.path.realpath(tempfile.mkdtemp(prefix="spark-"))
            atexit.register(shutil.rmtree, _PRIVATE[app], ignore_errors=True)
        return _PRIVATE[app]
    path = named or _checkpoint_dir(spark)
    if one_machine and path and not named:
        return path
    path = path or _plain(spark.conf.get(WAREHOUSE_CONF, None) or "")
    if not path:
        raise ValueError(f"set {SHARED_CONF} or {CHECKPOINT_CONF} to a folder that the driver and all executors share")
    if _is_machine_local(spark, path):
        refused = f"{path} is a machine-local folder; name one in {SHARED_CONF} or {CHECKPOINT_CONF} that the driver and all executors share, with its scheme"
        try:
            shared = _is_shared(spark, path)
        except Exception as e:
            raise ValueError(refused) from e
        if not shared:
            raise ValueError(refused)
    return path


def scratch_root(spark: SparkSession) -> str:
    """This application's own part of the shared folder, right below it: a folder above may belong to another user."""
    return f"{shared_dir(spark)}/tickloom-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: short lineage that survives executor loss."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.mode("overwrite").parquet(path)
    shared_dir(spark)  # an error if an executor that doesn't share the folder has joined meanwhile
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Remove what this application has materialised; frames read from there can't be used afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
