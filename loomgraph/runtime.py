"""Session helpers shared by every module: sessions, tables, durable intermediate results."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
import zipfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "loomgraph", cores: str = "*", shuffle: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary one of this machine serves a
    local session, as in tests; on a cluster that raises, since each executor would write to its own disk."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        own = spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(own)
    return own.rstrip("/")


class Saved:
    """A DataFrame written once to the shared folder; reads of it never recompute what made it."""

    def __init__(self, df: DataFrame, name: str = "step") -> None:
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/loomgraph/{name}-{uuid.uuid4().hex}"
        self.schema = df.schema
        df.write.parquet(self.path)
        hand_back(self.spark, 5.0)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Remove the files; only for results that nothing lazy still reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        _KEPT.discard(self.path)


class Dealt(Saved):
    """A DataFrame written once to the shared folder in buckets by ``key``, as many as there are shuffle partitions and each
    sorted by it: a join by ``key`` need not move it. Its name is in the session's catalogue until drop()."""

    def __init__(self, df: DataFrame, key: str, name: str = "step") -> None:
        self.spark, self.schema, self.name = df.sparkSession, df.schema, f"loomgraph_{name}_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(self.spark)}/loomgraph/{self.name}"
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.format("parquet").bucketBy(parts, key).sortBy(key).option("path", self.path).saveAsTable(self.name)
        hand_back(self.spark, 5.0)

    @property
    def df(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")
        super().drop()


#: Tables of saved() that have not been removed; results read them, so clear() is called when those are done with.
_KEPT: set[str] = set()


def saved(df: DataFrame, name: str = "step") -> DataFrame:
    """df, cut from its lineage by a table in the shared folder, which stays until clear()."""
    made = Saved(df, name)
    _KEPT.add(made.path)
    return made.df


def clear(spark: SparkSession) -> int:
    """Remove the tables that saved() has left in the shared folder; no result that reads one may be used after it."""
    paths = list(_KEPT)
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _KEPT.discard(p)
    return len(paths)


def let(value, body):
    """body(value) with value evaluated once a row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def ship(spark: SparkSession) -> None:
    """Give the executors this package: a zip of it, sent once a context, so that workers need no path of their own."""
    context = spark.sparkContext
    if getattr(context, "_loomgraph_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    made = os.path.join(tempfile.mkdtemp(prefix="loomgraph-zip-"), "loomgraph.zip")
    with zipfile.ZipFile(made, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("loomgraph", os.path.relpath(path, here)))
    context.addPyFile(made)
    context._loomgraph_shipped = True


def hand_back(spark: SparkSession, every: float = 0.0) -> bool:
    """Have the driver's JVM return the native memory it has freed, unless it did so less than ``every`` seconds ago.

    Compilers, planners and hundreds of exchange threads allocate outside the heap; the C library keeps what they free in an
    arena a thread, so that a driver that runs many plans grows although its live data do not. False if nothing was asked
    for: it is not time yet, or the JVM is older than 17.0.9 or runs on another system than Linux, and keeps the memory.
    """
    global _handed_back
    if time.monotonic() - _handed_back < every:
        return False
    _handed_back = time.monotonic()
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    # by the interface's method, as the server's own class is closed to reflection
    kind = jvm.java.lang.Class.forName
    types, values = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    none, signature = array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
    types[0], types[1], types[2], types[3] = kind("javax.management.ObjectName"), kind("java.lang.String"), none.getClass(), signature.getClass()
    values[0], values[1], values[2], values[3] = name, "systemTrimNativeHeap", none, signature
    try:
        kind("javax.management.MBeanServer").getMethod("invoke", types).invoke(server, values)
    except Py4JJavaError:
        return False
    return True


_handed_back = float("-inf")


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more; it works in the background. What
    the driver has freed goes back to the system."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.4)
    hand_back(spark)
