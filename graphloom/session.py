"""Session settings and the shared folder that jobs cut their lineage in."""

from __future__ import annotations

import gc
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


#: Per cent of the driver's heap that may be free after a collection by release.
FREE = 40
_HOMES: set[str] = set()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(app: str = "graphloom", **conf: str) -> SparkSession:
    """A session with the settings the library relies on; the cluster's own settings win where they are given."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which every executor and the driver can reach.

    A folder of this machine is set only where the session names none and the master is local, as in tests; on a cluster
    it is an error to name none, for no other machine could read that folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, under a folder of the application, which goes when the application ends."""
    home = f"{shared_root(spark)}/graphloom/{spark.sparkContext.applicationId}"
    if home not in _HOMES:
        folder = spark._jvm.org.apache.hadoop.fs.Path(home)
        store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(folder)
        store.deleteOnExit(folder)
        _HOMES.add(home)
    return f"{home}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and a lost executor costs nothing.

    The shuffle files of the write go with it, so that a job of many steps holds those of one step at a time.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that materialize wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage, plans, broadcasts and shuffles of finished steps, and return the heap they have grown.

    For jobs of hundreds of steps. Python goes first, as its objects hold those of the JVM. By itself a collection leaves
    a heap of which 70 % may be free; for this one alone the JVM is told `FREE`, if it knows that option and would keep more.
    """
    gc.collect()
    jvm = spark.sparkContext._jvm
    beans, name = jvm.java.lang.management.ManagementFactory, "MaxHeapFreeRatio"
    try:
        flags = beans.getPlatformMXBean(jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean"))
        before = flags.getVMOption(name).getValue()
        # a JVM takes none below its MinHeapFreeRatio
        told = max(FREE, int(flags.getVMOption("MinHeapFreeRatio").getValue()))
        flags.setVMOption(name, str(min(int(before), told)))
    except Py4JError:  # a JVM of another make
        flags = before = None
    try:
        jvm.System.gc()
    finally:
        if before is not None:
            flags.setVMOption(name, before)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
