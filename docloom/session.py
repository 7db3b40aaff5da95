"""Session helpers: shared scratch tables and reading the given tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench on one machine; on a cluster the session is given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("docloom")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers of the session this package, wherever the session was started."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="docloom-code-")
    atexit.register(_remove, folder)
    with zipfile.ZipFile(f"{folder}/docloom.zip", "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(f"{folder}/docloom.zip")  # Spark serves it to the executors


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a local folder for a session on one machine, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = _local_base()
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/docloom-{spark.sparkContext.applicationId}"


_local: list[str] = []


def _local_base() -> str:
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="docloom-"))
        atexit.register(_remove, _local[0])
    return f"file://{_local[0]}"


def _remove(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df to the shared folder and read it back.

    Cuts the lineage once, computes df once (a reliable checkpoint() would compute it twice) and
    survives lost executors, as the folder is shared.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its scan has fewer partitions than half of them (one small file), else as it is.

    For work that costs far more than moving the rows. A large table has partitions enough and isn't
    shuffled; the result is the same either way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def free(spark: SparkSession) -> None:
    """Let the driver collect its garbage: broadcasts, shuffle files and plans of what has ended go only then.

    What the JVM has freed outside its heap (compilers, buffers of some hundred threads) stays with the C
    library until it is told to give it back; a JVM or C library that can't is left as it is.
    """
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    try:  # the server's own class isn't open to Py4J; its interface is
        method = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = spark.sparkContext._gateway.new_array(jvm.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        method.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        pass


def sweep(spark: SparkSession) -> None:
    """Remove every table that cut() has written in this application."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(path, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
