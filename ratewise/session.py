"""Spark session helpers.

On a cluster the session comes from the platform; ``ensure_checkpoint_dir``
only reads ``spark.checkpoint.dir`` there.  Tests and ``bench.py`` build a
local session and get a fresh scratch checkpoint folder when none is set.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "ratewise", driver_memory: str = "8g",
                  extra_conf: dict[str, str] | None = None) -> SparkSession:
    """Local session for tests and benchmarks (UI off, AQE on, UTC)."""
    builder = SparkSession.builder
    for k, v in (extra_conf or {}).items():
        builder = builder.config(k, v)
    spark = (
        builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.  A scratch one is made only for a
    local master; on a cluster a session that names none is an error, since a
    machine-local folder would be seen by one machine only."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="ratewise-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """Folder under the shared checkpoint dir for a materialised table."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", name)


#: Tables this process has written under the checkpoint folder.
_TABLES: list[str] = []


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: lineage is cut like ``checkpoint()``, and later readers get column
    pruning (a wide text column is never read by a step that skips it)."""
    path = checkpoint_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    _TABLES.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_tables(spark: SparkSession) -> int:
    """Delete the tables that ``write_table`` made, through the file system
    that holds them.  Call it when no result that reads them is needed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _TABLES:
        path = jvm.org.apache.hadoop.fs.Path(_TABLES.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession | None = None) -> str | None:
    """Make ``ratewise`` importable in Python workers (needed by pandas UDFs
    that reference its functions): zip the package once per application in a
    temporary folder of the driver; ``addPyFile`` sends it to the executors."""
    import zipfile

    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return None
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: ship code with the client's artifact API instead
        return None
    if sc.applicationId in _SHIPPED:
        return None
    pkg = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="ratewise-py-"), "ratewise.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
    return target
