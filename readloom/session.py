"""Session building and the shared folder that lineage cuts are written to."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "readloom", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the library is tested with.

    On a cluster the session comes from spark-submit; only UTC and adaptive execution are assumed.
    """
    n = cores or os.cpu_count() or 1
    b = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    let_workers_import(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="readloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p.getParent())
    fs.deleteOnExit(p)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: the lineage ends there.

    The stage is computed once, survives the loss of executors, and later reads prune columns.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scan_partitions(df: DataFrame) -> int | None:
    """Partitions of a plan without shuffles, such as a scan; None for others, whose count only running tells."""
    plan = df._jdf.queryExecution().executedPlan()
    return None if "AdaptiveSparkPlan" in plan.toString() or "Exchange" in plan.toString() else plan.execute().getNumPartitions()


def spread(df: DataFrame) -> DataFrame:
    """For work that is long for its bytes: an input of fewer partitions than there are cores, dealt out evenly.

    Larger inputs, which have splits enough, come back as they are.
    """
    n, have = df.sparkSession.sparkContext.defaultParallelism, scan_partitions(df)
    return df.repartition(n) if have is not None and have < n else df


def let_workers_import(spark: SparkSession) -> None:
    """Puts this package's folder on the Python path of workers, for drivers started from elsewhere.

    On a cluster whose nodes don't have that folder the package is shipped by --py-files instead.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
