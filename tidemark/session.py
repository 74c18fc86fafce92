"""Session factory for local runs and tests; a cluster brings its own session."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", app: str = "tidemark") -> SparkSession:
    """A session on this machine, UTC, with AQE and shuffle partitions near the core count."""
    n = os.cpu_count() or 4 if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(max(2, n)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "6g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the tables of a scale-factor folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors unless their path has it already; once for each context."""
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    sc = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_tidemark_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "tidemark").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(archive))
    sc._tidemark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, qualified by the session's file system. Only a local session may
    go without spark.checkpoint.dir; its own folder is made then."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def release(spark: SparkSession) -> None:
    """Lets the driver forget tables that no variable holds any longer; Spark then deletes their shuffle files and
    broadcasts, which else stay until the driver happens to collect its garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dealt(df):
    """df for a join that deals both sides out: else a table of few compressed bytes, but many rows, is broadcast, which
    the driver gathers and hashes."""
    return df.hint("merge")


def written(df, name: str):
    """df as a table in the shared folder, read again: cuts the lineage and survives lost executors."""
    import uuid

    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
