"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("seriesloom")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, where what is written survives lost executors.

    It is read from the session; one is made only where none is set and all runs
    on one machine, as in tests. On a cluster that is an error: a folder of the
    driver is no folder of the executors.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="seriesloom-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut lineage through a table in the shared folder, of which later stages read only the columns they need."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per Spark context.

    Functions that run in Python workers refer to its modules, which need not be
    installed there.
    """
    sc = spark.sparkContext
    if getattr(sc, "_seriesloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    fd, name = tempfile.mkstemp(prefix="seriesloom-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(Path(root.name) / f.relative_to(root)))
    sc.addPyFile(name)
    sc._seriesloom_shipped = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A test table as a DataFrame."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
