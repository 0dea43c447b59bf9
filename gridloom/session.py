"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

# Settings that can be changed on a running session.  The time zone fixes the
# meaning of every time bucket and ST code.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Grid arithmetic is made of many dependent columns; inferring constraints over
    # such chains costs far more than the filters it adds.
    "spark.sql.constraintPropagation.enabled": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere (a cluster's, for instance)."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "gridloom") -> SparkSession:
    """Build a session; on a cluster leave ``master`` and ``shuffle_partitions`` unset."""
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    if master and master.startswith("local"):
        builder = builder.config("spark.driver.memory", os.environ.get("GRIDLOOM_DRIVER_MEMORY", "8g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in RUNTIME.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once for each application, so that Arrow kernels import it from any folder."""
    sc = spark.sparkContext
    if getattr(sc, "_gridloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="gridloom-package-"), "gridloom.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._gridloom_shipped = True


def stage_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names for cut lineage; a scratch folder stands in for a local session only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="gridloom-")


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint.

    The checkpoint folder is the cluster's; see :func:`stage_folder`.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(stage_folder(df.sparkSession))
    return df.checkpoint()


def stage(parts: DataFrame | list[DataFrame], label: str) -> DataFrame:
    """The rows of tables of one schema, written one after the other to the stage folder and read back.

    Each part is a job of its own, and what reads the result starts from files, so no plan holds them all.
    """
    parts = parts if isinstance(parts, list) else [parts]
    spark = parts[0].sparkSession
    path = f"{stage_folder(spark).rstrip('/')}/{label}-{uuid4().hex}"
    for part in parts:
        part.select(*parts[0].columns).write.mode("append").parquet(path)
    return spark.read.schema(parts[0].schema).parquet(path)
