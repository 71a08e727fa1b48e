"""Sessions, tables and the cutting of lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings of a session made here; a session that exists keeps its own.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with the engine's defaults; keyword names hold "_" for "."."""
    builder = SparkSession.builder.master(master).appName("gnomon")
    for key, value in (DEFAULTS | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table of that name, a parquet file or directory. Python workers then find this package where the driver found it, unless their path is set."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan for Python stages: where its files make fewer tasks than there are cores, its rows are dealt to as many. That holds only for inputs of a few file blocks; a large scan stays as it is, without a shuffle. Select the columns before."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see. Where it is unset a local session (tests) gets a temporary one; a cluster must set it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="gnomon-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return _own_folder[0]


_written: list[tuple[SparkSession, str]] = []


def _drop_written() -> None:
    """When the driver ends, its tables in the shared folder go."""
    for spark, path in _written:
        try:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # the session has ended: nothing can be done from here
            return


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gnomon-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    if not _written:
        atexit.register(_drop_written)
    _written.append((spark, path))
    held = spark.read.schema(df.schema).parquet(path)
    _paths[id(held)] = (held, path)
    return held


_paths: dict[int, tuple[DataFrame, str]] = {}


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing will read again; others are left alone."""
    for held in tables:
        found = _paths.pop(id(held), None)
        if found:
            spark, path = held.sparkSession, found[1]
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
            _written.remove((spark, path))
