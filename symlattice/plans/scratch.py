"""Tables that cut a plan's lineage, written where every executor can read them.

A scratch table is a Parquet table below the folder that ``spark.checkpoint.dir`` names.
It survives the loss of executors, and reading it again never recomputes what is above it.
Only where that setting is absent (tests, a laptop) a folder of this machine is used.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_tables: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; a local one is made only where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(spark.sparkContext, "_symlattice_scratch", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="symlattice-")
        spark.sparkContext._symlattice_scratch = own
    return own


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone, or the folder
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def scratch(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """``df``, written to a table of its own and read back. Shuffle files of the write go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/symlattice/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _tables[path] = spark
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def made() -> set[str]:
    """Paths of the scratch tables there are."""
    return set(_tables)


def discard(*tables: DataFrame | str) -> None:
    """Delete scratch tables (what :func:`scratch` returned, or paths) that no lazy DataFrame reads any more."""
    for table in tables:
        path = table if isinstance(table, str) else getattr(table, "_scratch_path", None)
        spark = _tables.pop(path, None)
        if spark is not None:
            _delete(spark, path)


def discard_all() -> None:
    discard(*made())


atexit.register(discard_all)
