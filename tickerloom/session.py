"""Session construction and the settings every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    # Window and tree work is heavy per byte: let coalescing keep tasks small instead of merging them to one megabyte.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    # Wide feature projections compile to methods beyond the 8000 bytecodes the JVM optimises; fall back before that.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A filter over forty columns doubles its inferred constraints with every column a later step renames.
    "spark.sql.constraintPropagation.enabled": "false",
    # The files of a shuffle go once the statement that made them has ended, not when the driver next collects its garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def build_session(app: str = "tickerloom", master: str | None = None, shuffle_partitions: int | None = None,
                  **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(_SETTINGS)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(extra)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> SparkSession:
    """The same settings on a session somebody else built; all of them are run-time settings."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for all executors; a private one only where none is named and the session is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="tickerloom-", dir=os.environ.get("TMPDIR", "/tmp"))


def new_folder(spark: SparkSession, kind: str = "run") -> str:
    """A name for a new folder that all executors share."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def stored(df: DataFrame, measured: bool = False, folder: str | None = None) -> DataFrame:
    """The rows as a table in the shared folder: columns can be read singly, several readers share one computation.

    ``measured``: nearly all columns are measurements that hardly repeat, for which looking for repeats takes most of the time to write.
    ``folder``: where the table lies, if it is to be ``removed`` once its readers are done."""
    folder = folder or new_folder(df.sparkSession, "table")
    df.write.option("parquet.enable.dictionary", str(not measured).lower()).option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def stored_rounded(df: DataFrame, columns: Sequence[str], folder: str | None = None) -> DataFrame:
    """The rows as a table, ``columns`` rounded to six digits. They are written as whole millionths, a third of the bytes of doubles, and read as the same doubles:
    a whole number below 2 ** 51 divided by a million is the double next to the decimal. What lies beyond, or is NaN or infinite, is written beside as it is."""
    folder = folder or new_folder(df.sparkSession, "table")
    rest, told = [c for c in df.columns if c not in columns], df.select(*[c for c in df.columns if c not in columns], *[F.round(F.col(c).cast("double"), 6).alias(c) for c in columns])
    small = {c: F.abs(c) < F.lit(1e9) for c in columns}
    told = told.select(*rest, *[F.when(small[c], F.rint(F.col(c) * F.lit(1e6)).cast("long")).alias(f"m{i}") for i, c in enumerate(columns)],
                       *[F.when(~small[c], F.col(c)).alias(f"d{i}") for i, c in enumerate(columns)])
    told.write.options(**{"parquet.enable.dictionary": "false", "compression": "zstd", "parquet.writer.version": "PARQUET_2_0"}).parquet(folder)
    at = {c: i for i, c in enumerate(columns)}
    read = df.sparkSession.read.schema(told.schema).parquet(folder)
    return read.select(*[F.coalesce(F.col(f"m{at[c]}").cast("double") / F.lit(1e6), F.col(f"d{at[c]}")).alias(c) if c in at else F.col(c) for c in df.columns])


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a table of ``stored`` that nothing will read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as a reliable checkpoint: several readers share one computation, the plan starts anew, and a lost executor
    re-reads files. For inputs that a step reads more than once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
