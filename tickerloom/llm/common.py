"""What the operators of this subpackage share: names that cannot clash, written tables, cells of bounded size."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than blank, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_CELL = 20_000


def seal(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Input columns under positional names, so that no work column can clash with them, and the names they had."""
    return df.toDF(*[f"in_{i}" for i in range(len(df.columns))]), list(df.columns)


def sealed_column(names: Sequence[str], column: str) -> str:
    """Where ``seal`` has put a column; names are matched as Spark does, without regard to case."""
    for i, name in enumerate(names):
        if name.lower() == column.lower():
            return f"in_{i}"
    raise ValueError(f"no column {column} among {list(names)}")


def unseal(df: DataFrame, names: Sequence[str], added: Sequence[str] = ()) -> DataFrame:
    """The input columns under their own names, then ``added``; an added column replaces an input column of its name."""
    new = {a.lower() for a in added}
    return df.select(*[F.col(f"in_{i}").alias(n) for i, n in enumerate(names) if n.lower() not in new], *added)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that all executors share; a private one only where the session is local and names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tickerloom-", dir=os.environ.get("TMPDIR", "/tmp"))
    return f"{named.rstrip('/')}/table-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: computed once, read by several steps, safe from lost executors."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cells_for(spark: SparkSession, rows: int, per_cell: int = ROWS_PER_CELL) -> int:
    """How many cells to deal ``rows`` into: several for each shuffle partition, more where cells would grow large."""
    return max(4 * shuffle_partitions(spark), math.ceil(rows / per_cell), 1)


def cell_of(hex_digest: Column, cells: int) -> Column:
    """Cell 0 to cells - 1 of a digest in hexadecimal; cells follow the order of digests and hold about equal shares."""
    return F.shiftright(F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("bigint") * F.lit(cells).cast("bigint"), 32)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def null_safe(column: Column) -> Column:
    """A string that equals another row's only if both values are equal or both are null."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))
