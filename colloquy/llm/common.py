"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: What separates words in every operator here: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Arrow batches handed to Python stay near this many bytes, however long single texts are.
ARROW_BYTES = str(4 << 20)


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches, and find the shared checkpoint folder.

    The folder is the one that the cluster names in ``spark.checkpoint.dir``; a folder of this machine is set only where
    that is unset and Spark runs on this machine alone (tests)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    ship(spark)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="colloquy-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from those files."""
    prepare(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame) -> Column:
    """All columns in one struct, so that no name of a user's column meets one of ours; see :func:`unpacked`."""
    return F.struct(*map(column, docs.columns))


def unpacked(rows: DataFrame, names: list[str], row: str = "row") -> DataFrame:
    return rows.select(*[F.col(row).getField(n).alias(n) for n in names])


def give_back() -> None:
    """Return freed memory to the system: a worker may idle beside other stages."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass
