"""Helpers shared by the training-data operators: tables, shared folders, text rules.

Every operator takes DataFrames and returns DataFrames.  Columns an operator does not
name are ignored: each operator first selects the columns it needs under names of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: ASCII bytes that end a word (before lower-casing): all but digits and letters.
BREAKS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())

#: bytes.translate table: breaks become spaces, A-Z become a-z, the rest stays.
WORD_BYTES = bytes(32 if c < 128 and not chr(c).isalnum() else c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 4 << 20

_LOCAL_SHARED: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``; one of our own only in a local session without it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL_SHARED:
        _LOCAL_SHARED.append(tempfile.mkdtemp(prefix="pagewright-"))
    return _LOCAL_SHARED[0]


def _tidied(function):
    """``function`` for a worker that hands freed memory back when its task ends: idle workers stay for the next tasks."""

    def run(batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim is not None:
                trim(0)

    return run


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` whose batches hold ``BATCH_BYTES`` at most, or one row: a session setting, so that
    neither the JVM nor a worker holds ten thousand long texts at once."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(_tidied(function), schema)


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, what)
    schema = df.schema
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def words_column(text):
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text whose A-Z are lower-cased.

    A translate and a split stay inside code generation and are about five times as fast
    as ``regexp_extract_all``.  Null and wordless texts give an empty array.
    """
    spaced = F.trim(F.translate(F.coalesce(text, F.lit("")), BREAKS + UPPER, " " * len(BREAKS) + LOWER))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " +"))


def ascii_lower(column):
    return F.translate(column, UPPER, LOWER)
