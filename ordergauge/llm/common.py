"""What the operators share: text helpers, and cutting lineage in the shared folder."""

from __future__ import annotations

import re
import shutil
import string
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java class and as its complement
SPACE = r"[ \t-\r]"
NOT_SPACE = r"[^ \t-\r]+"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; no other letter changes."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def whole_text(text: Column) -> Column:
    """The text, or the empty text for null."""
    return F.coalesce(text, F.lit(""))


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    return F.regexp_count(whole_text(text), F.lit(NOT_SPACE)).cast("long")


def _shared_folder(spark: SparkSession) -> None:
    """Set the folder for checkpoints that the session names; on one machine alone, as in tests, else one of our own."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="run-", dir="/tmp"))


def checkpointed(frame: DataFrame) -> DataFrame:
    """The frame's rows, stored in the folder that the cluster names in ``spark.checkpoint.dir``."""
    _shared_folder(frame.sparkSession)
    return frame.checkpoint()


def new_folder(spark: SparkSession) -> str:
    """A folder that does not exist yet, in the shared one."""
    _shared_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder that ``new_folder`` named, once nothing reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def same_schema(frame: DataFrame, **added: str) -> str:
    """The frame's columns and the added ones (name to type) as DDL, for functions that return Arrow batches."""
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name not in added]
    return ", ".join([*columns, *(f"`{name}` {kind}" for name, kind in added.items())])


def with_arrays(batch, **added):
    """An Arrow batch with the given columns added or replaced, in the order of ``same_schema``."""
    names = [n for n in batch.schema.names if n not in added]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *added.values()], [*names, *added])


def small(batches, column: str, rows: int = 256, size: int = 1 << 21):
    """The Arrow batches in slices of a few rows and, but for single long values, of few bytes in a column.

    What a task makes of a slice, in Python objects, then stays small however long the texts are.
    """
    for batch in batches:
        values = batch.column(column)
        length = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
        ends = pc.fill_null(length(values), 0).to_numpy(zero_copy_only=False).cumsum()
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            stop = max(at + 1, min(at + rows, int(ends.searchsorted(done + size, "right"))))
            yield batch.slice(at, stop - at)
            at = stop


def with_package(spark: SparkSession) -> SparkSession:
    """The session, with this library sent to executors that have not got it, once per application."""
    root = Path(__file__).resolve().parents[2]
    name = "ordergauge-package"
    if not any(name in x for x in spark.sparkContext.listFiles):
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{name}", "zip", root, "ordergauge")
        spark.sparkContext.addPyFile(archive)
    return spark
