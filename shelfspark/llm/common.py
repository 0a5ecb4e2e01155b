"""Helpers shared by the corpus operators: scratch tables, hashing of row identity, prefix sums."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Regular expression of one word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Most rows that are ever marked for broadcast; past it a plain join is used.
MAX_BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A private folder is chosen only where the session has none and runs in one
    process (local tests); on a cluster, where each machine would write its part
    to its own disk, a session without the setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir is not set: {master} needs a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="shelfspark-")
    spark.sparkContext.setCheckpointDir(made)
    return made


#: Scratch tables of this process, which are deleted when it ends.
_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


@atexit.register
def _forget() -> None:
    for spark, path in _SCRATCH:
        with contextlib.suppress(Exception):  # the session may have ended before
            drop_path(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there,
    and a lost executor costs nothing that was already written."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``tables``, once no plan reads it any more."""
    for df in tables:
        drop_path(df.sparkSession, df._scratch)
        _SCRATCH[:] = [x for x in _SCRATCH if x[1] != df._scratch]


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no live plan reads any more."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a table of ``rows`` rows, given only while that is small."""
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df


def segment_bases(meta: DataFrame, part: str, seq: str, n: str) -> DataFrame:
    """Exclusive prefix sums of ``n`` in (part, seq) order as column ``base``.

    Two levels, so that the only window without a partition sees one row per
    partition: totals per ``part`` are summed first, then segments within each.
    """
    totals = meta.groupBy(part).agg(F.sum(n).alias("_total"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select(part, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_part_base"))
    inside = Window.partitionBy(part).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    return (
        meta.select(part, seq, F.coalesce(F.sum(n).over(inside), F.lit(0)).alias("_inner"))
        .join(parts, part)
        .select(part, seq, (F.col("_part_base") + F.col("_inner")).alias("base"))
    )
