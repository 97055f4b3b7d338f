"""Shared-folder tables: cutting lineage so that a lost executor costs one reread."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors, taken from ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, may run
    without the setting; it gets a temporary folder that goes at exit.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="docloom-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    sc.setCheckpointDir(made)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under :func:`work_dir`."""
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


_scratch: list[tuple[SparkSession, str]] = []


def discard_at_exit(spark: SparkSession, path: str) -> str:
    """Have ``path`` deleted when the driver ends; results that scan it stay readable until then."""
    _scratch.append((spark, path))
    return path


@atexit.register
def _discard() -> None:
    for spark, path in _scratch:
        # The JVM may have gone first, and a folder that is left behind is no error.
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001
            return


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a scan of it.

    Used where a result is read more than once or where iteration would grow
    the lineage; nothing stays on the disks of single executors. The table goes
    when the driver ends.
    """
    path = discard_at_exit(df.sparkSession, new_path(df.sparkSession, label))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes up to which :func:`sized` has a table broadcast.
BROADCAST_BYTES = 32 << 20


def sized(table: DataFrame, most: int | None = None) -> DataFrame:
    """``table`` with a broadcast hint if its rows, counted first, are small enough, else as it is.

    For written tables, which are cheap to count. Texts and binaries count by
    their length, any other value as 16 bytes.
    """
    long = [F.coalesce(F.octet_length(n), F.lit(0)) for n, t in table.dtypes if t in ("string", "binary")]
    size = sum(long, F.lit(16 * len(table.columns)))
    held = table.agg(F.sum(size.cast("long"))).first()[0] or 0
    return F.broadcast(table) if held <= (BROADCAST_BYTES if most is None else most) else table


def running_totals(rows: DataFrame, order: list, totals: dict[str, Column], label: str = "ranges") -> DataFrame:
    """Adds, for each name in ``totals``, the sum of its value over all rows before, in a global ``order``.

    Rows are range-sorted, so one value of the first key may fill many ranges.
    Sums per range (one row for each shuffle partition, whatever the data's
    size) are run up and broadcast; the rest is added inside each range. No
    task sees all rows. ``order`` should leave no ties; nulls of a value count 0.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = {f"__v{i}": F.coalesce(v, F.lit(0)) for i, v in enumerate(totals.values())}
    placed = rows.withColumns(values).repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    placed = materialize(placed, label)
    whole = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("__part").agg(*(F.sum(v).alias(f"__s{v}") for v in values))
    sums = sums.select("__part", *(F.coalesce(F.sum(f"__s{v}").over(whole), F.lit(0)).alias(f"__b{v}") for v in values))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.join(F.broadcast(sums), "__part")
    added = {n: F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"__b{v}") for n, v in zip(totals, values, strict=True)}
    return placed.withColumns(added).drop("__part", *values, *(f"__b{v}" for v in values))
