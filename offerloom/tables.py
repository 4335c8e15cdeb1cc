"""Written tables, and numbers for the rows of a global order."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a partition come from monotonically_increasing_id in these bits.
_ROW_BITS = 33


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or under
    a local master one of its own. On a cluster without it that is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = sc._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="offerloom-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


#: Bytes of an Arrow batch, where the session says nothing else: rows that hold
#: pages are long, and by default only their number is bounded.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on a Python worker gets batches of bounded size."""
    if not spark.sparkContext.getConf().contains(BATCH) and not getattr(spark, "_offerloom_batches", False):
        spark.conf.set(BATCH, BATCH_BYTES)
        spark._offerloom_batches = True


PARTITIONS, SPLITS = "spark.sql.shuffle.partitions", "spark.sql.files.minPartitionNum"


@contextmanager
def shuffles(spark: SparkSession, tasks: int) -> Iterator[None]:
    """What runs within shuffles to ``tasks`` partitions, and reads its files in as
    many splits, where the session has fewer. A task holds what it reads until it is
    shuffled, and of narrow rows a split of the usual bytes has many."""
    was = {PARTITIONS: spark.conf.get(PARTITIONS), SPLITS: spark.conf.get(SPLITS, None)}
    cores = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism
    few = [k for k, v in was.items() if tasks > int(v or cores)]
    for k in few:
        spark.conf.set(k, tasks)
    try:
        yield
    finally:
        for k in few:
            spark.conf.unset(k) if was[k] is None else spark.conf.set(k, was[k])


def written(df: DataFrame, tag: str, tasks: int = 0) -> DataFrame:
    """``df`` written to the shared folder and read back: made once, whatever
    reads it, and not made again when an executor is lost. Its shuffles have
    ``tasks`` partitions at least, its files as many splits."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    with shuffles(df.sparkSession, tasks):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table that is broadcast, at most.
SMALL = 100_000


def small_or_whole(table: DataFrame) -> DataFrame:
    """A written table for a join: broadcast if it is small, else as it is."""
    return F.broadcast(table) if table.count() <= SMALL else table


def numbered(df: DataFrame, by: list[str | Column], name: str, start: int = 0, tasks: int = 0) -> DataFrame:
    """``df`` with ``name``, its rows' place in the order of ``by`` (a bigint).

    Rows are dealt out by ranges of the sort key and sorted within; the counts of
    the ranges, one number for each, add up to where each begins. So no task gets
    more than its range, where a window over all rows would be one task. Rows of
    equal keys go to one range: end ``by`` with what tells rows apart. There are
    ``tasks`` ranges at least.
    """
    spark = df.sparkSession
    at = F.monotonically_increasing_id()
    with shuffles(spark, tasks):
        placed = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__n_at", at), "ordered")
    part = F.shiftright("__n_at", _ROW_BITS)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    before, begins = start, []
    for r in counts:
        # the row bits count from 0 in each range
        begins.append((r["part"], before))
        before += r["n"]
    offsets = F.broadcast(spark.createDataFrame(begins, "__n_part bigint, __n_before bigint"))
    joined = placed.withColumn("__n_range", part).join(offsets, F.col("__n_range") == F.col("__n_part"))
    row = F.col("__n_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return joined.withColumn(name, F.col("__n_before") + row).select(*df.columns, name)
