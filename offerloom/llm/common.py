"""Helpers that the operators share: written tables, skew-aware joins, batches."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key counts as hot when it holds more than this share of all rows, so at
#: most 1 / HOT_SHARE keys are hot and a broadcast of them has a fixed bound.
HOT_SHARE = 1 / 1000

#: Rows up to which a list of ids is broadcast (8 bytes each); beyond it the
#: same join runs as a shuffle.
BROADCAST_ROWS = 500_000


def _is_local(spark: SparkSession) -> bool:
    """Whether driver and workers are on one machine and share its folders."""
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, for tables that cut lineage.

    Where spark.checkpoint.dir names none, a local master gets one of its own; on
    a cluster no folder of this machine would do, and that is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = sc._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="offerloom-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Every executor can read the files, so a lost executor costs a re-read, and
    later jobs start from here instead of from the source.
    """
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch, where the session has set none. Each task holds a
#: batch or two in the JVM and in its worker, on top of a heap that may be full.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def ship_package(spark: SparkSession) -> None:
    """Make ready for Python workers: small batches, and this package importable
    in those whose path lacks it, on a cluster always, since executors need not
    have the driver's folders."""
    if not spark.sparkContext.getConf().contains(BATCH) and not getattr(spark, "_offerloom_batches", False):
        spark.conf.set(BATCH, BATCH_BYTES)
        spark._offerloom_batches = True
    root = Path(__file__).resolve().parents[2]
    seen = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if _is_local(spark) and any(p and os.path.realpath(p) == str(root) for p in seen):
        return
    sc = spark.sparkContext
    if getattr(sc, "_offerloom_shipped", False):
        return
    at = Path(tempfile.mkdtemp(prefix="offerloom-code-")) / "offerloom.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted((root / "offerloom").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(at))
    sc._offerloom_shipped = True


def hot_limit(total_rows: int) -> int:
    """Rows a key may hold before it counts as hot."""
    return max(64, int(total_rows * HOT_SHARE))


def join_one_row_per_key(left: DataFrame, right: DataFrame, keys: list[str], rows: str, hot_above: int, salt: str, how: str = "inner") -> DataFrame:
    """Join ``left`` to ``right``, which has one row for each key.

    ``rows`` is the column of ``right`` that counts the key's rows in ``left``.
    Keys with more than ``hot_above`` rows come from a broadcast (at most
    total / hot_above of them exist) and their left rows are dealt out by
    ``salt`` instead of by key, so that no task gets all rows of one key.
    A first key that is no bigint is dealt by its hash.
    """
    plain = dict(left.dtypes)[keys[0]] == "bigint"
    first, rest = F.col(keys[0]) if plain else F.xxhash64(keys[0]), keys[1:] if plain else keys
    values = [c for c in right.columns if c not in keys]
    packed = right.select(*keys, F.struct(*values).alias("__value"), F.col(rows).alias("__rows"))
    hot = packed.filter(F.col("__rows") > hot_above).select(*[F.col(k).alias(f"__hot_{k}") for k in keys], F.col("__value").alias("__hot"))
    cold = packed.filter(F.col("__rows") <= hot_above).select(first.alias("__deal"), *[F.col(k).alias(f"__cold_{k}") for k in rest], F.col("__value").alias("__cold"))
    same_hot = [F.col(k) == F.col(f"__hot_{k}") for k in keys]
    dealt = left.join(F.broadcast(hot), same_hot, "left").drop(*[f"__hot_{k}" for k in keys])
    dealt = dealt.withColumn("__deal", F.when(F.col("__hot").isNotNull(), F.xxhash64(F.lit("hot"), F.col(salt))).otherwise(first)).alias("l")
    same = [F.col("l.__deal") == F.col("r.__deal")] + [F.col(k) == F.col(f"__cold_{k}") for k in rest]
    joined = dealt.join(cold.alias("r"), same, "left").withColumn("__value", F.coalesce("__hot", "__cold"))
    if how == "inner":
        joined = joined.filter(F.col("__value").isNotNull())
    return joined.select(*[F.col(f"l.{c}") for c in left.columns], *[F.col(f"__value.{v}").alias(v) for v in values])


def row_id(doc_id: Column, text: Column) -> Column:
    """128 bits for a row's id and text, as two hashes that read them in either
    order: at 1e10 rows 64 bits would have some rows in common."""
    return F.struct(F.xxhash64(doc_id, text).alias("a"), F.xxhash64(F.lit("b"), text, doc_id).alias("b"))


def _some_ids(ids: DataFrame, key: str) -> DataFrame:
    """Distinct ids, marked for a broadcast if few, else for a shuffle."""
    ids = ids.select(F.col(key)).filter(F.col(key).isNotNull()).distinct()
    small = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(ids) if small else ids.hint("merge")


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids``."""
    return df.join(_some_ids(ids, key), key, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is null or not in ``ids``."""
    return df.join(_some_ids(ids, key), key, "left_anti").select(df.columns)


def text_pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about ``most`` bytes of text.

    A row is never cut: one longer text is a piece of its own. After each piece
    the memory that Arrow keeps for later is given back, since a worker outlives
    its task and what it holds counts against its executor.
    """
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(sizes, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            if e > s:
                yield batch.slice(s, e - s)
                pa.default_memory_pool().release_unused()
        del batch
        pa.default_memory_pool().release_unused()


def text_buffer(column: pa.Array):
    """(bytes as uint8, offsets) of a string column; null counts as empty."""
    import numpy as np
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
