"""What several operators share: words, written intermediate tables, ranks without a one-task window."""

from __future__ import annotations

import contextlib
import functools
import math
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words: space, and tab to carriage return.
SEPARATORS = r"[\x20\x09-\x0D]+"
#: Rows of a slice of ``spread``.
SLICE_ROWS = 1 << 19


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later projections can't work out anew: a generator stands between."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def aside(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns under names that no operator uses; ``restored`` gives them back."""
    return docs.toDF(*(f"_own{k}" for k in range(len(docs.columns))))


def restored(names: Sequence[str]) -> list[Column]:
    return [F.col(f"_own{k}").alias(c) for k, c in enumerate(names)]


@functools.cache
def _own_folder() -> str:
    """Made once: the setting is the cluster's, and a running session can't take it."""
    return f"file://{tempfile.mkdtemp(prefix='echotrace-')}"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share.

    Where that is unset, it lies below a temporary one of this machine; a cluster's executors wouldn't share that, so
    there it is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        top = _own_folder()
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: the lineage ends there, and no executor's loss undoes it."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


_batches_lock, _batches_before = threading.Lock(), []


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Texts are large rows: fewer of them go to a Python worker at a time, for what runs inside the block.

    The setting is the session's: of blocks that overlap the first one sets it and the last one puts it back.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    with _batches_lock:
        _batches_before.append(_batches_before[-1] if _batches_before else spark.conf.get(name))
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        with _batches_lock:
            before = _batches_before.pop()
            if not _batches_before:
                spark.conf.set(name, before)


def drawn(df: DataFrame, key: Column, most: int) -> DataFrame:
    """All rows, or the ``most`` with the lowest hash of ``key`` if there are more; the hash has 62 bits, so a share of any size can be drawn."""
    n = df.count()
    if n <= most:
        return df
    draw = F.shiftrightunsigned(F.xxhash64(key, F.lit(7)), 2)
    # Somewhat more than are wanted pass the first test, so that few are sorted.
    share = (most + 6 * math.isqrt(most)) / n
    return df.where(draw < int(min(1.0, share) * 2**62)).orderBy(draw, key).limit(most)


def discard(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing will read any more: all that came from them is written itself."""
    for df in tables:
        if df is not None:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def spread(df: DataFrame, groups: Sequence[str], order: Sequence[Column], add: dict[str, Column], rows: int) -> DataFrame:
    """Running sums before each row, within ``groups`` in ``order``, with no group in one task.

    The first of ``order`` must be a bigint that spreads evenly (a hash). Each group is cut into slices of its range;
    sums of the slices give each slice its start, and a window runs inside a slice. ``add`` maps a new column's name to
    what it sums. There are as many slices as keep each below some SLICE_ROWS of all ``rows``, and 256 at least.
    """
    parts = min(1 << 24, max(256, rows // SLICE_ROWS))
    cut = F.shiftrightunsigned(order[0].bitwiseXOR(F.lit(-(2**63))), 32) * parts / F.lit(1 << 32)
    df = df.withColumn("_slice", cut.cast("int"))
    keys = [*groups, "_slice"]
    sums = df.groupBy(*keys).agg(*(F.sum(v).alias(f"_sum_{k}") for k, v in add.items()))
    before = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1) if groups else Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*(F.col(k).alias(f"_at_{k}") for k in keys), *(F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_from_{k}") for k in add))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.select("*", *(F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_in_{k}") for k, v in add.items()))
    same = [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in keys]
    out = out.join(starts, same, "left")
    kept = [c for c in df.columns if c != "_slice"]
    return out.select(*kept, *((F.col(f"_from_{k}") + F.col(f"_in_{k}")).alias(k) for k in add))
