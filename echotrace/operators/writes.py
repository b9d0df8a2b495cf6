"""What a write leaves behind, as the table after it: inserts, upserts, deletes, state machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with those rows whose key it doesn't hold; of equal new keys one is taken."""
    return table.unionByName(rows.dropDuplicates([key]).join(table.select(key), key, "left_anti"))


def latest_state(log: DataFrame, keys: list[str], at: str, ident: str, value: str) -> DataFrame:
    """The last entry's value for each key of an event log."""
    return log.groupBy(*keys).agg(F.max_by(value, F.struct(at, ident)).alias(value))


def without(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The table after a delete by key."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def kept_by_status(rows: DataFrame, status: DataFrame, key: str, dropped: list[str], unknown_stays: bool) -> DataFrame:
    """Rows whose status is none of ``dropped``; a row without status stays or goes as told."""
    both = rows.join(status.select(key, "status"), key, "left")
    fine = ~F.col("status").isin(dropped)
    return both.where(F.coalesce(fine, F.lit(unknown_stays))).drop("status")


def admin_check(failed: Column, failures: Column, notify_at: int = 2, remove_at: int = 4) -> Column:
    """What follows from one more admin check: reset, count, notify or remove."""
    now = F.when(failed, failures + 1).otherwise(0)
    act = F.when(~failed, "reset").when(now >= remove_at, "remove").when(now == notify_at, "notify").otherwise("count")
    return F.struct(now.alias("failures"), act.alias("act"))


def chunks(values: Column, size: int) -> Column:
    """An array cut into arrays of ``size``, the last one shorter."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(values) - 1), F.lit(size))
    return F.when(F.size(values) == 0, F.array().cast("array<array<string>>")).otherwise(F.transform(starts, lambda i: F.slice(values, i + 1, size)))
