"""Ordered deduplication and what is known of the rows that go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: list[str | Column], order: str, last: bool = False) -> DataFrame:
    """The first (or last) row of each key by ``order``, null keys being one key; ties of ``order`` give one arbitrary row.

    It is an aggregation, not a window: partial results collapse a hot key on each task.
    """
    row = F.struct(F.col(order), *(F.col(c) for c in df.columns if c != order))
    names = [f"_k{i}" for i in range(len(keys))]
    best = (F.max_by if last else F.min_by)(row, F.col(order)).alias("_row")
    out = df.groupBy(*((F.col(k) if isinstance(k, str) else k).alias(n) for k, n in zip(keys, names))).agg(best)
    return out.select(*(F.col("_row").getField(c).alias(c) for c in df.columns))


def joined_values(column: str) -> Column:
    """Distinct values that are not null, sorted and joined by a pipe."""
    return F.array_join(F.sort_array(F.collect_set(column)), "|")


def keyword_trail(df: DataFrame, key: str, columns: dict[str, str], counted: str, *more: Column) -> DataFrame:
    """Per key the joined values of some columns, the number of different values of another, and ``more`` aggregates."""
    joined = (joined_values(c).alias(n) for n, c in columns.items())
    return df.groupBy(key).agg(*joined, F.size(F.collect_set(counted)).cast("bigint").alias("n_keyword_hits"), *more)


def not_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the finished ones; a null key counts as not done."""
    return todo.join(done.select(key).distinct(), key, "left_anti")
