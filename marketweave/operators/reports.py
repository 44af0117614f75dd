"""Counts and audits over the pipelines' tables; each is one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def term_counts(df: DataFrame, column: str, n: int = 15) -> DataFrame:
    """The most frequent terms of a pipe-joined column, ties by term."""
    terms = df.select(F.explode(F.split(column, r"\|")).alias("term")).filter("term <> ''")
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(n)


def funnel(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """Rows left after each stage and the change against the stage before, in percent; conditions add up, in one pass."""
    passed, sums = F.lit(True), []
    for i, (_, condition) in enumerate(stages):
        passed = passed & F.coalesce(condition, F.lit(False))
        sums.append(F.count_if(passed).alias(f"s{i}"))
    total = df.agg(F.count(F.lit(1)).alias("all"), *sums)
    names = [("input", F.col("all")), *((name, F.col(f"s{i}")) for i, (name, _) in enumerate(stages))]
    rows = F.array(*(F.struct(F.lit(i).alias("step"), F.lit(name).alias("stage"), n.alias("rows")) for i, (name, n) in enumerate(names)))
    long = total.select(F.explode(rows).alias("x")).select("x.*")
    before = F.lag("rows").over(Window.partitionBy(F.lit(0)).orderBy("step"))
    return long.withColumn("pct", F.round(F.col("rows") / F.nullif(before, F.lit(0)) * 100 - 100, 1))


def coverage(daily: DataFrame, least: float = 90.0) -> DataFrame:
    """Trading days, share with news in percent, mean and median news, days without, and whether the share is too low."""
    out = daily.agg(
        F.count(F.lit(1)).alias("days"), (F.avg((F.col("n_news") > 0).cast("double")) * 100).alias("coverage"), F.avg("n_news").alias("mean_news"),
        F.median("n_news").alias("median_news"), F.count_if(F.col("n_news") == 0).alias("zero_days"),
    )
    return out.withColumn("too_low", F.col("coverage") < least)


def weekday_density(daily: DataFrame) -> DataFrame:
    """Mean window and news by weekday from Monday to Friday, and their ratio; a weekday without rows has nulls."""
    per = daily.groupBy(F.date_format("date", "EEEE").alias("dow")).agg(F.avg("window_hours").alias("w"), F.avg("n_news").alias("n"))
    days = daily.sparkSession.createDataFrame(list(enumerate(WEEKDAYS)), "pos int, dow string")
    out = days.join(per, "dow", "left")
    return out.select("pos", "dow", F.round("w", 3).alias("window_hours"), F.round("n", 3).alias("n_news"), F.round(F.col("n") / F.col("w"), 3).alias("news_per_hour"))


def rate_summary(rates: DataFrame) -> DataFrame:
    return rates.agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.min("kurs").alias("lowest"),
        F.max("kurs").alias("highest"), F.max("gap_days").alias("longest_gap"),
    )


def collection_summary(df: DataFrame, day: str, present: list[str], least_rows: int = 10_000, period: tuple[str, str] | None = None, least_days: float = 0.7) -> DataFrame:
    """Rows, filled values of some columns, days, rows per day, and whether there are too few rows, or days of the ``period``."""
    out = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(c).alias(f"n_{c}") for c in present), F.count_distinct(day).alias("days"))
    out = out.withColumn("per_day", F.col("n") / F.greatest(F.col("days"), F.lit(1))).withColumn("too_few", F.col("n") < least_rows)
    if period:
        whole = F.datediff(F.lit(period[1]).cast("date"), F.lit(period[0]).cast("date")) + 1
        out = out.withColumn("too_few_days", F.col("days") < whole * F.lit(least_days))
    return out


def described(df: DataFrame, group: Column, value: Column, over: int) -> DataFrame:
    """Count, least, mean and greatest value by group, and how many exceed ``over``."""
    return df.groupBy(group.alias("grp")).agg(
        F.count(value).alias("n"), F.min(value).alias("least"), F.avg(value).alias("mean"), F.max(value).alias("greatest"), F.count_if(value > over).alias("n_over")
    )


def yearly_counts(df: DataFrame, year: Column, conditions: dict[str, Column]) -> DataFrame:
    """Rows by year in all and under each condition; a year without such rows has 0."""
    return df.groupBy(year.alias("year")).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(c).alias(n) for n, c in conditions.items()))
