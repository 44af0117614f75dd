"""Cut-off and roll-forward of timed rows to trading days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketweave.functions import values as V

_ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"


def iso_utc(text: Column) -> Column:
    """ISO timestamps as wall-clock UTC; one without zone is UTC, anything invalid null."""
    zone = F.regexp_extract(text, r"[T ].*?(Z|[+-]\d{2}:?\d{2})$", 1)
    local = F.regexp_replace(F.regexp_replace(text, r"(?<=\d\d:\d\d.{0,11})(?:Z|[+-]\d{2}:?\d{2})$", ""), "T", " ")
    local = F.when(F.length(local) == 10, F.concat(local, F.lit(" 00:00:00"))).when(F.length(local) == 16, F.concat(local, F.lit(":00"))).otherwise(local)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    minutes = F.coalesce(
        (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")) * F.when(zone.startswith("-"), -1).otherwise(1), F.lit(0)
    )
    shifted = local.try_cast("timestamp_ntz") - F.make_dt_interval(mins=minutes)
    return F.when(text.rlike(_ISO), shifted)


def market_time(utc: Column, zone: str = V.MARKET_ZONE) -> Column:
    """Wall clock of the market for a wall clock in UTC."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def candidate_day(local: Column, cutoff: int = V.CUTOFF_HOUR) -> Column:
    """The day itself before the cut-off hour, else the next."""
    return F.date_add(local.cast("date"), F.when(F.hour(local) >= cutoff, 1).otherwise(0))


def trading_calendar(rates: DataFrame) -> DataFrame:
    """``target_date`` and ``target_date_lag1`` (the next trading day), a row per trading day."""
    days = rates.select(F.col("date").alias("target_date")).distinct()
    return days.withColumn("target_date_lag1", F.lead("target_date").over(Window.partitionBy(F.lit(0)).orderBy("target_date")))


def roll_forward(calendar: DataFrame) -> DataFrame:
    """``candidate``, ``target_date``: for every day of the calendar's span the next trading day at or after it.

    A row per calendar day, so it joins by equality.
    """
    span = calendar.agg(F.min("target_date").alias("lo"), F.max("target_date").alias("hi")).filter("lo is not null")
    span = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("candidate"))
    each = span.join(calendar.select("target_date"), F.col("candidate") == F.col("target_date"), "left")
    ahead = Window.partitionBy(F.lit(0)).orderBy("candidate").rowsBetween(0, Window.unboundedFollowing)
    return each.select("candidate", F.min("target_date").over(ahead).alias("target_date"))


def off_hours(local: Column, cutoff: int = V.CUTOFF_HOUR) -> Column:
    """Weekend, or the cut-off hour or later; false without a time."""
    return F.coalesce((F.weekday(local) >= 5) | (F.hour(local) >= cutoff), F.lit(False))


def hours_to_fixing(target: Column, local: Column, cutoff: int = V.CUTOFF_HOUR) -> Column:
    fixing = target.cast("timestamp_ntz") + F.expr(f"interval {cutoff} hours")
    return F.timestamp_diff("MICROSECOND", local, fixing) / F.lit(3_600_000_000)


def align(news: DataFrame, rates: DataFrame, utc: str = "published_utc") -> DataFrame:
    """``news`` with published_wib, target_date, target_date_lag1, is_offhours and hours_to_fixing; no row is dropped.

    Rows after the last fixing, or without time, have no target. Both lookup tables have a row per day; AQE broadcasts them.
    """
    calendar = trading_calendar(rates)
    # days before the first trading day roll to it; the first day is a scalar of the calendar, so the news are read once
    first = calendar.agg(F.min("target_date")).scalar()
    timed = news.withColumn("published_wib", market_time(F.col(utc)))
    day = candidate_day(F.col("published_wib"))
    timed = timed.withColumn("candidate", F.when(day.isNotNull(), F.greatest(day, first)))
    out = timed.join(roll_forward(calendar), "candidate", "left").join(calendar, "target_date", "left").drop("candidate")
    out = out.withColumn("is_offhours", off_hours(F.col("published_wib")))
    return out.withColumn("hours_to_fixing", hours_to_fixing(F.col("target_date"), F.col("published_wib")))


def daily_news(aligned: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per target day: counts and means of its news; ``with_text`` adds their texts in order of time and url.

    The joined text is one value a day, which suits news of a market; a corpus whose days outgrow a row has :func:`daily_texts`.
    """
    texts = F.array_sort(F.collect_list(F.when(F.col("text_norm") != "", F.struct("published_utc", "url", "text_norm"))))
    joined = [F.array_join(F.transform(texts, lambda x: x["text_norm"]), " ").alias("text_norm_concat")] if with_text else []
    return aligned.filter("target_date is not null").groupBy(F.col("target_date").alias("date")).agg(
        F.count("url").alias("n_news"), F.avg("relevance_score").alias("mean_relevance"), F.max("relevance_score").alias("max_relevance"),
        F.avg("n_tokens").alias("mean_tokens"), F.avg(F.col("is_offhours").cast("double")).alias("pct_offhours"), *joined,
    )


def daily_texts(aligned: DataFrame) -> DataFrame:
    """The texts of each day as rows in order: ``date``, ``published_utc``, ``url``, ``text_norm``; a range sort, so days may span tasks."""
    kept = aligned.filter("target_date is not null and text_norm <> ''")
    return kept.select(F.col("target_date").alias("date"), "published_utc", "url", "text_norm").orderBy("date", "published_utc", "url")


def aligned_daily(rates: DataFrame, daily: DataFrame) -> DataFrame:
    """Every trading day with its news; days without news have none of them, an empty text and no means."""
    out = rates.join(daily, "date", "left").na.fill(0, ["n_news"])
    if "text_norm_concat" in out.columns:
        out = out.na.fill("", ["text_norm_concat"])
    return out.withColumn("window_hours", F.coalesce(F.col("gap_days"), F.lit(1)) * F.lit(24.0)).withColumn("news_density", F.col("n_news") / F.col("window_hours"))
