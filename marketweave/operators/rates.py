"""The daily rate: parsing, checks, returns and direction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketweave.functions import rates as R
from marketweave.functions import values as V
from marketweave.operators.dedup import keep_one


def parsed_rates(raw: DataFrame, date: str = "tanggal", rate: str = "kurs", order: str = "seq", day_first: bool = True) -> DataFrame:
    return raw.select(R.rate_date(F.col(date), day_first).alias("date"), R.number(F.col(rate)).alias("kurs"), F.col(order).alias("seq"))


def valid_rates(parsed: DataFrame, least: float = V.MIN_RATE, first: str = V.FIRST_DAY, last: str = V.LAST_DAY) -> DataFrame:
    """Rates above ``least`` with a date in the period; of a date given twice the later row of the file counts."""
    sane = parsed.filter(F.col("date").isNotNull() & (F.col("kurs") > least))
    one = keep_one(sane, ["date"], "seq", last=True)
    return one.filter(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def with_returns(rates: DataFrame) -> DataFrame:
    """prev_kurs, gap_days, delta, log_return and direction by date.

    The window has no partition: a row per trading day, about 250 a year, whatever the number of articles.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    prev = F.lag("kurs").over(w)
    out = rates.select("date", "kurs", prev.alias("prev_kurs"), F.datediff("date", F.lag("date").over(w)).cast("bigint").alias("gap_days"))
    out = out.withColumn("delta", F.col("kurs") - F.col("prev_kurs")).withColumn("log_return", F.ln(F.col("kurs") / F.col("prev_kurs")))
    return out.withColumn("direction", R.direction(F.col("log_return")))


def clean_rates(raw: DataFrame) -> DataFrame:
    return with_returns(valid_rates(parsed_rates(raw)))
