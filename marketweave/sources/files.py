"""Files that the pipelines read and write."""

from __future__ import annotations

import csv
from datetime import date
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marketweave.session import shared_table

ARTICLE_SCHEMA = (
    "url string, title string, published string, modified string, description string, body string, author string, section string, "
    "index_date string, title_score bigint, matched_terms string"
)


def read_csv(spark: SparkSession, path: str, schema: str | StructType | None = None, sep: str = ",") -> DataFrame:
    """CSV with header; values may hold separators, quotes and line breaks. Without schema all columns are strings."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", sep)
    return (reader.schema(schema) if schema else reader).csv(path)


def sniff_separator(spark: SparkSession, path: str, lines: int = 50) -> str:
    """The separator that the first lines of a text file use."""
    head = [r.value for r in spark.read.text(path).limit(lines).collect() if r.value.strip()]
    try:
        return csv.Sniffer().sniff("\n".join(head), delimiters=",;\t|").delimiter
    except csv.Error:
        return max(",;\t|", key=lambda d: sum(x.count(d) for x in head[:1]))


def find_column(columns: list[str], words: list[str]) -> str | None:
    """The first column whose name holds any of the words, letter case aside."""
    return next((c for c in columns if any(w in c.lower().strip() for w in words)), None)


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """``tanggal``, ``kurs``, ``seq`` of a rate file with any separator and similar column names; blank lines are skipped."""
    raw = read_csv(spark, path, sep=sniff_separator(spark, path))
    day, rate = find_column(raw.columns, ["tanggal", "date"]), find_column(raw.columns, ["kurs", "nilai", "rate", "jisdor"])
    if day is None or rate is None:
        raise ValueError(f"no date or rate column among {raw.columns}")
    return raw.select(F.col(day).alias("tanggal"), F.col(rate).alias("kurs"), F.monotonically_increasing_id().alias("seq")).dropna("all", subset=["tanggal", "kurs"])


def read_shards(spark: SparkSession, path: str, schema: str = ARTICLE_SCHEMA, strict: bool = False) -> DataFrame:
    """JSON lines of a folder. Strict: a bad line is an error. Else bad lines come with null fields and their text in ``_bad``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(schema + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def shard_audit(spark: SparkSession, path: str, by: Column | None = None) -> DataFrame:
    """Per file (or another part of its address) the number of lines and of bad ones; blank lines count for neither."""
    lines = _audited(spark, path, by)
    return lines.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.count_if("bad").alias("bad_lines"))


def bad_lines(spark: SparkSession, path: str, by: Column | None = None) -> DataFrame:
    """``file`` and ``value`` of each bad line of a folder's shards. Files are split over tasks, so lines have no numbers."""
    return _audited(spark, path, by).filter("bad").select("file", "value")


def _audited(spark: SparkSession, path: str, by: Column | None) -> DataFrame:
    name = F.col("_metadata.file_name") if by is None else by
    lines = spark.read.text(path).select(name.alias("file"), "value").filter(F.trim("value") != "")
    return lines.withColumn("bad", F.try_parse_json("value").isNull() | ~F.trim("value").startswith("{"))


def months_to_fetch(days: DataFrame, landed: DataFrame) -> DataFrame:
    """``month`` (yyyy-MM) of each month of a period of which ``landed`` has nothing, so that a run goes on where one ended."""
    return days.select(F.date_format("day", "yyyy-MM").alias("month")).distinct().join(landed.select("month").distinct(), "month", "left_anti")


def days_between(spark: SparkSession, first: str | date, last: str | date) -> DataFrame:
    """Every day of a period, both ends included, with year and month."""
    span = F.sequence(F.lit(str(first)).cast("date"), F.lit(str(last)).cast("date"), F.expr("interval 1 day"))
    return spark.range(1).select(F.explode(span).alias("day")).select("day", F.year("day").alias("year"), F.month("day").alias("month"))


def archive_url(day: Column, base: str) -> Column:
    """Address of a day's archive page: year, full English month name, day without leading zero."""
    return F.concat(F.lit(base), F.date_format(day, "yyyy"), F.lit("/"), F.date_format(day, "MMMM"), F.lit("/"), F.dayofmonth(day).cast("string"), F.lit("/"))


def write_csv(df: DataFrame, path: str, overwrite: bool = True, sep: str = ",") -> None:
    """CSV with header; without ``overwrite`` an existing path is an error."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("escape", '"').option("sep", sep).csv(path)


def append_shard(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def split_write(df: DataFrame, keep: Column, kept_path: str, rest_path: str) -> None:
    """Rows that meet the condition to one table, all others (null too) to another; the input is computed once, into the shared folder."""
    marked = shared_table(df.withColumn("_keep", F.coalesce(keep, F.lit(False))), "split")
    marked.filter("_keep").drop("_keep").write.mode("overwrite").parquet(kept_path)
    marked.filter("not _keep").drop("_keep").write.mode("overwrite").parquet(rest_path)


def write_report(path: str, text: str, append: bool = False) -> None:
    with Path(path).open("a" if append else "w", encoding="utf-8") as f:
        f.write(text + ("\n" + "=" * 70 + "\n" if append else ""))
