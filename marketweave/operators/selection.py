"""Row filters of the pipelines, as boolean columns; null inputs give a defined answer, never null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketweave.functions import text as T
from marketweave.functions import values as V


def dropped_type(kind: Column, types: tuple[str, ...] = V.DROP_TYPES) -> Column:
    return F.lower(F.coalesce(kind, F.lit(""))).isin(*types)


def dropped_section(section: Column, words: tuple[str, ...] = V.DROP_SECTIONS) -> Column:
    """True where the section holds any of the words anywhere."""
    low = F.lower(F.coalesce(section, F.lit("")))
    found = F.lit(False)
    for w in words:
        found = found | F.contains(low, F.lit(w))
    return found


def paid(section: Column, words: tuple[str, ...] = V.PAID_SECTIONS) -> Column:
    return dropped_section(section, words)


def live_blog(title: Column, url: Column, pattern: str = V.LIVE_BLOG) -> Column:
    """Title or the last part of the url names a live blog."""
    slug = F.lower(F.coalesce(url, F.lit("")))
    return F.lower(F.coalesce(title, F.lit(""))).rlike(pattern) | slug.rlike(pattern)


def on_topic(title: Column, pattern: str = V.TOPIC) -> Column:
    return F.lower(F.coalesce(title, F.lit(""))).rlike(pattern)


def merged_description(description: Column, body: Column, longest: int = 2000) -> Column:
    """Description and the start of the body, which the record that follows the fetch carries as its description."""
    both = F.concat(F.coalesce(description, F.lit("")), F.lit(" "), F.substring(F.coalesce(body, F.lit("")), 1, longest))
    return F.btrim(both, F.lit(T.WHITE))


def merged_records(articles: DataFrame) -> DataFrame:
    """Fetched records as the pipelines read them: paid ones out, constant columns set, description merged."""
    open_ = articles.filter(~paid(F.col("section")))
    return open_.withColumns({
        "article_id": F.col("url"), "type": F.lit("article"), "search_keyword": F.col("matched_terms"), "keyword_group": F.lit("html_sitemap"),
        "description": merged_description(F.col("description"), F.col("body")),
    })


def shortlist(index: DataFrame, least: int = V.MIN_TITLE_SCORE) -> DataFrame:
    """Listed titles scored; kept if the score reaches ``least`` and no rejecting phrase occurs, even inside a word."""
    scored = T.computed_once(index, {"terms": T.matched_terms(F.col("title"))}).withColumns({
        "title_score": T.lexicon_score(F.col("terms")), "matched_terms": F.array_join("terms", "|"),
        "has_negative": T.has_negative(F.col("title"), whole_words=False),
    })
    return scored.filter((F.col("title_score") >= least) & ~F.col("has_negative")).drop("terms")


def present(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that exist, in the order given."""
    return df.select(*(c for c in columns if c in df.columns))


def top_rows(df: DataFrame, by: str, tie: str, n: int) -> DataFrame:
    return df.orderBy(F.col(by).desc_nulls_last(), F.col(tie)).limit(n)


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows by ``order``, for a look at a table."""
    return df.orderBy(order).limit(n)


def chronological_split(df: DataFrame, order: str, test_share: float = 0.2) -> DataFrame:
    """``part``: train for the first rows by ``order``, test for the rest; meant for a row per day."""
    w = Window.partitionBy(F.lit(0))
    n, at = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(order))
    return df.withColumn("part", F.when(at <= F.floor(n * F.lit(1 - test_share)), "train").otherwise("test"))


def stratified_sample(df: DataFrame, stratum: Column, key: str, n: int, seed: int = 42) -> DataFrame:
    """About ``n`` rows, each stratum in proportion (rounded half to even), chosen by a hash of the key; null strata are left out.

    A threshold per stratum comes from ranking hashes within salted parts, so no task sorts a whole stratum of any size.
    """
    total = df.count()
    if not total:
        return df
    h = F.xxhash64(F.lit(seed), F.col(key))
    tagged = df.withColumn("_s", stratum).filter("_s is not null").withColumn("_h", h)
    sizes = tagged.groupBy("_s").agg(F.bround(F.count(F.lit(1)) * F.lit(n / total)).cast("bigint").alias("_take"))
    part = F.shiftrightunsigned("_h", 48)
    per = tagged.groupBy("_s", part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    run = F.sum("_n").over(Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    per = per.withColumn("_before", F.coalesce(run, F.lit(0))).join(sizes, "_s").filter(F.col("_before") < F.col("_take"))
    near = tagged.withColumn("_p", part).join(per.select("_s", "_p", "_before", "_take"), ["_s", "_p"])
    rank = F.row_number().over(Window.partitionBy("_s", "_p").orderBy("_h", key)) + F.col("_before")
    return near.withColumn("_r", rank).filter("_r <= _take").select(*df.columns)


def first_per_stratum(df: DataFrame, stratum: Column, order: str, n: int) -> DataFrame:
    w = Window.partitionBy("_s").orderBy(order)
    return df.withColumn("_s", stratum).filter("_s is not null").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r", "_s")
