"""The pipelines from records to the aligned daily table, as one lazy plan each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketweave.functions import text as T
from marketweave.functions import values as V
from marketweave.functions.subword import subword_count
from marketweave.operators import alignment as A
from marketweave.operators import selection as S
from marketweave.operators.dedup import keep_one, keyword_trail


def news_stages(records: DataFrame) -> DataFrame:
    """Records once per url and title, with cleaned text, scores and the columns ``long_enough`` and ``keep``.

    The cheap filters come first, so that fewer rows cross to Python. ``records`` needs ``seq`` for the order of arrival.
    """
    r = records.withColumn("url", F.btrim("url", F.lit(T.WHITE)))
    # both deduplications and the trail are of narrow rows; the texts meet the rows that are left once
    key = T.title_key(F.coalesce(F.col("title"), F.lit("nan")))
    first = F.min_by(F.struct("seq", key.alias("_key")), F.col("seq")).alias("_first")
    trail = keyword_trail(r, "url", {"search_keywords": "search_keyword", "keyword_groups": "keyword_group"}, "search_keyword", first)
    trail = trail.select(F.col("_first.seq").alias("seq"), F.col("_first._key").alias("_key"), "search_keywords", "keyword_groups", "n_keyword_hits")
    chosen = keep_one(trail, ["_key"], "seq").drop("_key")
    text = r.filter(~S.dropped_type(F.col("type")) & ~S.dropped_section(F.col("section"))).join(chosen, "seq")
    text = T.computed_once(text, {f"{n}_clean": T.clean_terms(F.col(c)) for n, c in (("title", "title"), ("desc", "description"), ("body", "body"))})
    text = T.computed_once(text, {
        "text_for_filter": T.join_parts(F.col("title_clean"), F.col("desc_clean")),
        "text_clean": T.join_parts(F.col("title_clean"), F.col("desc_clean"), F.col("body_clean")),
    })
    text = T.computed_once(text, {
        "long_enough": T.token_count(F.col("text_clean")) >= V.MIN_TOKENS, "_terms": T.matched_terms(F.col("text_for_filter")),
        "has_negative": T.has_negative(F.col("text_for_filter")),
    })
    text = text.withColumns({"relevance_score": T.lexicon_score(F.col("_terms")), "matched_terms": F.array_join("_terms", "|")})
    text = text.withColumn("keep", F.col("long_enough") & (F.col("relevance_score") >= V.MIN_SCORE) & ~F.col("has_negative"))
    return text.drop("_terms", "search_keyword", "keyword_group")


def news_features(records: DataFrame) -> DataFrame:
    """Relevant news with a valid time: url, text_norm, section, published_utc, published_wib, relevance_score, matched_terms."""
    kept = news_stages(records).filter("keep").withColumn("published_utc", A.iso_utc(F.col("published"))).filter("published_utc is not null")
    return kept.select(
        "url", T.normal_terms(F.col("text_clean")).alias("text_norm"), "section", "published_utc",
        A.market_time(F.col("published_utc")).alias("published_wib"), "relevance_score", "matched_terms",
    )


def transformer_news(records: DataFrame, rates: DataFrame, count_tokens=subword_count) -> DataFrame:
    """One row per url with text for a transformer, subword and chunk counts and alignment; rows without time have no target."""
    r = records.withColumn("url", F.btrim("url", F.lit(T.WHITE)))
    one = r.join(keep_one(r.select("seq", "url"), ["url"], "seq").select("seq"), "seq", "left_semi")
    empty = F.length(F.coalesce(F.col("body"), F.lit(""))) == 0
    rest = F.when(empty, F.col("description")).otherwise(F.col("body"))
    t = one.withColumns({"_title": T.clean_transformer(F.col("title")), "_rest": T.clean_transformer(rest), "used_description_fallback": empty})
    t = T.computed_once(t, {"text_clean": F.btrim(T.transformer_text(F.col("_title"), F.col("_rest")))}).filter(F.length("text_clean") > 0)
    t = T.computed_once(t, {"n_tokens": count_tokens(F.col("text_clean"))}).withColumn("needs_chunking", F.col("n_tokens") > V.CHUNK_TOKENS)
    t = t.withColumn("n_chunks_est", T.chunks_needed(F.col("n_tokens"))).withColumn("published_utc", A.iso_utc(F.col("published")))
    t = A.align(t, rates).withColumn("date", F.date_format("published_wib", "yyyy-MM-dd hh:mm:ss a 'WIB'"))
    return t.select(
        "url", "date", "title", "text_clean", "n_tokens", "needs_chunking", "n_chunks_est", "used_description_fallback", "section",
        "target_date", "is_offhours", "hours_to_fixing", "target_date_lag1",
    )


def aligned_news(features: DataFrame, rates: DataFrame) -> DataFrame:
    """Features with their target day; rows after the last fixing are left out."""
    counted = features.withColumn("n_tokens", T.token_count(F.coalesce(F.col("text_norm"), F.lit(""))))
    return A.align(counted, rates).filter("target_date is not null")


def daily_table(features: DataFrame, rates: DataFrame, with_text: bool = True) -> DataFrame:
    """A row per trading day, with the day's texts in one value; a corpus whose days outgrow a row leaves them out (``with_text=False``)
    and has them row by row from :func:`alignment.daily_texts`."""
    return A.aligned_daily(rates, A.daily_news(aligned_news(features, rates), with_text))


def land_aligned(features: DataFrame, rates: DataFrame, path: str) -> DataFrame:
    """The aligned news as a new table by month; an existing path is an error, so no table is written over what it is read from."""
    aligned_news(features, rates).withColumn("month", F.date_format("target_date", "yyyy-MM")).write.mode("errorifexists").partitionBy("month").parquet(path)
    return features.sparkSession.read.parquet(path)


def funnel_stages() -> list[tuple[str, Column]]:
    """Stages that rows of :func:`funnel_flags` pass on their way to the features."""
    return [(name, F.col(name)) for name in ("first of url", "first of title", "text article", "long enough", "relevant", "timed")]


def funnel_flags(records: DataFrame) -> DataFrame:
    """For each record a flag for each stage; stages past the first that fails are false."""
    r = records.select("seq", F.btrim("url", F.lit(T.WHITE)).alias("url"), T.title_key(F.coalesce(F.col("title"), F.lit("nan"))).alias("_key"))
    by_url = keep_one(r, ["url"], "seq")
    by_title = keep_one(by_url, ["_key"], "seq").select("seq", F.lit(True).alias("first of title"))
    told = news_stages(records).select("seq", F.lit(True).alias("text article"), F.col("long_enough").alias("long enough"), F.col("keep").alias("relevant"), A.iso_utc(F.col("published")).isNotNull().alias("timed"))
    out = r.select("seq").join(by_url.select("seq", F.lit(True).alias("first of url")), "seq", "left").join(by_title, "seq", "left").join(told, "seq", "left")
    return out.na.fill(False)
