"""Timestamps of mixed notation, settled by expectation-maximisation over each source's mixture of readings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketweave.functions.timestamps import readings
from marketweave.session import shared_table, small_side

#: Likelihood that a value that was never meant as an instant still reads as one, whatever it reads as.
NOISE_LIKELIHOOD = 5e-5
#: A source's known habit counts as much as so many values that only the other order can read.
HABIT_VALUES = 20
#: Distances from the expected time, in days by powers of two; then after the latest possible time, and nothing expected.
AFTER, UNKNOWN = 14, 15
#: Least likelihood of a distance, however few values of a source have it.
LEAST_NEAR = 1e-3
COMPONENTS = ("main", "other", "noise")


def mixture_posteriors(pdf: pd.DataFrame, iterations: int = 100, tolerance: float = 1e-9) -> pd.DataFrame:
    """EM on the counts of one source's family of notations.

    ``pdf`` has ``has_main``, ``has_other``, the distances ``near_main`` and ``near_other`` (-1 where there is no reading), ``n`` and
    the habit ``day_first`` (null if unknown). A source writes its dates in one order, which is not known: day before month, the
    main reading, or month before day, the other. Under an order a value's likelihood is that of the distance of its reading, or of
    noise. E-step: the order's posterior from all values of the source and its habit, and each value's share of noise under each
    order. M-step: the weight of noise and the distribution of distances. A value's posterior of a reading is the order's times the
    reading's under it, so a tie stays unresolved.
    """
    n = pdf["n"].to_numpy(float)
    valid = np.column_stack([pdf["has_main"], pdf["has_other"]]).astype(bool)
    near = np.column_stack([pdf["near_main"], pdf["near_other"]]).astype(int)
    near[~valid] = UNKNOWN
    prior = np.zeros(2)
    habit = pdf["day_first"].iloc[0]
    if pdf["family"].iloc[0] != "numeric":
        prior[1] = -np.inf
    elif habit is not None and not pd.isna(habit):
        prior[1 if habit else 0] = HABIT_VALUES * np.log(NOISE_LIKELIHOOD)
    closeness = 0.5 ** np.arange(UNKNOWN + 1.0)
    closeness[UNKNOWN] = 1.0
    closeness /= closeness.sum()
    noise, before = 0.05, np.zeros(2)
    for _ in range(iterations):
        read = np.where(valid, (1 - noise) * np.maximum(closeness, LEAST_NEAR)[near], 0.0)
        share = read / (read + noise * NOISE_LIKELIHOOD)
        order = prior + (n[:, None] * np.log(read + noise * NOISE_LIKELIHOOD)).sum(axis=0)
        order = np.exp(order - order.max())
        order /= order.sum()
        meant = n[:, None] * share * order
        noise = (1 + (n.sum() - meant.sum())) / (2 + n.sum())
        closeness = np.bincount(near.ravel(), weights=meant.ravel(), minlength=UNKNOWN + 1) + 1 / (UNKNOWN + 1)
        closeness /= closeness.sum()
        if np.abs(order - before).max() < tolerance:
            break
        before = order
    posterior = np.column_stack([share * order, 1 - (share * order).sum(axis=1)])
    out = pdf[["source", "family", "has_main", "has_other", "near_main", "near_other"]].copy()
    out["reading"] = np.array(COMPONENTS)[posterior.argmax(axis=1)]
    out["posterior"] = posterior.max(axis=1)
    return out


def _nearness(instant: Column, expected: Column, latest: Column) -> Column:
    days = F.abs(instant - expected) / F.lit(86_400_000_000)
    power = F.least(F.floor(F.log2(days + 1)), F.lit(AFTER - 1)).cast("int")
    after = F.coalesce(instant > latest + F.lit(86_400_000_000), F.lit(False))
    return F.when(instant.isNull(), -1).when(after, AFTER).when(expected.isNull(), UNKNOWN).otherwise(power)


def normalise_timestamps(
    df: DataFrame, value: str, source: str, habits: DataFrame, least_posterior: float = 0.95, max_broadcast_rows: int = 100_000,
    expected_us: Column | None = None, latest_us: Column | None = None,
) -> DataFrame:
    """``df`` with ``utc_us bigint``, ``reading_status string`` and ``reading_posterior double``.

    ``habits`` has one row per source: ``source``, ``tz`` (IANA), ``day_first`` (may be null, and is a prior only: the source's own
    values show the order). ``expected_us`` is a time that values should be near, ``latest_us`` one that they can't be after; both
    may be null. Status is ``resolved``; ``ambiguous``, where no reading reaches ``least_posterior`` and utc_us is null; or
    ``no_instant`` for null, blank, date-only, unknown and impossible values, and for values without zone of a source whose zone is
    null or unknown. Repeated rows stay. Extra columns stay, but for those with the three new names, which are replaced, and those
    that begin with ``_ts_``, which go. An empty table gives an empty result. Values are parsed once and ``df`` is written to the
    shared folder with what they read as, so leave columns of texts out of it.
    """
    h = habits.select(F.col("source").alias("_ts_source"), F.col("tz").alias("_ts_tz"), F.col("day_first").alias("_ts_day_first"))
    h = h.dropDuplicates(["_ts_source"])
    h, _ = small_side(h, max_broadcast_rows)
    none = F.lit(None).cast("bigint")
    df = df.withColumns({"_ts_expected": none if expected_us is None else expected_us, "_ts_latest": none if latest_us is None else latest_us})
    read = df.join(h, F.col(source) == F.col("_ts_source"), "left").withColumn("_ts_read", readings(F.col(value), F.col("_ts_tz")))
    keys = {"_ts_key": F.coalesce(F.col(source), F.lit("")), **{f"_ts_{x}": F.col(f"_ts_read.{x}") for x in ("family", "main", "other")}}
    read = read.withColumns(keys)
    for x in ("main", "other"):
        read = read.withColumns({f"_ts_has_{x}": F.col(f"_ts_{x}").isNotNull(), f"_ts_near_{x}": _nearness(F.col(f"_ts_{x}"), F.col("_ts_expected"), F.col("_ts_latest"))})
    read = shared_table(read.drop("_ts_source", "_ts_tz", "_ts_read", "_ts_expected", "_ts_latest"), "readings")
    names = ("family", "has_main", "has_other", "near_main", "near_other")
    counts = (
        read.filter(F.col("_ts_has_main") | F.col("_ts_has_other"))
        .groupBy(F.col("_ts_key").alias("source"), *(F.col(f"_ts_{x}").alias(x) for x in names))
        .agg(F.count(F.lit(1)).alias("n"), F.first("_ts_day_first").alias("day_first"))
    )
    # one group holds a few hundred rows at most (pairs of distances), whatever the number of values
    chosen = counts.groupBy("source", "family").applyInPandas(
        lambda pdf: mixture_posteriors(pdf),
        "source string, family string, has_main boolean, has_other boolean, near_main int, near_other int, reading string, posterior double",
    )
    chosen, _ = small_side(chosen, max_broadcast_rows)
    c = chosen.select(*(F.col(x).alias("_ts_c_" + x) for x in chosen.columns))
    on = F.col("_ts_key") == F.col("_ts_c_source")
    for x in names:
        on = on & (F.col(f"_ts_{x}") == F.col(f"_ts_c_{x}"))
    out = read.join(c, on, "left")
    sure = F.col("_ts_c_posterior") >= least_posterior
    instant = F.when(F.col("_ts_c_reading") == "main", F.col("_ts_main")).when(F.col("_ts_c_reading") == "other", F.col("_ts_other"))
    out = out.withColumn("utc_us", F.when(sure, instant)).withColumn("reading_posterior", F.col("_ts_c_posterior"))
    status = (
        F.when(F.col("utc_us").isNotNull(), "resolved")
        .when(F.col("_ts_c_reading").isin("main", "other") & ~sure, "ambiguous").otherwise("no_instant")
    )
    out = out.withColumn("reading_status", status)
    return out.drop(*[x for x in out.columns if x.startswith("_ts_")])


def article_instants(
    articles: DataFrame, sites: DataFrame, fields: tuple[str, ...] = ("published", "modified"), keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per article and field: seq, site, ``keep``, field, utc_us, reading_status, reading_posterior.

    Times are expected near the article's index date and not after it was fetched.
    """
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields)))
    us = lambda t: F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), t.cast("timestamp_ntz"))
    near = {"_near": us(F.try_to_date("index_date", "yyyy-MM-dd")), "_until": us(F.col("fetched_at"))}
    stacked = articles.select("seq", "site", *keep, each.alias("x"), *(c.alias(n) for n, c in near.items())).select("seq", "site", *keep, "x.field", "x.value", *near)
    habits = sites.select(F.col("site").alias("source"), "tz", "day_first")
    return normalise_timestamps(stacked, "value", "site", habits, expected_us=F.col("_near"), latest_us=F.col("_until")).drop(*near)
