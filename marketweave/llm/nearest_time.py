"""Pairing rows of two tables with the nearest row in time of the same entity, within a tolerance.

Entity-time shards hold sorted arrays. A piecewise-linear learned index per shard predicts the position of a query time with a
known error bound, and a search inside that bound gives the exact neighbours. Shards overlap at their edges by the tolerance.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweave.session import cut_lineage, small_side

#: Points that one linear piece of the index covers.
SEGMENT = 64


def bounded_search(values: np.ndarray, query: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each query the first position in [lo, hi) whose value is not below it, or hi; values are sorted in each range."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        below = np.zeros(len(lo), bool)
        below[open_] = values[mid[open_]] < query[open_]
        lo = np.where(open_ & below, mid + 1, lo)
        hi = np.where(open_ & ~below, mid, hi)


class LearnedIndex:
    """Linear pieces over the sorted times of many shards; ``start`` has the shards' offsets and the total at its end."""

    def __init__(self, times: np.ndarray, start: np.ndarray):
        self.times, self.start = times, start
        sizes = np.diff(start)
        pieces = -(-sizes // SEGMENT)
        self.first = np.concatenate([[0], np.cumsum(pieces)])
        shard = np.repeat(np.arange(len(sizes)), pieces)
        self.begin = start[shard] + (np.arange(len(shard)) - self.first[shard]) * SEGMENT
        self.end = np.minimum(self.begin + SEGMENT, start[shard + 1])
        self.low = times[self.begin] if len(self.begin) else np.empty(0, np.int64)
        span = times[self.end - 1] - self.low if len(self.begin) else np.empty(0, np.int64)
        steps = self.end - 1 - self.begin
        self.slope = np.where(span > 0, steps / np.maximum(span, 1), 0.0)
        piece = np.repeat(np.arange(len(self.begin)), self.end - self.begin)
        at = np.arange(len(times))
        miss = np.abs(self._predict(piece, times) - at)
        self.error = np.zeros(len(self.begin), np.int64)
        np.maximum.at(self.error, piece, miss)

    def _predict(self, piece: np.ndarray, t: np.ndarray) -> np.ndarray:
        return self.begin[piece] + np.rint((t - self.low[piece]) * self.slope[piece]).astype(np.int64)

    def lower_bound(self, shard: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Position of the first time of the shard that is not below t, or the shard's end."""
        begin, end = self.start[shard], self.start[shard + 1]
        at = bounded_search(self.low, t, self.first[shard], self.first[shard + 1])
        piece = np.maximum(at - 1, self.first[shard])
        some = end > begin
        out = begin.copy()
        p, q = piece[some], t[some]
        guess = np.clip(self._predict(p, q), self.begin[p], self.end[p])
        lo = np.maximum(self.begin[p], guess - self.error[p] - 1)
        hi = np.minimum(self.end[p], guess + self.error[p] + 2)
        found = bounded_search(self.times, q, lo, hi)
        # outside the bound (it can't be, but for rounding) the whole piece is searched
        off = ((found > self.begin[p]) & (self.times[np.maximum(found - 1, 0)] >= q)) | (
            (found < self.end[p]) & (self.times[np.minimum(found, len(self.times) - 1)] < q)
        )
        if off.any():
            found[off] = bounded_search(self.times, q[off], self.begin[p][off], self.end[p][off])
        out[some] = found
        return out


def match_shards(left: pd.DataFrame, right: pd.DataFrame, tolerance: int) -> pd.DataFrame:
    """Exact nearest neighbours of one bucket of shards; columns _k, _c, _f, _s name the shard, _t the time, _id the row."""
    empty = pd.DataFrame({"_l": pd.Series(dtype="int64"), "_r": pd.Series(dtype="int64"), "_d": pd.Series(dtype="int64")})
    if left.empty or right.empty:
        return empty
    both = pd.concat([right[["_k", "_c", "_f", "_s"]], left[["_k", "_c", "_f", "_s"]]], ignore_index=True)
    shard = both.groupby(["_k", "_c", "_f", "_s"], sort=False).ngroup().to_numpy()
    rs, ls = shard[: len(right)], shard[len(right):]
    rt, rid = right["_t"].to_numpy(np.int64), right["_id"].to_numpy(np.int64)
    order = np.lexsort((rid, rt, rs))
    rs, rt, rid = rs[order], rt[order], rid[order]
    start = np.searchsorted(rs, np.arange(shard.max() + 2))
    lt = left["_t"].to_numpy(np.int64)
    after = LearnedIndex(rt, start).lower_bound(ls, lt)
    before = after - 1
    far = np.iinfo(np.int64).max
    n = len(rt)
    has_after, has_before = after < start[ls + 1], before >= start[ls]
    d_after = np.where(has_after, rt[np.minimum(after, n - 1)] - lt, far)
    d_before = np.where(has_before, lt - rt[np.maximum(before, 0)], far)
    id_after = np.where(has_after, rid[np.minimum(after, n - 1)], far)
    id_before = np.where(has_before, rid[np.maximum(before, 0)], far)
    take_before = (d_before < d_after) | ((d_before == d_after) & (id_before < id_after))
    out = pd.DataFrame({"_l": left["_id"], "_r": np.where(take_before, id_before, id_after), "_d": np.where(take_before, d_before, d_after)})
    return out[out["_d"] <= tolerance]


def nearest_in_time(
    left: DataFrame, right: DataFrame, key: str, left_id: str, left_us: str, right_id: str, right_us: str, tolerance_us: int,
    hot_rows: int = 200_000, bucket_rows: int = 200_000,
) -> DataFrame:
    """One row per row of ``left`` that has a partner: left id, right id, ``distance_us``.

    Of equally near partners the smaller right id counts. Rows with null key, time or id have no partner; repeated rows of
    ``right`` count once, of ``left`` (same id) give a row each. Ids must be bigint. An empty table gives an empty result.
    Other columns are ignored; if both ids have one name, the right one comes
    out with ``right_`` before it. A key and time shard with more than ``hot_rows`` rows is cut into
    shards as wide as the tolerance and its left rows are spread by id, so no task grows with one key.
    """
    width = 8 * tolerance_us
    shard = lambda t, w: F.floor(t / F.lit(w)).cast("bigint")
    l = left.select(F.col(key).alias("_k"), F.col(left_us).cast("bigint").alias("_t"), F.col(left_id).cast("bigint").alias("_id")).dropna()
    r = right.select(F.col(key).alias("_k"), F.col(right_us).cast("bigint").alias("_t"), F.col(right_id).cast("bigint").alias("_id")).dropna()
    r = r.groupBy("_k", "_t").agg(F.min("_id").alias("_id"))
    l = cut_lineage(l.withColumn("_c", shard(F.col("_t"), width)))
    r = cut_lineage(r.withColumn("_c", F.explode(F.sequence(shard(F.col("_t") - tolerance_us, width), shard(F.col("_t") + tolerance_us, width)))))
    n_left, n_right = l.count(), r.count()
    sizes = l.select("_k", "_c", F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionAll(r.select("_k", "_c", F.lit(0), F.lit(1)))
    hot = sizes.groupBy("_k", "_c").agg(F.sum("_l").alias("_nl"), F.sum("_r").alias("_nr")).filter(F.col("_nl") + F.col("_nr") > hot_rows)
    # at most one in hot_rows of all rows is left; beyond that bound the join shuffles
    hot, _ = small_side(hot.select("_k", "_c", F.ceil(F.col("_nl") / F.lit(hot_rows)).cast("int").alias("_salts")), 100_000)
    is_hot = F.col("_salts").isNotNull()
    l = l.join(hot, ["_k", "_c"], "left").select(
        "_k", "_c", "_t", "_id",
        F.when(is_hot, shard(F.col("_t"), tolerance_us)).otherwise(F.lit(-1)).alias("_f"),
        F.when(is_hot & (F.col("_salts") > 1), F.pmod(F.xxhash64("_id"), F.col("_salts")).cast("int")).otherwise(F.lit(0)).alias("_s"),
    )
    fine = F.when(
        is_hot,
        F.sequence(
            F.greatest(shard(F.col("_t") - tolerance_us, tolerance_us), F.col("_c") * 8),
            F.least(shard(F.col("_t") + tolerance_us, tolerance_us), F.col("_c") * 8 + 7),
        ),
    ).otherwise(F.array(F.lit(-1).cast("bigint")))
    salts = F.sequence(F.lit(0), F.greatest(F.coalesce(F.col("_salts"), F.lit(1)), F.lit(1)) - 1)
    r = r.join(hot, ["_k", "_c"], "left").withColumn("_f", F.explode(fine)).withColumn("_s", F.explode(salts)).drop("_salts")
    buckets = max(16, math.ceil((n_left + n_right) / bucket_rows))
    bucket = F.pmod(F.xxhash64("_k", "_c", "_f", "_s"), F.lit(buckets)).alias("_b")
    l, r = l.select("*", bucket), r.select("*", bucket)
    out = l.groupBy("_b").cogroup(r.groupBy("_b")).applyInPandas(
        lambda a, b: match_shards(a, b, tolerance_us), "_l bigint, _r bigint, _d bigint"
    )
    right_name = right_id if right_id != left_id else f"right_{right_id}"
    return out.select(F.col("_l").alias(left_id), F.col("_r").alias(right_name), F.col("_d").alias("distance_us"))
