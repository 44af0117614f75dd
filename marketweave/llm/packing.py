"""Filling containers of fixed capacity with items of varying length, little space left over.

Items over the capacity are cut into full containers and a rest. Items above a third of the capacity go at most two to a
container, matched greedily, the largest with the largest that still fits; smaller items best-fit the gaps that remain.
Sizes are whole numbers up to the capacity, so a shard is packed from its counts by size, not item by item.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweave.session import cut_lineage

CAPACITY = 2048


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item; sizes are from 0 to the capacity. Items of size 0 take part in the first container."""
    n = len(sizes)
    bins = np.zeros(n, np.int64)
    by_size: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in np.argsort(sizes, kind="stable").tolist():
        by_size[int(sizes[i])].append(i)
    third = capacity // 3
    present = 0  # bit s is set while an item of size s above a third is left
    for s in range(third + 1, capacity + 1):
        if by_size[s]:
            present |= 1 << s
    gaps: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit g is set while a container with gap g is open
    used = 0
    while present:
        s = present.bit_length() - 1
        i = by_size[s].pop()
        if not by_size[s]:
            present &= ~(1 << s)
        bins[i], gap = used, capacity - s
        fits = present & ((1 << (gap + 1)) - 1)
        if fits:
            t = fits.bit_length() - 1
            bins[by_size[t].pop()] = used
            if not by_size[t]:
                present &= ~(1 << t)
            gap -= t
        gaps[gap].append(used)
        open_ |= 1 << gap
        used += 1
    for s in range(third, 0, -1):
        for i in by_size[s]:
            fits = open_ >> s
            if fits:
                g = s + (fits & -fits).bit_length() - 1
                b = gaps[g].pop()
                if not gaps[g]:
                    open_ &= ~(1 << g)
            else:
                g, b, used = capacity, used, used + 1
            bins[i] = b
            gaps[g - s].append(b)
            open_ |= 1 << (g - s)
    return bins


def pack_items(
    df: DataFrame, item_id: str, size: str, capacity: int = CAPACITY, shard_items: int = 50_000,
) -> DataFrame:
    """Item id, ``container string``, ``part_no`` from 1, ``part_start``, ``part_size``, a row for each part of each item.

    Only an item over the capacity has more than one part: full containers of its own, and a rest that is packed like an item.
    Items of size null or 0 come out with size 0 in some container. Items with the same id are packed one by one. Shards of about
    ``shard_items`` items, formed by a hash of the id and a row's own salt, are packed apart; each leaves at most a few containers
    part empty. An empty table gives no rows. Other columns are not read.
    """
    # ids travel as text: a null among numbers would make them inexact
    items = cut_lineage(df.select(F.col(item_id).cast("string").alias("_id"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("_size")))
    shards = max(1, math.ceil(items.count() / shard_items))
    # copies of one id spread over all shards
    shard = F.pmod(F.xxhash64("_id", F.monotonically_increasing_id()), F.lit(shards)) if shards > 1 else F.lit(0).cast("bigint")
    items = items.withColumn("_shard", shard)
    id_type = dict(df.dtypes)[item_id]

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, sizes, shard = pdf["_id"].to_numpy(), pdf["_size"].to_numpy(np.int64), pdf["_shard"].iloc[0]
        order = np.lexsort((pdf["_id"].fillna("").to_numpy(str), sizes))  # the same packing of a shard whatever its rows' order
        ids, sizes = ids[order], sizes[order]
        full = np.where(sizes > capacity, sizes // capacity, 0)
        rest = sizes - full * capacity
        packed = np.flatnonzero((rest > 0) | (full == 0))
        bins = pack(rest[packed], capacity)
        top = bins.max() + 1 if len(bins) else 0
        whole = np.repeat(np.arange(len(ids)), full)
        part = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        at = np.concatenate([whole, packed])
        number = np.concatenate([part, full[packed]])
        container = np.concatenate([top + np.arange(len(whole)), bins])
        out = pd.DataFrame({"_id": ids[at], "container": [f"{shard}-{b}" for b in container], "part_no": number + 1, "part_start": number * capacity})
        return out.assign(part_size=np.concatenate([np.full(len(whole), capacity), rest[packed]]))

    out = items.groupBy("_shard").applyInPandas(fill, "_id string, container string, part_no bigint, part_start bigint, part_size bigint")
    return out.select(F.col("_id").cast(id_type).alias(item_id), "container", "part_no", "part_start", "part_size")
