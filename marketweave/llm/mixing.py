"""One mix of several sources in target shares of all tokens, with capped repetition.

Each source's documents are cut into blocks of a fixed number of tokens. Output shards draw how many slots each source has from
a multinomial with the targets, held to the sources' totals, each range of shards on its own executor; a source's slots map to its blocks through pseudorandom
permutations of the block numbers, one for each round through the source; slots join blocks by number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketweave.session import cut_lineage

BLOCK_TOKENS = 256
#: Sources of a mix are a table kept by hand; beyond so many the plan on the driver is refused.
MAX_SOURCES = 100_000


def allot(available: np.ndarray, share: np.ndarray, repeats: np.ndarray, total: int) -> np.ndarray:
    """Units for each source that add up to ``total``: the target where the cap allows it, what capped ones lack in proportion
    from the others; less than ``total`` only if all caps are reached."""
    cap = available * repeats
    want, fixed = np.zeros(len(share)), np.zeros(len(share), bool)
    while True:
        free = ~fixed & (share > 0) & (cap > 0)
        if not free.any():
            break
        left = total - cap[fixed].sum()
        want[free] = left * share[free] / share[free].sum()
        over = free & (want > cap)
        if not over.any():
            break
        want[over], fixed = cap[over], fixed | over
    want = np.minimum(want, cap)
    out = np.floor(want).astype(np.int64)
    short = int(min(total, round(want.sum())) - out.sum())
    for i in np.argsort(-(want - out), kind="stable"):
        if short <= 0:
            break
        if out[i] < cap[i]:
            out[i] += 1
            short -= 1
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` drawn from ``good`` and ``bad`` are good; an exact draw at any size.

    numpy draws up to a thousand million; beyond, a ratio of uniforms on the probabilities themselves is accepted or rejected.
    """
    if good == 0 or n == 0:
        return 0
    if bad == 0 or n == good + bad:
        return min(n, good)
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    whole, lowest, highest = good + bad, max(0, n - bad), min(n, good)
    weight = lambda k: -(lgamma(k + 1) + lgamma(good - k + 1) + lgamma(n - k + 1) + lgamma(bad - n + k + 1))
    peak = weight(min(max((n + 1) * (good + 1) // (whole + 2), lowest), highest))
    middle = n * good / whole + 0.5
    # the hat's width for a distribution of this variance, with Stadlober's constants
    width = 1.7155277699214135 * math.sqrt(n * (good / whole) * (bad / whole) * (whole - n) / (whole - 1) + 0.5) + 0.8989161620588988
    while True:
        u, v = rng.random(), rng.random()
        if not u:
            continue
        at = middle + width * (v - 0.5) / u
        if lowest <= at < highest + 1 and 2 * math.log(u) <= weight(k := math.floor(at)) - peak:
            return k


def draw_range(slots: np.ndarray, shards: int, seed: int, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of output shards ``low`` to ``high``: number, slots of each source before it, and slots of each source in it.

    Multinomial draws, given that the shards add up to the sources' totals: halves of the shards share out what they have, down to
    single shards. Each split is seeded by its place, so any range can be drawn on its own and fits the others.
    """
    total = int(slots.sum())
    upto = lambda k: -(-total * k // shards)

    def share(a: int, b: int, have: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if b <= low or a >= high:
            return
        if b - a == 1:
            yield a, first, have
            return
        mid = (a + b) // 2
        rng, need, rest = np.random.default_rng([seed, a, b]), upto(mid) - upto(a), int(have.sum())
        left = np.zeros(len(have), np.int64)
        for i in np.flatnonzero(have):
            rest -= int(have[i])
            left[i] = hypergeometric(rng, int(have[i]), rest, need)
            need -= int(left[i])
        yield from share(a, mid, left, first)
        yield from share(mid, b, have - left, first + left)

    return share(0, shards, slots, np.zeros(len(slots), np.int64))


def draw_shards(slots: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Slots of each source in each output shard."""
    return np.array([have for _, _, have in draw_range(slots, shards, seed, 0, shards)]).reshape(shards, len(slots))


def permuted(index: Column, size: Column, key: Column) -> Column:
    """A pseudorandom permutation of 0 .. size-1 for each key: a Feistel network on the next power of four, walked until inside."""
    half = F.greatest(F.ceil(F.log2(F.greatest(size, F.lit(2)).cast("double")) / 2), F.lit(1)).cast("int")

    @F.pandas_udf("bigint")
    def walk(i: pd.Series, n: pd.Series, k: pd.Series, h: pd.Series) -> pd.Series:
        x, n, h = i.to_numpy(np.uint64).copy(), n.to_numpy(np.uint64), h.to_numpy(np.uint64)
        k = k.to_numpy(np.int64).view(np.uint64)
        mask = (np.uint64(1) << h) - np.uint64(1)
        todo = np.ones(len(x), bool)
        while todo.any():
            left, right, hh, m, kk = x[todo] >> h[todo], x[todo] & mask[todo], h[todo], mask[todo], k[todo]
            for r in range(4):
                with np.errstate(over="ignore"):
                    f = (right + kk + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15)
                    f ^= f >> np.uint64(32)
                    f *= np.uint64(0xD6E8FEB86659FD93)
                    f ^= f >> np.uint64(29)
                left, right = right, (left ^ f) & m
            x[todo] = (left << hh) | right
            todo &= x >= n
        return pd.Series(x.astype(np.int64))

    return walk(index, size, key, half)


def source_blocks(counted: DataFrame, block: int, chunk_docs: int = 20_000) -> DataFrame:
    """``source``, ``block_no`` from 0, ``doc_id``, ``token_start``, ``token_count``, ``block_tokens``: what each block holds.

    Chunks of a source's documents, by a hash of the id, are laid end to end and cut apart, so a source of any size is many
    tasks; the last block of a chunk may be short.
    """
    sizes = counted.groupBy("source").agg(F.count(F.lit(1)).alias("_n")).withColumn("_chunks", F.ceil(F.col("_n") / chunk_docs))
    docs = counted.filter("tokens > 0 and doc_id is not null").join(sizes, "source").withColumn("_chunk", F.pmod(F.xxhash64("doc_id"), F.col("_chunks")))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "tokens"])
        n = pdf["tokens"].to_numpy(np.int64)
        end = np.cumsum(n)
        begin = end - n
        first, last = begin // block, (end - 1) // block
        parts = last - first + 1
        doc = np.repeat(np.arange(len(n)), parts)
        number = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        a, b = np.maximum(begin[doc], number * block), np.minimum(end[doc], (number + 1) * block)
        held = np.minimum((number + 1) * block, end[-1]) - number * block
        return pd.DataFrame({
            "source": pdf["source"].iloc[0], "_chunk": pdf["_chunk"].iloc[0], "_local": number, "doc_id": pdf["doc_id"].to_numpy()[doc],
            "token_start": a - begin[doc], "token_count": b - a, "block_tokens": held,
        })

    schema = f"source string, _chunk bigint, _local bigint, doc_id {dict(counted.dtypes)['doc_id']}, token_start bigint, token_count bigint, block_tokens bigint"
    pieces = cut_lineage(docs.select("source", "_chunk", "doc_id", "tokens").groupBy("source", "_chunk").applyInPandas(cut, schema))
    # one row per chunk, i.e. one per chunk_docs documents and one per source at least
    per_chunk = pieces.groupBy("source", "_chunk").agg((F.max("_local") + 1).alias("_blocks"))
    before = Window.partitionBy("source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offset = per_chunk.select("source", "_chunk", F.coalesce(F.sum("_blocks").over(before), F.lit(0)).alias("_offset"))
    return pieces.join(offset, ["source", "_chunk"]).select(
        "source", (F.col("_offset") + F.col("_local")).alias("block_no"), "doc_id", "token_start", "token_count", "block_tokens"
    )


def mix_sources(
    counted: DataFrame, targets: DataFrame, block: int = BLOCK_TOKENS, shard_slots: int = 10_000, seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """The mix, and the shares that each source reached.

    ``counted`` has ``doc_id``, ``source``, ``tokens``; ``targets`` has ``source``, ``target_share``, ``max_repeats``. Mix: a row
    for each part of a document in a slot: ``shard``, ``slot``, ``source``, ``doc_id``, ``token_start``, ``token_count``, ``round``
    (from 0, below ``max_repeats``). Shares: ``source``, ``target_share``, ``reached_share``, ``tokens``, ``own_tokens``, ``capped``.
    The mix is as large as the documents whose source has a target, as far as the caps allow; what capped and empty sources
    lack goes to the others in proportion. Documents without id or source, or whose source has no target, are left out; a target that
    is null or not above 0, or ``max_repeats`` that is null or below 1, gives no slots. Empty tables give empty results.
    """
    spark = counted.sparkSession
    t = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    # read twice below; counting tokens is the costly part
    aimed = cut_lineage(counted.join(F.broadcast(t.limit(MAX_SOURCES + 1).select("source")), "source", "left_semi").select("doc_id", "source", "tokens"))
    blocks = cut_lineage(source_blocks(aimed, block))
    heads = blocks.select("source", "block_no", "block_tokens").distinct()
    held = heads.groupBy("source").agg(F.count(F.lit(1)).alias("blocks"), F.sum("block_tokens").alias("own_tokens"))
    plan = t.join(held, "source", "left").limit(MAX_SOURCES + 1).toPandas()  # a row per targeted source
    if len(plan) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} targeted sources")
    plan = plan.sort_values("source").fillna({"blocks": 0, "own_tokens": 0, "target_share": 0.0, "max_repeats": 0})
    n, own = plan["blocks"].to_numpy(np.int64), plan["own_tokens"].to_numpy(np.int64)
    share = np.maximum(plan["target_share"].to_numpy(float), 0)
    repeats = np.maximum(plan["max_repeats"].to_numpy(np.int64), 0)
    # tokens first, then blocks of each source's own mean size
    tokens = allot(own, share, repeats, int(own.sum()))
    slots = np.minimum(np.rint(tokens * n / np.maximum(own, 1)).astype(np.int64), n * repeats)
    shards = max(1, math.ceil(slots.sum() / shard_slots))
    # executors draw for ranges of shards; what they are sent is a number for each targeted source
    sources, task_shards = plan["source"].tolist(), 64

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for task in batch["id"].tolist():
                for k, first, have in draw_range(slots, shards, seed, task * task_shards, min((task + 1) * task_shards, shards)):
                    of = np.flatnonzero(have)
                    if not len(of):
                        continue
                    yield pd.DataFrame({
                        "shard": k, "source": [sources[i] for i in of], "_from": first[of], "_take": have[of], "_blocks": n[of],
                        "_at": (np.cumsum(have) - have)[of], "_key": of,
                    })

    schema = "shard bigint, source string, _from bigint, _take bigint, _blocks bigint, _at bigint, _key bigint"
    tasks = math.ceil(shards / task_shards)
    ranges = spark.range(0, tasks, 1, max(1, min(tasks, 10_000))).mapInPandas(draw, schema)
    # a shard's slots are at most shard_slots, and so are the rows that one range unfolds into
    spread_ = max(1, min(shards, 16 * spark.sparkContext.defaultParallelism))
    slot = ranges.repartition(spread_, "shard").select("*", F.explode(F.sequence(F.lit(0), F.col("_take") - 1)).alias("_i"))
    order = F.col("_from") + F.col("_i")
    slot = slot.withColumn("round", F.floor(order / F.col("_blocks")).cast("bigint"))
    key = F.xxhash64(F.lit(seed), F.col("_key"), F.col("round"))
    slot = slot.withColumn("block_no", permuted(F.pmod(order, F.col("_blocks")), F.col("_blocks"), key))
    # a shard's slots in an order that doesn't lay its sources side by side
    slot = slot.withColumn("slot", F.xxhash64(F.lit(seed), F.col("shard"), F.col("_at") + F.col("_i")))
    # slots look small to the planner, as they unfold from a few ranges, but are as many as blocks: never broadcast them
    mix = slot.select("shard", "slot", "source", "block_no", "round").hint("merge").join(blocks, ["source", "block_no"])
    mix = mix.select("shard", "slot", "source", "doc_id", "token_start", "token_count", "round")
    reached = slot.select("source", "block_no").hint("merge").join(heads, ["source", "block_no"]).groupBy("source").agg(F.sum("block_tokens").alias("tokens"))
    wanted = spark.createDataFrame(
        pd.DataFrame({"source": plan["source"], "target_share": share, "own_tokens": own, "capped": tokens >= own * repeats}),
        "source string, target_share double, own_tokens bigint, capped boolean",
    )
    report = wanted.join(reached, "source", "left").na.fill(0, ["tokens"])
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # over a row per targeted source
    report = report.select(
        "source", "target_share", (F.col("tokens") / F.greatest(whole, F.lit(1))).alias("reached_share"), "tokens", "own_tokens", "capped"
    )
    return mix, report
