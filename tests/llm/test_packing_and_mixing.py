from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketweave.llm.mixing import allot, draw_range, draw_shards, hypergeometric, mix_sources, permuted
from marketweave.llm.packing import pack, pack_items
from marketweave.llm.tokens import TOKENIZER, count_tokens, encoder, with_token_counts


@settings(deadline=None)
@given(st.lists(st.integers(0, 60), max_size=80))
def test_pack_is_valid_and_tight(sizes):
    bins = pack(np.array(sizes, np.int64), 60)
    held = Counter()
    for b, s in zip(bins, sizes):
        held[b] += s
    assert all(v <= 60 for v in held.values())
    least = -(-sum(sizes) // 60)
    assert len([v for v in held.values() if v]) <= max(1, 1.5 * least + 2)


def test_large_items_go_at_most_two_to_a_container():
    sizes = np.array([25] * 30)
    assert max(Counter(pack(sizes, 60).tolist()).values()) == 2


@pytest.mark.parametrize("shard", [7, 50_000])
def test_pack_items(spark, shard):
    rows = [(i, n) for i, n in enumerate([10, 5000, 2048, 2049, 0, None, 700, 700, 700, 1300, 4096, 1])] + [(3, 2049), (None, 10), (2**60 + 1, 3)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, tokens long, container string")
    got = pack_items(df, "doc_id", "tokens", shard_items=shard).collect()
    held, parts = Counter(), defaultdict(list)
    for r in got:
        held[r.container] += r.part_size
        parts[r.doc_id].append((r.part_no, r.part_start, r.part_size))
    assert max(held.values()) <= 2048 and set(parts) == {r[0] for r in rows}
    assert sum(held.values()) == sum(n or 0 for _, n in rows)
    assert sorted(parts[1]) == [(1, 0, 2048), (2, 2048, 2048), (3, 4096, 904)] and sorted(parts[10]) == [(1, 0, 2048), (2, 2048, 2048)]
    assert all(len(p) == 1 for k, p in parts.items() if k in (0, 2, 4, 5, 6, 7, 8, 9, 11))
    assert pack_items(df.limit(0), "doc_id", "tokens").count() == 0


def test_token_counts(spark):
    texts = ["", None, "Hello world", "Größe 12 kg", "x" * 250_000, "a b\n" * 60_000, "<|endoftext|>"]
    df = spark.createDataFrame([(2**60 + i, t, None, 5) for i, t in enumerate(texts)], "doc_id long, text string, source string, tokens int")
    got = {r.doc_id - 2**60: r.tokens for r in with_token_counts(df, ["doc_id", "source"]).collect()}
    for i, t in enumerate(texts):
        if t and len(t) < 1000:
            assert got[i] == len(encoder(TOKENIZER).encode_ordinary(t))
    assert got[0] == got[1] == 0 and got[4] > 0
    assert abs(got[5] - len(encoder(TOKENIZER).encode_ordinary(texts[5]))) <= 4


def test_allot():
    assert allot(np.array([100, 100]), np.array([0.5, 0.5]), np.array([3, 3]), 200).tolist() == [100, 100]
    assert allot(np.array([10, 100]), np.array([0.5, 0.5]), np.array([1, 3]), 110).tolist() == [10, 100]
    assert allot(np.array([0, 100]), np.array([0.5, 0.5]), np.array([1, 3]), 100).tolist() == [0, 100]
    assert allot(np.array([10, 10]), np.array([0.9, 0.1]), np.array([1, 1]), 100).tolist() == [10, 10]
    drawn = draw_shards(np.array([7, 0, 93]), 4, 1)
    assert drawn.sum(axis=0).tolist() == [7, 0, 93] and drawn.sum(axis=1).tolist() == [25, 25, 25, 25]


def test_permutation(spark):
    for n in (1, 2, 5, 64, 1000):
        x = [r.x for r in spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(9).cast("long")).alias("x")).collect()]
        assert sorted(x) == list(range(n)) and (n < 64 or x != sorted(x))


def test_mix(spark):
    rng = np.random.default_rng(2)
    docs = [(i, s, int(rng.integers(0, 900))) for i, s in enumerate(rng.choice(["a", "a", "a", "b", "c", "x"], 3000))] + [(9001, None, 50), (9002, "a", 0), (None, "a", 5), (9003, "b", 3000)]
    counted = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, source string, tokens long, slot int")
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.6, 2), ("c", 0.1, 5), ("none", 0.0, 3)], "source string, target_share double, max_repeats int")
    mix, shares = mix_sources(counted, targets, block=64, shard_slots=500)
    total = sum(n for i, s, n in docs if s in ("a", "b", "c") and i is not None)
    used, per = defaultdict(list), Counter()
    sizes = {i: n for i, _, n in docs}
    for r in mix.collect():
        used[r.doc_id, r.token_start].append(r.round)
        per[r.source] += r.token_count
        assert 0 <= r.token_start and r.token_start + r.token_count <= sizes[r.doc_id]
    cap = {"a": 2, "b": 2, "c": 5}
    source = {i: s for i, s, _ in docs}
    assert all(len(v) <= cap[source[d]] and len(set(v)) == len(v) for (d, _), v in used.items())
    assert abs(sum(per.values()) - total) < 0.01 * total
    got = {r.source: r for r in shares.collect()}
    own_b = sum(n for _, s, n in docs if s == "b")
    want_b = min(0.6, 2 * own_b / total)
    assert abs(got["b"].reached_share - want_b) < 0.01 and got["none"].tokens == 0
    assert abs(got["a"].reached_share / got["c"].reached_share - 3) < 0.2
    again = mix_sources(counted, targets, block=64, shard_slots=500)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mix.collect()))


def test_mix_of_nothing(spark):
    counted = spark.createDataFrame([], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 1.0, 1), (None, None, None)], "source string, target_share double, max_repeats int")
    mix, shares = mix_sources(counted, targets)
    assert mix.count() == 0 and [r.tokens for r in shares.collect()] == [0]
    some = spark.createDataFrame([(1, "a", 10)], "doc_id long, source string, tokens long")
    assert mix_sources(some, targets.limit(0))[0].count() == 0


def test_ranges_of_shards_fit_together():
    slots = np.array([5, 0, 310, 77])
    whole = draw_shards(slots, 13, 3)
    assert whole.sum(axis=0).tolist() == slots.tolist() and set(whole.sum(axis=1).tolist()) <= {30, 31}
    for low, high in ((0, 4), (4, 5), (5, 13)):
        for k, first, have in draw_range(slots, 13, 3, low, high):
            assert low <= k < high and have.tolist() == whole[k].tolist() and first.tolist() == whole[:k].sum(axis=0).tolist()


def test_large_draws():
    rng = np.random.default_rng(4)
    good, bad, n = 3 * 10**10, 7 * 10**10, 10**6
    got = np.array([hypergeometric(rng, good, bad, n) for _ in range(3000)])
    sd = (n * 0.3 * 0.7) ** 0.5
    assert abs(got.mean() - 0.3 * n) < 5 * sd / 3000 ** 0.5 and abs(got.std() / sd - 1) < 0.06
    assert hypergeometric(rng, 5, 10**10, 10**10 + 5) == 5 and hypergeometric(rng, 10**10, 0, 7) == 7 and hypergeometric(rng, 2, 10**12, 10**6) in (0, 1, 2)


def test_steps_count_as_the_whole():
    for text in ("Die Zahl 12,5 % stieg  auf\n\n 9 Mrd. -- so it's said ( x )\t " * 40, "a b" * 900, "ok. " * 500):
        assert count_tokens(text, TOKENIZER, step=97) == len(encoder(TOKENIZER).encode_ordinary(text))
