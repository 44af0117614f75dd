import random

import numpy as np
import pytest

from marketweave.llm.nearest_time import LearnedIndex, nearest_in_time

LEFT, RIGHT = "seq long, k string, t long, _id int", "q long, k string, t long, _t int"


def brute(left, right, tolerance):
    out = {}
    for seq, k, t in left:
        near = [(abs(u - t), q) for q, kk, u in right if None not in (k, t, kk, u) and kk == k and abs(u - t) <= tolerance]
        if near:
            out[seq] = min(near)[::-1]
    return out


@pytest.mark.parametrize("hot", [5, 200_000])
def test_against_brute_force(spark, hot):
    rng = random.Random(3)
    key = lambda: rng.choice(["a", "a", "a", "b", None])
    time = lambda: rng.choice([None, rng.randrange(-5000, 5000), rng.randrange(0, 50)])
    left = [(i, key(), time()) for i in range(300)]
    right = [(i % 250, key(), time()) for i in range(300)]
    l = spark.createDataFrame([(*r, 0) for r in left], LEFT)
    r = spark.createDataFrame([(*x, 0) for x in right], RIGHT)
    got = {x.seq: (x.q, x.distance_us) for x in nearest_in_time(l, r, "k", "seq", "t", "q", "t", 40, hot_rows=hot, bucket_rows=50).collect()}
    assert got == brute(left, right, 40)


def test_ties_and_empty(spark):
    l = spark.createDataFrame([(1, "a", 10, 0), (2, "a", 100, 0)], LEFT)
    r = spark.createDataFrame([(9, "a", 5, 0), (7, "a", 15, 0), (8, "a", 15, 0), (7, "a", 15, 0)], RIGHT)
    assert [tuple(x) for x in nearest_in_time(l, r, "k", "seq", "t", "q", "t", 5).collect()] == [(1, 7, 5)]
    assert nearest_in_time(l.limit(0), r, "k", "seq", "t", "q", "t", 5).count() == nearest_in_time(l, r.limit(0), "k", "seq", "t", "q", "t", 5).count() == 0


def test_index_finds_every_position():
    rng = np.random.default_rng(1)
    parts = [np.sort(rng.integers(0, 10**int(e), n)) for e, n in ((3, 500), (12, 300), (1, 200), (6, 1))] + [np.zeros(0, np.int64)]
    parts[1][-5:] += 10**15
    times, start = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    times[start[1]:start[2]].sort()
    index = LearnedIndex(times, start)
    for s in range(len(parts)):
        a, b = start[s], start[s + 1]
        q = np.concatenate([times[a:b], times[a:b] + 1, times[a:b] - 1, [-1, 10**17]])
        assert (index.lower_bound(np.full(len(q), s), q) == a + np.searchsorted(times[a:b], q)).all()


def test_hot_entity(spark):
    rng = random.Random(5)
    left = [(i, "hot" if i % 3 == 0 else f"k{i % 40}", rng.randrange(0, 3000)) for i in range(1500)]
    right = [(i, "hot" if i % 2 == 0 else f"k{i % 40}", rng.randrange(0, 3000)) for i in range(1500)]
    l = spark.createDataFrame([(*r, 0) for r in left], LEFT)
    r = spark.createDataFrame([(*x, 0) for x in right], RIGHT)
    got = {x.seq: (x.q, x.distance_us) for x in nearest_in_time(l, r, "k", "seq", "t", "q", "t", 100, hot_rows=100, bucket_rows=200).collect()}
    assert got == brute(left, right, 100)
