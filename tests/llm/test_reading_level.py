import random

import numpy as np
import pytest

from marketweave.llm import reading_level as R

EASY = "the dog ran to the old red house and sat by the fire with a cat".split()
HARD = "notwithstanding intergovernmental demilitarisation the macroeconomic accommodation institutionally renegotiated comprehensive reconciliation".split()


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        level = rng.randint(1, 5)
        words = [rng.choice(HARD if rng.random() < (level - 1) / 4 * 0.9 + 0.05 else EASY) for _ in range(rng.randint(80, 300))]
        out.append((i, " ".join(words), level))
    return out


def test_isotonic():
    x, y = R.isotonic(np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 4]))
    assert x.tolist() == [1, 1, 2, 3, 4, 4] and y.tolist() == [1, 1, 2.5, 2.5, 4, 4]
    rng = np.random.default_rng(0)
    a, b = rng.random(200), rng.random(200)
    assert (np.diff(R.isotonic(a, a + b)[1]) >= 0).all()


def test_held_out_accuracy(spark):
    docs = corpus(1200, 1)
    rated = [(i, level if i % 7 else max(1, level - 1), "r") for i, _, level in docs[:800]] + [(3, None, "s"), (99_999, 5, "s"), (5, 77, "s")]
    d = spark.createDataFrame([(i, t, "en", 0) for i, t, _ in docs] + [(5000, None, None, 0), (5001, "", None, 0), (None, docs[0][1], None, 0), (5002, docs[0][1], "xx", 0), (5003, "word " * 50_000, None, 0), (5004, "12 34", None, 0)], "doc_id long, text string, lang string, level int")
    out = R.reading_levels(d, spark.createDataFrame(rated, "doc_id long, level int, rater string")).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(docs) + 6
    test = [(got[i].level, level) for i, _, level in docs[800:]]
    assert np.mean([abs(a - b) <= 1 for a, b in test]) > 0.97 and np.mean([a == b for a, b in test]) > 0.6
    five = {(a == 5, b == 5) for a, b in test}
    assert (True, True) in five
    assert got[5000].level is None and got[5001].level is None and got[5002].level == got[0].level and got[5003].level is not None


def test_bounded_fit_and_nothing_to_fit(spark):
    docs = corpus(200, 2)
    d = spark.createDataFrame([(i, t, "en") for i, t, _ in docs], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, x) for i, _, x in docs], "doc_id long, level int")
    assert R.reading_levels(d, labels, max_fit_docs=50).filter("level is not null").count() == 200
    with pytest.raises(ValueError):
        R.fit(d, labels.limit(0))
    assert R.reading_levels(d.limit(0), labels).count() == 0


def test_fit_keeps_to_its_characters(spark):
    docs = corpus(60, 3)
    d = spark.createDataFrame([(i, t, "en") for i, t, _ in docs] + [(1000, "word " * 100_000, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, x) for i, _, x in docs] + [(1000, 3)], "doc_id long, level int")
    grader = R.fit(d, labels, max_fit_chars=400_000)
    assert "word" not in grader.models[0].ids and "word" not in grader.models[1].ids


def test_borders_are_monotone(spark):
    docs = corpus(300, 4)
    grader = R.LevelGrader([R.words(t) for _, t, _ in docs], np.array([float(x) for _, _, x in docs]), ["en"] * 300, np.arange(300) % 2)
    for x, y in grader.maps[None]:
        assert (np.diff(y) >= 0).all() and y.min() >= 0 and y.max() <= 1
