import random

from marketweave.llm import residue as R


def test_near_duplicates_against_brute_force(spark):
    """Units of any length whose shingles are 0.8 alike meet, wherever they differ."""
    rng, seeds, others = random.Random(5), [], []
    for n in (8, 9, 12, 13, 16, 17, 30):
        for _ in range(12):
            words = ["".join(rng.choices("bcdfghklmnprstvw", k=7)) for _ in range(n - 4)]
            seed = ["scripts", "are", "disabled", "kindly", *words]
            assert R.label(seed) == R.NOTICE
            seeds.append(" ".join(seed))
            others += [" ".join(["programs", *seed[1:]]), " ".join([*seed, "zzadded"]), " ".join([*seed[:-1], "zzother"]), " ".join(["these", *seed[1:], "too"])]
    texts = seeds + others
    units = R.Units(R.Vocabulary(), texts)
    sets = [set(units.shingle_set(i)) for i in range(len(texts))]
    told = {i for i in range(len(texts)) if units.label(i) == R.NOTICE}
    while more := {i for i in range(len(texts)) if i not in told and any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in told)}:
        told |= more
    assert len(seeds) < len(told) < len(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, body string")
    assert {r.id for r in _labelled(df)} == told


def _labelled(df):
    units = R.text_units(df, "seq", "body")
    return units.join(R.spread_labels(df, "seq", "body", units), "h").select("id").distinct().collect()
