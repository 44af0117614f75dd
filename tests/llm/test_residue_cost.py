import random
import time

import numpy as np

from marketweave.llm import residue as R
from tests.llm.test_residue import OTHER, PROSE


def cpu_seconds(texts):
    def once():
        began = time.process_time()
        R.Units(vocabulary, texts)
        return time.process_time() - began

    vocabulary = R.Vocabulary()
    once()
    return min(once() for _ in range(7))


def test_a_text_with_quotes_and_dashes_costs_little_more():
    """Texts beyond ASCII aren't translated character by character: most hold none of the characters that are replaced."""
    plain = [f"{PROSE} {i} {OTHER}" for i in range(200)]
    quoted = [f"“{PROSE}” – {i} é {OTHER}" for i in range(200)]
    assert cpu_seconds(quoted) < 1.8 * cpu_seconds(plain)


def test_fold_is_the_whole_translation():
    rng, odd = random.Random(3), list(R._FOLD)
    for share in (0, 0.01, 0.1, 0.5):
        for _ in range(50):
            text = "".join(chr(rng.choice(odd)) if rng.random() < share else rng.choice("abé “–я%<\n") for _ in range(300))
            assert R.fold(text) == text.translate(R._FOLD)


def test_simhash_of_units_of_any_length():
    rng = np.random.default_rng(4)
    size = np.array([1, 2, 255, 256, 600, 3, 70_000, 50_000, 9])
    start, features = np.cumsum(size) - size, rng.integers(0, 1 << 63, size.sum(), np.uint64) * np.uint64(2) + np.uint64(1)
    for got, a, n in zip(R.simhashes(features, start), start, size):
        ones = np.unpackbits(features[a:a + n].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        assert got == np.packbits(ones * 2 > n).view(np.uint64)[0]


def test_every_notation_passes_the_quick_look():
    for mark in ("{{a}}", "{% if x %}", "<%= x %>", "${a.b}", "#{x}", "{city}", "[[x]]", "<<X>>", "@@x@@", "__X__", "%X_Y%", "$X_Y$", "*|X|*", "[your quote 1]", "[quote 1 TK]"):
        assert R.has_placeholder(f"a {mark} b") == R.PLACEHOLDERS.search(mark)[0]


def test_standing_lines_are_found_once(spark, monkeypatch):
    """Rounds that spread labels don't count again in how many bodies of a source a unit is."""
    heads, causes = ["404 Not Found", "Gatekeeper says no", "503 Service Unavailable"], ["the story kiln went cold today", "a clerk lost the ledger of pages", "nobody fed the page engine"]
    rows = [(i, f"{heads[i // 3 * 2]}: {c} (X{i}7)") for i, c in enumerate(causes * 2)] + [(100 + i, f"{heads[1]}: {c} (X{i}7)") for i, c in enumerate(causes)]
    rows += [(200 + i, f"Outlet line\n{chr(97 + i) * 5} {PROSE}") for i in range(12)] + [(300, f"Outlet line\n{heads[1]}: shut"), (301, f"Outlet line\n{PROSE} {OTHER} {heads[0]}")]
    searched, whole = [], R.standing_lines
    monkeypatch.setattr(R, "standing_lines", lambda *a: searched.append(a) or whole(*a))
    got = {r.seq for r in R.residue_articles(spark.createDataFrame(rows, "seq long, body string")).collect()}
    assert got == {*range(6), 100, 101, 102, 300}
    assert len(searched) == 1


def test_units_meet_alike_by_few_keys_and_by_the_table(spark, monkeypatch):
    long = "scripts are disabled in this reader and the article of the day will only be shown once you allow them to run"
    rows = [(0, long), (1, long.replace("scripts are", "programs are", 1)), (2, long + " again"), (3, PROSE), (4, OTHER)]
    df = spark.createDataFrame(rows, "seq long, body string")
    units = R.text_units(df, "seq", "body")
    looked, meet = [], R._meeting
    monkeypatch.setattr(R, "_meeting", lambda *a: looked.append(a) or meet(*a))
    found = [sorted(R.spread_labels(df, "seq", "body", units, bound).collect()) for bound in (500_000, 1)]
    assert len(found[0]) == 3 and found[0] == found[1]
    assert looked and len(looked) <= 3  # the second time only
