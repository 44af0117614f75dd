import unicodedata

import pytest

from marketweave.llm import unicode_forms as U

CASES = [  # text, one form, counts
    ("ｗｉｄｅ　ｔｅｘｔ", "wide text", True), ("ﬁne", "fine", True), ("café", "café", True), ("café", "café", False), ("zero​width", "zerowidth", True), ("no break", "no break", True),
    ("pаyment", "payment", True), ("мир", "мир", False), ("“quotes” – dash…", "“quotes” – dash…", False), ("tab\tand\r\nline", "tab\tand\r\nline", False), ("日本", "日本", False),
    ("x́", "x́", False), ("soft­hyphen", "softhyphen", True), ("", "", False), ("μ alone", "μ alone", False), ("📉 down", "📉 down", False), ("☀️", "☀️", False),
    ("thin space", "thin space", True), ("ệ", "ệ", True), ("Zürich", "Zürich", False), ("x" * 100_000 + "​", "x" * 100_000, True),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "seq long, body string, description string, field string, word string")


def test_forms(spark):
    df = frame(spark, [(i, c[0], None, "f", "w") for i, c in enumerate(CASES)])
    out = {r.seq: r.text for r in U.unify(df, "seq", ("body", "description")).collect()}
    changed = {r.seq for r in U.changed_words(df, "seq", ("body", "description")).collect()}
    for i, (_, want, counts) in enumerate(CASES):
        assert out[i] == want and (i in changed) == counts, CASES[i][0][:30]
    again = frame(spark, [(i, t, None, "f", "w") for i, t in out.items()])
    assert U.changed_words(again, "seq", ("body",)).count() == 0


def test_one_canonical_member_per_class(spark):
    words = spark.createDataFrame([("café",), ("ｃａｆｅ́",), ("cаfé",), ("caf​é",), ("cafe​",)], "word string")
    got = {r.word: r.canonical for r in U.canonical_words(words).collect()}
    assert set(got.values()) == {"café", "cafe"} and got["cafe​"] == "cafe"


def test_nulls_and_empty(spark):
    assert U.unify(frame(spark, []), "seq", ("body", "description")).count() == 0
    assert U.unify(frame(spark, [(1, None, None, None, None), (1, None, "a", None, None)]), "seq", ("body", "description")).count() == 1


@pytest.mark.parametrize("word", ["Ａ", "ﬀ", "㊀", "é", "ﷺ"])
def test_presentation_forms_are_compatible(word):
    mapped = U.LookAlikes()(word)
    assert mapped in (word, unicodedata.normalize("NFKC", word))
