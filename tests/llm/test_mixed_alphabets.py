from marketweave.llm import unicode_forms as U


def test_mixed_words_without_a_known_look_alike(spark):
    odd = ["rat\u0454", "bon\u0434", "\u043boan", "pa\u04cfm", "\u03b4rate", "pri\u03c0e", "rate\u0561", "b\u10d3nk", "\u2c81rate", "\u13a2x", "t\u0434\u043b\u0436", "Ju\u10d3ge", "word\u04d9", "pa\ua4e1", "ra\u05d0te"]
    fine = ["rate", "\u0434\u043b\u044f", "\u03bc alone", "USD-\u0434\u043b\u044f", "caf\u00e9", "\u65e5rate"]
    df = spark.createDataFrame(list(enumerate(odd + fine)), "seq long, body string")
    assert {r.seq for r in U.odd_words(df, "seq", ("body",)).collect()} == set(range(len(odd)))
    assert U.unify(df, "seq", ("body",)).count() == len(odd + fine)


def test_canonical_is_the_commonest_spelling(spark):
    rows = ["Kelvin\u200b 5", "a \u212aelvin", "b \u212aelvin", "Kelvin"]  # the sign and the letter are equal to the collation
    df = spark.createDataFrame(list(enumerate(rows)), "seq long, body string")
    words = U.unusual_words(df, "seq", ("body",))
    assert {r.word: r.canonical for r in U.classes(df, ("body",), words).collect()} == {"Kelvin\u200b": "Kelvin"}
    out = {r.seq: r.text for r in U.unify(df, "seq", ("body",)).collect()}
    assert out == {0: "Kelvin 5", 1: rows[1], 2: rows[2], 3: "Kelvin"}
