import pytest

from marketweave.functions import text as T
from marketweave.operators import selection as S
from pyspark.sql import functions as F

CASES = [  # text, for term weights, for the transformer
    ("Gold rose to $85.40 an ounce. Shares fell 2.3%.", "Gold rose to $85.40 an ounce. Shares fell 2.3%.", "Gold rose to $85.40 an ounce. Shares fell 2.3%."),
    ("In this article The rebels left.", "The rebels left.", "The rebels left."),
    ("...as others in this article, they left.", "...as others , they left.", "...as others in this article, they left."),
    ("Real news. Correction: This story named U.S. officials wrongly. More news.", "Real news. S. officials wrongly. More news.", "Real news. More news."),
    ("“don’t” — wait…", "\"don't\" - wait...", "\"don't\" - wait..."),
    ("Another $800 million.", "Another $800 million.", "Another $800 million."),
    ("&amp;lt;b&amp;gt;x&amp;lt;/b&amp;gt; y", "x y", "x y"),
    ("see https://a.example/b?c=1 and www.d.example now", "see and now", "see and now"),
    ("Don't miss these tips. Prices rose.", "Prices rose.", "Don't miss these tips. Prices rose."),
    ("Fact. Click here to read Jim Cramer's Guide to Investing at no cost.\nMore.", "Fact. Click here to read Jim Cramer's Guide to Investing at no cost. More.", "Fact."),
    ("ｗｉｄｅ ﬁne​", "wide fine", "wide fine"),
    ("  \n\t ", "", ""), (None, "", ""),
    ("Disclosure: " + "x" * 100_000 + ". End.", "End.", "End."),
]


def test_cleaning(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
    for r in df.select("i", T.clean_terms(F.col("t")).alias("a"), T.clean_transformer(F.col("t")).alias("b")).collect():
        assert (r.a, r.b) == CASES[r.i][1:], CASES[r.i][0]


def one(spark, column, *values):
    schema = ", ".join(f"c{i} string" for i in range(len(values)))
    return spark.createDataFrame([values], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize("title, score, terms", [
    ("Trade war now", 3, ["trade war", "war"]), ("OPEC+ plans oil cut", 3, ["opec", "oil"]), ("Inflation and conflict", 1, ["conflict"]),
    ("Warm days", 0, []), ("", 0, []), ("TARIFFS, tariffs", 2, ["tariffs"]),
])
def test_lexicon(spark, title, score, terms):
    assert one(spark, T.matched_terms(F.col("c0")), title) == terms
    assert one(spark, T.lexicon_score(T.matched_terms(F.col("c0"))), title) == score


def test_negative_variants(spark):
    assert one(spark, T.has_negative(F.col("c0"), whole_words=False), "Inflation") is True
    assert one(spark, T.has_negative(F.col("c0")), "Inflation") is False
    assert one(spark, T.has_negative(F.col("c0")), "They hire.") is True


def test_small_text_functions(spark):
    assert one(spark, T.token_count(F.col("c0")), "") == 0
    assert one(spark, T.token_count(F.col("c0")), " a\tb\n c ") == 3
    assert one(spark, T.token_count(F.col("c0")), None) is None
    assert one(spark, T.normal_terms(F.col("c0")), "The U.S. price: $85.40, up 2.3%. A b") == "u.s price $85.40 up 2.3%".replace(" up", "")
    assert one(spark, T.title_key(F.col("c0")), " A-b, C! ") == "ab c"
    assert one(spark, T.join_parts(F.col("c0"), F.col("c1"), F.col("c2")), "a", "", None) == "a"
    assert one(spark, T.transformer_text(F.col("c0"), F.col("c1")), "Title.", "Body.") == "Title. Body"
    assert one(spark, S.merged_description(F.col("c0"), F.col("c1")), None, " x ") == "x"


@pytest.mark.parametrize("n, want", [(0, 1), (512, 1), (513, 2), (974, 2), (975, 3)])
def test_chunks(spark, n, want):
    assert spark.range(1).select(T.chunks_needed(F.lit(n)).alias("x")).first().x == want
