"""Queries over whole texts, on small tables."""

from datetime import date, timedelta

import pytest

from marketweave.plans import queries as Q

ARTICLE = "seq long, url string, title string, published string, description string, body string, section string, matched_terms string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Forty days on which the rate goes up and down in turn; only the bodies of relevant news tell which."""
    folder, rates, news = str(tmp_path_factory.mktemp("whole")), [], []
    for i in range(40):
        day = date(2022, 1, 1) + timedelta(days=i)
        rates.append((str(i), str(day), str(14000 + 100 * (i % 2)), i))
        word = "rising" if i % 2 else "falling"
        news.append((2 * i, f"https://a.example/{i}", f"Sanctions tariff talk {i}", f"{day}T00:30:00Z", "Short summary", f"The {word} trade of the whole day " + "word " * 600, None, ""))
        news.append((2 * i + 1, f"https://a.example/x{i}", f"Gardening {word} {i}", f"{day}T00:30:00Z", None, "Irrelevantword of the garden and its flowers", None, ""))
    spark.createDataFrame(news, ARTICLE).write.parquet(f"{folder}/{Q.ARTICLES}.parquet")
    spark.createDataFrame(rates, "nomor string, tanggal string, kurs string, seq long").write.parquet(f"{folder}/rates_raw.parquet")
    return folder


def test_top_terms_come_from_bodies_of_relevant_news(spark, tables):
    best = {}
    for r in Q.ml2_ml4_ml7_top_terms(spark, tables).collect():
        assert "gardening" not in r.term and "irrelevantword" not in r.term
        best.setdefault(r.direction, set()).add(r.term)
    assert "rising trade" in best["up"] and "falling trade" in best["down"]


def test_daily_queries_over_whole_texts(spark, tables):
    aligned = Q.plan_aligned_news(spark, tables).collect()
    assert len(aligned) == 40 and all(r.n_tokens > 600 for r in aligned)
    assert Q.plan_coverage(spark, tables).first().mean_news == 1
    assert Q.plan_split(spark, tables).count() == 40
    assert Q.plan_weekdays(spark, tables).count() == 5


def test_transformer_counts_subwords(spark, tables):
    from marketweave.functions.subword import _tokenizer, VOCABULARY

    got = Q.plan_transformer_news(spark, tables).limit(5).collect()
    for r in got:
        assert r.n_tokens == len(_tokenizer(VOCABULARY).encode(r.text_clean, add_special_tokens=False).ids) + 2 != len(r.text_clean.split())
