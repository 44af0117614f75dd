import numpy as np

from marketweave.llm import reading_level as R
from tests.llm.test_reading_level import corpus


def test_fit_is_that_of_all_rated_documents(spark):
    """Counts and maps found on executors are those of one process over every rated document, more than any sample of 4,000."""
    rows = [(i, f"{text[:200]} {i % 1200 + 1} word{chr(97 + i % 26)} é", level, ("en", "de", None)[i % 3]) for i, text, level in corpus(4600, 6)]
    docs = spark.createDataFrame([(i, t, x) for i, t, _, x in rows] + [(rows[5][0], rows[5][1], rows[5][3]), (9_999, " ", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, k) for i, _, k, _ in rows] + [(9_999, 2)], "doc_id long, level int")
    got = R.fit(docs, labels)
    side = [r.s for r in docs.limit(len(rows)).select(R.side_of("text").alias("s")).collect()]
    whole = R.LevelGrader([R.words(t) for _, t, _, _ in rows], np.array([float(k) for _, _, k, _ in rows]), [x for *_, x in rows], np.array(side))
    for a, b in zip(got.models, whole.models):
        assert a.ids == b.ids and a.languages == b.languages
        for name in ("k2", "k3", "p1", "p2", "p3", "seen1", "n2", "log_lang"):
            np.testing.assert_array_equal(getattr(a, name), getattr(b, name), err_msg=name)
    assert set(got.maps) == set(whole.maps) and None in got.maps
    for language, maps in whole.maps.items():
        for (x, y), (x2, y2) in zip(got.maps[language], maps):
            np.testing.assert_allclose(x, x2, atol=1e-9)
            np.testing.assert_allclose(y, y2, atol=1e-9)


def test_rated_texts_without_words(spark):
    docs = spark.createDataFrame([(1, "!!!", "en"), (2, "a b", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 3)], "doc_id long, level int")
    got = {r.doc_id: r for r in R.reading_levels(docs, labels).collect()}
    assert got[1].level is None and got[2].level is not None
