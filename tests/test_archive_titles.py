from marketweave.plans import queries as Q


def test_titles_with_signs_keep_their_links(spark, tmp_path):
    titles = ["S&P and AT&T shares rise again", "Rates <b> under 5 > 4 percent", "Plain title of the whole day"]
    rows = [(i, t, f"https://a.example/2022/01/02/x-{i}.html", "2022-01-02", "a") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "listing_id long, title string, url string, index_date string, site string").write.parquet(f"{tmp_path}/archive_index.parquet")
    assert {r.title for r in Q.ext1_dd4_archive_links(spark, str(tmp_path)).collect()} == set(titles)
    assert Q.ext2_strict_links(spark, str(tmp_path)).count() == 3
