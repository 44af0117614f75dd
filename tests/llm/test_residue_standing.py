from marketweave.llm import residue as R
from tests.llm.test_residue import OTHER, PROSE

NOTICE = "404 Not Found"


def test_copies_make_no_standing_line(spark):
    copies = [(i, "a", OTHER + "\n" + NOTICE + " " * (i % 2)) for i in range(12)]  # a real article that arrived often
    elsewhere = [(100 + i, "b", f"{PROSE} {chr(97 + i) * 5}") for i in range(12)]  # lines that stand on another site
    theirs = [(200, "b", PROSE + "\n" + NOTICE), (201, "a", PROSE + "\n" + NOTICE)]
    df = spark.createDataFrame(copies + elsewhere + theirs, "seq long, site string, body string")
    assert {r.seq for r in R.residue_articles(df, source="site").collect()} == {200}
