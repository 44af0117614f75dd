from pyspark.sql import functions as F

from marketweave.functions.subword import subword_count


def test_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "word " * 20_000)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", subword_count(F.col("t")).alias("n")).collect()}
    assert got == {1: 4, 2: None, 3: 2, 4: 20_002}
