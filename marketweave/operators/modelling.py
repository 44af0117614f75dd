"""Term weights, a balanced classifier and its measures."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, RegexTokenizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketweave.session import cut_lineage


def grams(df: DataFrame, text: str) -> DataFrame:
    """``grams``: words of two and more letters or digits, and pairs of neighbours."""
    words = RegexTokenizer(inputCol=text, outputCol="_w", gaps=False, pattern=r"(?U)\b\w\w+\b", toLowercase=True).transform(df)
    pairs = NGram(n=2, inputCol="_w", outputCol="_p").transform(words)
    return pairs.withColumn("grams", F.concat("_w", "_p")).drop("_w", "_p")


class TermWeights:
    """Smoothed inverse document frequency plus one, times counts, in unit length; vocabulary by frequency."""

    def __init__(self, size: int = 5000, min_docs: int = 5, max_share: float = 0.8):
        self.size, self.min_docs, self.max_share = size, min_docs, max_share

    def table(self, train: DataFrame, text: str) -> DataFrame:
        """``term``, ``tf``, ``df`` and ``idf`` of the vocabulary, the most frequent first."""
        # the documents are numbered before their terms are taken apart; beside the generator each term would get its own number
        g = cut_lineage(grams(train, text).select("grams", F.monotonically_increasing_id().alias("d")))
        n = g.count()
        each = g.select(F.explode("grams").alias("term"), "d").groupBy("term", "d").agg(F.count(F.lit(1)).alias("n"))
        counts = each.groupBy("term").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))
        ok = counts.filter((F.col("df") >= self.min_docs) & (F.col("df") <= self.max_share * n))
        return ok.orderBy(F.desc("tf"), "term").limit(self.size).withColumn("idf", F.ln(F.lit(n + 1) / (F.col("df") + 1)) + 1)

    def fit(self, train: DataFrame, text: str) -> TermWeights:
        self.text = text
        rows = sorted(self.table(train, text).select("term", "idf").collect(), key=lambda r: r.term)  # at most ``size`` rows
        self.vocabulary, self.idf = [r.term for r in rows], [r.idf for r in rows]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        model = CountVectorizerModel.from_vocabulary(self.vocabulary, "grams", "_tf")
        weigh = ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol="_tf", outputCol="_x")
        raw = weigh.transform(model.transform(grams(df, self.text)))
        return Normalizer(p=2.0, inputCol="_x", outputCol="features").transform(raw).drop("grams", "_tf", "_x")


def balanced(df: DataFrame, label: str) -> DataFrame:
    """``weight`` that gives every class the same total; a row per class is all that is collected."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = Window.partitionBy(F.lit(0))
    w = n.select(label, (F.sum("_n").over(total) / (F.count(F.lit(1)).over(total) * F.col("_n"))).alias("weight"))
    return df.join(w, label)


def fit_classifier(train: DataFrame, label_index: str, max_iter: int = 1000, c: float = 1.0) -> LogisticRegressionModel:
    """Multinomial regression with an L2 penalty as strong as 1/c over the summed weights."""
    total = train.agg(F.sum("weight")).first()[0] or 1.0
    lr = LogisticRegression(
        featuresCol="features", labelCol=label_index, weightCol="weight", family="multinomial", standardization=False, elasticNetParam=0.0,
        regParam=1.0 / (c * total), maxIter=max_iter,
    )
    return lr.fit(train)


def top_terms(model: LogisticRegressionModel, vocabulary: list[str], labels: list[str], n: int = 15) -> list[tuple[str, int, str, float]]:
    """Class, rank, term and coefficient of the terms that speak most for each class."""
    out = []
    for k, row in enumerate(model.coefficientMatrix.toArray()):
        best = sorted(range(len(vocabulary)), key=lambda i: (-row[i], vocabulary[i]))[:n]
        out += [(labels[k], r + 1, vocabulary[i], float(row[i])) for r, i in enumerate(best)]
    return out


def majority(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label).limit(1)


def class_measures(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support by class, then macro avg, weighted avg and accuracy; a zero division gives 0."""
    pairs = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    long = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("guessed")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("guessed")),
    )).alias("x"), F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("hit"))
    per = long.groupBy("x.label").agg(F.sum("x.support").alias("support"), F.sum("x.guessed").alias("guessed"), (F.sum("hit") / 2).alias("hit"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    per = per.withColumn("precision", ratio(F.col("hit"), F.col("guessed"))).withColumn("recall", ratio(F.col("hit"), F.col("support")))
    per = per.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    names = ("precision", "recall", "f1")
    total = F.sum("support")
    macro = per.agg(F.lit("macro avg").alias("label"), *(F.avg(c).alias(c) for c in names), total.alias("support"))
    weighted = per.agg(F.lit("weighted avg").alias("label"), *((F.sum(F.col(c) * F.col("support")) / total).alias(c) for c in names), total.alias("support"))
    right = F.sum("hit") / total
    accuracy = per.agg(F.lit("accuracy").alias("label"), *(right.alias(c) for c in names), total.alias("support"))
    return per.select("label", *names, "support").unionAll(macro).unionAll(weighted).unionAll(accuracy)


def confusion(df: DataFrame, actual: str, predicted: str, labels: list[str]) -> DataFrame:
    """Rows of actual classes, a column for each label predicted; no such pair is 0."""
    table = df.groupBy(F.col(actual).alias("actual")).pivot(predicted, labels).agg(F.count(F.lit(1)))
    return table.na.fill(0)
