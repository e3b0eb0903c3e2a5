"""The scored tier: a text classifier trained and applied with Spark ML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def train(samples: DataFrame, *, text: str = "text", label: str = "label", features: int = 1 << 16):
    """Hashed word pairs and a logistic regression; returns the fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer

    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}]+")
    pairs = NGram(n=2, inputCol="_words", outputCol="_pairs")
    counts = HashingTF(inputCol="_terms", outputCol="_features", numFeatures=features)
    from pyspark.ml.feature import SQLTransformer

    both = SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _terms FROM __THIS__")
    model = LogisticRegression(featuresCol="_features", labelCol=label, maxIter=20, regParam=0.01, probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction")
    kept = samples.select(F.coalesce(F.col(text), F.lit("")).alias(text), F.col(label).cast("double").alias(label))
    return Pipeline(stages=[words, pairs, both, counts, model]).fit(kept)


def score(df: DataFrame, model, name: str = "score", text: str = "text") -> DataFrame:
    """``df`` with the probability of label 1."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df.withColumn(text, F.coalesce(F.col(text), F.lit(""))))
    return out.withColumn(name, vector_to_array("_probability")[1]).select(*df.columns, name)


def tiered(df: DataFrame, rule: Column, scored, name: str = "score") -> DataFrame:
    """Rows that no rule hit are scored by ``scored`` (a function of a frame); the others pass it by.

    Two branches, because a Python scorer inside ``when`` would run for every row.
    """
    marked = df.withColumn("_rule", rule)
    missed = scored(marked.where("_rule is null"))
    return missed.unionByName(marked.where("_rule is not null").withColumn(name, F.lit(None).cast("double")))


def mock_answer(text: Column, answers: tuple[tuple[str, str], ...], otherwise: str) -> Column:
    """A canned answer for the first keyword that a text has."""
    out = F.lit(otherwise)
    for word, answer in reversed(answers):
        out = F.when(F.contains(F.lower(text), F.lit(word)), F.lit(answer)).otherwise(out)
    return out
