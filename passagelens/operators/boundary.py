"""A boundary model: logistic regression on features of neighbouring sentence vectors, in place of the neural ones."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_features(left: Column, right: Column) -> Column:
    """Both vectors, the size of their difference and their product, by component."""
    gap = F.zip_with(left, right, lambda a, b: F.abs(a - b))
    return F.concat(left, right, gap, F.zip_with(left, right, lambda a, b: a * b)).cast("array<double>")


def neighbours(sentences: DataFrame) -> DataFrame:
    """doc_id, pos and features for each sentence but the last. sentences: doc_id, pos, vec."""
    after = F.lead("vec").over(Window.partitionBy("doc_id").orderBy("pos"))
    return sentences.withColumn("_next", after).where(F.col("_next").isNotNull()).select("doc_id", "pos", pair_features(F.col("vec"), F.col("_next")).alias("features"))


def fit(rows: DataFrame, rounds: int = 50) -> LogisticRegressionModel:
    """rows: features, label. Positives weigh as much as all negatives together; 1 where that is undefined."""
    counts = rows.agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")).first()
    weight = counts.neg / counts.pos if counts.pos and counts.neg else 1.0
    ready = rows.select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"), F.when(F.col("label") == 1, float(weight)).otherwise(1.0).alias("weight"))
    return LogisticRegression(maxIter=rounds, regParam=0.01, weightCol="weight").fit(ready)


def probabilities(model: LogisticRegressionModel, rows: DataFrame) -> DataFrame:
    """rows with p, the probability of a boundary."""
    scored = model.transform(rows.withColumn("_x", F.col("features")).withColumn("features", array_to_vector("features")))
    kept = [c for c in rows.columns if c != "features"]
    return scored.select(*kept, F.col("_x").alias("features"), vector_to_array("probability")[1].alias("p"))
