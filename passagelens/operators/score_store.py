"""Scores of pairs that are computed once: batches of bounded size, the longest pairs first, each committed by itself, so that a run that dies goes on from its last batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.readers import no_such_path
from ..sources.scratch import settled
from .retrieval import pair_key, pending_pairs
from .windows import numbered

#: What a batch may hold, in units of `length`.
BATCH = 50_000_000


def stored_scores(spark: SparkSession, path: str) -> DataFrame:
    """pair_key, score of all batches that were committed; none if there is no store yet."""
    try:
        return spark.read.schema("pair_key string, score double").parquet(f"{path}/batch-*")
    except Exception as error:
        if not no_such_path(error):
            raise
        return spark.createDataFrame([], "pair_key string, score double")


def batched(pairs: DataFrame, length: str, most: int) -> DataFrame:
    """pairs with `batch`, from 0: in the order of falling length, each batch of about `most` in all: it may hold more by less than its longest pair.

    Pairs of one length are numbered in the order of their keys; how much longer pairs hold in all is a sum over lengths, of which there are few.
    """
    sizes = pairs.groupBy(length).agg((F.count(F.lit(1)) * F.col(length)).alias("total"))
    before = sizes.withColumn("before", F.sum("total").over(Window.orderBy(F.col(length).desc()).rowsBetween(Window.unboundedPreceding, -1))).select(length, F.coalesce("before", F.lit(0)).alias("before"))
    ordered = numbered(pairs.withColumn("_less", -F.col(length)), ["_less", "pair_key"], "_nth")
    first = ordered.groupBy(length).agg(F.min("_nth").alias("_first"))
    reached = F.col("before") + (F.col("_nth") - F.col("_first") + 1) * F.col(length)
    return ordered.join(F.broadcast(before.join(first, length)), length).withColumn("batch", F.floor((reached - 1) / most).cast("int")).drop("_less", "_nth", "_first", "before")


def score_pairs(pairs: DataFrame, left: str, right: str, score: Callable[[DataFrame], DataFrame], path: str, most: int = BATCH) -> DataFrame:
    """pairs with `score`, in rows as they came. score(rows with pair_key, left, right) gives pair_key and score; it is asked once for a pair of texts, however
    often and in whichever run it occurs."""
    spark = pairs.sparkSession
    keyed = settled(pairs.withColumn("pair_key", pair_key(F.coalesce(left, F.lit("")), F.coalesce(right, F.lit("")))))
    length = (F.length(F.coalesce(left, F.lit(""))) + F.length(F.coalesce(right, F.lit(""))) + 1).cast("long")
    todo = pending_pairs(keyed.select("pair_key", left, right), stored_scores(spark, path)).withColumn("length", length)
    todo = settled(batched(todo, "length", most), ["batch"])
    last = todo.agg(F.max("batch")).first()[0]
    for batch in range(0 if last is None else last + 1):
        own = todo.where(F.col("batch") == batch).select("pair_key", left, right)
        score(own).select("pair_key", F.col("score").cast("double").alias("score")).write.parquet(f"{path}/batch-{uuid.uuid4().hex}")
    scores = stored_scores(spark, path).groupBy("pair_key").agg(F.max("score").alias("score"))
    return keyed.join(scores, "pair_key", "left").select(*pairs.columns, "score")
