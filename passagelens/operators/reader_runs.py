"""Runs of a reader over questions that go on where they stopped: outputs are kept in committed batches, each with the digest of the prompt that it answers."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import prediction_from_output
from ..sources.readers import no_such_path
from ..sources.scratch import settled

_KEPT = "qid long, raw string, prediction string, prompt_sha1 string, device string"


def prompt_digest(prompt: Column) -> Column:
    return F.sha1(prompt.cast("binary"))


def saved_outputs(spark: SparkSession, path: str) -> DataFrame:
    """qid, raw, prediction, prompt_sha1, device of the batches that were committed; none if there is no run yet."""
    try:
        return spark.read.schema(_KEPT).parquet(f"{path}/batch-*")
    except Exception as error:
        if not no_such_path(error):
            raise
        return spark.createDataFrame([], _KEPT)


def answer_items(items: DataFrame, generate: Callable[[DataFrame], DataFrame], path: str, device: str, batches: int = 1) -> int:
    """Answers the items (qid, prompt; each qid once) that no output is saved for, a batch at a time; returns how many these were.

    generate(rows of qid, prompt) gives qid and raw. An output of another device, or one whose prompt is not the one that is asked now, is an error: a run is one
    run. Saved outputs of questions that aren't asked now stay.
    """
    spark = items.sparkSession
    done = settled(saved_outputs(spark, path))
    other = sorted(r.device for r in done.select("device").distinct().where(F.col("device") != device).limit(10).collect())
    if other:
        raise ValueError(f"saved outputs come from {other}, not from {device}")
    asked = settled(items.select("qid", "prompt", prompt_digest(F.col("prompt")).alias("prompt_sha1")))
    differ = asked.join(done.select("qid", F.col("prompt_sha1").alias("saved")), "qid").where(F.col("prompt_sha1") != F.col("saved")).select("qid").limit(5).collect()
    if differ:
        raise ValueError(f"saved outputs answer other prompts, of questions {sorted(r.qid for r in differ)} for example")
    todo = settled(asked.join(done.select("qid"), "qid", "left_anti").withColumn("batch", F.pmod(F.xxhash64("qid"), F.lit(batches)).cast("int")), ["batch"])
    for batch in range(batches):
        own = todo.where(F.col("batch") == batch).select("qid", "prompt", "prompt_sha1")
        out = generate(own.select("qid", "prompt")).select("qid", "raw").join(own.select("qid", "prompt_sha1"), "qid")
        kept = out.select("qid", "raw", prediction_from_output(F.col("raw")).alias("prediction"), "prompt_sha1", F.lit(device).alias("device"))
        kept.write.parquet(f"{path}/batch-{uuid.uuid4().hex}")
    return todo.count()
