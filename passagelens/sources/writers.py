"""Writing results. Each writer replaces or appends by Spark's committers, so that a lost task leaves no half-written file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fixed_number
from .readers import no_such_path, pending


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def write_results(rows: DataFrame, path: str, columns: list[str], places: dict[str, int] | None = None) -> None:
    """Result rows with the columns in the order given: 4 decimals, or what `places` says, for numbers, empty cells for null."""
    kinds = dict(rows.dtypes)
    own = [fixed_number(F.col(c), (places or {}).get(c, 4)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in columns]
    write_csv(rows.select(*own), path)


def write_json(rows: DataFrame, path: str) -> None:
    """One nested JSON object for each row, null fields left in."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def append_checkpoint(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Appends one line for each partition of rows."""
    packed = rows.select(F.struct(*rows.columns).alias("r"), F.spark_partition_id().alias("p")).groupBy("p").agg(F.collect_list("r").alias("rows"))
    packed.select(F.to_json(F.struct("rows")).alias("value")).write.mode("append").text(path)


def save_index(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").parquet(path)


def materialise_missing(inputs: DataFrame, key: list[str], path: str, make) -> DataFrame:
    """Appends make(rows) for the inputs whose key is not in the table at path yet; returns the whole table."""
    spark = inputs.sparkSession
    try:
        done = spark.read.parquet(path)
        todo = pending(inputs, done, key)
    except Exception as error:
        if not no_such_path(error):
            raise
        todo = inputs
    make(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)
