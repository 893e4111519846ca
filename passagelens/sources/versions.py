"""Tables with versions: a write adds a folder, then a pointer to it takes the old one's place in one rename.

Readers find the old version or the new one, never none and never a part. A write that dies leaves a folder that nothing points to; the
next commit takes another name, and expire() removes what isn't pointed to. Keys with fingerprints tell which rows have to be computed again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "_current"


def _path(spark: SparkSession, *parts: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _files(spark: SparkSession, path: str):
    at = _path(spark, path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _pointed(spark: SparkSession, path: str) -> str | None:
    """The name of the version that counts."""
    files, pointer = _files(spark, path), _path(spark, path, POINTER)
    if not files.exists(pointer):
        return None
    stream = files.open(pointer)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def version(spark: SparkSession, path: str) -> int:
    """The number of the version that counts; 0 if there is none."""
    name = _pointed(spark, path)
    return 0 if name is None else int(name.split("-")[1])


def commit(df: DataFrame, path: str, by: list[str] | None = None) -> int:
    """Writes df as the next version of the table at path (in folders by some columns) and points to it. Returns its number.

    df may read the version before. Of two writers at once the later pointer stands, whole.
    """
    spark = df.sparkSession
    number = version(spark, path) + 1
    name = f"version-{number:08d}-{uuid.uuid4().hex[:8]}"
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(f"{path}/{name}")
    files, jvm = _files(spark, path), spark.sparkContext._jvm
    draft = _path(spark, path, f"{POINTER}-{uuid.uuid4().hex}")
    stream = files.create(draft)
    stream.write(bytearray(name.encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(files.makeQualified(draft), files.makeQualified(_path(spark, path, POINTER)), options)
    return number


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The version that counts, None if there is none."""
    name = _pointed(spark, path)
    return None if name is None else spark.read.parquet(f"{path}/{name}")


def expire(spark: SparkSession, path: str) -> int:
    """Removes all versions but the one that counts, and drafts; says how many. Nobody may be reading or writing them."""
    files, kept = _files(spark, path), _pointed(spark, path)
    gone = [s.getPath() for s in files.listStatus(_path(spark, path)) if s.getPath().getName() not in (POINTER, kept)]
    for at in gone:
        files.delete(at, True)
    return len(gone)


def fingerprint(*columns: Column) -> Column:
    """What tells whether a row's input has changed: the SHA-256 of its values, nulls told from empty texts."""
    marked = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.to_json(F.array(*marked)).cast("binary"), 256)


def refreshed(rows: DataFrame, path: str, key: list[str], inputs: list[str], compute) -> tuple[int, int]:
    """Brings the table at path up to date: compute(rows) is asked for the keys that are new or whose inputs' fingerprint differs, other rows are taken over,
    keys that are gone from rows go. rows: the key, each once, and inputs. compute returns the key and columns of its own.

    Returns the number of the version and how many rows were computed.
    """
    spark = rows.sparkSession
    marked = rows.withColumn("fingerprint", fingerprint(*(F.col(c) for c in inputs)))
    old = current(spark, path)
    todo = marked if old is None else marked.join(old.select(*key, "fingerprint"), [*key, "fingerprint"], "left_anti")
    done = compute(todo.drop("fingerprint")).join(todo.select(*key, "fingerprint"), key)
    if old is not None:
        done = done.unionByName(old.join(marked.select(*key, "fingerprint"), [*key, "fingerprint"], "left_semi").select(*done.columns))
    return commit(done, path), todo.count()
