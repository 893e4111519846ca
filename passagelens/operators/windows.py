"""Ordered scans: first-N-documents windows, shards, splits, running bests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import settled


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with consecutive numbers from 1 in the given order, without gathering them in one task.

    Rows are dealt to ranges and kept; the ranges' sizes (a number each) give the first number of each range, in a table of a row a range.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = settled(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__place": place}))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = settled(sizes.select("__part", before.alias("__before")))
    return ranged.join(F.broadcast(first), "__part").withColumn(name, (F.col("__before") + F.col("__place") + 1).cast("long")).drop("__part", "__place", "__before")


def document_numbers(rows: DataFrame, title: str, order: str, most: int | None = None) -> DataFrame:
    """title, first_at, doc_no: documents numbered by their first row; only the first `most`, which is cheaper, if given."""
    first = rows.groupBy(title).agg(F.min(order).alias("first_at"))
    if most is None:
        return numbered(first, ["first_at"], "doc_no")
    head = first.orderBy("first_at").limit(most)  # each task sends its first rows only
    return head.withColumn("doc_no", F.row_number().over(Window.orderBy("first_at")).cast("long"))


def first_documents(rows: DataFrame, title: str, order: str, n: int) -> DataFrame:
    """The rows up to and with the one that admits the n-th distinct document."""
    cutoff = document_numbers(rows, title, order, n).where(F.col("doc_no") == n).first()
    return rows if cutoff is None else rows.where(F.col(order) <= cutoff.first_at)


def consecutive_windows(rows: DataFrame, title: str, order: str, sizes: list[int]) -> DataFrame:
    """Rows of consecutive windows of documents, with `window`; later rows of a window's documents stay until the first
    new document after the last window."""
    total = sum(sizes)
    numbers = settled(document_numbers(rows, title, order, total + 1))
    end = numbers.where(F.col("doc_no") == total + 1).first()
    window = F.lit(None).cast("int")
    for i in reversed(range(len(sizes))):
        window = F.when(F.col("doc_no") <= sum(sizes[: i + 1]), i + 1).otherwise(window)
    kept = rows.join(numbers.where(F.col("doc_no") <= total), title)
    kept = kept if end is None else kept.where(F.col(order) < end.first_at)
    return kept.withColumn("window", window)


def usable_rows(rows: DataFrame, answer: str, sentences: str, least: int = 2) -> DataFrame:
    """Rows with an answer whose document has enough sentences. Others neither add a question nor admit a document, so windows are cut from these."""
    return rows.where((F.trim(F.coalesce(answer, F.lit(""))) != "") & (F.size(F.coalesce(sentences, F.array().cast("array<string>"))) >= least))


def holdout(rows: DataFrame, title: str, question: str, order: str, n: int, skip_titles: DataFrame, skip_questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first n documents outside skipped titles and questions, and what was scanned and skipped up to the row that filled the window.

    A row of a skipped title counts as that, whatever its question.
    """
    marked = rows.join(skip_titles.select(title).distinct().withColumn("_title", F.lit(True)), title, "left")
    marked = marked.join(skip_questions.select(question).distinct().withColumn("_question", F.lit(True)), question, "left")
    open_ = marked.where("_title IS NULL AND _question IS NULL").select(*rows.columns)
    cutoff = document_numbers(open_, title, order, n).where(F.col("doc_no") == n).first()
    inside = F.lit(True) if cutoff is None else F.col(order) <= cutoff.first_at
    seen = marked.where(inside)
    stats = seen.agg(F.count(F.lit(1)).alias("scanned"), F.count("_title").alias("skipped_title"), F.count_if(F.col("_title").isNull() & F.col("_question").isNotNull()).alias("skipped_question"))
    return open_.where(inside), stats


def rows_after(rows: DataFrame, order: str, n: int) -> DataFrame:
    """All rows but the first n, which only a distributed top-n looks for."""
    last = rows.select(order).orderBy(order).limit(n).agg(F.max(order), F.count(F.lit(1))).first()
    return rows.where(F.col(order) > last[0]) if n > 0 and last[1] else rows


def inserted_documents(pages: DataFrame, order: str, pos: str, title: str) -> DataFrame:
    """title, doc_id: documents numbered from 0 as questions, and pages within a question, first bring them in."""
    first = pages.groupBy(title).agg(F.min(F.struct(order, pos)).alias("first_at"))
    return numbered(first, ["first_at"], "n").select(title, (F.col("n") - 1).alias("doc_id"))


def cut_split(rows: DataFrame, key: str, shares: tuple[float, float] = (0.8, 0.9), seed: int = 0) -> DataFrame:
    """rows with split: in the order of a seeded hash, whole numbers of rows by share: the first int(0.8 n) train, up to int(0.9 n) val, then test."""
    hashed = rows.withColumn("_hash", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")))
    at = numbered(hashed, ["_hash", key], "_row")
    n = rows.count()
    split = F.when(F.col("_row") <= int(shares[0] * n), "train").when(F.col("_row") <= int(shares[1] * n), "val").otherwise("test")
    return at.withColumn("split", split).drop("_hash", "_row")


def excluding(rows: DataFrame, skipped: DataFrame, title: str) -> DataFrame:
    """Rows of no skipped document; windows over them are holdouts."""
    return rows.join(skipped.select(title).distinct(), title, "left_anti")


def first_questions(rows: DataFrame, order: str, n: int, usable: Column) -> DataFrame:
    """The first n usable rows: only these add documents."""
    return rows.where(usable).orderBy(order).limit(n)


def shards(numbers: DataFrame, size: int) -> DataFrame:
    return numbers.withColumn("shard", F.floor((F.col("doc_no") - 1) / size).cast("long"))


def hash_split(key: Column, shares: tuple[float, float] = (0.8, 0.9), seed: int = 0) -> Column:
    """train, val or test by a hash of the key: no order, no shuffle, and stable as the corpus grows."""
    at = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    return F.when(at < shares[0], "train").when(at < shares[1], "val").otherwise("test")


def section_starts(sentences: DataFrame) -> DataFrame:
    """label 1 for the first sentence of a later section. sentences: doc_id, pos, section."""
    before = F.lag("section").over(Window.partitionBy("doc_id").orderBy("pos"))
    return sentences.withColumn("label", F.when(before.isNotNull() & ~before.eqNullSafe(F.col("section")), 1).otherwise(0))


def best_of_first(samples: DataFrame, ks: list[int]) -> DataFrame:
    """k, mean_best: the mean over questions of the best value among the first k samples. samples: qid, j, value."""
    running = F.max("value").over(Window.partitionBy("qid").orderBy("j").rowsBetween(Window.unboundedPreceding, 0))
    return samples.withColumn("best", running).where(F.col("j").isin(ks)).groupBy(F.col("j").alias("k")).agg(F.avg("best").alias("mean_best"))


def step_windows(trace: DataFrame, step: str, size: int, values: list[str], by: list[str]) -> DataFrame:
    """Means of a training trace by windows of `size` steps, the last one as long as it is."""
    return trace.groupBy(*by, F.ceil(F.col(step) / size).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values])


def first_and_last_tenth(trace: DataFrame, step: str, value: str, by: list[str]) -> DataFrame:
    """Means over the first and the last tenth of the steps, of at least one step."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(step))
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    tenth = F.greatest(F.lit(1), F.floor(F.col("_n") / 10))
    marked = trace.withColumn("_at", at).withColumn("_n", n)
    return marked.groupBy(*by).agg(F.avg(F.when(F.col("_at") <= tenth, F.col(value))).alias("first_mean"), F.avg(F.when(F.col("_at") > F.col("_n") - tenth, F.col(value))).alias("last_mean"))
