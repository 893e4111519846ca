"""Reading corpora, questions, result rows and checkpoints with declared schemas."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize_answer, normalize_text

DOCS = T.StructType([T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("sentences", T.ArrayType(T.StringType()))])
QUESTIONS = T.StructType([T.StructField("question", T.StringType()), T.StructField("answer", T.StringType()), T.StructField("doc_title", T.StringType()), T.StructField("doc_titles", T.ArrayType(T.StringType()))])
BOUNDARIES = T.StructType([T.StructField("id", T.StringType()), T.StructField("sentences", T.ArrayType(T.StringType())), T.StructField("labels", T.ArrayType(T.IntegerType()))])


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType, required: list[str]) -> DataFrame:
    """JSON lines with a declared schema; lines that don't parse, or lack a required field, are left out."""
    with_bad = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(with_bad).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    good = F.col("_corrupt_record").isNull()
    for name in required:
        good = good & F.col(name).isNotNull()
    return rows.where(good).drop("_corrupt_record")


def no_such_path(error: Exception) -> bool:
    """Whether an error says that a path is not there, or holds nothing."""
    return isinstance(error, PySparkException) and str(error.getCondition()).split(".")[0] in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def read_cached(spark: SparkSession, path: str, schema: T.StructType, required: list[str]) -> DataFrame:
    """As read_jsonl, but a file that isn't there yet has no rows."""
    try:
        return read_jsonl(spark, path, schema, required)
    except Exception as error:
        if not no_such_path(error):
            raise
        return spark.createDataFrame([], schema)


def read_docs(spark: SparkSession, path: str) -> DataFrame:
    """Documents of two sentences or more; the title falls back on the id."""
    docs = read_cached(spark, path, DOCS, ["sentences"])
    return docs.withColumn("title", F.coalesce("title", "id")).where(F.size("sentences") >= 2)


def gold_titles() -> Column:
    return F.when(F.size(F.coalesce("doc_titles", F.array().cast("array<string>"))) > 0, F.col("doc_titles")).otherwise(F.array("doc_title"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return read_cached(spark, path, QUESTIONS, ["question", "answer"]).withColumn("gold", gold_titles())


def read_results(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def checkpoint_rows(spark: SparkSession, path: str, row_schema: str, meta: dict[str, str]) -> DataFrame:
    """The rows of a checkpoint of JSON lines whose meta line must say `meta`; torn lines are passed over."""
    lines = spark.read.text(path)
    parsed = lines.select(F.from_json("value", f"meta map<string,string>, rows array<struct<{row_schema}>>").alias("x")).where(F.col("x").isNotNull())
    found = parsed.where(F.col("x.meta").isNotNull()).select("x.meta").limit(2).collect()
    if len(found) != 1 or found[0].meta != meta:
        raise ValueError(f"the checkpoint at {path} was written for other inputs")
    return parsed.where(F.col("x.rows").isNotNull()).select(F.explode("x.rows").alias("r")).select("r.*")


def read_contexts(spark: SparkSession, path: str, passages: str, arms: list[str], n: int) -> tuple[dict, DataFrame]:
    """The meta line of a contexts file, and its rows (arm, contexts, a list for each question), of which there must be one for each arm, of n questions."""
    parsed = spark.read.text(path).select(F.from_json("value", f"meta map<string,string>, arm string, contexts array<array<{passages}>>").alias("x")).select("x.*")
    meta = parsed.where("meta IS NOT NULL").select("meta").first()
    if meta is None:
        raise ValueError(f"{path} has no meta line")
    rows = parsed.where("arm IS NOT NULL").select("arm", "contexts")
    sizes = {r.arm: r.n for r in rows.select("arm", F.size("contexts").alias("n")).collect()}  # a row an arm
    if sizes != dict.fromkeys(arms, n):
        raise ValueError(f"{path} has {sizes}, not {n} questions for each of {arms}")
    return meta.meta, rows


def read_partial(spark: SparkSession, path: str, passages: str, meta: dict[str, str], arms: list[str], n: int) -> DataFrame | None:
    """The rows of a contexts file that an earlier run of the same inputs has left; None if there is none. A file of other inputs, or with other arms or counts, is an error."""
    if not path_exists(spark, path):
        return None
    found, rows = read_contexts(spark, path, passages, arms, n)
    if found != meta:
        raise ValueError(f"{path} was written for other inputs")
    return rows


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def article_vectors(spark: SparkSession, path: str, articles: list[str] | DataFrame) -> DataFrame:
    """doc_id, vecs: the sentence vectors (doc_id, pos, vec) of some articles, in order, one row an article. Names given as a list reach the scan as a filter, a table (doc_id) is joined."""
    rows = spark.read.parquet(path)
    rows = rows.where(F.col("doc_id").isin(articles)) if isinstance(articles, list) else rows.join(articles.select("doc_id").distinct(), "doc_id", "left_semi")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "vec")))
    return rows.groupBy("doc_id").agg(F.transform(ordered, lambda x: x["vec"]).alias("vecs"))


def pending(wanted: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return wanted.join(done.select(*key), key, "left_anti")


def head_before_filter(rows: DataFrame, order: str, n: int, condition: Column) -> DataFrame:
    """The filter applies to the first n rows, so that fewer may come back."""
    return rows.orderBy(order).limit(n).where(condition)


def first_short_answer(annotators: Column) -> Column:
    """The first span over annotators, each an array of (start, end), that is not empty; null without one."""
    spans = F.filter(F.flatten(annotators), lambda s: s["start"].isNotNull() & (s["start"] >= 0) & (s["end"] > s["start"]))
    return F.try_element_at(spans, F.lit(1))


def joined_tokens(tokens: Column, is_html: Column, start: Column, end: Column) -> Column:
    """The words from start up to before end, without markup tokens."""
    both = F.arrays_zip(tokens.alias("t"), is_html.alias("h"))
    part = F.slice(both, start + 1, F.greatest(end - start, F.lit(0)))
    return F.array_join(F.transform(F.filter(part, lambda x: ~x["h"]), lambda x: x["t"]), " ")


def entity_pages(titles: Column, contexts: Column) -> Column:
    both = F.arrays_zip(titles.alias("title"), contexts.alias("context"))
    return F.filter(both, lambda p: (F.coalesce(p["title"], F.lit("")) != "") & (F.coalesce(p["context"], F.lit("")) != ""))


def answer_candidates(value: Column, aliases: Column) -> Column:
    """The answer, then its aliases; stripped, without empty ones and repeats."""
    return F.array_distinct(F.filter(F.transform(F.concat(F.array(value), aliases), lambda x: F.trim(x)), lambda x: x != ""))


def read_rows(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines of an interrupted run: a last line that doesn't parse is left out, one before it fails the job.

    Lines are told by the place of their block in the file and their order in it; only the last place of each file is gathered.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth")).alias("at"))
    last = lines.groupBy("file").agg(F.max("at").alias("last"))
    parsed = lines.join(last, "file").withColumn("row", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    good = F.try_parse_json("value").isNotNull()
    torn = F.raise_error(F.concat(F.lit("unreadable line before the last in "), F.col("file"))).cast("boolean")
    kept = F.when(good, True).when(F.col("at") == F.col("last"), False).otherwise(torn)
    return parsed.where(kept).select("row.*")


def read_boundaries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The records of several splits together, with the split that the file is named by."""
    rows = read_jsonl(spark, paths, BOUNDARIES, ["sentences", "labels"])
    return rows.withColumn("split", F.regexp_extract(F.input_file_name(), r"([A-Za-z]+)\.jsonl?$", 1))


def index_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except Exception as error:
        if not no_such_path(error):
            raise
        return False
    return True


def load_index(spark: SparkSession, path: str, articles: list[str] | None = None) -> DataFrame:
    """The chunks (or sentence vectors) of an index; of the named articles only, which reaches the scan as a filter."""
    rows = spark.read.parquet(path)
    return rows if articles is None else rows.where(F.col("doc_id").isin(articles))


def grid_rows(results: DataFrame, arm: str, n: int | None = None) -> DataFrame:
    """The rows of one arm with `size` and `overlap` whatever the method; an error if there are not n of them."""
    rows = results.where(F.col("arm") == arm).withColumns({"size": F.coalesce("fixed_size", "semantic_target_size"), "overlap": F.coalesce("fixed_overlap", "semantic_overlap")})
    if n is not None and (found := rows.count()) != n:
        raise ValueError(f"expected {n} configurations, got {found}")
    return rows


def config_identity() -> Column:
    """What identifies the configuration of a result row, whether its cells are numbers or text; the window of a learned one is part of it."""
    number = lambda c: F.round(F.col(c).cast("string").cast("double")).cast("int").cast("string")
    fixed = F.concat_ws("|", F.lit("fixed"), number("fixed_size"), number("fixed_overlap"))
    learned = F.concat_ws("|", F.trim("method"), F.trim("semantic_policy"), number("semantic_target_size"), number("semantic_min_size"), number("semantic_max_size"), number("semantic_overlap"))
    return F.when(F.trim("method") == "fixed", fixed).otherwise(learned)


def config_label() -> Column:
    """A short name of a result row's configuration."""
    return F.format_string("%s %d/%d", F.trim("method"), F.coalesce("fixed_size", "semantic_target_size").cast("int"), F.coalesce("fixed_overlap", "semantic_overlap").cast("int"))


def spans(answers: Column, lists: bool) -> Column:
    """(start, end) of short answers in either layout: arrays side by side in one struct, or an array of structs of arrays."""
    zipped = lambda s: F.arrays_zip(s["start_token"].alias("start"), s["end_token"].alias("end"))
    return zipped(answers) if lists else F.flatten(F.transform(answers, zipped))


def doc_tokens(document: Column) -> tuple[Column, Column]:
    return document["tokens"]["token"], document["tokens"]["is_html"]


def work_items(questions: DataFrame, contexts: DataFrame | None) -> DataFrame:
    """qid, passages of the questions (qid, answer) that a reader is asked: those whose answer isn't empty when normalised, and, unless the
    book is closed (no contexts), that have passages."""
    kept = questions.where(normalize_answer(F.col("answer")) != "").select("qid")
    if contexts is None:
        return kept.withColumn("passages", F.lit(None).cast("array<struct<title:string,text:string>>"))
    return kept.join(contexts.where(F.size("passages") > 0).select("qid", "passages"), "qid")


def chosen_answer(pages: Column, candidates: Column) -> Column:
    """(answer, gold) of a question from its own pages (title, text): its first candidate that a page holds, and the titles of all pages that hold it;
    null if none is held."""

    def among(named: Column) -> Column:
        tried = F.transform(
            F.filter(candidates, lambda c: normalize_text(c) != ""),
            lambda c: F.struct(c.alias("answer"), F.transform(F.filter(named, lambda p: F.contains(p["text"], normalize_text(c))), lambda p: p["title"]).alias("gold")),
        )
        return F.try_element_at(F.filter(tried, lambda x: F.size(x["gold"]) > 0), F.lit(1))

    return F.transform(F.array(F.transform(pages, lambda p: F.struct(p["title"].alias("title"), normalize_text(p["text"]).alias("text")))), among)[0]
