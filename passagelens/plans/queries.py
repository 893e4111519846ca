"""The registered queries of the engine's own operators, each with the DuckDB SQL of its result."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import providers as P
from ..functions import text as T
from ..operators import boundary as N
from ..operators import chunking as C
from ..operators import metrics as M
from ..operators import retrieval as R
from ..operators import tables as B
from ..operators import verdicts as V
from ..operators import windows as W
from ..operators.chunk_policy import freeze, swapped_lists
from ..operators.order_statistics import upper_medians
from ..sources import readers as S
from ..sources.scratch import settled, spread
from .sweep import bm25_sweep, fixed_chunk_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts, whose work is in their rows, over all cores."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


# DuckDB expressions that several queries share.
def _norm(x: str) -> str:
    return rf"lower(trim(regexp_replace({x}, '[\s\x1c-\x1f]+', ' ', 'g')))"


def _norm_answer(x: str) -> str:
    bare = rf"""regexp_replace(translate(lower({x}), '!"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', ''), '\s+', ' ', 'g')"""
    return f"array_to_string(list_filter(string_split({bare}, ' '), lambda x: x NOT IN ('', 'a', 'an', 'the')), ' ')"


_ABBREVIATED = r"""'(^|[\s("\x02])(Dr|Mr|Mrs|Ms|Prof|St|Jr|Sr|vs|[A-Z])\.\s+', '\1\2.' || chr(2), 'g'"""
_KEPT = f"regexp_replace(regexp_replace(text, {_ABBREVIATED}), {_ABBREVIATED})"
_CUT = rf"""regexp_replace({_KEPT}, '([.!?]["'')\]]*)\s+(["''(]?[\p{{Lu}}0-9])', '\1' || chr(1) || '\2', 'g')"""
_SENTENCES = rf"""list_filter(list_transform(string_split({_CUT}, chr(1)), lambda x: trim(replace(x, chr(2), ' '), E' \n\r\t')), lambda x: x <> '')"""
_LONG = f"list_filter({_SENTENCES}, lambda x: length(x) >= 20)"
_TERMS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, sentences, n and stand-in boundary probabilities, which only sentence lengths decide."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", T.long_sentences(F.col("text")).alias("sentences"))
    p = F.transform(F.slice("sentences", 1, F.greatest(F.size("sentences") - 1, F.lit(0))), lambda s: ((F.length(s) * 37) % 101 / F.lit(101.0)).cast("float"))
    return docs.withColumn("probs", p).withColumn("n", F.size("sentences"))


@query(f"SELECT doc_id, len({_SENTENCES}) AS n_all, len({_LONG}) AS n_long, md5(array_to_string({_LONG}, '|')) AS digest FROM documents")
def sentence_split(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    both = docs.select("doc_id", F.size(T.sentences(F.col("text"))).alias("n"), T.long_sentences(F.col("text")).alias("long"))
    return both.select("doc_id", F.col("n").cast("long").alias("n_all"), F.size("long").cast("long").alias("n_long"), F.md5(F.array_join("long", "|").cast("binary")).alias("digest"))


@query(
    f"""
WITH d AS (SELECT doc_id, {_LONG} AS s FROM documents), g(size, overlap) AS (VALUES (10, 1), (6, 5), (15, 0), (3, 1)),
c AS (SELECT doc_id, size, overlap, list_transform(range(0, len(s), size - overlap), lambda p: s[p + 1:p + size]) AS c FROM d, g),
k AS (SELECT doc_id, size, overlap, CASE WHEN overlap > 0 AND len(c) >= 2 AND len(c[-1]) <= overlap THEN c[1:len(c) - 1] ELSE c END AS c FROM c)
SELECT doc_id, size, overlap, len(c) AS n_chunks, md5(array_to_string(list_transform(c, lambda x: array_to_string(x, ' ')), '|')) AS digest FROM k"""
)
def fixed_size_chunks(spark, sf_dir):
    docs = _split(spark, sf_dir)
    cuts = [
        F.struct(F.lit(size).alias("size"), F.lit(overlap).alias("overlap"), F.transform(C.fixed_chunks(F.col("sentences"), size, overlap), lambda c: F.array_join(c, " ")).alias("c"))
        for size, overlap in ((10, 1), (6, 5), (15, 0), (3, 1))
    ]
    each = docs.select("doc_id", F.explode(F.array(*cuts)).alias("x")).select("doc_id", "x.*")
    return each.select("doc_id", "size", "overlap", F.size("c").cast("long").alias("n_chunks"), F.md5(F.array_join("c", "|").cast("binary")).alias("digest"))


_PROBS = "list_transform(s[1:len(s) - 1], lambda x: CAST(((length(x) * 37) % 101) / 101.0::DOUBLE AS FLOAT))"


@query(
    f"""
WITH RECURSIVE d AS (SELECT doc_id, s, len(s) AS n, {_PROBS} AS p FROM (SELECT doc_id, {_LONG} AS s FROM documents)),
w AS (
  SELECT doc_id, n, p, 0 AS i, 0 AS start, CAST([] AS INT[]) AS a, CAST([] AS INT[]) AS b FROM d
  UNION ALL
  SELECT doc_id, n, p, i + 1, CASE WHEN cut THEN i + 1 - 1 ELSE start END, CASE WHEN cut THEN list_append(a, start) ELSE a END, CASE WHEN cut THEN list_append(b, i + 1) ELSE b END
  FROM (SELECT *, ((p[i + 1]::DOUBLE >= 0.8::DOUBLE AND i - start + 1 >= 2) OR i - start + 1 >= 8) AS cut FROM w WHERE i < n - 1)),
e AS (SELECT doc_id, CASE WHEN n > start THEN list_append(a, start) ELSE a END AS a, CASE WHEN n > start THEN list_append(b, n::INT) ELSE b END AS b FROM w WHERE i = greatest(n - 1, 0)),
t AS (SELECT doc_id, CASE WHEN len(a) >= 2 AND b[-1] - a[-1] <= 1 THEN a[1:len(a) - 1] ELSE a END AS a, CASE WHEN len(a) >= 2 AND b[-1] - a[-1] <= 1 THEN b[1:len(b) - 1] ELSE b END AS b FROM e)
SELECT doc_id, len(a) AS n_chunks, array_to_string(a, ',') AS starts, array_to_string(b, ',') AS ends FROM t"""
)
def threshold_chunks(spark, sf_dir):
    spans = C.chunks_from_probs("threshold", F.col("probs"), F.col("n"), threshold=0.8, least=2, most=8, overlap=1)
    return _spans(_split(spark, sf_dir).select("doc_id", spans.alias("x")))


def _spans(df: DataFrame) -> DataFrame:
    side = lambda c: F.array_join(F.transform("x", lambda s: s[c].cast("string")), ",")
    return df.select("doc_id", F.size("x").cast("long").alias("n_chunks"), side("a").alias("starts"), side("b").alias("ends"))


@query(
    f"""
WITH RECURSIVE d AS (SELECT doc_id, len(s) AS n, {_PROBS} AS p FROM (SELECT doc_id, {_LONG} AS s FROM documents)),
w AS (
  SELECT doc_id, n, p, 0 AS start, CAST([] AS INT[]) AS a, CAST([] AS INT[]) AS b FROM d
  UNION ALL
  SELECT doc_id, n, p, CASE WHEN n - start <= 10 THEN n ELSE start + k - 1 END, list_append(a, start::INT), list_append(b, (CASE WHEN n - start <= 10 THEN n ELSE start + k END)::INT)
  FROM (SELECT *, CASE WHEN n - start > 10 THEN -(list_max(list_transform(range(2, 11), lambda k: {{'p': p[start + k]::DOUBLE, 'd': -abs(k - 6), 'k': -k}})).k) ELSE 0 END AS k FROM w WHERE start < n))
SELECT doc_id, len(a) AS n_chunks, array_to_string(a, ',') AS starts, array_to_string(b, ',') AS ends FROM w WHERE start >= n"""
)
def target_chunks(spark, sf_dir):
    spans = C.chunks_from_probs("target", F.col("probs"), F.col("n"), target=6, least=2, most=10, overlap=1)
    return _spans(_split(spark, sf_dir).select("doc_id", spans.alias("x")))


_OTHER_PROBS = "list_transform(s[1:len(s) - 1], lambda x: CAST(((length(x) * 53) % 97) / 97.0::DOUBLE AS FLOAT))"


@query(
    f"""
WITH RECURSIVE d AS (SELECT doc_id, len(s) AS n, {_PROBS} AS p1, {_OTHER_PROBS} AS p2 FROM (SELECT doc_id, {_LONG} AS s FROM documents)),
g AS (SELECT size, overlap FROM (VALUES (6), (8), (10), (12), (15)) a(size), (VALUES (0), (1)) b(overlap)),
fx AS (SELECT size, overlap, list_transform(range(0, n, size - overlap), lambda p: least(size, n - p)) AS c FROM d, g),
fk AS (SELECT 'fixed' AS method, size, overlap, unnest(CASE WHEN overlap > 0 AND len(c) >= 2 AND c[-1] <= overlap THEN c[1:len(c) - 1] ELSE c END) AS len FROM fx),
w AS (
  SELECT doc_id, n, m.method, CASE WHEN m.method = 'bilstm' THEN p1 ELSE p2 END AS p, size, overlap, 0 AS start, 0 AS len FROM d, g, (VALUES ('bilstm'), ('transformer')) m(method)
  UNION ALL
  SELECT doc_id, n, method, p, size, overlap, CASE WHEN n - start <= size + 4 THEN n ELSE start + k - overlap END, CASE WHEN n - start <= size + 4 THEN n - start ELSE k END
  FROM (SELECT *, CASE WHEN n - start > size + 4 THEN -(list_max(list_transform(range(greatest(2, size - 4), size + 5), lambda k: {{'p': p[start + k]::DOUBLE, 'd': -abs(k - size), 'k': -k}})).k) ELSE 0 END AS k FROM w WHERE start < n)),
a AS (SELECT method, size, overlap, len FROM fk UNION ALL SELECT method, size, overlap, len FROM w WHERE len > 0)
SELECT method, size, overlap, count(*) AS n_chunks, round(avg(len), 9) AS avg_chunk_size FROM a GROUP BY ALL"""
)
def chunk_config_grid(spark, sf_dir):
    docs = _split(spark, sf_dir)
    other = F.transform(F.slice("sentences", 1, F.greatest(F.size("sentences") - 1, F.lit(0))), lambda s: ((F.length(s) * 53) % 97 / F.lit(97.0)).cast("float"))
    grid = C.config_grid([6, 8, 10, 12, 15], [0, 1], C.METHODS)
    each = C.chunk_all(docs.withColumn("other", other), grid, {"transformer": "other"}).select("method", "size", "overlap", F.explode("chunk_sizes").alias("n"))
    return each.groupBy("method", "size", "overlap").agg(F.count(F.lit(1)).alias("n_chunks"), F.round(F.avg("n"), 9).alias("avg_chunk_size"))


@query(
    f"""
WITH d AS (SELECT doc_id, {_LONG} AS s FROM documents),
f AS (SELECT doc_id, s, list_transform(s, lambda x, i: length(x) % 3 = 0) AS f FROM d),
e AS (SELECT doc_id, s, list_distinct(list_concat([0], list_filter(list_transform(f, lambda x, i: CASE WHEN x THEN i END), lambda x: x IS NOT NULL), [len(s)])) AS e FROM f)
SELECT doc_id, greatest(len(e) - 1, 0) AS n_chunks, array_to_string(list_sort(e), ',') AS edges FROM e"""
)
def boundary_flags_to_chunks(spark, sf_dir):
    docs = _split(spark, sf_dir).withColumn("flags", F.transform("sentences", lambda x: F.length(x) % 3 == 0))
    chunks = docs.select("doc_id", "n", C.boundaries_to_chunks(F.col("sentences"), F.col("flags")).alias("c"))
    sizes = F.transform("c", lambda c: F.size(c))
    edges = F.aggregate(sizes, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    return chunks.select("doc_id", F.size("c").cast("long").alias("n_chunks"), F.array_join(edges.cast("array<string>"), ",").alias("edges"))


# Retrieval over whole documents; benchmark items are the questions.
def _bm25_sql(k: int, k1: float, b: float) -> str:
    return f"""
q AS (SELECT item_id AS qid, unnest({_TERMS}) AS term FROM benchmark), qt AS (SELECT qid, term, count(*) AS qtf FROM q GROUP BY ALL),
c AS (SELECT doc_id AS chunk_id, {_TERMS} AS terms FROM documents), st AS (SELECT count(*) AS n, avg(len(terms)) AS av FROM c),
po AS (SELECT term, chunk_id, dl, count(*) AS tf FROM (SELECT chunk_id, len(terms) AS dl, unnest(terms) AS term FROM c) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
sc AS (SELECT qid, chunk_id, round(sum(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * qtf * tf * ({k1}::DOUBLE + 1) / (tf + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * dl / av))), 9) AS score
  FROM po JOIN qt USING (term) JOIN df USING (term), st GROUP BY ALL),
al AS (SELECT qid, chunk_id, score FROM sc UNION ALL SELECT item_id, doc_id, 0.0 FROM benchmark, (SELECT doc_id FROM documents ORDER BY doc_id LIMIT {k}) WHERE NOT EXISTS (SELECT 1 FROM sc WHERE qid = item_id AND chunk_id = doc_id)),
bm AS (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM al QUALIFY rank <= {k})"""


def _searched(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    chunks = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return chunks, _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _bm25(spark, sf_dir, k: int) -> DataFrame:
    return R.bm25_top_k(*_searched(spark, sf_dir), k)


@query(f"WITH {_bm25_sql(20, 1.5, 0.75)} SELECT qid, rank, chunk_id, score FROM bm")
def bm25_search(spark, sf_dir):
    return _bm25(spark, sf_dir, 20)


@query(
    """
WITH s AS (SELECT q.vec_id AS qid, c.vec_id AS chunk_id, round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0)
SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 10"""
)
def dense_search(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    return R.dense_top_k(vectors, vectors.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "qid"), 10)


@query(
    """
WITH s AS (SELECT q.vec_id AS qid, c.vec_id AS chunk_id, round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS score, q.label = c.label AS hit FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 10),
f AS (SELECT qid, coalesce(min(rank) FILTER (WHERE hit), 0) AS first_rank FROM r GROUP BY qid)
SELECT label, count(*) AS n, round(avg(CASE WHEN first_rank > 0 THEN 1.0 / first_rank ELSE 0 END), 9) AS mrr, round(avg(CASE WHEN first_rank BETWEEN 1 AND 1 THEN 1 ELSE 0 END), 9) AS recall_1, round(avg(CASE WHEN first_rank BETWEEN 1 AND 5 THEN 1 ELSE 0 END), 9) AS recall_5
FROM f JOIN embeddings ON vec_id = qid GROUP BY label"""
)
def dense_reciprocal_rank(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    plain = vectors.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    top = R.dense_top_k(plain, plain.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "qid"), 11).where("qid <> chunk_id")
    top = R.ranked(top.drop("rank"), 10, ["qid"], [F.col("score").desc(), F.col("chunk_id")])
    own = vectors.select(F.col("vec_id").alias("qid"), F.col("label"))
    lists = top.join(own, "qid").join(vectors.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("found")), "chunk_id").withColumn("hit", F.col("label") == F.col("found"))
    first = R.first_hit_rank(lists).join(own, "qid")
    rate = lambda k: F.round(F.avg(F.when(F.col("first_rank").between(1, k), 1).otherwise(0)), 9).alias(f"recall_{k}")
    return first.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(M.reciprocal(F.col("first_rank"))), 9).alias("mrr"), rate(1), rate(5))


_TWO = _bm25_sql(50, 1.5, 0.75)
_THREE = _bm25_sql(50, 0.9, 0.4)
for _name in ("q", "qt", "c", "st", "po", "df", "sc", "al", "bm"):
    _THREE = re.sub(rf"\b{_name} AS \(", f"{_name}2 AS (", _THREE)
    _THREE = re.sub(rf"\b(FROM|JOIN|,) {_name}\b(?! AS)", rf"\1 {_name}2", _THREE)


@query(
    f"""
WITH {_TWO}, {_THREE},
fu AS (SELECT qid, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 10) AS score, min(rank) AS best FROM (SELECT qid, chunk_id, rank FROM bm UNION ALL SELECT qid, chunk_id, rank FROM bm2) GROUP BY ALL)
SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, best, chunk_id) AS rank FROM fu QUALIFY rank <= 20"""
)
def rank_fusion(spark, sf_dir):
    chunks, questions = _searched(spark, sf_dir)
    wanted = questions.select(F.explode(F.transform(T.search_terms(F.col("text")), lambda t: F.xxhash64(t))).alias("term")).distinct()
    counted = settled(R.term_counts(chunks, wanted))  # both rankings score the same counts
    return R.rrf_fuse([R.bm25_top_k(chunks, questions, 50, k1, b, counted) for k1, b in ((1.5, 0.75), (0.9, 0.4))], 20)


_PAIR = "round(coalesce(len(list_intersect(dt, qt2))::DOUBLE / nullif(len(list_distinct(list_concat(dt, qt2))), 0), 0), 9)"
_POOL = f"""{_bm25_sql(50, 1.5, 0.75)},
pool AS (SELECT qid, rank, chunk_id, {_PAIR} AS pair_score, contains({_norm("d.text")}, answer) AS hit
  FROM bm JOIN (SELECT doc_id, text, list_distinct({_TERMS}) AS dt FROM documents) d ON doc_id = chunk_id
  JOIN (SELECT item_id, list_distinct({_TERMS}) AS qt2, array_to_string(string_split({_norm("text")}, ' ')[1:3], ' ') AS answer FROM benchmark) b ON item_id = qid)"""


def _pool(spark, sf_dir) -> DataFrame:
    """The 50 best documents of each item with a pair score, and whether they hold the item's first three words."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("passage"))
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    answer = F.array_join(F.slice(F.split(T.normalize_text(F.col("question")), " "), 1, 3), " ")
    both = _bm25(spark, sf_dir, 50).join(docs, "chunk_id").join(items, "qid")
    return both.select("qid", "rank", "chunk_id", R.term_overlap(F.col("passage"), F.col("question")).alias("pair_score"), F.contains(T.normalize_text(F.col("passage")), answer).alias("hit"))


@query(
    f"""
WITH {_POOL}, r AS (SELECT qid, depth, chunk_id, rank AS dense_rank, row_number() OVER (PARTITION BY qid, depth ORDER BY pair_score DESC, rank) AS new FROM pool, (VALUES (20), (50)) v(depth) WHERE rank <= depth)
SELECT qid, depth, chunk_id, dense_rank, new AS rank FROM r WHERE new <= 5"""
)
def rerank_pools(spark, sf_dir):
    return R.reranked(_pool(spark, sf_dir), [20, 50]).where("rank <= 5").select("qid", "depth", "chunk_id", "dense_rank", "rank")


@query(
    f"""
WITH {_POOL}, gold AS (SELECT item_id, doc_id AS gold FROM benchmark b JOIN documents d ON contains({_norm("d.text")}, {_norm("b.text")})),
p2 AS (SELECT qid, rank, hit, gold IS NOT NULL AS in_gold FROM pool LEFT JOIN gold ON item_id = qid AND gold = chunk_id),
e AS (SELECT k, item_id, coalesce(max(CASE WHEN rank <= k AND hit AND in_gold THEN 1 ELSE 0 END), 0) AS c, coalesce(max(CASE WHEN rank <= k AND hit THEN 1 ELSE 0 END), 0) AS u
  FROM (SELECT item_id FROM benchmark) LEFT JOIN p2 ON qid = item_id, (VALUES (1), (3), (5), (20), (50)) v(k) GROUP BY ALL)
SELECT k, count(*) AS n_questions, round(avg(c), 9) AS recall, round(avg(u), 9) AS recall_unconstrained FROM e GROUP BY k"""
)
def retrieval_recall(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("page"))
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), T.normalize_text(F.col("text")).alias("answer"))
    pool = settled(_pool(spark, sf_dir))
    gold = R.containing_documents(docs, items).select("qid", F.col("doc_id").alias("chunk_id"), F.lit(True).alias("in_gold"))
    hits = pool.join(gold, ["qid", "chunk_id"], "left").select("qid", "rank", F.coalesce("in_gold", F.lit(False)).alias("in_gold"), F.col("hit").alias("holds_answer"))
    out = M.recall_at_k(items, hits, [1, 3, 5, 20, 50])
    return out.select("k", "n_questions", F.round("recall", 9).alias("recall"), F.round("recall_unconstrained", 9).alias("recall_unconstrained"))


@query(
    f"""
WITH {_POOL}, n AS (SELECT *, row_number() OVER (PARTITION BY qid, hit ORDER BY rank) AS nth FROM pool),
g AS (SELECT qid, min(CASE WHEN hit THEN rank END) AS pos_rank, min(CASE WHEN hit AND nth = 1 THEN chunk_id END) AS pos,
  list(chunk_id ORDER BY rank) FILTER (WHERE NOT hit AND nth <= 7) AS negs, list(rank ORDER BY rank) FILTER (WHERE NOT hit AND nth <= 7) AS nr FROM n GROUP BY qid)
SELECT qid, pos, pos_rank, array_to_string(negs, ',') AS negs, array_to_string(nr, ',') AS neg_ranks FROM g WHERE pos IS NOT NULL AND len(negs) = 7"""
)
def hard_negative_groups(spark, sf_dir):
    groups = R.hard_negatives(_pool(spark, sf_dir))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return groups.select("qid", "pos", "pos_rank", joined("negs"), joined("neg_ranks"))


# Boundary scores: labelled documents with a stand-in probability.
_SCORES = "(SELECT quality AS label, CAST((n_chars % 1000) / 999.0::DOUBLE AS FLOAT) AS p FROM labels JOIN documents USING (doc_id))"


def _scores(spark, sf_dir) -> DataFrame:
    rows = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select(F.col("quality").alias("label"), ((F.col("n_chars") % 1000) / F.lit(999.0)).cast("float").alias("p"))


_SWEEP = f"""t AS (SELECT i, CAST(round(i / 100.0::DOUBLE, 10) AS FLOAT) AS t FROM range(1, 100) r(i)),
s AS (SELECT i, sum(CASE WHEN p > t AND label = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p > t AND label = 0 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN NOT p > t AND label = 1 THEN 1 ELSE 0 END) AS fn FROM {_SCORES}, t GROUP BY i),
sw AS (SELECT i / 100.0::DOUBLE AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM s)"""


def _sweep(spark, sf_dir) -> DataFrame:
    rounded = {c: F.round(c, 9) for c in ("precision", "recall", "f1")}
    return M.threshold_sweep(_scores(spark, sf_dir)).withColumns(rounded)


@query(f"WITH {_SWEEP} SELECT * FROM sw")
def boundary_threshold_sweep(spark, sf_dir):
    return _sweep(spark, sf_dir)


@query(f"WITH {_SWEEP} SELECT * FROM sw ORDER BY f1 DESC, threshold DESC LIMIT 1")
def best_boundary_threshold(spark, sf_dir):
    return M.best_threshold(_sweep(spark, sf_dir))


@query(
    f"""
SELECT label, count(*) AS n, round(avg(p::DOUBLE), 9) AS mean, round(stddev_pop(p::DOUBLE), 9) AS std, {", ".join(f"round(quantile_cont(p::DOUBLE, {s / 100}), 9) AS p{s}" for s in (0, 5, 25, 50, 75, 95, 100))}
FROM {_SCORES} GROUP BY GROUPING SETS ((), (label))"""
)
def boundary_score_diagnostics(spark, sf_dir):
    out = M.score_diagnostics(_scores(spark, sf_dir).withColumn("p", F.col("p").cast("double")))
    return out.select("label", "n", *[F.round(c, 9).alias(c) for c in out.columns[2:]])


@query(f"SELECT least(floor(p::DOUBLE * 10) + 1, 10)::INT AS bin, count(*) AS n FROM {_SCORES} WHERE p BETWEEN 0 AND 1 GROUP BY 1")
def boundary_score_histogram(spark, sf_dir):
    return M.histogram(_scores(spark, sf_dir))


@query("SELECT source, sum(quality)::BIGINT AS pos, sum(1 - quality)::BIGINT AS neg, round(avg(quality), 9) AS pos_rate, round(sum(1 - quality)::DOUBLE / nullif(sum(quality), 0), 9) AS pos_weight FROM labels JOIN documents USING (doc_id) GROUP BY source")
def label_balance(spark, sf_dir):
    rows = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    out = M.class_balance(rows.select("source", F.col("quality").alias("label")), ["source"])
    return out.select("source", "pos", "neg", F.round("pos_rate", 9).alias("pos_rate"), F.round("pos_weight", 9).alias("pos_weight"))


# Paired comparisons: an order is a question, its lines' return flag an arm.
_ARMS = "(SELECT l_orderkey AS qid, l_linenumber AS config, l_returnflag AS arm, avg(l_discount) AS value FROM lineitem GROUP BY ALL)"
_PAIRED = f"(SELECT config, qid, max(CASE WHEN arm = 'A' THEN value END) - max(CASE WHEN arm = 'N' THEN value END) AS diff FROM {_ARMS} GROUP BY config, qid HAVING count(CASE WHEN arm = 'A' THEN 1 END) > 0 AND count(CASE WHEN arm = 'N' THEN 1 END) > 0)"
_CI = f"SELECT config, count(*) AS n, avg(diff) AS mean, avg(diff) - 1.96::DOUBLE * stddev_samp(diff) / sqrt(count(*)) AS low, avg(diff) + 1.96::DOUBLE * stddev_samp(diff) / sqrt(count(*)) AS high, avg(diff) - 1.645::DOUBLE * stddev_samp(diff) / sqrt(count(*)) AS low90, avg(diff) + 1.645::DOUBLE * stddev_samp(diff) / sqrt(count(*)) AS high90 FROM {_PAIRED} GROUP BY config"


def _arms(spark, sf_dir) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("config"), F.col("l_returnflag").alias("arm")).agg(F.avg("l_discount").alias("value"))


@query(f"SELECT config, n, round(mean, 9) AS mean, round(low, 9) AS low, round(high, 9) AS high FROM ({_CI})")
def paired_deltas(spark, sf_dir):
    diffs = M.paired(_arms(spark, sf_dir), ["config", "qid"], "arm", "value", "A", "N")
    return M.mean_ci(diffs, "diff", ["config"]).select("config", "n", *[F.round(c, 9).alias(c) for c in ("mean", "low", "high")])


@query(
    f"""
SELECT count(*) AS n, round(avg(diff), 9) AS mean, round(avg(diff) - 1.96::DOUBLE * stddev_samp(diff) / sqrt(count(*)), 9) AS low, round(avg(diff) + 1.96::DOUBLE * stddev_samp(diff) / sqrt(count(*)), 9) AS high
FROM (SELECT diff FROM {_PAIRED} WHERE config = 1 UNION ALL SELECT diff FROM {_PAIRED} WHERE config = 2)"""
)
def pooled_paired_delta(spark, sf_dir):
    diffs = settled(M.paired(_arms(spark, sf_dir), ["config", "qid"], "arm", "value", "A", "N"))
    pooled = diffs.where("config = 1").select("diff").unionByName(diffs.where("config = 2").select("diff"))
    return M.mean_ci(pooled, "diff", []).select("n", *[F.round(c, 9).alias(c) for c in ("mean", "low", "high")])


@query(
    f"""
WITH c AS ({_CI})
SELECT config,
  CASE WHEN mean >= 0.02 THEN 'GO' WHEN mean <= 0 THEN 'NO-GO' ELSE 'GRAY-ZONE' END AS gate,
  CASE WHEN mean >= high - mean THEN 'TRANSFERS' WHEN mean > 0 THEN 'DIRECTIONAL' ELSE 'NO-TRANSFER' END AS transfer,
  CASE WHEN mean > high - mean THEN 'DEEPER WINS' WHEN mean < mean - high THEN 'DEEPER LOSES' ELSE 'NO DIFFERENCE' END AS depth,
  CASE WHEN config = 7 THEN 'INCOMPLETE' WHEN config % 3 * 0.25 > 0.3 THEN 'INVALID' WHEN mean >= 0.0001 THEN 'OVERTURNS' WHEN mean > 0 THEN 'DIRECTIONAL' ELSE 'NULL' END AS baseline,
  CASE WHEN high < -0.001 THEN 'CLOSED' WHEN mean < -0.001 THEN 'INCONCLUSIVE' WHEN config % 3 * 0.25 > 0.3 THEN 'SIZE-CONFOUNDED' ELSE 'HEADROOM' END AS ceiling,
  CASE WHEN config / 50.0 < 0.05 THEN 'NO-GO' WHEN mean >= 0 THEN 'GO' ELSE 'NO-GO' END AS dev_gate,
  CASE WHEN config = 1 THEN 'INVALID' WHEN config / 50.0 < 0.05 THEN 'FAILED-OPTIMISATION' WHEN n < 1500 THEN 'INCONCLUSIVE-BUDGET' WHEN low > 0 AND mean >= 0.0001 THEN 'RL-BETTER' WHEN high < 0 THEN 'CE-BETTER' ELSE 'TIE' END AS optimised,
  CASE WHEN config = 1 THEN 'INVALID' WHEN low > 0 AND mean >= 0.0001 THEN 'CE-BETTER' WHEN high < 0 THEN 'STAGE8-BETTER' ELSE 'TIE' END AS more_training,
  CASE WHEN config = 1 THEN 'INVALID' WHEN n < 1500 THEN 'INCONCLUSIVE-SIZE' WHEN low > 0 AND mean >= 0.0001 THEN 'MORE-DATA-BETTER' WHEN high < 0 THEN 'MORE-DATA-WORSE' ELSE 'TIE' END AS more_data,
  CASE WHEN n < 100 THEN 'INCONCLUSIVE-SIZE' WHEN low > 0 AND mean >= 0.0001 THEN 'LARGE-BETTER' WHEN high < 0 THEN 'LARGE-WORSE' ELSE 'TIE' END AS comparison,
  CASE WHEN n < 1000 THEN 'INCONCLUSIVE-SIZE' WHEN low > 0 AND mean >= 0.0001 THEN 'CONFIRMED' WHEN low > 0 THEN 'BELOW-FLOOR' WHEN high < 0 THEN 'LARGE-WORSE' ELSE 'NOT-CONFIRMED' END AS confirmation,
  CASE WHEN low > 0 AND mean >= 0.01 THEN 'SIZE-CARRIES' WHEN low > 0 THEN 'SIZE-SMALL' WHEN high < 0 THEN 'SIZE-REVERSED' ELSE 'SIZE-NOT-DETECTED' END AS size_effect,
  CASE WHEN low > 0 THEN 'BILSTM-BETTER' WHEN high < 0 THEN 'BILSTM-WORSE' WHEN low90 >= -0.03 AND high90 <= 0.03 THEN 'EQUIVALENT' ELSE 'INCONCLUSIVE' END AS placement,
  coalesce(low > 0, false) AS reader_works
FROM c"""
)
def verdict_rules(spark, sf_dir):
    diffs = settled(M.paired(_arms(spark, sf_dir), ["config", "qid"], "arm", "value", "A", "N"))
    wide = M.mean_ci(diffs, "diff", ["config"], 1.645).select("config", F.col("low").alias("low90"), F.col("high").alias("high90"))
    c = M.mean_ci(diffs, "diff", ["config"]).join(wide, "config")
    mean, low, high, n = F.col("mean"), F.col("low"), F.col("high"), F.col("n")
    # Stand-ins that a configuration's number decides: its size drift, whether it reproduced, and the share of groups with a gradient.
    drift, valid, live = F.when(F.col("config") != 7, F.col("config") % 3 * 0.25), F.col("config") != 1, F.col("config") / 50.0
    return c.select(
        "config",
        V.gate(mean).alias("gate"),
        V.transfer(mean, high - mean).alias("transfer"),
        V.depth(mean, high - mean).alias("depth"),
        V.against_baseline(mean, drift, 0.0001).alias("baseline"),
        V.ceiling(mean, high, F.coalesce(drift, F.lit(0.25)), -0.001).alias("ceiling"),
        V.dev_gate(mean, live).alias("dev_gate"),
        V.optimised(mean, low, high, valid, live, n, 0.0001, least_groups=1500).alias("optimised"),
        V.more_training(mean, low, high, valid, 0.0001).alias("more_training"),
        V.more_data(mean, low, high, valid, n, 0.0001, 1500).alias("more_data"),
        V.comparison(mean, low, high, 0.0001, "LARGE-BETTER", "LARGE-WORSE", [(n < 100, "INCONCLUSIVE-SIZE")]).alias("comparison"),
        V.confirmation(mean, low, high, n, 0.0001, 1000).alias("confirmation"),
        V.size_effect(mean, low, high, 0.01).alias("size_effect"),
        V.placement(low, high, F.col("low90"), F.col("high90")).alias("placement"),
        V.reader_works(low).alias("reader_works"),
    )


# Result tables: a part's type is a method, its size a chunk size, its brand an overlap.
_RESULTS = "(SELECT p_type AS method, p_size AS size, CAST(right(p_brand, 1) AS INT) AS overlap, avg(p_retailprice) AS recall, avg(p_partkey) AS avg_size FROM part GROUP BY ALL)"


def _results(spark, sf_dir) -> DataFrame:
    parts = _table(spark, sf_dir, "part")
    return parts.groupBy(F.col("p_type").alias("method"), F.col("p_size").alias("size"), F.expr("CAST(right(p_brand, 1) AS INT)").alias("overlap")).agg(F.avg("p_retailprice").alias("recall"), F.avg("p_partkey").alias("avg_size"))


@query(f"SELECT size, overlap, round(max(CASE WHEN method = 'ECONOMY' THEN recall END), 6) AS \"ECONOMY\", round(max(CASE WHEN method = 'STANDARD' THEN recall END), 6) AS \"STANDARD\" FROM {_RESULTS} GROUP BY ALL")
def arms_side_by_side(spark, sf_dir):
    wide = B.arms_side_by_side(_results(spark, sf_dir), ["size", "overlap"], "method", ["ECONOMY", "STANDARD"], "recall")
    return wide.select("size", "overlap", F.round("ECONOMY", 6).alias("ECONOMY"), F.round("STANDARD", 6).alias("STANDARD"))


@query(
    f"""
WITH r AS (SELECT method, size, overlap, round(recall, 6) AS recall, round(avg_size, 6) AS avg_size FROM {_RESULTS}), l AS (SELECT * FROM r WHERE method = 'ECONOMY'), f AS (SELECT * FROM r WHERE method = 'STANDARD')
SELECT l.size, l.overlap, f.size AS match_size, round(abs(l.avg_size - f.avg_size), 6) AS gap, round(l.recall - f.recall, 6) AS delta
FROM l JOIN f ON l.overlap = f.overlap QUALIFY row_number() OVER (PARTITION BY l.size, l.overlap ORDER BY abs(l.avg_size - f.avg_size), f.size) = 1"""
)
def nearest_size_match(spark, sf_dir):
    rows = settled(_results(spark, sf_dir).select("method", "size", "overlap", F.round("recall", 6).alias("recall"), F.round("avg_size", 6).alias("avg_size")))
    left, right = rows.where("method = 'ECONOMY'"), rows.where("method = 'STANDARD'")
    out = B.nearest_match(left, right, ["overlap"], "avg_size", "size")
    return out.select("size", "overlap", F.col("match.size").alias("match_size"), F.round("gap", 6).alias("gap"), F.round(F.col("recall") - F.col("match.recall"), 6).alias("delta"))


@query(f"SELECT method, size, overlap, round(recall, 6) AS recall FROM {_RESULTS} QUALIFY row_number() OVER (PARTITION BY method ORDER BY round(recall, 6) DESC, round(avg_size, 6), size, overlap) = 1")
def best_configuration(spark, sf_dir):
    rows = _results(spark, sf_dir).withColumn("recall", F.round("recall", 6)).withColumn("avg_size", F.round("avg_size", 6))
    return B.best_rows(rows, ["method"], [F.col("recall").desc(), F.col("avg_size"), F.col("size"), F.col("overlap")]).select("method", "size", "overlap", "recall")


@query(f"SELECT size, overlap, count(*) AS n, CASE WHEN count(*) >= 2 THEN round(max(recall) - min(recall), 6) END AS spread FROM {_RESULTS} GROUP BY ALL")
def method_spread(spark, sf_dir):
    out = B.spread(_results(spark, sf_dir), ["size", "overlap"], "recall")
    return out.select("size", "overlap", "n", F.round("spread", 6).alias("spread"))


@query(
    f"""
WITH r AS (SELECT * FROM {_RESULTS}), z AS (SELECT avg(CASE WHEN size = (SELECT max(size) FROM r) THEN recall END) - avg(CASE WHEN size = (SELECT min(size) FROM r) THEN recall END) AS effect FROM r),
s AS (SELECT avg(spread) AS spread FROM (SELECT max(recall) - min(recall) AS spread FROM r GROUP BY size, overlap HAVING count(*) >= 2))
SELECT round((SELECT corr(avg_size, recall) FROM r), 6) AS pearson, (SELECT corr(avg_size, recall) FROM r) >= 0.5 AS tracks_size, round(effect, 6) AS size_effect, round(spread, 6) AS mean_spread, effect > spread AS size_over_method, round((SELECT max(recall) FROM r), 6) AS best FROM z, s"""
)
def direction_checks(spark, sf_dir):
    rows = settled(_results(spark, sf_dir))
    ends = rows.agg(F.min("size").alias("lo"), F.max("size").alias("hi")).first()
    cells = B.spread(rows, ["size", "overlap"], "recall").agg(F.avg("spread").alias("mean_spread"))
    effect = F.avg(F.when(F.col("size") == ends.hi, F.col("recall"))) - F.avg(F.when(F.col("size") == ends.lo, F.col("recall")))
    one = rows.agg(M.pearson("avg_size", "recall").alias("pearson"), effect.alias("size_effect"), F.max("recall").alias("best"))
    spread = cells.first().mean_spread
    return one.select(F.round("pearson", 6).alias("pearson"), (F.col("pearson") >= 0.5).alias("tracks_size"), F.round("size_effect", 6).alias("size_effect"), F.round(F.lit(spread), 6).alias("mean_spread"), (F.col("size_effect") > spread).alias("size_over_method"), F.round("best", 6).alias("best"))


@query("SELECT source, count(*) AS n, round(1.96::DOUBLE * sqrt(2 * avg(quality) * (1 - avg(quality)) / count(*)), 9) AS floor_95, round((1.96::DOUBLE + 0.8416::DOUBLE) * sqrt(2 * avg(quality) * (1 - avg(quality)) / count(*)), 9) AS mde_80, round(2 * sqrt(avg(quality) * (1 - avg(quality)) / count(*)), 9) AS two_se FROM labels JOIN documents USING (doc_id) GROUP BY source")
def detection_limits(spark, sf_dir):
    rows = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    p = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("p"))
    floor, mde = B.detection(F.col("p"), F.col("n"))
    return p.select("source", "n", F.round(floor, 9).alias("floor_95"), F.round(mde, 9).alias("mde_80"), F.round(M.two_se(F.col("p"), F.col("n")), 9).alias("two_se"))


@query(
    """
WITH n AS (SELECT l_suppkey, l_returnflag, sum(round(l_discount * 100)::BIGINT)::DOUBLE / (count(*) * 100) AS r, sum(round(l_tax * 100)::BIGINT)::DOUBLE / (count(*) * 100) AS t, count(*) // 40 AS c FROM lineitem GROUP BY ALL), o AS (SELECT l_suppkey, l_returnflag, sum(round(l_discount * 100)::BIGINT)::DOUBLE / (count(*) * 100) AS r, sum(round(l_tax * 100)::BIGINT)::DOUBLE / (count(*) * 100) AS t, count(*) // 40 AS c FROM lineitem WHERE l_linenumber < 7 AND l_suppkey % 10 <> 0 GROUP BY ALL),
j AS (SELECT n.l_suppkey, n.l_returnflag, round(greatest(abs(round(n.r, 4) - round(o.r, 4)), abs(round(n.t, 4) - round(o.t, 4))), 9) AS worst, o.r IS NULL AS lone, n.c = o.c AS same FROM n LEFT JOIN o USING (l_suppkey, l_returnflag))
SELECT l_suppkey, l_returnflag, worst, CASE WHEN lone THEN 'UNMATCHED' WHEN NOT same THEN 'FAILED' WHEN worst = 0 THEN 'OK exact' WHEN worst <= 0.005 THEN 'OK within one question' ELSE 'FAILED' END AS status FROM j"""
)
def reproduction_check(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem")
    mean = lambda c: F.sum(F.round(F.col(c) * 100).cast("long")).cast("double") / (F.count(F.lit(1)) * 100)  # noqa: E731 (in whole hundredths, whatever the order of rows)
    measured = lambda d: d.groupBy("l_suppkey", "l_returnflag").agg(mean("l_discount").alias("r"), mean("l_tax").alias("t"), F.floor(F.count(F.lit(1)) / 40).alias("c"))
    return B.reproduction(measured(lines), measured(lines.where("l_linenumber < 7 AND l_suppkey % 10 <> 0")), ["l_suppkey", "l_returnflag"], ["r", "t"], counts=["c"])


@query(
    """
WITH s AS (SELECT count(*)::DOUBLE AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy, regr_sxy(l_extendedprice, l_quantity) AS sxy FROM lineitem),
f AS (SELECT *, sxy / sxx AS slope, (syy - sxy * sxy / sxx) / (n - 2) AS sigma FROM s),
t AS (SELECT 'intercept' AS term, my - slope * mx AS coef, sqrt(sigma * (1 / n + mx * mx / sxx)) AS se, 1 - sigma * (n - 2) / syy AS r2, n - 2 AS dof FROM f UNION ALL SELECT 'quantity', slope, sqrt(sigma / sxx), 1 - sigma * (n - 2) / syy, n - 2 FROM f)
SELECT term, round(coef, 4) AS coef, round(se, 6) AS se, round(coef - 1.96::DOUBLE * se, 4) AS low, round(coef + 1.96::DOUBLE * se, 4) AS high, round(coef / se, 4) AS t, round(r2, 6) AS r2, dof::BIGINT AS dof FROM t"""
)
def least_squares(spark, sf_dir):
    fit = B.least_squares(_table(spark, sf_dir, "lineitem"), "l_extendedprice", {"quantity": F.col("l_quantity")})
    return fit.select("term", *[F.round(c, places).alias(c) for c, places in (("coef", 4), ("se", 6), ("low", 4), ("high", 4), ("t", 4), ("r2", 6))], "dof")


# Ordered scans: events are the stream, users its documents.
_NUMBERS = "(SELECT user_id, min(event_id) AS first_at, row_number() OVER (ORDER BY min(event_id)) AS doc_no FROM events GROUP BY user_id)"


@query(f"SELECT event_id, user_id FROM events WHERE event_id <= coalesce((SELECT first_at FROM {_NUMBERS} WHERE doc_no = 40), 9e18)")
def first_documents_window(spark, sf_dir):
    return W.first_documents(_table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", "event_id", 40)


@query(f"SELECT event_id, user_id, CASE WHEN doc_no <= 30 THEN 1 ELSE 2 END AS \"window\" FROM events JOIN {_NUMBERS} USING (user_id) WHERE doc_no <= 50 AND event_id < coalesce((SELECT first_at FROM {_NUMBERS} WHERE doc_no = 51), 9e18)")
def consecutive_document_windows(spark, sf_dir):
    return W.consecutive_windows(_table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", "event_id", [30, 20]).select("event_id", "user_id", "window")


@query(f"SELECT (doc_no - 1) // 25 AS shard, count(*) AS n_events, count(DISTINCT user_id) AS n_users FROM events JOIN {_NUMBERS} USING (user_id) GROUP BY 1")
def document_shards(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    numbers = W.shards(W.document_numbers(events, "user_id", "event_id"), 25).select("user_id", "shard")
    return events.join(numbers, "user_id").groupBy("shard").agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("user_id").alias("n_users"))


@query("SELECT doc_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, CAST(('0x' || substr(md5('0:' || doc_id), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0 AS u FROM documents)")
def hash_split(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", W.hash_split(F.col("doc_id")).alias("split"))


@query(
    """
WITH s AS (SELECT user_id AS qid, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS j, value FROM events), b AS (SELECT j, max(value) OVER (PARTITION BY qid ORDER BY j) AS best FROM s)
SELECT j AS k, round(avg(best), 9) AS mean_best FROM b WHERE j IN (1, 2, 4, 8, 16) GROUP BY j"""
)
def best_of_k(spark, sf_dir):
    j = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    samples = _table(spark, sf_dir, "events").select(F.col("user_id").alias("qid"), j.alias("j"), "value")
    return W.best_of_first(samples, [1, 2, 4, 8, 16]).select("k", F.round("mean_best", 9).alias("mean_best"))


@query(
    """
WITH s AS (SELECT user_id AS qid, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS j, value > 50 AS hit, value FROM events QUALIFY j <= 16),
q AS (SELECT qid, max(value) AS oracle, min_by(value, j) AS fixed, avg(value) AS random_mean, min_by(j, {'d': abs(value - 30), 'j': j}) AS pick FROM s GROUP BY qid)
SELECT count(*) AS n, round(avg(oracle), 9) AS oracle, round(avg(fixed), 9) AS fixed, round(avg(random_mean), 9) AS random_mean, round(avg(oracle - fixed), 9) AS delta, round(avg(pick), 9) AS mean_pick FROM q"""
)
def oracle_summary(spark, sf_dir):
    j = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    s = _table(spark, sf_dir, "events").select(F.col("user_id").alias("qid"), j.alias("j"), "value").where("j <= 16")
    q = s.groupBy("qid").agg(F.max("value").alias("oracle"), F.min_by("value", "j").alias("fixed"), F.avg("value").alias("random_mean"), F.min_by("j", F.struct(F.abs(F.col("value") - 30), "j")).alias("pick"))
    means = [F.round(F.avg(c), 9).alias(c) for c in ("oracle", "fixed", "random_mean")]
    return q.agg(F.count(F.lit(1)).alias("n"), *means, F.round(F.avg(F.col("oracle") - F.col("fixed")), 9).alias("delta"), F.round(F.avg("pick"), 9).alias("mean_pick"))


_TRACE = "(SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step, value FROM events)"


def _trace(spark, sf_dir) -> DataFrame:
    """Each user's events are the steps of a run."""
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return _table(spark, sf_dir, "events").select("user_id", "event_type", step.alias("step"), "value")


@query(f"SELECT user_id, ceil(step / 10.0)::BIGINT AS bucket, count(*) AS n, round(avg(value), 9) AS mean_value FROM {_TRACE} GROUP BY ALL")
def logging_windows(spark, sf_dir):
    return W.step_windows(_trace(spark, sf_dir), "step", 10, ["value"], ["user_id"]).withColumn("mean_value", F.round("mean_value", 9))


@query(f"WITH t AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM {_TRACE}) SELECT user_id, round(avg(value) FILTER (WHERE step <= greatest(1, n // 10)), 9) AS first_mean, round(avg(value) FILTER (WHERE step > n - greatest(1, n // 10)), 9) AS last_mean FROM t GROUP BY user_id")
def first_and_last_tenth(spark, sf_dir):
    return W.first_and_last_tenth(_trace(spark, sf_dir), "step", "value", ["user_id"]).select("user_id", F.round("first_mean", 9).alias("first_mean"), F.round("last_mean", 9).alias("last_mean"))


@query("SELECT source, list_sort(list(n_chars))[count(*) // 2 + 1] AS upper_median, (list_sort(list(n_chars))[count(*) // 2 + 1]) >= 30 AS long_enough FROM documents GROUP BY source")
def document_length_guard(spark, sf_dir):
    out = upper_medians(_table(spark, sf_dir, "documents"), ["source"], "n_chars")
    return out.select("source", F.col("upper_median").cast("long").alias("upper_median"), (F.col("upper_median") >= 30).alias("long_enough"))


@query(
    """
WITH g AS (SELECT l_orderkey AS qid, list(l_discount * 10 ORDER BY l_linenumber, l_partkey, l_suppkey) AS s FROM lineitem GROUP BY ALL HAVING count(*) >= 2)
SELECT qid, round(list_max(s) + ln(list_sum(list_transform(s, lambda x: exp(x - list_max(s))))) - s[1], 6) AS loss, 1 + len(list_filter(s[2:], lambda x: x > s[1])) AS positive_rank FROM g"""
)
def listwise_loss(spark, sf_dir):
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", (F.col("l_discount") * 10).alias("s"))))
    g = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("qid")).agg(F.transform(ordered, lambda x: x["s"]).alias("s")).where(F.size("s") >= 2)
    rank = 1 + F.size(F.filter(F.slice("s", 2, 1 << 20), lambda x: x > F.col("s")[0]))
    return g.select("qid", F.round(M.group_loss(F.col("s"), F.col("s")[0]), 6).alias("loss"), rank.cast("long").alias("positive_rank"))


# Answers: an assistant's turn is a prediction, the first words of the user's turn before it the answer.
_TURNS = f"(SELECT a.conv_id, a.turn, a.text AS prediction, array_to_string(string_split({_norm('u.text')}, ' ')[1:4], ' ') AS answer FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE a.role = 'assistant')"
_FIRST_LINE = r"trim(string_split(trim(regexp_replace(prediction, '(?s)<think>.*?</think>', '', 'g'), E' \n\r\t'), chr(10))[1], E' \n\r\t')"


@query(
    f"""
WITH t AS (SELECT conv_id, turn, {_norm_answer(_FIRST_LINE)} AS p, {_norm_answer("answer")} AS a, {_norm_answer("prediction")} AS w FROM {_TURNS}),
k AS (SELECT *, list_filter(string_split(w, ' '), lambda x: x <> '') AS ps, list_filter(string_split(a, ' '), lambda x: x <> '') AS xs FROM t),
f AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(ps), lambda x: least(len(list_filter(ps, lambda y: y = x)), len(list_filter(xs, lambda y: y = x))))), 0) AS shared FROM k)
SELECT conv_id, turn, p = a AS exact, a <> '' AND contains(' ' || w || ' ', ' ' || a || ' ') AS holds, round(CASE WHEN shared = 0 THEN 0 ELSE 2.0 * shared / (len(ps) + len(xs)) END, 9)::DOUBLE AS f1 FROM f"""
)
def answer_scores(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    users = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.array_join(F.slice(F.split(T.normalize_text(F.col("text")), " "), 1, 4), " ").alias("answer"))
    both = turns.where("role = 'assistant'").join(users, ["conv_id", "turn"])
    p, a = F.col("text"), F.col("answer")
    return both.select("conv_id", "turn", T.exact_match(T.prediction_from_output(p), a).alias("exact"), T.contains_answer(p, a).alias("holds"), F.round(T.token_f1(p, a), 9).alias("f1"))


@query(
    r"""
SELECT doc_id, md5(trim(regexp_replace(array_to_string(list_filter(string_split(regexp_replace(text, '\[\d+\]', ' ', 'g'), chr(10)), lambda x: trim(x) <> '' AND length(x) - length(replace(x, '|', '')) < 2), ' '), '[\s\x1c-\x1f]+', ' ', 'g'))) AS digest FROM documents"""
)
def cleaned_text(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_text(F.col("text")).cast("binary")).alias("digest"))


_BARE = r"regexp_replace(html, '(?is)<(script|style|nav|footer)[^>]*>.*?</(script|style|nav|footer)>', ' ', 'g')"


@query(
    rf"""
WITH p AS (SELECT page_id, regexp_split_to_array({_BARE}, '<h2[^>]*>') AS parts FROM pages),
s AS (SELECT page_id, unnest(parts) AS part, unnest(range(0, len(parts))) AS pos FROM p)
SELECT page_id, pos, CASE WHEN pos > 0 THEN trim(regexp_replace(string_split(part, '</h2>')[1], '<[^>]*>', '', 'g')) END AS heading,
  trim(regexp_replace(regexp_replace(CASE WHEN pos > 0 THEN substr(part, instr(part, '</h2>') + 5) ELSE part END, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM s"""
)
def page_sections(spark, sf_dir):
    rows = _table(spark, sf_dir, "pages").select("page_id", F.posexplode(T.html_sections(F.col("html"))).alias("pos", "s"))
    return rows.select("page_id", "pos", F.col("s.heading").alias("heading"), F.col("s.text").alias("body"))


@query(
    rf"""
WITH p AS (SELECT page_id, regexp_split_to_array({_BARE}, '<h2[^>]*>') AS parts FROM pages),
s AS (SELECT page_id, unnest(range(0, len(parts))) AS section, unnest(parts) AS part FROM p), w AS (SELECT page_id, section, unnest(string_split(part, '<p>')) AS para, unnest(range(0, len(string_split(part, '<p>')))) AS i FROM s),
o AS (SELECT page_id, section, row_number() OVER (PARTITION BY page_id ORDER BY section, i) AS pos FROM w)
SELECT page_id, pos, CASE WHEN lag(section) OVER (PARTITION BY page_id ORDER BY pos) <> section THEN 1 ELSE 0 END AS label FROM o"""
)
def section_boundaries(spark, sf_dir):
    bare = F.regexp_replace("html", r"(?is)<(script|style|nav|footer)[^>]*>.*?</(script|style|nav|footer)>", " ")
    parts = _table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split(bare, r"<h2[^>]*>")).alias("section", "part"))
    paras = parts.select(F.col("page_id").alias("doc_id"), "section", F.posexplode(F.split("part", "<p>")).alias("i", "para"))
    numbered = paras.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("section", "i")))
    return W.section_starts(numbered.select("doc_id", "pos", "section")).select(F.col("doc_id").alias("page_id"), "pos", "label")


@query(r"SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<ref[^>]*>.*?</ref>', ' ', 'g'), '(?i)<ref[^>]*/>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')) AS digest, trim(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), '_')[1:60] || '_' || md5(url)[1:8] AS slug FROM pages")
def stripped_pages(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_refs_and_comments(F.col("html")).cast("binary")).alias("digest"), T.slug(F.col("url")).alias("slug"))


@query(
    f"""
WITH q AS (SELECT conv_id, turn, text, regexp_extract(text, '[A-Za-z]+') AS answer FROM conversations)
SELECT conv_id, turn, md5(CASE WHEN length(answer) > 0 THEN regexp_replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), '(?i)(' || answer || ')', '<mark>\\1</mark>', 'g') ELSE replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') END) AS digest FROM q"""
)
def highlighted_answers(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").withColumn("answer", F.regexp_extract("text", "[A-Za-z]+", 0))
    return rows.select("conv_id", "turn", F.md5(T.highlighted(F.col("text"), F.col("answer")).cast("binary")).alias("digest"))


@query(
    rf"""
WITH c AS (SELECT item_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM benchmark),
p AS (SELECT item_id, text, len(w) > 20 AS cut, CASE WHEN len(w) > 20 THEN array_to_string(w[1:20], ' ') ELSE text END AS head, array_to_string(w[1:3], ' ') AS early, array_to_string(w[len(w) - 2:], ' ') AS late FROM c)
SELECT item_id, CASE WHEN cut THEN 1 ELSE 0 END AS n_cut, contains({_norm("head")}, {_norm("early")}) AS early_kept, contains({_norm("head")}, {_norm("late")}) AS late_kept,
  md5('Answer the question using the passages below. Reply with the answer only, as a short phrase, without explanation.' || chr(10) || chr(10) || '[1] ' || item_id || chr(10) || head || chr(10) || chr(10) || '[2] other' || chr(10) || 'short text' || chr(10) || chr(10) || 'Question: ' || trim(text, E' \n\r\t')) AS digest,
  md5('Answer the question. Reply with the answer only, as a short phrase, without explanation.' || chr(10) || chr(10) || 'Question: ' || trim(text, E' \n\r\t')) AS closed_book FROM p"""
)
def reader_prompts(spark, sf_dir):
    title = F.col("item_id").cast("string")
    passages = F.array(F.struct(title.alias("title"), F.col("text")), F.struct(F.lit("other").alias("title"), F.lit("short text").alias("text")))
    items = _table(spark, sf_dir, "benchmark").withColumn("w", F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    question = T.checked_query(F.col("text"))
    cut = items.select("item_id", "w", title.alias("title"), T.built_prompt(question, passages, 20).alias("p"), F.array(F.struct(title.alias("title"), T.cut_passage(F.col("text"), 20)["text"].alias("text"))).alias("shown"), T.prompt(question, F.lit(None).cast("array<struct<title:string,text:string>>")).alias("closed"))
    kept = lambda words: T.answer_in_prompt(F.col("shown"), F.array_join(words, " "), F.array("title"))
    last = F.slice("w", F.greatest(F.size("w") - 2, F.lit(1)), 3)
    return cut.select("item_id", F.col("p.n_cut").alias("n_cut"), kept(F.slice("w", 1, 3)).alias("early_kept"), kept(last).alias("late_kept"), F.md5(F.col("p.text").cast("binary")).alias("digest"), F.md5(F.col("closed").cast("binary")).alias("closed_book"))


@query(
    """
WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), h AS (SELECT doc_id, w, list_transform(w, lambda x: contains(x, '|') OR contains(x, '%')) AS h FROM t),
s AS (SELECT *, least(doc_id % 7 + 3, len(w)) AS b, doc_id % 5 AS a FROM h)
SELECT doc_id, CASE WHEN b > a THEN array_to_string(list_filter(list_transform(range(a + 1, b + 1), lambda i: CASE WHEN h[i] THEN NULL ELSE w[i] END), lambda x: x IS NOT NULL), ' ') END AS answer FROM s"""
)
def short_answers(spark, sf_dir):
    words = _table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w"))
    html = F.transform("w", lambda x: F.contains(x, F.lit("|")) | F.contains(x, F.lit("%")))
    start, end = (F.col("doc_id") % 5).cast("int"), F.least((F.col("doc_id") % 7 + 3).cast("int"), F.size("w"))
    spans = F.array(F.array(F.struct(F.lit(-1).alias("start"), F.lit(4).alias("end"))), F.array(F.struct(start.alias("start"), end.alias("end"))))
    first = words.select("doc_id", "w", html.alias("h"), S.first_short_answer(spans).alias("s"))
    return first.select("doc_id", F.when(F.col("s").isNotNull(), S.joined_tokens(F.col("w"), F.col("h"), F.col("s.start"), F.col("s.end"))).alias("answer"))


@query(
    f"""
WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), c AS (SELECT doc_id, list_filter(list_transform(list_concat([w[2]], w[1:8]), lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> '') AS c FROM t),
e AS (SELECT doc_id, unnest(c) AS x, unnest(range(1, len(c) + 1)) AS i FROM c)
SELECT doc_id, string_agg(x, '|' ORDER BY i) AS candidates, count(*) AS n FROM (SELECT doc_id, x, min(i) AS i FROM e GROUP BY ALL) GROUP BY doc_id"""
)
def answer_candidates(spark, sf_dir):
    words = _table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w"))
    found = words.select("doc_id", S.answer_candidates(F.get("w", F.lit(1)), F.slice("w", 1, 8)).alias("c")).where(F.size("c") > 0)
    return found.select("doc_id", F.array_join("c", "|").alias("candidates"), F.size("c").cast("long").alias("n"))


# Joins and sets over documents, labels and items.
@query("SELECT source, count(*) AS n_pending FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source")
def pending_work(spark, sf_dir):
    return S.pending(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ["doc_id"]).groupBy("source").agg(F.count(F.lit(1)).alias("n_pending"))


@query("SELECT lang, count(*) AS n_docs FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY lang")
def answerable_documents(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left_semi").groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"))


@query(f"SELECT count(*) AS n_shared FROM (SELECT DISTINCT {_norm('text')} AS t FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT DISTINCT {_norm('text')} FROM documents WHERE doc_id % 2 = 1)")
def leak_check(spark, sf_dir):
    texts = _table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_text(F.col("text")).cast("binary"), 256).alias("t"))
    shared = texts.where("doc_id % 2 = 0").select("t").intersect(texts.where("doc_id % 2 = 1").select("t"))
    return shared.agg(F.count(F.lit(1)).alias("n_shared"))


@query(f"SELECT {_norm('text')} AS title, min(doc_id) AS doc_id, count(*) AS n_rows FROM documents GROUP BY 1")
def documents_by_title(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("title"))
    return docs.groupBy("title").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_rows"))


@query(
    """
WITH r AS (SELECT source, row_number() OVER (ORDER BY doc_id) AS k FROM documents), b AS (SELECT (k - 1) // 1000 AS b, sha256(string_agg(source, chr(10) ORDER BY k)) AS d FROM r GROUP BY 1)
SELECT CASE WHEN count(*) = 1 THEN max(d) ELSE sha256(string_agg(d, '' ORDER BY b)) END AS fingerprint, count(*) AS n_blocks FROM b"""
)
def ordered_fingerprint(spark, sf_dir):
    return B.ordered_fingerprint(_table(spark, sf_dir, "documents"), "source", "doc_id")


@query("SELECT event_type, count(*) AS n, sum(CAST(props->>'k' AS BIGINT))::BIGINT AS k FROM events GROUP BY event_type")
def json_properties(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("k"))


@query(
    f"""
WITH n AS (SELECT doc_no FROM {_NUMBERS} JOIN events USING (user_id))
SELECT s AS docs, count(*) AS rows FROM n, (VALUES (10), (20), (40)) v(s) WHERE doc_no <= s GROUP BY s"""
)
def nested_training_sets(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    numbered = events.join(W.document_numbers(events, "user_id", "event_id", 40).select("user_id", "doc_no"), "user_id")
    each = numbered.select(F.explode(F.filter(F.array(F.lit(10), F.lit(20), F.lit(40)), lambda s: s >= F.col("doc_no"))).alias("docs"))
    return each.groupBy("docs").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT event_id, user_id FROM (SELECT * FROM events ORDER BY event_id LIMIT 500) WHERE value > 50")
def head_before_filter(spark, sf_dir):
    return S.head_before_filter(_table(spark, sf_dir, "events"), "event_id", 500, F.col("value") > 50).select("event_id", "user_id")


@query(
    f"""
WITH RECURSIVE d AS (SELECT doc_id, len(s) AS n, {_PROBS} AS p FROM (SELECT doc_id, {_LONG} AS s FROM documents)),
l AS (SELECT doc_id, n, list_transform(p, lambda x, i: round(ln(least(greatest(x::DOUBLE, 1e-6), 1 - 1e-6::DOUBLE) / (1 - least(greatest(x::DOUBLE, 1e-6), 1 - 1e-6::DOUBLE))) - ln(-ln((CAST(('0x' || substr(md5(doc_id || ':' || (i - 1)), 1, 8))::BIGINT AS DOUBLE) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)), 9)) AS p FROM d),
w AS (
  SELECT doc_id, n, p, 0 AS start, CAST([] AS INT[]) AS a, CAST([] AS INT[]) AS b FROM l
  UNION ALL
  SELECT doc_id, n, p, CASE WHEN n - start <= 10 THEN n ELSE start + k - 1 END, list_append(a, start::INT), list_append(b, (CASE WHEN n - start <= 10 THEN n ELSE start + k END)::INT)
  FROM (SELECT *, CASE WHEN n - start > 10 THEN -(list_max(list_transform(range(2, 11), lambda k: {{'p': p[start + k], 'd': -abs(k - 6), 'k': -k}})).k) ELSE 0 END AS k FROM w WHERE start < n))
SELECT doc_id, len(a) AS n_chunks, array_to_string(a, ',') AS starts, array_to_string(b, ',') AS ends FROM w WHERE start >= n"""
)
def sampled_chunks(spark, sf_dir):
    spans = C.sampled_spans(F.col("probs"), F.col("n"), 6, 2, 10, 1, F.col("doc_id"))
    return _spans(_split(spark, sf_dir).select("doc_id", spans.alias("x")))


@query(
    f"""
WITH d AS (SELECT doc_id, {_LONG} AS s FROM documents), c AS (SELECT doc_id, unnest(range(0, len(s), 15)) AS p, s FROM d), k AS (SELECT doc_id, p, array_to_string(s[p + 1:p + 15], ' ') AS text FROM c),
q AS (SELECT doc_id, s[len(s) // 2 + 1][1:25] AS answer FROM d WHERE doc_id % 20 = 0 AND len(s) >= 2)
SELECT doc_id AS qid, md5(coalesce(min_by(text, p) FILTER (WHERE contains(text, answer)), '')) AS context FROM q JOIN k USING (doc_id) GROUP BY doc_id"""
)
def gold_contexts(spark, sf_dir):
    docs = _split(spark, sf_dir)
    chunks = docs.select("doc_id", F.posexplode(C.fixed_chunks(F.col("sentences"), 15)).alias("pos", "c")).select("doc_id", "pos", F.array_join("c", " ").alias("text"))
    middle = F.substring(F.get("sentences", F.floor(F.col("n") / 2).cast("int")), 1, 25)
    questions = docs.where("doc_id % 20 = 0 AND n >= 2").select(F.col("doc_id").alias("qid"), "doc_id", middle.alias("answer"))
    return C.gold_contexts(chunks, questions).select("qid", F.md5(F.col("context").cast("binary")).alias("context"))


@query(f"WITH {_POOL} SELECT depth, sum(least(n, depth))::BIGINT AS n_pairs FROM (SELECT qid, count(*) AS n FROM pool GROUP BY qid), (VALUES (5), (20), (50)) v(depth) GROUP BY depth")
def rerank_cost(spark, sf_dir):
    return R.pool_cost(_pool(spark, sf_dir), [5, 20, 50])


@query(
    f"""
WITH {_POOL}, a AS (SELECT qid, chunk_id, rank, hit, 'dense' AS arm, -rank::DOUBLE AS s FROM pool WHERE rank <= 20 UNION ALL SELECT qid, chunk_id, rank, hit, 'overlap', pair_score FROM pool WHERE rank <= 20 UNION ALL SELECT qid, chunk_id, rank, hit, 'reverse', rank::DOUBLE FROM pool WHERE rank <= 20),
r AS (SELECT arm, qid, hit, row_number() OVER (PARTITION BY arm, qid ORDER BY s DESC, rank) AS new FROM a),
f AS (SELECT arm, qid, max(CASE WHEN hit AND new = 1 THEN 1 ELSE 0 END) AS h1, max(CASE WHEN hit AND new <= 5 THEN 1 ELSE 0 END) AS h5 FROM r GROUP BY ALL)
SELECT arm, count(*) AS n, round(avg(h1), 9) AS recall_1, round(avg(h5), 9) AS recall_5 FROM f GROUP BY arm"""
)
def shared_pool_arms(spark, sf_dir):
    pool = _pool(spark, sf_dir).where("rank <= 20")
    arms = F.array(*[F.struct(F.lit(a).alias("arm"), s.cast("double").alias("s")) for a, s in (("dense", -F.col("rank")), ("overlap", F.col("pair_score")), ("reverse", F.col("rank")))])
    each = pool.select("qid", "chunk_id", "rank", "hit", F.explode(arms).alias("a")).select("qid", "chunk_id", "hit", "a.*", F.col("rank").alias("old"))
    new = F.row_number().over(Window.partitionBy("arm", "qid").orderBy(F.col("s").desc(), "old"))
    hits = lambda k: F.max(F.when(F.col("hit") & (F.col("new") <= k), 1).otherwise(0)).alias(f"h{k}")
    flags = each.withColumn("new", new).groupBy("arm", "qid").agg(hits(1), hits(5))
    return flags.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("h1"), 9).alias("recall_1"), F.round(F.avg("h5"), 9).alias("recall_5"))


@query(
    f"""
WITH {_POOL}, r AS (SELECT qid, chunk_id, rank, row_number() OVER (PARTITION BY qid ORDER BY pair_score DESC, rank) AS new FROM pool)
SELECT new - rank AS moved, count(*) AS n FROM r GROUP BY 1"""
)
def rank_movement(spark, sf_dir):
    moved = R.reranked(_pool(spark, sf_dir), [50]).select((F.col("rank") - F.col("dense_rank")).alias("moved"))
    return moved.groupBy("moved").agg(F.count(F.lit(1)).alias("n"))


@query(
    """
WITH p AS (SELECT sha1(concat_ws(chr(31), role, text)) AS k, conv_id, turn FROM conversations), c AS (SELECT DISTINCT k FROM p WHERE conv_id % 3 = 0)
SELECT count(DISTINCT k) AS n_pending FROM p WHERE k NOT IN (SELECT k FROM c)"""
)
def pending_pair_scores(spark, sf_dir):
    pairs = _table(spark, sf_dir, "conversations").withColumn("pair_key", R.pair_key(F.col("role"), F.col("text")))
    return R.pending_pairs(pairs, pairs.where("conv_id % 3 = 0")).agg(F.count(F.lit(1)).alias("n_pending"))


@query(
    """
WITH v AS (SELECT vec_id, label, CASE WHEN vec_id % 3 = 1 THEN list_transform(embedding::DOUBLE[], lambda x: -x) ELSE embedding::DOUBLE[] END AS e FROM embeddings),
s AS (SELECT q.vec_id AS qid, c.label = q.label AS hit, c.vec_id, round(list_inner_product(q.e, c.e), 9) AS score FROM v q, v c WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10)
SELECT qid, round(coalesce(max(CASE WHEN hit AND vec_id <> qid THEN 1.0::DOUBLE / rank END), 0), 9) AS reward FROM r GROUP BY qid"""
)
def swapped_corpus_reward(spark, sf_dir):
    """A third of the vectors change; lists that were searched once over the old ones are mended, not searched again."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    updates = rows.where("vec_id % 3 = 1").withColumn("vec", F.transform("vec", lambda x: -x))
    queries = R.swapped(rows.where("vec_id % 20 = 0"), updates.where("vec_id % 20 = 0"), "vec_id").select(F.col("vec_id").alias("qid"), "vec")
    as_chunks = lambda df: df.select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("doc_id"), "vec")
    corpus = freeze(as_chunks(rows), queries, 10)
    base = swapped_lists(corpus, updates.select(F.col("vec_id").alias("doc_id")), queries).select("qid", "chunk_id", "score")
    new = R.dense_top_k(as_chunks(updates), queries, 10).select("qid", "chunk_id", "score")
    top = R.ranked(base.unionByName(new), 10, ["qid"], [F.col("score").desc(), F.col("chunk_id")])
    own = rows.select(F.col("vec_id").alias("qid"), F.col("label").alias("wanted"))
    lists = top.join(own, "qid").join(rows.select(F.col("vec_id").alias("chunk_id"), "label"), "chunk_id")
    hit = (F.col("label") == F.col("wanted")) & (F.col("qid") != F.col("chunk_id"))
    return R.first_hit_rank(lists.withColumn("hit", hit)).select("qid", F.round(M.reciprocal(F.col("first_rank")), 9).alias("reward"))


@query(f"SELECT doc_id, list_filter(list_reverse(string_split({_norm('text')}, ' '))[1:5], lambda x: contains(text, x))[1] AS answer FROM documents")
def contained_candidate(spark, sf_dir):
    words = F.slice(F.reverse(F.split(T.normalize_text(F.col("text")), " ")), 1, 5)
    return _table(spark, sf_dir, "documents").select("doc_id", R.first_contained(F.col("text"), words).alias("answer"))


@query(
    f"""
SELECT size, overlap, round(max(CASE WHEN method = 'ECONOMY' THEN recall END), 6) AS economy, round(max(CASE WHEN method = 'STANDARD' THEN recall END), 6) AS standard, round(max(CASE WHEN method = 'PROMO' THEN recall END), 6) AS promo,
  CASE WHEN count(CASE WHEN method IN ('ECONOMY', 'STANDARD', 'PROMO') THEN 1 END) >= 2 THEN round(max(CASE WHEN method IN ('ECONOMY', 'STANDARD', 'PROMO') THEN recall END) - min(CASE WHEN method IN ('ECONOMY', 'STANDARD', 'PROMO') THEN recall END), 6) END AS spread
FROM {_RESULTS} GROUP BY ALL"""
)
def matched_summary(spark, sf_dir):
    arms = ["ECONOMY", "STANDARD", "PROMO"]
    wide = B.arms_side_by_side(_results(spark, sf_dir), ["size", "overlap"], "method", arms, "recall")
    known = F.size(F.filter(F.array(*arms), lambda x: x.isNotNull()))
    spread = F.when(known >= 2, F.round(F.greatest(*arms) - F.least(*arms), 6))
    return wide.select("size", "overlap", *[F.round(a, 6).alias(a.lower()) for a in arms], spread.alias("spread"))


@query(
    f"""
WITH t AS (SELECT role, text, turn, {_norm_answer("text")} AS w, array_to_string(string_split({_norm("text")}, ' ')[2:4], ' ') AS ans, string_split({_norm("text")}, ' ') AS raw FROM conversations),
k AS (SELECT *, {_norm_answer("ans")} AS a, list_filter(string_split(w, ' '), lambda x: x <> '') AS ps, list_filter(string_split({_norm_answer("ans")}, ' '), lambda x: x <> '') AS xs FROM t),
f AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(ps), lambda x: least(len(list_filter(ps, lambda y: y = x)), len(list_filter(xs, lambda y: y = x))))), 0) AS shared FROM k),
r AS (SELECT role, (contains(' ' || w || ' ', ' ' || a || ' ') AND a <> '')::INT AS accurate, (w = a)::INT AS exact, CASE WHEN shared = 0 THEN 0 ELSE 2.0::DOUBLE * shared / (len(ps) + len(xs)) END AS f1,
  CASE WHEN turn % 5 <> 0 THEN turn % 2 = 0 END AS hit, len(string_split(ans, ' ')) AS na, len(raw) AS nw, length(text) AS nt, turn % 3 AS n_cut, CASE WHEN turn % 4 <> 0 THEN turn % 2 = 0 END AS in_prompt, turn % 3 = 0 AS shown FROM f)
SELECT role, count(*) AS n, round(avg(accurate), 9) AS accuracy, round(avg(exact), 9) AS exact, round(avg(f1), 9) AS f1, round(avg(accurate) FILTER (WHERE hit), 9) AS accuracy_hit, count(*) FILTER (WHERE hit) AS n_hit, round(avg(accurate) FILTER (WHERE NOT hit), 9) AS accuracy_miss, count(*) FILTER (WHERE NOT hit) AS n_miss,
  round(avg(accurate) FILTER (WHERE na <= 2), 9) AS accuracy_short, count(*) FILTER (WHERE na <= 2) AS n_short, round(avg(accurate) FILTER (WHERE na > 2), 9) AS accuracy_long, count(*) FILTER (WHERE na > 2) AS n_long, round(avg(nw), 9) AS mean_words, round(avg(nt), 9) AS mean_tokens, sum(n_cut)::BIGINT AS n_cut, count(*) FILTER (WHERE NOT in_prompt AND shown) AS n_lost
FROM r GROUP BY role"""
)
def reader_roll_up(spark, sf_dir):
    words = F.split(T.normalize_text(F.col("text")), " ")
    rows = _table(spark, sf_dir, "conversations").withColumn("answer", F.array_join(F.slice(words, 2, 3), " "))
    p, a, turn = F.col("text"), F.col("answer"), F.col("turn")
    scored = rows.select(
        "role", T.contains_answer(p, a).alias("accurate"), T.exact_match(p, a).alias("exact"), T.token_f1(p, a).alias("f1"), F.when(turn % 5 != 0, turn % 2 == 0).alias("hit"), F.size(F.split(a, " ")).alias("n_answer"),
        F.size(words).alias("n_words"), F.length(p).alias("n_tokens"), (turn % 3).alias("n_cut"), F.when(turn % 4 != 0, turn % 2 == 0).alias("in_prompt"), (turn % 3 == 0).alias("shown"),
    )
    out = M.answer_roll_up(scored, ["role"], 2)
    return out.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(f"WITH e AS (SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM {_NUMBERS} WHERE doc_no <= 10)), n AS (SELECT user_id, min(event_id) AS f, row_number() OVER (ORDER BY min(event_id)) AS d FROM e GROUP BY user_id) SELECT event_id, user_id FROM e WHERE event_id <= coalesce((SELECT f FROM n WHERE d = 20), 9e18)")
def holdout_window(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("event_id", "user_id")
    skipped = W.document_numbers(events, "user_id", "event_id", 10)
    return W.first_documents(W.excluding(events, skipped, "user_id"), "user_id", "event_id", 20).select("event_id", "user_id")


@query("WITH k AS (SELECT event_id, user_id FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 200) SELECT user_id, min(event_id) AS first_at, count(*) AS n_questions FROM k GROUP BY user_id")
def first_kept_questions(spark, sf_dir):
    kept = W.first_questions(_table(spark, sf_dir, "events"), "event_id", 200, F.col("event_type") == "click")
    return kept.groupBy("user_id").agg(F.min("event_id").alias("first_at"), F.count(F.lit(1)).alias("n_questions"))


@query(
    """
WITH g AS (SELECT l_orderkey AS qid, list(l_discount * 10 ORDER BY l_linenumber, l_partkey, l_suppkey) AS s FROM lineitem GROUP BY ALL)
SELECT qid, round(ln(list_sum(list_transform(s, lambda x: exp(x)))) - list_sum(list_transform(s, lambda x: x * exp(x))) / list_sum(list_transform(s, lambda x: exp(x))), 6) + 0.0::DOUBLE AS entropy,
  round(list_sum(list_transform(range(1, least(2, len(s)) + 1), lambda i: s[i] - ln(list_sum(list_transform(s[i:], lambda x: exp(x)))))), 6) + 0.0::DOUBLE AS log_prob FROM g"""
)
def policy_log_probs(spark, sf_dir):
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", (F.col("l_discount") * 10).alias("s"))))
    g = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("qid")).agg(F.transform(ordered, lambda x: x["s"]).alias("s"))
    return g.select("qid", (F.round(M.entropy(F.col("s")), 6) + 0.0).alias("entropy"), (F.round(M.prefix_log_prob(F.col("s"), 2), 6) + 0.0).alias("log_prob"))


@query(
    f"""
WITH d AS (SELECT doc_id, s, {_PROBS} AS p FROM (SELECT doc_id, {_LONG} AS s FROM documents)), e AS (SELECT unnest(p) AS p, unnest(list_transform(s[1:len(s) - 1], lambda x: CASE WHEN length(x) % 4 = 0 THEN 1 ELSE 0 END)) AS y FROM d)
SELECT count(*) AS n, sum(CASE WHEN p > 0.5::FLOAT AND y = 1 THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN p > 0.5::FLOAT AND y = 0 THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN NOT p > 0.5::FLOAT AND y = 1 THEN 1 ELSE 0 END)::BIGINT AS fn FROM e"""
)
def boundary_counts(spark, sf_dir):
    labels = F.transform("sentences", lambda x: F.when(F.length(x) % 4 == 0, 1).otherwise(0))
    m = F.least(F.size("probs"), F.size(labels))
    both = F.arrays_zip(F.slice("probs", 1, m).alias("p"), F.slice(labels, 1, m).alias("y"))
    e = _split(spark, sf_dir).where("n >= 2").select(F.explode(both).alias("x")).select("x.*")
    up = F.col("p") > F.lit(0.5).cast("float")
    return e.agg(F.count(F.lit(1)).alias("n"), F.count_if(up & (F.col("y") == 1)).alias("tp"), F.count_if(up & (F.col("y") == 0)).alias("fp"), F.count_if(~up & (F.col("y") == 1)).alias("fn"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm, round(list_sum(list_transform(list_zip(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), lambda z: abs(z[1] - z[2]))), 6) AS gap FROM embeddings")
def vector_features(spark, sf_dir):
    v = _table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    norm, gap = F.sqrt(total(F.transform("v", lambda x: x * x))), total(F.zip_with("v", F.reverse("v"), lambda a, b: F.abs(a - b)))
    return v.select("vec_id", F.round(norm, 6).alias("norm"), F.round(gap, 6).alias("gap"))


@query("SELECT p_type || ' ' || p_size || '/' || right(p_brand, 1) AS label, count(*) AS n FROM part GROUP BY 1")
def configuration_labels(spark, sf_dir):
    label = F.format_string("%s %d/%s", F.col("p_type"), F.col("p_size"), F.expr("right(p_brand, 1)"))
    return _table(spark, sf_dir, "part").groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, sha256(text) AS digest FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def unarchived_contents(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return S.pending(docs, docs.where("doc_id % 2 = 0"), ["digest"]).select("source", "digest")


@query()
def boundary_model(spark, sf_dir):
    """Vectors of ten are a document; a boundary lies where the label changes. Fitted on four fifths of the documents, applied to all."""
    rows = _table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("doc_id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"), "label")
    changes = rows.select("doc_id", "pos", (F.lead("label").over(Window.partitionBy("doc_id").orderBy("pos")) != F.col("label")).cast("int").alias("label"))
    pairs = settled(N.neighbours(rows).join(changes, ["doc_id", "pos"]))
    model = N.fit(pairs.where(W.hash_split(F.col("doc_id")) == "train"))
    return N.probabilities(model, pairs).select("doc_id", "pos", "label", F.round("p", 6).alias("p"))


def _sweep_sql(size: int, overlap: int) -> str:
    return f"""
WITH d AS (SELECT doc_id, {_LONG} AS s FROM documents), l AS (SELECT doc_id, list_transform(range(0, len(s), {size - overlap}), lambda p: s[p + 1:p + {size}]) AS c FROM d),
t AS (SELECT doc_id, CASE WHEN {overlap} > 0 AND len(c) >= 2 AND len(c[-1]) <= {overlap} THEN c[1:len(c) - 1] ELSE c END AS c FROM l),
u AS (SELECT doc_id, unnest(c) AS x, unnest(range(0, len(c))) AS pos FROM t), ch AS (SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS chunk_id, doc_id, array_to_string(x, ' ') AS text, len(x) AS size FROM u),
qs AS (SELECT item_id AS qid, array_to_string(w[1:8], ' ') AS question, array_to_string(w[9:14], ' ') AS answer, n FROM (SELECT item_id, {_norm("text")} AS n, string_split({_norm("text")}, ' ') AS w FROM benchmark)),
gold AS (SELECT qid, doc_id FROM qs JOIN documents d ON contains({_norm("d.text")}, n)),
q AS (SELECT qid, unnest({_TERMS.replace("text", "question")}) AS term FROM qs), qt AS (SELECT qid, term, count(*) AS qtf FROM q GROUP BY ALL),
c AS (SELECT chunk_id, {_TERMS} AS terms FROM ch), st AS (SELECT count(*) AS n, avg(len(terms)) AS av FROM c),
po AS (SELECT term, chunk_id, dl, count(*) AS tf FROM (SELECT chunk_id, len(terms) AS dl, unnest(terms) AS term FROM c) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
sc AS (SELECT qid, chunk_id, round(sum(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * qtf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / av))), 9) AS score FROM po JOIN qt USING (term) JOIN df USING (term), st GROUP BY ALL),
al AS (SELECT qid, chunk_id, score FROM sc UNION ALL SELECT qid, chunk_id, 0.0 FROM qs, (SELECT chunk_id FROM ch ORDER BY chunk_id LIMIT 20) WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.qid = qs.qid AND sc.chunk_id = chunk_id)),
bm AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM al QUALIFY rank <= 20),
pr AS (SELECT bm.qid, bm.chunk_id, rank, ch.doc_id, contains({_norm("ch.text")}, answer) AS hit, gold.doc_id IS NOT NULL AS ok,
  round(coalesce(len(list_intersect(list_distinct({_TERMS.replace("text", "ch.text")}), list_distinct({_TERMS.replace("text", "question")})))::DOUBLE / nullif(len(list_distinct(list_concat({_TERMS.replace("text", "ch.text")}, {_TERMS.replace("text", "question")}))), 0), 0), 9) AS s
  FROM bm JOIN ch ON ch.chunk_id = bm.chunk_id JOIN qs ON qs.qid = bm.qid LEFT JOIN gold ON gold.qid = bm.qid AND gold.doc_id = ch.doc_id),
ar AS (SELECT 'bm25' AS arm, qid, rank, hit, ok FROM pr UNION ALL SELECT 'rerank', qid, row_number() OVER (PARTITION BY qid ORDER BY s DESC, rank), hit, ok FROM pr),
e AS (SELECT arm, k, qid, max(CASE WHEN rank <= k AND hit AND ok THEN 1 ELSE 0 END) AS c, max(CASE WHEN rank <= k AND hit THEN 1 ELSE 0 END) AS u FROM ar, (VALUES (1), (3), (5)) v(k) GROUP BY ALL)
SELECT {size} AS size, {overlap} AS overlap, arm, k, (SELECT count(*) FROM ch) AS n_chunks, round((SELECT avg(size) FROM ch), 6) AS avg_chunk_size, round(avg(c), 6) AS recall, round(avg(u), 6) AS recall_unconstrained FROM e GROUP BY arm, k"""


@query(" UNION ALL ".join(f"SELECT * FROM ({_sweep_sql(*c)})" for c in ((6, 0), (10, 1), (15, 0))))
def retrieval_sweep(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    whole = T.normalize_text(F.col("text"))
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), whole.alias("whole"), F.split(whole, " ").alias("w"))
    questions = items.select("qid", F.array_join(F.slice("w", 1, 8), " ").alias("question"), F.array_join(F.slice("w", 9, 6), " ").alias("answer"))
    gold = settled(R.containing_documents(docs.select("doc_id", whole.alias("page")), items.select("qid", F.col("whole").alias("answer"))))
    out = bm25_sweep(docs.select("doc_id", T.long_sentences(F.col("text")).alias("sentences")), questions, gold, [(6, 0), (10, 1), (15, 0)], [1, 3, 5])
    return out.select("size", "overlap", "arm", "k", "n_chunks", *[F.round(c, 6).alias(c) for c in ("avg_chunk_size", "recall", "recall_unconstrained")])


def _vector_sql(source: str, name: str) -> str:
    """CTEs that add to a source with text x its vector v, as the CTE `name`."""
    return f"""{name}1 AS (SELECT *, list_transform(regexp_extract_all(lower(x), '[a-z0-9]+'), lambda t: ('0x' || substr(md5(t), 1, 6))::INT % 16) AS bu FROM {source}),
{name}2 AS (SELECT * EXCLUDE (bu), list_transform(range(0, 16), lambda i: len(list_filter(bu, lambda y: y = i))::DOUBLE) AS co FROM {name}1),
{name}3 AS (SELECT *, sqrt(list_sum(list_transform(co, lambda y: y * y))) AS no FROM {name}2),
{name} AS (SELECT * EXCLUDE (co, no), list_transform(co, lambda y: CASE WHEN no > 0 THEN y / no ELSE 0 END) AS v FROM {name}3)"""


@query(
    f"""
WITH RECURSIVE s AS (SELECT doc_id, unnest(s) AS x, unnest(range(0, len(s))) AS i, len(s) AS n FROM (SELECT doc_id, {_LONG} AS s FROM documents)),
{_vector_sql("s", "v")},
pr AS (SELECT a.doc_id, a.i, round(1.0::DOUBLE - list_inner_product(a.v, b.v), 6) AS p FROM v a JOIN v b ON a.doc_id = b.doc_id AND b.i = a.i + 1),
d AS (SELECT documents.doc_id, coalesce(max(s.n), 0) AS n, (SELECT list(p ORDER BY i) FROM pr WHERE pr.doc_id = documents.doc_id) AS p FROM documents LEFT JOIN s USING (doc_id) GROUP BY documents.doc_id),
w AS (
  SELECT doc_id, n, p, 0 AS start, CAST([] AS INT[]) AS a, CAST([] AS INT[]) AS b FROM d
  UNION ALL
  SELECT doc_id, n, p, CASE WHEN n - start <= 10 THEN n ELSE start + k - 1 END, list_append(a, start::INT), list_append(b, (CASE WHEN n - start <= 10 THEN n ELSE start + k END)::INT)
  FROM (SELECT *, CASE WHEN n - start > 10 THEN -(list_max(list_transform(range(2, 11), lambda k: {{'p': p[start + k], 'd': -abs(k - 6), 'k': -k}})).k) ELSE 0 END AS k FROM w WHERE start < n))
SELECT doc_id, len(a) AS n_chunks, array_to_string(a, ',') AS starts, array_to_string(b, ',') AS ends FROM w WHERE start >= n"""
)
def hashed_boundary_chunks(spark, sf_dir):
    docs = _split(spark, sf_dir).select("doc_id", "n", P.boundary_probs(F.col("sentences")).alias("probs"))
    return _spans(docs.select("doc_id", C.target_spans(F.col("probs"), F.col("n"), 6, 2, 10, 1).alias("x")))


@query(
    f"""
WITH d AS (SELECT doc_id, {_LONG} AS s FROM documents), u AS (SELECT doc_id, s, unnest(range(0, len(s), 10)) AS p FROM d), c AS (SELECT row_number() OVER (ORDER BY doc_id, p) - 1 AS chunk_id, array_to_string(s[p + 1:p + 10], ' ') AS x FROM u), q AS (SELECT item_id AS qid, text AS x FROM benchmark),
{_vector_sql("c", "cv")}, {_vector_sql("q", "qv")},
sc AS (SELECT qid, chunk_id, round(list_inner_product(qv.v, cv.v), 9) AS score FROM qv, cv)
SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM sc QUALIFY rank <= 5"""
)
def hashed_dense_search(spark, sf_dir):
    chunks = fixed_chunk_table(_split(spark, sf_dir), 10, 0)
    vectors = P.encoded(chunks.select("chunk_id", "text"), "text", P.hashed_vector).select("chunk_id", "vec")
    questions = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), P.hashed_vector(F.col("text")).alias("vec"))
    return R.dense_top_k(vectors, questions, 5)
