"""Registered queries that write given tables in the engine's file formats and read them back, resume from them, or bring them up to date."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.wikitext import wikitext_sections
from ..operators import retrieval as R
from ..operators.chunking import METHODS, config_grid
from ..operators.score_store import score_pairs
from ..operators.sentence_breaks import break_sentences, learn
from ..sources import readers as S
from ..sources import writers as K
from ..sources.scratch import settled, shared_folder
from ..sources.versions import commit, current, refreshed
from .queries import _BARE, _LONG, _OTHER_PROBS, _PAIR, _PROBS, _bm25_sql, _norm, _split, _table, query
from .sweep import grid_sweep


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"


def _docs(spark, sf_dir) -> DataFrame:
    rows = _table(spark, sf_dir, "documents")
    return rows.select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 3 != 0, F.concat_ws(" ", F.lit("title"), "source")).alias("title"), T.long_sentences(F.col("text")).alias("sentences"))


@query(f"SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 3 <> 0 AND source IS NOT NULL THEN 'title ' || source WHEN doc_id % 3 <> 0 THEN 'title' ELSE doc_id::VARCHAR END AS title, len(s) AS n FROM (SELECT *, {_LONG} AS s FROM documents) WHERE len(s) >= 2")
def documents_from_json_lines(spark, sf_dir):
    """Documents written as JSON lines and read with their schema: those of two sentences or more, the title falling back on the id."""
    path = _folder(spark)
    K.write_jsonl(_docs(spark, sf_dir), path)
    return S.read_docs(spark, path).select("id", "title", F.size("sentences").cast("long").alias("n"))


@query("SELECT item_id AS qid, text AS question, string_split(text, ' ')[1] AS answer, CASE WHEN item_id % 2 = 0 THEN 't' || item_id ELSE 'u' || item_id || ',v' END AS gold FROM benchmark WHERE item_id % 5 <> 0")
def questions_from_json_lines(spark, sf_dir):
    """Questions with one title or a list of them; those without an answer are left out."""
    path, n = _folder(spark), F.col("item_id")
    rows = _table(spark, sf_dir, "benchmark").select(n.alias("qid"), F.col("text").alias("question"), F.when(n % 5 != 0, F.split("text", " ")[0]).alias("answer"), F.concat(F.lit("t"), n.cast("string")).alias("doc_title"), F.when(n % 2 != 0, F.array(F.concat(F.lit("u"), n.cast("string")), F.lit("v"))).alias("doc_titles"))
    K.write_jsonl(rows, path)
    read = S.read_questions(spark, path)
    return read.join(rows.select("qid", "question"), "question").select("qid", "question", "answer", F.array_join("gold", ",").alias("gold"))


@query("SELECT size, overlap, n, CASE WHEN recall IS NOT NULL THEN round(recall, 4) END AS recall FROM (SELECT p_size AS size, p_size % 3 AS overlap, count(*) AS n, avg(CASE WHEN p_size % 7 <> 0 THEN p_retailprice / 10000 END) AS recall FROM part GROUP BY p_size)")
def results_from_csv(spark, sf_dir):
    """Result rows in the order of columns asked for, numbers with four decimals, read with a declared schema."""
    path = _folder(spark)
    rows = _table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice") / 10000)).alias("recall"))
    K.write_results(rows.select("size", (F.col("size") % 3).alias("overlap"), "n", F.col("recall").cast("double")), path, ["size", "overlap", "n", "recall"])
    return S.read_results(spark, path, "size int, overlap int, n long, recall double")


@query("SELECT nation.n_nationkey AS key, count(c_custkey) AS n, CASE WHEN n_nationkey % 4 = 0 THEN 'again' ELSE 'kept' END AS how FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def refreshed_table(spark, sf_dir):
    """A table with versions: the second refresh computes again only the keys whose inputs differ, and takes the others over."""
    path = _folder(spark)
    customers = _table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = _table(spark, sf_dir, "nation").join(customers, "n_nationkey", "left").select(F.col("n_nationkey").alias("key"), F.coalesce("n", F.lit(0)).alias("n"))
    as_ = lambda how: lambda todo: todo.select("key", "n", F.lit(how).alias("how"))
    refreshed(rows.withColumn("n", F.when(F.col("key") % 4 == 0, F.col("n") + 1).otherwise(F.col("n"))), path, ["key"], ["n"], as_("kept"))
    refreshed(rows, path, ["key"], ["n"], as_("again"))
    return current(spark, path).select("key", "n", "how")


@query("SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY ALL")
def replaced_table(spark, sf_dir):
    """A version made from the one before, which the pointer then leaves."""
    path = _folder(spark)
    commit(_table(spark, sf_dir, "orders").select("o_orderpriority"), path)
    commit(current(spark, path).groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n")), path)
    return current(spark, path)


@query("SELECT doc_id, source, length(coalesce(text, '')) AS n FROM documents")
def materialised_incrementally(spark, sf_dir):
    """Half of the keys are made first, then all: what is there isn't made again."""
    path = _folder(spark)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    make = lambda rows: rows.select("doc_id", "source", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    K.materialise_missing(docs.where("doc_id % 2 = 0"), ["doc_id"], path, make)
    return K.materialise_missing(docs, ["doc_id"], path, make).select("doc_id", "source", "n")


@query("SELECT vec_id AS chunk_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings WHERE label % 2 = 0")
def index_loaded(spark, sf_dir):
    """Vectors saved as an index, of which some documents' are loaded."""
    path = _folder(spark)
    vectors = _table(spark, sf_dir, "embeddings")
    K.save_index(vectors.select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("doc_id"), F.col("embedding").alias("vec")), path)
    wanted = [r.label for r in vectors.select("label").distinct().where("label % 2 = 0").collect()]
    loaded = S.load_index(spark, path, [str(x) for x in wanted])
    return loaded.select("chunk_id", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


@query(
    rf"""
WITH p AS (SELECT page_id, regexp_split_to_array({_BARE}, '<h2[^>]*>') AS parts FROM pages),
s AS (SELECT page_id, unnest(parts) AS part, unnest(range(0, len(parts))) AS pos FROM p)
SELECT page_id, pos, CASE WHEN pos > 0 THEN trim(regexp_replace(string_split(part, '</h2>')[1], '<[^>]*>', '', 'g')) END AS heading,
  trim(regexp_replace(regexp_replace(CASE WHEN pos > 0 THEN substr(part, instr(part, '</h2>') + 5) ELSE part END, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM s"""
)
def wikitext_page_sections(spark, sf_dir):
    """The pages' sections, written as wikitext with templates, links and references strewn in, and read back from it."""
    rows = _table(spark, sf_dir, "pages").select("page_id", F.posexplode(T.html_sections(F.col("html"))).alias("pos", "s"))
    escaped = lambda c: F.regexp_replace(F.replace(c, F.lit("&"), F.lit("&amp;")), r"([{}\[\]'=|<>])", "<nowiki>$1</nowiki>")
    body = F.regexp_replace(escaped(F.col("s.text")), r"^(\p{L}+) (\p{L}+)", "{{note|{{deep|x}} y}}[[$1]]<ref name=\"r\">gone</ref> [[target of it|$2]]")
    heading = F.when(F.col("s.heading").isNotNull(), F.concat(F.lit("\n== "), escaped(F.col("s.heading")), F.lit(" ==\n"))).otherwise("")
    pages = rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat(heading, body).alias("t")))), lambda x: x["t"]), "").alias("wikitext"))
    read = pages.select("page_id", F.posexplode(wikitext_sections(F.col("wikitext"))).alias("pos", "s"))
    return read.select("page_id", "pos", F.col("s.heading").alias("heading"), F.trim(F.regexp_replace("s.text", r"\s+", " ")).alias("body"))


@query()
def learned_sentences(spark, sf_dir):
    """Sentences by abbreviations, starters and pairs that the documents themselves show."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return break_sentences(docs, learn(docs)).select("doc_id", F.size("sentences").alias("n"), F.md5(F.array_join("sentences", "\n").cast("binary")).alias("digest"))


@query(
    f"""
WITH {_bm25_sql(20, 1.5, 0.75)}
SELECT qid, chunk_id, {_PAIR} AS score FROM bm
  JOIN (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS dt FROM documents) d ON doc_id = chunk_id
  JOIN (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS qt2 FROM benchmark) b ON item_id = qid"""
)
def stored_pair_scores(spark, sf_dir):
    """Pairs of items and their best documents, scored in batches of bounded size that are kept one by one."""
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    pool = R.bm25_top_k(docs.select(F.col("doc_id").alias("chunk_id"), "text"), items.select(F.col("item_id").alias("qid"), "text"), 20)
    pairs = pool.select("qid", "chunk_id").join(docs.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("passage")), "chunk_id").join(items.select(F.col("item_id").alias("qid"), F.col("text").alias("question")), "qid")
    score = lambda own: own.withColumn("score", R.term_overlap(F.col("passage"), F.col("question")))
    return score_pairs(pairs, "question", "passage", score, _folder(spark)).select("qid", "chunk_id", "score")


def _grid_sql() -> str:
    """The grid's spans as chunk_config_grid's SQL finds them, then BM25 over each configuration by itself."""
    terms = lambda x: f"regexp_extract_all(lower({x}), '[a-z0-9]+')"
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, s, len(s) AS n, {_PROBS} AS p1, {_OTHER_PROBS} AS p2 FROM (SELECT doc_id, {_LONG} AS s FROM documents)),
g AS (SELECT size, overlap FROM (VALUES (6), (8), (10), (12), (15)) a(size), (VALUES (0), (1)) b(overlap)),
fx AS (SELECT doc_id, size, overlap, list_transform(range(0, n, size - overlap), lambda p: {{'a': p, 'b': least(p + size, n)}}) AS c FROM d, g),
fk AS (SELECT 'fixed' AS method, size, overlap, doc_id, unnest(CASE WHEN overlap > 0 AND len(c) >= 2 AND c[-1].b - c[-1].a <= overlap THEN c[1:len(c) - 1] ELSE c END) AS x FROM fx),
w AS (
  SELECT doc_id, n, m.method, CASE WHEN m.method = 'bilstm' THEN p1 ELSE p2 END AS p, size, overlap, 0 AS start, 0 AS a, 0 AS b FROM d, g, (VALUES ('bilstm'), ('transformer')) m(method)
  UNION ALL
  SELECT doc_id, n, method, p, size, overlap, CASE WHEN n - start <= size + 4 THEN n ELSE start + k - overlap END, start, CASE WHEN n - start <= size + 4 THEN n ELSE start + k END
  FROM (SELECT *, CASE WHEN n - start > size + 4 THEN -(list_max(list_transform(range(greatest(2, size - 4), size + 5), lambda k: {{'p': p[start + k]::DOUBLE, 'd': -abs(k - size), 'k': -k}})).k) ELSE 0 END AS k FROM w WHERE start < n)),
sp AS (SELECT method, size, overlap, doc_id, x.a AS a, x.b AS b FROM fk UNION ALL SELECT method, size, overlap, doc_id, a, b FROM w WHERE b > 0),
ch AS MATERIALIZED (SELECT method, size, overlap, row_number() OVER (PARTITION BY method, size, overlap ORDER BY doc_id, a) - 1 AS chunk_id, doc_id, b - a AS n, array_to_string(s[a + 1:b], ' ') AS x FROM sp JOIN d USING (doc_id)),
qs AS (SELECT item_id AS qid, array_to_string(w[1:8], ' ') AS question, array_to_string(w[9:14], ' ') AS answer, n FROM (SELECT item_id, {_norm("text")} AS n, string_split({_norm("text")}, ' ') AS w FROM benchmark)),
gold AS (SELECT qid, doc_id FROM qs JOIN documents d ON contains({_norm("d.text")}, n)),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({terms("question")}) AS term FROM qs) GROUP BY ALL),
c AS MATERIALIZED (SELECT method, size, overlap, chunk_id, {terms("x")} AS terms FROM ch),
st AS MATERIALIZED (SELECT method, size, overlap, count(*) AS n, avg(len(terms)) AS av FROM c GROUP BY ALL),
po AS MATERIALIZED (SELECT method, size, overlap, chunk_id, dl, term, count(*) AS tf FROM (SELECT method, size, overlap, chunk_id, len(terms) AS dl, unnest(terms) AS term FROM c) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT method, size, overlap, term, count(*) AS df FROM po GROUP BY ALL),
sc AS MATERIALIZED (SELECT method, size, overlap, qid, chunk_id, round(sum(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * qtf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / av))), 9) AS score
  FROM po JOIN qt USING (term) JOIN df USING (method, size, overlap, term) JOIN st USING (method, size, overlap) GROUP BY ALL),
lo AS (SELECT method, size, overlap, chunk_id, qid FROM ch, qs WHERE chunk_id < 20),
al AS (SELECT * FROM sc UNION ALL SELECT method, size, overlap, qid, chunk_id, 0.0 FROM lo ANTI JOIN sc USING (method, size, overlap, qid, chunk_id)),
bm AS (SELECT *, row_number() OVER (PARTITION BY method, size, overlap, qid ORDER BY score DESC, chunk_id) AS rank FROM al QUALIFY rank <= 20),
pr AS (SELECT method, size, overlap, qid, rank, contains({_norm("ch.x")}, answer) AS hit, gold.doc_id IS NOT NULL AS ok,
  round(coalesce(len(list_intersect(list_distinct({terms("ch.x")}), list_distinct({terms("question")})))::DOUBLE / nullif(len(list_distinct(list_concat({terms("ch.x")}, {terms("question")}))), 0), 0), 9) AS s
  FROM bm JOIN ch USING (method, size, overlap, chunk_id) JOIN qs USING (qid) LEFT JOIN gold USING (qid, doc_id)),
ar AS (SELECT method, size, overlap, 'bm25' AS arm, qid, rank, hit, ok FROM pr UNION ALL SELECT method, size, overlap, 'rerank', qid, row_number() OVER (PARTITION BY method, size, overlap, qid ORDER BY s DESC, rank), hit, ok FROM pr),
e AS (SELECT method, size, overlap, arm, k, qid, max(CASE WHEN rank <= k AND hit AND ok THEN 1 ELSE 0 END) AS c, max(CASE WHEN rank <= k AND hit THEN 1 ELSE 0 END) AS u FROM ar, (VALUES (1), (3), (5)) v(k) GROUP BY ALL),
me AS (SELECT method, size, overlap, count(*) AS n_chunks, round(avg(n), 6) AS avg_chunk_size FROM ch GROUP BY ALL)
SELECT method, size, overlap, arm, k, n_chunks, avg_chunk_size, round(avg(c), 6) AS recall, round(avg(u), 6) AS recall_unconstrained FROM e JOIN me USING (method, size, overlap) GROUP BY ALL"""


@query(_grid_sql())
def retrieval_grid_sweep(spark, sf_dir):
    """The whole grid of 30 configurations in one search: chunks, BM25, reranking, recalls."""
    docs = _split(spark, sf_dir)
    other = F.transform(F.slice("sentences", 1, F.greatest(F.size("sentences") - 1, F.lit(0))), lambda s: ((F.length(s) * 53) % 97 / F.lit(97.0)).cast("float"))
    whole = T.normalize_text(F.col("text"))
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), whole.alias("whole"), F.split(whole, " ").alias("w"))
    questions = settled(items.select("qid", F.array_join(F.slice("w", 1, 8), " ").alias("question"), F.array_join(F.slice("w", 9, 6), " ").alias("answer")))
    gold = settled(R.containing_documents(_table(spark, sf_dir, "documents").select("doc_id", whole.alias("page")), items.select("qid", F.col("whole").alias("answer"))))
    out = grid_sweep(docs.withColumn("other", other), questions, gold, config_grid([6, 8, 10, 12, 15], [0, 1], METHODS), [1, 3, 5], {"transformer": "other"})
    return out.select("method", "size", "overlap", "arm", "k", "n_chunks", *[F.round(c, 6).alias(c) for c in ("avg_chunk_size", "recall", "recall_unconstrained")])
