"""More registered queries of the engine's own operators: loading rules, calibration, effect sizes, claims, serving and reader inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import metrics as M
from ..operators import retrieval as R
from ..operators import tables as B
from ..operators import verdicts as V
from ..operators import windows as W
from ..sources import readers as S
from . import queries as Q
from .queries import _BARE, _LONG, _NUMBERS, _POOL, _PROBS, _SCORES, _SWEEP, _norm, _norm_answer, _split, _table, query

_SKIPPED = ", ".join(f"'{x}'" for x in T.SKIPPED_SECTIONS)


# Loading: which rows, sections and pages count.
@query(
    rf"""
WITH p AS (SELECT page_id, regexp_split_to_array({_BARE}, '<h2[^>]*>') AS parts FROM pages),
s AS (SELECT page_id, unnest(parts) AS part, unnest(range(0, len(parts))) AS pos FROM p),
b AS (SELECT page_id, pos, CASE WHEN pos > 0 THEN trim(regexp_replace(string_split(part, '</h2>')[1], '<[^>]*>', '', 'g')) END AS heading,
  trim(regexp_replace(regexp_replace(CASE WHEN pos > 0 THEN substr(part, instr(part, '</h2>') + 5) ELSE part END, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM s),
k AS (SELECT page_id, pos, {_LONG} AS s FROM b WHERE lower(trim(coalesce(heading, '__lead__'))) NOT IN ({_SKIPPED})),
a AS (SELECT page_id, list(s ORDER BY pos) AS sections, sum(len(s)) AS n FROM k WHERE len(s) >= 1 GROUP BY page_id)
SELECT page_id, n::BIGINT AS n_sentences, md5(array_to_string(flatten(sections), '|')) AS digest,
  array_to_string(flatten(list_transform(sections, lambda x, i: list_transform(x, lambda y, j: CASE WHEN j = 1 THEN 1 ELSE 0 END)))[2:], ',') AS labels FROM a WHERE n >= 8"""
)
def article_boundaries(spark, sf_dir):
    """Pages parsed to sentences and section boundaries: boilerplate sections left out, pages of fewer than 8 sentences too."""
    articles = T.parsed_articles(_table(spark, sf_dir, "pages").select("page_id", F.col("html")), "html")
    return articles.select("page_id", F.size("sentences").cast("long").alias("n_sentences"), F.md5(F.array_join("sentences", "|").cast("binary")).alias("digest"), F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


@query(
    f"""
WITH a AS (SELECT page_id, list(CASE WHEN i = 1 THEN 1 ELSE 0 END ORDER BY pos, i)[2:] AS labels FROM (
  SELECT page_id, pos, unnest(range(1, len(s) + 1)) AS i FROM (SELECT page_id, pos, {_LONG} AS s FROM (
    SELECT page_id, unnest(range(0, len(parts))) AS pos, trim(regexp_replace(regexp_replace(unnest(parts), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM (SELECT page_id, regexp_split_to_array({_BARE}, '<p>') AS parts FROM pages)))) GROUP BY page_id),
s AS (SELECT CASE WHEN page_id % 10 < 8 THEN 'train' WHEN page_id % 10 = 8 THEN 'val' ELSE 'test' END AS split, len(labels) AS n, coalesce(list_sum(labels), 0) AS pos FROM a)
SELECT split, count(*) AS n_docs, sum(pos)::BIGINT AS pos, sum(n - pos)::BIGINT AS neg, round(coalesce(sum(pos)::DOUBLE / nullif(sum(n), 0), 0), 9) AS pos_rate, round(sum(n - pos)::DOUBLE / nullif(sum(pos), 0), 9) AS pos_weight FROM s GROUP BY CUBE (split)"""
)
def boundary_corpus_stats(spark, sf_dir):
    """Paragraphs are sections: counts of documents and boundaries by split and in all."""
    bare = F.regexp_replace("html", r"(?is)<(script|style|nav|footer)[^>]*>.*?</(script|style|nav|footer)>", " ")
    plain = F.transform(F.split(bare, "<p>"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", " "), r"\s+", " ")))
    sections = F.filter(F.transform(plain, lambda x: T.long_sentences(x)), lambda s: F.size(s) > 0)
    docs = _table(spark, sf_dir, "pages").select("page_id", sections.alias("sections")).where(F.size("sections") > 0)
    split = F.when(F.col("page_id") % 10 < 8, "train").when(F.col("page_id") % 10 == 8, "val").otherwise("test")
    out = M.corpus_stats(docs.select(split.alias("split"), T.section_labels(F.col("sections")).alias("labels")))
    return out.select("split", "n_docs", "pos", "neg", F.round("pos_rate", 9).alias("pos_rate"), F.round("pos_weight", 9).alias("pos_weight"))


_USABLE = f"(SELECT e.event_id, e.user_id FROM events e JOIN (SELECT doc_id, len({_LONG}) AS n FROM documents) d ON d.doc_id = e.user_id WHERE value > 20 AND n >= 2)"


@query(f"WITH u AS (SELECT * FROM {_USABLE}), n AS (SELECT user_id, min(event_id) AS f, row_number() OVER (ORDER BY min(event_id)) AS d FROM u GROUP BY user_id) SELECT event_id, user_id FROM u WHERE event_id <= coalesce((SELECT f FROM n WHERE d = 15), 9e18)")
def usable_documents_window(spark, sf_dir):
    """A user is a document, an event a question with an answer if its value is over 20: neither kind of useless row adds to the window."""
    texts = _split(spark, sf_dir).select(F.col("doc_id").alias("user_id"), "sentences")
    events = _table(spark, sf_dir, "events").join(texts, "user_id").withColumn("answer", F.when(F.col("value") > 20, F.col("event_type")).otherwise(" "))
    return W.first_documents(W.usable_rows(events, "answer", "sentences").select("event_id", "user_id"), "user_id", "event_id", 15)


_HELD = f"(SELECT e.*, user_id IN (SELECT user_id FROM {_NUMBERS} WHERE doc_no <= 10) AS t, event_type = 'purchase' AS q FROM events e)"


@query(
    f"""
WITH h AS (SELECT * FROM {_HELD}), n AS (SELECT user_id, min(event_id) AS f, row_number() OVER (ORDER BY min(event_id)) AS d FROM h WHERE NOT t AND NOT q GROUP BY user_id), c AS (SELECT coalesce((SELECT f FROM n WHERE d = 20), 9e18) AS c)
SELECT count(*) AS scanned, count(*) FILTER (WHERE t) AS skipped_title, count(*) FILTER (WHERE NOT t AND q) AS skipped_question, count(*) FILTER (WHERE NOT t AND NOT q) AS kept FROM h, c WHERE event_id <= c"""
)
def holdout_counts(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    titles = W.document_numbers(events, "user_id", "event_id", 10)
    questions = events.where("event_type = 'purchase'").select("event_type").distinct()
    kept, stats = W.holdout(events, "user_id", "event_type", "event_id", 20, titles, questions)
    return stats.withColumn("kept", F.lit(kept.count()))


@query("SELECT user_id, row_number() OVER (ORDER BY min(event_id)) - 1 AS doc_id FROM (SELECT * FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 200) GROUP BY user_id")
def inserted_documents(spark, sf_dir):
    kept = W.first_questions(_table(spark, sf_dir, "events"), "event_id", 200, F.col("event_type") == "click")
    return W.inserted_documents(kept.withColumn("pos", F.lit(0)), "event_id", "pos", "user_id")


@query("SELECT event_id, user_id FROM events WHERE event_id > (SELECT max(event_id) FROM (SELECT event_id FROM events ORDER BY event_id LIMIT 700)) AND value > 90")
def rows_after_offset(spark, sf_dir):
    return W.rows_after(_table(spark, sf_dir, "events"), "event_id", 700).where("value > 90").select("event_id", "user_id")


@query(
    """
WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN r <= floor(0.8::DOUBLE * n) THEN 'train' WHEN r <= floor(0.9::DOUBLE * n) THEN 'val' ELSE 'test' END AS split FROM h"""
)
def cut_split(spark, sf_dir):
    return W.cut_split(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query(
    """
WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text <> ''),
s AS (SELECT doc_id, w, [doc_id % 4 - 1, doc_id % 9] AS a, [doc_id % 3, doc_id % 9 + doc_id % 5] AS b FROM w),
f AS (SELECT doc_id, w, CASE WHEN a[1] >= 0 AND b[1] > a[1] THEN a[1] WHEN b[2] > a[2] THEN a[2] END AS x, CASE WHEN a[1] >= 0 AND b[1] > a[1] THEN b[1] WHEN b[2] > a[2] THEN b[2] END AS y FROM s)
SELECT doc_id, CASE WHEN x IS NOT NULL THEN trim(array_to_string(list_filter(w[x + 1:y], lambda t: NOT contains(t, '%')), ' ')) END AS answer FROM f"""
)
def nested_short_answers(spark, sf_dir):
    """Short answers out of both layouts of annotations: structs of arrays for even documents, arrays of structs for odd ones."""
    words = F.split("text", " ")
    start = lambda i: (F.col("doc_id") % 4 - 1 if i == 0 else F.col("doc_id") % 9).cast("int")
    end = lambda i: (F.col("doc_id") % 3 if i == 0 else F.col("doc_id") % 9 + F.col("doc_id") % 5).cast("int")
    rows = _table(spark, sf_dir, "documents").where("text <> ''").select(
        "doc_id",
        F.struct(F.struct(words.alias("token"), F.transform(words, lambda t: F.contains(t, F.lit("%"))).alias("is_html")).alias("tokens")).alias("document"),
        F.struct(F.array(start(0), start(1)).alias("start_token"), F.array(end(0), end(1)).alias("end_token")).alias("lists"),
        F.array(*[F.struct(F.array(start(i)).alias("start_token"), F.array(end(i)).alias("end_token")) for i in (0, 1)]).alias("structs"),
    )
    spans = F.when(F.col("doc_id") % 2 == 0, S.spans(F.col("lists"), True)).otherwise(S.spans(F.col("structs"), False))
    found = rows.withColumn("s", S.first_short_answer(F.array(spans)))
    tokens, is_html = S.doc_tokens(F.col("document"))
    return found.select("doc_id", F.when(F.col("s").isNotNull(), F.trim(S.joined_tokens(tokens, is_html, F.col("s.start"), F.col("s.end")))).alias("answer"))


# Answers and the pages that hold them.
_CANDIDATES = f"(SELECT item_id AS qid, 0 AS pos, {_norm('text')} || ' zz' AS answer FROM benchmark UNION ALL SELECT item_id, 1, array_to_string(string_split({_norm('text')}, ' ')[3:6], ' ') FROM benchmark UNION ALL SELECT item_id, 2, string_split({_norm('text')}, ' ')[2] FROM benchmark UNION ALL SELECT item_id, 3, '' FROM benchmark)"


@query(
    f"""
WITH c AS (SELECT * FROM {_CANDIDATES} WHERE answer <> ''), d AS (SELECT doc_id, {_norm('text')} AS page FROM documents), h AS (SELECT qid, pos, answer, doc_id FROM c JOIN d ON contains(page, answer))
SELECT h.qid, pos, answer, count(*) AS n_gold, min(doc_id) AS first_gold, sum(doc_id)::BIGINT AS sum_gold FROM h JOIN (SELECT qid, min(pos) AS pos FROM h GROUP BY qid) USING (qid, pos) GROUP BY ALL"""
)
def gold_answer_pages(spark, sf_dir):
    """The first candidate answer of each item that any document holds, of four, two or one word, and all documents that hold it."""
    pages = _table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("page"))
    norm = T.normalize_text(F.col("text"))
    w = F.split(norm, " ")
    tried = F.array(F.concat(norm, F.lit(" zz")), F.array_join(F.slice(w, 3, 4), " "), F.get(w, F.lit(1)), F.lit(""))
    candidates = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.posexplode(tried).alias("pos", "answer")).where("answer IS NOT NULL")
    gold = R.gold_pages(pages, candidates)
    return gold.groupBy("qid", "pos", "answer").agg(F.count(F.lit(1)).alias("n_gold"), F.min("doc_id").alias("first_gold"), F.sum("doc_id").alias("sum_gold"))


@query(
    f"""
WITH t AS (SELECT conv_id, list({{'turn': turn, 'text': {_norm('text')}}} ORDER BY turn) AS p, max_by({_norm('text')}, turn) AS last FROM conversations GROUP BY conv_id),
c AS (SELECT conv_id, p, [last || ' zz', array_to_string(string_split(last, ' ')[1:2], ' '), string_split(last, ' ')[1]] AS c FROM t),
h AS (SELECT conv_id, unnest(c) AS answer, unnest(range(0, 3)) AS pos, p FROM c)
SELECT conv_id, answer, array_to_string(list_transform(list_filter(p, lambda x: contains(x.text, answer)), lambda x: x.turn), ',') AS gold FROM h WHERE len(list_filter(p, lambda x: contains(x.text, answer))) > 0 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos) = 1"""
)
def chosen_answers(spark, sf_dir):
    """A conversation's turns are a question's own pages: its first candidate that a turn holds, with all turns that do."""
    turns = _table(spark, sf_dir, "conversations")
    pages = F.array_sort(F.collect_list(F.struct("turn", "text")))
    rows = turns.groupBy("conv_id").agg(F.transform(pages, lambda x: F.struct(x["turn"].alias("title"), x["text"].alias("text"))).alias("pages"), F.max_by(T.normalize_text(F.col("text")), "turn").alias("last"))
    w = F.split("last", " ")
    candidates = F.array(F.concat("last", F.lit(" zz")), F.array_join(F.slice(w, 1, 2), " "), w[0])
    found = rows.select("conv_id", S.chosen_answer(F.col("pages"), candidates).alias("x")).where("x IS NOT NULL")
    return found.select("conv_id", F.col("x.answer").alias("answer"), F.array_join(F.col("x.gold").cast("array<string>"), ",").alias("gold"))


@query(
    f"""
WITH q AS (SELECT conv_id, turn, {_norm_answer("array_to_string(string_split(text, ' ')[1:2], ' ')")} AS a FROM conversations WHERE role = 'user'), c AS (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant' AND length(text) > 40)
SELECT 'closed' AS arm, conv_id, turn, 0 AS n_passages FROM q WHERE a <> '' UNION ALL SELECT 'open', conv_id, turn, 1 FROM q JOIN c USING (conv_id, turn) WHERE a <> ''"""
)
def reader_work_items(spark, sf_dir):
    """Which questions each reader arm is asked: an answer that isn't empty when normalised, and passages unless the book is closed."""
    turns = _table(spark, sf_dir, "conversations")
    qid = F.struct("conv_id", "turn")
    asked = turns.where("role = 'user'").select(qid.alias("qid"), F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("answer"))
    said = turns.where("role = 'assistant'").select(F.struct("conv_id", (F.col("turn") - 1).alias("turn")).alias("qid"), F.when(F.length("text") > 40, F.array(F.struct(F.lit("t").alias("title"), F.col("text")))).otherwise(F.array().cast("array<struct<title:string,text:string>>")).alias("passages"))
    arms = S.work_items(asked, None).withColumn("arm", F.lit("closed")).unionByName(S.work_items(asked, said).withColumn("arm", F.lit("open")))
    return arms.select("arm", "qid.*", F.coalesce(F.when(F.col("passages").isNotNull(), F.size("passages")), F.lit(0)).alias("n_passages"))


# Calibration, effect sizes and claims.
_HASHED = "CAST(('0x' || substr(md5('0:' || doc_id), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0"
_THREE = f"(SELECT CASE WHEN {_HASHED} < 0.5 THEN 'val' ELSE 'test' END AS split, quality AS label, CAST((n_chars % 1000) / 999.0::DOUBLE AS FLOAT) AS p FROM labels JOIN documents USING (doc_id))"


@query(
    f"""
WITH {_SWEEP.replace(_SCORES, f"(SELECT label, p FROM {_THREE} WHERE split = 'val')")},
b AS (SELECT threshold FROM sw ORDER BY f1 DESC, threshold DESC LIMIT 1), k AS (SELECT 'calibrated' AS kind, threshold FROM b UNION ALL SELECT 'fixed', 0.8::DOUBLE),
c AS (SELECT split, kind, threshold, count(*) FILTER (WHERE p > threshold::FLOAT AND label = 1) AS tp, count(*) FILTER (WHERE p > threshold::FLOAT AND label <> 1) AS fp, count(*) FILTER (WHERE NOT p > threshold::FLOAT AND label = 1) AS fn FROM {_THREE}, k GROUP BY ALL)
SELECT *, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM c"""
)
def calibrated_threshold(spark, sf_dir):
    """The threshold of best F1 on one half of the labelled documents, reported on both halves beside a fixed one."""
    rows = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    half = F.when(W.hash_split(F.col("doc_id"), (0.5, 0.5)) == "train", "val").otherwise("test")
    scores = rows.select(half.alias("split"), F.col("quality").alias("label"), ((F.col("n_chars") % 1000) / F.lit(999.0)).cast("float").alias("p"))
    return M.calibrated(scores).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(
    """
WITH g AS (SELECT l_returnflag AS f, count(*)::DOUBLE AS n, avg(l_discount) AS m, var_pop(l_discount) * count(*) AS ss FROM lineitem GROUP BY 1), a AS (SELECT sum(n) AS n, sum(ss) AS rest FROM g), v AS (SELECT n - 3 AS dof, rest / (n - 3) AS sigma, 1 - rest / (SELECT var_pop(l_discount) * count(*) FROM lineitem) AS r2 FROM a),
t AS (SELECT 'intercept' AS term, m AS coef, sqrt(sigma / n) AS se, r2, dof FROM g, v WHERE f = 'A' UNION ALL SELECT 'l_returnflag[' || g.f || ']', g.m - b.m, sqrt(sigma * (1 / g.n + 1 / b.n)), r2, dof FROM g, g b, v WHERE b.f = 'A' AND g.f <> 'A')
SELECT term, round(coef, 9) AS coef, round(se, 9) AS se, round(coef - 1.96::DOUBLE * se, 9) AS low, round(coef + 1.96::DOUBLE * se, 9) AS high, round(coef / se, 4) AS t, round(r2, 9) AS r2, dof::BIGINT AS dof FROM t"""
)
def effect_sizes(spark, sf_dir):
    """Least squares on the levels of a category: how far each is from the base level."""
    fit = B.least_squares(_table(spark, sf_dir, "lineitem"), "l_discount", B.dummies("l_returnflag", ["N", "R"]))
    return fit.select("term", *[F.round(c, places).alias(c) for c, places in (("coef", 9), ("se", 9), ("low", 9), ("high", 9), ("t", 4), ("r2", 9))], "dof")


_GRID = "(SELECT p_type AS method, p_size AS size, CAST(right(p_brand, 1) AS INT) AS overlap, avg(p_retailprice) / 2500 AS recall_5, avg(p_retailprice) / 5000 AS recall_1, avg(p_partkey) AS avg_size FROM part GROUP BY ALL)"
_RERANKED = "(SELECT size, size = 1 AS small, recall_1 * (50 - size) / 100.0::DOUBLE AS delta FROM (SELECT p_size AS size, avg(p_retailprice) / 5000 AS recall_1 FROM part GROUP BY 1))"


@query(
    f"""
WITH g AS (SELECT * FROM {_GRID}), e AS (SELECT (SELECT avg(recall_5) FROM g WHERE size = (SELECT max(size) FROM g)) - (SELECT avg(recall_5) FROM g WHERE size = (SELECT min(size) FROM g)) AS effect),
s AS (SELECT avg(s) AS spread FROM (SELECT max(recall_5) - min(recall_5) AS s FROM g GROUP BY size, overlap HAVING count(*) >= 2)), r AS (SELECT max(delta) FILTER (WHERE small) AS d_small, avg(delta) FILTER (WHERE NOT small) AS d_mean, max(delta) FILTER (WHERE NOT small) AS d_max FROM {_RERANKED}),
o AS (SELECT corr(avg_size, recall_5) AS r, max(recall_5) AS best, 2 * sqrt(avg(recall_1) * (1 - avg(recall_1)) / 200) AS se FROM g), a AS (SELECT * FROM e, s, r, o)
SELECT 'recall tracks chunk size' AS claim, round(r, 4) AS value, CASE WHEN r >= 0.5 THEN 'yes' ELSE 'no' END AS replicates FROM a
UNION ALL SELECT 'size effect above method spread', round(effect - spread, 4), CASE WHEN effect > spread THEN 'yes' ELSE 'no' END FROM a
UNION ALL SELECT 'dense retrieval stays strong', round(best, 4), CASE WHEN best >= 0.8 THEN 'yes' ELSE 'no' END FROM a
UNION ALL SELECT 'reranking helps small chunks', round(d_small, 4), CASE WHEN d_small >= se AND d_small > d_mean THEN 'yes' ELSE 'no' END FROM a
UNION ALL SELECT 'reranking leaves large chunks', round(d_max, 4), CASE WHEN d_max < se THEN 'yes' ELSE 'no' END FROM a"""
)
def replicated_claims(spark, sf_dir):
    """Five claims about a sweep, each with its value and rule."""
    parts = _table(spark, sf_dir, "part")
    price = F.avg("p_retailprice")
    grid = parts.groupBy(F.col("p_type").alias("method"), F.col("p_size").alias("size"), F.expr("CAST(right(p_brand, 1) AS INT)").alias("overlap")).agg((price / 2500).alias("recall_5"), (price / 5000).alias("recall_1"), F.avg("p_partkey").alias("avg_size"))
    deltas = parts.groupBy(F.col("p_size").alias("size")).agg((price / 5000).alias("recall_1")).select("size", (F.col("size") == 1).alias("small"), (F.col("recall_1") * (50 - F.col("size")) / 100.0).alias("delta"))
    return B.direction_checks(grid, deltas, 200)


@query(f"WITH g AS (SELECT * FROM {_GRID}) SELECT 200 AS n, round(avg(recall_5), 6) AS p_bar, round(1.96::DOUBLE * sqrt(2 * avg(recall_5) * (1 - avg(recall_5)) / 200), 6) AS floor_95, round((1.96::DOUBLE + 0.8416::DOUBLE) * sqrt(2 * avg(recall_5) * (1 - avg(recall_5)) / 200), 6) AS mde_80, round((SELECT max(s) FROM (SELECT max(recall_5) - min(recall_5) AS s FROM g GROUP BY size, overlap HAVING count(*) >= 2)), 6) AS max_spread FROM g")
def detectable_spread(spark, sf_dir):
    price = F.avg("p_retailprice")
    grid = _table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("method"), F.col("p_size").alias("size"), F.expr("CAST(right(p_brand, 1) AS INT)").alias("overlap")).agg((price / 2500).alias("recall_5"))
    out = B.largest_spread(grid, ["size", "overlap"], "recall_5", F.lit(200))
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("p_bar", "floor_95", "mde_80", "max_spread")])


@query(
    """
WITH s AS (SELECT source, count(*) AS n_docs, count(l.doc_id) AS n_scored, md5(string_agg(d.doc_id::VARCHAR, ',' ORDER BY d.doc_id)) AS h FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source), f AS (SELECT max(n_docs) AS n_docs, min_by(h, source) AS h FROM s)
SELECT source, array_to_string(list_filter([CASE WHEN s.n_docs <> f.n_docs THEN 'document count differs' END, CASE WHEN s.n_scored <> 40 THEN 'scored question count differs' END, CASE WHEN s.h <> f.h THEN 'hash differs' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM s, f"""
)
def bench_precheck(spark, sf_dir):
    """Why each source isn't the bench that was planned for: the largest count, 40 scored, the first source's ids."""
    both = _table(spark, sf_dir, "documents").select("doc_id", "source").join(_table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("scored")), "doc_id", "left")
    ids = F.array_join(F.array_sort(F.collect_list("doc_id")).cast("array<string>"), ",")
    benches = both.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count("scored").alias("n_scored"), F.md5(ids.cast("binary")).alias("hash"))
    planned = benches.agg(F.max("n_docs"), F.min_by("hash", "source")).first()
    why = V.precheck({"n": F.col("n_docs"), "s": F.col("n_scored"), "h": F.col("hash")}, {"n": F.lit(planned[0]), "s": F.lit(40), "h": F.lit(planned[1])}, {"n": "document count differs", "s": "scored question count differs", "h": "hash differs"})
    return benches.select("source", F.array_join(why, "; ").alias("reasons"))


# Chunking and ranking.
@query(
    f"""
WITH RECURSIVE d AS (SELECT doc_id, len(s) AS n, {_PROBS} AS p FROM (SELECT doc_id, {_LONG} AS s FROM documents)),
w AS (
  SELECT doc_id, n, p, 0 AS start, CAST([] AS VARCHAR[]) AS c FROM d
  UNION ALL
  SELECT doc_id, n, p, CASE WHEN n - start <= 10 THEN n ELSE start + k - 1 END, CASE WHEN n - start <= 10 THEN c ELSE list_append(c, (start + 1) || ':' || least(start + 9, n - 2) || ':' || (start + k - 1)) END
  FROM (SELECT *, CASE WHEN n - start > 10 THEN -(list_max(list_transform(range(2, 11), lambda k: {{'p': p[start + k]::DOUBLE, 'd': -abs(k - 6), 'k': -k}})).k) ELSE 0 END AS k FROM w WHERE start < n))
SELECT doc_id, array_to_string(c, ',') AS choices FROM w WHERE start >= n"""
)
def rollout_choices(spark, sf_dir):
    """Of each cut of a greedy rollout the places that it could have been at, and its own."""
    docs = _split(spark, sf_dir)
    spans = docs.select("doc_id", "n", C.target_spans(F.col("probs"), F.col("n"), 6, 2, 10, 1).alias("x"))
    told = F.transform(C.choices(F.col("x"), F.col("n"), 2, 10), lambda c: F.concat_ws(":", c["lo"].cast("string"), c["hi"].cast("string"), c["chosen"].cast("string")))
    return spans.select("doc_id", F.array_join(told, ",").alias("choices"))


@query(
    """
WITH b AS (SELECT user_id AS qid, event_id AS pos, round(value / 10) AS score, 0 AS new, false AS hit FROM events WHERE event_type = 'view'), n AS (SELECT user_id, event_id, round(value / 10), 1, value > 60 FROM events WHERE event_type = 'click'),
r AS (SELECT qid, hit, row_number() OVER (PARTITION BY qid ORDER BY score DESC, new, pos) AS rank FROM (SELECT * FROM b UNION ALL SELECT * FROM n) QUALIFY rank <= 10)
SELECT qid, coalesce(min(rank) FILTER (WHERE hit), 0) AS first_rank FROM r GROUP BY qid"""
)
def merged_first_hits(spark, sf_dir):
    """Views are a user's frozen top list, clicks the new chunks that it takes in."""
    events = _table(spark, sf_dir, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("pos"), F.round(F.col("value") / 10).alias("score"), "event_type", (F.col("value") > 60).alias("hit"))
    return R.merged_first_hit(events.where("event_type = 'view'"), events.where("event_type = 'click'"), 10)


@query(f"WITH {_POOL} SELECT count(*) AS questions, count(*) FILTER (WHERE p > 0 AND n >= 45) AS kept, count(*) FILTER (WHERE p = 0) AS dropped_no_positive, count(*) FILTER (WHERE p > 0 AND n < 45) AS dropped_too_few_negatives FROM (SELECT qid, count(*) FILTER (WHERE hit) AS p, count(*) FILTER (WHERE NOT hit) AS n FROM pool GROUP BY qid)")
def mining_stats(spark, sf_dir):
    return R.mining_stats(Q._pool(spark, sf_dir), 45)


@query(
    f"""
WITH {_POOL}, r AS (SELECT chunk_id, rank AS dense_rank, row_number() OVER (ORDER BY pair_score DESC, rank) AS rank FROM pool WHERE qid = (SELECT min(item_id) FROM benchmark) AND rank <= 20)
SELECT rank, chunk_id, dense_rank FROM r WHERE rank <= 5"""
)
def single_question(spark, sf_dir):
    """The serving path: one question against all documents, reranked, five shown with where they came from."""
    chunks, questions = Q._searched(spark, sf_dir)
    text = questions.orderBy("qid").first().text
    asked = spark.range(1).select(T.checked_query(F.lit(text))).first()[0]
    return R.one_query(chunks, asked, pair_score=R.term_overlap)


@query("SELECT item_id, 'Represent this sentence for searching relevant passages: ' || text AS query_input, text AS passage_input, text AS other_input FROM benchmark")
def encoder_inputs(spark, sf_dir):
    text = F.col("text")
    return _table(spark, sf_dir, "benchmark").select("item_id", T.encoder_input(text, "x/bge-small", True).alias("query_input"), T.encoder_input(text, "x/bge-small", False).alias("passage_input"), T.encoder_input(text, "x/mini", True).alias("other_input"))


@query(
    """
SELECT p_type || ' ' || p_size || '/' || right(p_brand, 1) AS label, 'fixed|' || p_size || '|' || right(p_brand, 1) AS identity, trim(regexp_replace(lower(any_value(p_type)), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
  printf('%.4f', round(avg(p_retailprice), 4)) AS recall, CASE WHEN count(*) > 1 THEN printf('%.3f', round(stddev_samp(p_partkey), 3)) ELSE '' END AS size FROM part GROUP BY p_type, p_size, right(p_brand, 1)"""
)
def formatted_results(spark, sf_dir):
    """Result rows as files have them: identities whether cells are numbers or text, labels, slugs, fixed decimals, empty cells."""
    parts = _table(spark, sf_dir, "part").withColumns({"method": F.lit(" fixed "), "fixed_size": F.concat(F.col("p_size").cast("string"), F.lit(".0")), "fixed_overlap": F.expr("right(p_brand, 1)")})
    rows = parts.groupBy("p_type", "method", "fixed_size", "fixed_overlap").agg(B.rounded(F.avg("p_retailprice"), 4).alias("recall"), F.round(F.stddev_samp("p_partkey"), 3).alias("size"))
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("semantic_policy", "semantic_target_size", "semantic_min_size", "semantic_max_size", "semantic_overlap")})
    numbers = rows.withColumns({c: F.col(c).cast("double") for c in ("fixed_size", "fixed_overlap", "semantic_target_size", "semantic_overlap")}).withColumn("method", F.col("p_type"))
    labelled = rows.select("p_type", "fixed_size", "fixed_overlap", S.config_identity().alias("identity"), T.fixed_number(F.col("recall"), 4).alias("recall"), T.fixed_number(F.col("size"), 3).alias("size"))
    names = numbers.select("p_type", F.concat(F.col("fixed_size").cast("int").cast("string"), F.lit(".0")).alias("fixed_size"), F.col("fixed_overlap").cast("int").cast("string").alias("fixed_overlap"), S.config_label().alias("label"), T.model_slug(F.col("p_type")).alias("slug"))
    return labelled.join(names, ["p_type", "fixed_size", "fixed_overlap"]).select("label", "identity", "slug", "recall", "size")



# Policies.
@query(
    """
WITH g AS (SELECT l_orderkey AS qid, list(l_discount * 10 ORDER BY l_linenumber, l_partkey, l_suppkey) AS s FROM lineitem GROUP BY ALL), j AS (SELECT qid, s, unnest(range(1, 5)) AS j FROM g),
o AS (SELECT qid, s, list_sort(list_transform(range(0, len(s)), lambda i: {'k': -round(s[i + 1] - ln(-ln((CAST(('0x' || substr(md5(qid || ':' || j || ':' || i), 1, 8))::BIGINT AS DOUBLE) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)), 9), 'i': i})) AS o FROM j),
p AS (SELECT qid, list_transform(o, lambda x: s[x.i + 1]) AS z, list_position(list_transform(o, lambda x: x.i), 0) AS rank FROM o),
l AS (SELECT qid, 1.0::DOUBLE / rank AS reward, list_sum(list_transform(range(1, rank + 1), lambda m: z[m] - ln(list_sum(list_transform(z[m:], lambda x: exp(x)))))) AS log_prob FROM p),
a AS (SELECT *, reward - (sum(reward) OVER (PARTITION BY qid) - reward) / 3 AS adv FROM l)
SELECT qid, round(avg(reward), 6) AS reward, max(reward) > min(reward) AS live, round(avg(abs(adv)), 6) AS advantage, round(avg(-adv * log_prob), 6) + 0.0::DOUBLE AS loss FROM a GROUP BY qid"""
)
def policy_gradients(spark, sf_dir):
    """An order's lines are a training group: four rankings drawn for each, their rewards and the loss."""
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", (F.col("l_discount") * 10).alias("s"))))
    groups = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("qid")).agg(F.transform(ordered, lambda x: x["s"]).alias("s"))
    out = M.policy_gradient(groups, 4)
    return out.select("qid", F.round("reward", 6).alias("reward"), "live", F.round("advantage", 6).alias("advantage"), (F.round("loss", 6) + 0.0).alias("loss"))


@query(
    f"""
WITH RECURSIVE d AS (SELECT doc_id, len(s) AS n, {_PROBS} AS p FROM (SELECT doc_id, {_LONG} AS s FROM documents)),
w AS (
  SELECT doc_id, n, p, 0 AS start, 0.0::DOUBLE AS lp, 0.0::DOUBLE AS h, 0 AS c FROM d
  UNION ALL
  SELECT doc_id, n, p, CASE WHEN n - start <= 10 THEN n ELSE start + k - 1 END, lp + CASE WHEN n - start <= 10 THEN 0 ELSE x[k - 1] - ln(list_sum(list_transform(x, lambda y: exp(y)))) END,
    h + CASE WHEN n - start <= 10 THEN 0 ELSE ln(list_sum(list_transform(x, lambda y: exp(y)))) - list_sum(list_transform(x, lambda y: y * exp(y))) / list_sum(list_transform(x, lambda y: exp(y))) END, c + CASE WHEN n - start <= 10 THEN 0 ELSE 1 END
  FROM (SELECT *, list_transform(p[start + 2:start + 10], lambda y: y::DOUBLE) AS x, CASE WHEN n - start > 10 THEN -(list_max(list_transform(range(2, 11), lambda k: {{'p': p[start + k]::DOUBLE, 'd': -abs(k - 6), 'k': -k}})).k) ELSE 0 END AS k FROM w WHERE start < n))
SELECT doc_id, round(lp, 6) + 0.0::DOUBLE AS log_prob, round(CASE WHEN c > 0 THEN h / c ELSE 0 END, 6) + 0.0::DOUBLE AS entropy FROM w WHERE start >= n"""
)
def choice_log_probs(spark, sf_dir):
    """The log-probability and entropy of a greedy rollout's choices, with its scores as logits."""
    docs = _split(spark, sf_dir)
    cut = docs.select("doc_id", "n", F.transform("probs", lambda x: x.cast("double")).alias("probs"), C.target_spans(F.col("probs"), F.col("n"), 6, 2, 10, 1).alias("x"))
    told = cut.select("doc_id", M.choice_log_prob(F.col("probs"), C.choices(F.col("x"), F.col("n"), 2, 10)).alias("c"))
    return told.select("doc_id", (F.round("c.log_prob", 6) + 0.0).alias("log_prob"), (F.round("c.entropy", 6) + 0.0).alias("entropy"))
