"""Registered queries of the trainers and of stored indexes, with the DuckDB SQL of their results where SQL can say them."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import providers as P
from ..functions import text as T
from ..operators import rankers as K
from ..operators.chunk_policy import freeze, train_chunker
from ..operators.inverted import add_to_index, index_top_k
from ..operators.retrieval import containing_documents
from ..operators.sequence_model import SequenceModel, fit_sequences, sequence_probs
from ..operators.windows import hash_split
from ..sources.scratch import settled, shared_folder
from .queries import _bm25_sql, _searched, _table, query


@query(f"WITH {_bm25_sql(20, 1.5, 0.75)} SELECT qid, rank, chunk_id, score FROM bm")
def stored_index_search(spark, sf_dir):
    """An index of all documents, stored in two additions, then searched."""
    chunks, questions = _searched(spark, sf_dir)
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    late = F.pmod(F.xxhash64("chunk_id"), F.lit(4)) == 0
    add_to_index(chunks.where(~late), path)
    add_to_index(chunks.where(late), path)
    return index_top_k(spark, path, questions, 20)


@query()
def sequence_boundary_model(spark, sf_dir):
    """Vectors of ten are a document; a boundary lies where the label changes. Fitted on four fifths of the documents with a tenth held for stopping, applied to all."""
    rows = _table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("doc_id"), F.col("vec_id").alias("pos"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), "label")
    docs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "vec", "label"))).alias("x"))
    changes = F.transform(F.sequence(F.lit(1), F.size("x") - 1), lambda i: (F.get("x.label", i) != F.get("x.label", i - 1)).cast("int"))
    docs = settled(docs.select("doc_id", F.col("x.vec").alias("vecs"), F.when(F.size("x") > 1, changes).otherwise(F.array().cast("array<int>")).alias("labels"), hash_split(F.col("doc_id")).alias("split")))
    model, state = fit_sequences(docs.where("split <> 'test'").withColumn("held", F.col("split") == "val"), 64, 8, epochs=12, rate=0.02)
    scored = sequence_probs(docs, model, state.best)
    return scored.select("doc_id", F.posexplode(F.arrays_zip("labels", "probs")).alias("pos", "x")).select("doc_id", "pos", F.col("x.labels").alias("label"), F.round("x.probs", 6).alias("p"))


# Orders of four lines or more are training groups: their first four lines, the one of largest discounted quantity first, and four features a line.
_STEPS, _RATE, _WARM = 6, 0.2, 2
_GROUPS = """
l AS (SELECT l_orderkey AS qid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nth, round(l_quantity * (1 - l_discount), 6) AS worth, l_quantity / 50.0::DOUBLE AS a, l_extendedprice / 100000.0::DOUBLE AS b, l_discount * 10.0::DOUBLE AS c, l_tax * 10.0::DOUBLE AS d FROM lineitem),
f AS MATERIALIZED (SELECT qid, a, b, c, d, row_number() OVER (PARTITION BY qid ORDER BY worth DESC, nth) AS place FROM l WHERE nth <= 4 QUALIFY count(*) OVER (PARTITION BY qid) = 4)"""


def _listwise_sql(steps: int, rate: float, warm: int) -> str:
    """Steps of Adam on all groups: a row of weights and moments a step."""
    names = "abcd"
    parts = ["s0 AS (SELECT " + ", ".join(f"0.0::DOUBLE AS w{n}, 0.0::DOUBLE AS m{n}, 0.0::DOUBLE AS v{n}" for n in names) + ")"]
    for t in range(steps):
        lr = rate * t / warm if t < warm else rate * (steps - t) / (steps - warm)
        parts.append(f"e{t} AS MATERIALIZED (SELECT qid, place, a, b, c, d, wa * a + wb * b + wc * c + wd * d AS z FROM f, s{t})")
        parts.append(f"p{t} AS MATERIALIZED (SELECT *, exp(z - max(z) OVER (PARTITION BY qid)) / sum(exp(z)) OVER (PARTITION BY qid) * exp(max(z) OVER (PARTITION BY qid)) - CASE WHEN place = 1 THEN 1 ELSE 0 END AS g, ln(sum(exp(z)) OVER (PARTITION BY qid)) - z AS loss, max(CASE WHEN place = 1 THEN z END) OVER (PARTITION BY qid) AS first FROM e{t})")
        parts.append(f"r{t} AS (SELECT {t} AS step, round(sum(CASE WHEN place = 1 THEN loss END) / count(DISTINCT qid), 6) AS loss, (SELECT round(avg(1.0::DOUBLE / k), 6) FROM (SELECT 1 + count(*) FILTER (WHERE z > first) AS k FROM p{t} GROUP BY qid)) AS greedy_rr FROM p{t})")
        parts.append(f"g{t} AS MATERIALIZED (SELECT " + ", ".join(f"sum(g * {n}) / count(DISTINCT qid) AS g{n}" for n in names) + f" FROM p{t})")
        parts.append(f"c{t} AS MATERIALIZED (SELECT s{t}.*, " + ", ".join(f"g{n} / greatest(1.0::DOUBLE, sqrt({' + '.join(f'g{o} * g{o}' for o in names)})) AS h{n}" for n in names) + f" FROM s{t}, g{t})")
        moved = [f"w{n} - {lr!r}::DOUBLE * ((0.9 * m{n} + 0.1 * h{n}) / (1 - 0.9 ** {t + 1})) / (sqrt((0.999 * v{n} + 0.001 * h{n} * h{n}) / (1 - 0.999 ** {t + 1})) + 1e-8) AS w{n}, 0.9::DOUBLE * m{n} + 0.1::DOUBLE * h{n} AS m{n}, 0.999::DOUBLE * v{n} + 0.001::DOUBLE * h{n} * h{n} AS v{n}" for n in names]
        parts.append(f"s{t + 1} AS MATERIALIZED (SELECT {', '.join(moved)} FROM c{t})".replace("0.9 *", "0.9::DOUBLE *").replace("0.1 *", "0.1::DOUBLE *").replace("0.999 *", "0.999::DOUBLE *").replace("0.001 *", "0.001::DOUBLE *").replace("0.9 **", "0.9::DOUBLE **").replace("0.999 **", "0.999::DOUBLE **"))
    return f"WITH {_GROUPS.strip()}, {', '.join(parts)} " + " UNION ALL ".join(f"SELECT * FROM r{t}" for t in range(steps))


def _order_groups(spark, sf_dir):
    nth = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    number = lambda c, by: (F.col(c).cast("double") / by) if by >= 1 else F.col(c).cast("double") * 10
    features = F.array(number("l_quantity", 50.0), number("l_extendedprice", 100000.0), number("l_discount", 0), number("l_tax", 0))
    worth = F.round(F.col("l_quantity") * (1 - F.col("l_discount")), 6)
    lines = _table(spark, sf_dir, "lineitem").withColumn("nth", F.row_number().over(nth)).where("nth <= 4")
    sorted_ = F.array_sort(F.collect_list(F.struct((-worth).alias("less"), "nth", features.alias("x"))))
    return lines.groupBy(F.col("l_orderkey").alias("qid")).agg(sorted_.alias("g")).where(F.size("g") == 4).select("qid", F.col("g.x").alias("x"), F.lit(False).alias("held"))


@query(_listwise_sql(_STEPS, _RATE, _WARM))
def listwise_ranker_training(spark, sf_dir):
    """Full-batch steps of listwise cross-entropy with warm-up: each step's loss and mean reciprocal rank."""
    state = K.train_ranker(_order_groups(spark, sf_dir), K.Scorer(4), steps=_STEPS, rate=_RATE, warmup=_WARM)
    rows = [(int(r["step"]), round(r["loss"], 6), round(r["greedy_rr"], 6)) for r in state.log]  # a row a step
    return spark.createDataFrame(rows, "step int, loss double, greedy_rr double")


@query()
def policy_ranker_training(spark, sf_dir):
    """A scorer trained on rewards of sampled rankings, then applied: each group's greedy rank."""
    groups = _order_groups(spark, sf_dir).withColumn("held", F.pmod(F.xxhash64("qid"), F.lit(10)) == 0)
    state = K.train_ranker(groups, K.Scorer(4), steps=6, rate=0.2, method="policy", samples=4, least_live=0.05)
    return K.scored_groups(groups, K.Scorer(4), state.weights).select("qid", "rank")


@query()
def chunker_policy_training(spark, sf_dir):
    """A policy over cuts, rewarded by where the answers of the items' pages rank: two steps, and their figures."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", T.long_sentences(F.col("text")).alias("sentences"))
    docs = settled(docs.withColumn("digits", F.transform("sentences", P.hashed_digits)).withColumn("vecs", F.transform("digits", lambda d: P.vector_of_digits(d))))
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), T.normalize_text(F.col("text")).alias("answer"))
    pages = docs.select("doc_id", T.normalize_text(F.array_join("sentences", " ")).alias("page"))
    gold = containing_documents(pages, items).groupBy("qid").agg(F.min("doc_id").alias("doc_id"))
    words = F.split("answer", " ")
    asked = settled(gold.join(items, "qid").select("qid", "doc_id", F.array_join(F.slice(words, 9, 6), " ").alias("answer"), P.hashed_vector(F.array_join(F.slice(words, 1, 8), " "), 16).alias("vec")))
    cut = F.transform(F.sequence(F.lit(0), F.size("sentences") - 1, F.lit(6)), lambda p: F.array_join(F.slice("digits", p + 1, 6), ""))
    chunks = docs.where(F.size("sentences") > 0).select("doc_id", F.posexplode(cut).alias("pos", "digits"))
    chunks = settled(chunks.select((F.col("doc_id") * 100_000 + F.col("pos")).alias("chunk_id"), "doc_id", P.vector_of_digits(F.col("digits")).alias("vec")))
    model = SequenceModel(16, 6)
    state = train_chunker(docs, freeze(chunks, asked), lambda c: P.hashed_vector(c, 16), model, model.start(1), steps=2, rate=0.01)
    rows = [(int(r["step"]), round(r["reward_greedy"], 6), round(r["reward_sample"], 6), round(r["entropy"], 6)) for r in state.log]  # a row a step
    return spark.createDataFrame(rows, "step int, reward_greedy double, reward_sample double, entropy double")
