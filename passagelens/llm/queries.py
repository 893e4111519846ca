"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .byte_bpe import encode
from .common import held_out, spread, table, train_row
from .decontaminate import decontaminate
from .language_id import classified, learn_languages
from .license_scan import LEAST_SHARE, PHRASES, postings, scan_licenses
from .line_dedup import dedup_lines
from .minhash_forest import near_duplicates
from .ogg_media import ogg_columns
from .pareto_mix import pareto_mix
from .quality_pu import learn_quality, scored
from .spelling_variants import spelling_variants
from .subvector_clusters import cluster
from .surrogates import replace_personal_data
from .token_counts import token_counts


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spread(table(spark, sf_dir, "documents")), "byte_bpe_50k.json")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    model = learn_languages(docs.where(train_row(F.col("doc_id"))))
    return classified(docs.drop("lang"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("text")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg_columns(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), key="surrogates-1")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    may_learn = train_row(F.col("doc_id"))
    scorer = learn_quality(docs.where(may_learn), table(spark, sf_dir, "labels").where(may_learn).select("doc_id", "quality"))
    return scored(docs, scorer).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), k=3, percent=85)


def op10_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix(table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))[0]


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), with_decoded=True)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_line_dedup, op3_language_id, op4_benchmark_decontamination, op5_license_scan, op6_media_columns, op7_pii_surrogates, op8_quality_classifier,
        op9_minhash_near_dedup, op10_mixing_sources, op11_centroid_clustering, op12_byte_bpe, op13_spelling_variants,
    )
}
ORACLE_SQL = {
    "op2_line_dedup": sql.OP2, "op9_minhash_near_dedup": sql.OP9, "op4_benchmark_decontamination": sql.OP4, "op5_license_scan": sql.op5(PHRASES, postings(), LEAST_SHARE),
    "op10_mixing_sources": sql.OP10, "op11_centroid_clustering": sql.op11(), "op13_spelling_variants": sql.OP13,
}
