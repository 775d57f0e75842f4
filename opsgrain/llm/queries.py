"""One query for each operator, over its whole table, with production parameters; SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsgrain.llm import divergence, katz, matroska, mixing, packing, runs, secrets, simhash, token_store, topk, toxicity, url_filter, vectors
from opsgrain.llm.common import table_path, written
from opsgrain.llm.tokens import public


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), 3, 3)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public("word_bpe_49k.json"), 4096, 1)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "token_store")
    token_store.write_store(table(spark, sf_dir, "documents"), path, public("byte_bpe_50k.json"), 2)
    return token_store.read_digests(spark, path)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.learn_and_score(table(spark, sf_dir, "documents"), lowest=1)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.HOST_RULES + url_filter.PATTERN_RULES)


def op9_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


def op10_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(matroska.store(table(spark, sf_dir, "documents")), "media")
    return matroska.features(stored)


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10, 1024)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.detect(runs.planted(table(spark, sf_dir, "documents"))))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), 3, 200)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_toxicity": op2_toxicity,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_token_store": op4_token_store,
    "op5_secret_scan": op5_secret_scan,
    "op6_mixing": op6_mixing,
    "op7_katz_backoff": op7_katz_backoff,
    "op8_url_filter": op8_url_filter,
    "op9_embedding_duplicates": op9_embedding_duplicates,
    "op10_matroska": op10_matroska,
    "op11_exact_top_k": op11_exact_top_k,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_source_divergence": op13_source_divergence,
}
SQL = {"op8_url_filter": url_filter.SQL, "op11_exact_top_k": topk.SQL, "op13_source_divergence": divergence.SQL}
