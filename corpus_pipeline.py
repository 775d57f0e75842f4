"""A corpus from raw documents: toxic ones go, one of each group of near-duplicates stays, secrets are masked,
the rest is mixed and packed. Each stage's result is written and read again as the next one's documents.

With nulls: a null text counts as empty in every stage, and a document with a null ``doc_id`` is judged by its
text. An empty table passes through all stages. Columns beyond those of ``documents`` pass through, too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opsgrain.llm import mixing, packing, secrets, shingles, toxicity
from opsgrain.llm.common import written
from opsgrain.llm.tokens import public


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents with a toxicity score of at least 0.5; sentences' model from the table of labels."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest ``doc_id`` of each group of texts with a Jaccard similarity of five-word shingles from 0.8 on.

    Candidates are texts whose SimHash fingerprints link within 3 bits, as op 1 finds them, and, for copies that are further
    apart, texts that share a band of minima; all links are verified on the whole sets.
    """
    return shingles.drop_duplicates(docs, 5, 0.8, distance=3)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets in each text; all documents stay."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the documents in the order of the mixed stream; all documents stay, in files that follow each other."""
    return mixing.in_order(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' token ids into sequences of 4096, which follow the order of the mixed stream."""
    return packing.pack_in_order(docs, public("word_bpe_49k.json"), 4096, 1)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL has no tokenizer and trains no model; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
