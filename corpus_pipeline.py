"""A corpus from raw documents to packed token sequences, stage by stage.

Each stage works on all that its predecessor kept. The first four return the columns of
``documents``; the last returns packed pieces. Decisions:

1. ``toxicity`` drops documents whose score is at least one half.
2. ``near_duplicates`` keeps one document of each class: the one with the smallest id.
3. ``decontamination`` drops documents in which a benchmark window occurs.
4. ``surrogates`` replaces personal data in the texts that are left.
5. ``packing`` cuts and packs them into sequences of at most 1024 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm import decontamination, ngram_join, packing, pii, toxicity
from cardloom.llm.common import written
from cardloom.llm.queries import surrogate_key, vocabulary

#: No SQL expresses the classifier, the tokenizer or the keyed surrogates; tests/llm compares with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.filter_toxic(docs, model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, ngram_join.near_duplicates(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.filter_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    replaced = pii.replace_entities(docs, key=surrogate_key(spark)).withColumn("n_chars", F.length("text").cast("bigint"))
    return replaced.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(docs, vocabulary=vocabulary("byte_bpe_50k.json"), end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("surrogates", replace_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
