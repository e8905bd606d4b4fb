"""The corpus pipeline: stages over ``documents``, each written and reread as the next one's input.

1. quality rules: documents that the rules reject go;
2. n-gram Jaccard join: five-word shingles, similarity 0.8 or more; the smallest id of each group stays;
3. benchmark decontamination: documents with a benchmark window go;
4. personal data: every span found is replaced by its kind in brackets, n_chars follows;
5. packing: what is left, in sequences along the curve.

No stage's SQL twin exists (suffix arrays, expectation-maximisation, token ids),
so the tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgivm.llm import op1_curve_packing, op2_ngram_jaccard_join, op3_pii, op9_quality_rules, op10_decontamination, scratch

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op9_quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_ngram_jaccard_join.keep_first(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op3_pii.redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return op1_curve_packing.curve_packing(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("PII", personal_data), ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
