"""Corpus pipeline over `documents`: each stage works on all rows that the one before it kept.

1. quality_rules: rejected documents go.
2. simhash_dedup: of texts that are near copies (five-word shingles, Jaccard similarity of 4 / 5 or more) one document stays.
3. secret_scans: secrets are masked in the text.
4. mixing: documents are taken to the target weights, whole epochs and seeded prefixes; repeats become repeated rows.
5. sentencepiece: texts become token ids.

Stages 1 to 4 return the columns of their input. ORACLE_SQL is None: XXH64 fingerprints, components and the tokenizer
cannot be said in SQL; tests compare the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, quality, secrets, sentencepiece_fst, simhash
from tessera.llm.common import discard, materialised, scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_stage(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.simhash_stage(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.secrets_stage(docs)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixing_stage(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.encode_table(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("secret_scans", secret_scans),
    ("mixing", mixing_weights),
    ("sentencepiece", sentencepiece),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as made:  # a stage's own tables go when its rows are written, and then those of the stage before
            done = made.keep(materialised(stage(spark, docs, sf_dir), name))
        discard(spark, docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
