"""The corpus pipeline: language ID, exact dedup, MinHash near-dedup, mixing, packing.

Each stage takes what its predecessor kept, as (spark, docs, sf_dir) -> DataFrame. run() writes each stage's rows as
Parquet in the folder that the cluster shares and reads them again as the next one's documents.

Defined results: documents with null or letterless text, or in which no language has half of the mixture, leave at the
first stage. Of equal texts and of near-duplicates one row stays. The mix repeats a row as often as it takes it (0 to
3 times). Nulls in other columns, ties, repeated rows and empty tables follow the operators' own definitions.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession

from millrace.llm import exact_dedup, language, minhash, mixing, packing
from millrace.llm.common import materialize
from millrace.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told (operator 3)."""
    model = language.fit(docs.filter(~language.held_out()))
    return language.keep_identified(docs, model, least=0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays (operator 10)."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays, at five words and 0.8 (operator 7)."""
    return minhash.drop_near_duplicates(docs, shingle=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources meet their target weights (operator 9)."""
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all that the mix took into sequences of 4096 tokens (operator 6)."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Mixtures by EM, random rounding and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
