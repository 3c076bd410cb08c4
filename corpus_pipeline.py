"""A corpus pipeline of five stages over the documents table; see STAGES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm.common import documents, written
from sylva.llm.op5_harmonic import default_tokenizer, pack
from sylva.llm.op6_suffix import without_repeats
from sylva.llm.op7_langid import in_a_language
from sylva.llm.op8_pivotal import mix
from sylva.llm.op10_oddsketch import without_near_duplicates


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language go."""
    return in_a_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words to a shingle, similarity 0.8."""
    return without_near_duplicates(docs, words=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes and more that stand earlier are cut out; documents that had text and keep none go."""
    columns = docs.columns
    out = without_repeats(docs).filter("n_bytes = 0 or n_removed < n_bytes")
    return out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])).select(*columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes sources to their target weights: a document stays as often as the mix takes it."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into token sequences: one row per piece."""
    return pack(docs, default_tokenizer())


STAGES = [("language", language), ("near duplicates", near_duplicates), ("repeats", repeats), ("mixing", mixing), ("packing", packing)]
#: Sketches, pivotal rounding and the tokenizer are beyond SQL; the pipeline is tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name.replace(' ', '-')}")
    return docs
