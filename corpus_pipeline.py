"""A corpus pipeline of the text operators: toxicity, language, near duplicates, repeated passages, packing.

Each stage is a function of (spark, docs, sf_dir) and works on all rows that the stage before has kept; all but the
last return the columns of ``documents``. ``run`` writes each stage as Parquet into the shared checkpoint folder and
reads it again, so a lost executor repeats at most one stage.

Rows with a null id pass through the stages like others (they are no sources of repeated passages); null and empty
texts have no language and go with the second stage. Columns beyond those of ``documents`` are dropped. An empty
table gives an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from featurewatch.llm import langid, packing, simhash, substring_dedup, toxicity
from featurewatch.session import storage_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A language counts as found from this score on (share of the letters in its spans, less the doubt).
LEAST_SCORE = 0.02
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose toxicity is below the operator's threshold; labels come from ``sf_dir``."""
    model = toxicity.fit_on_others(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, carry=COLUMNS).filter("predicted = 0").select("row.*")


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those in which no language is found with the least score."""
    scored = langid.identify(docs, langid.fit_on_others(docs), carry=COLUMNS)
    return scored.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    return simhash.one_of_each(docs.select(COLUMNS), size=3, seed=42)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words of passages that an earlier document has; ``n_chars`` follows the text."""
    cut = substring_dedup.remove_repeats(docs, carry=["lang", "source"], keep_layout=True)
    return cut.select("doc_id", "text", "row.lang", "row.source", F.length("text").cast("long").alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    return packing.pack(docs, VOCABULARY, keep_ids=False)


STAGES = [("toxicity", drop_toxic), ("language", keep_known_language), ("near_duplicates", drop_near_duplicates),
          ("repeated_passages", cut_repeated_passages), ("packing", pack_sequences)]

#: No SQL: the first two stages fit classifiers. tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), uuid.uuid4().hex
    for name, stage in STAGES[:-1]:
        path = storage_path(spark, "corpus_pipeline", folder, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
