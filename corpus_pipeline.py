"""From raw documents to token ids: five operators of ``cartshift.llm`` in a row.

Every stage takes and returns documents (the last one returns the ids' digests). Between two stages the rows
are written as Parquet in the shared folder and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartshift.llm.automaton import digests, encoded
from cartshift.llm.common import stored
from cartshift.llm.lines import drop_frequent_lines
from cartshift.llm.mixing import mixed
from cartshift.llm.quality import passing
from cartshift.llm.simhash import keep_one

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level rules keep."""
    return passing(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten or more of the documents that are left are gone; ``n_chars`` follows the text."""
    kept = drop_frequent_lines(docs)
    changes = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return kept.select(*[changes.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed(docs)


def bpe_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the mix: ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``."""
    return digests(encoded(docs, VOCABULARY), "doc_id")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("source mix", source_mix),
    ("BPE", bpe_ids),
]

# SimHash and BPE have no SQL form; the tests hold run() against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
