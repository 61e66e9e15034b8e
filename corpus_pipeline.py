"""The corpus pipeline: each stage works on all that the one before it kept, and returns the columns of documents.

language ID         documents without letters, or without a language that explains their text, go
exact dedup         one document of each group of equal texts stays
SimHash near-dedup  one document of each linked group stays
decontamination     documents that hold a benchmark item go
byte-level BPE      the tokens of what is left: doc_id, n_tokens, ids_sha256, decoded_sha256

Defined cases: a null or empty text has no letters and goes in the first stage; null ids are handled as each operator states; of repeated rows one stays;
ties are decided as the operators say; very long texts are worked on whole; extra columns are kept, whatever their names, up to the last
stage; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelmill.llm import decontaminate, exact, langid, simhash
from panelmill.llm.common import staged
from panelmill.llm.queries import token_digests
from panelmill.sources.tables import table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs)
    return langid.known_language(docs, model, levels=langid.levels(docs, model))


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.unique(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_digests(docs)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", dedup_exact),
    ("SimHash near-dedup", dedup_near),
    ("benchmark decontamination", decontaminate_benchmark),
    ("byte-level BPE", encode_tokens),
]

#: Fitted filters, latent vectors and tokens have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written once, so the next may read it more than once."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
