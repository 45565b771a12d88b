"""The corpus pipeline: five stages over the documents, each on all rows that the one before it kept.

Toxic documents go, one row of each near-duplicate group stays (the one with the smallest doc_id, then the
smallest hash of its text), contaminated documents go, personal data is replaced in the texts, and the
last stage gives each remaining document's tokens.

Verdicts are on rows: rows that share a doc_id go together only if their texts do. Of exact repeats of a row
one stays.

Rows with a null doc_id can't be a group's document, and no group is found for them: they are kept by
the near-duplicate stage. A null text is empty. Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretally.llm import bpe, decontam, pii, simhash, toxicity
from foretally.llm.common import table
from foretally.workspace import settle

TOKENIZER = "byte_bpe_50k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity reaches the operator's limit."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints."""
    repeats = simhash.repeated_rows(docs)
    return simhash.repeats_folded(decontam.without_rows(docs, repeats.where("drop")), repeats.where("not drop"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that hold benchmark passages."""
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact(docs, pii.fit(docs))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    return bpe.encoded(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("bpe", encode_tokens),
]

#: SQL can express neither the trained stages nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on the written result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
