"""A five-stage training-data pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents.  Every stage reads
whole texts, bears nulls in any column, empty tables and extra columns of any
name, and takes ids of any type that has an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm.bpe import BpeParams, encode_documents
from lodestrata.llm.decontamination import drop_contaminated
from lodestrata.llm.langid import fit_filters, keep_recognised
from lodestrata.llm.minhash import drop_near_duplicates
from lodestrata.llm.pii import redact_documents
from lodestrata.llm.queries import tokenizer_path
from lodestrata.runtime import materialize, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of no recognised language; the others get the predicted one as ``lang``.

    Null, empty and letterless texts are of none.  Rows that repeat are judged
    alike; between languages of equal score the first in order of name is taken.
    """
    return keep_recognised(docs, fit_filters(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (five-word shingles, similarity of 0.8 or more).

    The member of least id stays; of rows that repeat that id, those of one text
    count once.  Texts without words are copies of nothing and stay.
    """
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a ten-word window of a benchmark item (or all of a shorter one).

    Null and empty texts hold none and stay; rows that repeat go or stay together.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by the names of its kinds; every row stays.

    Null texts stay null; where spans overlap, one name stands for them all.
    """
    return redact_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token numbers of each document: doc_id, lang, source, n_tokens, token_ids; a null text has none."""
    return encode_documents(docs, BpeParams(tokenizer_path()), ["doc_id", "lang", "source"])


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("redact_personal_data", redact_personal_data),
    ("tokenize", tokenize),
]

#: Language filters, span classifier and tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
