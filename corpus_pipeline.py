"""A training-corpus pipeline over `documents`: toxicity, exact dedup, MinHash near-dedup, mixing, SentencePiece.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each stage's result to the shared folder
and reads it back as the next one's `docs`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake.llm._frames import Workspace, read_table, scratch
from cipherlake.llm.exact_dedup import drop_exact_copies
from cipherlake.llm.mixing import mix_sources
from cipherlake.llm.near_dedup import drop_near_copies
from cipherlake.llm.queries import TOKENIZERS
from cipherlake.llm.sentencepieces import encode_documents
from cipherlake.llm.toxicity import drop_toxic

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7; the model learns from a bounded sample of the labelled rows (operator 8)."""
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"), threshold=0.7).select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest, then first, of the documents whose texts are equal without white space (operator 1)."""
    return drop_exact_copies(docs).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group linked by five-word shingles at a similarity of 0.8 or more (operator 5)."""
    return drop_near_copies(docs, width=5, percent=80).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards source shares that follow the square root of source sizes, reshuffled (operator 7)."""
    return mix_sources(docs, temperature=0.5).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, decoded again for proof (operator 2)."""
    return encode_documents(docs, f"{TOKENIZERS}/piece_bpe_32k.model")


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources", mixing),
    ("SentencePiece", sentencepiece),
]

#: A trained model, minwise trees and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each over all that the one before kept."""
    ws = Workspace(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents").select(*[F.col(c) for c in COLUMNS])
    for k, (_, stage) in enumerate(STAGES):
        with scratch():
            docs = ws.save(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            ws.drop(f"stage{k - 1}")
    return docs
