"""A corpus pipeline of the training-data operators: identify, deduplicate, mix, tokenize.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadloom.llm.common import Scratch, read
from quadloom.llm.exact_dedup import keep_first
from quadloom.llm.language_id import keep_identified
from quadloom.llm.queries import unigram_model
from quadloom.llm.sentencepiece_codec import encoded
from quadloom.llm.shingle_join import keep_representatives
from quadloom.llm.source_mix import mixed_documents


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letter, no text, or neither a label nor n-grams of a learned language) go."""
    return keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text, up to white space, the one with the smallest doc_id stays."""
    return keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that hang together by a Jaccard similarity of 0.8 or more on five-word shingles, the first stays."""
    return keep_representatives(docs, words=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each epoch of the mix in which a document is taken, with the text that is taken."""
    return mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces of every row of the mix."""
    return encoded(docs, unigram_model())


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("SentencePiece", tokenize),
]
#: The stages learn, hash and draw: tests compare them with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    scratch = Scratch(spark, "corpus_pipeline")
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            scratch.drop(f"stage{i - 1}")
    return docs
