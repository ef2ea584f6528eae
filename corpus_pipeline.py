"""From raw documents to packed training sequences: five stages, each over all that the one before it kept.

Rows may hold nulls in any column, share ids, be equal throughout, or have empty or very long texts, and columns may be
named as the operators name theirs; all but the last stage return the columns they are given. What each operator makes of
such rows is told in its docstring; the stages below say what that means for a document. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import line_dedup, mixing, ngram_join, packing, quality
from loomline.llm.common import dropped, saved
from loomline.llm.queries import fold, table, tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. A null or empty text is scored by its statistics; without any label every score is one half and all documents are rejected."""
    machine = quality.fit(docs, table(spark, sf_dir, "labels").filter(fold(4) != 2))
    return quality.keep_good(docs, machine)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document or line has, but for two edits, go. Null, empty and blank texts stay; a document whose lines all went goes too."""
    return line_dedup.clean(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: the least id, null last. Texts without words are like nothing, so each stays; of rows that share id and text one stays."""
    return ngram_join.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source (null is one) gives its target of words, repeats included; a document comes out once for each pass that takes words of it."""
    return mixing.mixed_documents(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids; a null or empty text is its end token."""
    return packing.pack(docs, tokenizer_path(), tokenizer_path("byte_bpe_50k.tiktoken"), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("source mixing", source_mixing),
    ("packing", sequence_packing),
]

#: Learned scores, MinHash and tokenizers have no SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again by the next; what a stage wrote goes once the next one has written. The last written table stays, as the result reads it."""
    docs, held = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs)
            if held is not None:
                dropped(held)
            held = docs
    return docs
