"""The corpus pipeline: documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written and read again as the next one's ``docs``.  All but the last return
the columns of ``documents``.

In every stage a null text counts as an empty one, repeated rows are judged
alike, very long texts are read whole, an empty table stays empty, and columns
beyond those of ``documents`` pass through whatever their names, up to
packing, whose rows have its own columns alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lineforge.llm import decontamination, jaccard_join, packing, pii, quality_classifier
from lineforge.llm.common import read, written

VOCABULARY = "word_bpe_49k.json"
#: Near copies in the pipeline: five-word shingles, a similarity of 0.8 or more.
COPY_WORDS, COPY_PERCENT = 5, 80
#: Words that packing remembers: its Python workers serve the other stages too.
PACKED_WORDS = 100_000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: rows that the classifier scores below 0.3 go; one of exactly 0.3 stays, an empty text is scored too."""
    return quality_classifier.keep_good(docs, quality_classifier.train(docs, read(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each group of near copies the document of the least doc_id stays; texts without words link with nothing and stay."""
    return jaccard_join.one_of_each(docs, COPY_WORDS, COPY_PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that hold a benchmark item go whole; a null or empty text holds none."""
    return decontamination.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: personal data is masked in the text; a null text stays null."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: pieces of windows of 4096 tokens, with their ids; a null or empty text is its end id alone."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY), memory=PACKED_WORDS)


STAGES = [("quality_classifier", keep_good), ("jaccard_join", one_of_each), ("decontamination", decontaminate),
          ("pii", mask_pii), ("packing", pack)]
#: SQL has no classifier, hashes of sets or tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
