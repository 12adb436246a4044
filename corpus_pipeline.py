"""Corpus pipeline: from raw documents to packed training sequences.

Stages in order: language ID drops documents without a recognisable language; line dedup drops
boilerplate lines of each source; near-dedup keeps one document of each group; mixing takes each
source to its target; packing fills the sequences. Each stage's result is written and reread. The
columns doc_id, text, lang, source and n_chars are those of documents; others are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweft.llm import language_id, line_dedup, mixing, order_minhash, packing
from roadweft.llm.columns import named, unused
from roadweft.llm.queries import quality_weights, tokenizer
from roadweft.session import materialize, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; a missing label is filled in. Rejected are texts without a letter
    (`und`) and those that fit no codeword better than chance allows (strange); ambiguous ones stay.

    Null and empty texts go; ties, repeated rows and long texts are as in `language_id.identify`; an
    empty table gives an empty result; where nothing is labelled every text is `und` and goes.
    Columns may have any name, and all but lang are unchanged."""
    guess = unused(docs, "guess")
    found = language_id.identify(docs, into=guess)
    known = found.filter((F.col(f"{guess}.lang_pred") != language_id.UNKNOWN) & ~F.col(f"{guess}.strange"))
    return known.select(*[F.coalesce(named(c), F.col(f"{guess}.lang_pred")).alias(c) if c == "lang" else named(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines, n_chars as it is then.

    Null texts stay and have null n_chars, a text of boilerplate alone is empty then; null sources
    are one source; repeated rows are documents of their own; an empty table gives an empty result.
    Columns may have any name, and all but text and n_chars are unchanged."""
    cleaned = line_dedup.drop_boilerplate(docs, counts=False)
    return cleaned.select(*[F.length("text").cast("bigint").alias(c) if c == "n_chars" else named(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of smallest id.

    Texts without words all stay; of repeated rows one stays; null ids, ties, long texts and an empty
    table are as in `order_minhash.remove`. Columns may have any name and are unchanged."""
    return order_minhash.remove(docs)


def sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it.

    Null and blank texts have size 0 and follow their source's whole epochs; null sources stand
    last; repeated rows are taken together; an empty table gives an empty result. Columns may have
    any name and are unchanged."""
    return mixing.mix(docs, quality_weights(table(spark, sf_dir, "labels")))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the sequences.

    Null and empty texts are one closing id; long texts are cut; repeated rows are packed each; an
    empty table gives an empty result. Of the columns only doc_id and text are read."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_duplicates),
    ("source_mixing", sources),
    ("best_fit_packing", sequences),
]

#: Learned and iterative stages can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
