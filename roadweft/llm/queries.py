"""Queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweft.llm import embedding_dedup, fingerprints, language_id, line_dedup, mixing, order_minhash, packing, token_counts, url_rules, warc
from roadweft.session import passing, scratch, table

#: The rules of the URL filter's contract (fixed values).
URL_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def tokenizer(name: str) -> str:
    """Where a public vocabulary file is."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages")))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


#: Session setting that names a folder in which token counts last from run to run.
TOKEN_COUNTS = "spark.roadweft.tokenCounts"


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the cache that the session names. Without one a run has a cache of its own, which a
    first batch fills, one text in sixteen by its digest, as an earlier run would have; then all
    documents are counted, so every run joins stored counts and encodes what they lack."""
    docs, vocabulary = table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")
    if folder := spark.conf.get(TOKEN_COUNTS, None):
        return token_counts.count_tokens(docs, vocabulary, folder)
    folder = scratch(spark, "token-counts")
    early = docs.filter(F.sha2(F.coalesce("text", F.lit("")), 256).startswith("0"))
    token_counts.count_tokens(early, vocabulary, folder)
    return token_counts.count_tokens(docs, vocabulary, passing(spark, folder))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("key", "rid")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identify(docs).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def quality_weights(labels: DataFrame) -> DataFrame:
    """Quality weights of labelled documents: 2 where labelled good, 0.5 where bad."""
    return labels.filter("quality IS NOT NULL").select("doc_id", F.when(F.col("quality") >= 1, 2.0).otherwise(0.5).alias("weight"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.choose(table(spark, sf_dir, "documents"), quality_weights(table(spark, sf_dir, "labels"))).drop("digest")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "source", "n_lines", "n_dropped", "text")


QUERIES = {
    "op1_warc_archives": op1_warc_archives,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_token_counts": op3_token_counts,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_order_minhash": op5_order_minhash,
    "op6_language_id": op6_language_id,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_mix_sources": op8_mix_sources,
    "op9_url_filter": op9_url_filter,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE_SQL = {
    "op10_line_dedup": f"""
        WITH page AS (
            SELECT row_number() OVER () AS row_id, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents
        ), seen AS (
            SELECT source, unnest(list_distinct(list_filter(lines, lambda x: trim(x, ' ') <> ''))) AS line FROM page
        ), total AS (
            SELECT source, count(*) AS n FROM documents GROUP BY source
        ), often AS (
            SELECT source, line, count(*) AS c FROM seen GROUP BY source, line HAVING count(*) >= {line_dedup.MIN_PAGES}
        ), bad AS (
            SELECT o.source, list(o.line) AS lines FROM often o JOIN total t ON o.source IS NOT DISTINCT FROM t.source
            WHERE o.c > t.n * CAST({line_dedup.MAX_RATIO} AS DOUBLE) GROUP BY o.source
        ), kept AS (
            SELECT p.*, list_filter(p.lines, lambda x: trim(x, ' ') = '' OR NOT list_contains(coalesce(b.lines, []), x)) AS k
            FROM page p LEFT JOIN bad b ON p.source IS NOT DISTINCT FROM b.source
        )
        SELECT doc_id, source, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
               CAST(coalesce(len(lines) - len(k), 0) AS BIGINT) AS n_dropped,
               CASE WHEN text IS NOT NULL THEN array_to_string(k, chr(10)) END AS text
        FROM kept
    """,
}
