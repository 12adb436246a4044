"""Token counts through a cache of digests.

A count is stored under the digest of the content and the digest of the tokenizer's version, so
texts that were counted before, in this table or any earlier one, are never encoded again. Only
one text per distinct missing digest is encoded; the new counts are appended to the cache, and all
rows get theirs by joining digests, which never carry text. Digests that many rows share are joined
apart, through a broadcast of a proven size.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweft.llm.arrow import bounded, relax
from roadweft.llm.tokens import Encoder, slices
from roadweft.llm.columns import named
from roadweft.session import exists, materialize

LIMIT = 512
#: A digest is hot if over one of so many rows has it, so there are fewer hot digests than this.
HOT = 1_000
#: Texts that are missing from a warm cache are found through a broadcast up to this many digests.
FEW = 1_000
#: Bytes of texts that a worker divides at once; beside two workers and a JVM there is no room for more.
SLICE_BYTES = 1_500_000
CACHED = "digest binary, n_tokens bigint"


def version(tokenizer: str) -> str:
    """Digest of the vocabulary file and of the library that reads it."""
    library = importlib.metadata.version("tokenizers")
    return hashlib.sha256(Path(tokenizer).read_bytes() + library.encode()).hexdigest()


class TokenCountCache:
    """Counts by digest, one folder per tokenizer version. Every run appends a folder of its own, so
    runs at the same time don't disturb each other, and nothing is rewritten; a digest that two of
    them counted is there twice."""

    def __init__(self, spark: SparkSession, folder: str, tokenizer: str) -> None:
        self.spark = spark
        self.path = f"{folder.rstrip('/')}/version={version(tokenizer)}"

    def exists(self) -> bool:
        return exists(self.spark, self.path)

    def read(self) -> DataFrame:
        if not self.exists():
            return self.spark.createDataFrame([], CACHED)
        found = self.spark.read.schema(CACHED).parquet(f"{self.path}/batch=*")
        return found.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, counts: DataFrame) -> None:
        counts.write.parquet(f"{self.path}/batch={uuid.uuid4().hex}")


def encode_counts(texts: DataFrame, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) of rows (digest, text), by the library, without special tokens. Of rows of
    one digest that follow each other the first is encoded."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        relax()  # of what earlier stages left
        encoder, last = Encoder.of(tokenizer, "bytes"), None
        for batch in batches:
            digests = batch.column("digest").to_pylist()
            fresh = [d != before for d, before in zip(digests, [last, *digests])]
            last = digests[-1] if digests else last
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            text = batch.column("text")
            for start, stop in slices(text, SLICE_BYTES):
                _, counts = encoder.ids(text.slice(start, stop - start))
                yield pa.RecordBatch.from_pydict({"digest": batch.column("digest").slice(start, stop - start), "n_tokens": pa.array(counts, pa.int64())})
        relax()

    return texts.select("digest", "text").mapInArrow(count, CACHED)


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    cache: str,
    limit: int = LIMIT,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of every row.

    ``tokenizer`` is a byte-level vocabulary file of the `tokenizers` library, ``cache`` a folder
    that all executors share. Content is normalised only by reading null as empty: any other
    change would change counts. Defined cases: null and empty texts have 0 bytes and 0 tokens;
    strings of special tokens inside texts count as the library does by default; repeated rows are
    returned each; a text that a third of the rows share is encoded once; rows with null ids are
    counted; an empty table gives an empty result and appends nothing; other columns are not read.
    """
    spark = docs.sparkSession
    bounded(spark)
    store = TokenCountCache(spark, cache, tokenizer)
    whole = docs.select(named(doc_id).alias("doc_id"), F.coalesce(named(text), F.lit("")).alias("text"))
    whole = whole.withColumn("digest", F.unhex(F.sha2("text", 256)))
    slim = materialize(whole.select("doc_id", "digest", F.octet_length("text").cast("bigint").alias("n_bytes")), "token-digests")
    first = slim.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    hot = materialize(first.filter(F.col("n") > slim.count() / HOT).select(F.col("digest").alias("_hot")), "hot-digests")
    missing = first.join(store.read(), "digest", "left_anti") if store.exists() else first
    missing = materialize(missing.select(F.col("digest").alias("_digest"), "rep"), "missing-digests")
    if n := missing.count():
        # else the hint keeps one plan at every size
        few = F.broadcast(missing) if n <= FEW else missing.hint("merge")
        texts = whole.join(few, (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
        store.append(encode_counts(texts, tokenizer))
    counts = store.read()
    often = F.broadcast(counts.join(F.broadcast(hot), F.col("digest") == F.col("_hot")).select("_hot", "n_tokens"))
    many = slim.join(often, F.col("digest") == F.col("_hot")).drop("_hot")
    rest = slim.join(F.broadcast(hot), F.col("digest") == F.col("_hot"), "left_anti").join(counts.hint("merge"), "digest")
    counted = many.select("doc_id", "n_bytes", "n_tokens").unionByName(rest.select("doc_id", "n_bytes", "n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
