"""Document fingerprints: threshold-scaled sketches (FracMinHash) in native expressions.

A sketch keeps every hash of a five-word shingle that falls below a fixed fraction of the hash
space. What is kept doesn't depend on the document's length, so sketches of a part and of a whole
are comparable, sketches of a union are unions of sketches, and containment can be estimated
between very unequal documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweft.llm.columns import ROW, fields, named, row_of
from roadweft.session import materialize

SHINGLE = 5
FRACTION = 0.25
BLANKS = r"[\x09-\x0D\x20]+"
#: Text that a task of the ordered pass reads, about.
RANGE_BYTES = 64 << 20


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased words of a text, in order."""
    words = F.filter(F.split(F.lower(text), BLANKS), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column, size: int = SHINGLE) -> Column:
    """Hashes of the runs of ``size`` words; all words make one shingle where there are fewer."""
    empty = F.array().cast("array<bigint>")
    runs = F.transform(
        F.sequence(F.lit(0), F.size(hashes) - size),
        lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]),
    )
    return F.when(F.size(hashes) >= size, runs).when(F.size(hashes) > 0, F.array(F.xxhash64(hashes))).otherwise(empty)


def scaled(shingles: Column, fraction: float = FRACTION) -> Column:
    """The sketch: sorted distinct hashes below ``fraction`` of the unsigned 64-bit space.

    Where none is, the smallest hash alone is kept, so that a short text has a fingerprint too;
    a merge drops such a hash if the union has any below the threshold.
    """
    cut = int(-(1 << 63) + (1 << 64) * fraction)
    low = F.array_sort(F.array_distinct(F.filter(shingles, lambda h: h < F.lit(cut))))
    least = F.when(F.size(shingles) > 0, F.array(F.array_min(shingles))).otherwise(shingles)
    return F.when(F.size(low) > 0, low).otherwise(least)


def merge(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of two documents together."""
    return scaled(F.concat(a, b), fraction)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two sketches; two empty ones are alike, 1."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(1.0).cast("double")


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; an empty a is contained, 1."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(1.0).cast("double")


def shown(sketch: Column) -> Column:
    """The sketch as text: 16 hex digits a hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def sketch_of(text: Column, shingle: int = SHINGLE, fraction: float = FRACTION) -> Column:
    return scaled(shingle_hashes(word_hashes(F.coalesce(text, F.lit(""))), shingle), fraction)


def with_sketch(docs: DataFrame, text: str, to: str, shingle: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Adds column ``to``, the sketch of column ``text``; a column of that name is replaced, others
    may have any name and are unchanged. Each step is a projection of its own, so no expression runs
    twice.

    Defined cases: null and empty texts have an empty sketch, short ones one hash; long texts are
    read whole; equal texts have equal sketches; an empty table gives an empty result."""
    step = docs.select(row_of(docs), word_hashes(F.coalesce(named(text), F.lit(""))).alias("hashes"))
    step = step.select(ROW, shingle_hashes(F.col("hashes"), shingle).alias("hashes"))
    return step.select(*fields(docs, to), scaled(F.col("hashes"), fraction).alias(to))


def with_next(docs: DataFrame, key: str, text: str, columns: list[str], per_partition: int = 8, quantiles: int = 256) -> DataFrame:
    """Adds _next_<column>: values of the next row in ascending ``key``, after the last the first.

    Rows are dealt to ranges of the key (quantiles, each cut into even slices) and ordered within
    each; a range's first row also goes to the range before, as its sentinel. The wide rows are
    shuffled once and never sorted as a whole. Null keys come first; rows of one key follow each
    other by a hash of ``text``, and a key that spans several quantiles is cut by that hash, so
    that no key is one range. There are ``per_partition`` ranges a partition, and a partition per
    RANGE_BYTES of text, or as many as the session shuffles to, if those are more. Rows equal in key
    and text share a range.
    """
    spark = docs.sparkSession
    tie = F.shiftrightunsigned(F.xxhash64(named(text)), 1)
    own = docs.select(*[named(c) for c in docs.columns], named(key).cast("bigint").alias("_key"), tie.alias("_tie"))
    keys = materialize(own.select("_key", "_tie", F.octet_length(named(text)).alias("_size")), "range-keys")
    points = F.percentile_approx("_key", [i / quantiles for i in range(quantiles + 1)], 100 * quantiles)
    found = keys.agg(points.alias("cuts"), F.sum("_size").alias("size"), F.avg(F.col("_key").isNull().cast("double")).alias("none")).first()
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(found["size"] or 0) // RANGE_BYTES))
    cuts = found["cuts"] or []
    bounds = sorted(set(cuts))
    slices = max(1, per_partition * partitions // max(1, len(cuts)))
    # ranges of rows that have a bound itself as their key, in slices; the first are of null keys
    spans = [max(1, round((found["none"] or 0) * quantiles)), *[cuts.count(b) for b in bounds]]
    literal = lambda values: F.lit(values).cast("array<bigint>") if len(values) > 1 else F.array(*[F.lit(v) for v in values]).cast("array<bigint>")
    part = F.size(F.filter(F.col("_cuts"), lambda c: c <= F.col("_key")))
    low, high, span = F.get("_cuts", F.col("_part") - 1), F.get("_cuts", F.col("_part")), F.get("_spans", F.col("_part"))
    even = F.least(F.floor((F.col("_key") - low) / (high - low) * slices), F.lit(slices - 1))
    cut = F.floor(F.col("_tie") / float(1 << 63) * span * slices)
    within = F.when(F.col("_key").isNull() | (F.col("_key") == low), F.least(cut, span * slices - 1)).otherwise(span * slices + F.coalesce(even, F.lit(0)))

    def dealt(df: DataFrame) -> DataFrame:
        marked = df.withColumn("_cuts", literal(bounds)).withColumn("_spans", literal(spans))
        marked = marked.withColumn("_part", F.when(F.col("_key").isNull(), 0).otherwise(part))
        return marked.withColumn("_b", (F.col("_part") * (1 << 40) + within).cast("bigint")).drop("_cuts", "_spans", "_part")

    firsts = dealt(keys).groupBy("_b").agg(F.min(F.struct(F.col("_key").isNotNull(), "_key", "_tie")).alias("_m"))
    everything = Window.orderBy("_b")  # one row a range
    whole = everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("_b").over(everything), F.max("_b").over(whole))
    firsts = materialize(firsts.select(F.col("_b").alias("_first_b"), F.col("_m._key").alias("_first_key"), F.col("_m._tie").alias("_first_tie"), before.alias("_before")), "range-firsts")
    is_first = (F.col("_b") == F.col("_first_b")) & F.col("_key").eqNullSafe(F.col("_first_key")) & (F.col("_tie") == F.col("_first_tie"))
    # a written table: Spark broadcasts it if it is below its threshold
    base = dealt(own).join(firsts, is_first, "left")
    stays = F.struct(F.col("_b").alias("b"), F.lit(False).alias("sentinel"))
    also = F.struct(F.col("_before").alias("b"), F.lit(True).alias("sentinel"))
    base = base.withColumn("_at", F.explode(F.when(F.col("_first_b").isNull(), F.array(stays)).otherwise(F.array(stays, also))))
    base = base.select(*[named(c) for c in docs.columns], "_key", "_tie", F.col("_at.b").alias("_b"), F.col("_at.sentinel").alias("_sentinel")).repartition(partitions, "_b")
    order = Window.partitionBy("_b").orderBy("_sentinel", F.col("_key").asc_nulls_first(), "_tie", *[named(c) for c in columns])
    led = base.select(*[named(c) for c in docs.columns], "_sentinel", *[F.lead(named(c)).over(order).alias(f"_next_{c}") for c in columns])
    return led.filter(~F.col("_sentinel")).drop("_sentinel")


def fingerprint_edits(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    fraction: float = FRACTION,
) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how alike they are.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many (or
    all) of the next document in ascending id; after the last comes the first. Columns: doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    contained_edited, contained_next (share of this sketch found in the other).

    Defined cases: null text counts as empty; an empty text has an empty fingerprint, and two
    empty ones are alike; rows that share an id follow each other by a hash of their text; null ids
    come first; long texts are read whole; a single document is its own next one; an empty table
    gives an empty result; other columns of ``docs`` are not read.
    """
    slim = docs.select(named(doc_id).alias("doc_id"), F.coalesce(named(text), F.lit("")).alias("text"))
    led = with_next(with_sketch(slim, "text", "sketch", shingle, fraction), "doc_id", "text", ["text", "sketch"])
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("_next_text"), F.lit(1), cut))
    led = led.select("doc_id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "sketch", "_next_sketch")
    out = with_sketch(led, "edited", "changed", shingle, fraction)
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        shown(F.col("sketch")).alias("fingerprint"),
        shown(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("changed")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("_next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("changed")).alias("contained_edited"),
        containment(F.col("sketch"), F.col("_next_sketch")).alias("contained_next"),
    )
