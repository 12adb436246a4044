"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets an exponential key -ln(u) / weight, u being a uniform number hashed from its
content; the smallest keys of a source are a sample without replacement in proportion to the
weights. Whole epochs come first; the fraction left is taken in key order up to the budget.

No source is ever sorted as a whole: keys are counted in equal-width buckets per source (partial
sums map-side), only the bucket in which the budget ends is divided again, and once it holds few
rows these alone are sorted and prefix-summed. The driver holds one row per source and round.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadweft.llm.columns import ROW, fields, named, row_of
from roadweft.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_EPOCHS = 2.0
WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096
SORT_ROWS = 2_000
MAX_SOURCES = 100_000


def words(text: Column) -> Column:
    """Number of runs of anything but ASCII blanks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: dict, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> dict:
    """Words to take of each source: shares of ``share`` x all words by weight, none above
    ``max_epochs`` x its size; what is cut off is shared again among the rest until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))  # str order is code point order
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_ = share * sum(sizes.values()), list(order)
    out = {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > max_epochs * sizes[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = max_epochs * sizes[s]
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return out


def _per_source(spark: SparkSession, values: dict, schema: str) -> DataFrame:
    """One row per source, as a local relation: Spark knows its size and broadcasts it only where it
    is below its threshold."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64()}
    fields = pa.schema([(n, kinds[f.split()[1]]) for n, f in zip(names, schema.split(", "))])
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(names, (s, *v))) for s, v in values.items()], schema=fields), schema)


def choose(
    docs: DataFrame,
    quality: DataFrame | None = None,
    source: str = "source",
    text: str = "text",
    doc_id: str = "doc_id",
    weights=WEIGHTS,
    share: float = SHARE,
    max_epochs: float = MAX_EPOCHS,
    seed: int = 17,
    buckets: int = BUCKETS,
    sort_rows: int = SORT_ROWS,
) -> DataFrame:
    """What the mix takes of each row: doc_id, source, size, source_size, target, copies, taken
    (= copies x size) and digest.

    ``quality`` has columns doc_id and weight, the document's quality weight; where it is missing,
    null or not above 0 it counts as 1; of several rows the largest holds. A source that is due t
    words of its s gets floor(t / s) whole epochs and the documents of smallest key whose prefix
    sum ends nearest to the rest. Texts are read once and never shuffled.

    Defined cases: null or blank text has size 0 and is never a fraction's document; null sources
    form one source that stands last; keys depend on id and text alone, so reruns agree and
    repeated rows are taken or left together; an empty table gives an empty result; columns may
    have any name. The driver holds one row per source, of which there may be MAX_SOURCES: more are
    an error, since weights are assigned source by source.
    """
    spark = docs.sparkSession
    slim = docs.select(
        named(source).alias("_s"),
        named(doc_id).alias("_id"),
        words(named(text)).alias("size"),
        F.xxhash64(F.lit(seed), named(doc_id), named(text)).alias("_d"),
    )
    w = F.lit(1.0)
    if quality is not None:
        slim = materialize(slim, "mix-sizes")
        best = quality.filter("doc_id IS NOT NULL AND weight > 0").groupBy(F.col("doc_id").alias("_of")).agg(F.max("weight").alias("_w"))
        slim = slim.join(best, F.col("_id") == F.col("_of"), "left")
        w = F.coalesce(F.col("_w"), F.lit(1.0))
    # 53 bits, never 0: u in (0, 1]; the key's distribution function 1 - u^(1/w) keeps its order
    # and makes buckets even
    u = (F.shiftrightunsigned("_d", 11).cast("double") + 1.0) / F.lit(float(1 << 53))
    slim = materialize(slim.select("_s", "_id", "size", (1.0 - F.exp(F.log(u) / w)).alias("_k"), "_d"), "mix-keys")
    sums = slim.groupBy("_s").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"))
    sizes = {r["_s"]: (r["n"] or 0, r["rows"]) for r in sums.limit(MAX_SOURCES + 1).collect()}
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    due = targets({s: n for s, (n, _) in sizes.items()}, weights, share, max_epochs)
    plan = {}
    for s, (n, rows) in sizes.items():
        epochs = min(int(due[s] // n), int(max_epochs)) if n else 0
        # open interval of keys [lo, hi), words taken below it, rows in it, words left to take
        plan[s] = {"epochs": epochs, "lo": 0.0, "hi": math.nextafter(1.0, 2.0), "rows": rows, "rest": due[s] - epochs * n}
    candidates = slim.filter("size > 0")
    while wide := {s: p for s, p in plan.items() if p["rows"] > sort_rows and p["rest"] > 0 and p["hi"] - p["lo"] > 1e-15}:
        edges = _per_source(spark, {s: (p["lo"], p["hi"], float(p["rest"])) for s, p in wide.items()}, "_of string, lo double, hi double, rest double")
        inside = candidates.join(edges, F.col("_s").eqNullSafe(F.col("_of"))).filter("_k >= lo AND _k < hi")
        bucket = F.least(F.floor((F.col("_k") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets), F.lit(buckets - 1))
        sums = inside.groupBy("_s", "rest", bucket.alias("b")).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"))
        before = F.sum("n").over(Window.partitionBy("_s").orderBy("b")) - F.col("n")
        crossing = sums.withColumn("before", before).filter("before <= rest AND before + n > rest")
        found = {r["_s"]: r for r in crossing.collect()}
        for s, p in wide.items():
            if s not in found:  # the whole interval fits
                p |= {"lo": p["hi"], "rows": 0}
                continue
            r, step = found[s], (p["hi"] - p["lo"]) / buckets
            lo = p["lo"] + r["b"] * step
            p |= {"lo": lo, "hi": lo + step if r["b"] < buckets - 1 else p["hi"], "rows": r["rows"], "rest": p["rest"] - r["before"]}
    cuts = _per_source(spark, {s: (p["lo"], p["hi"], float(p["rest"]), p["epochs"], sizes[s][0], due[s]) for s, p in plan.items()}, "_of string, lo double, hi double, rest double, epochs bigint, source_size bigint, target double")
    edge = candidates.join(cuts, F.col("_s").eqNullSafe(F.col("_of"))).filter("_k >= lo AND _k < hi AND rest > 0")
    # equal keys are equal digests, hence repeated rows: one sum per key, taken or left together
    edge = edge.groupBy("_s", "rest", "_k").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("_s").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))
    last = edge.withColumn("upto", upto).filter("upto <= rest OR upto - rest <= rest - (upto - size)")
    ends = {r["_s"]: r["k"] for r in last.groupBy("_s").agg(F.max("_k").alias("k")).collect()}
    final = {s: (float(p["epochs"]), ends.get(s, math.nextafter(p["lo"], -1.0)), sizes[s][0], float(due[s])) for s, p in plan.items()}
    marks = _per_source(spark, final, "_of string, _e double, _last double, source_size bigint, target double")
    joined = slim.join(marks, F.col("_s").eqNullSafe(F.col("_of")), "left")
    extra = F.when((F.col("size") > 0) & (F.col("_k") <= F.col("_last")), 1).otherwise(0)
    copies = F.least(F.col("_e").cast("bigint") + extra, F.lit(int(max_epochs))).cast("bigint")
    return joined.select(
        F.col("_id").alias("doc_id"),
        F.col("_s").alias("source"),
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).cast("bigint").alias("taken"),
        F.col("_d").alias("digest"),
    )


def mix(docs: DataFrame, quality: DataFrame | None = None, text: str = "text", doc_id: str = "doc_id", seed: int = 17, **options) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as ``choose`` takes it (0, 1 or more times),
    with its own columns, whatever their names. Rows of size 0 follow their source's whole epochs;
    null ids and texts, repeated rows and an empty table are as in ``choose``."""
    taken = choose(docs, quality, text=text, doc_id=doc_id, seed=seed, **options)
    taken = taken.filter("copies > 0").groupBy(F.col("doc_id").alias("of"), F.col("digest").alias("its")).agg(F.max("copies").alias("copies"))
    keyed = docs.select(row_of(docs), named(doc_id).alias("id"), F.xxhash64(F.lit(seed), named(doc_id), named(text)).alias("digest"))
    # equal ids and digests are repeated rows
    joined = keyed.join(taken, F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("its")))
    return joined.select(ROW, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*fields(docs))
