"""Near-dedup of texts by Order MinHash, verified by banded alignment.

A text is the sequence of its five-word shingles, each labelled with its occurrence number, so
no label repeats within a text. Per permutation the three smallest labels, in text order, make one
bucket key: two texts share it if they have the same smallest shingles in the same order, which
tells edits from mere overlap. Candidates are verified by aligning the two label sequences:
similarity is L / (a + b - L) for the longest common subsequence L, found within the band that a
similarity of the threshold allows.

No bucket is ever expanded into pairs. First every text is held against the likeliest of a few
leaders of its buckets, and what is linked is merged. Buckets in which several groups remain are
compared inside a task, block by block, between texts of different groups only: in a second round
every text is held against the few likeliest that it meets, and in a third, after another merge,
whatever groups are still apart are compared in full. A bucket too large for that is divided by
further minima, so its cost stays in proportion to its texts. Pairs whose 128 minima can't belong
to a similar pair go no further.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweft.llm.arrow import bounded, relax
from roadweft.llm.columns import ROW, fields, named, row_of
from roadweft.llm.fingerprints import BLANKS
from roadweft.llm.tokens import slices
from roadweft.operators.components import Union, components
from roadweft.session import materialize

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 16
TAKEN = 3
MINIMA = 128
#: Of 128 minima a pair of likeness 0.8 shares fewer than 84 about as rarely (3 in 100 000) as it
#: shares no bucket.
LEAST_SHARED = 84
LEADERS = 4
LIKELIEST = 4
BLOCK = 2048
GROUP_ROWS = 50_000
#: A bucket of more blocks than a text has pieces is divided by pieces of SUB_TAKEN minima, which no
#: bucket's key uses. A pair of likeness 0.8 shares none of them about once in 4e10.
SUB_START, SUB_PIECES, SUB_TAKEN, SUB_LEVELS = 16, 24, 2, 2
DIVIDE = SUB_PIECES
SLICE_CHARS = 2_000_000

_MASK = (1 << 64) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SKETCH = "doc_id bigint, key binary, n int, minima binary, buckets array<bigint>"


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words (the finaliser of MurmurHash3: fixed values)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_PERMUTE = _multipliers(MINIMA, 11)
_ORDER = _multipliers(TAKEN + 1, 13)
_PLACE = _multipliers(SHINGLE, 17)


def normal(text: Column) -> Column:
    """Lower-cased words with single spaces between."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), BLANKS, " "))


def labels(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(occurrence-labelled shingle hashes of normalised texts in a row, where each begins and ends).
    A text of fewer words than a shingle is one shingle; one without words has none."""
    words = pc.split_pattern(pc.fill_null(texts, "").cast(pa.large_string()), " ")
    coded = words.flatten().dictionary_encode()
    unique = np.array([xxhash.xxh3_64_intdigest(w) if w else 0 for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    hashed = unique[coded.indices.to_numpy()] if len(unique) else np.empty(0, np.uint64)
    counts = pc.list_value_length(words).to_numpy().astype(np.int64)
    ends = np.cumsum(counts)
    starts = ends - counts
    blank = (counts == 1) & (hashed[np.minimum(starts, max(len(hashed) - 1, 0))] == 0) if len(hashed) else counts >= 0
    size = np.where(blank, 0, np.maximum(counts - SHINGLE + 1, 1))
    edges = np.concatenate([[0], np.cumsum(size)])
    total = int(edges[-1])
    doc = np.repeat(np.arange(len(counts)), size)
    first = np.repeat(starts - edges[:-1], size) + np.arange(total)
    shingle = np.zeros(total, np.uint64)
    limit = ends[doc]
    for k in range(SHINGLE):
        at = first + k
        shingle += np.where(at < limit, hashed[np.minimum(at, max(len(hashed) - 1, 0))], np.uint64(0)) * _PLACE[k]
    shingle = _mix(shingle)
    # a shingle that occurs again in its text is marked by how often it has occurred before
    own = shingle ^ _mix((doc.astype(np.uint64) + np.uint64(1)) * _ODD)
    order = np.argsort(own, kind="stable")
    same = np.zeros(total, bool)
    same[1:] = own[order][1:] == own[order][:-1]
    if same.any():
        run = np.arange(total)
        begin = np.maximum.accumulate(np.where(same, 0, run))
        times = np.empty(total, np.int64)
        times[order] = run - begin
        shingle = np.where(times > 0, _mix(shingle + times.astype(np.uint64) * _ODD), shingle)
    return shingle, edges


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    relax()  # of what earlier stages left
    for batch in batches:
        for a, b in slices(batch.column("norm"), SLICE_CHARS):
            label, edges = labels(batch.column("norm").slice(a, b - a))
            size = np.diff(edges)
            some = np.flatnonzero(size)
            minima = np.zeros((len(size), MINIMA), "<u2")
            if len(some):
                for p in range(MINIMA):
                    minima[some, p] = np.minimum.reduceat((label * _PERMUTE[p]) >> np.uint64(32), edges[some]) & np.uint64(0xFFFF)
            buckets = np.zeros((len(size), BANDS), np.uint64)
            for d in some:
                own = label[edges[d] : edges[d + 1]]
                places = np.arange(len(own))[None].repeat(BANDS, 0)
                if len(own) > TAKEN:
                    places = np.sort(np.argpartition(own[None] * _PERMUTE[:BANDS, None], TAKEN - 1, axis=1)[:, :TAKEN], axis=1)
                taken = own[places]  # in text order
                buckets[d] = (taken * _ORDER[: taken.shape[1]]).sum(1, dtype=np.uint64)
            buckets = _mix(buckets + np.arange(1, BANDS + 1, dtype=np.uint64) * _ORDER[TAKEN])
            lists = pa.ListArray.from_arrays(pa.array(np.where(size > 0, BANDS, 0).cumsum() - np.where(size > 0, BANDS, 0)).cast(pa.int32()).to_pylist() + [int(BANDS * len(some))], pa.array(buckets[some].view(np.int64).ravel()))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").slice(a, b - a),
                    "key": batch.column("key").slice(a, b - a),
                    "n": pa.array(size, pa.int32()),
                    "minima": pa.array([m.tobytes() for m in minima], pa.binary()),
                    "buckets": lists,
                }
            )
    relax()


def similarity(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """L / (a + b - L) of two label sequences, L being the longest common subsequence within the
    band that ``threshold`` allows; exact where it is at least ``threshold``, else maybe too small."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    common, at, to = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    # similar texts differ by at most this many insertions and deletions, so no pair strays further
    band = (n + m) * (1 - threshold) / (1 + threshold)
    near = np.abs(at - to) <= band
    if 2 * near.sum() < (n + m) - band - 1e-9:
        return float(near.sum()) / (n + m - near.sum())
    order = np.argsort(at[near])
    tails: list[int] = []
    # labels don't repeat, so the alignment is the longest increasing run of places
    for place in to[near][order].tolist():
        k = bisect_left(tails, place)
        if k == len(tails):
            tails.append(place)
        else:
            tails[k] = place
    return len(tails) / (n + m - len(tails))


def _verify(threshold: float):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, le = labels(batch.column("left"))
            right, re = labels(batch.column("right"))
            good = np.array([similarity(left[le[i] : le[i + 1]], right[re[i] : re[i + 1]], threshold) >= threshold for i in range(batch.num_rows)], bool)
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))
        relax()

    return step


def _aligned(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose texts are similar; each text travels with its pairs."""
    left = pairs.join(texts.select(F.col("uid").alias("_l"), F.col("norm").alias("left")).hint("merge"), F.col("u") == F.col("_l"))
    both = left.join(texts.select(F.col("uid").alias("_r"), F.col("norm").alias("right")).hint("merge"), F.col("v") == F.col("_r"))
    return materialize(both.select("u", "v", "left", "right").mapInArrow(_verify(threshold), "u bigint, v bigint"), "similar")


def _compare(least: int, ratio: float):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            minima = [np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, MINIMA) for c in ("minima", "minima2")]
            n, m = batch.column("n").to_numpy(), batch.column("n2").to_numpy()
            shared = (minima[0] == minima[1]).sum(-1)
            good = (shared >= least) & (np.minimum(n, m) >= ratio * np.maximum(n, m))
            out = pa.RecordBatch.from_pydict({"u": batch.column("u"), "v": batch.column("v"), "shared": pa.array(shared, pa.int32())})
            yield out.filter(pa.array(good))

    return step


def _likely(part: pd.DataFrame, least: int, ratio: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, rows, shared minima) of likely similar texts of different groups in a block pair, some
    at a time. A pair that meets in several buckets counts in the first of them only, and there in
    the first sub-bucket."""
    minima = np.frombuffer(b"".join(part.minima), "<u2").reshape(-1, MINIMA)
    buckets = np.array(part.buckets.tolist(), np.int64)
    label, n, own = part.label.to_numpy(), part.n.to_numpy(), part.own.to_numpy()
    here, path = buckets == part.root.iloc[0], part.path.iloc[0]
    left, right = np.flatnonzero(own == part.i.iloc[0]), np.flatnonzero(own == part.j.iloc[0])
    for a in range(0, len(left), 64):
        l = left[a : a + 64]
        may = (label[l][:, None] != label[right][None]) & (np.minimum(n[l][:, None], n[right][None]) >= ratio * np.maximum(n[l][:, None], n[right][None]))
        x, y = np.nonzero(may)
        for c in range(0, len(x), 8192):
            p, q = l[x[c : c + 8192]], right[y[c : c + 8192]]
            same = minima[p] == minima[q]
            shared = same.sum(-1)
            first = (buckets[p] == buckets[q]).argmax(1)
            good = (shared >= least) & here[p, first]
            for level, piece in enumerate(path):
                at = SUB_START + level * SUB_PIECES * SUB_TAKEN
                pieces = same[:, at : at + SUB_PIECES * SUB_TAKEN].reshape(-1, SUB_PIECES, SUB_TAKEN).all(2)
                good &= pieces.argmax(1) == piece
            yield p[good], q[good], shared[good]


_BLOCK = ["bucket", "i", "j"]
_SPOT = ["uid", "root", "path", *_BLOCK, "own"]


def _block_pairs(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for _, part in rows.groupby(_BLOCK, sort=False):
        yield part.reset_index(drop=True)


def _partners(least: int, ratio: float, top: int):
    """Of each text of a task's block pairs the ``top`` likeliest of other groups."""

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        us, vs = [], []
        for part in _block_pairs(rows):
            uid = part.uid.to_numpy()
            for x, y, shared in _likely(part, least, ratio):
                order = np.lexsort((uid[y], -shared, x))
                x, y = x[order], y[order]
                kept = np.arange(len(x)) - np.searchsorted(x, x) < top
                us.append(uid[x[kept]])
                vs.append(uid[y[kept]])
        u, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (us, vs))
        found = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], 1), axis=0)
        relax()
        return pd.DataFrame({"u": found[:, 0], "v": found[:, 1]})

    return pairs


def _involved(least: int, ratio: float):
    """The rows of a task's block pairs that any likely pair holds."""

    def needed(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part in _block_pairs(rows):
            some = np.zeros(len(part), bool)
            for x, y, _ in _likely(part, least, ratio):
                some[x] = some[y] = True
            out.append(part.loc[some, _SPOT])
        relax()
        return pd.concat(out) if out else rows[_SPOT].head(0)

    return needed


def _settled(least: int, ratio: float, threshold: float):
    """Links of all likely pairs of a task's block pairs: each text's labels are made once, each
    pair is aligned here, and links that join nothing new are left out."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        us, vs = [], []
        for part in _block_pairs(rows):
            label, edges = labels(pa.array(part.norm, pa.large_string()))
            own, uid = Union(len(part)), part.uid.to_numpy()
            for x, y, _ in _likely(part, least, ratio):
                for a, b in zip(x.tolist(), y.tolist()):
                    if own.root(a) == own.root(b):
                        continue
                    if similarity(label[edges[a] : edges[a + 1]], label[edges[b] : edges[b + 1]], threshold) >= threshold:
                        own.join(a, b)
                        us.append(uid[a])
                        vs.append(uid[b])
        relax()
        return pd.DataFrame({"u": pd.Series(us, dtype="int64"), "v": pd.Series(vs, dtype="int64")})

    return links


def _grouped(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` (uid, ...) with label: the smallest uid that links reach."""
    parts = components(links)
    return nodes.join(parts, F.col("uid") == F.col("node"), "left").withColumn("label", F.coalesce("component", "uid")).drop("node", "component")


def _several(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` (label, bucket, ...) of buckets that hold several groups, with their blocks."""
    groups = rows.groupBy(F.col("bucket").alias("_bucket")).agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size"))
    groups = groups.filter("low <> high").select("_bucket", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    return rows.join(groups, F.col("bucket") == F.col("_bucket")).drop("_bucket")


def _open(posted: DataFrame, labelled: DataFrame, block: int, divide: int = DIVIDE) -> DataFrame:
    """_SPOT: the places of texts in buckets that hold several groups.

    Large buckets are cut into blocks; each pair of blocks (i, j) is a place of its own, own being
    the text's block. A bucket of over ``divide`` blocks is divided first: a text goes to one
    sub-bucket per piece of its minima, and similar texts share a piece nearly surely, so there are
    SUB_PIECES rows a text instead of one per block. Sub-buckets of one group are left out, those
    that are still large are divided again by other minima, and then cut into blocks like others.
    root is the bucket and path the pieces that led here. ``posted``: (uid, bucket); ``labelled``:
    (uid, label, minima, ...)."""
    placed = materialize(posted.join(labelled.select("uid", "label"), "uid"), "placed")
    rows = _several(placed.select("uid", "label", F.col("bucket").alias("root"), "bucket", F.array().cast("array<int>").alias("path")), block)
    rows, done = materialize(rows, "several"), []
    for level in range(SUB_LEVELS):
        large = rows.filter(F.col("blocks") > divide)
        if large.isEmpty():
            break
        done.append(rows.filter(F.col("blocks") <= divide))
        at = SUB_START + level * SUB_PIECES * SUB_TAKEN  # two bytes a minimum
        pieces = F.array(*[F.struct(F.lit(k).alias("k"), F.substring("minima", 2 * (at + k * SUB_TAKEN) + 1, 2 * SUB_TAKEN).alias("of")) for k in range(SUB_PIECES)])
        split = large.join(labelled.select("uid", "minima"), "uid").withColumn("piece", F.explode(pieces))
        split = split.select("uid", "label", "root", F.xxhash64("bucket", "piece.k", "piece.of").alias("bucket"), F.array_append("path", F.col("piece.k")).alias("path"))
        rows = materialize(_several(materialize(split, "pieces"), block), "several")
    for part in done:
        rows = rows.unionByName(part)
    rows = rows.select("uid", "root", "path", "bucket", "blocks", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int").alias("own"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return materialize(rows.withColumn("i", F.least("own", "o")).withColumn("j", F.greatest("own", "o")).select(*_SPOT), "open-buckets")


def _tasks(rows: DataFrame) -> Column:
    """The task of a block pair; there are enough that each has some GROUP_ROWS rows at most."""
    many = max(rows.count() // GROUP_ROWS, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return F.pmod(F.xxhash64(*_BLOCK), F.lit(many)).alias("task")


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    block: int = BLOCK,
    divide: int = DIVIDE,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (digest of the normalised text), class_id (smallest
    id of its group of near-duplicates), exact_id (smallest id of the same words), kept (true for
    one row of each group) and rid (the row's number).

    Texts whose normalised words are equal are one class and are compared once. Two texts are
    linked if their similarity is at least ``threshold``; groups are connected by links.

    Defined cases: null, empty and blank texts have no shingle, link with nothing and are kept each;
    texts under five words link only with the same words; repeated rows are exact copies, of which
    one is kept; ids that are null are never the smallest if another is; ties of id fall by row
    number; an empty table gives an empty result; other columns are not read.
    """
    bounded(docs.sparkSession)
    ratio = threshold
    whole = docs.select(named(doc_id).cast("bigint").alias("doc_id"), normal(named(text)).alias("norm"))
    whole = whole.withColumn("key", F.unhex(F.md5(F.col("norm").cast("binary"))))
    sketch = materialize(whole.mapInArrow(_sketches, _SKETCH).withColumn("rid", F.monotonically_increasing_id()), "sketches")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    classes = sketch.filter("n > 0").groupBy("key").agg(F.min(rank).alias("best"), F.min("rid").alias("uid"))
    classes = materialize(classes.select("key", "best", "uid"), "classes")
    # one row of each class stands for it
    reps = sketch.join(classes.select(F.col("uid").alias("_uid")).hint("merge"), F.col("rid") == F.col("_uid"), "left_semi")
    reps = materialize(reps.select(F.col("rid").alias("uid"), "doc_id", "key", "n", "minima", "buckets"), "texts")
    posted = reps.select("uid", F.explode("buckets").alias("bucket"))
    # the smallest text of each of a bucket's few parts leads
    part = F.pmod(F.xxhash64("uid", F.lit(5)), F.lit(LEADERS))
    parts = posted.groupBy("bucket", part.alias("part")).agg(F.min("uid").alias("leader"), F.count(F.lit(1)).alias("size"))
    shared = parts.groupBy("bucket").agg(F.collect_list("leader").alias("leaders"), F.sum("size").alias("size")).filter("size > 1").drop("size")
    met = materialize(posted.join(shared.hint("merge"), "bucket"), "buckets")

    sides = lambda pairs: (
        pairs.join(reps.select(F.col("uid").alias("_a"), "n", "minima"), F.col("u") == F.col("_a"))
        .join(reps.select(F.col("uid").alias("_b"), F.col("n").alias("n2"), F.col("minima").alias("minima2")), F.col("v") == F.col("_b"))
        .select("u", "v", "n", "minima", "n2", "minima2")
    )
    led = met.select(F.col("uid").alias("u"), F.explode("leaders").alias("v")).filter("u <> v").distinct()
    near = sides(led)
    near = near.mapInArrow(_compare(LEAST_SHARED, ratio), "u bigint, v bigint, shared int")
    first = materialize(near.groupBy("u").agg(F.max_by("v", F.struct("shared", -F.col("v"))).alias("v")), "leaders")

    # texts that meet any other: the only ones that are read again
    candidates = met.select("uid").distinct()
    wanted = reps.join(candidates, "uid").select("uid", F.col("key").alias("_key"), F.col("doc_id").alias("_id"))
    same = (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    texts = materialize(whole.join(wanted.hint("merge"), same).select("uid", "norm").dropDuplicates(["uid"]), "candidates")

    links = _aligned(first, texts, threshold)
    posted = met.select("uid", "bucket")
    met = reps.join(candidates, "uid").select("uid", "n", "minima", "buckets")

    labelled = _grouped(met, links)
    rows = _open(posted, labelled, block, divide)
    near = rows.join(labelled, "uid").groupBy(_tasks(rows)).applyInPandas(_partners(LEAST_SHARED, ratio, LIKELIEST), "u bigint, v bigint")
    links = links.unionByName(_aligned(materialize(near.distinct(), "partners"), texts, threshold))

    labelled = _grouped(met, links)
    rows = _open(posted, labelled, block, divide)
    place = "uid bigint, root bigint, path array<int>, bucket bigint, i int, j int, own int"
    rows = materialize(rows.join(labelled, "uid").groupBy(_tasks(rows)).applyInPandas(_involved(LEAST_SHARED, ratio), place), "involved")
    full = rows.join(labelled, "uid").join(texts, "uid").groupBy(_tasks(rows))
    links = links.unionByName(materialize(full.applyInPandas(_settled(LEAST_SHARED, ratio, threshold), "u bigint, v bigint"), "settled"))

    grouped = _grouped(classes, links)
    least = grouped.groupBy(F.col("label").alias("_label")).agg(F.min("best").alias("least"))
    known = materialize(grouped.join(least, F.col("label") == F.col("_label")).select(F.col("key").alias("_key"), "best", "least"), "groups")
    out = sketch.select("doc_id", "key", "rid", "n").join(known.hint("merge"), (F.col("key") == F.col("_key")) & (F.col("n") > 0), "left")
    alone = F.col("_key").isNull()
    return out.select(
        "doc_id",
        "key",
        F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("exact_id"),
        (alone | (F.col("rid") == F.col("least.rid"))).alias("kept"),
        "rid",
    )


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one of smallest id.

    Defined cases as in `near_duplicates`: texts without words (null, empty, blank) all stay; of
    repeated rows one stays; null ids are the smallest of no group that has another; an empty table
    gives an empty result. Columns may have any name and are unchanged."""
    found = near_duplicates(docs, doc_id, text, threshold)
    # a pattern that stops at the first word tells blank texts, so texts are normalised once
    worded = F.coalesce(named(text).rlike(r"[^\x09-\x0D\x20]"), F.lit(False))
    blank = docs.filter(~worded).select(row_of(docs))
    digest = F.coalesce(F.unhex(F.md5(normal(named(text)).cast("binary"))), F.lit(b""))
    keyed = docs.filter(worded).select(row_of(docs), named(doc_id).cast("bigint").alias("id"), digest.alias("digest"))
    kept = materialize(found.filter("kept").select(F.col("key").alias("_key"), F.col("doc_id").alias("_id")), "kept")
    # rows that repeat id and words, of which any other column may differ: the first met stays
    repeated = found.groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not repeated.isEmpty():
        keyed = keyed.dropDuplicates(["digest", "id"])
    rows = keyed.join(kept.hint("merge"), (F.col("digest") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    return rows.select(ROW).unionByName(blank).select(*fields(docs))
