"""Language identification with error-correcting output codes.

Each language has a codeword; one binary classifier per bit, linear in hashed byte trigrams of the
lower-cased letters, predicts that bit. The losses of all bits, each weighted by how well its
classifier does on texts that it didn't learn from, are summed per codeword; the smallest sum
decides, and a close second is flagged as ambiguous. A text that fits no codeword better than
chance is flagged as strange. Learning uses a bounded sample per language, predictions read every
whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweft.llm.arrow import bounded, relax
from roadweft.llm.columns import ROW, fields, named, row_of
from roadweft.session import materialize

#: Distinct texts learnt from per language, at most.
SAMPLE = 1_500
#: Of these every fourth only weighs the bits; then all are learnt from.
WEIGHING = 4
#: Learned languages; the model, which is broadcast, has 32768 numbers per bit: 12 MB at most.
MAX_LANGUAGES = 512
BUCKETS = 1 << 15
BITS = 15
SMOOTH = 0.5
MARGIN = 0.1
SCALE = 4.0
#: A text is strange if its best codeword's loss is at least this share of the loss of no evidence:
#: at sf0.1 the documents' largest share is 0.70 (one of 3 letters), other scripts have 0.85 or more.
CHANCE = 0.8
UNKNOWN = "und"
CHUNK = 1 << 18

_SPACE = 32
_MAP = np.arange(256, dtype=np.uint8)
_MAP[[c for c in range(128) if not chr(c).isalpha()]] = _SPACE


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed trigrams of all texts in a row, where each text's begin and end): a text stands
    between blanks, runs of other characters than letters being blanks."""
    parts, edges, at = [], [0], 0
    for text in texts:
        raw = _MAP[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8)]
        # runs of blanks become one
        blank = raw == _SPACE
        raw = raw[~(blank & np.concatenate([[False], blank[:-1]]))].astype(np.uint32)
        if len(raw) < 3:
            raw = np.full(3, _SPACE, dtype=np.uint32)
        key = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
        parts.append((key * np.uint32(2654435761)) >> np.uint32(32 - 15))
        at += len(key)
        edges.append(at)
    return np.concatenate(parts) if parts else np.empty(0, np.uint32), np.array(edges)


def codewords(n: int, bits: int = BITS, seed: int = 5) -> np.ndarray:
    """n codewords of +1 and -1: all two-way divisions for a few languages, else random words, each
    chosen far from those before it. No bit has the same value for all languages."""
    if n == 1:
        return np.ones((1, 1))
    if n <= 5:
        words = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(words).T.astype(float)
    rng, width = np.random.default_rng(seed), max(bits, int(10 * np.log2(n)))
    rows = [rng.choice([-1.0, 1.0], width)]
    while len(rows) < n:
        tries = rng.choice([-1.0, 1.0], (64, width))
        far = np.min([(tries != r).sum(1) for r in rows], axis=0)
        rows.append(tries[int(np.argmax(far))])
    code = np.array(rows)
    return code[:, np.abs(code.sum(0)) < n]


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray
    #: BUCKETS x bits: log odds of a trigram where the bit is 1
    odds: np.ndarray
    weights: np.ndarray
    margin: float = MARGIN

    def margins(self, texts: list[str]) -> np.ndarray:
        """texts x bits: mean log odds."""
        keys, edges = grams(texts)
        out = np.empty((len(texts), self.odds.shape[1]))
        first = 0
        while first < len(texts):  # some texts, or a part of a long one, at a time
            last = max(first + 1, int(np.searchsorted(edges, edges[first] + CHUNK, side="right")) - 1)
            if last == first + 1:
                total = sum(self.odds[keys[i : min(i + CHUNK, edges[last])]].sum(0, dtype=np.float64) for i in range(edges[first], edges[last], CHUNK))
                out[first] = total / (edges[last] - edges[first])
            else:
                sums = np.add.reduceat(self.odds[keys[edges[first] : edges[last]]], edges[first:last] - edges[first], axis=0, dtype=np.float64)
                out[first:last] = sums / np.diff(edges[first : last + 1])[:, None]
            first = last
        return out

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(language numbers, scores 0..1, ambiguous, loss as a share of the loss of no evidence)."""
        if len(self.languages) == 1:
            return np.zeros(len(texts), int), np.ones(len(texts)), np.zeros(len(texts), bool), np.zeros(len(texts))
        m = self.margins(texts)
        losses = np.logaddexp(0.0, -SCALE * m[:, None, :] * self.code[None]) @ self.weights
        weigh = np.exp(losses.min(1, keepdims=True) - losses)
        chance = weigh / weigh.sum(1, keepdims=True)
        order = np.sort(chance, axis=1)
        share = losses.min(1) / (np.log(2.0) * self.weights.sum())
        return losses.argmin(1), chance.max(1), order[:, -1] - order[:, -2] < self.margin, share


def held_out(doc_id: Column) -> Column:
    """Whether crc32(id as text) mod 4 is 2; rows without an id are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def drawn_texts(rows: DataFrame, text: str, lang: str, sample: int, seed: int) -> tuple[list[str], DataFrame]:
    """(languages, (k, place, text)): at most ``sample`` distinct texts per language, those of
    smallest hash; ``place`` numbers them from 0. Copies of a text count as one, so neither the
    bound nor a language depends on them."""
    known = rows.filter(named(lang).isNotNull() & named(text).rlike(r"\p{L}")).select(named(text).cast("string").alias("text"), named(lang).cast("string").alias("lang"))
    known = known.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "text"), 1))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    number, below = F.lit(-1), F.lit(0.0)
    for k, name in enumerate(languages):
        number = F.when(F.col("lang") == name, F.lit(k)).otherwise(number)
        # twice as many as are wanted, since sizes are estimates
        below = F.when(F.col("lang") == name, F.lit(min(1.0, 2 * sample / max(1, sizes[name])))).otherwise(below)
    few = known.filter(F.col("h") <= below * float(1 << 63)).select(number.alias("k"), "h", "text").dropDuplicates(["k", "h"])
    place = F.row_number().over(Window.partitionBy("k").orderBy("h")) - 1
    return languages, materialize(few.withColumn("place", place).filter(F.col("place") < sample).select("k", "place", "text"), "languages")


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE, seed: int = 3) -> Model | None:
    """A model from labelled rows; None if there are none. It learns from `drawn_texts`; bits are
    weighted by a first model, learnt without every WEIGHING-th text, on those texts. The driver
    holds counts of buckets x languages."""
    bounded(rows.sparkSession)
    languages, drawn = drawn_texts(rows, text, lang, sample, seed)
    if not languages:
        return None
    drawn = drawn.select("k", "text", (F.col("place") % WEIGHING == WEIGHING - 1).alias("weighs"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, bool], np.ndarray] = {}
        for batch in batches:
            for t, k, w in zip(batch.column("text").to_pylist(), batch.column("k").to_pylist(), batch.column("weighs").to_pylist()):
                keys, _ = grams([t])
                # a long text counts no more than others
                total[k, w] = total.get((k, w), 0) + np.bincount(keys, minlength=BUCKETS) / len(keys)
        for (k, w), c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(at), k), pa.int32()), "w": pa.array(np.full(len(at), int(w)), pa.int32()), "g": pa.array(at, pa.int32()), "c": pa.array(c[at], pa.float64())})

    counts = np.zeros((2, len(languages), BUCKETS))
    for k, w, g, c in drawn.mapInArrow(count, "k int, w int, g int, c double").groupBy("k", "w", "g").agg(F.sum("c").alias("c")).toPandas().itertuples(index=False):
        counts[w, k, g] = c
    code = codewords(len(languages))
    bits = code.shape[1]

    def learned(seen: np.ndarray, weights: np.ndarray) -> Model:
        used = max(1, int((seen.sum(0) > 0).sum()))
        chance = seen + SMOOTH * seen.sum() / used / len(languages)
        chance /= chance.sum(1, keepdims=True)
        odds = np.zeros((BUCKETS, bits), dtype=np.float32)
        for b in range(bits):
            if len(languages) > 1:
                odds[:, b] = np.log(chance[code[:, b] > 0].mean(0)) - np.log(chance[code[:, b] < 0].mean(0))
        return Model(languages, code, odds, weights)

    first = learned(counts[0], np.ones(bits))

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column("k").to_numpy()
            good = (np.sign(first.margins(batch.column("text").to_pylist())) == first.code[k]).sum(0)
            yield pa.RecordBatch.from_pydict({"n": [len(k)], "good": [good.tolist()]})

    tested = drawn.filter("weighs").mapInArrow(right, "n bigint, good array<bigint>")
    sums = tested.agg(F.sum("n").alias("n"), *[F.sum(F.col("good")[b]).alias(f"b{b}") for b in range(bits)]).first()
    rate = np.array([((sums[f"b{b}"] or 0) + 1) / ((sums["n"] or 0) + 2) for b in range(bits)])
    # AdaBoost's weight of a classifier with this rate of right answers, at least a little
    weights = np.maximum(0.05, 0.5 * np.log(rate / (1 - rate)))
    return learned(counts.sum(0), weights / weights.sum() * bits)


GUESS = "lang_pred string, score double, ambiguous boolean, strange boolean"
_NAMES = [f.split()[0] for f in GUESS.split(", ")]


def _guessed(docs: DataFrame, model: Model | None, text: str) -> DataFrame:
    """ROW and GUESS of every row. Only the row goes to Python, its text read from it."""
    bounded(docs.sparkSession)
    marked = docs.select(row_of(docs), F.coalesce(named(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    schema = marked.select(ROW).schema
    for name in GUESS.split(", "):
        schema = schema.add(*name.split())
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            n, rows = batch.num_rows, batch.column(0)
            use = batch.column(1).to_numpy(zero_copy_only=False) & (known is not None)
            names, scores, close, strange = np.full(n, UNKNOWN, dtype=object), np.zeros(n), np.ones(n, bool), np.ones(n, bool)
            if use.any():
                at, score, near, share = known.predict(rows.field(place).filter(pa.array(use)).to_pylist())
                names[use], scores[use], close[use], strange[use] = np.array(known.languages, dtype=object)[at], score, near, share >= CHANCE
            yield pa.RecordBatch.from_arrays([rows, pa.array(names, pa.string()), pa.array(scores), pa.array(close), pa.array(strange)], [ROW, *_NAMES])
        relax()

    return marked.mapInArrow(guess, schema)


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1), ambiguous and strange.

    Defined cases: a text that is null or has no letter is `und` with score 0, ambiguous and
    strange, as is every text without a model; ties fall to the first language; long texts are
    read whole, in parts; repeated rows are all returned; an empty table gives an empty result.
    Columns of ``docs`` may have any name; those named as the new ones are replaced.
    """
    return _guessed(docs, model, text).select(*fields(docs, *_NAMES), *_NAMES)


def identify(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, into: str | None = None
) -> DataFrame:
    """``docs`` with held_out, lang_pred, score, ambiguous and strange, as columns or as one struct
    named ``into``. Learns only from rows with an id and a label that are not held out. The label,
    the id and other columns are no inputs of a prediction.

    Defined cases as in `predict`; a row without an id is not held out; without any label to learn
    from every text is `und`. Columns named as the new ones are replaced, with ``into`` only that.
    """
    held = held_out(named(doc_id))
    found = _guessed(docs, fit(docs.filter(~held & named(doc_id).isNotNull()), text, lang, sample), text)
    new = [held_out(F.col(ROW).getField(doc_id)).alias("held_out"), *map(F.col, _NAMES)]
    if into is not None:
        return found.select(*fields(docs, into), F.struct(*new).alias(into))
    return found.select(*fields(docs, "held_out", *_NAMES), *new)
