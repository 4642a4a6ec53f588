"""Toxicity by a linear model on character n-grams, scaled by naive Bayes ratios.

Features are the presence of n-grams of ``ORDERS`` characters of the text in lower case, in
2^``BUCKETS`` hash buckets. With p and q the smoothed shares of a bucket in the documents of
either class, a feature's value is its log-count ratio log(p/q) (Wang and Manning, "Baselines
and Bigrams", 2012), drawn towards 0 by ``EVIDENCE`` of its standard errors, so that an n-gram
counts for as much as its rows show; a logistic model with a quadratic penalty is fitted on
top. No feature is left out otherwise, however many there are.

The model is learned from a bounded sample: the ``ROWS`` labelled rows of the learning fold
that come first by a hash of their id, of at most ``ROW_BYTES`` bytes each, whole, and of
``SAMPLE_BYTES`` together. Their n-grams are counted by class in an aggregation; the driver
sees the counts (12 bytes a bucket) and each row's features, not the texts. Scores cover every
n-gram of every text, whatever its length. A null or empty text scores as one without n-grams.
With one class or none in the sample, all scores are the smoothed share of toxic rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from fieldbook.llm.common import cut, drop, free, map_arrow, named, require_free, slices

ORDERS = (3, 4, 5, 6)
BUCKETS = 22  # as a power of two
EVIDENCE = 3.0
ROWS = 8192
ROW_BYTES = 1 << 16
SAMPLE_BYTES = 32 << 20
PENALTY = 1.0
_TASKS = 8
_WINDOW = 1 << 19


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(F.col(id_col).cast("string")) % 5


def _buckets(text: bytes):
    """The buckets of all n-grams of the characters of a text in lower case, in bounded arrays."""
    data = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), np.uint32)
    for start in range(0, len(data), _WINDOW):
        part = data[start : start + _WINDOW + max(ORDERS) - 1]
        hashes = np.zeros(len(part), np.uint32)
        for order in range(1, min(max(ORDERS), len(part)) + 1):
            hashes = hashes[: len(part) - order + 1] * np.uint32(0x01000193) + part[order - 1 :] + np.uint32(order)
            if order in ORDERS:
                yield ((hashes[:_WINDOW] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS)).astype(np.int32)


def present(text: bytes, used: np.ndarray | None = None) -> np.ndarray:
    """The distinct buckets of one text, each once, or those of them that are used."""
    found, n = [], 0
    for bucket in _buckets(text):
        found.append(bucket if used is None else bucket[used[bucket]])
        n += len(found[-1])
        if n > _WINDOW:  # a long text is never held as all its n-grams
            found = [np.unique(np.concatenate(found))]
            n = 0
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


@dataclass
class Model:
    weight: np.ndarray  # of every bucket; 0 where it is of no evidence
    intercept: float

    def __post_init__(self):
        self.used = self.weight != 0

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The probability of every text, from all its n-grams."""
        total = np.array([self.intercept + float(self.weight[present(t, self.used)].sum(dtype=np.float64)) for t in texts])
        return 1 / (1 + np.exp(-np.clip(total, -700, 700)))


def class_counts(rows: Iterable[tuple[int, bytes]], most: int = 1 << 31) -> np.ndarray:
    """(2, buckets): how many rows of either class, ``most`` at most, hold each bucket."""
    counts = np.zeros((2, 1 << BUCKETS), np.uint16 if most < 1 << 16 else np.uint32)
    for label, text in rows:
        counts[label, present(text)] += 1
    return counts


def ratios(counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The log-count ratio of each bucket (column), drawn towards 0 by its standard errors."""
    n, rows = counts + 1.0, rows[:, None] + 2.0
    ratio = np.log(n[1] / rows[1]) - np.log(n[0] / rows[0])
    error = np.sqrt((1 / n - 1 / rows).sum(0))
    return np.sign(ratio) * np.maximum(0, np.abs(ratio) - EVIDENCE * error)


def constant(rows: np.ndarray) -> Model:
    share = (rows[1] + 0.5) / (rows.sum() + 1)
    return Model(np.zeros(1 << BUCKETS, np.float32), float(np.log(share / (1 - share))))


def fitted(bucket: np.ndarray, ratio: np.ndarray, features: list[np.ndarray], toxic: np.ndarray) -> Model:
    """The model of rows whose features are places in ``bucket``."""
    coef, intercept = _logistic(features, ratio, toxic)
    weight = np.zeros(1 << BUCKETS, np.float32)
    weight[bucket] = coef * ratio
    return Model(weight, intercept)


def _places(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each bucket is one of these, and its place among them."""
    used, place = np.zeros(1 << BUCKETS, bool), np.zeros(1 << BUCKETS, np.int32)
    used[bucket] = True
    place[bucket] = np.arange(len(bucket))
    return used, place


def train(texts: list[bytes], toxic: np.ndarray) -> Model:
    """A model of the given documents; toxic is 1 or 0 for each."""
    toxic = np.asarray(toxic, np.int64)
    rows = np.bincount(toxic, minlength=2)
    ratio = ratios(class_counts(zip(toxic, texts)), rows) if rows.all() else np.zeros(1 << BUCKETS)
    bucket = np.flatnonzero(ratio)
    if not len(bucket):
        return constant(rows)
    used, place = _places(bucket)
    return fitted(bucket, ratio[bucket], [np.sort(place[present(t, used)]) for t in texts], toxic)


def _logistic(features: list[np.ndarray], ratio: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients of the scaled features and an intercept, of least penalised loss.

    Limited-memory quasi-Newton steps (Liu and Nocedal, 1989), each within a halving search.
    """
    bounds = np.cumsum([0, *map(len, features)])
    feature = np.concatenate(features)
    blocks = [(a, min(a + 256, len(toxic))) for a in range(0, len(toxic), 256)]

    def loss(at: np.ndarray) -> tuple[float, np.ndarray]:
        value, slope, total = at[:-1] * ratio, np.zeros(len(at)), PENALTY / 2 * float(at[:-1] @ at[:-1])
        for a, b in blocks:
            own, y = feature[bounds[a] : bounds[b]], toxic[a:b]
            upto = np.r_[0, np.cumsum(value[own])]
            z = upto[bounds[a + 1 : b + 1] - bounds[a]] - upto[bounds[a:b] - bounds[a]] + at[-1]
            total += float(np.logaddexp(0, np.where(y == 1, -z, z)).sum())
            gap = 1 / (1 + np.exp(-z)) - y
            slope[:-1] += np.bincount(own, np.repeat(gap, np.diff(bounds[a : b + 1])), len(ratio))
            slope[-1] += gap.sum()
        slope[:-1] = slope[:-1] * ratio + PENALTY * at[:-1]
        return total, slope

    at = np.zeros(len(ratio) + 1)
    now, slope = loss(at)
    least = 1e-4 * np.sqrt(slope @ slope)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(200):
        if np.sqrt(slope @ slope) <= least:
            break
        way, used = -slope, []
        for s, y in reversed(held):
            used.append((s @ way) / (s @ y))
            way = way - used[-1] * y
        way = way * ((held[-1][0] @ held[-1][1]) / (held[-1][1] @ held[-1][1]) if held else 1 / np.sqrt(slope @ slope))
        for (s, y), share in zip(held, reversed(used)):
            way = way + (share - (y @ way) / (s @ y)) * s
        far = 1.0
        while (new := loss(at + far * way))[0] > now + 1e-4 * far * float(way @ slope) and far > 1e-8:
            far /= 2
        if far <= 1e-8:
            break
        step, bend = far * way, new[1] - slope
        if step @ bend > 1e-12:
            held = [*held[-7:], (step, bend)]
        at, now, slope = at + step, *new
    return at[:-1], float(at[-1])


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, y, text) of the labelled rows that the model is learned from, as a written table.

    They are chosen by ids and sizes first; texts are only read for the chosen ones.
    """
    known = labels.filter((fold(id_col) != 0) & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    size = F.octet_length(text_col)
    texts = docs.filter((size > 0) & (size <= ROW_BYTES))
    sizes = texts.groupBy(F.col(id_col).alias("id")).agg(F.max(size).alias("size"))
    first = known.join(sizes, "id").orderBy(F.xxhash64("id"), "id").limit(ROWS)
    # A window over ROWS rows at most.
    running = F.sum("size").over(Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0))
    chosen = cut(first.withColumn("upto", running).filter(F.col("upto") <= SAMPLE_BYTES).select("id", "y"), "labelled")
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    rows = rows.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    return cut(rows.repartition(_TASKS, "id"), "labelled-texts")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    known = sample(docs, labels, id_col, text_col, label_col)
    rows = np.zeros(2, np.int64)
    for y, n in known.groupBy("y").count().collect():
        rows[y] = n
    if not rows.all():
        return constant(rows)

    def count(batches):
        counts = class_counts(((y, t) for b in batches for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())), ROWS)
        bucket = np.flatnonzero(counts.any(0)).astype(np.int32)
        for at in range(0, len(bucket), 1 << 16):
            some = bucket[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(c[some].astype(np.int32)) for c in counts]], ["bucket", "clean", "toxic"])

    partial = map_arrow(known.select("y", "text"), count, "bucket int, clean int, toxic int")
    found = partial.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    bucket = found.column("bucket").to_numpy()
    ratio = ratios(np.array([found.column("clean").to_numpy(), found.column("toxic").to_numpy()]), rows)
    order = np.argsort(bucket)
    order = order[ratio[order] != 0]
    bucket, ratio = bucket[order], ratio[order]
    if not len(bucket):
        return constant(rows)
    shared = docs.sparkSession.sparkContext.broadcast(bucket)

    def describe(batches):
        used, place = _places(shared.value)
        for batch in batches:
            features = [np.sort(place[present(t, used)]).astype("<i4").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(features, pa.binary())], ["id", "y", "features"])

    kind = known.schema["id"].dataType.simpleString()
    rows = map_arrow(known, describe, f"id {kind}, y int, features binary").toArrow().sort_by("id")
    drop(known)
    features = [np.frombuffer(x, "<i4") for x in rows.column("features").to_pylist()]
    return fitted(bucket, ratio, features, rows.column("y").to_numpy().astype(np.int64))


def score_texts(docs: DataFrame, model: Model, text_col: str = "text", added: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All rows and columns of ``docs`` with score and predicted (1 from a score of 0.5 on).

    A null text scores as an empty one. ``added`` gives the two columns other names; a name
    that ``docs`` has raises.
    """
    require_free(docs, added)
    kept = docs.columns
    used = np.flatnonzero(model.weight).astype(np.int32)
    shared = docs.sparkSession.sparkContext.broadcast((used, model.weight[used], model.intercept))

    def run(batches):
        used, weights, intercept = shared.value
        weight = np.zeros(1 << BUCKETS, np.float32)
        weight[used] = weights
        model = Model(weight, intercept)
        for batch in (part for whole in batches for part in slices(whole, whole.num_columns - 1)):
            scores = model.scores([x or b"" for x in batch.column(batch.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], [*kept, *added])

    rows = docs.select(*map(named, kept), named(text_col).cast("binary").alias(free(docs, "bytes")[0]))
    return map_arrow(rows, run, StructType([*docs.schema, StructField(added[0], DoubleType()), StructField(added[1], IntegerType())]))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, held_out, score, predicted) of every row; learned from the other fold's labels.

    A null id is in no fold: not held out and not learned from. Labels other than 0 and 1 are
    none; an id that has both is toxic. Repeated rows score alike; texts of any length are
    scored whole. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    model = fit(docs, labels, id_col, text_col, label_col)
    rows = docs.select(named(id_col).alias("id"), F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"), named(text_col).alias("text"))
    return score_texts(rows, model).select(F.col("id").alias(id_col), "held_out", "score", "predicted")
