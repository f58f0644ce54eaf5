"""Quality scores: n-gram indicators scaled by naive Bayes, a hinge loss fitted in the dual (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .texts import BYTE_CODES, mix, prefix_sums, slices, utf8, window_hashes, words

FEATURES = 1 << 18
SAMPLE_ROWS = 8000
BYTE_GRAMS = (1, 2, 3, 4)
COST = 1.0
SWEEPS = 20
SMOOTHING = 1.0


def indicators(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Distinct features of each row: byte n-grams, word pairs, and words that follow themselves."""
    stamp = np.zeros(FEATURES, np.int32)
    shift = np.uint64(64 - (FEATURES.bit_length() - 1))
    for lo, hi in slices(offsets):
        part, within = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        sums = prefix_sums(BYTE_CODES[part])
        grams = [(window_hashes(sums, n) >> shift).astype(np.int32) for n in BYTE_GRAMS]
        found = words(part, within)
        hashes = found.hashes()
        pair = mix(hashes[:-1] * np.uint64(3) + hashes[1:])
        pair[hashes[:-1] == hashes[1:]] = np.uint64(1) << np.uint64(63)
        pair = (pair >> shift).astype(np.int32)
        for k in range(hi - lo):
            a, b = within[k], within[k + 1]
            every = [g[a : max(a, b - n + 1)] for n, g in zip(BYTE_GRAMS, grams)]
            every.append(pair[found.first[k] : max(found.first[k], found.first[k + 1] - 1)])
            row = np.concatenate(every)
            place = np.arange(len(row), dtype=np.int32)
            stamp[row] = place
            yield row[stamp[row] == place]


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows = indicators(data, offsets)
        margin = np.array([self.weights[x].sum() / np.sqrt(max(1, len(x))) + self.bias for x in rows])
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    counts = np.full((2, FEATURES), SMOOTHING)
    for x, y in zip(rows, labels):
        counts[y, x] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def dual_descent(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Hinge loss by dual coordinate descent on ratio-scaled unit-length indicators, with a bias feature.

    Examples are weighted so that either class has the same total cost.
    """
    scaled = [ratio[x] / np.sqrt(max(1, len(x))) for x in rows]
    sign = np.where(labels == 1, 1.0, -1.0)
    share = np.bincount(labels, minlength=2) / len(labels)
    cost = COST * 0.5 / share[labels]
    square = np.array([v @ v + 1.0 for v in scaled])
    weights, bias, alpha = np.zeros(FEATURES), 0.0, np.zeros(len(rows))
    generator = np.random.default_rng(1)
    for _ in range(SWEEPS):
        most = 0.0
        for i in generator.permutation(len(rows)):
            x, v = rows[i], scaled[i]
            slack = sign[i] * (weights[x] @ v + bias) - 1
            new = min(max(alpha[i] - slack / square[i], 0.0), cost[i])
            change = (new - alpha[i]) * sign[i]
            if change:
                weights[x] += change * v
                bias += change
                alpha[i] = new
                most = max(most, abs(change))
        if most < 1e-3:
            break
    return weights * ratio, bias


def calibrate(margin: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve from margin to probability, by damped Newton steps."""
    ones = labels.sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    x, t = np.stack([margin, np.ones(len(margin))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(t @ x, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2), x @ (target - p) - 1e-3 * t)
        t = t + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(t[0]), float(t[1])


def fit_rows(rows: list[np.ndarray], labels: np.ndarray) -> QualityModel:
    """The model of a labelled sample. A fifth of it, left out of a first fit, sets the probabilities."""
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return QualityModel(np.zeros(FEATURES), 0.0, 0.0, float(np.log(share / (1 - share))))
    fold = np.arange(len(rows)) % 5 == 0
    inner = [k for k in range(len(rows)) if not fold[k]]
    outer = [k for k in range(len(rows)) if fold[k]]
    if len(set(labels[inner].tolist())) < 2:
        inner = outer = list(range(len(rows)))
    some = [rows[k] for k in inner]
    weights, bias = dual_descent(some, labels[inner], log_count_ratios(some, labels[inner]))
    margin = np.array([weights[rows[k]].sum() / np.sqrt(max(1, len(rows[k]))) + bias for k in outer])
    slope, offset = calibrate(margin, labels[outer])
    weights, bias = dual_descent(rows, labels, log_count_ratios(rows, labels))
    return QualityModel(weights, bias, slope, offset)


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> QualityModel:
    """Learn from at most ``sample_rows`` labelled documents, chosen by a hash of their id.

    The bound makes the list of ids safe to broadcast and the features small enough for one task and
    the driver. Null ids and labels are left out; an id labelled twice takes the larger label. Without
    labels every score is 0.5; with one class, that class's share within 0.001 of the end.
    """
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).dropna()
    chosen = marked.groupBy("_id").agg(F.max("_label").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")
    rows = docs.select(F.col(id_col).alias("_id"), text).join(F.broadcast(chosen), "_id")
    rows = rows.select("_id", "_label", "_text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x.tobytes() for x in indicators(*utf8(b.column(2)))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.string()), b.column(1), pa.array(found, pa.binary())], names=["_id", "_label", "x"]
            )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = [(*r,) for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        every.sort(key=lambda r: (r[0], r[2]))
        labels = np.array([int(r[1] > 0) for r in every], np.int64)
        model = fit_rows([np.frombuffer(r[2], np.int32) for r in every], labels)
        whole = np.concatenate((model.weights, [model.bias, model.slope, model.offset]))
        yield pa.RecordBatch.from_arrays([pa.array([whole.tobytes()], pa.binary())], names=["model"])

    sample = rows.mapInArrow(features, "_id string, _label int, x binary")
    found = sample.repartition(1).mapInArrow(fit, "model binary").first()
    if found is None:
        return fit_rows([], np.zeros(0, np.int64))
    whole = np.frombuffer(found["model"], np.float64)
    return QualityModel(whole[:FEATURES], *map(float, whole[FEATURES:]))


def score_quality(
    docs: DataFrame, model: QualityModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """``keep`` columns of every row with ``score``: how likely its whole text has label 1.

    Null counts as empty; empty texts get the score of a text without n-grams. Repeated rows repeat and
    null ids stay. Memory follows the longest text. Other columns are ignored, a kept ``score`` gives way.
    """
    keep = [c for c in keep if c != "score"]
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    kept = rows.schema.fields[: len(keep)]
    sql = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + "score double"
    arrow = pa.schema([*((f.name, to_arrow_type(f.dataType)) for f in kept), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = shared.value.scores(*utf8(b.column(len(keep))))
            columns = [b.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score, pa.float64())], schema=arrow)

    return rows.mapInArrow(run, sql)
