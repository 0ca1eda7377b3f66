"""Quality scores by a linear model on naive Bayes features.

The features of a text are indicators of its n-grams, hashed into a fixed number
of slots: words and word pairs, and runs of one to four word shapes (case, digits,
closing marks, equal to the word before), which carry over to words that training
has not seen. Each indicator is scaled by the log-count ratio of its slot between
the classes, rows are brought to unit length, and a hinge-loss linear model is
fitted by dual coordinate descent. Margins are mapped to probabilities by a
logistic curve.

Counts are sums over all labelled training rows, reduced per slot. The model is
fitted on a documented number of them in one task, chosen by a hash of the id; its
size is that of the slots, and scoring is a map over the texts with the model as
broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm import common
from docspark.operators.small import broadcast_if_small

SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
SHAPE_GRAMS = 4
# Labelled rows that the linear model is fitted on, about.
FIT_ROWS = 10_000
EPOCHS = 12
# The fit ends when no step would change a margin's slope by more.
TOLERANCE = 0.05
PENALTY = 1.0
SMOOTHING = 1.0
FOLDS = 5
THRESHOLD = 0.3
# Texts are read in pieces of at most so many bytes.
PIECE = 1 << 20
MAX_LABEL_ROWS = 1_000_000

_SPACES = [bytes([b]) for b in (32, *range(9, 14))]
_SPACE_BYTE = re.compile(rb"[ \t-\r]")
_SPACE, _LOWER, _UPPER, _DIGIT, _MARK = 0, 1, 2, 4, 8


def _byte_classes() -> np.ndarray:
    classes = np.full(256, _MARK, dtype=np.uint8)
    classes[[32, *range(9, 14)]] = _SPACE
    classes[ord("a") : ord("z") + 1] = _LOWER
    classes[128:] = _LOWER  # letters beyond ASCII
    classes[ord("A") : ord("Z") + 1] = _UPPER
    classes[ord("0") : ord("9") + 1] = _DIGIT
    return classes


_CLASSES = _byte_classes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slots(hashes: np.ndarray, kind: int) -> np.ndarray:
    salted = _mixed(hashes + np.uint64(kind * 0x9E3779B97F4A7C15 % (1 << 64)))
    return (salted >> np.uint64(64 - SLOT_BITS)).astype(np.int32)


def _mark(byte: np.ndarray) -> np.ndarray:
    return np.where(_CLASSES[byte] == _MARK, byte, 0).astype(np.uint64)


def _shape(kinds, last, before, capital, single) -> np.ndarray:
    """Bits of a word's shape; whether it repeats the word before it is added by `_Grams`."""
    shape = kinds.astype(np.uint64) | _mark(last) << np.uint64(8) | _mark(before) << np.uint64(16)
    return shape | capital.astype(np.uint64) << np.uint64(25) | single.astype(np.uint64) << np.uint64(26)


def _spelled(raw: np.ndarray, place: np.ndarray) -> np.ndarray:
    """What the bytes of words add to their hashes: each mixed with its place in the word."""
    return _mixed((raw.astype(np.uint64) << np.uint64(32)) ^ place)


def _words_of(piece: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and shapes of the words in a piece that begins and ends between words."""
    raw = np.frombuffer(piece, dtype=np.uint8)
    classes = _CLASSES[raw]
    inside = classes != _SPACE
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    place = np.arange(len(raw), dtype=np.uint64) - np.repeat(
        np.append(starts, len(raw)).astype(np.uint64), np.diff(np.append(np.append(0, starts[1:]), [len(raw), len(raw)]))
    )
    mixed = _spelled(raw, place)
    mixed[~inside] = 0
    words = _mixed(np.add.reduceat(mixed, starts))
    kinds = np.bitwise_or.reduceat(classes, starts)
    last, before = raw[ends - 1], raw[np.maximum(ends - 2, starts)]
    return words, _shape(kinds, last, before, classes[starts] == _UPPER, ends - starts == 1)


def _long_word(data: bytes, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and shape of one word that is longer than a piece, added up in parts."""
    total, kinds = np.zeros(1, np.uint64), np.zeros(1, np.uint8)
    for at in range(start, end, PIECE):
        raw = np.frombuffer(data, np.uint8, min(PIECE, end - at), at)
        total += _spelled(raw, np.arange(at - start, at - start + len(raw), dtype=np.uint64)).sum(dtype=np.uint64)
        kinds |= np.bitwise_or.reduce(_CLASSES[raw])
    one = lambda i: np.frombuffer(data, np.uint8, 1, i)
    shape = _shape(kinds, one(end - 1), one(max(end - 2, start)), _CLASSES[one(start)] == _UPPER, np.array([end - start == 1]))
    return _mixed(total), shape


def _parts(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and shapes of the words of a text, a piece at a time; no word is cut."""
    start = 0
    while start < len(data):
        limit = start + PIECE
        if limit >= len(data):
            yield _words_of(data[start:])
            return
        cut = max(data.rfind(space, start, limit) for space in _SPACES)
        if cut >= start:
            yield _words_of(data[start : cut + 1])
            start = cut + 1
        else:
            found = _SPACE_BYTE.search(data, limit)
            end = found.start() if found else len(data)
            yield _long_word(data, start, end)
            start = end


class _Grams:
    """Slots of the n-grams of words that come in parts; the last words are carried over."""

    def __init__(self):
        self.word = np.zeros(0, np.uint64)
        self.shapes = np.zeros(0, np.uint64)

    def of(self, words: np.ndarray, shapes: np.ndarray) -> Iterator[np.ndarray]:
        known = np.concatenate([self.word, words])
        repeated = np.zeros(len(words), np.uint64)
        repeated[len(words) - len(known) + 1 :] = known[1:] == known[:-1]
        shapes = np.concatenate([self.shapes, _mixed(shapes | repeated << np.uint64(24))])
        yield _slots(words, 1)
        yield _slots(_mixed(known[:-1]) + known[1:], 2)
        carried, run = len(self.shapes), shapes
        for n in range(SHAPE_GRAMS):
            # Runs that end in this part.
            yield _slots(run[max(carried - n, 0) :], 3 + n)
            run = _mixed(run[:-1]) + shapes[n + 1 :]
        self.word, self.shapes = known[-1:], shapes[1 - SHAPE_GRAMS :]


def features(text: str | None) -> np.ndarray:
    """Slots of the n-grams of a whole text, each once. The text is read in pieces, which change no n-gram."""
    data, grams, found = (text or "").encode("utf-8", "surrogatepass"), _Grams(), []
    for words, shapes in _parts(data):
        if len(words):
            found.append(np.unique(np.concatenate(list(grams.of(words, shapes)))))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int32)


@dataclass
class Model:
    """Scaled weights and squared ratios of the slots, bias, and the curve from margin to probability."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, slots: np.ndarray) -> float:
        length = float(np.sqrt(self.squares[slots].sum(dtype=np.float64)))
        return float(self.weights[slots].sum(dtype=np.float64)) / (length or 1.0) + self.bias

    def score(self, text: str | None) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(features(text)) + self.offset, -30, 30))))


def dual_coordinate_descent(
    rows: list[np.ndarray], signs: np.ndarray, scale: np.ndarray, penalty: float, epochs: int
) -> tuple[np.ndarray, float]:
    """Weights and bias of least hinge loss, on rows of `scale` at their slots brought to unit length."""
    weights, bias = np.zeros(len(scale)), 0.0
    alphas = np.zeros(len(rows))
    values = []
    for slots in rows:
        value = scale[slots]
        length = np.sqrt((value * value).sum())
        values.append(value / length if length else value)
    norms = np.array([float((v * v).sum()) for v in values]) + 1.0  # 1 for the bias
    order, active, bound = np.random.default_rng(0), np.arange(len(rows)), np.inf
    for _ in range(epochs):
        violations, staying = [0.0], []
        for n in order.permutation(active):
            slots, value, sign = rows[n], values[n], signs[n]
            gradient = sign * ((weights[slots] * value).sum() + bias) - 1.0
            if alphas[n] == 0.0 and gradient > bound:
                continue  # far on the right side: left out of further epochs
            staying.append(n)
            alpha = min(max(alphas[n] - gradient / norms[n], 0.0), penalty)
            if alpha != alphas[n]:
                violations.append(abs(gradient))
                step = (alpha - alphas[n]) * sign
                weights[slots] += step * value
                bias += step
                alphas[n] = alpha
        active, bound = np.array(staying, dtype=np.int64), max(violations)
        if bound < TOLERANCE:
            break
    return weights, bias


def calibrated(margins: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the labels, by Newton steps on smoothed targets."""
    positive, negative = labels.sum(), len(labels) - labels.sum()
    targets = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    slope, offset = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -30, 30)))
        error, weight = p - targets, p * (1 - p) + 1e-9
        gradient = np.array([(error * margins).sum() + 1e-6 * slope, error.sum()])
        hessian = np.array(
            [
                [(weight * margins * margins).sum() + 1e-6, (weight * margins).sum()],
                [(weight * margins).sum(), weight.sum() + 1e-6],
            ]
        )
        step = np.linalg.solve(hessian, gradient)
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(slope), float(offset)


def held_out(row_id: Column) -> Column:
    return F.crc32(F.coalesce(row_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _featured(rows: DataFrame) -> DataFrame:
    """`label`, `place` and the slots of `text`, for rows of these columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = pa.array([features(t.as_py()) for t in batch.column(2)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), slots], names=["label", "place", "slots"])

    return common.map_in_arrow(rows.select("label", "place", "text"), run, "label int, place long, slots array<int>")


def _ratios(rows: DataFrame) -> np.ndarray:
    """Log-count ratio of each slot over all rows; the driver gets a row per used slot."""
    slots = rows.select("label", F.explode("slots").alias("slot"))
    counts = slots.groupBy("slot").agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad")).collect()
    good, bad = np.full(SLOTS, SMOOTHING), np.full(SLOTS, SMOOTHING)
    for row in counts:
        good[row["slot"]] += row["good"]
        bad[row["slot"]] += row["bad"]
    return np.log((good / good.sum()) / (bad / bad.sum()))


def _fitted(rows: DataFrame, ratios: np.ndarray, penalty: float, epochs: int) -> Model | None:
    """Model of all `rows`, fitted in one task; None without rows of both labels."""
    scale = rows.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, places, slots = [], [], []
        for batch in batches:
            labels += batch.column(0).to_pylist()
            places += batch.column(1).to_pylist()
            slots += [np.asarray(row.values.to_numpy(), dtype=np.int32) for row in batch.column(2)]
        order = sorted(range(len(slots)), key=lambda n: (places[n], labels[n], slots[n].tobytes()))
        label = np.array([labels[n] for n in order], dtype=np.int64)
        if 0 < label.sum() < len(label):
            rows_ = [slots[n] for n in order]
            weights, bias = dual_coordinate_descent(rows_, 2.0 * label - 1.0, scale.value, penalty, epochs)
            scaled, squares = (weights * scale.value).astype(np.float32), (scale.value**2).astype(np.float32)
            model = Model(scaled, squares, bias, 1.0, 0.0)
            slope, offset = calibrated(np.array([model.margin(s) for s in rows_]), label)
            columns = [pa.array([x]) for x in (scaled.tobytes(), bias, slope, offset)]
            yield pa.RecordBatch.from_arrays(columns, names=["weights", "bias", "slope", "offset"])

    one = rows.select("label", "place", "slots").coalesce(1)
    found = common.map_in_arrow(one, run, "weights binary, bias double, slope double, offset double").first()
    if found is None:
        return None
    weights = np.frombuffer(bytes(found["weights"]), dtype=np.float32)
    return Model(weights, (ratios**2).astype(np.float32), found["bias"], found["slope"], found["offset"])


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    fit_rows: int = FIT_ROWS,
    penalty: float = PENALTY,
    epochs: int = EPOCHS,
) -> Model | float:
    """Model of the labels of all rows that are not held out.

    Where all labels are equal, or there are none, it is the score of every text:
    their mean, or 0.5.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label"))
    known = known.filter("label IS NOT NULL AND _id IS NOT NULL").filter(~held_out(F.col("_id"))).distinct()
    known = broadcast_if_small(common.stored(known), max_rows=MAX_LABEL_ROWS)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    labelled = texts.join(known, "_id").withColumn("place", F.xxhash64("_id"))
    rows = common.stored(_featured(labelled))
    total, mean = rows.agg(F.count("*"), F.avg("label")).first()
    ratios = _ratios(rows)
    share = min(1.0, fit_rows / max(total, 1))
    # Stored by many tasks, so that the one that fits reads the sample and nothing else.
    sample = common.stored(rows.filter(F.pmod("place", F.lit(1_000_000)) < int(share * 1_000_000)))
    return _fitted(sample, ratios, penalty, epochs) or (0.5 if mean is None else float(mean))


def scored(
    docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """`held_out`, `score` and `predicted` of every row of `docs`.

    Null and empty texts have no features and get the score of the bias alone. A
    null id is held out or not like an empty one. Repeated rows get equal scores.
    Other columns are not read and may have any name. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            texts = (t.as_py() for t in batch.column(1))
            scores = [fitted if isinstance(fitted, float) else fitted.score(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["_id", "score"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    made = common.map_in_arrow(rows, run, f"_id {dict(docs.dtypes)[id_col]}, score double")
    return made.select(
        F.col("_id").alias(id_col),
        held_out(F.col("_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
