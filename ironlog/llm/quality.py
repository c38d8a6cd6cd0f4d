"""Quality classifier: an additive model of per-feature tables and pair tables, grown by cyclic boosting."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ironlog.llm.common import only, remainder
from ironlog.llm.words import text_bytes, word_hashes

FEATURES = (
    "log_bytes", "log_words", "upper", "digits", "exclamations", "bars", "symbols", "stops", "beyond_ascii",
    "lines", "word_bytes", "repeats", "distinct", "top_word", "controls",
)
#: At most so many labelled rows are learned from: those with the smallest hash of their id.
TRAIN_ROWS = 20_000

_OTHER, _UPPER, _LOWER, _DIGIT, _BANG, _BAR, _SYMBOL, _STOP, _HIGH, _SPACE, _LINE, _CONTROL = range(12)
_CLASS = np.zeros(256, np.uint8)
for _kind, _chars in (
    (_UPPER, range(65, 91)), (_LOWER, range(97, 123)), (_DIGIT, range(48, 58)), (_BANG, b"!"), (_BAR, b"|"),
    (_SYMBOL, b"#$%&*@^~<>=_+\\{}[]/"), (_STOP, b".,;:?'\"()-"), (_HIGH, range(128, 256)), (_CONTROL, range(32)),
    (_SPACE, b" \t\r\v\f"), (_LINE, b"\n"),
):
    _CLASS[list(_chars)] = _kind


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text, from the whole text; a null or empty text is a row of zeros."""
    data, edges = text_bytes(texts)
    n = len(edges) - 1
    count = np.zeros((n, 12))
    for a in range(0, len(data), 1 << 20):
        part = _CLASS[data[a : a + (1 << 20)]]
        lo, hi = np.searchsorted(edges, a, "right") - 1, np.searchsorted(edges, a + len(part), "left")
        spans = np.diff(np.clip(edges[lo : hi + 1] - a, 0, len(part)))
        owner = np.repeat(np.arange(hi - lo, dtype=np.int32), spans)
        count[lo:hi] += np.bincount(owner * 12 + part, minlength=(hi - lo) * 12).reshape(-1, 12)
    size = np.diff(edges)
    words, per = word_hashes(texts)
    distinct, top, repeats = np.zeros(n), np.zeros(n), np.zeros(n)
    at = 0
    for i, m in enumerate(per):
        if m:
            own = words[at : at + m]
            repeats[i] = (own[1:] == own[:-1]).sum()
            _, times = np.unique(own, return_counts=True)
            distinct[i], top[i] = len(times), times.max()
            at += m
    words_or_1, size_or_1 = np.maximum(per, 1), np.maximum(size, 1)
    letters = np.maximum(count[:, _UPPER] + count[:, _LOWER], 1)
    return np.column_stack(
        [
            np.log1p(size), np.log1p(per), count[:, _UPPER] / letters, count[:, _DIGIT] / size_or_1, count[:, _BANG] / words_or_1,
            count[:, _BAR] / words_or_1, count[:, _SYMBOL] / words_or_1, count[:, _STOP] / words_or_1, count[:, _HIGH] / size_or_1,
            count[:, _LINE] / words_or_1, (size - count[:, _SPACE] - count[:, _LINE]) / words_or_1, repeats / words_or_1,
            distinct / words_or_1, top / words_or_1, count[:, _CONTROL] / size_or_1,
        ]
    )


@dataclass
class AdditiveModel:
    """score = sigmoid(base + a table entry per feature + a table entry per chosen pair of features)."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edges, x[:, f], "right")]
        for (f, g), values in zip(self.pairs, self.pair_tables, strict=True):
            total += values[np.searchsorted(self.coarse[f], x[:, f], "right"), np.searchsorted(self.coarse[g], x[:, g], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between neighbouring values nearest to equal shares of the rows."""
    values = np.unique(x)
    if len(values) < 2:
        return np.zeros(0)
    middle = (values[1:] + values[:-1]) / 2
    return middle if len(middle) < bins else np.unique(middle[np.searchsorted(values[1:-1], np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))])


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def _shallow_tree(g: np.ndarray, h: np.ndarray, ridge: float, depth: int = 2) -> np.ndarray:
    """The step function of at most 2**depth leaves over ordered bins that best follows the gradients."""
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = _gain(left_g, left_h, ridge) + _gain(g.sum() - left_g, h.sum() - left_h, ridge)
        cut = int(np.argmax(gain)) + 1
        if gain[cut - 1] > _gain(g.sum(), h.sum(), ridge) + 1e-9:
            return np.concatenate([_shallow_tree(g[:cut], h[:cut], ridge, depth - 1), _shallow_tree(g[cut:], h[cut:], ridge, depth - 1)])
    return np.full(len(g), g.sum() / (h.sum() + ridge))


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of a grid in two by two parts: its gain, and the step of each cell."""
    best, steps = 0.0, np.zeros_like(g)
    whole = _gain(g.sum(), h.sum(), ridge)
    cg, ch = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0))), np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            part = []
            for c in (cg, ch):
                a, b, d = c[i, j], c[i, -1] - c[i, j], c[-1, j] - c[i, j]
                part.append(np.array([[a, b], [d, c[-1, -1] - a - b - d]]))
            gain = float(_gain(*part, ridge).sum() - whole)
            if gain > best:
                best = gain
                leaf = part[0] / (part[1] + ridge)
                steps = leaf[np.ix_((np.arange(g.shape[0]) >= i).astype(int), (np.arange(g.shape[1]) >= j).astype(int))]
    return best, steps


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, rounds: int = 150, rate: float = 0.15, pairs: int = 6, pair_rounds: int = 40, ridge: float = 5.0) -> AdditiveModel:
    """Boosts all features in turn, round after round; then the pairs whose grids explain most of what is left.

    Without rows of both labels the model is the smoothed share of label 1.
    """
    width = x.shape[1]
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    edges = [_edges(x[:, f], bins) for f in range(width)]
    coarse = [_edges(x[:, f], 8) for f in range(width)]
    model = AdditiveModel(base, edges, [np.zeros(len(e) + 1) for e in edges], coarse, [], [])
    if len(np.unique(y)) < 2:
        return model
    at = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
    total = np.full(len(y), base)
    for _ in range(rounds):
        for f in range(width):
            p = 1 / (1 + np.exp(-total))
            size = len(model.tables[f])
            step = rate * _shallow_tree(np.bincount(at[f], y - p, size), np.bincount(at[f], p * (1 - p), size), ridge)
            model.tables[f] += step
            total += step[at[f]]
    p = 1 / (1 + np.exp(-total))
    cell = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse)]

    def grids(f: int, g: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(coarse[f]) + 1, len(coarse[g]) + 1)
        key = cell[f] * shape[1] + cell[g]
        return tuple(np.bincount(key, w, shape[0] * shape[1]).reshape(shape) for w in (y - p, p * (1 - p)))

    ranked = sorted(((_quadrants(*grids(f, g), ridge)[0], -f, -g) for f, g in combinations(range(width), 2)), reverse=True)
    model.pairs = [(-f, -g) for gain, f, g in ranked[:pairs] if gain > 0]
    model.pair_tables = [np.zeros((len(coarse[f]) + 1, len(coarse[g]) + 1)) for f, g in model.pairs]
    for _ in range(pair_rounds):
        for values, (f, g) in zip(model.pair_tables, model.pairs, strict=True):
            p = 1 / (1 + np.exp(-total))
            step = rate * _quadrants(*grids(f, g), ridge)[1]
            values += step
            total += step[cell[f], cell[g]]
    return model


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 2048):
            part = batch.slice(a, 2048)
            x = text_features(part.column(2))
            flat = pa.array(x.ravel())
            at = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(at, flat)], ["doc_id", "quality", "x"])


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> AdditiveModel:
    """A model of ``labels.quality`` from at most ``train_rows`` labelled rows that are not held out.

    Held out are rows with crc32(doc_id) mod 3 = 1.  The sample is the rows with the smallest hash of their id, so it
    is the same on every run; its ids and labels are all that is broadcast, its features all that is collected.
    Labels that are null, not 0 or 1, or of unknown documents are left out; a document labelled twice counts twice.
    """
    given = only(labels, "doc_id", "quality").where("quality IN (0, 1) AND doc_id IS NOT NULL").where(remainder(F.col("doc_id"), 3) != 1)
    sample = given.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(train_rows)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = (
        only(docs, "doc_id", "text")
        .join(F.broadcast(sample), "doc_id")
        .select("doc_id", F.col("quality").cast("int").alias("quality"), "text")
        .mapInArrow(_feature_rows, f"doc_id {kind}, quality int, x array<double>")
        .toArrow()
    )
    x = np.array(rows["x"].to_pylist(), float).reshape(rows.num_rows, len(FEATURES))
    y = rows["quality"].to_numpy().astype(float)
    order = np.lexsort((y, *x.T[::-1], rows["doc_id"].to_numpy()))
    return fit(x[order], y[order])


def score_texts(docs: DataFrame, model: AdditiveModel, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``name``: 0 to 1, higher where label 1 is likelier.

    Every row is scored from its whole text; null counts as empty.
    """
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                score = pa.array(model.score(text_features(part.column(place))))
                yield pa.RecordBatch.from_arrays([*part.columns, score], [*part.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document (see ``train`` and ``score_texts``).

    Rows without doc_id are scored as well; their crc32 is that of the empty text.  Empty tables give empty results.
    """
    model = train(docs, labels, train_rows)
    light = docs.select("doc_id", "text")
    scored = score_texts(light, model).drop("text")
    return scored.select(
        "doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model does not reject, with their own columns."""
    model = train(docs, labels)
    return score_texts(docs, model, "__score").where("__score >= 0.5").drop("__score")
