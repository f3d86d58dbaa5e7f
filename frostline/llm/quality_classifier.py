"""Quality classifier: support vectors on n-gram indicators scaled by naive Bayes (Wang and Manning, 2012)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frostline.llm.columns import arrow_rows, given, quoted
from frostline.llm.packing import text_chunks
from frostline.llm.shingles import mixed, word_hashes, word_lists

BITS = 18
FIT_ROWS = 6000
COST, EPOCHS, SMOOTHING = 1.0, 12, 1.0
_SIZE = 1 << BITS


class QualityModel(NamedTuple):
    """Log-count ratios and weights of the hashed n-grams, and the map from margin to probability."""

    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float


def gram_lists(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct hashed n-grams of each text, as numbers below 2^BITS.

    They are its words, its word pairs, its byte triples, and the shapes of neighbouring equal words: a pair, three or
    four alike. A-Z are lower-cased; words are runs without ASCII white space.
    """
    lower = pc.ascii_lower(texts.cast(pa.large_string()))
    coded, bounds = word_lists(texts)
    word = word_hashes(coded)[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.uint64)
    top = np.uint64(64 - BITS)
    with np.errstate(over="ignore"):
        ones = (mixed(word) >> top).astype(np.int32)
        pair = mixed(word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:])
        same = word[:-1] == word[1:]
        alike = same.astype(np.int64)
        if len(same) > 1:
            alike[1:] += same[1:] & same[:-1]
        if len(same) > 2:
            alike[2:] += same[2:] & same[1:-1] & same[:-2]
        pair[same] = mixed(alike[same].astype(np.uint64))
        pairs = (pair >> top).astype(np.int32)
        edges = np.frombuffer(lower.buffers()[1], np.int64)[lower.offset:lower.offset + len(lower) + 1]
        raw = np.frombuffer(lower.buffers()[2] or b"", np.uint8)[edges[0]:edges[-1]].astype(np.uint32)
        triple = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:] if len(raw) > 2 else raw[:0]
        triples = ((triple * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32)
    edges = edges - edges[0]
    last = np.empty(_SIZE, np.int32)
    for i in range(len(texts)):
        a, b, c, d = int(bounds[i]), int(bounds[i + 1]), int(edges[i]), int(edges[i + 1])
        found = np.concatenate([ones[a:b], pairs[a:max(b - 1, a)], triples[c:max(d - 2, c)]])
        order = np.arange(len(found), dtype=np.int32)
        last[found] = order
        yield found[last[found] == order]


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    sides = []
    for side in (1, 0):
        count = np.full(_SIZE, smoothing)
        for row, label in zip(rows, labels):
            if label == side:
                count[row] += 1
        sides.append(count / count.sum())
    return np.log(sides[0]) - np.log(sides[1])


def fit_hinge(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float = COST,
              epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear hinge-loss model by dual coordinate descent (Hsieh et al., 2008).

    Rows are the ratios at a text's n-grams, scaled to length one, with a constant. Both classes weigh the same in sum.
    """
    scaled = [ratios[r] / max(float(np.sqrt((ratios[r] ** 2).sum())), 1e-12) for r in rows]
    sign = np.where(labels == 1, 1.0, -1.0)
    share = {s: max(int((sign == s).sum()), 1) for s in (1.0, -1.0)}
    bound = np.array([cost * len(rows) / (2 * share[s]) for s in sign])
    square = np.array([float((v * v).sum()) + 1.0 for v in scaled])
    weights, bias, alpha = np.zeros(_SIZE), 0.0, np.zeros(len(rows))
    random = np.random.default_rng(7)
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            slope = sign[i] * (weights[rows[i]] @ scaled[i] + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), bound[i])
            if new != alpha[i]:
                change = (new - alpha[i]) * sign[i]
                weights[rows[i]] += change * scaled[i]
                bias += change
                alpha[i] = new
    return weights, bias


def margin(row: np.ndarray, ratios: np.ndarray, weights: np.ndarray, bias: float) -> float:
    r = ratios[row]
    return float(weights[row] @ r / max(np.sqrt(r @ r), 1e-12) + bias)


def _sigmoid_fit(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability by Newton steps on the logistic loss, with softened targets (Platt, 1999)."""
    good, bad = (labels == 1).sum(), (labels != 1).sum()
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.column_stack([margins, np.ones(len(margins))])
    beta = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        beta = beta - np.linalg.solve(curve, x.T @ (p - target) + 1e-4 * beta)
    return float(beta[0]), float(beta[1])


def fit_quality(rows: list[np.ndarray], labels: np.ndarray) -> QualityModel:
    """Fit on all rows; the probability is fitted on margins that each half gets from the other half's model."""
    if not len(rows) or len(set(labels.tolist())) < 2:
        always = 0.5 if not len(rows) else float(labels[0])
        return QualityModel(np.zeros(_SIZE), np.zeros(_SIZE), 0.0, 0.0, float(np.log((always + .01) / (1.01 - always))))
    half, margins = np.arange(len(rows)) % 2, np.zeros(len(rows))
    for side in (0, 1):
        there = [i for i in range(len(rows)) if half[i] == side]
        ratios = log_count_ratios([rows[i] for i in there], labels[there])
        weights, bias = fit_hinge([rows[i] for i in there], labels[there], ratios)
        for i in np.flatnonzero(half != side):
            margins[i] = margin(rows[i], ratios, weights, bias)
    ratios = log_count_ratios(rows, labels)
    weights, bias = fit_hinge(rows, labels, ratios)
    return QualityModel(ratios, weights, bias, *_sigmoid_fit(margins, labels))


def train_quality(events: DataFrame, marks: DataFrame, event_id: str = "event_id", description: str = "description",
                  mark: str = "useful", fit_rows: int = FIT_ROWS) -> QualityModel:
    """Fit on the descriptions of marked events.

    ``marks`` holds event_id and a mark of 1 or 0; other values and null ids are ignored. At most ``fit_rows`` marks are
    used, the first by a hash of the id, so the sample does not depend on the order or number of rows; it is small by
    that bound, and only its rows' n-grams reach the driver. Of repeated ids the smallest text is taken, of repeated
    marks the mean, rounded up. Without marks every score is 0.5, with marks of one kind near that kind.
    """
    key = F.col(quoted(event_id)).cast("long")
    labels = marks.select(key.alias("id"), F.col(quoted(mark)).cast("int").alias("label")).where("label in (0, 1)").where(
        "id is not null").groupBy("id").agg(F.round(F.avg("label")).cast("int").alias("label"))
    labels = labels.orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    # The bound on the sample makes the broadcast safe; texts are read once and not shuffled.
    texts = events.select(key.alias("id"), given(description).alias("text")).join(F.broadcast(labels), "id")
    texts = texts.groupBy("id", "label").agg(F.min("text").alias("text")).select("id", "label", "text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_chunks(whole, "text", 4 << 20):
                lists = [np.sort(g).tobytes() for g in gram_lists(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(lists, pa.binary())],
                                                 ["id", "label", "grams"])

    table = texts.mapInArrow(grams, "id long, label int, grams binary").toArrow().sort_by("id")
    rows = [np.frombuffer(g, np.int32) for g in table.column("grams").to_pylist()]
    return fit_quality(rows, table.column("label").to_numpy())


def score_quality(events: DataFrame, model: QualityModel, event_id: str = "event_id",
                  description: str = "description") -> DataFrame:
    """Add ``quality_score``, the probability (0 to 1) that a description would be marked 1, to all rows.

    Whole texts are scored, each in its task; null counts as empty; an empty text has the score of its bias. A given
    column of the name is replaced, all others stay; an empty table gives an empty result.
    """
    shared = events.sparkSession.sparkContext.broadcast(model)

    def score(columns: list[pa.Array]) -> pa.Array:
        m = shared.value
        gain, square = m.weights * m.ratios, m.ratios ** 2
        margins = np.array([gain[g].sum() / max(np.sqrt(square[g].sum()), 1e-12) + m.bias for g in gram_lists(columns[-1])])
        return pa.array(1 / (1 + np.exp(-np.clip(m.slope * margins + m.shift, -500, 500))), pa.float64())

    return arrow_rows(events, {"text": given(description)}, T.StructField("quality_score", T.DoubleType()), score)
