"""Quality classifier: n-gram indicators scaled by naive Bayes log-count ratios, and a linear hinge-loss model.

N-grams are words and pairs of words, and runs of one to three word shapes
(letters reduced to their case, digits to 0, a word equal to the one before
to ``=``); each is hashed to one of ``BUCKETS``.  An indicator counts once per
text.  The model is fitted by dual coordinate descent on a bounded sample of
labelled rows and its margin is turned into a probability on rows kept out of
the fit.  Only texts enter a score.

A null text is scored as an empty one; both have a score (the shapes of a
text's edges are n-grams too).  Repeated rows get equal scores.  With labels
of one class or none the score is the smoothed share of label 1.  Long texts
are scored whole.  Extra columns never reach the worker, or pass through
``keep_good`` unchanged; an empty table gives no rows.  Of several labels of a
document the least counts; a score of exactly the limit is kept.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, no_nulls, pieces, to_arrow, training_labels, trim_memory

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
#: At most so many labelled rows are fitted, those with the smallest hash of doc_id.
MAX_ROWS = 6_000
#: Rows in so many are kept out of the fit, for the probability.
CALIBRATE = 5
COST, EPOCHS, SMOOTHING = 1.0, 30, 1.0
#: Words whose hashes a worker remembers at a time.
MEMORY = 400_000
GOOD = 0.3

FOLDS = "crc32(coalesce(CAST(doc_id AS STRING), '')) % 5"
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
SAME, FIRST, LAST = (np.uint64(xxhash.xxh64_intdigest(x)) for x in ("=", "^", "$"))


def shape(word: str) -> str:
    """Case and digit pattern: runs of capitals, small letters and digits become A, a and 0."""
    out = []
    for c in word:
        k = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        if not out or out[-1] != k or k not in "0Aa":
            out.append(k)
    return "".join(out).replace("Aa", "a")[:12]  # a capital first letter says nothing


class Hashes:
    """Words' and shapes' 64-bit hashes, remembered up to a bound."""

    def __init__(self) -> None:
        self.known: dict[bytes, tuple[int, int]] = {}

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = (xxhash.xxh64_intdigest(w), xxhash.xxh64_intdigest("s" + shape(w.decode())))
        both = np.array([known[w] for w in words], np.uint64).reshape(len(words), 2)
        return both[:, 0], both[:, 1]


def features(text: str, hashes: Hashes) -> np.ndarray:
    """The text's distinct n-gram buckets, ascending."""
    word, form = hashes.of(text.encode().split())
    form = form.copy()
    form[1:][word[1:] == word[:-1]] = SAME
    form = np.concatenate([[FIRST], form, [LAST]]).astype(np.uint64)
    with np.errstate(over="ignore"):
        grams = [word, word[:-1] * ODD[0] + word[1:] * ODD[1], form,
                 form[:-1] * ODD[1] + form[1:] * ODD[2], form[:-2] * ODD[0] + form[1:-1] * ODD[1] + form[2:] * ODD[2]]
        mixed = np.concatenate([(g ^ (g >> np.uint64(29))) * ODD[n % 3] for n, g in enumerate(grams)])
    return np.unique((mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))


class Model(NamedTuple):
    weight: np.ndarray  # by bucket: fitted weight times log-count ratio
    square: np.ndarray  # by bucket: the ratio squared, for a text's length
    bias: float
    slope: float
    shift: float

    def margin(self, buckets: np.ndarray) -> float:
        return float(self.weight[buckets].sum() / max(np.sqrt(self.square[buckets].sum()), 1e-9) + self.bias)

    def score(self, buckets: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(buckets) + self.shift, -30, 30))))


def ratios(texts: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """Naive Bayes log-count ratios of the buckets' indicators."""
    p = np.full(BUCKETS, SMOOTHING)
    q = np.full(BUCKETS, SMOOTHING)
    for x, y in zip(texts, good):
        (p if y else q)[x] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def descend(texts: list[np.ndarray], good: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss on unit-length rows of ratio-scaled indicators."""
    y = np.where(good, 1.0, -1.0)
    cost = COST * np.where(good, 0.5 / max(good.mean(), 1e-9), 0.5 / max(1 - good.mean(), 1e-9))
    rows = [r[x] / max(np.sqrt((r[x] ** 2).sum()), 1e-9) for x in texts]
    w, b, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(11)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(y)):
            gradient = y[i] * (w[texts[i]] @ rows[i] + b) - 1
            new = min(max(alpha[i] - gradient / (rows[i] @ rows[i] + 1), 0.0), cost[i])
            if step := (new - alpha[i]) * y[i]:
                w[texts[i]] += step * rows[i]
                b += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, b


def calibrated(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of the margins, by Newton steps with smoothed targets."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack([margins, np.ones(len(margins))])
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), x.T @ (target - p) - 1e-3 * beta)
        beta = beta + np.clip(step, -5, 5)
        if abs(step).max() < 1e-6:
            break
    return max(float(beta[0]), 1e-3), float(beta[1])


def fit(texts: list[np.ndarray], good: np.ndarray) -> Model:
    if not good.any() or good.all():
        share = (good.sum() + 1) / (len(good) + 2)
        return Model(np.zeros(BUCKETS), np.ones(BUCKETS), 0.0, 1.0, float(np.log(share / (1 - share))))
    kept_out = np.arange(len(good)) % CALIBRATE == 0
    seen = [x for x, out in zip(texts, kept_out) if not out]
    use = good[~kept_out]
    if use.all() or not use.any():
        kept_out, seen, use = np.zeros(len(good), bool), texts, good
    r = ratios(seen, use)
    w, b = descend(seen, use, r)
    model = Model(w * r, r ** 2, b, 1.0, 0.0)
    check = kept_out if kept_out.any() and 0 < good[kept_out].sum() < kept_out.sum() else ~kept_out
    margins = np.array([model.margin(x) for x, c in zip(texts, check) if c])
    slope, shift = calibrated(margins, good[check])
    return model._replace(slope=slope, shift=shift)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most ``max_rows`` labelled rows outside the held-out fold.

    Only the sample's bucket numbers reach the driver.
    """
    rows_in = docs.select("doc_id", "text").join(F.broadcast(training_labels(labels, max_rows)), "doc_id")

    def rows(doc_id, quality, text, hashes=Hashes()):
        yield doc_id, quality, features(no_nulls(text), hashes).tobytes()

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = map_rows(rows_in, ["doc_id", "quality", "text"], f"doc_id {kind}, quality int, buckets binary", rows)
    got = got.groupBy("doc_id", "quality").agg(F.min("buckets").alias("buckets")).collect()  # one row a doc_id
    got.sort(key=lambda x: xxhash.xxh64_intdigest(str(x.doc_id)))
    return fit([np.frombuffer(x.buckets, np.int32) for x in got], np.array([x.quality == 1 for x in got], bool))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row; the model has a fixed size and is broadcast once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(doc_id, text, hashes=Hashes()):
        yield doc_id, shared.value.score(features(no_nulls(text), hashes))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs, ["doc_id", "text"], f"doc_id {kind}, score double", rows)


def keep_good(docs: DataFrame, model: Model, least: float = GOOD) -> DataFrame:
    """``docs`` without the rows that score below ``least``; all columns pass through, nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, schema = docs.columns.index("text"), to_arrow(docs.schema)

    def run(batches):
        hashes = Hashes()
        for batch in batches:
            keep = [shared.value.score(features(no_nulls(t), hashes)) >= least for t in pieces(batch.column(at))]
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(keep, pa.bool_())).columns, schema=schema)
        hashes.known.clear()
        trim_memory()  # the worker lives on for the next stage

    return docs.mapInArrow(run, docs.schema)
