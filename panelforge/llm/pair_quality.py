"""Quality scores learned from preference pairs (Bradley-Terry).

A text has a strength w·x; the chance that a good text beats a bad one is the logistic of
the difference. Weights minimise that loss over all pairs of labelled texts, and a quantile of
the strengths becomes the threshold, which scores map to ``CUT``.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, discard, map_batches, stage
from .quality_rules import base_counts, grams
from .text_arrays import Texts, slices

BUCKETS = 224  # hashed trigram shares among the features
PAIRS = 40_000  # what all pairs of a good and a bad text weigh together, at most
TASKS = 24  # that add up sums over the labelled rows
ROUNDS = 30  # Newton steps, at most; about eight are needed
CUT = 0.7
CELL, NODES = 2.0, 16  # width of cells of strengths, points of polynomials in each
_POINTS = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
_WEIGHTS = np.cos(np.arange(NODES)[:, None] * np.arccos(_POINTS)) * (2 / NODES)
_WEIGHTS[0] /= 2
_KIND = np.zeros(256, np.int64)  # 1 upper case, 2 digit, 3 sign, 4 full stop or comma, 5 beyond ASCII
_KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 5
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
_KIND[[44, 46]] = 4


def features(t: Texts) -> np.ndarray:
    """One row per text; empty texts have finite features too."""
    c = base_counts(t)
    n, chars = np.maximum(c["n_words"], 1), np.maximum(t.count(t.inside), 1)
    text = np.repeat(np.arange(t.n), c["n_words"])
    h = t.word_hashes
    order = np.lexsort((h, text))
    new = np.ones(len(h), bool)
    if len(h):
        new[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
    distinct = np.bincount(text[order][new], minlength=t.n)
    lines = np.maximum(t.count(t.raw == 0x0A) + 1, 1)
    kind = _KIND[t.raw]
    dense = [
        np.log1p(c["n_words"]), np.log1p(c["n_words"]) ** 2 / 10, c["n_words"] == 0, c["n_words"] < 5,
        c["n_symbols"] / n, c["n_symbols"] > 0, np.sqrt(c["n_symbols"] / n), c["n_dup_lines"] / lines, np.sqrt(c["n_dup_lines"] / lines),
        c["n_repeat_words"] / n, np.sqrt(c["n_repeat_words"] / n), distinct / n, distinct / np.sqrt(n), c["word_chars"] / n / 10,
        *(t.count(kind == k) / chars for k in (1, 2, 3, 4, 5)), np.sqrt(t.count(kind == 1) / chars), np.sqrt(t.count(kind == 3) / chars), lines / n,
    ]
    use = t.inside
    slot = np.repeat(np.arange(t.n), np.diff(t.bounds))[use] * BUCKETS + grams(t)[use] % BUCKETS
    shares = np.bincount(slot, minlength=t.n * BUCKETS).reshape(t.n, BUCKETS) / chars[:, None]
    return np.column_stack([*dense, np.sqrt(shares)])


class PairModel:
    def __init__(self, mean, weights, threshold):
        self.mean, self.weights, self.threshold = mean, weights, threshold

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.weights - self.threshold + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _add(a, b):
    return a + b


def _append(a, b):
    return np.concatenate([a, b])


def _merge(into: dict, new: dict, how) -> dict:
    for key, value in new.items():
        into[key] = how(into[key], value) if key in into else value
    return into


def _cells(s: np.ndarray) -> np.ndarray:
    return np.floor(s / CELL).astype(np.int64)


def _nodes(cell: int) -> np.ndarray:
    return (cell + 0.5 + _POINTS / 2) * CELL


def _basis(s: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Values at ``s`` of the polynomials that are 1 at one node of the cell and 0 at the others."""
    t = np.clip((s / CELL - cell) * 2 - 1, -1, 1)
    return np.cos(np.arange(NODES) * np.arccos(t)[:, None]) @ _WEIGHTS


def _parts(s: np.ndarray, good: np.ndarray):
    """Rows of one label whose strengths lie in one cell: label, cell, rows, basis."""
    cell = _cells(s)
    order = np.lexsort((cell, good))
    new = np.flatnonzero(np.r_[True, (np.diff(cell[order]) != 0) | (good[order][1:] != good[order][:-1])]) if len(s) else []
    for rows in np.split(order, new[1:]) if len(s) else []:
        yield bool(good[rows[0]]), int(cell[rows[0]]), rows, _basis(s[rows], cell[rows])


def _better(t: np.ndarray) -> np.ndarray:
    """The chance that a text wins which is stronger by ``t``."""
    return 1 / (1 + np.exp(-np.clip(t, -700, 700)))


def _sums(moments: dict, at: np.ndarray, label: bool, kernel) -> np.ndarray:
    """``kernel`` (strength of the good text less that of the bad one) between ``at``, of this label, and all rows of the other."""
    others = [(cell, m) for (other, cell), m in moments.items() if other != label]
    far = np.concatenate([_nodes(cell) for cell, _ in others])
    t = at[:, None] - far
    return kernel(t if label else -t) @ np.concatenate([m for _, m in others])


def _learn(total, *, pairs: int, ridge: float) -> PairModel:
    """``learn`` on rows of which only sums are known: ``total(fn, how)`` merges what ``fn(x, good)`` gives for blocks of rows.

    A sum over all pairs is one over strengths: the logistic function of a difference is a polynomial of both strengths
    wherever these lie in a cell each, to eleven digits. So a row meets the other label's moments in each cell, not its rows.
    """
    first = total(lambda x, good: {"n": np.array([len(x), good.sum()]), "x": x.sum(0)}, _add)
    if not first:
        return PairModel(np.zeros(1), np.zeros(1), 0.0)
    n, n_good = first["n"].tolist()
    mean = first["x"] / n
    spread = np.sqrt(total(lambda x, good: {"x": ((x - mean) ** 2).sum(0)}, _add)["x"] / n) + 1e-6
    w = np.zeros(len(mean))
    n_pairs = n_good * (n - n_good)
    if not n_pairs:
        return PairModel(mean, w, 0.0)
    weight = min(1.0, pairs / n_pairs)

    def moments(w: np.ndarray) -> tuple[dict, float]:
        got = total(lambda x, good: {(k, c): b.sum(0) for k, c, _, b in _parts((x - mean) / spread @ w, good)}, _add)
        loss = sum(m @ _sums(got, _nodes(c), True, lambda t: np.logaddexp(0, -t)) for (k, c), m in got.items() if k)
        return got, weight * loss + ridge / 2 * (w @ w)

    def slopes(w: np.ndarray, known: dict) -> tuple[np.ndarray, np.ndarray]:
        loses = {key: _sums(known, _nodes(key[1]), key[0], lambda t: _better(-t)) for key in known}
        bends = {key: _sums(known, _nodes(key[1]), key[0], lambda t: _better(t) * _better(-t)) for key in known}

        def block(x: np.ndarray, good: np.ndarray) -> dict:
            z = (x - mean) / spread
            out, pull, bend = {}, np.zeros(len(z)), np.zeros(len(z))
            for k, c, rows, basis in _parts(z @ w, good):
                pull[rows], bend[rows] = basis @ loses[k, c] * (1 if k else -1), basis @ bends[k, c]
                out[k, c] = basis.T @ z[rows]
            return out | {"pull": pull @ z, "bend": (z * bend[:, None]).T @ z}

        got = total(block, _add)
        gradient, own = got.pop("pull"), got.pop("bend")
        across = sum(v.T @ _sums(got, _nodes(c), True, lambda t: _better(t) * _better(-t)) for (k, c), v in got.items() if k)
        return weight * gradient - ridge * w, weight * (own - across - across.T) + ridge * np.eye(len(w))

    known, loss = moments(w)
    for _ in range(ROUNDS):
        gradient, hessian = slopes(w, known)
        step = np.linalg.solve(hessian, gradient)
        while True:  # the loss is convex: a short enough step goes down
            known, now = moments(w + step)
            if now <= loss + 1e-9 * abs(loss) or np.abs(step).max() < 1e-6:
                break
            step /= 2
        w, loss = w + step, now
        if np.abs(step).max() < 1e-6:
            break
    # The threshold is a quantile of the strengths: the middle of those that part the labels best.
    got = total(lambda x, good: {"s": (x - mean) / spread @ w, "good": good}, _append)
    strength, of = np.unique(got["s"], return_inverse=True)
    gain = np.cumsum(np.bincount(of, ~got["good"])) / (n - n_good) - np.cumsum(np.bincount(of, got["good"])) / n_good
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    at = best[len(best) // 2]
    threshold = float((strength[at] + strength[min(at + 1, len(strength) - 1)]) / 2)
    return PairModel(mean, w / spread, threshold)


def learn(x: np.ndarray, good: np.ndarray, *, pairs: int = PAIRS, ridge: float = 2.0) -> PairModel:
    """Newton steps on the logistic loss of feature differences, of every good text and every bad one.

    All pairs together weigh as much against ``ridge`` as ``pairs`` of them, or as they are where there are fewer."""
    good = np.asarray(good, bool)
    return _learn(lambda fn, how: fn(x, good) if len(x) else {}, pairs=pairs, ridge=ridge)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, pairs: int = PAIRS, ridge: float = 2.0) -> PairModel:
    """Weights from all labelled rows that are not held out, and all pairs of them. Their features are written once; tasks
    add up sums of bounded size. Null ids and labels are ignored; without two kinds of labels every score is ``CUT``."""
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # one form of join at any size, as texts of all sizes are moved by it
    rows = docs.select("doc_id", "text").join(known.hint("merge"), "doc_id").select((F.col("quality") == 1).alias("good"), "text")

    def numbers(batch):
        good = column(batch, "good")
        for lo, hi, t in slices(column(batch, "text")):
            x = features(t).astype(np.float32)
            yield pa.RecordBatch.from_arrays([good.slice(lo, hi - lo), pa.array(list(x), pa.list_(pa.float32()))], names=["good", "x"])

    table = stage(map_batches(rows, numbers, "good boolean, x array<float>"), "pairs")
    few = table.coalesce(TASKS)

    def total(fn, how) -> dict:
        def run(batches):
            mine: dict = {}
            for batch in batches:
                if batch.num_rows:
                    x = column(batch, "x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
                    _merge(mine, fn(x, column(batch, "good").to_numpy(zero_copy_only=False).astype(bool)), how)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(mine)], pa.binary())], names=["sums"])

        sums: dict = {}
        for part in few.mapInArrow(run, "sums binary").collect():
            _merge(sums, pickle.loads(part["sums"]), how)
        return sums

    model = _learn(total, pairs=pairs, ridge=ridge)
    discard(table)
    if len(model.mean) == 1:  # no labelled rows
        width = features(Texts(np.zeros(0, np.uint8), np.zeros(2, np.int64))).shape[1]
        return PairModel(np.zeros(width), np.zeros(width), 0.0)
    return model


def pair_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for every document, from its whole text alone.

    Null text is an empty one and gets the score of an empty text; a null doc_id is not held out;
    repeated rows get equal scores; other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batch):
        for lo, hi, t in slices(column(batch, "text")):
            s = shared.value.score(features(t))
            own = [column(batch, c).slice(lo, hi - lo) for c in ("doc_id", "held_out")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(docs.select("doc_id", held_out().alias("held_out"), "text"), run, f"doc_id {kind}, held_out boolean, score double, predicted int")
