"""Weights of op8 come from every pair of a good and a bad labelled text."""

import numpy as np
import pytest

from panelforge.llm import pair_quality
from panelforge.llm.text_arrays import Texts


def every_pair(x, good, pairs, ridge=2.0):
    """The same loss, minimised over a table of all pairs."""
    mean, spread = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / spread
    d = (z[good][:, None] - z[~good][None]).reshape(-1, x.shape[1])
    weight, w = min(1.0, pairs / len(d)), np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-d @ w))
        w += np.linalg.solve(weight * (d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w)), weight * d.T @ (1 - p) - ridge * w)
    return w / spread


@pytest.mark.parametrize("pairs", [100, 40_000, 10**9])
def test_every_pair_counts(pairs):
    rng = np.random.default_rng(2)
    good = rng.random(300) < 0.7
    x = rng.normal(size=(300, 6)) * np.array([1, 20, 0.1, 1, 1, 3]) + good[:, None] * np.array([1.5, 9, 0, 0, -1, 0])
    assert pair_quality.learn(x, good, pairs=pairs).weights == pytest.approx(every_pair(x, good, pairs), abs=1e-9)


def test_a_text_far_away_counts():
    # the last good row is the only one that has the feature; strengths reach over many cells
    x, good = np.zeros((400, 2)), np.arange(400) % 2 == 0
    x[:, 0], x[398, 1] = np.where(good, 0.2, 0) + np.arange(400) % 7, 1.0
    assert pair_quality.learn(x, good, pairs=50).weights[1] > 0
    assert pair_quality.learn(x, good, pairs=50).weights == pytest.approx(every_pair(x, good, 50), abs=1e-9)


def test_all_labelled_rows_are_learned_from(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["alpha", "Beta", "x9", "the", "##", "gamma."], size=int(rng.integers(3, 40)))) for _ in range(120)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int("##" not in texts[k][: 40 + k])) for k in range(110)], "doc_id long, quality int")
    used = labels.where(~pair_quality.held_out()).toPandas()
    known = [(texts[k], q) for k, q in zip(used["doc_id"], used["quality"])] + [(texts[3], q) for k, q in zip(used["doc_id"], used["quality"]) if k == 3]
    parts = [t.encode() for t, _ in known]
    bounds = np.cumsum([0, *map(len, parts)])
    x = pair_quality.features(Texts(np.frombuffer(b"".join(parts), np.uint8), bounds)).astype(np.float32).astype(float)
    want = pair_quality.learn(x, np.array([q == 1 for _, q in known]))
    got = pair_quality.fit(docs, labels)
    assert got.weights == pytest.approx(want.weights, abs=1e-7) and got.threshold == pytest.approx(want.threshold, abs=1e-6)
    assert 0 < (used["quality"] == 1).mean() < 1
