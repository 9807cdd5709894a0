"""The pairwise ranker's fit without a table of pairs."""

import numpy as np

from tickloom.operators import models

COLS = "ts long, v double, a double, b double"


def test_gradient_vanishes_over_all_pairs(frame):
    r = np.random.default_rng(5)
    rows = [(t, float(r.integers(0, 6)), float(r.normal()), float(r.normal() * 100)) for t in range(6) for _ in range(1 + 60 * t)]
    rows += [(1, None, 1.0, 1.0), (1, 2.0, float("nan"), 1.0), (1, 2.0, None, 1.0), (None, 1.0, 1.0, 1.0), (None, 2.0, -9.0, 9.0)]
    w = models.fit_panel_ranker(frame(rows, COLS), "v", ["a", "b"], reg=0.05)
    sound = [x for x in rows if x[0] is not None and None not in x and not np.isnan(x[2])]
    e = np.array([(x[2] - y[2], x[3] - y[3]) for x in sound for y in sound if x[0] == y[0] and x[1] > y[1]])
    scale = np.sqrt((e ** 2).mean(0))
    c = np.array([w["a"], w["b"]])
    g = -((e / scale) * (1 / (1 + np.exp(e @ c)))[:, None]).mean(0) + 0.05 * c * scale
    assert np.abs(g).max() < 1e-8


def test_no_pairs_give_zero_weights(frame):
    assert models.fit_panel_ranker(frame([(1, 1.0, 2.0, 3.0), (2, 1.0, 5.0, 3.0), (3, 4.0, 1.0, 1.0), (3, 4.0, 2.0, 2.0)], COLS), "v", ["a", "b"]) == {"a": 0.0, "b": 0.0}
    assert models.fit_panel_ranker(frame([], COLS), "v", ["a", "b"]) == {"a": 0.0, "b": 0.0}
