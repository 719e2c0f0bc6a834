"""ROC and isotonic regression against one-machine versions."""

import numpy as np
import pytest

from ratewise.operators import calibration


def rows(seed, n, levels):
    rng = np.random.default_rng(seed)
    p = rng.integers(0, levels, n) / levels
    y = (rng.random(n) < p ** 2).astype(int)
    return [(k, float(a), int(b)) for k, a, b in zip(rng.choice(["x", "y"], n, p=[0.8, 0.2]).tolist(), p, y)]


@pytest.fixture(scope="module", params=[(1, 400, 37), (2, 900, 100_000)])
def data(request):
    # one class only, a single row, missing scores and labels, repeated rows
    return rows(*request.param) + [("one", 0.5, 1), ("one", 0.7, 1), ("lone", 0.1, 0), ("x", None, 1), ("x", 0.3, None)] + [("same", 0.25, i % 2) for i in range(9)]


def frame(spark, data):
    return spark.createDataFrame(data, "k string, p double, y int").repartition(3)


def known(data):
    out = {}
    for k, p, y in data:
        if p is not None and y is not None:
            out.setdefault(k, []).append((round(p, 6), y))
    return out


@pytest.mark.parametrize("ranges", [1, 7])
def test_roc(spark, data, ranges):
    got = {r.k: r for r in calibration.roc(frame(spark, data), "k", "p", "y", ranges=ranges).collect()}
    want = known(data)
    assert set(got) == set(want)
    for k, pairs in want.items():
        pos, neg = [p for p, y in pairs if y], [p for p, y in pairs if not y]
        r = got[k]
        assert (r.n_pos, r.n_neg) == (len(pos), len(neg))
        if pos and neg:
            a, b = np.array(pos)[:, None], np.array(neg)[None, :]
            assert abs(r.auc - ((a > b) + 0.5 * (a == b)).mean()) < 1e-12
        else:
            assert r.auc is None
        best = max((sum(p >= t for p in pos) * len(neg) - sum(p >= t for p in neg) * len(pos), t) for t, _ in pairs)
        assert (r.threshold, r.tp, r.fp) == (best[1], sum(p >= best[1] for p in pos), sum(p >= best[1] for p in neg))


def sequential(pairs):
    """Blocks (low, high, n, pos) of the isotonic fit, one group at a time."""
    blocks = []
    for p in sorted({p for p, _ in pairs}):
        ys = [y for q, y in pairs if q == p]
        blocks.append([p, p, len(ys), sum(ys)])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            low, _, n, pos = blocks.pop(-2)
            blocks[-1] = [low, blocks[-1][1], n + blocks[-1][2], pos + blocks[-1][3]]
    return blocks


@pytest.mark.parametrize("ranges, fan", [(1, 8), (9, 2), (16, 8)])
def test_isotonic_equals_the_sequential_fit(spark, data, ranges, fan):
    got = {}
    for r in calibration.isotonic(frame(spark, data), "k", "p", "y", ranges=ranges, fan=fan).collect():
        got.setdefault(r.k, []).append([r.low, r.high, r.n, r.pos])
    assert {k: sorted(v) for k, v in got.items()} == {k: sequential(v) for k, v in known(data).items()}


def test_calibrated_scores(spark, data):
    df = frame(spark, data)
    blocks = calibration.isotonic(df, "k", "p", "y")
    fit = {k: sequential(v) for k, v in known(data).items()}
    for r in calibration.calibrated(df, blocks, "k", "p").collect():
        if r.p is None:
            assert r.calibrated is None
        else:
            block = [b for b in fit[r.k] if b[0] <= round(r.p, 6)] or fit[r.k][:1]
            assert abs(r.calibrated - block[-1][3] / block[-1][2]) < 1e-12
    for r in calibration.errors(calibration.tie_groups(df, "k", "p", "y"), blocks, "k").collect():
        assert r.brier_calibrated <= r.brier + 1e-9


def test_nothing(spark):
    df = frame(spark, [("x", None, None)])
    assert calibration.roc(df, "k", "p", "y").collect() == [] and calibration.isotonic(df, "k", "p", "y").collect() == []
