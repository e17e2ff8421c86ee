"""Hexagonal bins and the multivariate-t ellipse against plain versions; edge frames."""

import math
import random

import numpy as np
import pytest

from carrisk.operators import dist


def _plain_hexagons(points, bins):
    """Nearest centre of the lattice, by trying every centre around the point."""
    x, y = np.array(points).T
    width = [(v.max() - v.min()) / bins or 1.0 for v in (x, y)]
    origin = [math.floor(v.min() / w) * w - 1e-6 for v, w in zip((x, y), width)]
    counts = {}
    for a, b in points:
        u, v = (a - origin[0]) / width[0], (b - origin[1]) / width[1]
        r0 = round(v / (math.sqrt(3) / 2))
        centres = [(q, r) for r in range(r0 - 2, r0 + 3) for q in range(math.floor(u - r / 2) - 2, math.floor(u - r / 2) + 4)]
        best = min(centres, key=lambda c: (u - c[0] - c[1] / 2) ** 2 + (v - c[1] * math.sqrt(3) / 2) ** 2)
        counts[best] = counts.get(best, 0) + 1
    return counts


@pytest.mark.parametrize("bins", [3, 40])
def test_hexagons_are_the_nearest(spark, bins):
    rnd = random.Random(bins)
    points = [(rnd.gauss(-2, 3), rnd.expovariate(0.2)) for _ in range(1500)]
    got = dist.hex_bin2d(spark.createDataFrame(points, "a double, b double"), "a", "b", bins).collect()
    assert {(r.hq, r.hr): r.n for r in got} == _plain_hexagons(points, bins)
    x = [p[0] for p in points]
    width = (max(x) - min(x)) / bins
    start = math.floor(min(x) / width) * width - 1e-6
    assert all(abs(r.x_mid - start - (r.hq + r.hr / 2) * width) < 1e-9 for r in got)


def test_hexagon_edges(spark):
    schema = "k string, a double, b double"
    odd = spark.createDataFrame([("x", None, 1.0), ("x", float("nan"), 1.0), (None, 5.0, 2.0), (None, 5.0, 2.0), ("x", 5.0, 2.0), ("x", -1.0, 0.0)], schema)
    assert sorted((r.k or "", r.n) for r in dist.hex_bin2d(odd, "a", "b", keys=["k"], log_x=True, log_y=True).collect()) == [("", 2), ("x", 1)]
    assert dist.hex_bin2d(odd.where("false"), "a", "b").count() == 0
    assert sum(r.n for r in dist.hex_bin2d(odd, "a", "b").collect()) == 4


def _plain_t(points, nu=5.0, tol=0.01, max_iter=25):
    p = np.array(points)
    w, centre = np.ones(len(p)), p.mean(0)
    for rounds in range(1, max_iter + 1):
        d = p - centre
        cov = (w[:, None] * d).T @ d / w.sum()
        new = (nu + 2) / (nu + np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
        centre = (new[:, None] * p).sum(0) / new.sum()
        moved = np.abs(new - w).max()
        w = new
        if moved < tol:
            break
    return centre, (w[:, None] * d).T @ d / len(p), rounds


def test_t_ellipse(spark):
    rnd = random.Random(3)
    groups = {"tight": [(rnd.gauss(1, 1), rnd.gauss(5, 2)) for _ in range(400)], "small": [(rnd.random(), rnd.random()) for _ in range(5)]}
    groups["planted"] = [(x := rnd.gauss(0, 1), 0.6 * x + rnd.gauss(0, 0.5)) for _ in range(500)] + [(60 + rnd.random(), -40.0) for _ in range(25)]
    groups[None] = [(rnd.gauss(0, 3), rnd.gauss(0, 1)) for _ in range(60)]
    rows = [(k, *p) for k, ps in groups.items() for p in ps] + [("tight", None, 1.0), ("tight", 1.0, float("nan"))]
    frame = spark.createDataFrame(rows, "k string, a double, b double")
    got = {r.k: r for r in dist.t_ellipse(frame, "a", "b", ["k"]).collect()}
    assert set(got) == set(groups)
    for k, points in groups.items():
        centre, cov, rounds = _plain_t(points)
        r = got[k]
        assert (r.n, r.rounds) == (len(points), rounds)
        assert np.allclose([r.cx, r.cy], centre) and np.allclose([r.var_x, r.var_y, r.cov_xy], [cov[0, 0], cov[1, 1], cov[0, 1]])
        d = r.n - 1
        f = r.radius ** 2 / 2  # P(F(2, d) <= f) is the level
        assert abs(1 - (1 + 2 * f / d) ** (-d / 2) - 0.9) < 1e-12
    plain = dist.ellipse_params(frame.where("k = 'planted'"), "a", "b").first()
    assert abs(got["planted"].cx) < 0.3 < 2 < plain.cx  # the far rows lose their pull
    whole = dist.t_ellipse(frame.where("k = 'planted'"), "a", "b").first()
    assert np.isclose(whole.cx, got["planted"].cx) and "_all" not in whole.asDict()


def test_t_ellipse_edges(spark):
    line = [("line", float(i), 2.0 * i) for i in range(9)]
    same = [("same", 4.0, 4.0)] * 6
    few = [("few", 0.0, 1.0), ("few", 3.0, 0.0), ("few", 1.0, 1.0)]
    frame = spark.createDataFrame(line + same + few + [("one", 1.0, 2.0), ("none", None, None)], "k string, a double, b double")
    got = {r.k: r for r in dist.t_ellipse(frame, "a", "b", ["k"]).collect()}
    assert set(got) == {"line", "same", "few", "one"} and all(r.rounds == 0 for r in got.values())
    assert got["few"].radius is None and got["one"].var_x is None and got["line"].radius > 0 and got["same"].var_x == 0
    assert dist.t_ellipse(frame.where("false"), "a", "b", ["k"]).count() == 0


def test_pca_preview_variance(spark):
    from carrisk.plans import queries_eda
    from carrisk.plans.registry import QUERIES, load_all
    from tests.conftest import SF001
    load_all()
    x = np.array([r.features.toArray() for r in queries_eda.pca_preview_frame(spark, SF001).select("features").collect()])
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    got = {r.component: r.percent for r in QUERIES["pca_preview_variance"](spark, SF001).collect()}
    assert np.allclose([got["PC1"], got["PC2"]], 100 * values[:2] / values.sum(), atol=1e-5)


def test_outcome_densities(spark):
    from carrisk.plans.queries_segment import outcome_densities
    rnd = random.Random(5)
    rows = [(k, min(max(rnd.gauss(0.3, 0.1), 0.0), 1.0), rnd.lognormvariate(m, 0.5), rnd.lognormvariate(1, 1)) for k, m in (("C1", 0), ("C2", 2)) for _ in range(300)]
    rows += [("C3", 0.2, 0.0, None), ("C3", 0.4, 0.0, 0.0)]
    frame = spark.createDataFrame(rows, "cluster string, oos_rate_raw double, total_crashes_raw double, severity_weight_raw double")
    got = {}
    for r in outcome_densities(frame, "cluster").collect():
        got.setdefault((r.outcome, r.cluster), []).append((r.x, r.density))
    assert set(got) == {(o, c) for o in ("oos_rate", "total_crashes_log10", "severity_weight_log10") for c in ("C1", "C2")} | {("oos_rate", "C3")}
    crashes = np.log10([r[2] for r in rows if r[0] == "C2"])
    curve = sorted(got["total_crashes_log10", "C2"])
    assert curve[0][0] >= crashes.min() and curve[-1][0] <= crashes.max()
    quart = np.percentile(crashes, [25, 75])
    bw = 0.9 * min(crashes.std(ddof=1), (quart[1] - quart[0]) / 1.34) * len(crashes) ** -0.2
    for x, density in curve[::20]:
        assert abs(density - np.exp(-0.5 * ((x - crashes) / bw) ** 2).sum() / (len(crashes) * bw * math.sqrt(2 * math.pi))) < 2e-3
