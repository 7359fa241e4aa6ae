"""Overlaps of polygons against lines drawn across them."""

import numpy as np
import pytest

from freshet.operators import overlay as O


def inside_lengths(a, b, y):
    """Length of the line at height y inside both sets of rings."""
    spans = []
    for shape in (a, b):
        cuts = []
        for r in shape:
            for (x1, y1), (x2, y2) in zip(r, np.roll(r, -1, axis=0)):
                if (y1 > y) != (y2 > y):
                    cuts.append(x1 + (y - y1) * (x2 - x1) / (y2 - y1))
        cuts.sort()
        spans.append(list(zip(cuts[::2], cuts[1::2])))
    return sum(max(0.0, min(p[1], q[1]) - max(p[0], q[0])) for p in spans[0] for q in spans[1])


def lines(a, b, n=3000):
    ys = np.concatenate([np.concatenate(s)[:, 1] for s in (a, b)])
    lo, hi = ys.min(), ys.max()
    return sum(inside_lengths(a, b, lo + (i + 0.5) * (hi - lo) / n) for i in range(n)) * (hi - lo) / n


def star(r, n, x, y, size, spiky=0.6):
    t = np.arange(n) * 2 * np.pi / n
    d = size * (1 - spiky * r.random(n))
    return np.stack([x + d * np.cos(t), y + d * np.sin(t)], axis=1)


def shapes(r, n, x=0.0, y=0.0, size=1.0):
    """A concave outline, a hole that may reach over it, and a second part."""
    return [star(r, n, x, y, size), star(r, n, x + 0.1, y, size * 0.35), star(r, 7, x + 2.2 * size, y, size * 0.5)]


@pytest.mark.parametrize("seed", range(8))
def test_area_against_lines(seed):
    r = np.random.default_rng(seed)
    a, b = shapes(r, 12), shapes(r, 9, *r.normal(size=2) * 0.5, size=0.8)
    want = lines(a, b)
    assert O.overlap_area(a, b) == pytest.approx(want, rel=2e-3, abs=1e-3)
    assert O.overlap_area(a, b) == pytest.approx(O.overlap_area(b, a))
    assert O.overlap_area(a, a) == pytest.approx(O.overlap_area(a))
    box = (-0.3, -0.4, 0.5, 0.2)
    square = np.array([(box[0], box[1]), (box[2], box[1]), (box[2], box[3]), (box[0], box[3])])
    assert O.overlap_area(O.clipped(a, box)) == pytest.approx(O.overlap_area(a, [square]))


def test_shared_edges_touching_and_flat_rings():
    square = lambda x, y, s=1.0: np.array([(x, y), (x + s, y), (x + s, y + s), (x, y + s)])
    assert O.overlap_area([square(0, 0)], [square(0, 0)]) == pytest.approx(1)
    assert O.overlap_area([square(0, 0)], [square(1, 0)]) == 0
    assert O.overlap_area([square(0, 0)], [square(0.5, 0)]) == pytest.approx(0.5)
    assert O.overlap_area([square(0, 0, 3), square(1, 1)], [square(1, 1)]) == 0  # in the hole
    assert O.overlap_area([np.array([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)])], [square(0, 0)]) == 0
    assert O.overlap_area([], [square(0, 0)]) == 0


def test_cover_of_a_large_polygon_is_small():
    r = np.random.default_rng(3)
    whole = [star(r, 400, 40.0, 20.0, 15.0, 0.05)]
    cells = O.cover(whole)
    assert sum(c[4] for c in cells) == pytest.approx(O.overlap_area(whole))
    smallest = 360.0 / 2 ** max(c[0] for c in cells)
    assert len(cells) < 0.1 * (30.0 / smallest) ** 2
    assert any(c[3] for c in cells) and all(sum(map(len, c[5])) <= O.CORNERS for c in cells if c[0] < max(c[0] for c in cells))


def table(spark, polygons):
    rows = [(name, 1, ring, i, float(x), float(y)) for name, rings in polygons.items() for ring, corners in enumerate(rings) for i, (x, y) in enumerate(corners)]
    return spark.createDataFrame(rows, "poly_id string, part int, ring int, seq int, lon double, lat double")


def test_tables_of_polygons(spark):
    r = np.random.default_rng(5)
    a = {f"a{i}": [star(r, 30, *r.uniform(0, 6, 2), r.uniform(0.3, 3)), star(r, 6, *r.uniform(0, 6, 2), 0.3)] for i in range(6)}
    b = {f"b{i}": [star(r, 9, *r.uniform(0, 6, 2), r.uniform(0.1, 1))] for i in range(12)}
    b["world"] = [np.array([(-170.0, -80.0), (170.0, -80.0), (170.0, 80.0), (-170.0, 80.0)])]
    a["line"] = [np.array([(0.0, 0.0), (1.0, 1.0)])]
    got = {(x.a_id, x.b_id): x.overlap_km2 for x in O.overlaps(table(spark, a), table(spark, b)).collect()}
    want = {(m, n): O.overlap_area([O.flat(x) for x in p], [O.flat(x) for x in q]) * O.KM2 for m, p in a.items() for n, q in b.items()}
    assert set(got) == {k for k, v in want.items() if v > 0}
    for k, v in got.items():
        assert v == pytest.approx(want[k], rel=1e-9)
    assert O.overlaps(table(spark, a).limit(0), table(spark, b)).count() == 0
