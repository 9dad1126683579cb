"""Polygon coverage and raster components against known areas and plain search."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mensura.operators import raster, regions


def square(x, y, s, t=None):
    return [(x, y), (x + s, y), (x + s, y + (t or s)), (x, y + (t or s))]


def points(ring):
    return [{"x": float(x), "y": float(y)} for x, y in ring]


def test_known_areas(spark):
    nan = float("nan")
    cases = [
        ("voids", 0, square(0, 0, 2000, 1300), [square(100, 100, 300), square(600, 600, 300, 400)], 0.1), ("bow-tie", 0, [(0, 0), (1000, 1000), (1000, 0), (0, 1000)], [], 0.1),
        ("overlap", 0, square(0, 0, 1000), [], 0.1), ("overlap", 1, square(500, 500, 1000), [], 0.1), ("two points", 0, [(0, 0), (1, 1)], [], 0.1),
        ("hole outside", 0, square(0, 0, 1000), [square(5000, 5000, 10)], 0.1), ("not finite", 0, square(0, 0, 1000), [], 0.1), ("not finite", 1, [(nan, 0), (1, 1), (2, 0)], [], 0.1),
    ]
    schema = "case string, region_idx int, outer array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>, k double"
    rows = spark.createDataFrame([(c, i, points(o), [points(h) for h in hs], k) for c, i, o, hs, k in cases], schema)
    got = {r.case: r for r in regions.measured(rows).collect()}
    assert {c: r.area_m2 for c, r in got.items()} == {"voids": 23900.0, "bow-tie": 5000.0, "overlap": 17500.0, "two points": 0.0, "hole outside": 10000.0, "not finite": 10000.0}
    assert [c for c, r in got.items() if r.flags] and {c for c, r in got.items() if r.flags} == {"bow-tie", "overlap", "not finite"}
    with pytest.raises(Exception, match="no scale"):
        regions.measured(spark.createDataFrame([("x", 0, points(square(0, 0, 1)), [], None)], schema)).collect()


@given(st.lists(st.tuples(*[st.integers(0, 12)] * 2, *[st.integers(1, 6)] * 2), min_size=1, max_size=6))
@settings(max_examples=40, deadline=None)
def test_covered_area_of_rectangles(boxes):
    grid = np.zeros((20, 20), bool)
    for x, y, w, h in boxes:
        grid[x : x + w, y : y + h] = True
    total, own = regions.covered([(np.array(square(x, y, w, h), float), []) for x, y, w, h in boxes])
    assert total == pytest.approx(grid.sum()) and own == pytest.approx([w * h for _, _, w, h in boxes])


@given(st.integers(0, 2**30))
@settings(max_examples=40, deadline=None)
def test_components(seed):
    mask = np.random.default_rng(seed).random((9, 11)) < 0.5
    labels, seen, number = raster.label_components(mask), np.zeros_like(mask), 0
    for y, x in zip(*np.nonzero(mask)):
        if seen[y, x]:
            continue
        number += 1
        stack = [(y, x)]
        while stack:
            a, b = stack.pop()
            if 0 <= a < 9 and 0 <= b < 11 and mask[a, b] and not seen[a, b]:
                seen[a, b] = True
                assert labels[a, b] == number
                stack += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    assert labels.max() == number and (labels[~mask] == 0).all()


def test_colour_components(spark):
    image = np.zeros((8, 10, 3), np.uint8)
    image[1:4, 1:5] = (200, 100, 50)
    image[6, 9] = (201, 99, 52)
    rows = spark.createDataFrame([(7, 10, 8, bytearray(image.tobytes()))], "image_id long, width int, height int, rgb binary")
    got = raster.retained(raster.colour_components(rows, (200, 100, 50)), 0.015).orderBy("component").collect()
    assert [(r.pixels, r.x0, r.y0, r.x1, r.y1, r.chosen) for r in got] == [(12, 1, 1, 5, 4, True), (1, 9, 6, 10, 7, False)]
    assert raster.dominant_rgb(image, image.sum(axis=2) > 0) == (200, 100, 50)
