"""Scale bars, boxes and tiled images against plain Python over whole pages."""

import random
from collections import deque

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from mensura.operators import circles, docks, lineage, points, scalebars, search, spatial, tiles

PAGES, STROKES, WORDS = "page int, width double, height double", "page int, kind string, x0 double, y0 double, x1 double, y1 double", "page int, seq int, x double, y double, text string"


def bars(spark, pages, strokes, words):
    rows = scalebars.scale_bars(spark.createDataFrame(pages, PAGES), spark.createDataFrame(strokes, STROKES), spark.createDataFrame(words, WORDS)).collect()
    return {r["page"]: r for r in rows}


def test_scale_bars_of_known_sheets(spark):
    pages = [(i, 1400.0, 2200.0) for i in range(12)]
    strokes = [
        (0, "line", 100.0, 150.0, 600.0, 150.0), (0, "rect", 200.0, 1000.0, 1200.0, 1800.0),
        (1, "line", 100.0, 80.0, 383.44, 80.0),
        *((2, "rect", 50.0 + 28 * i, 70.0, 78.0 + 28 * i, 74.0) for i in range(4)),  # blocks that touch
        (3, "line", 10.0, 100.0, 1100.0, 100.0), (3, "line", 300.0, 110.0, 400.0, 110.0),  # a border, and a bar
        (4, "line", 100.0, 100.0, 101.5, 300.0), (5, "line", 100.0, 1000.0, 600.0, 1000.0),
        (7, "line", 100.0, 150.0, 600.0, 150.0), (8, "line", 0.0, 0.0, None, 0.0), (9, "line", 0.0, 50.0, 100.0, 50.0), (9, "line", 102.0, 51.0, 200.0, 51.0),
        (10, "line", 100.0, 150.0, 300.0, 150.0), (10, "line", 100.0, 150.0, 300.0, 150.0),
    ]
    words = [
        (0, 0, 250.0, 160.0, "0"), (0, 1, 290.0, 160.0, "50"), (0, 2, 302.0, 160.0, "m"),
        (1, 0, 125.0, 90.0, "1m"), (1, 1, 240.0, 90.0, "5m"), (1, 2, 375.0, 90.0, "10m"),
        (2, 0, 160.0, 80.0, "25m"), (3, 0, 405.0, 112.0, "20m"), (4, 0, 110.0, 290.0, "10 Metres"),
        (5, 0, 300.0, 160.0, "50m"), (6, 0, 1.0, 1.0, "note"), (7, 0, 300.0, 160.0, "m"), (8, 0, 1.0, 1.0, "5m"), (9, 0, 199.0, 60.0, "40m"),
        (10, 0, 200.0, 160.0, "20m"), (10, 0, 200.0, 160.0, "20m"), (11, 0, None, 1.0, "5m"), (99, 0, 1.0, 1.0, "5m"),
    ]
    got = bars(spark, pages, strokes, words)
    assert sorted(got) == list(range(12))
    assert got[0]["scale"] == 0.1 and got[0]["bar_m"] == 50
    assert got[1]["bar_m"] == 10 and abs(got[1]["scale"] - 10 / 283.44) < 1e-9
    assert got[2]["bar_pt"] == 112.0 and got[2]["scale"] == 25 / 112
    assert got[3]["bar_pt"] == 100.0
    assert got[4]["axis"] == "v" and got[4]["bar_pt"] == 200.0 and got[4]["bar_m"] == 10
    assert got[9]["bar_pt"] == 200.0 and got[10]["scale"] == 0.1
    for page, reason in ((5, scalebars.NO_LABEL), (6, scalebars.NO_LABEL), (7, scalebars.NO_BAR), (8, scalebars.NO_LABEL), (11, scalebars.NO_LABEL)):
        assert got[page]["scale"] is None and got[page]["reason"] == reason
    assert bars(spark, [], [], []) == {}


def test_strokes_and_labels_are_worked_out_once(spark):
    strokes, words = ([(p, *r) for p in range(5) for r in rows] for rows in ([("line", 10.0, y, 110.0, y) for y in (5.0, 39.0, 99.5, 100.5, 300.0)], [(i, 20.0, y, f"{i + 1}m") for i, y in enumerate((40.0, 160.0, 240.0))]))
    read = {"strokes": spark.sparkContext.accumulator(0), "words": spark.sparkContext.accumulator(0)}

    def counted(rows, name):
        n = read[name]

        def run(batches):
            for b in batches:
                n.add(len(b))
                yield b

        return rows.mapInPandas(run, rows.schema)

    pages = spark.createDataFrame([(p, 1000.0, 1000.0) for p in range(5)], PAGES)
    rows = scalebars.scale_bars(pages, counted(spark.createDataFrame(strokes, STROKES), "strokes"), counted(spark.createDataFrame(words, WORDS), "words")).collect()
    # the last label is exactly as far from a stroke as is no longer near
    assert {(r.bar_m, r.bar_pt, r.axis) for r in rows} == {(2, 100.0, "h")} and len(rows) == 5
    assert read["strokes"].value == len(strokes) and read["words"].value <= 3 * len(words)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(500, 400), (400, 450), (7, 7)]
    nodes = spark.createDataFrame([(i,) for i in range(600)], "node long")
    got = {r["node"]: r["component"] for r in lineage.components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 if i <= 60 else i for i in range(600)} | {400: 400, 450: 400, 500: 400}
    assert got == want


def random_boxes(seed, n):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x, y, w, h = r.randint(-50, 50), r.randint(-50, 50), r.choice([1, 3, 8, 40, 90]), r.choice([1, 3, 8, 40, 90])
        rows.append((i % 3, i, x, y, x + w + r.randint(0, 3), y + h + r.randint(0, 3)))
    rows += [(0, 1000 + i, *rows[0][2:]) for i in range(20)] + [(1, 2000, 5, 5, 5, 9), (1, 2001, 5, 5, 2, 9), (None, 2002, 0, 0, 9, 9), (1, 2003, None, 0, 9, 9)]
    return rows


def sound(b):
    return None not in b and b[4] > b[2] and b[5] > b[3]


def both(a, b):
    return max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))


def size(b):
    return (b[4] - b[2]) * (b[5] - b[3])


BOXES = "group int, id int, x0 int, y0 int, x1 int, y1 int"


@pytest.mark.parametrize("seed,base,least", [(0, 1.0, None), (2, 0.3, 0.4), (4, 1000.0, 0.05)])
def test_overlaps_are_those_of_all_pairs(spark, seed, base, least):
    rows = random_boxes(seed, 120)
    live = [b for b in rows if sound(b)]
    want = set()
    for i, a in enumerate(live):
        for b in live[i + 1 :]:
            s = both(a, b)
            if a[0] == b[0] and s > 0 and s >= (least or 0) * (size(a) + size(b) - s):
                want.add((a[0], *sorted((a[1], b[1])), s, size(a) + size(b) - s))
    got = [(r["group"], *sorted((r["a"], r["b"])), int(r["shared"]), int(r["united"])) for r in spatial.overlaps(spark.createDataFrame(rows, BOXES).repartition(3), least, base).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_pairs_that_overlap_take_few_bytes(spark, tmp_path):
    """Pairs of boxes that nearly all meet lie in runs, so that files hold them in a few bytes each."""
    r = random.Random(5)
    rows = [(0, i, x := r.randint(-300, 300), y := r.randint(-300, 300), x + s + r.randint(0, 99), y + s + r.randint(0, 99)) for i in range(1500) for s in [r.choice([900, 300, 900])]]
    spatial.overlaps(spark.createDataFrame(rows, BOXES), base=8.0).select("a", "b", "shared", "united").write.parquet(f"{tmp_path}/pairs")
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "pairs").glob("*.parquet")]
    groups = [(m.row_group(g), c) for m in files for g in range(m.num_row_groups) for c in range(4)]
    n = sum(m.num_rows for m in files)
    live = np.array([b[2:] for b in rows])
    w, h = (np.minimum(live[:, k + 2, None], live[None, :, k + 2]) - np.maximum(live[:, k, None], live[None, :, k]) for k in (0, 1))
    assert n == (((w > 0) & (h > 0)).sum() - len(rows)) // 2
    assert sum(g.column(c).total_compressed_size for g, c in groups if c < 2) < 1.0 * n


@pytest.mark.parametrize("seed,least,most", [(0, 0.5, 100_000), (2, 0.1, 3)])
def test_kept_boxes_are_the_greedy_ones(spark, monkeypatch, seed, least, most):
    monkeypatch.setattr(spatial, "COMPONENT", most)
    rows = random_boxes(seed, 120)
    kept = []
    for b in sorted((b for b in rows if sound(b)), key=lambda b: (b[0], -size(b), b[1])):
        if all(k[0] != b[0] or both(k, b) < least * (size(k) + size(b) - both(k, b)) for k in kept):
            kept.append(b)
    order = [F.desc((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))]
    got = spatial.without_overlapping(spark.createDataFrame(rows, BOXES).repartition(3), order, least).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(kept + [b for b in rows if not sound(b)], key=repr)


def test_a_chain_of_conflicts_is_decided_in_order(spark, monkeypatch):
    monkeypatch.setattr(spatial, "COMPONENT", 0)
    chain = spark.createDataFrame([(i, i + 1) for i in range(14)], "better long, worse long")
    assert {r["place"]: r["kept"] for r in spatial.greedy_kept(chain).collect()} == {i: i % 2 == 0 for i in range(15)}


def images(seed=0):
    r = np.random.default_rng(seed)
    out = []
    for page, (h, w, share) in enumerate([(23, 31, 0.55), (40, 17, 0.3), (9, 9, 0.9), (30, 30, 0.0), (33, 50, 0.62)]):
        out.append((page, r.random((h, w)) < share))
    ring = np.zeros((40, 40), bool)
    ring[4:36, 4:36] = True
    ring[8:30, 8:30] = False
    ring[12:20, 12:20] = True  # an island in a void
    ring[14:16, 14:15] = False
    ring[32:33, 20:22] = False
    return [*out, (5, ring)]


def frame(spark, pages, side):
    rows = [(p, *m.shape, bytearray(tiles.pack(m))) for p, m in pages]
    return tiles.tiled(spark.createDataFrame(rows, "page int, h int, w int, mask binary"), side)


def whole(rows, pages, side, key=lambda p: p):
    out = {p: np.zeros(m.shape, bool) for p, m in pages}
    for r in rows:
        m, (y, x) = tiles.unpack(r["mask"], side, side), (r["ty"] * side, r["tx"] * side)
        h, w = out[key(r["page"])].shape
        assert not m[max(0, h - y) :].any() and not m[:, max(0, w - x) :].any()
        out[key(r["page"])][y : y + side, x : x + side] |= m[: h - y, : w - x]
    return out


def plain_window(mask, low, high, all_):
    h, w = mask.shape
    out = np.zeros((h, w), bool)
    for y in range(h):
        for x in range(w):
            at = [(y + a, x + b) for a in range(low, high + 1) for b in range(low, high + 1)]
            values = [0 <= p < h and 0 <= q < w and mask[p, q] for p, q in at]
            out[y, x] = all(values) if all_ else any(values)
    return out


def plain_dilated(mask, n):
    return plain_window(mask, -(n - 1 - n // 2), n // 2, False)


def plain_eroded(mask, n):
    return plain_window(mask, -(n // 2), n - 1 - n // 2, True)


def flood(mask):
    """Pixels of each 4-connected component, by its first pixel in reading order."""
    seen, found = np.zeros(mask.shape, bool), {}
    for y, x in zip(*np.nonzero(mask)):
        if seen[y, x]:
            continue
        seen[y, x], queue, cells = True, deque([(y, x)]), []
        while queue:
            p, q = queue.popleft()
            cells.append((p, q))
            for a, b in ((p - 1, q), (p + 1, q), (p, q - 1), (p, q + 1)):
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not seen[a, b]:
                    seen[a, b] = True
                    queue.append((a, b))
        found[int(y * mask.shape[1] + x)] = cells
    return found


@pytest.mark.parametrize("side,size", [(8, 3), (4, 9), (64, 6)])
def test_morphology_is_that_of_whole_pages(spark, side, size):
    pages = images()
    rows = frame(spark, pages, side)
    got = whole(tiles.closed(rows, size, side).collect(), pages, side)
    opened = whole(tiles.opened(rows, size, side).collect(), pages, side)
    for p, m in pages:
        assert (got[p] == plain_eroded(plain_dilated(m, size), size)).all()
        assert (opened[p] == plain_dilated(plain_eroded(m, size), size)).all()


@pytest.mark.parametrize("side", [7, 64])
def test_regions_voids_and_outlines_are_those_of_whole_pages(spark, side):
    pages = images(1)
    labels = lineage.stored(tiles.labelled(frame(spark, pages, side), side))
    pieces = tiles.pieces_with_regions(labels, side)
    regions = lineage.stored(tiles.regions_of(pieces))
    want = {}
    for p, m in pages:
        for first, cells in flood(m).items():
            ys, xs = zip(*cells)
            want[p, first] = (len(cells), min(ys), min(xs), max(ys) + 1, max(xs) + 1)
    assert {(r["page"], r["region"]): (r["pixels"], r["y0"], r["x0"], r["y1"], r["x1"]) for r in regions.collect()} == want

    large = regions.where("pixels >= 5")
    masks = lineage.stored(tiles.region_tiles(labels, pieces, large, side))
    holes, filled = tiles.voids(masks, large, 4, side)
    expected, areas = {}, {}
    for p, m in pages:
        for first, cells in flood(m).items():
            if len(cells) < 5:
                continue
            own = np.zeros(m.shape, bool)
            own[tuple(zip(*cells))] = True
            inner = [c for c in flood(~own).values() if not any(y in (0, m.shape[0] - 1) or x in (0, m.shape[1] - 1) for y, x in c)]
            expected[p, first] = sorted(len(c) for c in inner)
            areas[p, first] = (len(cells), sum(map(len, inner)), sum(len(c) for c in inner if len(c) < 4))
    got = {}
    for r in holes.collect():
        got.setdefault((r["page"]["page"], r["page"]["region"]), []).append(r["pixels"])
        assert r["filled"] == (r["pixels"] < 4)
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in expected.items() if v}
    n = {(r["page"]["page"], r["page"]["region"]): r["n"] for r in tiles._set_pixels(filled).collect()}
    assert n == {k: a + f for k, (a, _, f) in areas.items()}
    for r in tiles.outlines(filled, 12, side).collect():
        a, h, _ = areas[r["page"]["page"], r["page"]["region"]]
        assert r["area"] == a + h  # the outer border holds the region and all of its holes
        assert len(r["points"]) <= 12 or r["tolerance"] > 0
    assert tiles.labelled(frame(spark, [], side), side).count() == 0


def test_tiles_are_worked_out_once_and_by_several_tasks(spark):
    """Tiles that lie in one file are dealt to all tasks, numbers don't read them twice, and tiles that come twice are united."""
    pages, side, read = images(3), 7, spark.sparkContext.accumulator(0)
    rows = lineage.stored(frame(spark, pages, side).coalesce(1))

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    labels = lineage.stored(tiles.labelled(rows.mapInArrow(counted, rows.schema), side).coalesce(1))
    assert read.value == rows.count() == labels.count()
    assert tiles._pieces(labels, side).select(F.spark_partition_id()).distinct().count() > 1
    got = whole(tiles.closed(rows.unionByName(rows), 3, side).collect(), pages, side)
    for p, m in pages:
        assert (got[p] == plain_eroded(plain_dilated(m, 3), 3)).all()


def test_style_and_margin(spark):
    pages = images(2) + [(6, np.pad(np.ones((20, 20), bool), 5)), (7, np.eye(30, dtype=bool))]
    rows, side = frame(spark, pages, 6), 6
    table = spark.createDataFrame([(p, *m.shape) for p, m in pages], "page int, h int, w int")
    got = {r["page"]: (r["solid"], r["style"]) for r in tiles.solid_share(rows, table, side).collect()}
    for p, m in pages:
        share = tiles.cross_eroded(tiles.cross_eroded(m)).mean()
        assert got[p] == (pytest.approx(share), "colour-coded" if share > 0.03 else "line/hatch")
    inner = whole(tiles.without_margin(rows, 0.1, side).collect(), pages, side)
    for p, m in pages:
        my, mx = max(1, round(m.shape[0] * 0.1)), max(1, round(m.shape[1] * 0.1))
        assert (inner[p][my:-my, mx:-mx] == m[my:-my, mx:-mx]).all() and inner[p].sum() == m[my:-my, mx:-mx].sum()


def test_retained_regions(spark):
    rows = [(0, 5, 900), (0, 9, 900), (0, 1, 60_000), (0, 2, 14), (0, 3, 13), (1, 4, 100), (1, 7, 50), (2, 1, 70_000)]
    got = {(r["page"], r["region"]): (r["chosen"], r["plausible"]) for r in tiles.retained(spark.createDataFrame(rows, "page int, region int, pixels int"), 1.0).collect()}
    assert got == {(0, 5): (True, True), (0, 9): (False, True), (0, 2): (False, False), (1, 4): (True, False), (2, 1): (True, False)}


def test_simplified_stays_within_its_tolerance():
    r = np.random.default_rng(3)
    angle = np.linspace(0, 2 * np.pi, 900, endpoint=False)
    points = np.round(np.stack([np.cos(angle), np.sin(angle)], 1) * (300 + r.integers(-6, 7, (900, 1)))).astype(int)
    for most in (400, 60, 8):
        kept, tolerance = tiles.simplified(points, most)
        assert len(kept) <= most or tolerance >= 0.049 * np.abs(np.roll(points, -1, 0) - points).sum()
        ring = np.vstack([kept, kept[:1]]).astype(float)
        for p in points:
            d = ring[1:] - ring[:-1]
            t = np.clip(((p - ring[:-1]) * d).sum(1) / np.maximum((d * d).sum(1), 1e-9), 0, 1)
            assert np.sqrt((((p - ring[:-1]) - t[:, None] * d) ** 2).sum(1)).min() <= tolerance + 1e-6


SEGMENTS = "page int, seq int, orientation string, a0 double, a1 double, p0 double, p1 double, grey boolean, tones array<int>"


def dock(page, seq, x=100.0, doors=12, wall=True, edge=True, far_wall=False):
    """Doors of 3.1 m every 3 m, a wall at one end and the yard's edge beyond it, at 0.1 m a point."""
    rows = [(page, seq + i, "H", x, x + 31, 200.0 + 30 * i, 200.0 + 30 * i, True, [230]) for i in range(doors)]
    rows += [(page, seq + 50, "V", 195.0, 535.0, x - 1, x - 1, False, None)] if wall else []
    rows += [(page, seq + 51, "V", 190.0, 545.0, x - 5, x - 5, True, [213, 90])] if edge else []
    rows += [(page, seq + 52, "V", 195.0, 535.0, x + 31, x + 31, False, [0])] if far_wall else []
    return rows


def test_dock_zones(spark):
    rows = [*dock(0, 0), *dock(1, 0, doors=7), *dock(2, 0, wall=False), *dock(3, 0, edge=False), *dock(4, 0, far_wall=True), *dock(5, 0), *dock(5, 100, x=900.0), *dock(6, 0), *dock(6, 0)]
    rows += [(7, 0, "H", None, 1.0, 1.0, 1.0, True, None), (0, 90, "V", None, None, None, None, None, None), (99, 0, "H", 0.0, 31.0, 0.0, 0.0, True, [214])]
    pages = [(i, 0.1, 214.0) for i in range(9)] + [(9, 0.0, 214.0), (10, None, 214.0)]
    got = {r["page"]: r for r in docks.dock_zones(spark.createDataFrame(rows, SEGMENTS), spark.createDataFrame(pages, "page int, k double, target double")).collect()}
    assert sorted(got) == list(range(11))
    # the edge is 0.5 m out, so the dock is 3.1 m and twice that deep; on page 2 it's the only wall as well
    for page in (0, 2, 6):
        assert (got[page]["dock_depth_m"], got[page]["loading_face_lm"], got[page]["doors"], got[page]["reason"]) == (4.1, 35.5, 12, None)
        assert got[page]["area_m2"] == 145.6 or got[page]["area_m2"] == 145.5
        assert (got[page]["x0"], got[page]["x1"], got[page]["y0"], got[page]["y1"]) == (95.0, 136.0, 190.0, 545.0)
    assert got[5]["reason"] == "2 competing dock-door families" and got[5]["area_m2"] is None
    assert all(got[p]["reason"] == docks.NO_FAMILY for p in (1, 3, 4, 7, 8, 9, 10))
    assert [got[p]["evidence_seen"] for p in (0, 1, 2, 3, 4, 7)] == [True, False, True, True, True, False]


def plain_runs(points, k, walls):
    """Length, ends and members of the one wall along an outline, or the reason, by comparing all with all."""
    def off(p):
        best = 1e9
        for a, b in zip(points, points[1:] + points[:1]):
            d = np.subtract(b, a)
            u = np.clip(np.dot(np.subtract(p, a), d) / max(np.dot(d, d), 1e-12), 0, 1)
            best = min(best, float(np.hypot(*(np.subtract(p, a) - u * d))) * k)
        return best

    found = []
    for seq, x0, y0, x1, y1, grey in walls:
        dx, dy = abs(x1 - x0), abs(y1 - y0)
        if min(dx, dy) > 0.05 or max(dx, dy) <= 0.05 or max(dx, dy) * k < 20:
            continue
        flat = dx > dy
        fixed, a0, a1 = ((y0 + y1) / 2, *sorted((x0, x1))) if flat else ((x0 + x1) / 2, *sorted((y0, y1)))
        samples = [a0 + (a1 - a0) * i / 8 for i in range(9)]
        if max(off((s, fixed) if flat else (fixed, s)) for s in samples) <= 1.0:
            found.append((-(a1 - a0) * k, seq, flat, fixed, a0, a1, grey))
    clusters = []
    for c in sorted(found):
        for g in clusters:
            r = g[0]
            cover = max(0.0, min(c[5], r[5]) - max(c[4], r[4])) / min(c[5] - c[4], r[5] - r[4])
            if c[2] == r[2] and cover >= 0.9 and abs(c[3] - r[3]) * k <= 1.0:
                g.append(c)
                break
        else:
            clusters.append([c])
    good = sorted((g for g in clusters if len(g) > 1 or any(c[6] for c in g)), key=lambda g: g[0])
    if not found:
        return docks.NO_WALL
    if not good:
        return docks.UNSUPPORTED
    if len(good) > 1 and good[1][0][0] <= 0.95 * good[0][0][0]:
        return docks.RIVALS
    return round(-good[0][0][0], 2), len(good[0])


def test_yard_edge_runs_are_those_of_comparing_all(spark):
    r = random.Random(8)
    outlines, walls, want = [], [], {}
    for page in range(24):
        w, h, k = r.choice([400, 650, 900]), r.choice([300, 520]), r.choice([0.05, 0.1])
        points = [(0.0, 0.0), (w + 0.0, 0.0), (w + 0.0, h + 0.0), (w * 0.6, h + 0.0), (w * 0.4, h * 0.7)]
        outlines.append((page, k, points))
        mine = []
        for seq in range(r.choice([3, 8, 20])):
            x, n = r.choice([0, 4, 30]) + r.random() * 20, r.choice([100, 300, w * 0.9, h * 0.9])
            across = r.choice([0.0, h + 0.0, 5.0, -8.0, 12.0, 60.0])
            line = (x, across, x + n, across) if r.random() < 0.6 else (r.choice([w + 3.0, -6.0, w / 2]), x, r.choice([0.0, 0.01]) + 0.0, x + n)
            line = line if line[1] == line[3] else (line[0], line[1], line[0], line[3])
            mine.append((seq, *(round(float(v), 1) for v in line), r.random() < 0.3))
        walls += [(page, *m) for m in mine]
        want[page] = plain_runs(points, k, mine)
    outlines += [(50, 0.0, [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0)]), (51, 0.1, [(0.0, 0.0)]), (52, 0.1, None)]
    want |= {50: docks.NO_SCALE, 51: docks.NO_SCALE, 52: docks.NO_SCALE}
    rows = docks.yard_edge_runs(
        spark.createDataFrame(outlines, "page int, k double, points array<struct<x:double,y:double>>"),
        spark.createDataFrame(walls, "page int, seq int, x0 double, y0 double, x1 double, y1 double, grey boolean"),
    ).collect()
    got = {x["page"]: x["reason"] or (x["length_lm"], x["n_members"]) for x in rows}
    assert {k: v if isinstance(v, str) else (pytest.approx(v[0], abs=0.011), v[1]) for k, v in want.items()} == got
    assert sum(not isinstance(v, str) for v in want.values()) >= 3 and len({v for v in want.values() if isinstance(v, str)}) >= 3


@pytest.mark.parametrize("side", [32])
def test_planted_circles_are_found_and_lines_are_none(spark, side):
    y, x = np.mgrid[0:120, 0:150]
    ring = lambda cx, cy, r: abs(np.hypot(x - cx, y - cy) - r - 4) <= 4
    disc = lambda cx, cy, r: np.hypot(x - cx, y - cy) <= r
    pages = [(0, disc(30, 40, 7) | disc(90, 60, 10) | ring(60, 95, 9)), (1, ((x % 23 < 2) & (y > 9)) | (y % 31 < 2)), (2, np.zeros((120, 150), bool)), (3, disc(140, 8, 8))]
    found = circles.circles(circles.borders(frame(spark, pages, side), side), 6, 11).collect()
    got = {}
    for r in found:
        got.setdefault(r["page"], []).append((r["x"], r["y"], r["radius"]))
    near = lambda a, b: np.hypot(a[0] - b[0], a[1] - b[1]) <= 2.5 and abs(a[2] - b[2]) <= 2
    for page, want in ((0, [(30.5, 40.5, 7), (90.5, 60.5, 10), (60.5, 95.5, 9)]), (3, [(140.5, 8.5, 8)])):
        assert len(got[page]) == len(want) and all(any(near(w, g) for g in got[page]) for w in want), got
    assert 1 not in got and 2 not in got
    assert circles.radii(10.0) == (2, 9) and circles.radii(0.1) == (1, 2)


def test_points_of_odd_places(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, 0.0, 0.0), (0, 2, 0.0, 0.0), (0, 3, 1000.0, 0.0), (0, 4, -1.0, 0.0), (1, 5, 3.0, 3.0), (0, 6, nan, 1.0), (0, 7, inf, 1.0), (0, 8, None, 1.0), (None, 9, 0.0, 0.0)]
    table = spark.createDataFrame(rows, "group int, id int, x double, y double")
    got = {r["id"]: (r["neighbour"], r["d2"]) for r in points.nearest_neighbours(table, 0.5).collect()}
    assert got == {1: (2, 0.0), 2: (1, 0.0), 3: (1, 1e6), 4: (1, 1.0), 5: (None, None)}
    groups = {r["id"]: (r["dense"], r["cluster"]) for r in points.density_groups(table, 1.0, 2).collect()}
    assert groups == {1: (True, 1), 2: (True, 1), 3: (False, None), 4: (True, 1), 5: (False, None)}
    assert points.nearest_neighbours(table.limit(0), 1.0).count() == 0


def test_files_that_speak_for_a_drawing(spark):
    targets = spark.createDataFrame([("/a/own.pdf", "/a", "P 1"), ("/a/free.pdf", "/a", None)], "target string, folder string, project string")
    names = ["P_1_slab-specification.pdf", "P_11_slab-specification.pdf", "P_1_Joint_Layout.PDF", "P_1_elevation.pdf", "typical detail.pdf", "P_1_typical detail.dwg"]
    files = [(f"/a/{n}", "/a", n, None) for n in names] + [("/z/typical detail.pdf", "/z", "typical detail.pdf", "P 1"), (f"/b/{names[0]}", "/b", names[0], None)]
    got = sorted((r["target"], r["path"], r["stage"]) for r in search.candidates(targets, spark.createDataFrame(files, "path string, folder string, name string, project string")).collect())
    own = "/a/own.pdf"
    assert [g for g in got if g[0] == own] == sorted([(own, own, 0), (own, f"/a/{names[0]}", 1), (own, f"/a/{names[2]}", 1), (own, "/z/typical detail.pdf", 2)])
    assert sorted(p for t, p, s in got if t == "/a/free.pdf" and s == 1) == sorted(f"/a/{names[i]}" for i in (0, 1, 2, 4))

@pytest.mark.parametrize("block", [24, 256])
def test_circles_are_those_of_one_greedy_pass_at_any_block(spark, monkeypatch, block):
    monkeypatch.setattr(circles, "AROUND", 1 if block == 24 else 2)
    r = np.random.default_rng(5)
    rows = []
    for page in range(2):
        for cx, cy in r.integers(-5, 90, (14, 2)):
            for angle in np.linspace(0, 2 * np.pi, 40, endpoint=False):
                rows.append((page, float(cx + 0.5 + 7 * np.cos(angle)), float(cy + 0.5 + 7 * np.sin(angle)), float(np.cos(angle)), float(np.sin(angle))))
    edges = spark.createDataFrame(rows, "page int, x double, y double, nx double, ny double").repartition(3)
    votes = {}
    for page, x, y, nx, ny in rows:
        for radius in (6, 7, 8):
            for way in (-1, 1):
                at = (page, int(np.floor(x + way * radius * nx)), int(np.floor(y + way * radius * ny)), radius)
                for a in (-1, 0, 1):
                    for b in (-1, 0, 1):
                        k = (at[0], at[1] + a, at[2] + b, radius)
                        votes[k] = votes.get(k, 0) + 1
    best = {}
    for (page, x, y, radius), n in votes.items():
        if (s := n / (2 * np.pi * radius)) >= 0.3:
            best[page, x, y] = max(best.get((page, x, y), (0, 0)), (s, radius))
    kept = []
    for (page, x, y), (s, radius) in sorted(best.items(), key=lambda i: (i[0][0], -i[1][0], i[0][2], i[0][1])):
        if all(k[0] != page or np.hypot(k[1] - x, k[2] - y) >= 9.0 for k in kept):
            kept.append((page, x, y, radius))
    got = circles.circles(edges, 6, 8, 0.3, 9.0, block=block).collect()
    assert sorted((q["page"], q["x"] - 0.5, q["y"] - 0.5, q["radius"]) for q in got) == sorted(kept) and len(kept) > 20
    if block == 24:
        found = circles._decided(circles.peaks(edges, 6, 8, 0.3, block), 9.0, block)
        assert found.where(f"state = {circles.OPEN}").count() > 0  # some are decided over the whole table


def test_votes_are_not_shuffled(spark):
    """Border pixels are what moves, so few rows cross for each of them."""
    y, x = np.mgrid[0:60, 0:60]
    edges = lineage.stored(circles.borders(frame(spark, [(0, np.hypot(x - 30, y - 30) <= 9)], 32), 32))
    sent = circles._in_blocks(edges, F.col("x"), F.col("y"), 13, circles.BLOCK)
    assert sent.count() == edges.count()
    assert circles.circles(edges, 6, 10).count() == 1


def test_copies_of_a_wall_are_compared_once(spark, monkeypatch):
    """Lines drawn again and again count as members, but bring no pairs of walls."""
    walls = [(0, seq, 0.0, y, 390.0, y, False) for seq, y in enumerate([2.0, 3.0] * 200)]
    found, kept = [], docks.greedy_kept
    monkeypatch.setattr(docks, "greedy_kept", lambda pairs: found.append(pairs.count()) or kept(pairs))
    outline = spark.createDataFrame([(0, 0.1, [(0.0, 0.0), (400.0, 0.0), (400.0, 300.0)])], "page int, k double, points array<struct<x:double,y:double>>")
    (row,) = docks.yard_edge_runs(outline, spark.createDataFrame(walls, "page int, seq int, x0 double, y0 double, x1 double, y1 double, grey boolean")).collect()
    assert (row["length_lm"], row["n_members"], row["y0"]) == (39.0, 400, 2.0) and found == [1]


def test_targets_of_a_class_are_searched_together(spark, monkeypatch):
    r = random.Random(4)
    names = ["P_1_slab-specification.pdf", "P_2_joint layout.pdf", "typical detail.pdf", "plan.pdf"]
    files = [(f"/{f}/{n}", f"/{f}", n, p) for f in "ab" for n in names for p in ["P 1" if r.random() < 0.4 else None]]
    targets = [(f"/t/{i}", r.choice(["/a", "/b", None]), r.choice(["P 1", "P 2", "", None])) for i in range(60)]
    targets += [(files[0][0], "/a", "P 1"), (files[2][0], "/a", None), (files[1][0], "/b", "P 2"), ("/t/1", "/b", "P 2"), ("/t/1", "/a", None), (None, "/a", None)]
    said = [(p, f, v, c) for p in [x[0] for x in files + targets] for f, v, c in [("mesh", r.choice(["A252", "A252", None]), r.random() < 0.05), ("depth", r.choice(["150", "200"]), None)] if r.random() < 0.6]
    targets = spark.createDataFrame(targets, "target string, folder string, project string")
    files = spark.createDataFrame(files, "path string, folder string, name string, project string")
    found = spark.createDataFrame(said, "path string, field string, value string, conflict boolean")
    key = lambda rows: sorted((tuple(x) for x in rows.collect()), key=repr)
    want = key(search.resolved(search.candidates(targets, files), found))
    asked, plain = [], search.candidates
    monkeypatch.setattr(search, "candidates", lambda t, f: asked.append(t.count()) or plain(t, f))
    assert key(search.searched(targets, files, found)) == want and len(want) > 60
    assert asked[0] < 20  # classes, not targets


@pytest.mark.parametrize("crowd,peels", [(5, 40), (12, 2)])
def test_crowded_boxes_are_decided_in_rounds_without_their_pairs(spark, monkeypatch, crowd, peels):
    monkeypatch.setattr(spatial, "CROWD", crowd)
    monkeypatch.setattr(spatial, "PEELS", peels)
    listed, plain = [], spatial.overlaps
    monkeypatch.setattr(spatial, "overlaps", lambda boxes, *a: listed.append(boxes.count()) or plain(boxes, *a))
    rows = [b for b in random_boxes(7, 90)] + [(5, 5000 + i, i % 4, i % 3, 200 + i % 5, 300 + i) for i in range(60)]
    kept = []
    for b in sorted((b for b in rows if sound(b)), key=lambda b: (b[0], -size(b), b[1])):
        if all(k[0] != b[0] or both(k, b) < 0.5 * (size(k) + size(b) - both(k, b)) for k in kept):
            kept.append(b)
    got = spatial.without_overlapping(spark.createDataFrame(rows, BOXES).repartition(3), [F.desc((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))], 0.5).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(kept + [b for b in rows if not sound(b)], key=repr)
    assert listed[0] < sum(map(sound, rows)) - 50  # the crowd never meets pair by pair


def test_no_table_that_grows_with_pages_is_broadcast(spark, monkeypatch):
    """Files of a few bytes may hold many rows, so it isn't left to their size what goes through the driver."""
    plan = lambda rows: rows._jdf.queryExecution().executedPlan().toString()
    edges = lineage.stored(spark.createDataFrame([(0, 0.1, 0.0, 0.0, 400.0, 0.0)], "page int, k double, ex0 double, ey0 double, ex1 double, ey1 double"))
    walls = lineage.stored(spark.createDataFrame([(0, 0, 0.1, 0.0, 2.0, 390.0, 2.0)], "page int, wall long, k double, x0 double, y0 double, x1 double, y1 double"))
    near = docks._near_edge(walls, edges)
    assert "Broadcast" not in plan(near) and [(r["wall"], round(r["worst"], 3)) for r in near.collect()] == [(0, 0.2)]
    many = lineage.small(edges, lineage.BROADCAST_ROWS + 1)
    assert "Broadcast" not in plan(walls.join(many, "page")) and "Broadcast" in plan(walls.join(lineage.small(edges), "page"))
    monkeypatch.setattr(lineage, "BROADCAST_ROWS", 0)
    outline = lineage.stored(spark.createDataFrame([(0, 0.1, [(0.0, 0.0), (400.0, 0.0), (400.0, 300.0)])], "page int, k double, points array<struct<x:double,y:double>>"))
    lines = [(0, 1, 0.0, 2.0, 390.0, 2.0, False), (0, 2, 0.0, 3.0, 380.0, 3.0, False)]
    runs = docks.yard_edge_runs(outline, lineage.stored(spark.createDataFrame(lines, "page int, seq int, x0 double, y0 double, x1 double, y1 double, grey boolean")))
    assert "Broadcast" not in plan(runs) and [(r["length_lm"], r["n_members"]) for r in runs.collect()] == [(39.0, 2)]
