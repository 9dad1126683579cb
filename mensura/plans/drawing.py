"""Queries of the drawing operators: strokes, words, boxes and pixels shaped out of whole driver tables.

The expressions that shape them are written once and read by both engines, so each
SQL below recomputes a result from the same rows by another way.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.operators import circles, docks, points, scalebars, search, spatial, tiles
from mensura.operators.lineage import spread, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Orders are pages; each line of an order is a stroke and a word. Every other page lies on its side.
PAGE = {"page": "o_orderkey", "width": "600 + 200 * (o_orderkey % 3)", "height": "400 + 100 * (o_orderkey % 5)"}
_ALONG, _CROSS = "(30 * ((l_partkey % 5) + l_linenumber))", "(40 * (l_suppkey % 4) + (l_partkey % 4))"
_LONG = "(CASE l_linenumber % 4 WHEN 0 THEN 28 WHEN 1 THEN 31 WHEN 2 THEN 300 + l_partkey % 400 ELSE 1 END)"
_THICK = "(CASE WHEN l_suppkey % 3 = 0 THEN 4 ELSE (CASE l_partkey % 11 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END) END)"
_TURNED = "l_orderkey % 2 = 1"
STROKE = {
    "page": "l_orderkey", "kind": "CASE WHEN l_suppkey % 3 = 0 THEN 'rect' ELSE 'line' END",
    "x0": f"CASE WHEN {_TURNED} THEN {_CROSS} ELSE {_ALONG} END", "y0": f"CASE WHEN {_TURNED} THEN {_ALONG} ELSE {_CROSS} END",
    "x1": f"CASE WHEN {_TURNED} THEN {_CROSS} + {_THICK} ELSE {_ALONG} + {_LONG} END",
    "y1": f"CASE WHEN {_TURNED} THEN {_ALONG} + {_LONG} ELSE {_CROSS} + {_THICK} END",
}
_WORD_ALONG, _WORD_CROSS = f"({_ALONG} + 20 * (l_suppkey % 7) - 10)", f"({_CROSS} + 10 * (l_suppkey % 9))"
WORD = {
    "page": "l_orderkey", "seq": "l_linenumber * CAST(1000000000000 AS BIGINT) + l_partkey * 100000 + l_suppkey",
    "x": f"CASE WHEN {_TURNED} THEN {_WORD_CROSS} ELSE {_WORD_ALONG} END", "y": f"CASE WHEN {_TURNED} THEN {_WORD_ALONG} ELSE {_WORD_CROSS} END",
    "text": "CASE l_partkey % 9 WHEN 0 THEN '5m' WHEN 1 THEN '10m' WHEN 2 THEN '25 M' WHEN 3 THEN 'm' WHEN 4 THEN 'Metres' WHEN 5 THEN '20' WHEN 6 THEN '50' "
            "WHEN 7 THEN 'note' ELSE '12345m' END",
}


def _shaped(rows: DataFrame, shape: dict[str, str]) -> DataFrame:
    return rows.selectExpr(*(f"{e} AS {n}" for n, e in shape.items()))


def _columns(shape: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in shape.items())


@query(rf"""
WITH pg AS (SELECT {_columns(PAGE)} FROM orders), st AS (SELECT {_columns(STROKE)} FROM lineitem), wd AS (SELECT DISTINCT {_columns(WORD)} FROM lineitem),
ax AS (SELECT page, kind, x0, y0, x1, y1, abs(x1 - x0) AS w, abs(y1 - y0) AS h FROM st),
ar AS (SELECT *, CASE WHEN kind = 'line' AND h < 2 AND w > 1 THEN 'h' WHEN kind = 'line' AND w < 2 AND h > 1 THEN 'v'
              WHEN kind = 'rect' AND w > 0 AND h > 0 AND h >= 3 * w THEN 'v' WHEN kind = 'rect' AND w > 0 AND h > 0 AND w >= 3 * h THEN 'h' END AS axis FROM ax),
sg AS (SELECT page, axis, CASE axis WHEN 'h' THEN (y0 + y1) / 2 ELSE (x0 + x1) / 2 END AS crossing, CASE axis WHEN 'h' THEN least(x0, x1) ELSE least(y0, y1) END AS lo,
              CASE axis WHEN 'h' THEN greatest(x0, x1) ELSE greatest(y0, y1) END AS hi FROM ar JOIN pg USING (page)
       WHERE axis IS NOT NULL AND CASE axis WHEN 'h' THEN w <= CAST(0.70 AS DOUBLE) * width ELSE h <= CAST(0.70 AS DOUBLE) * height END),
lb AS (SELECT page, seq, x, y, CAST(nullif(regexp_extract(text, '^([0-9]{{1,4}})\s*(m|metres|meters)$', 1, 'i'), '') AS INTEGER) AS value, text FROM wd),
lv AS (SELECT page, seq, x, y, value, CASE WHEN value IS NULL THEN 1 ELSE 0 END AS tier FROM lb WHERE value IS NOT NULL OR lower(text) IN ('m', 'metres', 'meters')),
al AS (SELECT a.page, a.seq, count(*) AS n, max(b.value) AS top FROM lv a JOIN lv b ON a.page = b.page AND b.value IS NOT NULL AND (abs(a.x - b.x) <= 6 OR abs(a.y - b.y) <= 6) GROUP BY ALL),
lo AS (SELECT lv.*, CASE WHEN value IS NOT NULL AND n >= 2 THEN CASE WHEN value = top THEN 0 ELSE 1 END ELSE 2 END AS kind,
              CASE WHEN value IS NOT NULL AND n >= 2 THEN -value ELSE 0 END AS down FROM lv LEFT JOIN al USING (page, seq)),
near AS (SELECT lo.page, lo.seq, axis, round_even(crossing / 3, 0) AS cl, sg.lo, sg.hi, CASE axis WHEN 'h' THEN x ELSE y END AS along FROM lo JOIN sg USING (page)
         WHERE abs(crossing - CASE axis WHEN 'h' THEN y ELSE x END) < 60),
isl AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY page, seq, axis, cl ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3 THEN 0 ELSE 1 END AS fresh FROM near),
num AS (SELECT *, sum(fresh) OVER (PARTITION BY page, seq, axis, cl ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM isl),
run AS (SELECT page, seq, axis, along, min(lo) AS low, max(hi) AS high FROM num GROUP BY page, seq, axis, along, cl, island),
cand AS (SELECT page, seq, axis, high - low AS len, CASE WHEN along BETWEEN low AND high THEN 0 ELSE least(abs(high - along), abs(low - along)) END AS far FROM run),
best AS (SELECT page, seq, len, axis FROM (SELECT *, row_number() OVER (PARTITION BY page, seq ORDER BY far, len DESC, axis) AS r FROM cand) WHERE r = 1),
digits AS (SELECT a.page, a.seq, max(CAST(b.text AS INTEGER)) AS n FROM lo a JOIN wd b ON a.page = b.page AND regexp_matches(b.text, '^[0-9]{{1,4}}$') AND (abs(a.x - b.x) < 60 OR abs(a.y - b.y) < 60)
           GROUP BY ALL),
kn AS (SELECT lo.page, lo.seq, tier, kind, down, -(x + y) AS corner, coalesce(value, n) AS bar_m, len AS bar_pt, axis FROM lo LEFT JOIN best USING (page, seq) LEFT JOIN digits USING (page, seq)),
ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY tier, kind, down, corner, seq) AS r FROM kn WHERE bar_m IS NOT NULL AND bar_pt > 0) WHERE r = 1),
anyb AS (SELECT page, bool_or(bar_pt IS NOT NULL) AS near FROM kn GROUP BY page)
SELECT pg.page, bar_m / bar_pt AS scale, bar_m, CAST(bar_pt AS DOUBLE) AS bar_pt, axis,
       CASE WHEN bar_m IS NULL THEN CASE WHEN coalesce(near, false) THEN 'label found but no bar line near it' ELSE 'no scale-bar label' END END AS reason
FROM pg LEFT JOIN ch USING (page) LEFT JOIN anyb USING (page)""")
def scale_bars(spark, d):
    """The scale bar of every page, or why it has none."""
    lines = t(spark, d, "lineitem")
    return scalebars.scale_bars(_shaped(t(spark, d, "orders"), PAGE), _shaped(lines, STROKE), _shaped(lines, WORD))


# Vectors are boxes on the page of their label, of sides over two orders of magnitude.
_AT = "CAST(floor(1000 * CAST(embedding[{0}] AS DOUBLE)) AS BIGINT)"
_SIDE = "(CASE vec_id % 5 WHEN 0 THEN 5 WHEN 1 THEN 40 WHEN 2 THEN 300 ELSE 900 END + abs({0}) % 100)"


def _boxes(first: int) -> dict[str, str]:
    """Corners of a vector's box, for an engine whose arrays begin at ``first``; every seventh box is one of few that repeat."""
    at = [_AT.format(first + k) for k in range(4)]
    x0, y0 = (f"(CASE WHEN vec_id % 7 = 3 THEN 100 * (vec_id % 3) ELSE {a} END)" for a in at[:2])
    w, h = (f"(CASE WHEN vec_id % 7 = 3 THEN 500 ELSE {_SIDE.format(a)} END)" for a in at[2:])
    return {"group_": "label", "id": "vec_id", "x0": x0, "y0": y0, "x1": f"{x0} + {w}", "y1": f"{y0} + {h}"}


def _box_rows(spark, d) -> DataFrame:
    return _shaped(t(spark, d, "embeddings").where("label IS NOT NULL AND size(embedding) > 3"), _boxes(0)).withColumnRenamed("group_", "group")


_SHARED = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_UNITED = f"(a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {_SHARED}"
_BOX_ROWS = f"bx AS (SELECT {_columns(_boxes(1))} FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 3)"


@query(f"""WITH {_BOX_ROWS}
SELECT a.group_ AS page, a.id AS a, b.id AS b, CAST({_SHARED} AS BIGINT) AS shared, CAST({_UNITED} AS BIGINT) AS united
FROM bx a JOIN bx b ON a.group_ = b.group_ AND a.id < b.id WHERE {_SHARED} > 0""")
def overlapping_boxes(spark, d):
    """All pairs of boxes of a page that overlap."""
    pairs = spatial.overlaps(_box_rows(spark, d), base=8.0)
    return pairs.select(F.col("group").alias("page"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("shared").cast("long").alias("shared"), F.col("united").cast("long").alias("united"))


LEAST_IOU = 0.5


@query(f"""WITH RECURSIVE {_BOX_ROWS},
o AS (SELECT *, row_number() OVER (PARTITION BY group_ ORDER BY (x1 - x0) * (y1 - y0) DESC, id) AS r FROM bx),
k AS (SELECT group_, 0 AS r, CAST([] AS STRUCT(id BIGINT, x0 BIGINT, y0 BIGINT, x1 BIGINT, y1 BIGINT)[]) AS kept FROM bx GROUP BY group_
      UNION ALL
      SELECT k.group_, k.r + 1, CASE WHEN len(list_filter(kept, lambda a: {_SHARED.replace("b.", "o.")} >= {LEAST_IOU} * ({_UNITED.replace("b.", "o.")}))) = 0
             THEN list_append(kept, {{'id': o.id, 'x0': o.x0, 'y0': o.y0, 'x1': o.x1, 'y1': o.y1}}) ELSE kept END
      FROM k JOIN o ON o.group_ = k.group_ AND o.r = k.r + 1),
l AS (SELECT group_, arg_max(kept, r) AS kept FROM k GROUP BY group_)
SELECT page, s.id AS id, s.x0 AS x0, s.y0 AS y0, s.x1 AS x1, s.y1 AS y1 FROM (SELECT group_ AS page, unnest(kept) AS s FROM l)""")
def kept_boxes(spark, d):
    """Boxes of a page, largest first, without those that nearly cover one that is kept."""
    boxes = _box_rows(spark, d)
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return spatial.without_overlapping(boxes, [F.desc(area)], LEAST_IOU, base=8.0).withColumnRenamed("group", "page")


# A vector of 64 components is a tile of 8 x 8 pixels, 64 of them a page.
TILE_SIDE, PAGE_TILES, GAP = 8, 8, 4
_PAGE_SIDE = TILE_SIDE * PAGE_TILES


def _pixel_tiles(spark, d, above: float) -> DataFrame:
    """Tiles of which those components of a vector are set that lie above a bound."""
    rows = t(spark, d, "embeddings").where("vec_id IS NOT NULL AND size(embedding) = 64").select("vec_id", F.transform("embedding", lambda x: F.coalesce(x.cast("double") > above, F.lit(False))).alias("set"))

    def run(batches):
        for b in batches:
            bits = b.column("set").flatten().to_numpy(zero_copy_only=False).reshape(-1, 64)
            yield pa.record_batch({"vec_id": b.column("vec_id"), "mask": pa.array([tiles.pack(x) for x in bits], pa.binary())})

    packed = rows.mapInArrow(run, "vec_id long, mask binary")
    at = F.col("vec_id") % PAGE_TILES**2
    place = {"page": F.floor(F.col("vec_id") / PAGE_TILES**2), "h": F.lit(_PAGE_SIDE), "w": F.lit(_PAGE_SIDE), "ty": F.floor(at / PAGE_TILES).cast("int"), "tx": (at % PAGE_TILES).cast("int")}
    return packed.select(*(c.alias(n) for n, c in place.items()), "mask")


def _pixels_sql(above: float) -> str:
    at = f"(vec_id % {PAGE_TILES**2})"
    return f"""e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64),
p AS (SELECT vec_id // {PAGE_TILES**2} AS page, {TILE_SIDE} * ({at} // {PAGE_TILES}) + i // {TILE_SIDE} AS y, {TILE_SIDE} * ({at} % {PAGE_TILES}) + i % {TILE_SIDE} AS x,
      coalesce(CAST(v AS DOUBLE) > {above}, false) AS on_ FROM e),
g AS (SELECT page, y, x, coalesce(on_, false) AS on_ FROM (SELECT page, y, x FROM (SELECT DISTINCT page FROM p), (SELECT unnest(range({_PAGE_SIDE})) AS y), (SELECT unnest(range({_PAGE_SIDE})) AS x)) LEFT JOIN p USING (page, y, x))"""


def _windows_sql(low: int, high: int, size: int) -> tuple[str, str]:
    """Counts over a window of one axis, reached where at least ``size`` are set."""
    frame = lambda a, b: f"(PARTITION BY page, {a} ORDER BY {b} RANGE BETWEEN {-low} PRECEDING AND {high} FOLLOWING)"
    return (f"sum(CAST(on_ AS INT)) OVER {frame('x', 'y')} >= {size}", f"sum(CAST(on_ AS INT)) OVER {frame('y', 'x')} >= {size}")


_GROW, _SHRINK = _windows_sql(-(GAP - 1 - GAP // 2), GAP // 2, 1), _windows_sql(-(GAP // 2), GAP - 1 - GAP // 2, GAP)


@query(f"""
WITH {_pixels_sql(0.08)}, a AS (SELECT page, y, x, {_GROW[0]} AS on_ FROM g), b AS (SELECT page, y, x, {_GROW[1]} AS on_ FROM a),
c AS (SELECT page, y, x, {_SHRINK[0]} AS on_ FROM b), f AS (SELECT page, y, x, {_SHRINK[1]} AS on_ FROM c)
SELECT page, CAST(y // {TILE_SIDE} AS INTEGER) AS ty, CAST(x // {TILE_SIDE} AS INTEGER) AS tx, count(*) AS n_set,
       CAST(sum((y % {TILE_SIDE}) * {TILE_SIDE} + x % {TILE_SIDE} + 1) AS BIGINT) AS places FROM f WHERE on_ GROUP BY ALL""")
def closed_masks(spark, d):
    """Pages with gaps closed, tile by tile: how many pixels are set, and the sum of their places."""
    done = tiles.closed(_pixel_tiles(spark, d, 0.08), GAP, TILE_SIDE)

    def run(batches):
        for b in batches:
            set_ = [np.flatnonzero(tiles.unpack(m.as_py(), TILE_SIDE, TILE_SIDE)) for m in b.column("mask")]
            counts = {"n_set": pa.array([len(s) for s in set_], pa.int64()), "places": pa.array([int((s + 1).sum()) for s in set_], pa.int64())}
            yield pa.record_batch({**{c: b.column(c) for c in ("page", "ty", "tx")}, **counts})

    return done.select("page", "ty", "tx", "mask").mapInArrow(run, "page long, ty int, tx int, n_set long, places long")


@query(f"""
WITH {_pixels_sql(-0.12)}, s AS (SELECT page, count(*) FILTER (on_ AND ring = 13) AS n FROM (SELECT page, on_, (
  SELECT count(*) FROM g o WHERE o.page = g.page AND o.on_ AND abs(o.y - g.y) + abs(o.x - g.x) <= 2) AS ring FROM g) GROUP BY page)
SELECT page, n / {float(_PAGE_SIDE**2)} AS solid, CASE WHEN n / {float(_PAGE_SIDE**2)} > 0.03 THEN 'colour-coded' ELSE 'line/hatch' END AS style FROM s""")
def drawing_styles(spark, d):
    """Pages of filled surfaces and pages of lines, told apart by what two erosions leave."""
    pages = _pixel_tiles(spark, d, -0.12)
    return tiles.solid_share(pages, pages.select("page", "h", "w").distinct(), TILE_SIDE)


@query()
def surface_regions(spark, d):
    """Retained regions of each page with their corners, filled voids and outline."""
    labels = stored(tiles.labelled(tiles.closed(_pixel_tiles(spark, d, 0.02), 2, TILE_SIDE), TILE_SIDE), "labels")
    pieces = tiles.pieces_with_regions(labels, TILE_SIDE)
    kept = stored(tiles.retained(tiles.regions_of(pieces), 1.0), "regions")
    holes, filled = tiles.voids(stored(tiles.region_tiles(labels, pieces, kept, TILE_SIDE), "masks"), kept, 4, TILE_SIDE)
    sums = holes.groupBy(F.col("page.page").alias("page"), F.col("page.region").alias("region")).agg(
        F.count("*").alias("n_voids"), F.coalesce(F.sum(F.when(F.col("filled"), F.col("pixels"))), F.lit(0)).alias("filled_pixels"),
    )
    border = tiles.outlines(filled, 24, TILE_SIDE).select(F.col("page.page").alias("page"), F.col("page.region").alias("region"), "n_corners", F.col("area").cast("long").alias("outer_area"), F.size("points").alias("n_points"))
    met = kept.join(sums, ["page", "region"], "left").join(border, ["page", "region"], "left")
    return met.fillna(0, ["n_voids", "filled_pixels"])


# Suppliers are pages; their lines are doors, walls and edges of a dock, or noise, by the part's remainder.
_DOOR, _NEAR, _FAR, _EDGE = "l_partkey % 7 < 3", "l_partkey % 7 = 3", "l_partkey % 7 = 4", "l_partkey % 7 = 5"
SEGMENT = {
    "page": "l_suppkey", "seq": "l_orderkey * 100000000 + l_partkey * 10 + l_linenumber",
    "orientation": f"CASE WHEN {_DOOR} THEN 'V' WHEN l_partkey % 7 = 6 THEN 'V' ELSE 'H' END",
    "a0": f"CAST(CASE WHEN {_DOOR} THEN 100 WHEN {_NEAR} THEN 195 WHEN {_EDGE} THEN 190 ELSE 190 + l_partkey % 9 END AS DOUBLE)",
    "a1": f"CAST(CASE WHEN {_DOOR} THEN CASE WHEN l_suppkey % 4 = 3 THEN 141 ELSE 131 END WHEN {_NEAR} THEN 525 WHEN {_EDGE} THEN 530 + l_partkey % 3 ELSE 520 END AS DOUBLE)",
    "p0": f"CAST(CASE WHEN {_DOOR} THEN 200 + 30 * (l_linenumber + l_partkey % 5) WHEN {_NEAR} THEN 100 - l_partkey % 3 WHEN {_FAR} THEN CASE WHEN l_suppkey % 5 = 0 THEN 131 ELSE 500 END "
          f"WHEN {_EDGE} THEN CASE WHEN l_suppkey % 7 = 2 THEN 80 ELSE 95 END ELSE 900 + l_partkey % 50 END AS DOUBLE)",
    "grey": f"{_DOOR} OR {_EDGE}", "tone": f"CASE WHEN {_EDGE} AND l_suppkey % 6 = 1 THEN 100 ELSE 210 END",
}


@query(f"""
WITH sg AS (SELECT DISTINCT {_columns(SEGMENT)} FROM lineitem), s AS (SELECT *, p0 AS mid, a1 - a0 AS len FROM sg),
f AS (SELECT page, orientation, a0, a1, min(seq) AS seq, count(DISTINCT mid) AS doors, min(mid) AS f0, max(mid) AS f1 FROM s WHERE grey AND len * 0.1::DOUBLE BETWEEN 2.5 AND 3.7
      GROUP BY page, orientation, a0, a1 HAVING count(DISTINCT mid) >= 8 AND (max(mid) - min(mid)) * 0.1::DOUBLE >= 20),
e AS (SELECT f.*, (SELECT min(abs(w.mid - f.a0) * 0.1::DOUBLE) FROM s w WHERE w.page = f.page AND w.orientation <> f.orientation AND w.len / (f1 - f0) BETWEEN 0.8 AND 1.7 AND abs(w.mid - f.a0) * 0.1::DOUBLE <= 1.5) AS d0,
      (SELECT min(abs(w.mid - f.a1) * 0.1::DOUBLE) FROM s w WHERE w.page = f.page AND w.orientation <> f.orientation AND w.len / (f1 - f0) BETWEEN 0.8 AND 1.7 AND abs(w.mid - f.a1) * 0.1::DOUBLE <= 1.5) AS d1 FROM f),
n AS (SELECT *, CASE way WHEN -1 THEN a0 ELSE a1 END AS near, CASE way WHEN -1 THEN a1 ELSE a0 END AS far FROM (
      SELECT *, CASE WHEN d0 IS NULL AND d1 IS NULL THEN NULL WHEN d1 IS NULL OR d0 + 0.15::DOUBLE < d1 THEN -1 WHEN d0 IS NULL OR d1 + 0.15::DOUBLE < d0 THEN 1 END AS way FROM e) WHERE way IS NOT NULL),
g AS (SELECT * FROM (SELECT n.*, w.mid AS edge, row_number() OVER (PARTITION BY n.page, n.orientation, n.a0, n.a1 ORDER BY w.len DESC, w.seq) AS r FROM n JOIN s w ON w.page = n.page AND w.orientation <> n.orientation
      WHERE (w.mid - near) * way * 0.1::DOUBLE BETWEEN 0.05 AND 1.0 AND w.len * 0.1::DOUBLE >= 0.8::DOUBLE * (f1 - f0) * 0.1::DOUBLE AND abs(w.tone - 214) <= 14) WHERE r = 1),
h AS (SELECT * FROM (SELECT g.* EXCLUDE (r), w.a0 AS w0, w.a1 AS w1, row_number() OVER (PARTITION BY g.page, g.orientation, g.a0, g.a1
      ORDER BY abs(w.mid - edge) * 0.1::DOUBLE + abs(w.len / (f1 - f0) - 1.05::DOUBLE), w.seq) AS r FROM g JOIN s w ON w.page = g.page AND w.orientation <> g.orientation
      WHERE w.len / (f1 - f0) BETWEEN 0.8 AND 1.5 AND abs(w.mid - edge) * 0.1::DOUBLE <= 1.5) WHERE r = 1),
c AS (SELECT *, (abs(far - near) + 2 * abs(edge - near)) * 0.1::DOUBLE AS depth, (w1 - w0) * 0.1::DOUBLE AS run FROM h),
z AS (SELECT * FROM c WHERE depth BETWEEN 3.4 AND 4.6 AND run >= 20)
SELECT s_suppkey AS page, round_even(run * depth, 1) AS area_m2, round_even(depth, 3) AS dock_depth_m, round_even(run, 2) AS loading_face_lm, z.doors AS doors, f.page IS NOT NULL AS evidence_seen,
       CASE WHEN z.page IS NULL THEN 'no unique repeated dock-door family adjacent to the yard' END AS reason
FROM supplier LEFT JOIN z ON z.page = s_suppkey LEFT JOIN (SELECT DISTINCT page FROM f) f ON f.page = s_suppkey""")
def dock_zones(spark, d):
    """The dock of every supplier's page, or why it has none."""
    segments = _shaped(t(spark, d, "lineitem"), SEGMENT).distinct().withColumn("p1", F.col("p0")).withColumn("tones", F.array("tone"))
    pages = t(spark, d, "supplier").select(F.col("s_suppkey").alias("page"), F.lit(0.1).alias("k"), F.lit(214.0).alias("target"))
    return docks.dock_zones(segments, pages).select("page", "area_m2", "dock_depth_m", "loading_face_lm", "doors", "evidence_seen", "reason")


@query()
def yard_edge_runs(spark, d):
    """The wall along the edge of each supplier's yard, or why there is none."""
    corners = [("100.0D", "95.0D"), ("100.0D", "530.0D"), ("400.0D", "530.0D"), ("400.0D", "300.0D + s_suppkey % 40"), ("250.0D", "95.0D")]
    yard = f"array({', '.join(f'struct({x} AS x, {y} AS y)' for x, y in corners)})"
    outlines = t(spark, d, "supplier").selectExpr("s_suppkey AS page", "0.1D AS k", f"{yard} AS points")
    flat = F.col("orientation") == "V"  # the yard's long side lies along the docks
    lines = _shaped(t(spark, d, "lineitem"), SEGMENT).distinct()
    ends = {"x0": F.when(flat, F.col("a0")).otherwise(F.col("p0")), "y0": F.when(flat, F.col("p0")).otherwise(F.col("a0")), "x1": F.when(flat, F.col("a1")).otherwise(F.col("p0")), "y1": F.when(flat, F.col("p0")).otherwise(F.col("a1"))}
    # stored, as a test of ends would be moved into the scan and write out each end's cases many times over
    return docks.yard_edge_runs(outlines, stored(lines.select("page", "seq", "grey", *(c.alias(n) for n, c in ends.items())), "lines"))


# Vectors are points on the page of their label; their first two components, in thousandths.
_POINT = {"group_": "label", "id": "vec_id"}


def _points(spark, d) -> DataFrame:
    at = [_AT.format(k) for k in range(2)]
    rows = t(spark, d, "embeddings").where("label IS NOT NULL AND size(embedding) > 1")
    return _shaped(rows, _POINT | {"x": at[0], "y": at[1]}).withColumnRenamed("group_", "group")


_POINTS_SQL = f"pt AS (SELECT label AS page, vec_id AS id, {_AT.format(1)} AS x, {_AT.format(2)} AS y FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 1)"
_PAIRS_SQL = "pr AS (SELECT a.page, a.id AS qid, b.id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM pt a JOIN pt b ON a.page = b.page AND a.id <> b.id)"


@query(f"""WITH {_POINTS_SQL}, {_PAIRS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY page, qid ORDER BY d2, id) AS r FROM pr)
SELECT pt.page AS page, pt.id AS id, r.id AS neighbour, CAST(d2 AS BIGINT) AS d2 FROM pt LEFT JOIN r ON r.page = pt.page AND r.qid = pt.id AND r.r = 1""")
def nearest_neighbours(spark, d):
    """The nearest other point of every point's page."""
    found = points.nearest_neighbours(_points(spark, d), 8.0)
    return found.select(F.col("group").alias("page"), "id", "neighbour", F.col("d2").cast("long").alias("d2"))


REACH, DENSE = 25, 2


@query(f"""WITH RECURSIVE {_POINTS_SQL}, {_PAIRS_SQL}, nb AS (SELECT * FROM pr WHERE d2 <= {REACH * REACH}),
dn AS (SELECT page, qid AS id FROM nb GROUP BY page, qid HAVING count(*) >= {DENSE}),
ed AS (SELECT nb.qid AS a, nb.id AS b FROM nb JOIN dn x ON x.id = nb.qid JOIN dn y ON y.id = nb.id),
rc(id, c) AS (SELECT id, id FROM dn UNION SELECT ed.b, rc.c FROM rc JOIN ed ON ed.a = rc.id AND rc.c < ed.b),
cl AS (SELECT id, min(c) AS cluster FROM rc GROUP BY id),
bd AS (SELECT qid AS id, arg_min(nb.id, (d2, nb.id)) AS via FROM nb JOIN dn ON dn.id = nb.id WHERE qid NOT IN (SELECT id FROM dn) GROUP BY qid)
SELECT page, pt.id AS id, cl.cluster IS NOT NULL AS dense, coalesce(cl.cluster, cv.cluster) AS cluster FROM pt LEFT JOIN cl ON cl.id = pt.id LEFT JOIN bd ON bd.id = pt.id LEFT JOIN cl cv ON cv.id = bd.via""")
def density_groups(spark, d):
    """Points of a page that lie close together, grouped."""
    return points.density_groups(_points(spark, d), float(REACH), DENSE).withColumnRenamed("group", "page")


# Customers' drawings, and parts as the files of a few shared folders.
_TARGET = {
    "target": "'/up/' || CAST(c_custkey % 3 AS STRING) || '/own-' || CAST(c_custkey AS STRING) || '.pdf'", "folder": "'/up/' || CAST(c_custkey % 3 AS STRING)",
    "project": "CASE WHEN c_custkey % 10 = 9 THEN CASE WHEN c_custkey % 20 = 9 THEN '' END ELSE 'P ' || CAST(c_custkey % 40 AS STRING) END",
}
_FILE_NAME = ("'P_' || CAST(p_partkey % 50 AS STRING) || '_' || CASE p_partkey % 4 WHEN 0 THEN 'Slab-Specification' WHEN 1 THEN 'site plan' WHEN 2 THEN 'typical_detail' ELSE 'JOINT LAYOUT' END "
              "|| '_' || CAST(p_partkey AS STRING) || CASE WHEN p_partkey % 9 = 0 THEN '.dwg' ELSE '.PDF' END")  # fmt: skip
_FILE = {
    "folder": "'/up/' || CAST(p_partkey % 7 AS STRING)", "name": _FILE_NAME, "path": f"'/up/' || CAST(p_partkey % 7 AS STRING) || '/' || {_FILE_NAME}",
    "project": "CASE WHEN p_partkey % 6 = 5 THEN 'P ' || CAST(p_partkey % 45 AS STRING) END", "size_": "p_size", "key_": "p_partkey",
}


@query(f"""
WITH tg AS (SELECT {_columns(_TARGET).replace("STRING", "VARCHAR")} FROM customer), fl AS (SELECT {_columns(_FILE).replace("STRING", "VARCHAR")} FROM part),
dt AS (SELECT *, regexp_replace(lower(name), '[-_]+', ' ', 'g') AS plain FROM fl WHERE lower(name) LIKE '%.pdf'),
dd AS (SELECT * FROM dt WHERE plain LIKE '%slab specification%' OR plain LIKE '%typical detail%' OR plain LIKE '%joint layout%'),
cd AS (SELECT target, target AS path, 0 AS stage FROM tg
  UNION ALL SELECT target, path, 1 FROM tg JOIN dd ON dd.folder = tg.folder AND (coalesce(tg.project, '') = '' OR starts_with(name, replace(tg.project, ' ', '_') || '_'))
  UNION ALL SELECT target, path, 2 FROM tg JOIN dd ON dd.project = tg.project AND tg.project <> ''),
sp AS (SELECT target, path, min(stage) AS stage FROM cd GROUP BY ALL),
fd AS (SELECT path, 'depth_mm' AS field, CAST(150 + 25 * (size_ % 3) AS VARCHAR) AS value, false AS conflict FROM fl WHERE size_ % 4 > 0 UNION ALL
  SELECT path, 'mesh', CASE WHEN size_ % 11 > 0 THEN CASE WHEN key_ % 97 = 0 THEN 'A393' ELSE 'A252' END END, size_ % 11 = 0 FROM fl WHERE size_ % 3 = 0 UNION ALL
  SELECT target, 'depth_mm', '200', false FROM (SELECT target, length(target) AS n FROM tg) WHERE n % 2 = 0),
by_ AS (SELECT target, field, count(DISTINCT value) AS n, bool_or(conflict) AS any_, min(value) AS v, min(stage) AS stage, count(DISTINCT path) AS n_files FROM sp JOIN fd USING (path) GROUP BY target, field)
SELECT target, field, CASE WHEN n = 1 AND NOT any_ THEN v END AS value, NOT (n = 1 AND NOT any_) AS conflict, stage, n_files FROM by_ WHERE n > 0 OR any_""")
def searched_specs(spark, d):
    """Fields of every customer's drawing from all the files that speak for it."""
    targets, files = _shaped(t(spark, d, "customer"), _TARGET), _shaped(t(spark, d, "part"), _FILE)
    field = lambda rows, path, name, value, conflict: rows.selectExpr(f"{path} AS path", f"'{name}' AS field", f"CAST({value} AS STRING) AS value", f"{conflict} AS conflict")
    found = field(files.where("size_ % 4 > 0"), "path", "depth_mm", "150 + 25 * (size_ % 3)", "false")
    found = found.unionByName(field(files.where("size_ % 3 = 0"), "path", "mesh", "CASE WHEN size_ % 11 > 0 THEN CASE WHEN key_ % 97 = 0 THEN 'A393' ELSE 'A252' END END", "size_ % 11 = 0"))
    found = found.unionByName(field(targets.where("length(target) % 2 = 0"), "target", "depth_mm", "'200'", "false"))
    return search.searched(targets, files, found)


# Parts are marks on sheets of sixteen: discs of several radii, and every fifth a square.
_SHEET, _STEP = 4, 30


def _marked_sheets(spark, d) -> DataFrame:
    marks = t(spark, d, "part").selectExpr(f"p_partkey div {_SHEET**2} AS page", f"int(p_partkey % {_SHEET**2}) AS place", "6 + p_size % 5 AS r", "p_partkey % 5 = 0 AS square")
    size = _SHEET * _STEP

    # no mark reaches beyond its own field
    y, x = np.mgrid[0:_STEP, 0:_STEP] - _STEP // 2
    square, round_ = np.maximum(abs(x), abs(y)), np.hypot(x, y)

    def draw(group: pa.Table) -> pa.Table:
        whole = np.zeros((size, size), bool)
        for m in group.to_pylist():
            top, left = m["place"] // _SHEET * _STEP, m["place"] % _SHEET * _STEP
            whole[top : top + _STEP, left : left + _STEP] |= (square if m["square"] else round_) <= m["r"]
        return pa.table({"page": group.column("page")[:1], "h": pa.array([size], pa.int32()), "w": pa.array([size], pa.int32()), "mask": pa.array([tiles.pack(whole)], pa.binary())})

    return tiles.tiled(spread(marks, "page").groupBy("page").applyInArrow(draw, "page long, h int, w int, mask binary"), 32)


@query(f"SELECT p_partkey // {_SHEET**2} AS page, count(*) AS n FROM part WHERE p_partkey % 5 > 0 GROUP BY ALL")
def circle_marks(spark, d):
    """How many circles the sheets of all parts show."""
    return circles.circles(circles.borders(_marked_sheets(spark, d), 32), 6, 10).groupBy("page").agg(F.count("*").alias("n"))
