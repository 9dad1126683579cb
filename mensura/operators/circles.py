"""Circles among border pixels by voting: each pixel votes for the centres that it may lie around, and clear winners stay.

Borders are rows (page, x, y, nx, ny): a place and the direction across the border
there. A pixel votes on both sides along that direction, once for each radius. Border
pixels go to the blocks of a page in which they may vote, and a task counts the votes of one
block, so what is shuffled are border pixels, not votes. A centre's support at a radius is the
votes of its cell and the eight around it, as a share of the circle's length; straight
borders give a centre no more than they are long within these cells. Of centres that lie
within a distance of one another the best supported one stays: each block decides its
own, from those a few distances around it, and what hangs on centres farther away is
decided over the whole table.

Found are discs, holes and strokes at least as wide as the window that a border's
direction is read from; thinner strokes have no clear direction.

Defined results: pages without borders have no circles; null places and directions of
length 0 don't vote; of equal support the smaller place stays.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mensura.operators.lineage import spread, stored
from mensura.operators.spatial import greedy_kept, numbered
from mensura.operators.tiles import SIDE, _form, unpack, windows

# The diameters of a manhole in metres.
LEAST_M, MOST_M = 0.5, 1.8
CELL = 1
SHARE = 0.6
BORDER = "x double, y double, nx double, ny double"
PEAK = "cx long, cy long, support double, r int"
#: Width of the blocks in which votes are counted and centres decided; the first begins a quarter before the page.
BLOCK = 256
#: Distances around a block whose centres it sees when it decides its own.
AROUND = 2
GONE, KEPT, OPEN = 0, 1, 2


def borders(tiles: DataFrame, side: int = SIDE, reach: int = 3) -> DataFrame:
    """Set pixels beside unset ones, with the direction in which the mask falls, from sums over a window of ``reach``."""
    page = tiles.schema["page"]
    schema, arrow = _form(page, BORDER)
    k = np.arange(-reach, reach + 1)

    def run(batches):
        for batch in batches:
            at, found = [], []
            for i, (blob, ty, tx) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("mask", "ty", "tx")))):
                m = unpack(blob, side + 2 * reach, side + 2 * reach)
                own = m[reach:-reach, reach:-reach]
                inner = m[reach - 1 : -reach - 1, reach:-reach] & m[reach + 1 : m.shape[0] - reach + 1, reach:-reach] & m[reach:-reach, reach - 1 : -reach - 1] & m[reach:-reach, reach + 1 : m.shape[1] - reach + 1]
                n = m.astype(np.int64)
                down, across = (sum(n[reach + j : reach + j + side] for j in k), sum(n[:, reach + j : reach + j + side] for j in k))
                dx = sum(j * down[:, reach + j : reach + j + side] for j in k)
                dy = sum(j * across[reach + j : reach + j + side] for j in k)
                y, x = np.nonzero(own & ~inner & ((dx != 0) | (dy != 0)))
                dx, dy = dx[y, x].astype(float), dy[y, x].astype(float)
                long = np.hypot(dx, dy)
                at.append(np.full(len(x), i))
                found.append(np.stack([x + tx * side + 0.5, y + ty * side + 0.5, dx / long, dy / long]))
            if found:
                values = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("page").take(pa.array(np.concatenate(at))), *map(pa.array, values)], schema=arrow)

    return windows(tiles, reach, side).mapInArrow(run, schema)


def _in_blocks(rows: DataFrame, x: Column, y: Column, halo: float, block: int) -> DataFrame:
    """``rows`` once for each block (bx, by) that they lie in or within ``halo`` of."""
    span = lambda c: F.explode(F.sequence(F.floor((c - halo + block // 4) / block), F.floor((c + halo + block // 4) / block)))
    return rows.withColumn("bx", span(x)).withColumn("by", span(y))


def _own(bx: int, by: int, block: int) -> tuple[int, int]:
    """The first cell of a block."""
    return bx * block - block // 4, by * block - block // 4


def peaks(edges: DataFrame, least: int, most: int, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """page, cx, cy, support and r of the centres that have at least the share, each at its best radius."""
    page = edges.schema["page"]
    schema, arrow = _form(page, PEAK)
    sent = _in_blocks(edges.select("page", "x", "y", "nx", "ny"), F.col("x"), F.col("y"), most + 3, block)

    def run(group: pa.Table) -> pa.Table:
        x, y, nx, ny = (group.column(c).to_numpy() for c in ("x", "y", "nx", "ny"))
        ox, oy = _own(group.column("bx")[0].as_py(), group.column("by")[0].as_py(), block)
        # the block's cells and one around them, no farther than votes lie
        x0, x1 = max(ox - 1, int(x.min()) - most - 3), min(ox + block, int(x.max()) + most + 3)
        y0, y1 = max(oy - 1, int(y.min()) - most - 3), min(oy + block, int(y.max()) + most + 3)
        wide, high = x1 - x0 + 1, y1 - y0 + 1
        best, radius = np.zeros((max(high - 2, 0), max(wide - 2, 0))), np.zeros((max(high - 2, 0), max(wide - 2, 0)), int)
        for r in range(least, most + 1) if best.size else ():
            cells = []
            for way in (-1, 1):
                cx, cy = np.floor((x + way * r * nx) / CELL).astype(np.int64), np.floor((y + way * r * ny) / CELL).astype(np.int64)
                live = (cx >= x0) & (cx <= x1) & (cy >= y0) & (cy <= y1)
                cells.append((cy[live] - y0) * wide + cx[live] - x0)
            n = np.bincount(np.concatenate(cells), minlength=high * wide).reshape(high, wide)
            n = n[:-2] + n[1:-1] + n[2:]
            support = (n[:, :-2] + n[:, 1:-1] + n[:, 2:]) / (2 * math.pi * r)
            better = (support >= share) & (support >= best)
            best, radius = np.where(better, support, best), np.where(better, r, radius)
        cy, cx = np.nonzero(radius)
        values = [pa.array(cx + x0 + 1), pa.array(cy + y0 + 1), pa.array(best[cy, cx]), pa.array(radius[cy, cx], pa.int32())]
        return pa.Table.from_arrays([pa.chunked_array([group.column("page").combine_chunks().take(pa.array(np.zeros(len(cx), int)))], arrow.field(0).type), *values], schema=arrow)

    return spread(sent, "page", "bx", "by").groupBy("page", "bx", "by").applyInArrow(run, schema)


def _decided(found: DataFrame, apart: float, block: int) -> DataFrame:
    """Centres with ``state``: KEPT or GONE where the block and what lies around it tell, else OPEN."""
    schema = T.StructType([*(found.schema[c] for c in ("page", "cx", "cy", "support", "r")), T.StructField("state", T.IntegerType())])
    arrow = to_arrow_schema(schema)
    halo, step = math.ceil(AROUND * apart), math.ceil(apart)
    sent = _in_blocks(found.select("page", "cx", "cy", "support", "r"), F.col("cx"), F.col("cy"), halo, block)

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        x, y, support = (group.column(c).to_numpy() for c in ("cx", "cy", "support"))
        ox, oy = _own(group.column("bx")[0].as_py(), group.column("by")[0].as_py(), block)
        order = np.lexsort((x, y, -support))
        x, y = x[order], y[order]
        # all centres within ``apart`` of these are known
        known = (x - apart >= ox - halo) & (x + apart < ox + block + halo) & (y - apart >= oy - halo) & (y + apart < oy + block + halo)
        state = np.full(len(x), -1)
        cells: dict[tuple, list[int]] = {}
        for i, (p, q) in enumerate(zip((x // step).tolist(), (y // step).tolist())):
            cells.setdefault((p, q), []).append(i)
        cells = {c: np.array(v) for c, v in cells.items()}
        for i in range(len(x)):
            if state[i] == GONE:
                continue
            if state[i] == -1:
                state[i] = KEPT if known[i] else OPEN
            p, q = int(x[i] // step), int(y[i] // step)
            near = np.concatenate([cells[c] for a in (-1, 0, 1) for b in (-1, 0, 1) if (c := (p + a, q + b)) in cells])
            near = near[(near > i) & ((x[near] - x[i]) ** 2 + (y[near] - y[i]) ** 2 < apart * apart)]
            if state[i] == KEPT:
                state[near] = GONE
            else:
                state[near[state[near] == -1]] = OPEN
        mine = np.flatnonzero((x >= ox) & (x < ox + block) & (y >= oy) & (y < oy + block))
        out = group.select(["page", "cx", "cy", "support", "r"]).take(pa.array(order[mine]))
        return out.append_column("state", pa.array(state[mine], pa.int32())).cast(arrow)

    return spread(sent, "page", "bx", "by").groupBy("page", "bx", "by").applyInArrow(run, schema)


def _close(better: DataFrame, worse: DataFrame, apart: float) -> DataFrame:
    """Pairs of a page within ``apart``: columns of ``better`` with the prefix b_."""
    band = lambda c: F.floor(F.col(c) / apart)
    look = better.select(*(F.col(c).alias(f"b_{c}") for c in better.columns))
    for c, of in (("bx", "b_cx"), ("by", "b_cy")):
        look = look.withColumn(c, F.explode(F.sequence(band(of) - 1, band(of) + 1)))
    lie = worse.withColumn("bx", band("cx")).withColumn("by", band("cy"))
    met = look.join(lie, (F.col("b_page").eqNullSafe(F.col("page"))) & (look["bx"] == lie["bx"]) & (look["by"] == lie["by"])).drop("bx", "by")
    return met.where((F.col("cx") - F.col("b_cx")) ** 2 + (F.col("cy") - F.col("b_cy")) ** 2 < apart * apart)


def circles(edges: DataFrame, least: int, most: int, share: float = SHARE, apart: float | None = None, block: int = BLOCK) -> DataFrame:
    """page, x, y, radius and support of the circles with radii of ``least`` to ``most`` pixels in borders(page, x, y, nx, ny)."""
    apart = max(4.0, 2.0 * least) if apart is None else apart
    live = edges.where("x IS NOT NULL AND y IS NOT NULL AND nx * nx + ny * ny > 0")
    known = stored(_decided(peaks(live, least, most, share, block), apart, block), "peaks")
    cols = ["page", "cx", "cy", "support", "r"]
    kept, open_ = known.where(f"state = {KEPT}").select(cols), stored(known.where(f"state = {OPEN}").select(cols), "open")
    if not open_.isEmpty():
        placed = stored(numbered(open_, ["page", F.desc("support"), "cy", "cx"], "place"), "open")
        rank = lambda p: F.struct((-F.col(f"{p}support")).alias("s"), F.col(f"{p}cy").alias("y"), F.col(f"{p}cx").alias("x"))
        beaten = _close(kept, placed, apart).where(rank("b_") < rank("")).select("place").distinct()
        left = stored(placed.join(beaten, "place", "left_anti"), "open")
        pairs = _close(left, left, apart).where("b_place < place").select(F.col("b_place").alias("better"), F.col("place").alias("worse"))
        gone = greedy_kept(pairs).where("NOT kept").select("place")
        kept = kept.unionByName(left.join(gone, "place", "left_anti").select(cols))
    return kept.select("page", ((F.col("cx") + 0.5) * CELL).alias("x"), ((F.col("cy") + 0.5) * CELL).alias("y"), F.col("r").alias("radius"), "support")


def radii(pixels_a_m: float) -> tuple[int, int]:
    """The radii in pixels of what may be a manhole."""
    least = max(1, round(LEAST_M / 2 * pixels_a_m))
    return least, max(least + 1, round(MOST_M / 2 * pixels_a_m))
