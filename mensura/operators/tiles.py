"""Binary images of any size in tiles: closing, opening, erosion, components over seams, voids, outlines.

A page is a table of square tiles (page, h, w, ty, tx, mask) with ``mask`` the packed
bits of the tile, row by row; tiles without a set pixel may be missing, pixels outside
of h x w are never set. Nothing here needs a whole page in one task: neighbourhood
operators send each tile the strips of its neighbours that reach into its halo, also
where a halo is wider than a tile, and components are found inside of tiles, linked
where labels meet at a seam and joined as a graph. Results are equal at every tile
size. Only an outline, which is as long as a region's border, is gathered by region.

Windows of even size lie as the usual image libraries have them: one more pixel
before than after when eroding, and the other way round when dilating; what is
outside of the page counts as not set.
"""

from __future__ import annotations

import math
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from mensura.operators.lineage import components, spread, stored
from mensura.operators.raster import label_components
from mensura.operators.spatial import numbered

SIDE = 256
LABELS = 1 << 24
# The areas that a single surface may have, and the share of the chosen one that others must reach.
LEAST_M2, MOST_M2, SATELLITE, MARGIN = 200, 50_000, 0.015, 0.025
SOLID = 0.03
#: Tiles that a task hands on at once, and pixels of tiles that it works on together.
TILES, PIXELS = 512, 1 << 20
TILE = "h int, w int, ty int, tx int, mask binary"


def pack(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def unpack(blob: bytes, height: int, width: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=height * width).reshape(height, width).astype(bool)


def _packed(masks: np.ndarray) -> pa.Array:
    """``pack`` of every mask of a stack."""
    return pa.array([x.tobytes() for x in np.packbits(masks.reshape(len(masks), math.prod(masks.shape[1:])), axis=1)], pa.binary())


def _unpacked(blobs: list[bytes], height: int, width: int) -> np.ndarray:
    """A stack of masks of equal size."""
    bits = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1)
    return np.unpackbits(bits, axis=1, count=height * width).reshape(-1, height, width).view(bool)


def _numbers(batch, *names: str) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]


def _stacks(batches, pixels: int):
    """Parts of batches whose tiles of so many pixels each are worked on together."""
    n = max(1, PIXELS // pixels)
    return (batch.slice(i, n) for batch in batches for i in range(0, batch.num_rows, n))


def _counts(mask: np.ndarray, low: int, high: int, axis: int) -> np.ndarray:
    """How many pixels are set from ``low`` to ``high`` places on from each along an axis of an image, or of a stack of them."""
    n = mask.shape[axis]
    sums = np.concatenate([np.zeros_like(mask.take([0], axis), int), np.cumsum(mask, axis=axis, dtype=int)], axis=axis)
    at = np.arange(n)
    return sums.take(np.clip(at + high + 1, 0, n), axis) - sums.take(np.clip(at + low, 0, n), axis)


def dilated(mask: np.ndarray, size: int) -> np.ndarray:
    low, high = -(size - 1 - size // 2), size // 2
    return _counts(_counts(mask, low, high, -2) > 0, low, high, -1) > 0


def eroded(mask: np.ndarray, size: int) -> np.ndarray:
    low, high = -(size // 2), size - 1 - size // 2
    return _counts(_counts(mask, low, high, -2) == size, low, high, -1) == size


def cross_eroded(mask: np.ndarray) -> np.ndarray:
    """Pixels whose four neighbours are all set."""
    around = np.pad(mask, [(0, 0)] * (mask.ndim - 2) + [(1, 1)] * 2)
    return mask & around[..., :-2, 1:-1] & around[..., 2:, 1:-1] & around[..., 1:-1, :-2] & around[..., 1:-1, 2:]


def tiled(images: DataFrame, side: int = SIDE) -> DataFrame:
    """Tiles of images(page, h, w, mask), where ``mask`` are the packed bits of a whole image."""
    schema, arrow = _form(images.schema["page"], TILE)

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                whole = unpack(r["mask"], r["h"], r["w"])
                for y in range(0, r["h"], side):
                    for x in range(0, r["w"], side):
                        part = whole[y : y + side, x : x + side]
                        if part.any():
                            full = np.zeros((side, side), bool)
                            full[: part.shape[0], : part.shape[1]] = part
                            rows.append({**r, "ty": y // side, "tx": x // side, "mask": pack(full)})
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return images.select("page", "h", "w", "mask").mapInArrow(run, schema)


def _form(page: T.StructField, rest: str) -> tuple[T.StructType, pa.Schema]:
    """The columns page and ``rest``, for Spark and for the batches of its tasks."""
    schema = T.StructType([T.StructField("page", page.dataType), *T.StructType.fromDDL(rest).fields])
    return schema, to_arrow_schema(schema)


STRIP = "h int, w int, ty int, tx int, y int, x int, ph int, pw int, piece binary"


def windows(tiles: DataFrame, halo: int, side: int = SIDE) -> DataFrame:
    """Tiles with ``halo`` pixels around them, as masks of side + 2 * halo; also of tiles that only have something around."""
    return with_neighbours(tiles, halo, None, side)


def with_neighbours(tiles: DataFrame, halo: int, work, side: int = SIDE) -> DataFrame:
    """Tiles of work(windows, inside)[:, halo:-halo, halo:-halo], where a window is a tile with ``halo`` pixels around it.

    ``work`` takes a stack of windows; ``inside`` tells their pixels on the page. Tiles that only
    receive strips are worked on as well; those without a set pixel at the end are left out. Without
    ``work`` the windows themselves are returned.
    """
    page = tiles.schema["page"]
    tile_schema, tile_arrow = _form(page, TILE)
    strip_schema, strip_arrow = _form(page, STRIP)
    reach, full = math.ceil(halo / side), side + 2 * halo
    keys = ["page", "h", "w", "ty", "tx"]

    def strips(batches):
        for part in _stacks(batches, side * side):
            masks, (h, w, ty, tx) = _unpacked(part.column("mask").to_pylist(), side, side), _numbers(part, "h", "w", "ty", "tx")
            for dy in range(-reach, reach + 1):
                for dx in range(-reach, reach + 1):
                    # these tiles' place in the windows of the other ones
                    y, x = halo - dy * side, halo - dx * side
                    y0, x0 = max(0, -y), max(0, -x)
                    piece = masks[:, y0 : full - y, x0 : full - x]
                    on_page = (ty + dy >= 0) & (tx + dx >= 0) & ((ty + dy) * side < h) & ((tx + dx) * side < w)
                    sent = np.flatnonzero(on_page & piece.any(axis=(1, 2)))
                    place = [np.full(len(sent), v, np.int32) for v in (y + y0, x + x0, *piece.shape[1:])]
                    at = [v[sent].astype(np.int32) for v in (h, w, ty + dy, tx + dx)]
                    yield pa.RecordBatch.from_arrays([part.column("page").take(pa.array(sent)), *map(pa.array, at + place), _packed(piece[sent])], schema=strip_arrow)

    def whole_tiles(batches):
        """Strips of some tiles with the number of the tile that each belongs to; the last tile of a batch waits for the next one."""
        most, rows, last, n = max(1, PIXELS // full**2), [], None, 0
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in (*keys, "y", "x", "ph", "pw", "piece"))):
                if r[:5] != last:
                    if n == most:
                        yield rows, n
                        rows, n = [], 0
                    last, n = r[:5], n + 1
                rows.append((n - 1, r))
        if n:
            yield rows, n

    def stitched(batches):
        for rows, n in whole_tiles(batches):
            window, tile, kinds = np.zeros((n, full, full), bool), [None] * n, {}
            for i, r in rows:
                tile[i] = r[:5]
                kinds.setdefault(r[5:9], []).append((i, r[9]))
            for (y, x, ph, pw), sent in kinds.items():
                pieces = _unpacked([blob for _, blob in sent], ph, pw)
                at, first = np.unique([i for i, _ in sent], return_index=True)
                window[at, y : y + ph, x : x + pw] |= pieces[first]
                for k in np.setdiff1d(np.arange(len(sent)), first):  # of a tile that comes twice
                    window[sent[k][0], y : y + ph, x : x + pw] |= pieces[k]
            done = window
            if work is not None:
                h, w, ty, tx = (np.array(v)[:, None] for v in zip(*(t[1:] for t in tile)))
                y, x = np.arange(full) + ty * side - halo, np.arange(full) + tx * side - halo
                inside = ((y >= 0) & (y < h))[:, :, None] & ((x >= 0) & (x < w))[:, None, :]
                done = (work(window, inside) & inside)[:, halo : halo + side, halo : halo + side]
            kept = np.flatnonzero(done.any(axis=(1, 2)))
            names = zip(*(tile[i] for i in kept)) if len(kept) else [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(list(v), f.type) for v, f in zip(names, tile_arrow)), _packed(done[kept])], schema=tile_arrow)

    sent = spread(tiles.select("page", "h", "w", "ty", "tx", "mask"), *keys).mapInArrow(strips, strip_schema)
    # tiles are small, so a task takes them one after the other in their order, not as a group each
    return spread(sent, *keys).sortWithinPartitions(*keys).mapInArrow(stitched, tile_schema)


def closed(tiles: DataFrame, size: int, side: int = SIDE) -> DataFrame:
    """Gaps of less than ``size`` pixels closed: dilated, then eroded."""
    return with_neighbours(tiles, size - 1, lambda m, inside: eroded(dilated(m, size) & inside, size), side)


def opened(tiles: DataFrame, size: int, side: int = SIDE) -> DataFrame:
    """What is thinner than ``size`` pixels left out: eroded, then dilated."""
    return with_neighbours(tiles, size - 1, lambda m, inside: dilated(eroded(m & inside, size), size), side)


def solid_share(tiles: DataFrame, pages: DataFrame, side: int = SIDE) -> DataFrame:
    """page, solid and style: the share of pixels that two erosions by a cross leave, of pages(page, h, w).

    Filled surfaces survive them, lines and hatching vanish; a page with little solid is line work.
    """
    left = with_neighbours(tiles, 2, lambda m, inside: cross_eroded(cross_eroded(m & inside)), side)
    n = _set_pixels(left)
    share = F.coalesce("n", F.lit(0)) / (F.col("h").cast("double") * F.col("w"))
    met = pages.select("page", "h", "w").join(n, "page", "left").select("page", share.alias("solid"))
    return met.withColumn("style", F.when(F.col("solid") > SOLID, "colour-coded").otherwise("line/hatch"))


def _set_pixels(tiles: DataFrame) -> DataFrame:
    """page and n, the number of its set pixels."""
    page = tiles.schema["page"]

    def run(batches):
        for batch in batches:
            n = [int(np.unpackbits(np.frombuffer(m.as_py(), np.uint8)).sum()) for m in batch.column("mask")]
            yield pa.record_batch([batch.column("page"), pa.array(n, pa.int64())], ["page", "n"])

    return tiles.select("page", "mask").mapInArrow(run, _form(page, "n long")[0]).groupBy("page").agg(F.sum("n").alias("n"))


def without_margin(tiles: DataFrame, share: float = MARGIN, side: int = SIDE) -> DataFrame:
    """Tiles without the pixels of the outer band of the page, where frames are drawn."""
    page = tiles.schema["page"]
    tile_schema, tile_arrow = _form(page, TILE)

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                my, mx = (max(1, round(r[c] * share)) for c in ("h", "w"))
                y, x = np.arange(side) + r["ty"] * side, np.arange(side) + r["tx"] * side
                mask = unpack(r["mask"], side, side) & ((y >= my) & (y < r["h"] - my))[:, None] & ((x >= mx) & (x < r["w"] - mx))[None, :]
                if mask.any():
                    rows.append({**r, "mask": pack(mask)})
            yield pa.RecordBatch.from_pylist(rows, tile_arrow)

    return tiles.select("page", "h", "w", "ty", "tx", "mask").mapInArrow(run, tile_schema)


LABELLED = "h int, w int, ty int, tx int, tile long, labels binary, top binary, bottom binary, left binary, right binary"
PIECE = "tile long, local int, node long, pixels long, first long, y0 int, x0 int, y1 int, x1 int"


def labelled(tiles: DataFrame, side: int = SIDE) -> DataFrame:
    """Tiles with the number of each pixel's component inside of the tile, and these numbers along its four sides."""
    page = tiles.schema["page"]
    labelled_schema, labelled_arrow = _form(page, LABELLED)

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                n = label_components(unpack(r["mask"], side, side)).astype("<i4")
                ends = {"top": n[0], "bottom": n[-1], "left": n[:, 0], "right": n[:, -1]}
                rows.append({**{c: r[c] for c in ("page", "h", "w", "ty", "tx", "tile")}, "labels": n.tobytes(), **{k: np.ascontiguousarray(v).tobytes() for k, v in ends.items()}})
            yield pa.RecordBatch.from_pylist(rows, labelled_arrow)

    # numbers take two passes over the tiles
    return spread(numbered(stored(tiles, "tiles"), ["page", "ty", "tx"], "tile"), "tile").mapInArrow(run, labelled_schema)


def _pieces(labels: DataFrame, side: int) -> DataFrame:
    """A row for each component inside of a tile: its size, first pixel in reading order, and corners on the page."""
    page = labels.schema["page"]
    piece_schema, piece_arrow = _form(page, PIECE)

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                n = np.frombuffer(r["labels"], "<i4").reshape(side, side)
                y, x = np.nonzero(n)
                of = n[y, x] - 1
                k = int(of.max(initial=-1)) + 1
                pixels = np.bincount(of, minlength=k)
                y, x = y + r["ty"] * side, x + r["tx"] * side
                first, y1, x1 = np.full(k, np.iinfo(np.int64).max), np.zeros(k, int), np.zeros(k, int)
                y0, x0 = first.copy(), first.copy()
                for into, values, f in ((first, y * r["w"] + x, np.minimum), (y0, y, np.minimum), (x0, x, np.minimum), (y1, y + 1, np.maximum), (x1, x + 1, np.maximum)):
                    f.at(into, of, values)
                for i in range(k):
                    rows.append({
                        "page": r["page"], "tile": r["tile"], "local": i + 1, "node": r["tile"] * LABELS + i + 1, "pixels": int(pixels[i]), "first": int(first[i]),
                        "y0": int(y0[i]), "x0": int(x0[i]), "y1": int(y1[i]), "x1": int(x1[i]),
                    })
            yield pa.RecordBatch.from_pylist(rows, piece_arrow)

    return spread(labels.select("page", "w", "ty", "tx", "tile", "labels"), "tile").mapInArrow(run, piece_schema)


def _seams(batches):
    for batch in batches:
        found = []
        for one, a, two, b in zip(*(batch.column(c).to_pylist() for c in ("one", "a", "two", "b"))):
            a, b = (np.frombuffer(x, "<i4").astype(np.int64) for x in (a, b))
            met = np.flatnonzero((a > 0) & (b > 0))
            found.append(np.unique(np.stack([one * LABELS + a[met], two * LABELS + b[met]], 1), axis=0))
        pairs = np.concatenate([np.zeros((0, 2), np.int64), *found])
        yield pa.record_batch({"a": pa.array(pairs[:, 0].astype(np.int64)), "b": pa.array(pairs[:, 1].astype(np.int64))})


def pieces_with_regions(labels: DataFrame, side: int = SIDE) -> DataFrame:
    """The pieces of all tiles, each with the ``region`` that it belongs to: the first pixel of that, in reading order."""
    edges = None
    for mine, its, dy, dx in (("right", "left", 0, 1), ("bottom", "top", 1, 0)):
        one = labels.select("page", (F.col("ty") + dy).alias("ty"), (F.col("tx") + dx).alias("tx"), F.col("tile").alias("one"), F.col(mine).alias("a"))
        two = labels.select("page", "ty", "tx", F.col("tile").alias("two"), F.col(its).alias("b"))
        met = one.join(two, ["page", "ty", "tx"]).select("one", "a", "two", "b").mapInArrow(_seams, "a long, b long")
        edges = met if edges is None else edges.unionByName(met)
    found = components(stored(_pieces(labels, side), "pieces"), edges)
    first = found.groupBy("component").agg(F.min("first").alias("region"))
    return stored(found.join(first, "component").drop("component"), "pieces")


def regions_of(pieces: DataFrame) -> DataFrame:
    """page, region, pixels and corners of every component."""
    return pieces.groupBy("page", "region").agg(F.sum("pixels").alias("pixels"), *(f(c).alias(c) for c, f in (("y0", F.min), ("x0", F.min), ("y1", F.max), ("x1", F.max))))


def retained(regions: DataFrame, pixels_a_m2: float) -> DataFrame:
    """Regions that stay, ``chosen`` the largest of a plausible area: with it all of at least a share of it that aren't too large.

    Where no area is plausible the largest region stays alone, with ``plausible`` false.
    Equal sizes go to the first in reading order.
    """
    m2 = F.col("pixels") / pixels_a_m2
    w = Window.partitionBy("page")
    known = regions.withColumn("plausible", m2.between(LEAST_M2, MOST_M2))
    known = known.withColumn("place", F.row_number().over(w.orderBy(F.desc("plausible"), F.desc("pixels"), "region")))
    known = known.withColumn("best", F.max(F.when(F.col("place") == 1, F.col("pixels"))).over(w)).withColumn("any", F.max("plausible").over(w))
    stays = (F.col("place") == 1) | (F.col("any") & (F.col("pixels") >= SATELLITE * F.col("best")) & (m2 <= MOST_M2))
    return known.where(stays).withColumn("chosen", F.col("place") == 1).drop("place", "best", "any")


def region_tiles(labels: DataFrame, pieces: DataFrame, regions: DataFrame, side: int = SIDE) -> DataFrame:
    """Tiles of each of ``regions`` alone; their page is (page, region)."""
    wanted = pieces.join(regions.select("page", "region"), ["page", "region"], "left_semi")
    by = wanted.groupBy("tile", "region").agg(F.collect_set("local").alias("locals"))
    met = spread(labels.select("page", "h", "w", "ty", "tx", "tile", "labels"), "tile").join(spread(by, "tile"), "tile")
    met = met.select(F.struct("page", "region").alias("page"), "h", "w", "ty", "tx", "labels", "locals")
    page = met.schema["page"]
    tile_schema, tile_arrow = _form(page, TILE)

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                mask = np.isin(np.frombuffer(r["labels"], "<i4"), r["locals"])
                rows.append({**{c: r[c] for c in ("page", "h", "w", "ty", "tx")}, "mask": pack(mask)})
            yield pa.RecordBatch.from_pylist(rows, tile_arrow)

    return met.mapInArrow(run, tile_schema)


def _outside(masks: DataFrame, regions: DataFrame, side: int) -> DataFrame:
    """Tiles of what isn't the region, within the tiles that its corners span."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / side).cast("int"), F.floor((F.col(hi) - 1) / side).cast("int"))
    every = regions.select(F.struct("page", "region").alias("page"), F.explode(span("y0", "y1")).alias("ty"), "x0", "x1").withColumn("tx", F.explode(span("x0", "x1"))).drop("x0", "x1")
    size = masks.groupBy("page").agg(F.max("h").alias("h"), F.max("w").alias("w"))
    at = ["page", "ty", "tx"]
    met = spread(every.join(size, "page"), *at).join(spread(masks.select(*at, "mask"), *at), at, "left").select("page", "h", "w", "ty", "tx", "mask")
    page = met.schema["page"]
    tile_schema, tile_arrow = _form(page, TILE)

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                mask = np.zeros((side, side), bool) if r["mask"] is None else unpack(r["mask"], side, side)
                y, x = np.arange(side) + r["ty"] * side, np.arange(side) + r["tx"] * side
                free = ~mask & (y < r["h"])[:, None] & (x < r["w"])[None, :]
                if free.any():
                    rows.append({**r, "mask": pack(free)})
            yield pa.RecordBatch.from_pylist(rows, tile_arrow)

    return met.mapInArrow(run, tile_schema)


def voids(masks: DataFrame, regions: DataFrame, least_pixels: float, side: int = SIDE) -> tuple[DataFrame, DataFrame]:
    """(holes, tiles): every hole of the regions with its size and whether it is filled, and the tiles with small holes filled.

    A hole is a component of what isn't the region that doesn't reach the edge of
    the tiles which the region spans, beyond which there is nothing of it.
    """
    around = stored(labelled(_outside(masks, regions, side), side), "around")
    pieces = pieces_with_regions(around, side)
    edge = regions.select(
        F.struct("page", "region").alias("page"), (F.floor(F.col("y0") / side) * side).alias("ey0"), (F.floor(F.col("x0") / side) * side).alias("ex0"),
        (F.ceil(F.col("y1") / side) * side).alias("ey1"), (F.ceil(F.col("x1") / side) * side).alias("ex1"),
    ).join(masks.groupBy("page").agg(F.max("h").alias("h"), F.max("w").alias("w")), "page")
    found = regions_of(pieces).join(edge, "page")
    inner = (F.col("y0") > F.col("ey0")) & (F.col("x0") > F.col("ex0")) & (F.col("y1") < F.least("ey1", "h")) & (F.col("x1") < F.least("ex1", "w"))
    holes = stored(found.where(inner).select("page", F.col("region").alias("hole"), "pixels", (F.col("pixels") < least_pixels).alias("filled")), "holes")
    fill = region_tiles(around, pieces, holes.where("filled").select("page", F.col("hole").alias("region")), side)
    both = masks.select("page", "h", "w", "ty", "tx", "mask").unionByName(fill.select(F.col("page.page").alias("page"), "h", "w", "ty", "tx", "mask"))
    tile_schema, tile_arrow = _form(both.schema["page"], TILE)

    def united(batches):
        out = []
        for _, rows in groupby((r for batch in batches for r in batch.to_pylist()), key=itemgetter("page", "ty", "tx")):
            first, *more = rows
            if more:
                first["mask"] = np.bitwise_or.reduce([np.frombuffer(r["mask"], np.uint8) for r in (first, *more)]).tobytes()
            out.append(first)
            if len(out) == TILES:
                yield pa.RecordBatch.from_pylist(out, tile_arrow)
                out = []
        yield pa.RecordBatch.from_pylist(out, tile_arrow)

    at = ["page", "ty", "tx"]
    return holes, spread(both, *at).sortWithinPartitions(*at).mapInArrow(united, tile_schema)


EDGES = "x0 int, y0 int, x1 int, y1 int"


def border_runs(masks: DataFrame, side: int = SIDE) -> DataFrame:
    """Straight runs of every tile's border, directed so that what is set lies on the right hand."""
    page = masks.schema["page"]
    edges_schema, edges_arrow = _form(page, EDGES)

    def runs(lines: np.ndarray) -> tuple[np.ndarray, ...]:
        step = np.diff(np.pad(lines, ((0, 0), (0, 0), (1, 1))).astype(np.int8), axis=2)
        tile, row, low = np.nonzero(step == 1)
        return tile, row, low, np.nonzero(step == -1)[2]

    # the borders of a tile's own pixels need one pixel around it, so the window itself is what comes back
    wide = windows(masks, 1, side)

    def run(batches):
        for part in _stacks(batches, (side + 2) ** 2):
            m, (ty, tx) = _unpacked(part.column("mask").to_pylist(), side + 2, side + 2), _numbers(part, "ty", "tx")
            own, oy, ox, found = m[:, 1:-1, 1:-1], ty * side, tx * side, []
            turned = own.transpose(0, 2, 1)
            k, row, low, high = runs(own & ~m[:, :-2, 1:-1])
            found.append((k, low + ox[k], row + oy[k], high + ox[k], row + oy[k]))
            k, row, low, high = runs(own & ~m[:, 2:, 1:-1])
            found.append((k, high + ox[k], row + oy[k] + 1, low + ox[k], row + oy[k] + 1))
            k, column, low, high = runs(turned & ~m[:, 1:-1, :-2].transpose(0, 2, 1))
            found.append((k, column + ox[k], high + oy[k], column + ox[k], low + oy[k]))
            k, column, low, high = runs(turned & ~m[:, 1:-1, 2:].transpose(0, 2, 1))
            found.append((k, column + ox[k] + 1, low + oy[k], column + ox[k] + 1, high + oy[k]))
            k, *ends = (np.concatenate(c) for c in zip(*found))
            yield pa.RecordBatch.from_arrays([part.column("page").take(pa.array(k)), *(pa.array(e.astype(np.int32)) for e in ends)], schema=edges_arrow)

    return wide.mapInArrow(run, edges_schema)


def loops(runs: np.ndarray) -> list[np.ndarray]:
    """Closed paths of directed runs (x0, y0, x1, y1).

    Where two leave a point, because pixels meet at a corner only, that which turns
    left is taken: so a hole that reaches the outside over a corner is still a hole.
    """
    out: dict[tuple, list[int]] = {}
    for i, (x, y, _, _) in enumerate(runs.tolist()):
        out.setdefault((x, y), []).append(i)
    heading = np.sign(runs[:, 2:] - runs[:, :2]).tolist()
    used, found = np.zeros(len(runs), bool), []
    for begin in np.lexsort((runs[:, 0], runs[:, 1])).tolist():
        if used[begin]:
            continue
        path, i = [], begin
        while not used[i]:
            used[i] = True
            x, y, to_x, to_y = runs[i].tolist()
            path.append((x, y))
            ways = [j for j in out[(to_x, to_y)] if not used[j] or j == begin]
            dx, dy = heading[i]
            i = min(ways, key=lambda j: (heading[j] != [dy, -dx], heading[j] != [dx, dy]))
        points = np.array(path)
        straight = np.sign(np.roll(points, -1, 0) - points)
        corner = (straight != np.roll(straight, 1, 0)).any(axis=1)
        found.append(points[corner])
    return found


def signed_area(points: np.ndarray) -> float:
    x, y = points[:, 0].astype(float), points[:, 1].astype(float)
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def simplified(points: np.ndarray, most: int = 180, start: float = 0.001, growth: float = 1.5, end: float = 0.05) -> tuple[np.ndarray, float]:
    """A closed path with at most ``most`` points where the tolerance allows it, and the tolerance.

    No point that is left out lies farther than the tolerance from the piece that
    replaces it. The tolerance starts at a share of the length and grows until the
    budget is met or the last share is reached.
    """
    length = float(np.abs(np.roll(points, -1, 0) - points).sum())
    far = int(((points - points[0]) ** 2).sum(axis=1).argmax())
    share = start
    while True:
        keep = np.zeros(len(points), bool)
        keep[[0, far]] = True
        ring = np.vstack([points, points[:1]]).astype(float)
        todo = [(0, far), (far, len(points))]
        while todo:
            a, b = todo.pop()
            if b - a < 2:
                continue
            p, q, mid = ring[a], ring[b], ring[a + 1 : b]
            d = q - p
            t = np.clip(((mid - p) @ d) / max(d @ d, 1e-12), 0, 1)
            off = np.sqrt(((mid - p - t[:, None] * d) ** 2).sum(axis=1))
            i = int(off.argmax())
            if off[i] > share * length:
                keep[a + 1 + i] = True
                todo += [(a, a + 1 + i), (a + 1 + i, b)]
        if keep.sum() <= most or share >= end:
            return points[keep], share * length
        share = min(share * growth, end)


def outlines(masks: DataFrame, most: int = 180, side: int = SIDE) -> DataFrame:
    """page, points, n_corners, area and tolerance of the outer border of each page of ``masks``, which is one region.

    ``area`` is that within the border before it is simplified.
    """
    page = masks.schema["page"]
    schema, arrow = _form(page, "points array<struct<x:int,y:int>>, n_corners int, area double, tolerance double")

    def trace(group: pa.Table) -> pa.Table:
        runs = np.stack([group.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1")], 1).astype(np.int64)
        outer = max(loops(runs), key=lambda p: (signed_area(p), p.tolist()))
        points, tolerance = simplified(outer, most)
        row = {"page": group.column("page")[0].as_py(), "points": [{"x": int(x), "y": int(y)} for x, y in points], "n_corners": len(outer), "area": signed_area(outer), "tolerance": tolerance}
        return pa.Table.from_pylist([row], arrow)

    return border_runs(masks, side).groupBy("page").applyInArrow(trace, schema)
