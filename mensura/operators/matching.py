"""One-to-one matching of names, and what rectangles cover together."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mensura.operators.lineage import stored


def pair_names(marked: DataFrame, raw: DataFrame, key: str) -> DataFrame:
    """Marked and raw drawings of one key paired one to one.

    Within a key marked ones choose in the order of their case-folded path: the
    free raw one of the highest score, then of the smallest path. Keys that one side
    alone has, or that each side has once, need no choice and no Python; of the
    others a group is a handful of rows, as keys are whole drawing names. Unpaired
    rows of either side are kept.
    """
    both = marked.selectExpr(f"{key} AS k", "path", "'marked' AS side").unionByName(raw.selectExpr(f"{key} AS k", "path", "'raw' AS side"))
    own = lambda side: F.when(F.col("side") == side, F.col("path"))
    counts = both.groupBy("k").agg(F.count(own("marked")).alias("m"), F.count(own("raw")).alias("r"), F.max(own("marked")).alias("marked"), F.max(own("raw")).alias("raw"))
    single = counts.where("m = 1 AND r = 1").select("k", "marked", "raw")
    alone = both.join(counts.where("m = 0 OR r = 0").select("k"), "k", "left_semi").select("k", own("marked").alias("marked"), own("raw").alias("raw"))
    contested = both.join(counts.where("m > 0 AND r > 0 AND m + r > 2").select("k"), "k", "left_semi")

    def pair(group: pd.DataFrame) -> pd.DataFrame:
        left = sorted(group[group.side == "marked"].path, key=lambda p: (p.casefold(), p))
        free = sorted(group[group.side == "raw"].path)
        rows = []
        for m in left:
            best = max(free, key=lambda r: (pair_score(m, r), [-ord(c) for c in r]), default=None)
            if best is not None:
                free.remove(best)
            rows.append((group.k.iloc[0], m, best))
        rows += [(group.k.iloc[0], None, r) for r in free]
        return pd.DataFrame(rows, columns=["k", "marked", "raw"])

    return single.unionByName(alone).unionByName(contested.groupBy("k").applyInPandas(pair, "k string, marked string, raw string"))


# Names of folders that hold unmarked copies.
RAW_FOLDERS = ("_stripped", "stripped", "raw", "unmarked")


def pair_score(marked: str, raw: str) -> int:
    """Equal names count most, then a raw drawing whose own folder says so, then the same folder; names of different length count against."""
    (folder, name), (raw_folder, raw_name) = (p.rpartition("/")[::2] for p in (marked, raw))
    stem = lambda n: len(n.rpartition(".")[0] or n)
    points = {100: name.casefold() == raw_name.casefold(), 40: raw_folder.rpartition("/")[2].casefold() in RAW_FOLDERS, 10: folder == raw_folder}
    return sum(p for p, holds in points.items() if holds) - abs(stem(name) - stem(raw_name))


def _iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w = np.maximum(0, np.minimum(a[2], b[:, 2]) - np.maximum(a[0], b[:, 0]))
    h = np.maximum(0, np.minimum(a[3], b[:, 3]) - np.maximum(a[1], b[:, 1]))
    size = lambda r: (r[..., 2] - r[..., 0]) * (r[..., 3] - r[..., 1])
    union = size(a) + size(b) - w * h
    return np.where(union > 0, w * h / np.where(union > 0, union, 1), 0.0)


def drop_overlapping(boxes: DataFrame, page: str, threshold: float = 0.9) -> DataFrame:
    """Boxes of a page (id, x0, y0, x1, y1, rank) kept greedily by rank, then area, unless they nearly equal a kept one."""

    def keep(group: pd.DataFrame) -> pd.DataFrame:
        area = (group.x1 - group.x0) * (group.y1 - group.y0)
        ordered = group.assign(_a=-area).sort_values(["rank", "_a", "id"])
        kept: list[int] = []
        r = ordered[["x0", "y0", "x1", "y1"]].to_numpy(float)
        for i in range(len(r)):
            if not kept or (_iou(r[i], r[kept]) < threshold).all():
                kept.append(i)
        return ordered.iloc[kept][[page, "id"]]

    return boxes.groupBy(page).applyInPandas(keep, f"{page} {dict(boxes.dtypes)[page]}, id {dict(boxes.dtypes)['id']}")


#: Rectangles of a cell that are swept together, and how often a cell that holds more is quartered.
SWEPT, QUARTERED = 500, 24


def _clipped(parts: DataFrame, step: Column) -> DataFrame:
    """Rectangles cut at the cells of width ``step``, each once a cell, with ``whole`` where it is the cell itself."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / step), F.greatest(F.floor(F.col(lo) / step), F.ceil(F.col(hi) / step) - 1)))
    parts = parts.withColumn("cx", span("x0", "x1")).withColumn("cy", span("y0", "y1"))
    for c, at in (("x", "cx"), ("y", "cy")):
        parts = parts.withColumn(f"{c}0", F.greatest(F.col(f"{c}0"), F.col(at) * step)).withColumn(f"{c}1", F.least(F.col(f"{c}1"), (F.col(at) + 1) * step))
    whole = (F.col("x0") == F.col("cx") * step) & (F.col("x1") == (F.col("cx") + 1) * step) & (F.col("y0") == F.col("cy") * step) & (F.col("y1") == (F.col("cy") + 1) * step)
    return parts.select("key", "cx", "cy", "x0", "y0", "x1", "y1", whole.alias("whole")).distinct()


def union_area(boxes: DataFrame, key: str, cell: float | None = None) -> DataFrame:
    """The area that rectangles of a key cover together, and their plain sum.

    Rectangles are clipped to the cells of a grid, by default at least twice as wide as
    they are on average, so that no step grows with all rectangles of a key. A cell that
    one of them fills is done; one that holds many is quartered, and so on, so that
    a task never sweeps a crowd. In a cell the edges cut strips, and what is covered of a
    strip is summed from the lowest rectangle up, by how far each reaches beyond
    those before it. Cells are powers of two wide, so sums of whole numbers stay exact.
    """
    rows = boxes.select(F.col(key).alias("key"), "x0", "y0", "x1", "y1")
    finite = [~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")) for c in ("x0", "y0", "x1", "y1")]
    sound = rows.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    for f in finite:
        sound = sound.where(f)
    if cell is None:
        side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).cast("double")
        cell = 2.0 ** math.ceil(math.log2(2 * (sound.agg(F.avg(side)).first()[0] or 1.0)))
    by, corners = ["key", "cx", "cy"], ["x0", "y0", "x1", "y1"]
    swept, filled, step = [], [], float(cell)
    parts = stored(_clipped(sound.select("key", *(F.col(c).cast("double").alias(c) for c in corners)), F.lit(step)), "parts")
    for turn in range(QUARTERED + 1):
        cells = stored(parts.groupBy(*by).agg(F.count("*").alias("n"), F.max("whole").alias("filled")), "cells")
        filled.append(cells.where("filled").select("key", F.lit(step * step).alias("area")))
        few = cells.where("NOT filled" if turn == QUARTERED else f"NOT filled AND n <= {SWEPT}")
        swept.append(parts.join(few.select(*by), by).select(F.lit(turn).alias("turn"), *by, *corners))
        crowded = cells.where(f"NOT filled AND n > {SWEPT}")
        if turn == QUARTERED or crowded.isEmpty():
            break
        step /= 2
        parts = stored(_clipped(parts.join(crowded.select(*by), by).select("key", *corners), F.lit(step)), "parts")
    parts, by = reduce(DataFrame.unionByName, swept), ["turn", *by]
    edges = parts.select(*by, F.explode(F.array("x0", "x1")).alias("left")).distinct()
    strips = edges.withColumn("right", F.lead("left").over(Window.partitionBy(*by).orderBy("left"))).where("right IS NOT NULL")
    met = strips.join(parts, by).where("x0 <= left AND x1 >= right")
    below = F.max("y1").over(Window.partitionBy(*by, "left").orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1))
    covered = met.withColumn("below", below)
    more = F.greatest(F.lit(0.0), F.col("y1") - F.greatest(F.col("y0"), F.coalesce("below", "y0")))
    areas = reduce(DataFrame.unionByName, [covered.select("key", ((F.col("right") - F.col("left")) * more).alias("area")), *filled])
    area = areas.groupBy("key").agg(F.sum("area").alias("area"))
    total = rows.select("key").distinct().join(sound.groupBy("key").agg(F.sum(((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).cast("double")).alias("total")), "key", "left")
    met = total.join(area, "key", "left").select("key", F.coalesce("area", F.lit(0.0)).alias("area"), F.coalesce("total", F.lit(0.0)).alias("total"))
    return met.withColumn("overlaps", F.col("area") < 0.999 * F.col("total"))
