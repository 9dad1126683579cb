"""Spatial joins of boxes and greedy suppression of those that cover nearly the same.

Boxes are (group, id, x0, y0, x1, y1); groups, as pages, don't meet. A box belongs to
the level of a grid whose cells are as large as it is, so it touches few cells of
its own level and of all coarser ones. The smaller box of a pair looks for the larger one
in the cells of the larger one's level; a pair counts in one cell only, that of the
lower corner of what the two share. Sizes may differ as they will, and no cell
holds a box that is much smaller than the cell without also being looked for there.

Defined results: boxes without a positive width and height, and those with null
coordinates, ids or groups, overlap nothing; boxes that only touch don't overlap;
rows that share an id within a group are separate boxes of equal name.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mensura.operators.lineage import components, small, spread, stored

#: Conflicts of a component that one task decides; larger components are decided by rounds over the whole table.
COMPONENT = 100_000
ROUNDS = 8
#: About how many boxes of one crowded group a task decides in a round, never more than 20 times as many, and most rounds.
CROWD, PEELS = 1_000, 12
#: Boxes of a cell that smaller ones meet at once, and blocks of them in one task.
BLOCK, PART = 1_024, 8


def shared_area(a: str, b: str) -> Column:
    """The area that two boxes share, of columns with the prefixes ``a`` and ``b``."""
    side = lambda lo, hi: F.least(f"{a}{hi}", f"{b}{hi}") - F.greatest(f"{a}{lo}", f"{b}{lo}")
    w, h = side("x0", "x1"), side("y0", "y1")
    return F.when((w > 0) & (h > 0), w * h).otherwise(w * 0)


def area(a: str = "") -> Column:
    return (F.col(f"{a}x1") - F.col(f"{a}x0")) * (F.col(f"{a}y1") - F.col(f"{a}y0"))


def _sound(boxes: DataFrame) -> DataFrame:
    return boxes.where("group IS NOT NULL AND id IS NOT NULL AND x1 > x0 AND y1 > y0")


def _cells(boxes: DataFrame, step: Column) -> DataFrame:
    """A row for each cell of width ``step`` that a box touches."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / step), F.ceil(F.col(hi) / step) - 1)
    return boxes.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))


def overlaps(boxes: DataFrame, least: float | None = None, base: float = 1.0) -> DataFrame:
    """(group, a, b, shared, united): pairs of boxes whose shared area is above 0, or at least ``least`` of the united one.

    ``base`` is the width of the finest cells. a and b are ids; each pair comes once, and
    pairs of rows that share an id count too. Larger boxes of a cell meet smaller ones in
    blocks of boxes that lie close, in the order of their ids, which are opened last: pairs then
    lie in long runs that files hold in few bytes, and nothing of a pair is shuffled.
    """
    cols = ["x0", "y0", "x1", "y1"]
    rows = _sound(boxes).select("group", "id", *cols)
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).cast("double")
    rows = rows.withColumn("level", F.greatest(F.lit(0), F.ceil(F.log2(side / base))).cast("int"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "boxes")
    step = F.lit(base) * F.pow(F.lit(2.0), F.col("at_level"))
    levels = sorted(r["level"] for r in rows.select("level").distinct().collect())  # powers of two, so a few dozen
    reach = math.ceil(math.log2(1 / least)) + 1 if least else None  # sides of a pair may differ by the factor 1 / least at most
    at = F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")
    near = lambda large, few: (large >= few) & (large <= few + reach) if least else large >= few
    starts = lambda c, lo: (F.floor(F.col(lo) / step) == F.col(c)).alias(f"starts_{c}")

    cell = ["at_level", "group", "cx", "cy"]
    own = _cells(rows.withColumn("at_level", F.col("level")), step)
    # an order without ties, so that a block is the same one whenever its task is run again
    order = [*cell, *cols, "id", "row"]
    own = own.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.expr(f"monotonically_increasing_id() div {BLOCK}"))
    inside = F.sort_array(F.collect_list(F.struct("id", "row", *cols, starts("cx", "x0"), starts("cy", "y0"))))
    blocks = stored(own.groupBy(*cell, "part").agg(inside.alias("block")).withColumn("part", F.expr(f"part div {PART}")), "blocks")
    looks = _cells(rows.withColumn("at_level", F.explode(F.filter(at, lambda x: near(x, F.col("level"))))), step)
    looks = looks.join(small(stored(blocks.select(*cell, "part").distinct(), "parts")), cell)
    name = lambda p, get: [get(c).alias(f"{p}{c}") for c in ("row", "id", *cols, "starts_cx", "starts_cy")]
    # levels come first, so that a task lists pairs of like sizes together
    keys = ["at_level", "level", "group", "cx", "cy", "part"]
    looks = spread(looks.select("*", starts("cx", "x0"), starts("cy", "y0")).select(*keys, *name("a_", F.col)), *keys)
    blocks = spread(blocks.withColumn("level", F.explode(F.filter(at, lambda x: near(F.col("at_level"), x)))), *keys)
    # the left side of a merge join is the outer loop
    met = blocks.hint("merge").join(looks, keys).withColumn("b", F.explode("block"))
    met = met.select("group", "level", "at_level", *(f"a_{c}" for c in ("row", "id", *cols, "starts_cx", "starts_cy")), *name("b_", lambda c: F.col(f"b.{c}")))
    first = (F.col("level") < F.col("at_level")) | (F.col("a_row") < F.col("b_row"))
    # both boxes touch the cell, so the lower corner of what they share lies in it if one of them starts there
    met = met.where(first & (F.col("a_starts_cx") | F.col("b_starts_cx")) & (F.col("a_starts_cy") | F.col("b_starts_cy")))
    met = met.withColumn("shared", shared_area("a_", "b_")).where("shared > 0")
    met = met.withColumn("united", area("a_") + area("b_") - F.col("shared"))
    if least:
        met = met.where(F.col("shared") >= F.col("united") * least)
    return met.select("group", F.col("a_id").alias("a"), F.col("b_id").alias("b"), "a_row", "b_row", "shared", "united")


def _greedy(frame: pd.DataFrame) -> pd.DataFrame:
    """Kept rows of one component's conflicts, decided in the order of places."""
    order = np.unique(np.concatenate([frame.better.to_numpy(), frame.worse.to_numpy()]))
    frame = frame.sort_values("better")
    ends = np.searchsorted(frame.better.to_numpy(), order, "right")
    begins = np.searchsorted(frame.better.to_numpy(), order, "left")
    worse = np.searchsorted(order, frame.worse.to_numpy())
    gone = np.zeros(len(order), bool)
    for i in range(len(order)):
        if not gone[i]:
            gone[worse[begins[i] : ends[i]]] = True
    return pd.DataFrame({"place": order, "kept": ~gone})


def greedy_kept(conflicts: DataFrame, most: int | None = None) -> DataFrame:
    """(place, kept) of every place in conflicts(better, worse), where better < worse.

    In the order of places a row is kept unless one that is kept is in conflict
    with it. Components of few conflicts are decided each in one task. In larger
    ones rounds keep the rows without an open better one and drop their conflicts,
    which leaves smaller components, and so on.
    """
    most = COMPONENT if most is None else most
    spark = conflicts.sparkSession
    kind = conflicts.schema["better"].dataType
    schema = T.StructType([T.StructField("place", kind), T.StructField("kept", T.BooleanType())])
    open_, out = stored(conflicts.select("better", "worse").distinct(), "conflicts"), spark.createDataFrame([], schema)
    while not open_.isEmpty():
        places = open_.select(F.explode(F.array("better", "worse")).alias("node")).distinct()
        where = components(places, open_.select(F.col("better").alias("a"), F.col("worse").alias("b")))
        of = stored(open_.hint("merge").join(where.select(F.col("node").alias("better"), "component"), "better"))
        sizes = of.groupBy("component").agg(F.count("*").alias("n"))
        large = stored(sizes.where(F.col("n") > most).select("component"))
        crowd = small(large)
        solved = spread(of.join(crowd, "component", "left_anti"), "component").groupBy("component").applyInPandas(_greedy, schema)
        out = out.unionByName(stored(solved, "kept"))
        open_ = stored(of.join(crowd, "component", "left_semi").select("better", "worse"))
        for _ in range(ROUNDS):
            if open_.isEmpty():
                break
            beaten = open_.select(F.col("worse").alias("place")).distinct()
            keep = stored(open_.select(F.col("better").alias("place")).distinct().join(beaten, "place", "left_anti"))
            drop = stored(open_.join(keep.withColumnRenamed("place", "better"), "better", "left_semi").select(F.col("worse").alias("place")).distinct())
            rest = open_
            for c in ("better", "worse"):
                rest = rest.join(drop.withColumnRenamed("place", c), c, "left_anti").join(keep.withColumnRenamed("place", c), c, "left_anti")
            rest = stored(rest)
            # a row whose better ones are all dropped, and with nothing left in conflict, is kept
            ends = open_.select(F.explode(F.array("better", "worse")).alias("place")).distinct().join(drop, "place", "left_anti").join(keep, "place", "left_anti")
            free = ends.join(rest.select(F.explode(F.array("better", "worse")).alias("place")).distinct(), "place", "left_anti")
            yes = keep.unionByName(free).withColumn("kept", F.lit(True))
            out = out.unionByName(stored(yes.unionByName(drop.withColumn("kept", F.lit(False))), "kept"))
            open_ = rest
    return out


def numbered(rows: DataFrame, order: list, name: str = "number") -> DataFrame:
    """``rows`` with their number from 0 in the given order: ranges are sorted apart and moved by the sizes of those before."""
    spark = rows.sparkSession
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    placed = stored(placed, "sorted")
    counts = sorted((r["__part"], r["low"], r["n"]) for r in placed.groupBy("__part").agg(F.min("__at").alias("low"), F.count("*").alias("n")).collect())
    before, total = [], 0
    for part, low, n in counts:
        before.append((part, total - low))
        total += n
    shift = spark.createDataFrame(before, "__part int, __shift long")
    return placed.join(F.broadcast(shift), "__part").withColumn(name, F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")


def _first_kept(group: pd.DataFrame, least: float) -> pd.DataFrame:
    """The boxes of a bounded group that stay, in the order of their numbers."""
    group = group.sort_values("__number")
    box = group[["x0", "y0", "x1", "y1"]].to_numpy()
    size, live, kept = (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1]), np.ones(len(box), bool), []
    for i in range(len(box)):
        if live[i]:
            kept.append(i)
            w, h = (np.minimum(box[i, k + 2], box[i:, k + 2]) - np.maximum(box[i, k], box[i:, k]) for k in (0, 1))
            shared = np.where((w > 0) & (h > 0), w * h, 0)
            live[i:] &= ~((shared > 0) & (shared >= (size[i] + size[i:] - shared) * least))
    return group.iloc[kept]


def _peeled(single: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(kept, open) of numbered boxes: in rounds the first CROWD of each crowded group are decided, and what they cover is left out.

    So pairs of boxes that nearly all cover one another are never listed. Groups of
    few boxes, and what is left when rounds leave out little, stay open.
    """
    spark = single.sparkSession
    kept, open_ = spark.createDataFrame([], single.schema), single
    for _ in range(PEELS):
        sizes = open_.groupBy("group").agg(F.count("*").alias("n"))
        crowded = stored(sizes.where(F.col("n") > CROWD), "crowded")
        before = crowded.agg(F.sum("n")).first()[0]
        if not before:
            break
        share = F.col("n").cast("double")
        # any bound on the number is exact; this one lets about CROWD of a group in
        first = stored(open_.join(small(crowded), "group").groupBy("group").agg(F.min("__number").alias("low"), F.max("__number").alias("high"), F.max(share).alias("n")), "bounds")
        step = F.ceil((F.col("high") - F.col("low") + 1) * CROWD / F.col("n")).cast("long")
        bounds = first.select("group", (F.col("low") + F.least(step, F.lit(20 * CROWD))).alias("bound"))
        head = open_.join(small(stored(bounds, "bounds")), "group")
        names = single.columns
        done = stored(head.where("__number < bound").select(names).groupBy("group").applyInPandas(lambda g: _first_kept(g, least), single.schema), "kept")
        kept = kept.unionByName(done)
        over = done.select("group", *(F.col(c).alias(f"k_{c}") for c in ("x0", "y0", "x1", "y1")))
        rest = open_.join(small(stored(bounds, "bounds")), "group", "left").where("bound IS NULL OR __number >= bound").select(*(F.col(c).alias(c if c == "group" else f"o_{c}") for c in names))
        shared = shared_area("o_", "k_")
        covers = (over["group"] == rest["group"]) & (shared > 0) & (shared >= (area("o_") + area("k_") - shared) * least)
        rest = rest.join(small(over), covers, "left_anti").select(*(F.col(c if c == "group" else f"o_{c}").alias(c) for c in names))
        open_ = stored(rest, "open")
        left = open_.join(small(crowded.select("group")), "group", "left_semi").count()
        if left > 0.9 * before:
            break
    return kept, open_


def without_overlapping(boxes: DataFrame, order: list, least: float, base: float = 1.0) -> DataFrame:
    """The rows of ``boxes`` that stay: in the order of each group, those that share less than ``least`` of the
    united area with every one that stays before them; ties of the order go by id, boxes without an area stay.

    Of rows with equal corners all but the first are left out beforehand: what lets the first stay
    leaves them out, and what leaves the first out does so with them.
    """
    rows = stored(boxes.withColumn("__row", F.monotonically_increasing_id()), "boxes")
    sound = _sound(rows)
    twin = Window.partitionBy("group", "x0", "y0", "x1", "y1").orderBy(*order, "id", "__row")
    single = sound.withColumn("__twin", F.row_number().over(twin)).where("__twin = 1").drop("__twin")
    single = stored(numbered(single, ["group", *order, "id", "__row"], "__number"), "singles")
    first, open_ = _peeled(single, least) if least > 0 else (single.limit(0), single)
    pairs = overlaps(open_.select("group", F.col("__number").alias("id"), "x0", "y0", "x1", "y1"), least, base)
    decided = greedy_kept(pairs.select(F.least("a", "b").alias("better"), F.greatest("a", "b").alias("worse")))
    gone = stored(decided.where("NOT kept").select(F.col("place").alias("__number")), "gone")
    kept = first.unionByName(open_.join(small(gone), "__number", "left_anti").select(first.columns))
    odd = rows.join(sound.select("__row"), "__row", "left_anti")
    return kept.select(*boxes.columns).unionByName(odd.select(*boxes.columns))
