"""Graphical scale bars: the drawn bar that belongs to a page's ``N m`` label, or a reason why there is none.

Strokes lie along an axis or not; those along one are clustered by where they
cross the other axis, and what touches within a cluster is one bar. A label meets
the clusters near it by an equi-join over bands of the cross axis. Clusters that lie
in the label's band as a whole bring bars that were merged once for all labels;
only those that its edge cuts are merged anew, from the strokes inside. Of a
label's bars the nearest counts, of equally near ones the longest. Of a page's
labels the first with a bar and a value gives the scale: labels fused with their
value before bare units, the end of a row of ticks before the others, then those
nearest to the lower right corner.

Defined results: pages without a label or without a bar have a null scale and a
reason; pages that only strokes or words name have no row; null coordinates make
no bar; repeated rows change nothing; strokes longer than the border share of the
page are no bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.operators.lineage import stored
from mensura.operators.relational import merge_intervals

# Units of a label, points of distance and share of the page, as they must be for equal results.
FUSED = r"(?i)^(\d{1,4})\s*(m|metres|meters)$"
UNITS = ["m", "metres", "meters"]
NUMBER = r"^\d{1,4}$"
BORDER, NEAR, CLUSTER, GAP, ALIGNED = 0.70, 60, 3, 3, 6.0
#: How wide a band of the cross axis is; as wide as what lies near a label, so that a label is in few.
BAND = 2 * NEAR
NO_LABEL, NO_BAR = "no scale-bar label", "label found but no bar line near it"


def axis_of(kind: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """(axis, cross, lo, hi) of a line or thin rectangle along an axis, else null."""
    w, h = F.abs(x1 - x0), F.abs(y1 - y0)
    along = lambda a, c0, c1, s0, s1: F.struct(F.lit(a).alias("axis"), ((c0 + c1) / 2).alias("cross"), F.least(s0, s1).alias("lo"), F.greatest(s0, s1).alias("hi"))
    flat, upright = along("h", y0, y1, x0, x1), along("v", x0, x1, y0, y1)
    line = F.when((h < 2) & (w > 1), flat).when((w < 2) & (h > 1), upright)
    rect = F.when((w > 0) & (h > 0) & (h >= 3 * w), upright).when((w > 0) & (h > 0) & (w >= 3 * h), flat)
    return F.when(kind == "line", line).when(kind == "rect", rect)


def labels_of(words: DataFrame) -> DataFrame:
    """(page, seq, x, y, tier, value, place) of words that may be labels; a smaller ``place`` is tried first.

    Of two or more fused values in one row or column the largest is the end of the bar.
    """
    value = F.regexp_extract("text", FUSED, 1)
    known = words.select("page", "seq", "x", "y", "text", F.when(value != "", value.cast("int")).alias("value"))
    bare = F.lower("text").isin(UNITS)
    found = known.where("x IS NOT NULL AND y IS NOT NULL").where(F.col("value").isNotNull() | bare)
    found = found.select("page", "seq", "x", "y", F.col("value").isNull().cast("int").alias("tier"), "value").distinct()
    # frames of a distance in points can only be written as SQL
    over = lambda f, c: F.expr(f"{f} OVER (PARTITION BY page, tier ORDER BY CAST({c} AS DOUBLE) RANGE BETWEEN {ALIGNED}D PRECEDING AND {ALIGNED}D FOLLOWING)")
    several = F.greatest(over("count(*)", "y"), over("count(*)", "x")) >= 2
    end = F.greatest(over("max(value)", "y"), over("max(value)", "x"))
    tick = F.col("value").isNotNull() & several
    first = F.when(tick, F.when(F.col("value") == end, 0).otherwise(1)).otherwise(2)
    place = F.struct("tier", first.alias("kind"), F.when(tick, -F.col("value")).otherwise(0).alias("down"), (-(F.col("x") + F.col("y"))).cast("double").alias("corner"), "seq")
    return found.withColumn("place", place)


def _bands(at: Column, before: float) -> Column:
    """A row for each band that holds a place from ``before`` before ``at`` to NEAR after it."""
    return F.explode(F.sequence(F.floor((at - before) / BAND), F.floor((at + NEAR) / BAND)))


def bars_near(labels: DataFrame, strokes: DataFrame) -> DataFrame:
    """(page, seq, axis, low, high, along): every bar near a label, from strokes(page, axis, cross, lo, hi)."""
    by = ["page", "axis", "cluster"]
    pieces = strokes.withColumn("cluster", F.bround(F.col("cross") / CLUSTER, 0).cast("long"))
    runs = merge_intervals(pieces, by, "lo", "hi", GAP).select(*by, "low", "high")
    clusters = pieces.groupBy(*by).agg(F.min("cross").alias("least"), F.max("cross").alias("most")).withColumn("band", F.floor(F.col("least") / BAND))
    ways = F.array(*(F.struct(F.lit(a).alias("axis"), F.col(c).cast("double").alias("at"), F.col(s).cast("double").alias("along")) for a, c, s in (("h", "y", "x"), ("v", "x", "y"))))
    looks = labels.select("page", "seq", F.inline(ways))
    # a cluster is no wider than its step, so its least stroke is in one of two bands, seldom three
    looks = looks.withColumn("band", _bands(F.col("at"), NEAR + CLUSTER))
    met = looks.join(clusters, ["page", "axis", "band"]).where((F.col("least") < F.col("at") + NEAR) & (F.col("most") > F.col("at") - NEAR))
    inside = (F.col("least") > F.col("at") - NEAR) & (F.col("most") < F.col("at") + NEAR)
    met = met.select("page", "seq", "axis", "cluster", "at", "along", inside.alias("inside"))
    cols = ["page", "seq", "axis", "low", "high", "along"]
    whole = met.where("inside").join(runs, by).select(cols)
    cut = met.where("NOT inside").join(pieces, by).where(F.abs(F.col("cross") - F.col("at")) < NEAR)
    part = merge_intervals(cut, ["page", "seq", "axis", "cluster", "along"], "lo", "hi", GAP).select(cols)
    return whole.unionByName(part)


def nearby_numbers(labels: DataFrame, words: DataFrame) -> DataFrame:
    """(page, seq, number): the largest number in the row or the column of each label."""
    numbers = words.where(F.col("text").rlike(NUMBER)).select("page", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("text").cast("int").alias("n"))
    out = None
    for mine, its in (("y", "ny"), ("x", "nx")):
        here = labels.select("page", "seq", F.col(mine).alias("at")).withColumn("band", _bands(F.col("at"), NEAR))
        met = here.join(numbers.withColumn("band", F.floor(F.col(its) / BAND)), ["page", "band"]).where(F.abs(F.col("at") - F.col(its)) < NEAR)
        found = met.groupBy("page", "seq").agg(F.max("n").alias("n"))
        out = found if out is None else out.unionByName(found)
    return out.groupBy("page", "seq").agg(F.max("n").alias("number"))


def scale_bars(pages: DataFrame, strokes: DataFrame, words: DataFrame) -> DataFrame:
    """page, scale (metres a point), bar_m, bar_pt, axis and reason for every page.

    ``pages`` has (page, width, height), ``strokes`` (page, kind, x0, y0, x1, y1) with
    kind line or rect, ``words`` (page, seq, x, y, text) with seq in reading order.
    """
    pages = pages.select("page", "width", "height")
    # as a generator the expression is worked out once, not for each of its fields
    drawn = strokes.select("page", F.inline(F.array(axis_of(*(F.col(c) for c in ("kind", "x0", "y0", "x1", "y1"))))))
    drawn = drawn.where("lo IS NOT NULL AND hi IS NOT NULL AND cross IS NOT NULL").join(pages, "page")
    drawn = drawn.where(F.col("hi") - F.col("lo") <= BORDER * F.when(F.col("axis") == "h", F.col("width")).otherwise(F.col("height"))).drop("width", "height")
    # both are read several times below
    drawn, labels = stored(drawn, "strokes"), stored(labels_of(words), "labels")
    bars = bars_near(labels, drawn)
    low, high, along = F.col("low"), F.col("high"), F.col("along")
    far = F.when(along.between(low, high), 0.0).otherwise(F.least(F.abs(high - along), F.abs(low - along)))
    best = bars.groupBy("page", "seq").agg(F.min(F.struct(F.bround(far, 1).alias("far"), (low - high).cast("double").alias("short"), "axis")).alias("bar"))
    known = labels.join(best, ["page", "seq"], "left").join(nearby_numbers(labels.where("tier = 1"), words), ["page", "seq"], "left")
    known = known.withColumn("bar_m", F.coalesce("value", "number")).withColumn("bar_pt", -F.col("bar.short"))
    usable = F.col("bar_m").isNotNull() & (F.col("bar_pt") > 0)
    chosen = known.groupBy("page").agg(
        F.min(F.when(usable, F.struct("place", F.col("bar_m"), F.col("bar_pt"), F.col("bar.axis").alias("axis")))).alias("c"), F.max(F.col("bar").isNotNull()).alias("near"),
    )
    reason = F.when(F.col("c").isNull(), F.when(F.coalesce("near", F.lit(False)), NO_BAR).otherwise(NO_LABEL))
    scale = F.col("c.bar_m") / F.col("c.bar_pt")
    return pages.select("page").distinct().join(chosen, "page", "left").select("page", scale.alias("scale"), "c.bar_m", "c.bar_pt", "c.axis", reason.alias("reason"))
