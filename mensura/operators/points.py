"""Nearest neighbours and density groups of points, exactly, over grids that grow until the answer is certain.

Points are (group, id, x, y); groups, as pages, don't meet. A point first looks into
the nine cells around it; what it finds within one cell's width can't be beaten by
anything farther away, and is settled. The others look again in cells twice as wide,
so only lonely points ever look far.

Defined results: points without a group, id or finite place are left out; a point
never is its own neighbour, another of its place is, at distance 0; ties go to the
smaller id; a point alone in its group has no neighbour and a null distance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.operators.lineage import components, stored


def _sound(points: DataFrame) -> DataFrame:
    finite = lambda c: F.coalesce(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.lit(False))
    return points.select("group", "id", "x", "y").where(F.col("group").isNotNull() & F.col("id").isNotNull() & finite("x") & finite("y"))


def _around(points: DataFrame, step: float) -> DataFrame:
    """A row for each of the nine cells around a point, as (qid, qx, qy)."""
    span = lambda c: F.explode(F.sequence(F.floor(F.col(c) / step) - 1, F.floor(F.col(c) / step) + 1))
    return points.select("group", F.col("id").alias("qid"), F.col("x").alias("qx"), F.col("y").alias("qy")).withColumn("cx", span("qx")).withColumn("cy", span("qy"))


def _squared():
    return (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy"))


def nearest_neighbours(points: DataFrame, base: float) -> DataFrame:
    """group, id, neighbour and squared distance of every point; ``base`` is the width of the first cells."""
    rows = stored(_sound(points), "points")
    extent = rows.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    open_, out, step = rows, None, float(base)
    while True:
        last = step >= max(float(extent[0] or 0), float(extent[1] or 0))
        cells = rows.withColumn("cx", F.floor(F.col("x") / step)).withColumn("cy", F.floor(F.col("y") / step))
        met = _around(open_, step).join(cells, ["group", "cx", "cy"]).where("id <> qid").withColumn("d2", _squared())
        best = met.groupBy("group", "qid").agg(F.min(F.struct("d2", "id")).alias("b"))
        found = stored(open_.join(best.withColumnRenamed("qid", "id"), ["group", "id"], "left"), "nearest")
        sure = F.coalesce(F.col("b.d2") <= step * step, F.lit(False)) | F.lit(last)
        done = found.where(sure).select("group", "id", F.col("b.id").alias("neighbour"), F.col("b.d2").alias("d2"))
        out = done if out is None else out.unionByName(done)
        open_ = found.where(~sure).select("group", "id", "x", "y")
        if last or open_.isEmpty():
            return out
        step *= 2


def density_groups(points: DataFrame, reach: float, least: int) -> DataFrame:
    """group, id, dense and cluster: dense points have ``least`` others within ``reach``; those within reach of one another are one
    cluster, named by its least id, and others belong to that of the nearest dense point in reach, or to none. Ids are whole numbers, unique over all groups."""
    rows = stored(_sound(points), "points")
    cells = rows.withColumn("cx", F.floor(F.col("x") / reach)).withColumn("cy", F.floor(F.col("y") / reach))
    pairs = _around(rows, reach).join(cells, ["group", "cx", "cy"]).where("id <> qid").withColumn("d2", _squared()).where(F.col("d2") <= reach * reach)
    counts = stored(pairs.groupBy("group", "qid").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("group", F.col("qid").alias("id")), "dense")
    # each dense point is linked with its dense neighbours only
    dense_pairs = pairs.join(counts, ["group", "id"], "left_semi")
    edges = dense_pairs.join(counts.withColumnRenamed("id", "qid"), ["group", "qid"], "left_semi").where("qid < id").select(F.col("qid").alias("a"), F.col("id").alias("b"))
    clusters = stored(components(counts, edges, "id").withColumnRenamed("component", "cluster"), "clusters")
    near = dense_pairs.join(counts.withColumnRenamed("id", "qid"), ["group", "qid"], "left_anti").groupBy("group", F.col("qid").alias("of")).agg(F.min(F.struct("d2", "id")).alias("b"))
    edge = near.select("group", F.col("of"), F.col("b.id").alias("id")).join(clusters, ["group", "id"]).select("group", F.col("of").alias("id"), "cluster")
    known = clusters.select("group", "id", "cluster", F.lit(True).alias("dense")).unionByName(edge.withColumn("dense", F.lit(False)))
    return rows.select("group", "id").join(known, ["group", "id"], "left").select("group", "id", F.coalesce("dense", F.lit(False)).alias("dense"), "cluster")
