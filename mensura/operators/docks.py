"""Dock zones and retaining walls from drawn segments: evidence that agrees, or a refusal with its reason.

Segments are (page, seq, orientation, a0, a1, p0, p1, grey, tones): they run from a0
to a1 along their own axis and lie between p0 and p1 on the other; seq is the order in
which they were drawn. Pages are (page, k, target) with k metres a point and the mean
tone of the yard. Every step is a join of few rows with the segments of their page
that lie within a reach, over bands of that reach on the other axis, so no page is
compared with itself as a whole.

Defined results: pages without evidence, with ambiguous or competing evidence have no
zone and a reason; null coordinates, scales of 0 or below and repeated rows bring
nothing more; rows of pages that aren't in ``pages`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.operators.lineage import small, stored
from mensura.operators.spatial import greedy_kept, numbered, without_overlapping

# The sizes that tell dock doors, their walls and the yard's edge, in metres, as they must be for equal results.
DOOR_DEPTH, DOORS, FACE = (2.5, 3.7), 8, 20
END_RATIO, END_REACH, CLEAR = (0.8, 1.7), 1.5, 0.15
EDGE_REACH, EDGE_SHARE, TONE = (0.05, 1.0), 0.8, 14
WALL_RATIO, WALL_REACH, WALL_LIKE = (0.8, 1.5), 1.5, 1.05
DOCK_DEPTH, SAME = (3.4, 4.6), 0.8
WALL_LEAST, WALL_NEAR, WALL_COVER, RIVAL, SAMPLES = 20, 1.0, 0.9, 0.95, 9
NO_FAMILY = "no unique repeated dock-door family adjacent to the yard"
FAMILY = ["page", "orientation", "r0", "r1"]


def families(segments: DataFrame, pages: DataFrame) -> DataFrame:
    """Repeated grey segments of a door's depth that begin and end alike: at least DOORS places over at least FACE metres."""
    door = segments.where("grey").join(pages, "page").where((F.col("a1") - F.col("a0")) * F.col("k") >= DOOR_DEPTH[0]).where((F.col("a1") - F.col("a0")) * F.col("k") <= DOOR_DEPTH[1])
    door = door.withColumn("r0", F.bround("a0", 1)).withColumn("r1", F.bround("a1", 1)).withColumn("at", F.bround((F.col("p0") + F.col("p1")) / 2, 2))
    found = door.groupBy(*FAMILY).agg(
        F.min_by(F.struct("a0", "a1"), "seq").alias("own"), F.min("seq").alias("seq"), F.count_distinct("at").alias("doors"),
        F.min("at").alias("face0"), F.max("at").alias("face1"), F.max("k").alias("k"), F.max("target").alias("target"),
    )
    found = found.where(F.col("doors") >= DOORS).withColumn("face", (F.col("face1") - F.col("face0")) * F.col("k")).where(F.col("face") >= FACE)
    return found.select(*FAMILY, "own.*", "seq", "doors", "face0", "face1", "face", "k", "target")


def beside(found: DataFrame, segments: DataFrame, at: str, reach: float) -> DataFrame:
    """``found`` with the segments across it (length, middle, seq, tones) whose middle is within ``reach`` metres of its column ``at``."""
    across = F.when(F.col("orientation") == "H", "V").otherwise("H")
    middle = (F.col("p0") + F.col("p1")) / 2
    lie = segments.select("page", F.col("orientation").alias("across"), (F.col("a1") - F.col("a0")).alias("length"), middle.alias("middle"), F.col("a0").alias("w0"), F.col("a1").alias("w1"), F.col("seq").alias("wall_seq"), "tones")
    scales = found.select("page", "k").distinct()  # of pages with a family only
    lie = lie.join(scales, "page").withColumn("band", F.floor(F.col("middle") * F.col("k") / reach)).drop("k")
    band = F.floor(F.col(at) * F.col("k") / reach)
    look = found.withColumn("across", across).withColumn("band", F.explode(F.sequence(band - 1, band + 1)))
    met = look.join(lie, ["page", "across", "band"]).where(F.abs(F.col("middle") - F.col(at)) * F.col("k") <= reach)
    return met.drop("across", "band")


def _ratio() -> Column:
    return F.col("length") / F.greatest(F.col("face1") - F.col("face0"), F.lit(1e-9))


def _sided(found: DataFrame, segments: DataFrame) -> DataFrame:
    """Families of which one end alone, or more clearly, lies at a wall: near and far end and which way is out."""
    ends = found.select("*", F.posexplode(F.array("a0", "a1")).alias("end", "edge"))
    walls = beside(ends, segments, "edge", END_REACH).where(_ratio().between(*END_RATIO))
    far = walls.groupBy(*FAMILY, "end").agg(F.min(F.abs(F.col("middle") - F.col("edge")) * F.col("k")).alias("d"))
    both = far.groupBy(*FAMILY).agg(F.min(F.when(F.col("end") == 0, F.col("d"))).alias("d0"), F.min(F.when(F.col("end") == 1, F.col("d"))).alias("d1"))
    first = F.col("d1").isNull() | (F.col("d0") + CLEAR < F.col("d1"))
    second = F.col("d0").isNull() | (F.col("d1") + CLEAR < F.col("d0"))
    way = F.when(first, -1).when(second, 1)
    met = found.join(both.withColumn("way", way).where("way IS NOT NULL"), FAMILY)
    near, other = F.when(F.col("way") == -1, F.col("a0")).otherwise(F.col("a1")), F.when(F.col("way") == -1, F.col("a1")).otherwise(F.col("a0"))
    return met.withColumn("near", near).withColumn("far", other).drop("d0", "d1")


def _edged(found: DataFrame, segments: DataFrame) -> DataFrame:
    """The families with the yard's edge: the longest segment of the yard's tone a little way out of the near end."""
    out = (F.col("middle") - F.col("near")) * F.col("way") * F.col("k")
    tone = F.array_min(F.transform("tones", lambda x: F.abs(x - F.col("target"))))
    some = beside(found, segments, "near", END_REACH).where(out.between(*EDGE_REACH) & (F.col("length") * F.col("k") >= EDGE_SHARE * F.col("face")) & (tone <= TONE))
    edge = some.groupBy(*FAMILY).agg(F.max_by("middle", F.struct("length", -F.col("wall_seq"))).alias("edge"))
    return found.join(edge, FAMILY)


def dock_candidates(segments: DataFrame, pages: DataFrame, found: DataFrame) -> DataFrame:
    """Every dock that doors, a wall and the yard's edge agree on, with its rectangle (group, id, x0, y0, x1, y1) and score."""
    edged = _edged(_sided(found, segments), segments)
    away = F.abs(F.col("middle") - F.col("edge")) * F.col("k")
    walls = beside(edged, segments, "edge", WALL_REACH).where(_ratio().between(*WALL_RATIO))
    best = walls.groupBy(*FAMILY).agg(F.min_by(F.struct("w0", "w1", "middle"), F.struct((away + F.abs(_ratio() - WALL_LIKE)).alias("s"), "wall_seq")).alias("wall"))
    met = edged.join(best, FAMILY)
    gap = F.abs(F.col("edge") - F.col("near"))
    depth = (F.abs(F.col("far") - F.col("near")) + 2 * gap) * F.col("k")
    met = met.withColumn("depth", depth).withColumn("run", (F.col("wall.w1") - F.col("wall.w0")) * F.col("k"))
    met = met.where(F.col("depth").between(*DOCK_DEPTH) & (F.col("run") >= FACE)).withColumn("back", F.col("far") - F.col("way") * gap)
    low, high, flat = F.least("edge", "back"), F.greatest("edge", "back"), F.col("orientation") == "H"
    side = lambda own, wall: F.when(flat, own).otherwise(wall)
    return met.select(
        F.col("page").alias("group"), F.col("seq").alias("id"), side(low, F.col("wall.w0")).alias("x0"), side(F.col("wall.w0"), low).alias("y0"),
        side(high, F.col("wall.w1")).alias("x1"), side(F.col("wall.w1"), high).alias("y1"), "doors", "depth", "run",
        (F.abs(F.col("far") - F.col("near")) * F.col("k")).alias("door_depth"), (F.col("doors") * F.col("run")).alias("score"), F.col("wall.middle").alias("face_at"),
    )


def dock_zones(segments: DataFrame, pages: DataFrame) -> DataFrame:
    """page, area_m2, dock_depth_m, door_depth_m, loading_face_lm, doors, corners, evidence_seen and reason of every page."""
    pages = pages.select("page", "k", "target")
    found = stored(families(segments, pages.where("k > 0")), "families")
    docks = dock_candidates(segments, pages, found)
    single = without_overlapping(docks, [F.desc("score")], SAME, base=64.0)
    by = single.groupBy(F.col("group").alias("page")).agg(F.count("*").alias("n"), F.min_by(F.struct("x0", "y0", "x1", "y1", "doors", "depth", "door_depth", "run"), "id").alias("d"))
    seen = found.select("page").distinct().withColumn("seen", F.lit(True))
    met = pages.select("page").distinct().join(by, "page", "left").join(seen, "page", "left").withColumn("d", F.when(F.col("n") == 1, F.col("d")))
    reason = F.when(F.col("n").isNull(), NO_FAMILY).when(F.col("n") > 1, F.concat(F.col("n").cast("string"), F.lit(" competing dock-door families")))
    return met.select(
        "page", F.bround(F.col("d.run") * F.col("d.depth"), 1).alias("area_m2"), F.bround("d.depth", 3).alias("dock_depth_m"), F.bround("d.door_depth", 3).alias("door_depth_m"),
        F.bround("d.run", 2).alias("loading_face_lm"), "d.doors", "d.x0", "d.y0", "d.x1", "d.y1", F.coalesce("seen", F.lit(False)).alias("evidence_seen"), reason.alias("reason"),
    )


NO_SCALE, NO_WALL = "Yard outline or scale is missing", "No native non-diagonal CAD wall remained within 1.00 m of the complete Yard-edge run"
UNSUPPORTED, RIVALS = "Yard-edge lines have no light stroke or repeated path", "Competing yard-edge runs are within 5% length of one another"
CELL = 8.0


def _near_edge(walls: DataFrame, edges: DataFrame) -> DataFrame:
    """Walls (with k) of which every sample lies near the outline; worst and mean distance in metres."""
    at = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * F.col("i") / (SAMPLES - 1)
    samples = walls.select("page", "wall", "k", "x0", "y0", "x1", "y1", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES - 1))).alias("i"))
    samples = samples.select("page", "wall", "k", "i", at("x0", "x1").alias("x"), at("y0", "y1").alias("y"))
    cell = lambda c: F.floor(c * F.col("k") / CELL)
    samples = samples.withColumn("cx", cell(F.col("x"))).withColumn("cy", cell(F.col("y")))
    reach = WALL_NEAR / F.col("k")
    span = lambda a, b: F.explode(F.sequence(cell(F.least(a, b) - reach), cell(F.greatest(a, b) + reach)))
    lie = edges.withColumn("cx", span("ex0", "ex1")).withColumn("cy", span("ey0", "ey1")).drop("k")
    # hints: outlines are a few bytes in their plan but many cells, and no table that grows with pages goes through the driver
    met = samples.hint("merge").join(lie, ["page", "cx", "cy"])
    dx, dy = F.col("ex1") - F.col("ex0"), F.col("ey1") - F.col("ey0")
    along = ((F.col("x") - F.col("ex0")) * dx + (F.col("y") - F.col("ey0")) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-12))
    on = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    off = F.hypot(F.col("x") - F.col("ex0") - on * dx, F.col("y") - F.col("ey0") - on * dy) * F.col("k")
    nearest = met.withColumn("d", off).groupBy("page", "wall", "i").agg(F.min("d").alias("d")).where(F.col("d") <= WALL_NEAR)
    return nearest.groupBy("page", "wall").agg(F.count("*").alias("n"), F.max("d").alias("worst"), F.avg("d").alias("mean")).where(F.col("n") == SAMPLES).drop("n")


def yard_edge_runs(outlines: DataFrame, walls: DataFrame) -> DataFrame:
    """page, length_lm, orientation, ends, n_members, worst, mean and reason: the one straight wall along each yard's outline.

    ``outlines`` has (page, k, points: array<struct<x, y>>), ``walls`` (page, seq, x0, y0,
    x1, y1, grey). Of walls that lie on one another the longest leads; a leader counts
    if one of its members is a light stroke or it has several. The longest leader is
    taken unless another comes within the rival share of it. Walls drawn several times over
    are compared once and count each time.
    """
    known = outlines.where("k > 0 AND size(points) >= 3").select("page", "k", "points")
    ring = known.select("page", "k", F.inline(F.arrays_zip(F.col("points").alias("p"), F.concat(F.slice("points", 2, F.size("points") - 1), F.slice("points", 1, 1)).alias("q"))))
    edges = ring.select("page", "k", *(F.col(f"{s}.{c}").cast("double").alias(f"e{c}{i}") for i, s in ((0, "p"), (1, "q")) for c in ("x", "y")))
    dx, dy = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    straight = walls.where((F.least(dx, dy) <= 0.05) & (F.greatest(dx, dy) > 0.05)).withColumn("orientation", F.when(dx > dy, "H").otherwise("V"))
    flat = F.col("orientation") == "H"
    straight = straight.select(
        "page", "seq", "grey", "orientation", F.when(flat, (F.col("y0") + F.col("y1")) / 2).otherwise((F.col("x0") + F.col("x1")) / 2).alias("fixed"),
        F.when(flat, F.least("x0", "x1")).otherwise(F.least("y0", "y1")).alias("a0"), F.when(flat, F.greatest("x0", "x1")).otherwise(F.greatest("y0", "y1")).alias("a1"),
    ).join(small(stored(known.select("page", "k"), "scales")), "page")
    # walls of equal ends share their fate: they are as near, and all follow what the first of them follows, or that itself
    straight = straight.groupBy("page", "orientation", "fixed", "a0", "a1").agg(F.min("seq").alias("seq"), F.count("*").alias("copies"), F.max(F.coalesce("grey", F.lit(False))).alias("grey"), F.max("k").alias("k"))
    straight = straight.withColumn("length", (F.col("a1") - F.col("a0")) * F.col("k")).where(F.col("length") >= WALL_LEAST)
    placed = stored(numbered(straight, ["page", F.desc("length"), "seq", "orientation", "fixed", "a0"], "wall"), "walls")
    ends = {"x0": F.when(flat, F.col("a0")).otherwise(F.col("fixed")), "y0": F.when(flat, F.col("fixed")).otherwise(F.col("a0")), "x1": F.when(flat, F.col("a1")).otherwise(F.col("fixed")), "y1": F.when(flat, F.col("fixed")).otherwise(F.col("a1"))}
    near = _near_edge(placed.select("page", "wall", "k", *(c.alias(n) for n, c in ends.items())), edges)
    candidates = stored(placed.join(near.hint("merge"), ["page", "wall"]), "near-walls")

    band = F.floor(F.col("fixed") * F.col("k") / WALL_NEAR)
    one = candidates.select("page", "orientation", F.col("wall").alias("better"), F.col("a0").alias("b0"), F.col("a1").alias("b1"), F.col("fixed").alias("bf"), "k", F.explode(F.sequence(band - 1, band + 1)).alias("band"))
    two = candidates.select("page", "orientation", F.col("wall").alias("worse"), "a0", "a1", "fixed", band.alias("band"))
    cover = F.greatest(F.lit(0.0), F.least("a1", "b1") - F.greatest("a0", "b0")) / F.least(F.col("a1") - F.col("a0"), F.col("b1") - F.col("b0"))
    alike = (F.col("better") < F.col("worse")) & (cover >= WALL_COVER) & (F.abs(F.col("fixed") - F.col("bf")) * F.col("k") <= WALL_NEAR)
    same = stored(one.hint("merge").join(two, ["page", "orientation", "band"]).where(alike).select("better", "worse"), "same-walls")
    follows = small(stored(greedy_kept(same).where("NOT kept").select(F.col("place").alias("worse")), "followers"))
    lead = same.join(follows, "worse", "left_semi").join(follows.withColumnRenamed("worse", "better"), "better", "left_anti").groupBy("worse").agg(F.min("better").alias("leader"))
    of = candidates.join(small(stored(lead.withColumnRenamed("worse", "wall"))), "wall", "left").withColumn("leader", F.coalesce("leader", "wall"))
    support = of.groupBy("leader").agg(F.sum("copies").alias("n_members"), F.max("grey").alias("light"))
    leaders = candidates.join(support.withColumnRenamed("leader", "wall").hint("merge"), "wall").withColumn("counts", F.col("light") | (F.col("n_members") >= 2))
    two_best = F.slice(F.sort_array(F.collect_list(F.when(F.col("counts"), F.struct("length", (-F.col("wall")).alias("w")))), asc=False), 1, 2)
    # leaders of a page that count are few: they are long, apart, and along its outline
    best = leaders.groupBy("page").agg(two_best.alias("top"), F.count("*").alias("n"))
    first, second = F.get("top", F.lit(0)), F.get("top", F.lit(1))
    rival = second["length"] >= RIVAL * first["length"]
    best = best.select("page", "n", (-first["w"]).alias("wall"), F.coalesce(rival, F.lit(False)).alias("rival"))
    met = outlines.select("page").distinct().join(known.select("page", F.lit(True).alias("known")).distinct().hint("merge"), "page", "left").join(best.hint("merge"), "page", "left")
    reason = F.when(F.col("known").isNull(), NO_SCALE).when(F.col("n").isNull(), NO_WALL).when(F.col("wall").isNull(), UNSUPPORTED).when(F.col("rival"), RIVALS)
    met = met.withColumn("reason", reason).withColumn("wall", F.when(reason.isNull(), F.col("wall"))).drop("n", "rival", "known")
    chosen = leaders.select("wall", F.bround("length", 2).alias("length_lm"), "orientation", *(c.alias(n) for n, c in ends.items()), "n_members", F.bround("worst", 3).alias("worst"), F.bround("mean", 3).alias("mean"))
    return met.join(chosen.hint("merge"), "wall", "left").select("page", "length_lm", "orientation", *ends, "n_members", "worst", "mean", "reason")
