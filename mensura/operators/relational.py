"""DataFrame operators of the domain: rollups, consensus, refusal of near ties, history, overlays and matching.

None of them gathers rows at the driver. Order that matters is an explicit column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mensura.functions import parsing, rules
from mensura.operators.lineage import small, spread, stored


def zone_rollup(rows: DataFrame, keys: list[str], order: str = "index") -> DataFrame:
    """Zones of annotation rows: sums that stay null where nothing contributed, in the order first seen."""
    return rows.groupBy(*keys).agg(
        F.sum("area_m2").alias("area_m2"), F.sum("length_lm").alias("length_lm"), F.sum("perimeter_lm").alias("perimeter_lm"),
        F.sum("cutout_count").alias("cutout_count"), F.count("*").alias("annotation_count"), F.min(order).alias("first_seen"),
        F.transform(F.array_sort(F.collect_set(F.struct("subject"))), lambda s: s["subject"]).alias("subjects"),
    )


def consensus(rows: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """The mean of positive readings that agree within ``tolerance``, else null: disagreement is never averaged away."""
    good = F.when(F.col(value) > 0, F.col(value))
    out = rows.groupBy(*keys).agg(F.min(good).alias("low"), F.max(good).alias("high"), F.avg(good).alias("mean"), F.count(good).alias("n"))
    agreed = F.col("high") / F.col("low") - 1 <= tolerance
    return out.withColumn("agreed", F.when(agreed, F.col("mean"))).drop("mean")


def distinct_consensus(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The one distinct value of each group, or a conflict."""
    out = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count_distinct(value).alias("n_values"), F.min(value).alias("__v"))
    return out.select(*keys, "n_values", F.when(F.col("n_values") == 1, F.col("__v")).alias("value"), (F.col("n_values") > 1).alias("conflict"))


def best_or_refuse(rows: DataFrame, keys: list[str], value: str, score: str, margin: float = 1.0) -> DataFrame:
    """The best supported value, or a conflict where another comes within ``margin``.

    A value's support is its best score plus up to two for being found again.
    """
    support = rows.groupBy(*keys, value).agg((F.max(score) + F.least(F.lit(2), F.count("*") - 1)).alias("support"))
    w = Window.partitionBy(*keys).orderBy(F.desc("support"), value)
    ranked = support.withColumn("place", F.row_number().over(w)).withColumn("next", F.lead("support").over(w)).where("place = 1")
    clear = F.col("next").isNull() | (F.col("next") < F.col("support") - margin)
    return ranked.select(*keys, F.when(clear, F.col(value)).alias("value"), "support", (~clear).alias("conflict"))


def mode_first_seen(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group; of equally frequent ones that seen first."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first_at"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "first_at")
    return counts.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def latest_with_history(rows: DataFrame, keys: list[str], entry: list[str], at: list[str]) -> DataFrame:
    """Each key's latest entry (the last of ``at``) and how many there were; empty keys are dropped."""
    known = rows
    for k in keys:
        known = known.where(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    return known.groupBy(*keys).agg(F.max_by(F.struct(*entry), F.struct(*at)).alias("latest"), F.count("*").alias("n_history"))


def latest_row(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def prior_of(rows: DataFrame, key: str, row_id: str, at: str) -> DataFrame:
    """Each row with the latest other row of its key, whatever its time, or null."""
    latest = rows.groupBy(F.col(key).alias("__k"), F.col(row_id).alias("__i")).agg(F.max(at).alias("__at"))  # an id counts once
    other = latest.select("__k", F.struct(F.col("__at").alias("at"), F.col("__i").alias("id")).alias("__o"))
    # two latest of each key are enough: the latest, unless that is the row itself
    w = Window.partitionBy("__k").orderBy(F.desc("__o"))
    two = other.withColumn("__p", F.row_number().over(w)).where("__p <= 2").groupBy("__k").agg(F.sort_array(F.collect_list("__o"), asc=False).alias("__two"))
    met = rows.join(two, F.col(key) == F.col("__k"), "left")
    prior = F.get(F.filter("__two", lambda o: o["id"] != F.col(row_id)), F.lit(0))
    return met.select(*rows.columns, prior["id"].alias("prior_id"), prior["at"].alias("prior_at"))


def overlay(base: DataFrame, over: DataFrame, key: str, value: str) -> DataFrame:
    """Base values with those of ``over`` on top, and where each came from."""
    o = over.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    met = base.join(o, F.col(key) == F.col("__k"), "left")
    return met.select(key, F.coalesce("__v", value).alias(value), F.when(F.col("__v").isNotNull(), "override").otherwise("default").alias("source"))


def row_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value changed, appeared or went, nulls compared as values."""
    b, a = before.select(F.col(key).alias("bk"), F.col(value).alias("before")), after.select(F.col(key).alias("ak"), F.col(value).alias("after"))
    met = b.join(a, F.col("bk") == F.col("ak"), "full_outer")
    return met.where(~F.col("before").eqNullSafe(F.col("after"))).select(F.coalesce("bk", "ak").alias(key), "before", "after")


def hot_over_archive(hot: DataFrame, archive: DataFrame, key: str) -> DataFrame:
    """Both stores as one; a row of the hot store hides its archived copy."""
    return hot.unionByName(archive.join(hot.select(key), key, "left_anti"))


def merge_intervals(rows: DataFrame, keys: list[str], low: str, high: str, gap: float) -> DataFrame:
    """Intervals of each key united where they touch, overlap or lie within ``gap``; open ends lie after all others of their start."""
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(low), F.asc_nulls_last(high))
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col(low) <= F.col("__reach") + gap, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.withColumn("__reach", reach).withColumn("__island", island)
    return marked.groupBy(*keys, "__island").agg(F.min(low).alias("low"), F.max(high).alias("high"), F.count("*").alias("n")).drop("__island")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, payload: str) -> DataFrame:
    """Each left row with the nearest right row of its keys, ties to the smaller payload.

    An as-of join in both directions: rows of both sides are laid on one line and
    each left row looks at the last right row before it and the first after it.
    """
    l = left.select(*left.columns, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[payload].dataType).alias("__p"))
    r = right.groupBy(*keys, F.col(right_at).alias("__at")).agg(F.min(payload).alias("__p")).withColumn("__side", F.lit(0))
    both = l.unionByName(r, allowMissingColumns=True)
    near = F.when(F.col("__side") == 0, F.struct(F.col("__at").alias("at"), F.col("__p").alias("p")))
    w = Window.partitionBy(*keys).orderBy("__at", "__side")
    back = F.last(near, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(near, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    got = both.withColumn("__b", back).withColumn("__a", ahead).where("__side = 1")
    db, da = F.col("__at") - F.col("__b.at"), F.col("__a.at") - F.col("__at")
    take_back = F.col("__a").isNull() | (db < da) | ((db == da) & (F.col("__b.p") <= F.col("__a.p")))
    best = F.when(F.col("__b").isNotNull() & take_back, F.col("__b")).otherwise(F.col("__a"))
    return got.select(*left.columns, best["p"].alias("nearest"), F.abs(best["at"] - F.col("__at")).alias("distance"))


#: Right rows of equal ends that a range join meets as one, and how many blocks' rows one task takes at once.
BLOCK, PART = 512, 2


def range_join(left: DataFrame, right: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Left rows within [low, high] of right rows, met by equal buckets of ``width`` and then tested.

    A right interval is listed in each bucket it touches, so the join is an
    equi-join that shuffles both sides instead of a nested loop. Right rows of equal
    ends meet the left ones in blocks, which are opened last: a task lists a block for one
    left row after the other, so pairs lie in long runs that files hold in few bytes.
    A few blocks of a bucket are one part, and parts are what is dealt to tasks: a left row goes to each part of
    its bucket, and to none where the bucket has no right rows, so a bucket that holds most pairs isn't one task.
    """
    b = lambda c: F.floor(F.col(c) / width).cast("long")
    others = [c for c in right.columns if c not in (low, high)]
    # in an order without ties, so that a block is the same one whenever its task is run again
    order = [low, high, *others]
    r = right.where(F.col(low) <= F.col(high)).repartitionByRange(*order).sortWithinPartitions(*order)
    r = r.withColumn("__n", F.expr(f"monotonically_increasing_id() div {BLOCK}")).groupBy(low, high, "__n").agg(F.collect_list(F.struct(*(others or [low]))).alias("__rows"))
    r = stored(r.withColumn("__b", F.explode(F.sequence(b(low), b(high)))).withColumn("__part", F.expr(f"__n div {PART}")).drop("__n"), "blocks")
    keys = ["__b", "__part"]
    l = left.withColumn("__b", b(at)).join(small(stored(r.select(*keys).distinct(), "parts")), "__b")
    # the left side of a merge join is the outer loop
    met = spread(r, *keys).hint("merge").join(spread(l, *keys), keys).where(F.col(at).between(F.col(low), F.col(high)))
    # plain values are read faster than structs
    met = met.withColumn("__row", F.explode(F.col(f"__rows.{others[0]}") if len(others) == 1 else F.col("__rows")))
    of = lambda c: F.col("__row").alias(c) if len(others) == 1 else F.col(f"__row.{c}")
    return met.select(*left.columns, *(of(c) if c in others else F.col(c) for c in right.columns))


def first_rule(rows: DataFrame, rules: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Rows with the first rule (by rule_order) whose pattern their text holds; the rule table is a handful of rows."""
    hits = rows.join(F.broadcast(rules), F.expr(f"{text} RLIKE concat('(?i)', pattern)"))
    return hits.groupBy(*keys).agg(F.min_by("exclusion_id", "rule_order").alias("exclusion_id"), F.min("rule_order").alias("rule_order"))


def top_per_key(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def scorecard(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by verdict and the share of passes, zero where nothing was measured."""
    n = lambda v: F.count_if(F.col("verdict") == v).alias(f"n_{v.lower()}")
    share = F.coalesce(F.try_divide(F.count_if(F.col("verdict") == "PASS") * 100, F.count("*")), F.lit(0.0))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), n("PASS"), n("FAIL"), n("UNMEASURED"), share.cast("double").alias("pass_pct"))


def explode_zones(rows: DataFrame, zones: str, extras: list[str]) -> DataFrame:
    """A row for each zone of an array, or one without; what belongs to the whole stays on the first only."""
    out = rows.select(*[c for c in rows.columns if c != zones], F.posexplode_outer(zones).alias("zone_index", "zone"))
    first = F.coalesce(F.col("zone_index"), F.lit(0)) == 0
    for c in extras:
        out = out.withColumn(c, F.when(first, F.col(c)))
    return out


def exact_cover(items: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Keys on one side only; empty when decisions cover the items exactly."""
    a, b = items.select(F.col(key).alias("a")), decisions.select(F.col(key).alias("b"))
    return a.join(b, F.col("a") == F.col("b"), "full_outer").where("a IS NULL OR b IS NULL").select(F.coalesce("a", "b").alias(key), F.when(F.col("a").isNull(), "unknown").otherwise("undecided").alias("problem"))


def compared(truth: DataFrame, measured: DataFrame, keys: list[str], category: str, value: str, domain: list[str], tolerance: float) -> DataFrame:
    """Truth against measurement over a fixed domain of categories: every key gets a verdict for each of them."""
    side = lambda d, name: d.groupBy(*keys, category).agg(F.sum(value).alias(name))
    cells = truth.select(*keys).union(measured.select(*keys)).distinct().withColumn(category, F.explode(F.array(*map(F.lit, domain))))
    met = cells.join(side(truth, "truth"), [*keys, category], "left").join(side(measured, "measured"), [*keys, category], "left")
    verdict = rules.compare_zone(F.col("truth"), F.col("measured"), tolerance)
    return met.withColumn("delta_pct", rules.signed_delta_pct(F.col("measured"), F.col("truth"))).withColumn("verdict", verdict)


def scale_rank(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Title denominators of each text by how often they occur, then by place."""
    each = texts.select(key, F.posexplode(parsing.title_scales(F.col(text))).alias("at", "denominator"))
    counts = each.groupBy(key, "denominator").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "at")
    return counts.withColumn("place", F.row_number().over(w)).drop("at")


def chosen_swatch(swatches: DataFrame, key: str, distance: str, plausible: str) -> DataFrame:
    """The nearest swatch of each key, one that may be a surface before any other."""
    return latest_row(swatches, [key], [F.desc(plausible), F.col(distance), F.col("id")])
