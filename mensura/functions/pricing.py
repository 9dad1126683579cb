"""Rates and amounts as single projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mensura.functions import dims


def money(value: Column) -> Column:
    """Issued amounts are decimals of two places, rounded half up once."""
    return F.round(value.cast("decimal(28,8)"), 2).cast("decimal(18,2)")


def rate_parts(depth_mm, conc_rate, conc_wastage, kg_m2, layers, steel_rate_t, steel_wastage, lap_acc, dpm, curing, labour, trim, margin) -> Column:
    """concrete, steel, nett and rate for a square metre; null where the mesh is unknown."""
    concrete = depth_mm / 1000 * conc_rate * (1 + conc_wastage)
    steel = kg_m2 * layers * steel_rate_t / 1000 * (1 + steel_wastage + lap_acc)
    nett = concrete + steel + dpm + curing + labour + trim
    return F.struct(money(concrete).alias("concrete"), money(steel).alias("steel"), money(nett).alias("nett"), money(nett * (1 + margin)).alias("rate"))


def zone_price(area: Column, rate: Column) -> Column:
    return F.when((area > 0) & rate.isNotNull(), money(area.cast("decimal(18,3)") * rate))


def manhole_line(confirmed: Column, estimate: Column, rate: float = dims.MANHOLE_RATE) -> Column:
    """quantity, amount and provisional of manholes: a confirmed count beats an estimate, and zero is no count."""
    count = F.when(confirmed > 0, confirmed).when(estimate > 0, estimate)
    return F.when(count.isNotNull(), F.struct(count.alias("qty"), money(count * F.lit(rate)).alias("amount"), (~F.coalesce(confirmed > 0, F.lit(False))).alias("provisional")))


def cubes(area: Column, depth_mm: Column, wastage: Column) -> Column:
    return F.round((area * depth_mm / 1000 * (1 + wastage)).cast("decimal(28,8)"), 1).cast("decimal(18,1)")


def scale_of_title(denominator: Column) -> Column:
    """Metres a point of a drawing at 1:N; none for zero."""
    return F.when(denominator != 0, denominator * F.lit(dims.POINT_M))


def ratio_of_scale(k: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(k / F.lit(dims.POINT_M)).cast("int"))


def scale_of_bay(width_pt: Column, bay_m: float = 2.5) -> Column:
    return F.try_divide(F.lit(bay_m), F.when(width_pt > 0, width_pt))


def scale_decision(bar: Column, title: Column, n_titles: Column, tolerance: float = 0.05) -> Column:
    """k and verdict of a scale bar against title scales: only an agreeing pair is verified, a disagreement gives none."""
    agree = F.abs(bar / title - 1) <= tolerance
    plausible = (bar / F.lit(dims.POINT_M)).between(20, 5000)
    verdict = (
        F.when(bar.isNotNull() & ~plausible, "implausible")
        .when(bar.isNotNull() & title.isNotNull() & agree & (n_titles == 1), "verified")
        .when(bar.isNotNull() & title.isNotNull() & agree, "agrees with one of several")
        .when(bar.isNotNull() & title.isNotNull(), "disagree")
        .when(bar.isNotNull(), "bar only")
        .when(title.isNotNull(), "title only")
        .otherwise("none")
    )
    return F.struct(F.when(verdict.isin("implausible", "disagree", "none"), None).otherwise(F.coalesce(bar, title)).alias("k"), verdict.alias("verdict"))


def feature_check(k: Column, span_pt: Column, real_m: Column, tolerance: float = 0.05) -> Column:
    """Whether a scale reads a known feature right: verified, unverified, or none where nothing was measured."""
    known = (k > 0) & (span_pt > 0) & (real_m > 0)
    off = F.abs(k * span_pt - real_m) / real_m
    return F.when(F.coalesce(known, F.lit(False)), F.when(off > tolerance, "unverified").otherwise("verified")).otherwise("none")


def calibrated(denominator: Column, bay_width_pt: Column, span_pt: Column, real_m: Column, tolerance: float = 0.05) -> Column:
    """k and source: a bay beats a dimension, either beats the title; the title is told of where it disagrees."""
    title = scale_of_title(denominator)
    bay, measured = scale_of_bay(bay_width_pt), F.when((span_pt > 0) & (real_m > 0), real_m / span_pt)
    feature = F.coalesce(bay, measured)
    source = F.when(bay.isNotNull(), "bay").when(measured.isNotNull(), "dimension").when(title.isNotNull(), "title").otherwise("none")
    return F.struct(F.coalesce(feature, title).alias("k"), source.alias("source"), F.coalesce(F.abs(title / feature - 1) > tolerance, F.lit(False)).alias("title_differs"))


def boundary_risk(denominator: Column, least: int = 1500) -> Column:
    """Whether a small slip of a corner weighs much at a drawing's scale."""
    return F.coalesce(denominator >= least, F.lit(False))


def valid_rate(field: Column, value: Column, fractions: tuple[str, ...] = ("margin", "conc_wastage", "steel_wastage", "lap_acc")) -> Column:
    """A supplied rate if it is finite, not negative and, where it is a share, at most one; else null."""
    fine = ~F.isnan(value) & (value >= 0) & (value < float("inf")) & (~field.isin(*fractions) | (value <= 1))
    return F.when(fine, value)
