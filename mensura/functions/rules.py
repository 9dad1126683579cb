"""Classifiers, gates and quality states as ordered CASE expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from mensura.functions import dims

REJECTED, UNMEASURED, UNVERIFIED, VERIFIED = "REJECTED", "UNMEASURED", "MEASURED_UNVERIFIED", "MEASURED_VERIFIED"


def any_of(text: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def discipline(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.when(any_of(low, dims.ENGINEER_HINTS), "engineer").when(any_of(low, dims.ARCHITECT_HINTS), "architect").otherwise("unknown")


def keyword_score(text: Column, weights: dict[str, int]) -> Column:
    """The sum of the weights of the words that a text contains."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(0)
    for word, weight in weights.items():
        out = out + F.when(F.contains(low, F.lit(word)), weight).otherwise(0)
    return out


def drawing_priority(name: Column, text: Column, source: Column) -> Column:
    both = F.concat_ws(" ", name, text)
    extra = {w: 1 for w in ("concrete", "slab", "yard", "service yard")}
    words = keyword_score(both, {w: 2 for w in dims.AREA_KEYWORDS}) + keyword_score(both, extra) + keyword_score(both, {w: -2 for w in dims.LOW_KEYWORDS})
    return words + F.when(source == "engineer", 3).when(source == "architect", -1).otherwise(0)


def build_up_source(name: Column, source: Column) -> Column:
    return F.when((source == "engineer") | any_of(F.lower(name), dims.DETAIL_KEYWORDS), "detail").otherwise("assume")


def page_kind(vector_paths: Column, area_markups: Column) -> Column:
    return F.when(vector_paths < 50, "RASTER").when(area_markups > 0, "MARKED").otherwise("UNMARKED")


def page_confidence(kind: Column) -> Column:
    return dims.lookup({"RASTER": "low", "MARKED": "high", "UNMARKED": "medium"}, kind)


def implausible(area: Column, site: Column, most: float = 60_000.0) -> Column:
    """Reasons why an area can't be right; none for null."""
    return F.array_compact(
        F.array(F.when(area > site * 1.02, "exceeds site"), F.when(area > most, "exceeds single zone"), F.when(area <= 0, "not positive"))
    )


def measurement_state(area: Column, scale_verified: Column, confidence: Column, site: Column, rejected: Column) -> Column:
    """One of four states; an unknown scale check doesn't demote, only a failed one."""
    return (
        F.when(F.coalesce(rejected, F.lit("")) != "", REJECTED)
        .when(area.isNull(), UNMEASURED)
        .when(F.size(implausible(area, site)) > 0, UNVERIFIED)
        .when(scale_verified.eqNullSafe(F.lit(False)), UNVERIFIED)
        .when(confidence.eqNullSafe(F.lit("low")), UNVERIFIED)
        .otherwise(VERIFIED)
    )


def first_reason(*reasons: tuple[Column, str]) -> Column:
    """The first reason whose condition holds, or null: the order is the meaning."""
    return F.coalesce(*(F.when(test, reason) for test, reason in reasons), F.lit(None).cast("string"))


def pending(ids: Column, decisions: Column) -> Column:
    """How many of the identified proposals have no decision that closes them."""
    return F.size(F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda i: (i != "") & ~F.coalesce(F.try_element_at(decisions, i), F.lit("")).isin("accepted", "removed")))


def zone_block(stale: Column, mismatch: Column, overlap: Column, required: Column, categories: Column) -> Column:
    """Why a job's zones need an assessor."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    unknown = F.exists(F.coalesce(categories, F.array().cast("array<string>")), lambda c: F.lower(F.trim(c)) == "unclassified")
    return first_reason((yes(stale), "zones stale"), (yes(mismatch), "zones mismatch reference"), (yes(overlap), "zones overlap"), (yes(required) | yes(unknown), "zones unclassified"))


def area_elements_block(names: Column, categories: Column) -> Column:
    """Named areas without a priced section: how many, and the first three."""
    both = F.arrays_zip(names.alias("n"), categories.alias("c"))
    open_ = F.filter(both, lambda e: ~F.coalesce(F.lower(F.trim(e["c"])).isin(*dims.AREA_CATEGORIES), F.lit(False)))
    listed = F.array_join(F.slice(F.transform(open_, lambda e: F.coalesce(e["n"], F.lit("Unnamed area"))), 1, 3), ", ")
    return F.when(F.size(open_) > 0, F.concat(F.size(open_).cast("string"), F.lit(" area elements without section: "), listed))


def approval_reason(
    state: Column, scale_confirmed: Column, zones: Column, yard_review: Column, elements: Column, channels_pending: Column, transitions_pending: Column, warning: Column,
    exclusions_open: Column | None = None, units_open: Column | None = None,
) -> Column:
    """The first reason why a job can't be approved; confirming the scale lifts only the state's own reasons."""
    yes = lambda c: F.lit(False) if c is None else F.coalesce(c, F.lit(False))
    open_state = ~yes(scale_confirmed) & state.isin(REJECTED, UNMEASURED, UNVERIFIED)
    return F.coalesce(
        F.when(yes(exclusions_open), "exclusions need confirmation"), F.when(yes(units_open), "unit group incomplete"), zones,
        F.when(yes(yard_review), "yard regions need review"), elements,
        F.when(channels_pending > 0, F.concat(channels_pending.cast("string"), F.lit(" channel proposals pending"))),
        F.when(transitions_pending > 0, F.concat(transitions_pending.cast("string"), F.lit(" transition candidates pending"))),
        F.when(yes(warning), "specification needs pricing review"), F.when(open_state, F.lower(state)),
    )


def approval_block(state: Column, scale_confirmed: Column, zones_open: Column, regions_open: Column, proposals_open: Column, warning: Column) -> Column:
    """Why a job can't be approved; confirming the scale lifts only the state's own reasons."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    confirmed = yes(scale_confirmed)
    return first_reason(
        (yes(zones_open), "zones need classification"),
        (yes(regions_open), "regions need review"),
        (yes(proposals_open), "proposals need a decision"),
        (yes(warning), "specification needs pricing review"),
        (~confirmed & (state == REJECTED), "rejected"),
        (~confirmed & (state == UNMEASURED), "unmeasured"),
        (~confirmed & (state == UNVERIFIED), "unverified"),
    )


def needs_approval(flags: Column, kind: Column, confidence: Column) -> Column:
    trigger = F.exists(flags, lambda f: any_of(F.upper(f), dims.APPROVAL_TRIGGERS))
    return F.coalesce(trigger, F.lit(False)) | kind.eqNullSafe(F.lit("RASTER")) | confidence.eqNullSafe(F.lit("low"))


def outcome(crashed: Column, hung: Column, area: Column, state: Column, flags: Column) -> Column:
    """How a run over one file ended; a number without a state or flag is the worst."""
    silent = area.isNotNull() & state.isNull() & (F.size(F.coalesce(flags, F.array().cast("array<string>"))) == 0)
    return F.when(crashed, "CRASH").when(hung, "HANG").when(silent, "SILENT_NUMBER").when(area.isNotNull(), "MEASURED_OK").otherwise("REFUSED_CLEANLY")


def signed_delta_pct(measured: Column, truth: Column) -> Column:
    """Per cent above or below the truth; infinite against a truth of zero."""
    far = F.signum(measured) * F.lit(float("inf"))
    return F.when(truth == 0, F.when(measured == 0, 0.0).otherwise(far)).otherwise((measured - truth) / F.abs(truth) * 100)


def within_tolerance(measured: Column, truth: Column, tolerance: Column) -> Column:
    return F.coalesce(F.abs(signed_delta_pct(measured, truth)) <= tolerance, F.lit(False))


def is_upper_floor(subject_key: Column) -> Column:
    """An ordinal, "floor" or "floors", and perhaps "slab" or "slabs", and nothing else."""
    words = F.split(subject_key, " ")
    numbered = F.regexp_extract(words[0], "^([0-9]+)(st|nd|rd|th)$", 1) != ""
    ordinal = numbered | words[0].isin(*dims.ORDINAL_WORDS)
    rest = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    floor = F.get(rest, F.lit(0)).isin("floor", "floors") & ((F.size(rest) == 1) | ((F.size(rest) == 2) & F.get(rest, F.lit(1)).isin("slab", "slabs")))
    return F.coalesce(ordinal & floor, F.lit(False))


def names_units(text: Column) -> Column:
    """Whether a text is "unit" or "units" with one or more identifiers, several of them set apart by a sign or "and"."""
    ids = F.regexp_replace(text, "^units?", "")
    marked = F.regexp_replace(F.trim(ids), "^[-:#] *", "")
    parts = F.split(F.regexp_replace(marked, " *(&|,|/|[+]|-|(?<![a-z0-9])and(?![a-z0-9])) *", "&"), "&")
    return F.coalesce((ids != text) & F.forall(parts, lambda x: x.rlike("^[a-z0-9]+$")), F.lit(False))


def linear_kind(subject_key: Column) -> Column:
    """channel or transition for subjects such as "unit 4a & 4b channels"; null for others."""
    kind = F.regexp_extract(subject_key, "([a-z]+)$", 1)
    head = F.regexp_replace(F.substring(subject_key, F.lit(1), F.greatest(F.length(subject_key) - F.length(kind), F.lit(0))), " *[-:]? *$", "")
    return F.when(names_units(head), dims.lookup(dims.LINEAR_WORDS, kind))


def linear_unit(subject_key: Column) -> Column:
    """The unit part of such a subject."""
    return F.when(linear_kind(subject_key).isNotNull(), F.regexp_replace(subject_key, " *[-:]? *[a-z]+$", ""))


def subject_category(subject_key: Column, exact: Column, scope: Column | None = None) -> Column:
    """The category of a subject: works of others, a stated upper scope, its exact entry, then the forms of floors and of units' lengths."""
    upper = F.lit(False) if scope is None else scope.isNotNull()
    return (
        F.when(any_of(subject_key, dims.OTHER_WORKS), "other").when(upper, "upper_floor").when(exact.isNotNull(), exact).when(is_upper_floor(subject_key), "upper_floor")
        .otherwise(linear_kind(subject_key))
    )


def out_of_scope(subject_key: Column) -> Column:
    return F.when(any_of(subject_key, dims.OUT_OF_SCOPE), "internal_warehouse_scope")


def in_context(category: Column, subject_key: Column, context: Column) -> Column:
    """A category, or for a subject that only names units the one that the drawing's own context gives."""
    return F.when((category == "unclassified") & names_units(subject_key), F.coalesce(context, category)).otherwise(category)


def section(category: Column, stated: Column) -> Column:
    """The priced section: that of the category, else one stated by its exact name; never a guess."""
    known = F.when(stated.isin(*dims.SECTION_ORDER), stated)
    return F.coalesce(dims.lookup(dims.SECTION_OF, category), known, F.lit(dims.UNCLASSIFIED))


def is_fixture(job_id: Column, env: Column, file: Column) -> Column:
    """Log rows of tests: by id, or by environment together with a telling file."""
    return F.coalesce(job_id.rlike(r"^(test|fixture)[-_]"), F.lit(False)) | (
        F.coalesce(env.isin("test", "ci"), F.lit(False)) & F.coalesce(F.lower(file).rlike("(fixture|sample|test)"), F.lit(False))
    )


def surface_tint(r: Column, g: Column, b: Column) -> Column:
    """Whether a colour may be a surface: neither ink nor paper."""
    return F.coalesce((F.greatest(r, g, b) > 30) & (F.least(r, g, b) < 245), F.lit(False))


def tints_agree(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column], tolerance: int = 5) -> Column:
    return F.coalesce(F.greatest(*(F.abs(x - y) for x, y in zip(a, b))) <= tolerance, F.lit(False))


def compare_zone(truth: Column, measured: Column, tolerance: float) -> Column:
    """The verdict on one category of the fixed domain."""
    return (
        F.when(truth.isNull() & measured.isNull(), "NOT APPLICABLE").when(truth.isNull(), "FAIL - unexpected measured zone").when(measured.isNull(), "FAIL - missing measured zone")
        .when(within_tolerance(measured, truth, F.lit(tolerance)), "PASS").otherwise("FAIL")
    )


def without_prices(values: Column, keys: tuple[str, ...] = ("rate", "costing", "breakdown", "total_gbp", "grand_total_gbp")) -> Column:
    """A map without entries of a commercial kind."""
    return F.map_filter(values, lambda k, _: ~k.isin(*keys) & ~k.endswith("_rate"))


def candidate_confidence(resolved: Column, scale_verified: Column, translated: Column, regions: Column) -> Column:
    """score and label of an extent found on a drawing; one that isn't resolved is low."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    points = F.lit(35) + F.when(yes(scale_verified), 20).otherwise(0) + F.when(yes(translated), 5).otherwise(20) + F.when(regions > 1, 5).otherwise(0)
    score = F.when(yes(resolved), F.least(points, F.lit(95))).otherwise(10)
    return F.struct(score.alias("score"), F.when(score >= 70, "medium").otherwise("low").alias("label"))


def eligible(area_pt2: Column, page_pt2: Column, k: Column, scale_verified: Column, least_m2: float, most_m2: float) -> Column:
    """Whether an extent's size is possible: in square metres where the scale is verified, else as a share of the page."""
    by_scale = (area_pt2 * k * k).between(least_m2, most_m2)
    by_page = (area_pt2 / page_pt2).between(0.002, 0.15)
    return F.coalesce((area_pt2 > 0) & F.when(F.coalesce(scale_verified & (k > 0), F.lit(False)), by_scale).otherwise(by_page), F.lit(False))
