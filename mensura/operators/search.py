"""Specifications of a drawing out of the files that may speak for it: its own, siblings of its project, and registered ones."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.functions import dims
from mensura.operators.lineage import small, stored

# Names of sheets that hold specifications, besides those of details.
SHEETS = (*dims.DETAIL_KEYWORDS, "external works details", "joint layout", "construction thickness", "slab specification", "pavement details")
OWN, SIBLING, REGISTERED = 0, 1, 2


def is_detail(name: Column) -> Column:
    """Whether a file's name is that of a PDF which may hold a specification."""
    terms = {re.escape(t.replace("-", " ").replace("_", " ")) for t in SHEETS}
    return F.regexp_replace(F.lower(name), "[-_]+", " ").rlike("|".join(sorted(terms))) & F.lower(name).endswith(".pdf")


def candidates(targets: DataFrame, files: DataFrame) -> DataFrame:
    """(target, path, stage): the files that speak for each of targets(target, folder, project).

    ``files`` has (path, folder, name, project). A target speaks for itself; so do detail
    sheets of its folder that carry its project's prefix, or any of them where it has no
    project; and detail sheets registered to the project, wherever they lie. Folders are
    shared by all projects, so files meet targets by (folder, prefix): one row for each
    place at which a name's prefix may end. Of several stages the first counts.
    """
    own = targets.select("target", F.col("target").alias("path"), F.lit(OWN).alias("stage"))
    details = stored(files.where(is_detail(F.col("name"))).select("path", "folder", "name", "project"), "details")
    parts = F.split("name", "_")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "_"), F.lit("_")))
    prefixed = details.where(F.size(parts) > 1).select("path", "folder", F.explode(ends).alias("prefix"))
    safe = F.substring(F.regexp_replace(F.regexp_replace("project", " ", "_"), r"[^\w.\-]", ""), 1, 80)
    within = targets.where(F.coalesce("project", F.lit("")) != "").select("target", "folder", "project", F.concat(safe, F.lit("_")).alias("prefix"))
    siblings = within.join(prefixed, ["folder", "prefix"]).select("target", "path")
    free = targets.where(F.coalesce("project", F.lit("")) == "").join(details.drop("project"), "folder").select("target", "path")
    registered = within.select("target", "project").join(details.where("project IS NOT NULL").select("path", "project"), "project").select("target", "path")
    stage = lambda d, n: d.withColumn("stage", F.lit(n))
    every = own.unionByName(stage(siblings.unionByName(free), SIBLING)).unionByName(stage(registered, REGISTERED))
    return every.groupBy("target", "path").agg(F.min("stage").alias("stage"))


def searched(targets: DataFrame, files: DataFrame, found: DataFrame) -> DataFrame:
    """What resolved(candidates(targets, files), found) gives, without a row for each target and file.

    Targets of equal folders and projects hear the same files, so these are resolved
    once for each such class; a target then adds what it says itself. Work grows with
    files and targets, not with their product.
    """
    place = F.sort_array(F.collect_set(F.struct("folder", "project")))
    of = stored(targets.groupBy("target").agg(place.alias("places")).select("target", "places", F.to_json("places").alias("class")), "classes")
    classes = stored(of.groupBy("class").agg(F.first("places").alias("places")).select("class", F.inline("places")), "classes")
    heard = candidates(small(classes.withColumnRenamed("class", "target")), files).where(F.col("stage") != OWN).withColumnRenamed("target", "class")
    heard = stored(heard, "heard")
    # of values only none, one or several matters
    low, high, any_ = F.min("value").alias("low"), F.max("value").alias("high"), F.max(F.coalesce("conflict", F.lit(False))).alias("any")
    shared = heard.join(found, "path").groupBy("class", "field").agg(low, high, any_, F.min("stage").alias("stage"), F.count_distinct("path").alias("n_files"))
    shared = stored(shared, "shared")
    known = heard.select("class", F.col("path").alias("target"), F.lit(1).alias("twice"))  # a target that is a file of its own class
    own = of.select("target", "class").join(found, F.col("target") == F.col("path")).groupBy("target", "class", "field").agg(low, high, any_)
    own = own.join(known, ["class", "target"], "left").select("target", "field", "low", "high", "any", F.lit(OWN).alias("stage"), (1 - F.coalesce("twice", F.lit(0))).cast("long").alias("n_files"))
    every = of.select("target", "class").join(small(shared), "class").drop("class").select(own.columns).unionByName(own)
    by = every.groupBy("target", "field").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("any").alias("any"), F.min("stage").alias("stage"), F.sum("n_files").alias("n_files"))
    good = F.col("low").isNotNull() & (F.col("low") == F.col("high")) & ~F.col("any")
    return by.where("low IS NOT NULL OR any").select("target", "field", F.when(good, F.col("low")).alias("value"), (~good).alias("conflict"), "stage", "n_files")


def resolved(speaks: DataFrame, found: DataFrame) -> DataFrame:
    """target, field, value, conflict, stage and n_files of found(path, field, value, conflict) over a target's candidates.

    A value counts where all files that give one agree and none of them is in
    conflict with itself; else the field is in conflict and has no value. ``stage`` is
    the first that said anything.
    """
    met = speaks.join(found, "path")
    by = met.groupBy("target", "field").agg(F.count_distinct("value").alias("n"), F.max(F.coalesce("conflict", F.lit(False))).alias("any"), F.min("value").alias("v"), F.min("stage").alias("stage"), F.count_distinct("path").alias("n_files"))
    good = (F.col("n") == 1) & ~F.col("any")
    return by.where("n > 0 OR any").select("target", "field", F.when(good, F.col("v")).alias("value"), (~good).alias("conflict"), "stage", "n_files")
