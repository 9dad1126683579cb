"""Quotation lines of measured zones: one DataFrame for each kind of line, joined by name and ordered once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.functions import dims, pricing, rules

LINE = ["doc_id", "section", "description", "qty", "unit", "rate", "value", "provisional", "role"]
# Rates of the lines that every priced group carries.
TRIM_RATE, JOINT_RATE = 1.40, 4.85
ROLE_ORDER = ("slab", "trim", "joints", "manholes")


def _line(description: Column, qty: Column, unit: str, rate: Column, provisional: Column, role: str) -> list[Column]:
    value = F.when(rate.isNotNull(), pricing.money(qty.cast("decimal(18,3)") * rate.cast("decimal(18,2)")))
    return [
        F.col("doc_id"), F.col("section"), description.alias("description"), qty.cast("decimal(18,3)").alias("qty"), F.lit(unit).alias("unit"),
        rate.cast("decimal(18,2)").alias("rate"), value.alias("value"), F.coalesce(provisional, F.lit(True)).alias("provisional"), F.lit(role).alias("role"),
    ]


def priced_zones(zones: DataFrame) -> DataFrame:
    """Zones(doc_id, category, area_m2, and the rate's inputs) with section and rate; a document of several sections has none."""
    spark = zones.sparkSession
    z = zones.join(F.broadcast(dims.mesh(spark)), "mesh", "left").withColumn("section", rules.section(F.col("category"), F.lit(None).cast("string")))
    names = ("depth_mm", "conc_rate", "conc_wastage", "kg_m2", "layers", "steel_rate_t", "steel_wastage", "lap_acc", "dpm", "curing", "labour", "trim", "margin")
    fill = lambda n: F.coalesce(F.col(n), F.lit(dims.DEFAULT_SPEC[n])) if n in dims.DEFAULT_SPEC and n in zones.columns else F.lit(dims.DEFAULT_SPEC[n]) if n in dims.DEFAULT_SPEC else F.col(n)
    rate = pricing.rate_parts(*(fill(n) for n in names))["rate"]
    sections = z.groupBy("doc_id").agg(F.count_distinct("section").alias("n_sections"))
    one = F.col("n_sections") == 1
    return z.join(sections, "doc_id").withColumn("rate", F.when(one & (F.col("section") != dims.UNCLASSIFIED), rate)).drop("n_sections")


def lines(zones: DataFrame) -> DataFrame:
    """All lines of the zones' documents, in order of section and role."""
    g = priced_zones(zones).groupBy("doc_id", "section", "depth_mm", "mesh", "rate").agg(F.sum("area_m2").alias("area"), F.bool_or(F.coalesce("assumed", F.lit(True))).alias("assumed"))
    text = F.concat_ws(" ", F.concat(F.col("depth_mm").cast("string"), F.lit("mm slab")), F.col("mesh"))
    slab = g.select(_line(text, F.col("area"), "m2", F.col("rate"), F.col("assumed"), "slab"))
    priced = F.col("rate").isNotNull()
    extra = lambda d, r, role: g.select(_line(F.lit(d), F.col("area"), "m2", F.when(priced, F.lit(r)), ~priced, role))
    out = slab.unionByName(extra("Final trim", TRIM_RATE, "trim")).unionByName(extra("Joints", JOINT_RATE, "joints"))
    if "manholes" in zones.columns:
        m = priced_zones(zones).groupBy("doc_id", "section").agg(F.sum("manholes").alias("n")).where("n > 0")
        out = out.unionByName(m.select(_line(F.lit("E/O manhole details"), F.col("n"), "Nr", F.lit(dims.MANHOLE_RATE), F.lit(False), "manholes")))
    place = lambda values, c: F.coalesce(F.array_position(F.array(*map(F.lit, values)), F.col(c)).try_cast("int"), F.lit(99))
    section = F.when(place(dims.SECTION_ORDER, "section") == 0, 99).otherwise(place(dims.SECTION_ORDER, "section"))
    return out.withColumn("section_rank", section.cast("int")).withColumn("role_rank", place(ROLE_ORDER, "role"))


def totals(line_rows: DataFrame) -> DataFrame:
    """A document's subtotal of priced lines, and whether anything in it is provisional."""
    return line_rows.groupBy("doc_id").agg(F.sum("value").alias("subtotal"), F.bool_or("provisional").alias("assumed"), F.count_if(F.col("rate").isNull()).alias("unpriced"))


def text_lines(line_rows: DataFrame) -> DataFrame:
    """One fixed-width line of text for each quotation line, for a text sink."""
    cell = lambda c: F.coalesce(F.format_string("%14.2f", F.col(c).cast("double")), F.lit(" " * 8 + "to be priced"[:6]))
    return line_rows.select("doc_id", F.concat(F.rpad("section", 14, " "), F.rpad("description", 38, " "), F.format_string("%10.2f", F.col("qty").cast("double")), cell("rate"), cell("value")).alias("value"))


def json_documents(line_rows: DataFrame) -> DataFrame:
    """A JSON quotation for each document."""
    entry = F.struct("section_rank", "role_rank", "section", "description", "qty", "unit", "rate", "value", "provisional")
    return line_rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("lines")).select("doc_id", F.to_json(F.struct("doc_id", "lines")).alias("value"))
