"""From annotation rows to zones: labels are read, subjects classified, exclusions taken out, the rest rolled up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.functions import dims, parsing, rules


def classified(annotations: DataFrame) -> DataFrame:
    """Each annotation(doc_id, index, type, subject, content) with its quantities, category, zone and rule of exclusion."""
    spark = annotations.sparkSession
    key = parsing.subject_key(F.col("subject"))
    read = annotations.withColumn("subject_key", key).withColumn("area_m2", parsing.area_m2(F.col("content"))).withColumn("length_lm", parsing.length_m(F.when(F.col("type").isin("Line", "PolyLine"), F.col("content"))))
    named = read.join(F.broadcast(dims.subjects(spark)), "subject_key", "left")
    scope = parsing.upper_scope(F.col("subject"))
    named = named.withColumn("category", F.coalesce(rules.subject_category(F.col("subject_key"), F.col("category"), scope), F.lit("unclassified")))
    rule = F.coalesce(
        *(F.when(dims.says(F.concat_ws(" ", "subject", "content"), phrases), F.lit(i)) for _, i, _, _, phrases in dims.EXCLUSIONS), rules.out_of_scope(F.col("subject_key"))
    )
    zone = F.when(scope.isNotNull(), F.concat_ws("|", F.col("category"), parsing.unit_label(F.col("subject")), scope)).otherwise(F.col("category"))
    return named.withColumn("exclusion_id", rule).withColumn("boq_scope", scope).withColumn("zone_key", zone)


def zones(annotations: DataFrame) -> DataFrame:
    """One row for each document and zone: sums that are null where nothing was read, in first-seen order."""
    rows = classified(annotations).where("exclusion_id IS NULL AND (area_m2 IS NOT NULL OR length_lm IS NOT NULL)")
    return rows.groupBy("doc_id", "zone_key").agg(
        F.sum("area_m2").alias("area_m2"), F.sum("length_lm").alias("length_lm"), F.count("*").alias("annotation_count"),
        F.min("index").alias("first_seen"), F.first("category").alias("category"),
        F.array_join(F.array_sort(F.collect_set("subject")), "; ").alias("subjects"),
    )


def manholes(annotations: DataFrame) -> DataFrame:
    """Circles by document; a document that couldn't be read has null, not zero."""
    count = F.count_if(F.col("type") == "Circle")
    return annotations.groupBy("doc_id").agg(F.when(F.count("type") > 0, count).alias("manholes"))


def page_ranks(pages: DataFrame) -> DataFrame:
    """Pages of a document by priority, ties in page order; pages that failed come last."""
    from pyspark.sql.window import Window

    score = F.coalesce(F.when(F.col("failed"), -999), rules.drawing_priority(F.lit(""), F.col("text"), rules.discipline(F.col("path"))))
    kind = rules.page_kind(F.col("vector_paths"), F.col("area_markups"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "page")
    return pages.withColumn("score", score).withColumn("kind", kind).withColumn("place", F.row_number().over(w))
