"""Domain queries over the driver tables.

Every query shapes rows of the domain (annotations, jobs, specifications, readings)
out of a whole table by plain SQL that both engines run, applies the library's
operators to them, and has SQL that computes the same result anew.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from mensura.functions import briefs, dims, geometry, parsing, pricing, rules, wording
from mensura.operators import annotations, jobs, quotation, relational, specs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

# Rows of the domain, by plain SQL over one table each.
ROWS = {
    "annotation": """
        SELECT p_partkey AS idx, p_partkey % 211 AS doc_id, p_size,
          CASE WHEN p_partkey % 13 = 4 THEN 'Circle' WHEN p_partkey % 13 IN (5, 6, 12) THEN 'PolyLine' ELSE 'Polygon' END AS type,
          CASE p_partkey % 13 WHEN 0 THEN 'Service Yard' WHEN 1 THEN ' loading  dock ' WHEN 2 THEN 'yard' WHEN 3 THEN 'Yard Gatehouse' WHEN 4 THEN 'MH' WHEN 5 THEN 'Unit 1 channel'
            WHEN 6 THEN 'Channels' WHEN 7 THEN 'Unit 4a first floor' WHEN 8 THEN '3rd floor slab' WHEN 9 THEN 'mystery' WHEN 10 THEN 'gf slab' WHEN 11 THEN 'internal warehouse slab'
            ELSE 'units 2 & 3 - transitions' END AS subject,
          CASE WHEN p_partkey % 13 = 4 THEN NULL WHEN p_partkey % 13 = 6 THEN CAST(p_size * 500 AS STRING) || ' mm' WHEN p_partkey % 13 IN (5, 12) THEN CAST(p_size AS STRING) || '.5 m'
            WHEN p_partkey % 7 = 0 THEN 'no label' WHEN p_partkey % 2 = 0 THEN 'A = ' || CAST(p_size AS STRING) || '.25 sq m' ELSE 'Zone' || chr(10) || CAST(p_size AS STRING) || ' m2' END AS content
        FROM {part}""",
    "job": """
        SELECT CAST(o_orderkey AS STRING) AS job_id, o_orderkey AS seq, CAST(o_orderdate AS STRING) AS decided_at, CAST(NULL AS STRING) AS created_at,
          CASE o_orderstatus WHEN 'F' THEN 'Approved ' WHEN 'O' THEN 'pending' ELSE 'processing' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'APPROVED' END AS decision,
          'P' || CAST(o_custkey % 50 AS STRING) AS project_ref, '/in/' || CAST(o_orderkey % 4 AS STRING) || '/D' || CAST(o_custkey AS STRING) || '.pdf' AS pdf_path,
          CASE WHEN o_custkey % 5 > 0 THEN 'AB' || CAST(o_custkey AS STRING) END AS document_sha256, o_custkey, CAST(o_totalprice AS DOUBLE) AS price,
          CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_totalprice AS DOUBLE) / 2 END AS area
        FROM {orders}""",
    "reading": """
        SELECT l_orderkey * 8 + l_linenumber AS id, CAST(l_quantity AS DOUBLE) AS q, CAST(l_extendedprice AS DOUBLE) AS price, CAST(l_discount AS DOUBLE) AS discount, l_linenumber AS n, l_partkey
        FROM {lineitem}""",
    "slab": """
        SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'Dock Slabs' WHEN 1 THEN NULL WHEN 2 THEN 'upper_floor' WHEN 3 THEN 'office' ELSE 'zzz' END AS kind, p_name AS name,
          CASE p_partkey % 4 WHEN 0 THEN 'Ground_Floor plan' WHEN 1 THEN 'Mezzanine' WHEN 2 THEN 'dock levellers' ELSE 'plain' END AS note,
          CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 100 + p_size * 5 END AS depth_mm,
          CASE p_partkey % 6 WHEN 0 THEN 'A142' WHEN 1 THEN 'A193' WHEN 2 THEN 'A252' WHEN 3 THEN 'A393' WHEN 4 THEN 'X9' END AS mesh,
          CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 3 END AS layers, CAST(p_retailprice AS DOUBLE) AS price, p_size
        FROM {part}""",
}
ROWS |= {
    "zone": """
        SELECT l_orderkey AS doc_id, CASE WHEN l_orderkey % 3 = 1 OR (l_orderkey % 3 = 0 AND l_suppkey % 2 = 0) THEN 'dock' ELSE 'external_yard' END AS category, CAST(l_quantity AS DOUBLE) AS area_m2,
          150 + 50 * (l_partkey % 2) AS depth_mm, CASE l_partkey % 3 WHEN 0 THEN 'A252' WHEN 1 THEN 'A393' ELSE 'X9' END AS mesh, CAST(0.10 AS DOUBLE) AS steel_wastage,
          CASE WHEN l_suppkey % 5 = 0 THEN l_linenumber END AS manholes, l_suppkey % 4 = 0 AS assumed
        FROM {lineitem}""",
    "span": """
        SELECT l_suppkey AS page, CASE WHEN l_partkey % 2 = 0 THEN 'h' ELSE 'v' END AS axis, CAST(7 * (l_partkey % 3000) AS DOUBLE) AS lo, CAST(7 * (l_partkey % 3000) + l_quantity AS DOUBLE) AS hi
        FROM {lineitem}""",
    "layer": """
        SELECT p_partkey AS slab, 'depth_mm' AS field, CAST(100 + p_size AS STRING) AS e, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS STRING) END AS x, CASE WHEN p_partkey % 5 = 0 THEN '175' END AS c
        FROM {part} UNION ALL
        SELECT p_partkey AS slab, 'mesh' AS field, CASE WHEN p_partkey % 4 > 0 THEN 'A252' END AS e, CASE WHEN p_partkey % 7 = 0 THEN 'A193' END AS x, CASE WHEN p_partkey % 8 = 4 THEN 'A393' END AS c
        FROM {part}""",
}
TABLES = ("part", "orders", "lineitem", "documents", "embeddings", "events")


def query(sql: str | None):
    """Registers a query; in its SQL ``{name}`` stands for rows of the domain."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            known = {t: t for t in TABLES}
            ORACLE_SQL[f.__name__] = sql.format(**{n: f"({r.format(**known)})" for n, r in ROWS.items()})
        return f

    return add


def rows(spark, d: str, name: str):
    return spark.sql(ROWS[name].format(**{t: f"parquet.`{d}/{t}.parquet`" for t in TABLES}))


ZONED = """z AS (SELECT *, idx % 13 AS k, CASE WHEN type = 'PolyLine' THEN CASE WHEN idx % 13 = 6 THEN p_size * 0.5 ELSE p_size + 0.5 END END AS length_lm,
    CASE WHEN type = 'Polygon' AND idx % 7 <> 0 THEN CASE WHEN idx % 2 = 0 THEN p_size + 0.25 ELSE p_size END END AS area_m2 FROM {annotation}),
  c AS (SELECT *, CASE k WHEN 0 THEN 'external_yard' WHEN 1 THEN 'dock' WHEN 2 THEN 'external_yard' WHEN 5 THEN 'channel' WHEN 6 THEN 'channel' WHEN 7 THEN 'upper_floor' WHEN 8 THEN 'upper_floor'
    WHEN 10 THEN 'ground_floor' WHEN 12 THEN 'transition' ELSE 'unclassified' END AS category FROM z WHERE k NOT IN (3, 4, 11) AND (area_m2 IS NOT NULL OR length_lm IS NOT NULL))"""


@query(f"""
WITH {ZONED}
SELECT doc_id, category || CASE WHEN k = 7 THEN '|Unit 4A|main_upper_floor' ELSE '' END AS zone_key, CAST(sum(area_m2) AS DOUBLE) AS area_m2, CAST(sum(length_lm) AS DOUBLE) AS length_lm,
  count(*) AS annotation_count, min(idx) AS first_seen, category FROM c GROUP BY ALL""")
def marked_zones(spark, d):
    """Annotations of all parts to zones, with exclusions and other works out and unknown subjects in a bucket of their own."""
    got = annotations.zones(rows(spark, d, "annotation").withColumnRenamed("idx", "index"))
    return got.select("doc_id", "zone_key", "area_m2", "length_lm", "annotation_count", "first_seen", "category")


@query("SELECT doc_id, count(CASE WHEN idx % 13 = 4 THEN 1 END) AS manholes FROM {annotation} GROUP BY doc_id")
def manhole_counts(spark, d):
    return annotations.manholes(rows(spark, d, "annotation"))


@query("""
SELECT idx, CASE WHEN idx % 13 IN (4, 5, 6, 12) OR idx % 7 = 0 THEN NULL WHEN idx % 2 = 0 THEN p_size + 0.25 ELSE CAST(p_size AS DOUBLE) END AS area_m2,
  CAST(CASE WHEN idx % 13 = 6 THEN p_size * 0.5 WHEN idx % 13 IN (5, 12) THEN p_size + 0.5 END AS DOUBLE) AS length_m,
  CASE idx % 13 WHEN 5 THEN 'Unit 1' WHEN 7 THEN 'Unit 4A' WHEN 12 THEN 'Unit 2' END AS unit, CASE WHEN idx % 13 = 7 THEN 'main_upper_floor' END AS scope,
  CASE idx % 13 WHEN 5 THEN 'unit 1' WHEN 12 THEN 'units 2 & 3' END AS linear_unit, CASE WHEN idx % 13 = 11 THEN 'internal_warehouse_scope' END AS out_of_scope
FROM {annotation}""")
def area_labels(spark, d):
    """What each label and subject states: areas, lengths, units and scopes."""
    a = rows(spark, d, "annotation")
    key = parsing.subject_key(F.col("subject"))
    length = F.when(F.col("type") == "PolyLine", parsing.length_m(F.col("content")))
    return a.select(
        "idx", parsing.area_m2(F.col("content")).alias("area_m2"), length.alias("length_m"), parsing.unit_label(F.col("subject")).alias("unit"), parsing.upper_scope(F.col("subject")).alias("scope"),
        rules.linear_unit(key).alias("linear_unit"), rules.out_of_scope(key).alias("out_of_scope"),
    )


STATE_SQL = """CASE WHEN n = 7 THEN 'REJECTED' WHEN n = 6 THEN 'UNMEASURED' WHEN price > 60000 OR price > q * 2000 * 1.02 THEN 'MEASURED_UNVERIFIED' WHEN discount = 0.05 OR n = 5 THEN 'MEASURED_UNVERIFIED' ELSE 'MEASURED_VERIFIED' END"""


def _state():
    n = F.col("n")
    return rules.measurement_state(
        F.when(n != 6, F.col("price")), F.when(F.col("discount") == 0.05, False).when(F.col("discount") == 0.01, True), F.when(n == 5, "low").otherwise("high"), F.col("q") * 2000,
        F.when(n == 7, "encrypted"),
    )


@query(f"SELECT id, {STATE_SQL} AS state FROM {{reading}}")
def quality_states(spark, d):
    return rows(spark, d, "reading").select("id", _state().alias("state"))


@query(f"""
WITH s AS (SELECT *, {STATE_SQL} AS state FROM {{reading}}),
r AS (SELECT *, CASE WHEN id % 11 = 0 THEN 'zones stale' WHEN id % 13 = 0 THEN 'zones mismatch reference' WHEN id % 17 = 0 THEN 'zones overlap' WHEN n = 3 AND l_partkey % 4 = 0 THEN 'zones unclassified' END AS zone FROM s)
SELECT id, CASE WHEN zone IS NOT NULL THEN zone WHEN l_partkey % 19 = 0 THEN 'yard regions need review'
  WHEN l_partkey % 23 = 0 THEN CASE WHEN n = 1 THEN '2 area elements without section: path, Unnamed area' ELSE '1 area elements without section: path' END
  WHEN l_partkey % 29 = 0 THEN CASE WHEN n > 4 THEN '2' ELSE '1' END || ' channel proposals pending' WHEN l_partkey % 31 = 0 AND n = 2 THEN '1 transition candidates pending'
  WHEN id % 37 = 0 THEN 'specification needs pricing review' WHEN q > 45 THEN NULL WHEN state <> 'MEASURED_VERIFIED' THEN lower(state) END AS reason FROM r""")
def approval_gates(spark, d):
    """The first reason why a job can't be approved, over all gates."""
    r = rows(spark, d, "reading")
    some = lambda c, m: F.col(c) % m == 0
    kinds = F.array(F.lit("dock"), F.when((F.col("n") == 3) & some("l_partkey", 4), " Unclassified"))
    zone = rules.zone_block(some("id", 11), some("id", 13), some("id", 17), F.lit(False), kinds)
    names = F.when(some("l_partkey", 23), F.array(F.lit("yard"), F.lit("path"), F.lit(None)))
    sections = F.array(F.lit("Dock"), F.lit("footpath"), F.when(F.col("n") != 1, "dock"))
    elements = F.when(names.isNotNull(), rules.area_elements_block(names, sections))
    given = F.create_map(F.lit("a"), F.when(F.col("n") > 4, "edited").otherwise("accepted"))
    channels = F.when(some("l_partkey", 29), rules.pending(F.array(F.lit("a"), F.lit("b"), F.lit("")), given)).otherwise(0)
    moves = F.when(some("l_partkey", 31), rules.pending(F.array(F.lit("t")), F.create_map(F.lit("t"), F.when(F.col("n") == 2, "later").otherwise("removed")))).otherwise(0)
    reason = rules.approval_reason(_state(), F.col("q") > 45, zone, some("l_partkey", 19), elements, channels, moves, some("id", 37))
    return r.select("id", reason.alias("reason"))


@query("""
WITH k AS (SELECT id, q * (CAST(0.0254 AS DOUBLE) / 72) AS bar, CASE WHEN n < 3 THEN NULL ELSE CAST(floor(q) AS INTEGER) + n - 3 END AS denom, n, q FROM {reading})
SELECT id, CASE WHEN bar / (CAST(0.0254 AS DOUBLE) / 72) NOT BETWEEN 20 AND 5000 THEN 'implausible' WHEN denom IS NULL THEN 'bar only' WHEN abs(bar / (denom * (CAST(0.0254 AS DOUBLE) / 72)) - 1) > 0.05 THEN 'disagree'
  WHEN n = 3 THEN 'verified' ELSE 'agrees with one of several' END AS verdict FROM k""")
def scale_verdicts(spark, d):
    r = rows(spark, d, "reading")
    bar, denom = F.col("q") * F.lit(dims.POINT_M), F.when(F.col("n") >= 3, F.floor("q").cast("int") + F.col("n") - 3)
    return r.select("id", pricing.scale_decision(bar, pricing.scale_of_title(denom), F.col("n") - 2)["verdict"].alias("verdict"))


@query("""
WITH k AS (SELECT *, CASE WHEN n > 1 THEN 10 * CAST(floor(q) AS INTEGER) END AS denom, CASE WHEN n = 2 THEN q END AS bay, CASE WHEN n IN (2, 3) THEN q * 3 END AS span, CASE WHEN n IN (2, 3, 4) THEN 7.5 END AS real_m FROM {reading}),
t AS (SELECT *, denom * (0.0254 / 72) AS title, CASE WHEN bay IS NOT NULL THEN 2.5 / bay WHEN span IS NOT NULL THEN real_m / span END AS feature FROM k)
SELECT id, round(CAST(coalesce(feature, title) AS DOUBLE), 9) AS k, CASE WHEN bay IS NOT NULL THEN 'bay' WHEN span IS NOT NULL THEN 'dimension' WHEN title IS NOT NULL THEN 'title' ELSE 'none' END AS source,
  coalesce(abs(title / feature - 1) > 0.05, false) AS title_differs, coalesce(denom >= 400, false) AS risky,
  CASE WHEN title IS NULL OR n > 3 THEN 'none' WHEN abs(title * q * 3 - 7.5) / 7.5 > 0.05 THEN 'unverified' ELSE 'verified' END AS feature_check
FROM t""")
def calibrated_scales(spark, d):
    """Scales by feature, dimension or title, with what disagrees."""
    n, q = F.col("n"), F.col("q")
    denom, span = F.when(n > 1, 10 * F.floor(q).cast("int")), F.when(n.isin(2, 3), q * 3)
    real = F.when(n.isin(2, 3, 4), 7.5)
    got = pricing.calibrated(denom, F.when(n == 2, q), span, real)
    check = pricing.feature_check(pricing.scale_of_title(denom), span, real)
    return rows(spark, d, "reading").select(
        "id", F.round(got["k"], 9).alias("k"), got["source"].alias("source"), got["title_differs"].alias("title_differs"), pricing.boundary_risk(denom, 400).alias("risky"), check.alias("feature_check")
    )


@query("""
WITH a AS (SELECT * FROM {job} WHERE lower(trim(status)) = 'approved' OR lower(decision) = 'approved'),
k AS (SELECT 'file' AS match_type, 'D' || CAST(o_custkey AS VARCHAR) || '.pdf' AS key, job_id, decided_at, seq FROM a UNION ALL SELECT 'project', project_ref, job_id, decided_at, seq FROM a
  UNION ALL SELECT 'sha256', lower(document_sha256), job_id, decided_at, seq FROM a WHERE document_sha256 IS NOT NULL)
SELECT match_type, key, arg_max(job_id, (decided_at, seq)) AS latest, CAST(count(*) AS INTEGER) AS n FROM k GROUP BY ALL""")
def learned_patterns(spark, d):
    got = jobs.learned_patterns(rows(spark, d, "job"))
    return got.select("match_type", "key", F.col("latest.job_id").alias("latest"), F.col("n_history").cast("int").alias("n"))


@query("""
WITH a AS (SELECT * FROM {job} WHERE lower(trim(status)) = 'approved' OR lower(decision) = 'approved')
SELECT project_ref, count(*) AS n_jobs, count(area) AS n_delta, round(avg(area - price), 4) AS mean_delta FROM a GROUP BY project_ref""")
def job_deltas(spark, d):
    """Approved jobs of each project and how far their areas moved."""
    j = rows(spark, d, "job")
    episodes = j.select("job_id", F.col("price").alias("initial_area_m2"), F.col("area").alias("terminal_area_m2"))
    got = jobs.delta_report(episodes, j)
    return got.select("project_ref", "n_jobs", "n_delta", F.round("mean_delta", 4).alias("mean_delta"))


@query("""
SELECT job_id, CASE WHEN status = 'processing' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'processing' THEN 'UNMEASURED' ELSE 'MEASURED_VERIFIED' END AS measurement_state,
  CASE WHEN status = 'processing' THEN 1 ELSE 0 END AS n_flags FROM {job}""")
def swept_jobs(spark, d):
    j = rows(spark, d, "job").select("job_id", "status", F.lit("MEASURED_VERIFIED").alias("measurement_state"), F.array().cast("array<string>").alias("flags"))
    return jobs.swept(j).select("job_id", "status", "measurement_state", F.size("flags").alias("n_flags"))


@query("""
SELECT id, CASE WHEN kind = 'Dock Slabs' THEN 'dock' WHEN kind = 'upper_floor' THEN kind WHEN kind = 'office' THEN 'ground_floor' WHEN id % 4 = 2 THEN 'dock' WHEN id % 4 = 1 THEN 'upper_floor' ELSE 'external_yard' END AS slab,
  CASE WHEN depth_mm IS NULL THEN 'No details provided' ELSE CAST(depth_mm AS VARCHAR) || ' mm' || CASE WHEN id % 2 = 0 THEN ' — ASSUMED / provisional' ELSE '' END END AS shown,
  depth_mm IS NULL OR depth_mm > 0 AS allowed,
  CASE WHEN id % 4 = 1 THEN 'upper_floor' ELSE 'dock' END || '|depth_mm=' || coalesce(CAST(depth_mm AS VARCHAR), '') || '=' || CASE WHEN id % 2 = 0 THEN 'true' ELSE 'false' END || ';mesh=' || coalesce(mesh, '') || '=true' AS signature,
  'f' || CAST(id % 3 AS VARCHAR) || CASE WHEN p_size > 25 THEN ', page ' || CAST(p_size - 25 AS VARCHAR) ELSE '' END AS citation
FROM {slab}""")
def brief_specifications(spark, d):
    """Slab types, what is shown of a value, its check, a brief's signature and its source."""
    s = rows(spark, d, "slab")
    assumed, depth = F.col("id") % 2 == 0, F.col("depth_mm").cast("string")
    field = lambda n, v, p: F.struct(F.lit(n).alias("field"), v.alias("value"), p.alias("provisional"))
    fields = F.array(field("mesh", F.col("mesh"), F.lit(None).cast("boolean")), field("depth_mm", depth, assumed))
    return s.select(
        "id", briefs.slab_type(F.col("kind"), F.col("note")).alias("slab"), briefs.shown(F.lit("depth_mm"), depth, assumed, F.lit("")).alias("shown"),
        briefs.supplied(F.lit("depth_mm"), depth)["allowed"].alias("allowed"), briefs.signature(F.when(F.col("id") % 4 == 1, "upper_floor").otherwise("dock"), fields).alias("signature"),
        wording.citation(F.concat(F.lit(" f"), (F.col("id") % 3).cast("string")), F.col("p_size") - 25).alias("citation"),
    )


@query("""
SELECT id, CASE WHEN depth_mm IS NOT NULL THEN CAST(depth_mm AS VARCHAR) || 'mm. th ' ELSE '' END || 'Concrete Slabs C32/40' || CASE WHEN id % 2 = 0 THEN ' AE' ELSE '' END || ' 20mm agg.' AS concrete,
  CASE WHEN mesh IS NOT NULL THEN mesh || ' ' ELSE '' END || 'Mesh Fabric' || CASE layers WHEN 1 THEN ' x Single Layer' WHEN 2 THEN ' x 2 Layers' ELSE '' END AS mesh_row,
  CASE id % 3 WHEN 0 THEN 'Joints (Excl. Mastic) - Based on 4.9m wide x ' || CAST(p_size AS VARCHAR) || 'm long bays' WHEN 1 THEN 'Saw Cuts and Movement Joints (Excl. Mastic)' ELSE 'Saw Cuts and Movement Joints' END AS joints,
  CASE id % 4 WHEN 0 THEN 'E/O for channels' WHEN 1 THEN 'E/O for MH details' WHEN 2 THEN 'E/O for transition details' END AS extra_over,
  CASE id % 3 WHEN 0 THEN 'm2' WHEN 1 THEN 'Lm' ELSE 'weeks' END AS unit, CASE id % 3 WHEN 0 THEN 'External Yard Slabs' WHEN 1 THEN 'Ground Floor Slabs' ELSE 'Prelims' END || CASE WHEN id % 3 < 2 AND id % 2 = 0 THEN '- Provisional Cost (No Details)' ELSE '' END AS title,
  CASE WHEN id % 5 = 0 THEN NULL ELSE 'Unit ' || CAST(id AS VARCHAR) || CASE WHEN p_size > 9 THEN ' (D' || CAST(p_size AS VARCHAR) || ')' ELSE '' END END AS unit_of_file,
  CASE WHEN depth_mm IS NULL AND mesh IS NULL THEN 'no spec extracted — will use defaults' ELSE concat_ws(' / ', CAST(depth_mm AS VARCHAR) || ' mm', CASE WHEN layers IS NULL THEN mesh || ' mesh (layers not provided)' ELSE CAST(layers AS VARCHAR) || '× ' || mesh || ' mesh' END) END AS spec
FROM {slab}""")
def quotation_wording(spark, d):
    """All texts that a quotation's rows are worded by."""
    s, i = rows(spark, d, "slab"), F.col("id")
    section = F.when(i % 3 == 0, "External yard slabs").when(i % 3 == 1, "Ground floor slabs").otherwise("Prelims")
    said = F.when(i % 4 == 0, "Channel length").when(i % 4 == 1, "Manholes (3 nr)").when(i % 4 == 2, "transition — T1").otherwise("pump")
    file = F.when(i % 5 == 0, "drawing.pdf").otherwise(F.concat(F.lit("External unit-"), i.cast("string"), F.lit(" d"), F.col("p_size").cast("string"), F.lit(".pdf")))
    return s.select(
        "id", wording.concrete(F.col("depth_mm"), F.lit("C32/40"), i % 2 == 0, F.lit(20)).alias("concrete"), wording.mesh(F.col("mesh"), F.col("layers")).alias("mesh_row"),
        wording.joints(section, F.concat(F.lit("4.90 m x "), F.col("p_size").cast("string"), F.lit(" m bays"))).alias("joints"), wording.extra_over(said).alias("extra_over"),
        wording.unit(F.when(i % 3 == 0, "M²").when(i % 3 == 1, "LM").otherwise("weeks")).alias("unit"), wording.section_title(section, i % 2 == 0).alias("title"),
        wording.unit_of_file(file).alias("unit_of_file"), wording.specification(F.col("depth_mm"), F.col("mesh"), F.col("layers"), F.lit(None).cast("string")).alias("spec"),
    )


@query("""
SELECT id, CASE id % 4 WHEN 0 THEN '''=' || name WHEN 1 THEN '''-' || name ELSE name END AS cell, CASE WHEN id % 3 = 2 THEN NULL ELSE DATE '2024-03-05' END AS day,
  CAST(p_size AS VARCHAR) || CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN '.5' ELSE '.25' END AS quantity, 'P_1_D_' || CAST(id AS VARCHAR) || '_REV_0' || CAST(id % 4 AS VARCHAR) || '_MARKED.pdf' AS marked_file,
  CASE id % 3 WHEN 0 THEN '50-90mm' WHEN 1 THEN '100-150mm' END AS slump, CASE WHEN id % 4 = 0 THEN 'area' WHEN id % 4 = 1 THEN 'length' WHEN id % 4 = 2 THEN 'perimeter' ELSE 'unparsed' END AS kind,
  CASE id % 4 WHEN 0 THEN 'engineer' WHEN 1 THEN 'architect' WHEN 2 THEN 'engineer' ELSE 'unknown' END AS discipline, CASE WHEN id % 4 IN (0, 2) OR id % 8 = 3 THEN 'detail' ELSE 'assume' END AS build_up,
  'unit' || CAST(id AS VARCHAR) || 'yard' AS drawing_key, CASE WHEN id % 3 = 0 THEN '-' ELSE format('{{:,.1f}}', price) END AS number,
  CASE WHEN id % 2 = 0 THEN 'Slab [PROVISIONAL]' ELSE 'Slab' END AS provisional, 'Build-up ASSUMED: ' || CAST(p_size AS VARCHAR) || ' mm slab, A252 mesh (C32/40 concrete)' AS note,
  CAST(p_size * 1.5 AS DOUBLE) AS first_number
FROM {slab}""")
def label_scalars(spark, d):
    """Names, cells, dates and numbers of labels and files."""
    s, i = rows(spark, d, "slab"), F.col("id")
    day = F.when(i % 3 == 0, "5 March 2024").when(i % 3 == 1, "05/03/2024").otherwise("soon")
    path = F.concat(F.lit("/p/"), F.when(i % 4 == 0, "BWB").when(i % 4 == 1, "SGP").when(i % 4 == 2, "x-DR-C-1").otherwise("misc"), F.lit("/a.pdf"))
    name = F.when(i % 8 == 3, "Typical detail").otherwise("plan")
    number = lambda k: F.when(i % 4 == k, 1.0)
    return s.select(
        "id", parsing.sheet_text(F.concat(F.when(i % 4 == 0, "=").when(i % 4 == 1, "-").otherwise(""), F.col("name"))).alias("cell"), parsing.sheet_date(day).alias("day"),
        parsing.quantity_text(F.col("p_size") + F.when(i % 3 == 0, 0.0).when(i % 3 == 1, 0.5).otherwise(0.25)).alias("quantity"),
        parsing.marked_file_name(F.lit("P 1"), F.concat(F.lit("D#"), i.cast("string")), i % 4).alias("marked_file"), parsing.slump_label(F.when(i % 3 == 0, "s2").when(i % 3 == 1, " S3 ").otherwise("X")).alias("slump"),
        parsing.measurement_kind(number(0), number(1), number(2)).alias("kind"), rules.discipline(path).alias("discipline"), rules.build_up_source(name, rules.discipline(path)).alias("build_up"),
        parsing.drawing_key(F.concat(F.lit("/x/Marked Unit-"), i.cast("string"), F.lit("_yard copy.PDF"))).alias("drawing_key"),
        wording.grouped_number(F.when(i % 3 != 0, F.col("price"))).alias("number"), wording.provisional(F.lit("Slab"), i % 2 == 0).alias("provisional"),
        briefs.assumption_note(F.col("p_size"), F.lit("A252"), F.lit(None).cast("string")).alias("note"),
        parsing.numbers(F.concat(F.lit("w "), (F.col("p_size") * 1.5).cast("string"), F.lit(" x 7")))[0].alias("first_number"),
    )


@query("""
WITH t AS (SELECT p_partkey % 100 AS doc, CASE p_partkey % 6 WHEN 0 THEN 'external_yard' WHEN 1 THEN 'dock' WHEN 2 THEN 'ground_floor' ELSE 'channel' END AS category, sum(p_size) AS v, sum(p_size + p_partkey % 2) AS m,
  bool_and(p_partkey % 100 < 90) AS has_m FROM part GROUP BY ALL),
c AS (SELECT doc, category FROM (SELECT DISTINCT doc FROM t) CROSS JOIN (SELECT unnest(['external_yard', 'dock', 'ground_floor', 'upper_floor', 'channel', 'transition']) AS category)),
j AS (SELECT c.doc, c.category, CASE WHEN c.category <> 'dock' THEN t.v END AS truth, CASE WHEN t.has_m AND NOT (c.category = 'ground_floor' AND c.doc % 2 = 0) THEN t.m END AS measured FROM c LEFT JOIN t USING (doc, category))
SELECT doc, category, CAST(truth AS BIGINT) AS truth, CAST(measured AS BIGINT) AS measured, round((measured - truth) / abs(CAST(truth AS DOUBLE)) * 100, 6) AS delta_pct,
  CASE WHEN truth IS NULL AND measured IS NULL THEN 'NOT APPLICABLE' WHEN truth IS NULL THEN 'FAIL - unexpected measured zone' WHEN measured IS NULL THEN 'FAIL - missing measured zone'
    WHEN abs((measured - truth) / abs(CAST(truth AS DOUBLE)) * 100) <= 2 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM j""")
def compared_zones(spark, d):
    """Truth against measurement over the fixed domain of zones, with missing and unexpected ones."""
    kind = "CASE p_partkey % 6 WHEN 0 THEN 'external_yard' WHEN 1 THEN 'dock' WHEN 2 THEN 'ground_floor' ELSE 'channel' END AS category"
    p = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey % 100 AS doc", kind, "CAST(p_size AS BIGINT) AS truth", "CAST(p_size + p_partkey % 2 AS BIGINT) AS measured")
    truth, measured = p.where("category <> 'dock'").select("doc", "category", F.col("truth").alias("v")), p.where("doc < 90 AND NOT (category = 'ground_floor' AND doc % 2 = 0)").select("doc", "category", F.col("measured").alias("v"))
    docs = p.select("doc", "category", F.lit(None).cast("bigint").alias("v"))
    got = relational.compared(truth.unionByName(docs), measured, ["doc"], "category", "v", list(dims.ZONE_ORDER), 2.0)
    return got.select("doc", "category", "truth", "measured", F.round("delta_pct", 6).alias("delta_pct"), "verdict")


@query("""
WITH m(mesh, kg) AS (VALUES ('A142', 2.22), ('A193', 3.02), ('A252', 3.95), ('A393', 6.16), ('B785', 8.14)),
r AS (SELECT id, price, depth_mm, CAST(depth_mm AS DOUBLE) / 1000 * 128 * 1.03 + CAST(kg AS DOUBLE) * layers * 850 / 1000 * (1 + 0.15 + 0.18) + 0.46 + 0.23 + 10 + 0.40 AS nett FROM {slab} LEFT JOIN m USING (mesh))
SELECT id, CAST(round(CAST(nett * 1.11 AS DECIMAL(28,8)), 2) AS DOUBLE) AS rate, CAST(round(CAST(price AS DECIMAL(18,3)) * round(CAST(nett * 1.11 AS DECIMAL(28,8)), 2), 2) AS DOUBLE) AS total,
  CAST(round(CAST(price * depth_mm / 1000 * 1.03 AS DECIMAL(28,8)), 1) AS DOUBLE) AS cubes, CAST(CASE WHEN id % 3 = 0 THEN id % 10 * 75.0 + 75 WHEN id % 3 = 1 THEN 75.0 END AS DOUBLE) AS manholes, id % 3 = 1 AS manholes_assumed,
  CAST(CASE WHEN id % 4 = 2 THEN 0.5 WHEN id % 4 = 3 THEN 3.0 END AS DOUBLE) AS accepted_rate
FROM r""")
def slab_rates(spark, d):
    """Rates, totals, volumes, manhole lines and supplied rates of all slabs."""
    s = rows(spark, d, "slab").join(F.broadcast(dims.mesh(spark)), "mesh", "left")
    c, i = {k: F.lit(v) for k, v in dims.DEFAULT_SPEC.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}, F.col("id")
    names = ("depth_mm", "conc_rate", "conc_wastage", "kg_m2", "layers", "steel_rate_t", "steel_wastage", "lap_acc", "dpm", "curing", "labour", "trim", "margin")
    rate = pricing.rate_parts(*(F.col(n).cast("double") if n in s.columns else c[n] for n in names))["rate"]
    holes = pricing.manhole_line(F.when(i % 3 == 0, i % 10 + 1), F.when(i % 3 == 1, 1))
    supplied = pricing.valid_rate(F.when(i % 4 < 3, "margin").otherwise("labour"), F.when(i % 4 == 0, -1.0).when(i % 4 == 1, 1.5).when(i % 4 == 2, 0.5).otherwise(3.0))
    return s.select(
        "id", rate.cast("double").alias("rate"), pricing.zone_price(F.col("price"), rate).cast("double").alias("total"), pricing.cubes(F.col("price"), F.col("depth_mm"), F.lit(0.03)).cast("double").alias("cubes"),
        holes["amount"].cast("double").alias("manholes"), F.coalesce(holes["provisional"], F.lit(False)).alias("manholes_assumed"), supplied.alias("accepted_rate"),
    )


@query("""
WITH s AS (SELECT p_partkey % 97 AS legend, p_partkey AS id, p_size AS distance, p_partkey * 7 % 256 AS r, p_partkey * 11 % 256 AS g, p_partkey % 40 AS b FROM part),
p AS (SELECT *, greatest(r, g, b) > 30 AND least(r, g, b) < 245 AS plausible FROM s)
SELECT legend, id, plausible, greatest(abs(r - g), abs(g - b)) <= 5 AS grey FROM (SELECT *, row_number() OVER (PARTITION BY legend ORDER BY plausible DESC, distance, id) AS k FROM p) WHERE k = 1""")
def chosen_swatches(spark, d):
    """The legend swatch nearest to each label that may be a surface."""
    p = spark.read.parquet(f"{d}/part.parquet")
    s = p.selectExpr("p_partkey % 97 AS legend", "p_partkey AS id", "p_size AS distance", "p_partkey * 7 % 256 AS r", "p_partkey * 11 % 256 AS g", "p_partkey % 40 AS b")
    tint = lambda *c: tuple(map(F.col, c))
    s = s.withColumn("plausible", rules.surface_tint(*tint("r", "g", "b")))
    return relational.chosen_swatch(s, "legend", "distance", "plausible").select("legend", "id", "plausible", rules.tints_agree(tint("r", "g"), tint("g", "b")).alias("grey"))


@query("""
WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding[1:8]] AS v FROM embeddings),
p AS (SELECT vec_id, [{{'x': v[2 * i - 1], 'y': v[2 * i]}} FOR i IN range(1, 5)] AS q FROM e),
m AS (SELECT vec_id, q, list_max([a.x FOR a IN q]) - list_min([a.x FOR a IN q]) AS w, list_max([a.y FOR a IN q]) - list_min([a.y FOR a IN q]) AS h FROM p)
SELECT vec_id, round(sqrt((q[1].x - q[2].x) ** 2 + (q[1].y - q[2].y) ** 2) + sqrt((q[2].x - q[3].x) ** 2 + (q[2].y - q[3].y) ** 2) + sqrt((q[3].x - q[4].x) ** 2 + (q[3].y - q[4].y) ** 2) + sqrt((q[4].x - q[1].x) ** 2 + (q[4].y - q[1].y) ** 2), 9) AS perimeter,
  round((q[1].x + q[2].x + q[3].x + q[4].x) / 4, 9) AS cx, round((q[1].y + q[2].y + q[3].y + q[4].y) / 4, 9) AS cy, round(greatest(w, h) / least(w, h), 6) AS aspect, round(2 * q[1].x + q[1].y + 5, 9) AS moved_x,
  vec_id % 3 = 0 OR vec_id % 5 > 0 AS eligible, CASE WHEN vec_id % 4 = 0 THEN 10 ELSE 35 + CASE WHEN vec_id % 3 = 0 THEN 20 ELSE 0 END + CASE WHEN vec_id % 5 = 0 THEN 5 ELSE 20 END + CASE WHEN vec_id % 2 = 0 THEN 5 ELSE 0 END END AS confidence
FROM m""")
def outlines(spark, d):
    """Perimeter, centre, aspect, transform and confidence of outlines."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").selectExpr("vec_id", "transform(sequence(0, 3), i -> struct(CAST(embedding[2 * i] AS DOUBLE) AS x, CAST(embedding[2 * i + 1] AS DOUBLE) AS y)) AS q")
    q, i = F.col("q"), F.col("vec_id")
    fine = rules.eligible(F.lit(100.0), F.when(i % 5 == 0, 10_000_000.0).otherwise(1000.0), F.lit(1.0), i % 3 == 0, 50.0, 200.0)
    sure = rules.candidate_confidence(i % 4 != 0, i % 3 == 0, i % 5 == 0, F.when(i % 2 == 0, 2).otherwise(1))
    return e.select(
        "vec_id", F.round(geometry.perimeter(q), 9).alias("perimeter"), F.round(geometry.centroid(q)["x"], 9).alias("cx"), F.round(geometry.centroid(q)["y"], 9).alias("cy"), F.round(geometry.aspect(q), 6).alias("aspect"),
        F.round(geometry.affine(q, 2, 0, 1, 1, 5, 0)[0]["x"], 9).alias("moved_x"), fine.alias("eligible"), sure["score"].alias("confidence"),
    )


@query("""
WITH c AS (SELECT regexp_extract_all(text, '1\\s*:\\s*([0-9]{{1,5}})\\b', 1) AS found, doc_id FROM (SELECT doc_id, text || ' 1:' || CAST(doc_id % 7 * 50 + 20 AS VARCHAR) || ' at 1 : 500, 1:' || CAST(doc_id % 3 * 240 + 20 AS VARCHAR) AS text FROM documents WHERE text IS NOT NULL)),
e AS (SELECT doc_id, CAST(x AS BIGINT) AS denominator, i FROM (SELECT doc_id, unnest(found) AS x, unnest(range(len(found))) AS i FROM c)),
n AS (SELECT doc_id, denominator, count(*) AS n, min(i) AS place_at FROM e WHERE denominator BETWEEN 20 AND 5000 GROUP BY ALL)
SELECT doc_id, CAST(denominator AS INTEGER) AS denominator, n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, place_at) AS INTEGER) AS place FROM n""")
def title_scale_ranks(spark, d):
    """Title scales of every document by prevalence, then by place."""
    texts = spark.read.parquet(f"{d}/documents.parquet").where("text IS NOT NULL")
    extra = F.concat(F.col("text"), F.lit(" 1:"), (F.col("doc_id") % 7 * 50 + 20).cast("string"), F.lit(" at 1 : 500, 1:"), (F.col("doc_id") % 3 * 240 + 20).cast("string"))
    return relational.scale_rank(texts.select("doc_id", extra.alias("text")), "doc_id", "text")


@query("""
WITH t AS (SELECT p_partkey AS doc_id, p_size, p_partkey % 5 AS k, p_partkey % 4 AS m FROM part),
c AS (SELECT doc_id, 'depth_mm' AS field, CAST(100 + 5 * p_size AS VARCHAR) AS value, 9 + CASE WHEN k = 1 THEN 1 ELSE 0 END AS score FROM t
  UNION ALL SELECT doc_id, 'depth_mm', CAST(105 + 5 * p_size AS VARCHAR), 9 FROM t WHERE k = 2
  UNION ALL SELECT doc_id, 'mesh', CASE m WHEN 0 THEN 'A142' WHEN 1 THEN 'A193' WHEN 2 THEN 'A252' ELSE 'A393' END, 4 FROM t WHERE k = 3
  UNION ALL SELECT doc_id, 'aggregate_mm', '20', 4 FROM t WHERE k = 4 UNION ALL SELECT doc_id, 'wc_ratio', '0.45', 4 FROM t WHERE k = 4 UNION ALL SELECT doc_id, 'slump_class', 'S3', 4 FROM t WHERE k = 4
  UNION ALL SELECT doc_id, 'air_entrained', 'true', 4 FROM t WHERE k = 4 UNION ALL SELECT doc_id, 'bay_sizes', '4.9x6.5', 4 FROM t WHERE k = 4 UNION ALL SELECT doc_id, 'layers', '2', 10 FROM t WHERE k = 3)
SELECT doc_id, field, CASE WHEN count(*) = 1 OR field <> 'depth_mm' THEN min(value) END AS value, count(*) > 1 AS conflict FROM c WHERE field <> 'depth_mm' OR CAST(value AS INTEGER) BETWEEN 100 AND 400 GROUP BY doc_id, field""")
def spec_fields(spark, d):
    """Specification fields out of drawing texts; equally strong values are a conflict."""
    texts = """SELECT p_partkey AS doc_id, 'a.pdf' AS file, 1 AS page, '' AS context,
      'Check 300 mm when printed. ' || CAST(100 + 5 * p_size AS STRING) || 'mm thick slab on 150 mm sub-base.' ||
      CASE p_partkey % 5 WHEN 1 THEN ' Note one.' WHEN 2 THEN ' Then ' || CAST(105 + 5 * p_size AS STRING) || ' mm deep slab.'
        WHEN 3 THEN ' Two layers of ' || CASE p_partkey % 4 WHEN 0 THEN 'A142' WHEN 1 THEN 'A193' WHEN 2 THEN 'a252' ELSE 'A393' END || ' fabric.'
        WHEN 4 THEN ' Mix with 20 mm aggregate, w/c ratio 0.45, slump class S3, air-entrained; 4.9 x 6.5 m bays.' ELSE '' END AS text FROM parquet.`{}/part.parquet`"""
    found = specs.candidates(spark.sql(texts.format(d)))
    return specs.selected(found, ["doc_id"]).select("doc_id", "field", "value", "conflict")


@query("""
SELECT section, CAST(sum(round(CAST(CAST(q AS DECIMAL(18,3)) * CAST(price AS DECIMAL(18,2)) AS DECIMAL(28,8)), 2)) AS DOUBLE) AS amount, count(*) AS n_lines
FROM (SELECT *, CASE l_partkey % 4 WHEN 0 THEN 'Yard' WHEN 1 THEN 'Dock' WHEN 2 THEN 'Prelims' ELSE 'Upper floors' END AS section FROM {reading}) GROUP BY ROLLUP (section)""")
def boq_total(spark, d):
    """Priced lines by section and in all."""
    at = F.col("l_partkey") % 4
    r = rows(spark, d, "reading").withColumn("section", F.when(at == 0, "Yard").when(at == 1, "Dock").when(at == 2, "Prelims").otherwise("Upper floors"))
    value = pricing.money(F.col("q").cast("decimal(18,3)") * F.col("price").cast("decimal(18,2)"))
    return r.rollup("section").agg(F.sum(value).cast("double").alias("amount"), F.count("*").alias("n_lines"))


_MESH = "m(mesh, kg) AS (VALUES ('A142', 2.22), ('A193', 3.02), ('A252', 3.95), ('A393', 6.16), ('B785', 8.14))"


@query(f"""
WITH {_MESH}, r AS (SELECT id, CAST(depth_mm AS DOUBLE) / 1000 * 128 * 1.03 AS concrete, CAST(kg AS DOUBLE) * layers * 850 / 1000 * (1 + CASE WHEN id % 2 = 0 THEN 0.10 ELSE 0.15 END + 0.18) AS steel
  FROM {{slab}} LEFT JOIN m USING (mesh))
SELECT id, CAST(round(CAST(concrete AS DECIMAL(28,8)), 2) AS DOUBLE) AS concrete, CAST(round(CAST(steel AS DECIMAL(28,8)), 2) AS DOUBLE) AS steel,
  CAST(round(CAST((concrete + steel + 0.46 + 0.23 + 10 + 0.40) * 1.11 AS DECIMAL(28,8)), 2) AS DOUBLE) AS rate FROM r""")
def rate_build_up(spark, d):
    """Parts of the rate of all slabs, by both presets of steel wastage."""
    s = rows(spark, d, "slab").join(F.broadcast(dims.mesh(spark)), "mesh", "left").withColumn("steel_wastage", F.when(F.col("id") % 2 == 0, 0.10).otherwise(0.15))
    names = ("depth_mm", "conc_rate", "conc_wastage", "kg_m2", "layers", "steel_rate_t", "steel_wastage", "lap_acc", "dpm", "curing", "labour", "trim", "margin")
    parts = pricing.rate_parts(*(F.col(n).cast("double") if n in s.columns else F.lit(dims.DEFAULT_SPEC[n]) for n in names))
    return s.select("id", *(parts[c].cast("double").alias(c) for c in ("concrete", "steel", "rate")))


@query(f"""
WITH {_MESH}, z AS (SELECT *, CASE category WHEN 'dock' THEN 'Dock' ELSE 'Yard' END AS section FROM {{zone}} LEFT JOIN m USING (mesh)),
s AS (SELECT doc_id, count(DISTINCT section) AS n FROM z GROUP BY doc_id),
r AS (SELECT z.*, CASE WHEN n = 1 THEN round(CAST((CAST(depth_mm AS DOUBLE) / 1000 * 128 * 1.03 + CAST(kg AS DOUBLE) * 850 / 1000 * (1 + 0.10 + 0.18) + 0.46 + 0.23 + 10 + 0.40) * 1.11 AS DECIMAL(28,8)), 2) END AS rate
      FROM z JOIN s USING (doc_id)),
g AS (SELECT doc_id, section, depth_mm, mesh, rate, CAST(sum(area_m2) AS DECIMAL(18,3)) AS qty FROM r GROUP BY ALL),
l AS (SELECT doc_id, section, CAST(depth_mm AS VARCHAR) || 'mm slab ' || mesh AS description, qty, rate, 'slab' AS role FROM g
  UNION ALL SELECT doc_id, section, 'Final trim', qty, CASE WHEN rate IS NOT NULL THEN 1.40 END, 'trim' FROM g UNION ALL SELECT doc_id, section, 'Joints', qty, CASE WHEN rate IS NOT NULL THEN 4.85 END, 'joints' FROM g
  UNION ALL SELECT doc_id, section, 'E/O manhole details', sum(manholes), 75.00, 'manholes' FROM z GROUP BY doc_id, section HAVING sum(manholes) > 0)
SELECT doc_id, section, description, CAST(qty AS DOUBLE) AS qty, CAST(rate AS DOUBLE) AS rate, CAST(round(CAST(qty * CAST(rate AS DECIMAL(18,2)) AS DECIMAL(28,8)), 2) AS DOUBLE) AS value, role FROM l""")
def quotation_lines(spark, d):
    """Lines of the quotations of all orders; a drawing of several sections is listed without rates."""
    got = quotation.lines(rows(spark, d, "zone"))
    return got.select("doc_id", "section", "description", *(F.col(c).cast("double").alias(c) for c in ("qty", "rate", "value")), "role")


@query("""
WITH i AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY page, axis ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3 THEN 0 ELSE 1 END AS fresh FROM {span}),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY page, axis ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM i)
SELECT page, axis, min(lo) AS low, max(hi) AS high, count(*) AS n FROM n GROUP BY page, axis, k""")
def merged_runs(spark, d):
    """Runs of segments united over gaps of at most three."""
    return relational.merge_intervals(rows(spark, d, "span"), ["page", "axis"], "lo", "hi", 3.0)


@query("""
SELECT slab, field, coalesce(c, x, e) AS value, CASE WHEN c IS NOT NULL THEN 'confirmed' WHEN x IS NOT NULL THEN 'existing' ELSE 'default' END AS source, c IS NULL AND x IS NULL AS provisional
FROM {layer} WHERE coalesce(c, x, e) IS NOT NULL""")
def layered_spec(spark, d):
    """Fields of all slabs by precedence: confirmed over existing over effective."""
    r = rows(spark, d, "layer")
    side = lambda c: r.select("slab", "field", F.col(c).alias("value"))
    return specs.layered(side("e"), side("x"), side("c"), ["slab", "field"])
