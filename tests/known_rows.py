"""Operators over small rows whose results are known: drawing labels, priced lines, specifications, jobs.

The SQL either recomputes a result or states the rows that are expected.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from mensura.functions import dims, parsing, pricing, rules
from mensura.operators import annotations, jobs, quotation, relational, specs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def values(rows: list[tuple]) -> str:
    text = lambda v: "NULL" if v is None else f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else repr(v)
    return "VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


# The lines of a bill of quantities that is known to total 1,823,687.32.
BOQ = [
    ("Yard", "190mm slab C32/40", 26080, "m2", 44.89), ("Yard", "Final trim +/-50mm", 26080, "m2", 1.40), ("Yard", "Joints (4.9x6.5 bays)", 26080, "m2", 4.85),
    ("Yard", "E/O manhole details", 26, "Nr", 75.00), ("Yard", "Pouring top of channels", 731, "Lm", 17.50), ("Yard", "E/O transition details", 13, "Lm", 110.00),
    ("Yard", "24m boom pump", 1, "Item", 45900.00), ("Yard", "E/O 205mm w/ A393", 2930, "m2", 4.86),
    ("Dock", "250mm slab C32/40", 930, "m2", 63.37), ("Dock", "Final trim", 930, "m2", 1.50), ("Dock", "Perimeter edge formwork 250dp", 500, "Lm", 25.10),
    ("Dock", "24m boom pump", 1, "Item", 2700.00), ("Dock", "Foundation bases C40 (34no 2x2x1)", 136, "m3", 167.80), ("Dock", "A393 x2 in base bottoms", 272, "m2", 45.95),
    ("Dock", "E/O concrete wastage (dig by others)", 1, "Item", 2282.08),
    ("GF ancillary", "150mm slab C32/40", 520, "m2", 36.84), ("GF ancillary", "Final trim", 520, "m2", 1.50), ("GF ancillary", "Saw cuts & movement joints", 520, "m2", 3.80),
    ("GF ancillary", "Perimeter edge formwork 150dp", 190, "Lm", 15.00), ("GF ancillary", "E/O column details", 22, "Nr", 55.00), ("GF ancillary", "24m boom pump", 1, "Item", 4050.00),
    ("Upper floors", "130mm C30 on MD60 deck", 3692, "m2", 32.92), ("Upper floors", "24m mobile boom pump", 1, "Item", 5400.00),
    ("Prelims", "Accommodation/subsistence", 15, "weeks", 4250.00), ("Prelims", "Cubes (1 set/3 per 150m3)", 1, "Item", 17425.00), ("Prelims", "Skips for washing out", 15, "weeks", 1450.00),
    ("Prelims", "COSHH container", 15, "weeks", 225.00), ("Prelims", "Carbon reduction measure", 1, "Item", 19200.00), ("Prelims", "14m telehandler", 8, "weeks", 1750.00),
    ("Prelims", "O&M", 1, "Item", 750.00), ("Prelims", "Protection (Hessian & DPM)", 1, "Item", 3250.00),
]


@query(f"""
SELECT section, CAST(sum(CAST(qty AS DECIMAL(18,3)) * CAST(rate AS DECIMAL(18,2))) AS DOUBLE) AS amount, count(*) AS n_lines
FROM ({values(BOQ)}) t(section, description, qty, unit, rate) GROUP BY ROLLUP (section)""")
def boq_total(spark, d):
    lines = spark.createDataFrame([(s, x, q, u, float(r)) for s, x, q, u, r in BOQ], "section string, description string, qty int, unit string, rate double")
    value = pricing.money(F.col("qty").cast("decimal(18,3)") * F.col("rate").cast("decimal(18,2)"))
    return lines.rollup("section").agg(F.sum(value).cast("double").alias("amount"), F.count("*").alias("n_lines"))


PRICES = [("yard", 26080.0, 190, "A252", 1, 0.10), ("yard by defaults", 26080.0, 190, "A252", 1, 0.15), ("dock", 930.0, 250, "A393", 2, 0.10), ("unknown mesh", 10.0, 150, "X1", 1, 0.1), ("no area", None, 190, "A252", 1, 0.1), ("zero", 0.0, 190, "A252", 1, 0.1)]


@query(f"""
WITH z AS (SELECT * FROM ({values(PRICES)}) t(name, area, depth, mesh, layers, w)), m AS (SELECT * FROM ({values(list(dims.MESH_KG_M2.items()))}) t(mesh, kg)),
r AS (SELECT name, area, depth / 1000.0 * 128 * 1.03 + kg * layers * 850 / 1000.0 * (1 + w + 0.18) + 0.46 + 0.23 + 10 + 0.40 AS nett FROM z LEFT JOIN m USING (mesh)),
p AS (SELECT name, area, round(CAST(nett * 1.11 AS DECIMAL(28,8)), 2) AS rate FROM r)
SELECT name, CAST(rate AS DOUBLE) AS rate, CAST(CASE WHEN area > 0 THEN round(CAST(area AS DECIMAL(18,3)) * rate, 2) END AS DOUBLE) AS total FROM p""")
def rate_build_up(spark, d):
    z = spark.createDataFrame(PRICES, "name string, area double, depth_mm int, mesh string, layers int, steel_wastage double").join(F.broadcast(dims.mesh(spark)), "mesh", "left")
    s = {k: F.lit(v) for k, v in dims.DEFAULT_SPEC.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
    names = ("depth_mm", "conc_rate", "conc_wastage", "kg_m2", "layers", "steel_rate_t", "steel_wastage", "lap_acc", "dpm", "curing", "labour", "trim", "margin")
    parts = pricing.rate_parts(*(F.col(n) if n in z.columns else s[n] for n in names))
    priced = z.withColumn("rate", parts["rate"])
    return priced.select("name", F.col("rate").cast("double").alias("rate"), pricing.zone_price(F.col("area"), F.col("rate")).cast("double").alias("total"))


LABELS = [
    (1, "A = 26,080.2 sq m", 26080.2), (2, "Area = 930 m²", 930.0), (3, "A=520sqm", 520.0), (4, "Unit-1&2\r235.37 sq m", 235.37), (5, "1,000 sq ft", 92.90304),
    (6, "Allow 12.50 sq m at this rate", None), (7, "12345", None), (8, "", None), (9, None, None), (10, "5 m2\nA = 7 m2", 7.0),
]


@query(f"SELECT * FROM ({values([(i, e) for i, _, e in LABELS])}) t(id, area_m2)".replace("SELECT *", "SELECT CAST(id AS BIGINT) AS id, CAST(area_m2 AS DOUBLE) AS area_m2"))
def area_labels(spark, d):
    return spark.createDataFrame([(i, c) for i, c, _ in LABELS], "id long, content string").select("id", parsing.area_m2(F.col("content")).alias("area_m2"))


ANNOTATIONS = [
    ("a", 1, "Polygon", "Service Yard", "A = 100 sq m"), ("a", 2, "Polygon", " loading  dock ", "50 m2"), ("a", 3, "Polygon", "yard", "A = 20.5 sq m"), ("a", 4, "Polygon", "Yard Gatehouse", "A = 9 m2"),
    ("a", 5, "Circle", "MH", None), ("a", 6, "PolyLine", "Unit 1 channel", "12.5 m"), ("a", 7, "Line", "Channels", "500 mm"), ("b", 1, "Polygon", "Unit 4a first floor", "A = 70 m2"),
    ("b", 2, "Polygon", "3rd floor slab", "A = 30 m2"), ("b", 3, "Polygon", "mystery", "A = 1 m2"), ("b", 4, "Polygon", "gf slab", "no label"), ("b", 5, "Circle", "MH", None), ("b", 6, "Circle", "MH", None),
]
ZONES = [
    ("a", "external_yard", 120.5, None, 2, 1, "external_yard"), ("a", "dock", 50.0, None, 1, 2, "dock"), ("a", "channel", None, 13.0, 2, 6, "channel"),
    ("b", "upper_floor|Unit 4A|main_upper_floor", 70.0, None, 1, 1, "upper_floor"), ("b", "upper_floor", 30.0, None, 1, 2, "upper_floor"), ("b", "unclassified", 1.0, None, 1, 3, "unclassified"),
]


def _annotations(spark):
    return spark.createDataFrame(ANNOTATIONS, "doc_id string, index int, type string, subject string, content string")


@query(f"SELECT doc_id, zone_key, CAST(a AS DOUBLE) AS area_m2, CAST(l AS DOUBLE) AS length_lm, n AS annotation_count, i AS first_seen, category FROM ({values(ZONES)}) t(doc_id, zone_key, a, l, n, i, category)")
def marked_zones(spark, d):
    """Annotations to zones, with exclusions out and unknown subjects in a bucket of their own."""
    return annotations.zones(_annotations(spark)).select("doc_id", "zone_key", "area_m2", "length_lm", F.col("annotation_count").cast("int").alias("annotation_count"), "first_seen", "category")


@query("SELECT * FROM (VALUES ('a', 1), ('b', 2)) t(doc_id, manholes)")
def manhole_counts(spark, d):
    return annotations.manholes(_annotations(spark)).select("doc_id", F.col("manholes").cast("int").alias("manholes"))


PRICED = [("q1", "external_yard", 26080.0, 190, "A252", 0.10, 26, False), ("q1", "external_yard", 100.0, 190, "A252", 0.10, None, False), ("q2", "dock", 930.0, 250, "A393", 0.10, None, True), ("q3", "dock", 10.0, 250, "A393", 0.1, None, False), ("q3", "external_yard", 10.0, 190, "A252", 0.1, None, False)]


def _priced(spark):
    return spark.createDataFrame(PRICED, "doc_id string, category string, area_m2 double, depth_mm int, mesh string, steel_wastage double, manholes int, assumed boolean")


@query("""
WITH l(doc_id, section, description, qty, rate, role) AS (VALUES ('q1', 'Yard', '190mm slab A252', 26180, 44.89, 'slab'), ('q1', 'Yard', 'Final trim', 26180, 1.40, 'trim'), ('q1', 'Yard', 'Joints', 26180, 4.85, 'joints'),
  ('q1', 'Yard', 'E/O manhole details', 26, 75.00, 'manholes'), ('q2', 'Dock', '250mm slab A393', 930, 56.33, 'slab'), ('q2', 'Dock', 'Final trim', 930, 1.40, 'trim'), ('q2', 'Dock', 'Joints', 930, 4.85, 'joints'),
  ('q3', 'Dock', '250mm slab A393', 10, NULL, 'slab'), ('q3', 'Dock', 'Final trim', 10, NULL, 'trim'), ('q3', 'Dock', 'Joints', 10, NULL, 'joints'),
  ('q3', 'Yard', '190mm slab A252', 10, NULL, 'slab'), ('q3', 'Yard', 'Final trim', 10, NULL, 'trim'), ('q3', 'Yard', 'Joints', 10, NULL, 'joints'))
SELECT doc_id, section, description, CAST(qty AS DOUBLE) AS qty, CAST(rate AS DOUBLE) AS rate, CAST(round(CAST(qty AS DECIMAL(18,3)) * rate, 2) AS DOUBLE) AS value, role FROM l""")
def quotation_lines(spark, d):
    """Lines of quotations; a drawing of several sections is listed without rates."""
    got = quotation.lines(_priced(spark))
    return got.select("doc_id", "section", "description", *(F.col(c).cast("double").alias(c) for c in ("qty", "rate", "value")), "role")


TEXTS = [
    ("t1", "a.pdf", 1, "175 mm thick with A193 mesh, C32/40 concrete", ""), ("t2", "b.pdf", 1, "200mm slab with two layers of A393 reinforcement C35/45", ""),
    ("t3", "c.pdf", 1, "190 mm thick slab here. 200 mm thick slab there.", ""), ("t4", "d.pdf", 1, "Check: 150 mm when printed. Yard slab 190 mm thick concrete.", ""), ("t5", "e.pdf", 1, None, None),
]
CHOSEN = [("t1", "depth_mm", "175", False), ("t1", "mesh", "A193", False), ("t1", "conc_mix", "C32/40", False), ("t2", "depth_mm", "200", False), ("t2", "mesh", "A393", False), ("t2", "layers", "2", False), ("t2", "conc_mix", "C35/45", False), ("t3", "depth_mm", None, True), ("t4", "depth_mm", "190", False)]


@query(f"SELECT * FROM ({values(CHOSEN)}) t(doc_id, field, value, conflict)")
def spec_fields(spark, d):
    """Specification fields out of text; equally strong values are a conflict."""
    found = specs.candidates(spark.createDataFrame(TEXTS, "doc_id string, file string, page int, text string, context string"))
    return specs.selected(found, ["doc_id"]).select("doc_id", "field", "value", "conflict")


STATES = [
    (1, 100.0, True, "high", None, None), (2, 100.0, False, "high", None, None), (3, 100.0, None, "high", None, None), (4, None, True, "high", None, None), (5, 70000.0, True, "high", None, None),
    (6, 100.0, True, "low", None, None), (7, 100.0, True, "high", 90.0, None), (8, 100.0, True, "high", None, "encrypted"), (9, 0.0, True, "high", None, None), (10, 101.0, True, "high", 100.0, None),
]


@query(f"""
SELECT id, CASE WHEN rejected IS NOT NULL AND rejected <> '' THEN 'REJECTED' WHEN area IS NULL THEN 'UNMEASURED' WHEN area > site * 1.02 OR area > 60000 OR area <= 0 THEN 'MEASURED_UNVERIFIED'
  WHEN scale IS NOT DISTINCT FROM false OR confidence = 'low' THEN 'MEASURED_UNVERIFIED' ELSE 'MEASURED_VERIFIED' END AS state
FROM (SELECT CAST(id AS BIGINT) AS id, CAST(area AS DOUBLE) AS area, CAST(scale AS BOOLEAN) AS scale, confidence, CAST(site AS DOUBLE) AS site, CAST(rejected AS VARCHAR) AS rejected
  FROM ({values(STATES)}) t(id, area, scale, confidence, site, rejected))""")
def quality_states(spark, d):
    s = spark.createDataFrame(STATES, "id long, area double, scale boolean, confidence string, site double, rejected string")
    return s.select("id", rules.measurement_state(*(F.col(c) for c in ("area", "scale", "confidence", "site", "rejected"))).alias("state"))


SCALES = [(1, 0.0894, 250, 1), (2, 0.0882, 250, 2), (3, 0.12, 250, 1), (4, 0.09, None, 0), (5, None, 500, 1), (6, None, None, 0), (7, 0.000001, 250, 1)]


@query("SELECT CAST(id AS BIGINT) AS id, verdict FROM (VALUES (1, 'verified'), (2, 'agrees with one of several'), (3, 'disagree'), (4, 'bar only'), (5, 'title only'), (6, 'none'), (7, 'implausible')) t(id, verdict)")
def scale_verdicts(spark, d):
    s = spark.createDataFrame(SCALES, "id long, bar double, title int, n int")
    return s.select("id", pricing.scale_decision(F.col("bar"), pricing.scale_of_title(F.col("title")), F.col("n"))["verdict"].alias("verdict"))


JOBS = [
    ("j1", 1, "pending", "approved", "2024-01-02", "2024-01-01", "P1", "/x/A.pdf", "AA"), ("j2", 2, "Approved ", None, "", "2024-01-03", "P1", "/y/A.pdf", "aa"), ("j3", 3, "pending", None, None, "2024-01-04", "P1", "/z/B.pdf", "bb"),
    ("j4", 4, None, "APPROVED", "2024-01-03", None, " ", "/z/B.pdf", None), ("j4", 5, None, "APPROVED", "2024-01-03", None, " ", "/z/B.pdf", None),
]


@query("""
SELECT * FROM (VALUES ('file', 'A.pdf', 'j2', 2), ('file', 'B.pdf', 'j4', 1), ('project', 'P1', 'j2', 2), ('sha256', 'aa', 'j2', 2)) t(match_type, key, latest, n)""")
def learned_patterns(spark, d):
    rows = spark.createDataFrame(JOBS, "job_id string, seq long, status string, decision string, decided_at string, created_at string, project_ref string, pdf_path string, document_sha256 string")
    got = jobs.learned_patterns(rows)
    return got.select("match_type", "key", F.col("latest.job_id").alias("latest"), F.col("n_history").cast("int").alias("n"))


SPANS = [("h", 0.0, 10.0), ("h", 12.0, 20.0), ("h", 24.0, 30.0), ("v", 5.0, 6.0), ("h", 1.0, 2.0)]


@query("SELECT axis, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, CAST(n AS BIGINT) AS n FROM (VALUES ('h', 0, 20, 3), ('h', 24, 30, 1), ('v', 5, 6, 1)) t(axis, low, high, n)")
def merged_runs(spark, d):
    """Runs of segments united over gaps of at most three."""
    return relational.merge_intervals(spark.createDataFrame(SPANS, "axis string, lo double, hi double"), ["axis"], "lo", "hi", 3.0)


SLABS = [("f1", "depth_mm", "190", None, None), ("f1", "mesh", "A252", "A193", None), ("f1", "layers", "1", "1", "2"), ("f1", "mix", None, None, None)]


@query("SELECT * FROM (VALUES ('f1', 'depth_mm', '190', 'default', true), ('f1', 'mesh', 'A193', 'existing', false), ('f1', 'layers', '2', 'confirmed', false)) t(slab, field, value, source, provisional)")
def layered_spec(spark, d):
    rows = spark.createDataFrame(SLABS, "slab string, field string, e string, x string, c string")
    side = lambda c: rows.select("slab", "field", F.col(c).alias("value"))
    return specs.layered(side("e"), side("x"), side("c"), ["slab", "field"])
