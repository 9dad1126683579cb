"""Operators on small rows, with results worked out by hand or by plain Python."""

import io
import json
import random
import time
import zipfile
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from mensura.functions import dims, geometry, parsing, pricing, rules
from mensura.operators import jobs, matching, quotation, relational, specs
from mensura.sources import intake, stores
from mensura.streaming import events


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()


def wait(done, seconds=40):
    until = time.time() + seconds
    while not done():
        assert time.time() < until
        time.sleep(0.3)


def ring(*points):
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points))


def test_geometry(spark):
    square, hole = ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((1, 1), (3, 1), (3, 3), (1, 3))
    r = one(
        spark, area=geometry.shoelace(square), around=geometry.perimeter(square), line=geometry.polyline(square), net=geometry.net_area(square, F.array(hole)),
        two=geometry.shoelace(ring((0, 0), (1, 1))), middle=geometry.centroid(square)["x"], fine=geometry.valid(square, 3), few=geometry.valid(square, 5),
        iou=geometry.box_overlap(geometry.box(square), geometry.box(ring((5, 0), (15, 10), (5, 10)))), wide=geometry.aspect(ring((0, 0), (8, 0), (8, 2))),
        moved=geometry.affine(square, 0, 1, -1, 0, 5, 0)[1]["y"], bad=geometry.valid(ring((0, 0), (float("nan"), 1), (2, 2)), 3),
    )
    assert (r.area, r.around, r.line, r.net, r.two, r.middle) == (100, 40, 30, 96, None, 5)
    assert (r.fine, r.few, r.bad, r.wide, r.moved) == (True, False, False, 4, 10) and r.iou == pytest.approx(50 / 150)


def test_parsing(spark):
    s = F.lit
    r = one(
        spark, length=parsing.length_m(s("1,250 mm run")), feet=parsing.length_m(s("10 ft")), none=parsing.length_m(s("no unit 5")), unit=parsing.unit_label(s("units - 4a Upper floor")),
        scope=parsing.upper_scope(s("Unit 2 first floor")), deck=parsing.upper_scope(s("plant  deck")), scales=parsing.title_scales(s("1:250 @A1, 1 : 10, 1:500")),
        key=parsing.drawing_key(s("/x/Markup Project-Alpha_marked.pdf")), raw=parsing.drawing_key(s("Project Alpha.pdf")), cell=parsing.sheet_text(s("=1+1")),
        day=parsing.sheet_date(s("3 March 2024")), qty=parsing.quantity_text(s(12.50)), whole=parsing.quantity_text(s(100)),
        name=parsing.marked_file_name(s("P/1"), s("Yard plan"), s(3)), slump=parsing.slump_label(s("s3")), text=parsing.first_text(s(" "), s(None).cast("string"), s("x")),
    )
    assert r.length == pytest.approx(1.25) and r.feet == pytest.approx(3.048) and r.none is None
    assert (r.unit, r.scope, r.deck, r.scales) == ("Unit 4A", "main_upper_floor", "plant_deck", [250, 500])
    assert r.key == r.raw == "projectalpha" and r.cell == "'=1+1" and str(r.day) == "2024-03-03"
    assert (r.qty, r.whole, r.name, r.slump, r.text) == ("12.5", "100", "P_1_Yard_plan_REV_03_MARKED.pdf", "100-150mm", "x")


def test_rules(spark):
    n = F.lit(None)
    r = one(
        spark, civil=rules.discipline(F.lit("x-DR-C-01 civil.pdf")), arch=rules.discipline(F.lit("Hard Landscaping")), unknown=rules.discipline(n.cast("string")),
        over=rules.signed_delta_pct(F.lit(105.0), F.lit(100.0)), zero=rules.signed_delta_pct(F.lit(0.0), F.lit(0.0)), far=rules.signed_delta_pct(F.lit(-1.0), F.lit(0.0)),
        edge=rules.within_tolerance(F.lit(105.0), F.lit(100.0), F.lit(5.0)), past=rules.within_tolerance(F.lit(105.01), F.lit(100.0), F.lit(5.0)), none=rules.within_tolerance(n.cast("double"), F.lit(1.0), F.lit(5.0)),
        block=rules.approval_block(F.lit("UNMEASURED"), F.lit(True), n.cast("boolean"), n.cast("boolean"), F.lit(True), n.cast("boolean")),
        free=rules.approval_block(F.lit("UNMEASURED"), F.lit(True), *[n.cast("boolean")] * 4), held=rules.approval_block(F.lit("MEASURED_UNVERIFIED"), n.cast("boolean"), *[n.cast("boolean")] * 4),
        crash=rules.outcome(F.lit(False), F.lit(False), F.lit(5.0), n.cast("string"), F.array().cast("array<string>")), section=rules.section(F.lit("mystery"), F.lit("Roof")),
        flags=rules.implausible(F.lit(70000.0), F.lit(100.0)), priority=rules.drawing_priority(F.lit("External works"), F.lit("site plan"), F.lit("engineer")),
    )
    assert (r.civil, r.arch, r.unknown) == ("engineer", "architect", "unknown")
    assert (r.over, r.zero, r.far, r.edge, r.past, r.none) == (5, 0, float("-inf"), True, False, False)
    assert (r.block, r.free, r.held) == ("proposals need a decision", None, "unverified")
    assert r.crash == "SILENT_NUMBER" and r.section == dims.UNCLASSIFIED and r.flags == ["exceeds site", "exceeds single zone"] and r.priority == 3


def test_pricing(spark):
    r = one(
        spark, estimated=pricing.manhole_line(F.lit(0), F.lit(3)), none=pricing.manhole_line(F.lit(None).cast("int"), F.lit(0)), cubes=pricing.cubes(F.lit(100.0), F.lit(190), F.lit(0.03)),
        ratio=pricing.ratio_of_scale(F.lit(0.0882)), bay=pricing.scale_of_bay(F.lit(0.0)), k=pricing.scale_of_title(F.lit(0)),
    )
    assert r.estimated.asDict() == {"qty": 3, "amount": r.estimated.amount, "provisional": True} and float(r.estimated.amount) == 225
    assert r.none is None and float(r.cubes) == 19.6 and r.ratio == 250 and r.bay is None and r.k is None


def test_refusals_and_consensus(spark):
    rows = spark.createDataFrame([("a", "x", 5.0), ("a", "x", 5.0), ("a", "y", 4.0), ("b", "x", 5.0), ("b", "y", 4.5), ("c", "x", 1.0)], "k string, v string, s double")
    got = {r.k: (r.value, r.conflict) for r in relational.best_or_refuse(rows, ["k"], "v", "s").collect()}
    assert got == {"a": ("x", False), "b": (None, True), "c": ("x", False)}
    scale = spark.createDataFrame([("s", 50 / 500), ("t", 0.1), ("t", 10.0), ("u", -1.0), ("u", None)], "k string, v double")
    assert {r.k: r.agreed for r in relational.consensus(scale, ["k"], "v", 0.05).collect()} == {"s": 0.1, "t": None, "u": None}


@pytest.mark.parametrize("seed", range(3))
def test_nearest_and_range_against_loops(spark, seed):
    r = random.Random(seed)
    left = [(i, r.choice("ab"), float(r.randint(0, 60))) for i in range(40)]
    right = [(100 + i, r.choice("abc"), float(r.randint(0, 60))) for i in range(25)]
    l, h = spark.createDataFrame(left, "id int, k string, at double"), spark.createDataFrame(right, "rid int, k string, at double")
    got = {x.id: (x.distance, x.nearest) for x in relational.nearest(l, h, ["k"], "at", "at", "rid").collect()}
    for i, k, at in left:
        assert got[i] == min(((abs(at - b), j) for j, kk, b in right if kk == k), default=(None, None))
    spans = spark.createDataFrame([(j, b, b + r.randint(0, 20)) for j, _, b in right], "rid int, lo double, hi double")
    pairs = {(x.id, x.rid) for x in relational.range_join(l, spans, "at", "lo", "hi", 7.0).collect()}
    assert pairs == {(i, s.rid) for i, _, at in left for s in spans.collect() if s.lo <= at <= s.hi}


def test_pairs_of_equal_ranges_are_few_bytes(spark, tmp_path):
    left = spark.range(40).selectExpr("id", "CAST(14 + id % 7 AS DOUBLE) AS at")
    spans = spark.range(40000).selectExpr("id AS rid", "CAST(id % 2 AS DOUBLE) AS lo", "30.0D AS hi")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        relational.range_join(left, spans, "at", "lo", "hi", 7.0).select("id", "rid").write.parquet(f"{tmp_path}/out")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    pairs = spark.read.parquet(f"{tmp_path}/out")
    assert pairs.count() == pairs.distinct().count() == 40 * 40000
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 0.5 * 40 * 40000
    alone = relational.range_join(left, spans.select("lo", "hi"), "at", "lo", "hi", 7.0)
    assert alone.columns == ["id", "at", "lo", "hi"] and alone.count() == 40 * 40000


def test_pairing_uses_each_raw_drawing_once(spark):
    m = spark.createDataFrame([("k", "/m/B.pdf"), ("k", "/m/a.pdf"), ("z", "/m/z.pdf")], "name string, path string")
    raw = spark.createDataFrame([("k", "/raw/a.pdf"), ("k", "/x/a.pdf"), ("k", "/x/c.pdf"), ("y", "/x/y.pdf")], "name string, path string")
    got = {(r.marked, r.raw) for r in matching.pair_names(m, raw, "name").collect()}
    assert got == {("/m/a.pdf", "/raw/a.pdf"), ("/m/B.pdf", "/x/a.pdf"), (None, "/x/c.pdf"), ("/m/z.pdf", None), (None, "/x/y.pdf")}


def test_boxes(spark):
    b = spark.createDataFrame([("p", 1, 0.0, 0.0, 10.0, 10.0, 1), ("p", 2, 0.0, 0.0, 10.0, 9.5, 0), ("p", 3, 5.0, 0.0, 15.0, 10.0, 1), ("q", 4, 0.0, 0.0, float("nan"), 1.0, 1)], "page string, id int, x0 double, y0 double, x1 double, y1 double, rank int")
    assert {r.id for r in matching.drop_overlapping(b, "page").collect()} == {2, 3, 4}
    got = {r.key: (r.area, r.overlaps) for r in matching.union_area(b, "page").collect()}
    assert got["p"] == (150.0, True) and got["q"] == (0.0, False)


@pytest.mark.parametrize("swept", [None, 3])
def test_union_area_of_crowded_rectangles_is_exact(spark, monkeypatch, swept):
    if swept:
        monkeypatch.setattr(matching, "SWEPT", swept)
    r = random.Random(5)
    boxes = [(k, x, y, x + r.randint(1, w), y + r.randint(1, w)) for k, w in (("a", 9), ("b", 40)) for x, y in ((r.randint(-30, 30), r.randint(-30, 30)) for _ in range(60))]
    thirds = [("c", *(v / 3 for v in b[1:])) for b in boxes]
    got = {g.key: g.area for g in matching.union_area(spark.createDataFrame([(k, *map(float, b)) for k, *b in boxes + thirds], "key string, x0 double, y0 double, x1 double, y1 double"), "key").collect()}
    for k in "ab":
        assert got[k] == len({(x, y) for q, x0, y0, x1, y1 in boxes if q == k for x in range(x0, x1) for y in range(y0, y1)})
    assert got["c"] * 9 == pytest.approx(len({(x, y) for _, x0, y0, x1, y1 in boxes for x in range(x0, x1) for y in range(y0, y1)}), rel=1e-12)


def test_intake_makes_one_row_of_everything(spark, tmp_path):
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("in/a.pdf", b"%PDF-1.4 a")
        z.writestr("../evil.pdf", b"%PDF-1.4 b")
        z.writestr("notes.txt", b"x")
    mail = EmailMessage()
    mail.set_content("see attached")
    mail.add_attachment(b"%PDF-1.7 c", maintype="application", subtype="pdf", filename="c.pdf")
    for name, content in {"u.zip": archive.getvalue(), "bad.zip": b"PK no", "m.eml": bytes(mail), "d.pdf": b"%PDF-1.5", "e.pdf": b"", "f.pdf": b"hello"}.items():
        (tmp_path / name).write_bytes(content)
    rows = intake.jobs(intake.members(intake.files(spark, str(tmp_path)))).collect()
    got = {(r.path.rsplit("/", 1)[-1], r.file): (r.status, r.reason) for r in rows}
    assert got[("u.zip", "in_a.pdf")] == ("processing", None) and got[("m.eml", "c.pdf")] == ("processing", None) and got[("d.pdf", "d.pdf")] == ("processing", None)
    assert sorted(v[1] for v in got.values() if v[1]) == ["corrupt archive", "empty file", "not a PDF", "unsafe name"] and len(rows) == 7


def test_stores(spark, tmp_path):
    lines = spark.createDataFrame([('{"job_id":"test_1"}',), ('{"job_id":"j2"}',), ("not json",), ("  ",), ("[1]",)], "value string")
    kept = stores.clean_log(lines, lambda m: rules.is_fixture(m["job_id"], m["env"], m["file"]))
    assert {r.value for r in kept.collect()} == {'{"job_id":"j2"}', "not json", "[1]"}
    (tmp_path / "x.json").write_text('{"a": 1}\n{bad\n')
    assert sorted((r.a, r._corrupt) for r in stores.read_json_rows(spark, str(tmp_path / "x.json"), "a int").collect() if r._corrupt is None) == [(1, None)]
    for n in (3, 5):
        stores.replace(spark.range(n), str(tmp_path / "jobs"))
        assert spark.read.parquet(str(tmp_path / "jobs")).count() == n
    for v in (0, 1):
        stores.append_revision(spark.range(2).withColumn("revision", F.lit(v)), str(tmp_path / "issued"))
    assert spark.read.parquet(str(tmp_path / "issued")).count() == 4


def test_jobs(spark):
    e = spark.createDataFrame([("j", 2, "2024-01-01", {"a": "1"}, {"a": "2", "b": None}), ("j", 1, "2024-01-01", {}, {"a": "1"})], "job_id string, event_id int, at string, before map<string,string>, after map<string,string>")
    assert [(r.event_id, r.sequence, r.changed) for r in jobs.numbered_events(e).orderBy("sequence").collect()] == [(1, 1, ["a"]), (2, 2, ["a"])]
    issued = spark.createDataFrame([("q", 0, 10.0)], "ref string, revision int, total double")
    more = spark.createDataFrame([("q", "t1", 11.0), ("q", "t2", 12.0), ("r", "t1", 1.0)], "ref string, at string, total double")
    assert {(r.ref, r.revision, r.total) for r in jobs.revised(issued, more, "ref").collect()} == {("q", 0, 10.0), ("q", 1, 11.0), ("q", 2, 12.0), ("r", 0, 1.0)}
    stuck = spark.createDataFrame([("processing", None, None), ("done", "MEASURED_VERIFIED", ["x"])], "status string, measurement_state string, flags array<string>")
    assert [(r.status, r.measurement_state) for r in jobs.swept(stuck).collect()] == [("pending", "UNMEASURED"), ("done", "MEASURED_VERIFIED")]


def test_quotation_documents(spark):
    z = spark.createDataFrame([("q", "dock", 930.0, 250, "A393", 0.1, None, True)], "doc_id string, category string, area_m2 double, depth_mm int, mesh string, steel_wastage double, manholes int, assumed boolean")
    rows = quotation.lines(z)
    total = quotation.totals(rows).first()
    assert float(total.subtotal) == pytest.approx(930 * (56.33 + 1.40 + 4.85)) and total.assumed and total.unpriced == 0
    assert len(json.loads(quotation.json_documents(rows).first().value)["lines"]) == 3
    assert all("Dock" in r.value for r in quotation.text_lines(rows).collect())


def test_spec_defaults_and_merge(spark):
    s = spark.createDataFrame([(1, None, "A193"), (2, 200, None)], "id int, depth_mm int, mesh string")
    got = {r.id: (r.depth_mm, r.mesh, r.assumed_fields) for r in specs.with_defaults(s, dims.DEFAULT_SPEC, ["depth_mm", "mesh"]).collect()}
    assert got == {1: (190, "A193", ["depth_mm"]), 2: (200, "A252", ["mesh"])}
    c = spark.createDataFrame([("p", "mesh", "A193", False), ("p", "mesh", "A252", False), ("p", "depth_mm", "190", False)], "project string, field string, value string, conflict boolean")
    assert {r.field: (r.value, r.conflict) for r in specs.merged(c, "project").collect()} == {"mesh": (None, True), "depth_mm": ("190", False)}


def test_deadline_stream_lets_late_success_win(spark, tmp_path):
    folder = tmp_path / "in"
    schema = "job_id string, event string, area_m2 double"
    spark.createDataFrame([("a", "start", None), ("b", "start", None), ("b", "done", 5.0)], schema).coalesce(1).write.parquet(str(folder))
    stream = spark.readStream.schema(schema).parquet(str(folder))
    q = events.with_deadline(stream, 1).writeStream.format("memory").queryName("late").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="300 milliseconds").start()
    seen = lambda: {(r.job_id, r.status, r.area_m2) for r in spark.table("late").collect()}
    try:
        wait(lambda: seen() == {("a", "UNMEASURED", None), ("b", "MEASURED", 5.0)})
        spark.createDataFrame([("a", "done", 7.0)], schema).coalesce(1).write.mode("append").parquet(str(folder))
        wait(lambda: ("a", "MEASURED", 7.0) in seen())
    finally:
        q.stop()


def test_forms_of_subjects(spark):
    rows = [
        ("unit 1 channel", "channel", "unit 1", False, False), ("units 4a & 4b transitions", "transition", "units 4a & 4b", False, False), ("unit-4 - channels", "channel", "unit-4", False, True),
        ("channels", None, None, False, False), ("3rd floor slab", None, None, True, False), ("second floors", None, None, True, False), ("3rd floor slab x", None, None, False, False),
        ("unit 1 2 channel", None, None, False, False), ("units 1 and 2", None, None, False, True), ("unit", None, None, False, False), ("unit4", None, None, False, True), ("band 2", None, None, False, False),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, k string")
    k = F.col("k")
    got = df.select("i", rules.linear_kind(k), rules.linear_unit(k), rules.is_upper_floor(k), rules.names_units(k)).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [r[1:] for r in rows]


def test_archive_members_are_never_dropped():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for i in range(intake.MOST_MEMBERS + 3):
            z.writestr(f"{i}.pdf", b"%PDF-")
    got = intake.open_archive(buffer.getvalue())
    assert len(got) == intake.MOST_MEMBERS + 3 and [r for _, _, r in got[-3:]] == ["too many members"] * 3


def test_pair_score_reads_the_raw_folder_itself():
    assert matching.pair_score("/drawings/a.pdf", "/drawings/a.pdf") == 110
    assert matching.pair_score("/in/A.pdf", "/in/Stripped/a.PDF") == 140
    assert matching.pair_score("/in/abc.pdf", "/in/a.jpeg") == 8


def test_prior_of_repeated_rows(spark):
    rows = spark.createDataFrame([("k", 1, 5), ("k", 1, 6), ("k", 2, 3)], "k string, id int, at int")
    assert {(r.id, r.prior_id) for r in relational.prior_of(rows, "k", "id", "at").collect()} == {(1, 2), (2, 1)}


def test_merged_runs_with_null_ends_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    from mensura.plans import registry

    rows = [(1, 2, 5.0), (1, 2, None), (1, 4, None), (1, 6, 3.0), (1, 6, 3.0), (1, None, 2.0), (1, 400, None), (2, 8, None)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [tuple(r) for r in registry.QUERIES["merged_runs"](spark, str(tmp_path)).select("page", "axis", "low", "high", "n").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(f"SELECT page, axis, low, high, n FROM ({registry.ORACLE_SQL['merged_runs']})").fetchall()
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_a_bucket_of_a_range_join_is_dealt_to_several_tasks(spark):
    """Pairs whose ends all lie in one bucket aren't the work of one task; null columns of either side stay."""
    right = [(i if i % 50 else None, 900.0 + i % 3, 902.0 + i % 3) for i in range(12 * relational.BLOCK)] + [(-1, 9.0, 8.0), (-2, 10.0, 20.0)]
    left = [(i, 900.0 + i) for i in range(4)] + [(9, 5000.0), (10, None)]
    r = spark.createDataFrame(right, "part int, lo double, hi double")
    met = relational.range_join(spark.createDataFrame(left, "id int, at double"), r, "at", "lo", "hi", 100.0).withColumn("task", F.spark_partition_id())
    rows = met.collect()
    want = sorted(((i, p) for i, a in left for p, lo, hi in right if a is not None and lo <= a <= hi), key=repr)
    assert sorted(((x["id"], x["part"]) for x in rows), key=repr) == want
    assert len({x["task"] for x in rows}) > 1
