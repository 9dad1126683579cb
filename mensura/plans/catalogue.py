"""Queries over the driver tables: each domain operator in the relational shape of these tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mensura.functions import geometry, pricing, rules
from mensura.operators import matching, relational

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cents(c: str):
    return F.col(c).cast("decimal(18,2)")


TYPES = "VALUES ('ECONOMY', 2.22), ('STANDARD', 3.02), ('PROMO', 3.95), ('MEDIUM', 6.16)"


def _type_dim(spark):
    return spark.createDataFrame([("ECONOMY", 2.22), ("STANDARD", 3.02), ("PROMO", 3.95), ("MEDIUM", 6.16)], "kind string, kg double")


@query("""
SELECT l_returnflag, l_linestatus, CAST(sum(v) AS DOUBLE) AS amount, count(*) AS n_lines
FROM (SELECT l_returnflag, l_linestatus,
        CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(5,2)) AS v FROM lineitem)
GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def boq_rollup(spark, d):
    """Priced lines with section subtotals and a total."""
    value = cents("l_extendedprice") * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)")).cast("decimal(5,2)")
    return t(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum(value).cast("double").alias("amount"), F.count("*").alias("n_lines"))


@query(f"""
WITH dim(kind, kg) AS ({TYPES})
SELECT p_partkey, CAST(p_size * CAST(0.128 AS DECIMAL(10,3)) + coalesce(CAST(kg AS DECIMAL(10,2)), 0) * CAST(0.85 AS DECIMAL(10,2)) AS DOUBLE) AS rate, kg IS NULL AS missing
FROM part LEFT JOIN dim ON kind = split_part(p_type, ' ', 1)""")
def rate_lookup(spark, d):
    """A rate from a broadcast lookup; unknown keys are flagged, not dropped."""
    p = t(spark, d, "part").withColumn("kind", F.split_part("p_type", F.lit(" "), F.lit(1)))
    kg = F.coalesce(F.col("kg").cast("decimal(10,2)"), F.lit(0).cast("decimal(10,2)"))
    rate = F.col("p_size").cast("decimal(10,0)") * F.lit("0.128").cast("decimal(10,3)") + kg * F.lit("0.85").cast("decimal(10,2)")
    return p.join(F.broadcast(_type_dim(spark)), "kind", "left").select("p_partkey", rate.cast("double").alias("rate"), F.col("kg").isNull().alias("missing"))


@query(f"""
WITH dim(kind, kg) AS ({TYPES})
SELECT split_part(p_type, ' ', 1) AS kind, count(*) AS n FROM part WHERE split_part(p_type, ' ', 1) NOT IN (SELECT kind FROM dim) GROUP BY 1""")
def lookup_miss(spark, d):
    p = t(spark, d, "part").select(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("kind"))
    return p.join(F.broadcast(_type_dim(spark)), "kind", "left_anti").groupBy("kind").agg(F.count("*").alias("n"))


@query("""
SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS done, count(*) AS n FROM orders GROUP BY o_custkey""")
def null_preserving_sum(spark, d):
    """A sum that is null, not zero, where nothing contributed."""
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.sum(F.when(F.col("o_orderstatus") == "F", cents("o_totalprice"))).cast("double").alias("done"), F.count("*").alias("n"))


@query("""
SELECT state, count(*) AS n FROM (
  SELECT CASE WHEN l_returnflag = 'R' AND l_quantity < 5 THEN 'REJECTED' WHEN l_quantity > 48 THEN 'UNMEASURED'
    WHEN l_extendedprice > 60000 OR l_extendedprice <= 0 THEN 'MEASURED_UNVERIFIED'
    WHEN CASE l_linestatus WHEN 'O' THEN NULL ELSE l_discount < 0.08 END IS NOT DISTINCT FROM false THEN 'MEASURED_UNVERIFIED'
    WHEN l_tax >= 0.08 THEN 'MEASURED_UNVERIFIED' ELSE 'MEASURED_VERIFIED' END AS state FROM lineitem) GROUP BY state""")
def four_states(spark, d):
    li = t(spark, d, "lineitem")
    state = rules.measurement_state(
        F.when(F.col("l_quantity") <= 48, F.col("l_extendedprice")), F.when(F.col("l_linestatus") != "O", F.col("l_discount") < 0.08),
        F.when(F.col("l_tax") >= 0.08, "low"), F.lit(None).cast("double"), F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") < 5), "bad"),
    )
    return li.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey, coalesce(CASE WHEN c_acctbal < 0 THEN 'negative balance' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END,
  CASE WHEN o_totalprice > 200000 THEN 'large' END) AS reason FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def first_block_reason(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_acctbal")
    reason = rules.first_reason((F.col("c_acctbal") < 0, "negative balance"), (F.col("o_orderpriority") == "1-URGENT", "urgent"), (F.col("o_totalprice") > 200000, "large"))
    return t(spark, d, "orders").join(c, F.col("c_custkey") == F.col("o_custkey"), "left").select("o_orderkey", reason.alias("reason"))


@query("""
WITH f AS (SELECT doc_id, list_filter([CASE WHEN n_chars < 200 THEN 'SHORT' END, CASE WHEN lang <> 'en' THEN 'UNVERIFIED LANGUAGE' END,
  CASE WHEN text LIKE '%|%' THEN 'MENU' END], lambda x: x IS NOT NULL) AS flags FROM documents)
SELECT doc_id, len(flags) AS n_flags, array_to_string(flags, ';') AS flags,
  len(list_filter(flags, lambda x: x LIKE '%UNVERIFIED%' OR x LIKE '%REFUSED%')) > 0 AS needs_approval FROM f""")
def flag_triggers(spark, d):
    flags = F.array_compact(F.array(F.when(F.col("n_chars") < 200, "SHORT"), F.when(F.col("lang") != "en", "UNVERIFIED LANGUAGE"), F.when(F.col("text").contains("|"), "MENU")))
    f = t(spark, d, "documents").select("doc_id", flags.alias("flags"))
    needs = rules.needs_approval(F.col("flags"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return f.select("doc_id", F.size("flags").cast("long").alias("n_flags"), F.array_join("flags", ";").alias("flags"), needs.alias("needs_approval"))


SCORE = "(CASE WHEN contains(lower(text), 'the') THEN 2 ELSE 0 END + CASE WHEN contains(lower(text), 'license') THEN 3 ELSE 0 END + CASE WHEN contains(lower(text), '!!') THEN -2 ELSE 0 END)"


def _score():
    return rules.keyword_score(F.col("text"), {"the": 2, "license": 3, "!!": -2})


@query(f"SELECT doc_id, CAST({SCORE} AS INTEGER) AS score FROM documents")
def keyword_score(spark, d):
    return t(spark, d, "documents").select("doc_id", _score().cast("int").alias("score"))


@query(f"""
SELECT source, doc_id, CAST(score AS INTEGER) AS score, CAST(place AS INTEGER) AS place FROM (SELECT source, doc_id, {SCORE} AS score,
  row_number() OVER (PARTITION BY source ORDER BY {SCORE} DESC, doc_id) AS place FROM documents) WHERE place <= 3""")
def stable_top_k(spark, d):
    rows = t(spark, d, "documents").select("source", "doc_id", _score().cast("int").alias("score"))
    return relational.top_per_key(rows, ["source"], [F.desc("score"), F.asc("doc_id")], 3)


@query("""
SELECT page_id, CAST(nullif(regexp_extract(html, '([0-9]+)\\s*(px|em|%)', 1), '') AS BIGINT) AS n, nullif(regexp_extract(html, '([0-9]+)\\s*(px|em|%)', 2), '') AS unit FROM pages""")
def number_with_unit(spark, d):
    p = r"([0-9]+)\s*(px|em|%)"
    get = lambda g: F.nullif(F.regexp_extract("html", p, g), F.lit(""))
    return t(spark, d, "pages").select("page_id", get(1).cast("long").alias("n"), get(2).alias("unit"))


@query("""
SELECT source, lang, n, first_at FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, first_at) AS place FROM (
  SELECT source, lang, count(*) AS n, min(doc_id) AS first_at FROM documents GROUP BY ALL)) WHERE place = 1""")
def mode_first_seen(spark, d):
    return relational.mode_first_seen(t(spark, d, "documents"), ["source"], "lang", "doc_id")


@query("""
SELECT l_partkey, low, high, n, CASE WHEN high / low - 1 <= 0.05 THEN mean END AS agreed FROM (
  SELECT l_partkey, min(v) AS low, max(v) AS high, avg(v) AS mean, count(v) AS n FROM (
    SELECT l_partkey, CASE WHEN l_quantity > 0 THEN l_quantity END AS v FROM lineitem) GROUP BY l_partkey)""")
def consensus_or_null(spark, d):
    return relational.consensus(t(spark, d, "lineitem"), ["l_partkey"], "l_quantity", 0.05)


@query("""
WITH s AS (SELECT user_id, event_type, max(floor(value / 10)) + least(2, count(*) - 1) AS support FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS place, lead(support) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY user_id ORDER BY support DESC, event_type))
SELECT user_id, CASE WHEN nxt IS NULL OR nxt < support - 1 THEN event_type END AS value, CAST(support AS DOUBLE) AS support, NOT (nxt IS NULL OR nxt < support - 1) AS conflict
FROM r WHERE place = 1""")
def near_tie_refusal(spark, d):
    e = t(spark, d, "events").select("user_id", "event_type", F.floor(F.col("value") / 10).cast("double").alias("points"))
    return relational.best_or_refuse(e, ["user_id"], "event_type", "points").withColumn("support", F.col("support").cast("double"))


@query("""
SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_values, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS value,
  count(DISTINCT o_orderstatus) > 1 AS conflict FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY o_custkey""")
def distinct_consensus(spark, d):
    return relational.distinct_consensus(t(spark, d, "orders"), ["o_custkey"], "o_orderstatus")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE lower(trim(o_orderstatus)) = 'f' OR lower(trim(o_orderpriority)) = '1-urgent'")
def approved_filter(spark, d):
    o = t(spark, d, "orders")
    return o.where((F.lower(F.trim("o_orderstatus")) == "f") | (F.lower(F.trim("o_orderpriority")) == "1-urgent")).select("o_orderkey", "o_custkey")


@query("""
SELECT o_custkey, o_orderkey AS latest_key, o_orderstatus AS latest_status, n AS n_history FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders) WHERE place = 1""")
def latest_with_history(spark, d):
    got = relational.latest_with_history(t(spark, d, "orders"), ["o_custkey"], ["o_orderkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"])
    return got.select("o_custkey", F.col("latest.o_orderkey").alias("latest_key"), F.col("latest.o_orderstatus").alias("latest_status"), "n_history")


@query("""
SELECT coalesce(CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END, '__none__') AS ref, count(*) AS n,
  count(CASE WHEN c_acctbal > 0 THEN 1 END) AS n_delta, CAST(sum(CASE WHEN c_acctbal > 0 THEN CAST(c_acctbal AS DECIMAL(18,2)) END) AS DOUBLE) AS total FROM customer GROUP BY 1""")
def delta_report(spark, d):
    ref = F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("__none__"))
    delta = F.when(F.col("c_acctbal") > 0, cents("c_acctbal"))
    return t(spark, d, "customer").groupBy(ref.alias("ref")).agg(F.count("*").alias("n"), F.count(delta).alias("n_delta"), F.sum(delta).cast("double").alias("total"))


@query("""
SELECT o.o_orderkey, p.o_orderkey AS prior_id, p.o_orderdate AS prior_at FROM orders o LEFT JOIN LATERAL (
  SELECT o_orderkey, o_orderdate FROM orders q WHERE q.o_custkey = o.o_custkey AND q.o_orderkey <> o.o_orderkey
  ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) p ON true""")
def prior_approval(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return relational.prior_of(o, "o_custkey", "o_orderkey", "o_orderdate").select("o_orderkey", "prior_id", "prior_at")


@query("""
WITH truth AS (SELECT n_nationkey AS k, n_regionkey * 10.0 AS truth FROM nation), m AS (SELECT c_nationkey AS k, count(*) / 1.0 AS measured FROM customer GROUP BY 1)
SELECT truth.k, CAST(truth AS DOUBLE) AS truth, CAST(measured AS DOUBLE) AS measured,
  CASE WHEN measured IS NULL THEN 'MISSING' WHEN truth = 0 THEN CASE WHEN measured = 0 THEN 'PASS' ELSE 'FAIL' END
    WHEN abs((measured - truth) / abs(truth) * 100) <= 60 THEN 'PASS' ELSE 'FAIL' END AS status FROM truth LEFT JOIN m USING (k)""")
def tolerance_score(spark, d):
    truth = t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_regionkey") * 10.0).alias("truth"))
    m = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").cast("double").alias("measured"))
    ok = rules.within_tolerance(F.col("measured"), F.col("truth"), F.lit(60.0))
    return truth.join(m, "k", "left").select("k", "truth", "measured", F.when(F.col("measured").isNull(), "MISSING").when(ok, "PASS").otherwise("FAIL").alias("status"))


@query("""
SELECT l_returnflag, count(*) AS n, count(*) FILTER (v = 'PASS') AS n_pass, count(*) FILTER (v = 'FAIL') AS n_fail, count(*) FILTER (v = 'UNMEASURED') AS n_unmeasured,
  CAST(count(*) FILTER (v = 'PASS') * 100 AS DOUBLE) / count(*) AS pass_pct
FROM (SELECT l_returnflag, CASE WHEN l_discount > 0.09 THEN 'UNMEASURED' WHEN l_quantity > 25 THEN 'FAIL' ELSE 'PASS' END AS v FROM lineitem) GROUP BY l_returnflag""")
def scorecard(spark, d):
    v = F.when(F.col("l_discount") > 0.09, "UNMEASURED").when(F.col("l_quantity") > 25, "FAIL").otherwise("PASS")
    return relational.scorecard(t(spark, d, "lineitem").withColumn("verdict", v), ["l_returnflag"])


@query("""
SELECT p_partkey, coalesce(o.p_retailprice * 2, p.p_retailprice) AS p_retailprice, CASE WHEN o.k IS NULL THEN 'default' ELSE 'override' END AS source
FROM part p LEFT JOIN (SELECT p_partkey AS k, p_retailprice FROM part WHERE p_size > 40) o ON o.k = p_partkey""")
def overlay_defaults(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_retailprice", "p_size")
    over = p.where("p_size > 40").select("p_partkey", (F.col("p_retailprice") * 2).alias("p_retailprice"))
    return relational.overlay(p.drop("p_size"), over, "p_partkey", "p_retailprice")


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p FROM events) WHERE p = 1""")
def latest_audit_per_key(spark, d):
    return relational.latest_row(t(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("""
WITH b AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS v FROM customer WHERE c_custkey % 5 <> 0),
a AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 4 <> 0)
SELECT coalesce(b.c_custkey, a.c_custkey) AS c_custkey, b.v AS before, a.v AS after FROM b FULL JOIN a ON a.c_custkey = b.c_custkey WHERE b.v IS DISTINCT FROM a.v""")
def row_diff(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    k = F.col("c_custkey")
    b = c.where(k % 5 != 0).select("c_custkey", F.when(k % 7 != 0, F.col("c_mktsegment")).alias("v"))
    a = c.where(k % 4 != 0).select("c_custkey", F.when(k % 3 == 0, "CHANGED").otherwise(F.col("c_mktsegment")).alias("v"))
    return relational.row_diff(b, a, "c_custkey", "v")


@query("""
SELECT o_orderkey, 'hot' AS store FROM orders WHERE o_orderstatus = 'O' UNION ALL
SELECT o_orderkey, 'archive' FROM orders WHERE o_totalprice > 50000 AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')""")
def hot_over_archive(spark, d):
    o = t(spark, d, "orders")
    hot = o.where("o_orderstatus = 'O'").select("o_orderkey", F.lit("hot").alias("store"))
    return relational.hot_over_archive(hot, o.where("o_totalprice > 50000").select("o_orderkey", F.lit("archive").alias("store")), "o_orderkey")


@query("""
SELECT a.o_custkey, a.o_orderkey AS anchor, count(s.o_orderkey) FILTER (s.o_orderstatus = 'F') AS contributing, count(s.o_orderkey) FILTER (s.o_orderstatus <> 'F') AS unmeasured,
  arg_max(s.o_orderkey, struct_pack(x := s.o_orderdate, y := s.o_orderkey)) AS revision, count(*) FILTER (s.o_orderstatus <> 'F') = 0 AS firm
FROM (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) a JOIN orders s ON s.o_custkey = a.o_custkey GROUP BY ALL""")
def project_siblings(spark, d):
    """An anchor's siblings of one project: what contributes, what is missing, and the latest revision."""
    o = t(spark, d, "orders")
    return o.groupBy("o_custkey").agg(
        F.min("o_orderkey").alias("anchor"), F.count_if(F.col("o_orderstatus") == "F").alias("contributing"), F.count_if(F.col("o_orderstatus") != "F").alias("unmeasured"),
        F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("revision"), (F.count_if(F.col("o_orderstatus") != "F") == 0).alias("firm"),
    )


@query("""
WITH g AS (SELECT o_orderpriority, o_orderstatus, o_totalprice > 100000 AS provisional, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount, count(DISTINCT o_custkey) AS n_customers, min(o_orderkey) AS seq
  FROM orders GROUP BY ALL)
SELECT *, CAST(row_number() OVER (ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 9 END, provisional, seq) AS INTEGER) AS line FROM g""")
def grouped_lines_in_order(spark, d):
    """Lines grouped by several keys and numbered by section rank; the window holds groups, not rows."""
    keys = ["o_orderpriority", "o_orderstatus", "provisional"]
    g = t(spark, d, "orders").withColumn("provisional", F.col("o_totalprice") > 100000).groupBy(*keys).agg(
        F.sum(cents("o_totalprice")).cast("double").alias("amount"), F.count_distinct("o_custkey").alias("n_customers"), F.min("o_orderkey").alias("seq")
    )
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(9)
    return g.withColumn("line", F.row_number().over(Window.orderBy(rank, "provisional", "seq")))


@query("""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS zone_index, CAST(length(split(text, chr(10))[i]) AS INTEGER) AS size, CASE WHEN i = 1 THEN n_chars END AS n_chars
FROM (SELECT *, unnest(range(1, len(split(text, chr(10))) + 1)) AS i FROM documents)""")
def exploded_zones(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "n_chars", F.split("text", "\n").alias("zones"))
    return relational.explode_zones(docs, "zones", ["n_chars"]).select("doc_id", "zone_index", F.length("zone").alias("size"), "n_chars")


@query("""
WITH r AS (SELECT user_id, epoch(ts) AS lo, epoch(ts) + value * 60 AS hi FROM events),
m AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT *, sum(CASE WHEN lo <= reach + 600 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, min(lo) AS low, max(hi) AS high, count(*) AS n FROM i GROUP BY user_id, island""")
def merged_intervals(spark, d):
    e = t(spark, d, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return relational.merge_intervals(e.select("user_id", at.alias("lo"), (at + F.col("value") * 60).alias("hi")), ["user_id"], "lo", "hi", 600.0)


@query("""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS at FROM events WHERE event_type <> 'purchase'), r AS (SELECT user_id, epoch_us(ts) AS at, min(event_id) AS id FROM events WHERE event_type = 'purchase' GROUP BY ALL),
m AS (SELECT e.event_id, r.id, abs(e.at - r.at) AS d, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(e.at - r.at), r.id) AS p FROM e LEFT JOIN r USING (user_id))
SELECT event_id, id AS nearest, d AS distance FROM m WHERE p = 1""")
def nearest_match(spark, d):
    e = t(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).select("event_id", "user_id", "at", "event_type")
    left, right = e.where("event_type <> 'purchase'").drop("event_type"), e.where("event_type = 'purchase'").drop("event_type")
    return relational.nearest(left, right, ["user_id"], "at", "at", "event_id").select("event_id", "nearest", "distance")


@query("""
WITH p AS (SELECT p_partkey, p_retailprice - 2 AS lo, p_retailprice + 2 AS hi FROM part)
SELECT o_orderkey, p_partkey FROM orders JOIN p ON o_totalprice / 100 BETWEEN lo AND hi""")
def range_join_whole(spark, d):
    """Orders whose price lies within the range of a part, for all parts."""
    p = t(spark, d, "part").select("p_partkey", (F.col("p_retailprice") - 2).alias("lo"), (F.col("p_retailprice") + 2).alias("hi"))
    o = t(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 100).alias("at"))
    return relational.range_join(o, p, "at", "lo", "hi", 4.0).select("o_orderkey", "p_partkey")


RULES = [(1, "license", "licen[sc]e"), (2, "rights", "all rights reserved"), (3, "shout", "!!"), (4, "menu", "[|]")]


def _rules(spark):
    return spark.createDataFrame(RULES, "rule_order int, exclusion_id string, pattern string")


RULES_SQL = "VALUES (1, 'license', 'licen[sc]e'), (2, 'rights', 'all rights reserved'), (3, 'shout', '!!'), (4, 'menu', '[|]')"


@query(f"""
WITH r(rule_order, exclusion_id, pattern) AS ({RULES_SQL})
SELECT doc_id, arg_min(exclusion_id, rule_order) AS exclusion_id, min(rule_order) AS rule_order FROM documents, r WHERE regexp_matches(text, '(?i)' || pattern) GROUP BY doc_id""")
def first_rule_wins(spark, d):
    return relational.first_rule(t(spark, d, "documents"), _rules(spark), "text", ["doc_id"])


@query(f"""
WITH r(rule_order, exclusion_id, pattern) AS ({RULES_SQL})
SELECT source, exclusion_id, count(doc_id) AS n_hits, CASE WHEN count(doc_id) > 0 THEN 'outline_unresolved' ELSE 'confirm_none' END AS status
FROM (SELECT DISTINCT source FROM documents) s CROSS JOIN r LEFT JOIN documents x ON x.source = s.source AND regexp_matches(x.text, '(?i)' || pattern) GROUP BY ALL""".replace("SELECT source,", "SELECT s.source AS source,"))
def exclusion_prompts(spark, d):
    """Every rule for every group, with or without evidence."""
    docs, r = t(spark, d, "documents").select("source", "doc_id", "text"), F.broadcast(_rules(spark))
    hits = docs.join(r, F.expr("text RLIKE concat('(?i)', pattern)")).groupBy("source", "exclusion_id").agg(F.count("*").alias("n_hits"))
    ids = F.explode(F.array(*[F.lit(x[1]) for x in RULES])).alias("exclusion_id")
    asked = docs.select("source").distinct().select("source", ids).join(hits, ["source", "exclusion_id"], "left")
    n = F.coalesce("n_hits", F.lit(0))
    return asked.select("source", "exclusion_id", n.alias("n_hits"), F.when(n > 0, "outline_unresolved").otherwise("confirm_none").alias("status"))


def _points():
    """The 64 components of a vector as 32 vertices."""
    x = lambda i: F.get("embedding", i).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(x(i * 2).alias("x"), x(i * 2 + 1).alias("y")))


PTS = "(SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings)"


@query(f"""
SELECT vec_id, floor(abs(list_sum([e[2*i+1] * e[((2*i+3) % 64) + 1] - e[((2*i+2) % 64) + 1] * e[2*i+2] FOR i IN range(32)])) / 2 * 1000000) AS area FROM {PTS}""")
def polygon_area(spark, d):
    return t(spark, d, "embeddings").select("vec_id", _points().alias("p")).select("vec_id", F.floor(geometry.shoelace(F.col("p")) * 1000000).cast("double").alias("area"))


@query(f"""
SELECT vec_id, floor(list_sum([sqrt(pow(e[2*i+3] - e[2*i+1], 2) + pow(e[2*i+4] - e[2*i+2], 2)) FOR i IN range(31)]) * 1000000) AS length FROM {PTS}""")
def polyline_length(spark, d):
    return t(spark, d, "embeddings").select("vec_id", _points().alias("p")).select("vec_id", F.floor(geometry.polyline(F.col("p")) * 1000000).cast("double").alias("length"))


@query(f"""
WITH b AS (SELECT vec_id, list_min(e[1:63:2]) AS x0, list_min(e[2:64:2]) AS y0, list_max(e[1:63:2]) AS x1, list_max(e[2:64:2]) AS y1 FROM {PTS}),
p AS (SELECT a.vec_id AS a, c.vec_id AS b, greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) AS i,
  (a.x1 - a.x0) * (a.y1 - a.y0) + (c.x1 - c.x0) * (c.y1 - c.y0) AS s FROM b a JOIN b c ON c.vec_id = a.vec_id + 1)
SELECT a, b, floor(i / (s - i) * 1000000) AS iou FROM p""")
def box_overlaps(spark, d):
    b = t(spark, d, "embeddings").select("vec_id", geometry.box(_points()).alias("r"))
    a = b.select((F.col("vec_id") + 1).alias("vec_id"), F.col("vec_id").alias("a"), F.col("r").alias("s"))
    return a.join(b, "vec_id").select("a", F.col("vec_id").alias("b"), F.floor(geometry.box_overlap(F.col("s"), F.col("r")) * 1000000).cast("double").alias("iou"))


_TEXT_KEY = r"sha256(trim(regexp_replace(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' '))"


@query(f"""
WITH m AS (SELECT {_TEXT_KEY} AS k, '/marked/' || coalesce(CAST(doc_id AS VARCHAR), '') || '/' || {_TEXT_KEY} AS path FROM documents),
r AS (SELECT {_TEXT_KEY} AS k, '/raw/' || coalesce(CAST(item_id AS VARCHAR), '') || '/' || {_TEXT_KEY} AS path FROM benchmark),
a AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY path) AS n FROM m), b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY path) AS n FROM r)
SELECT coalesce(a.k, b.k) AS k, a.path AS marked, b.path AS raw FROM a FULL JOIN b ON a.k = b.k AND a.n = b.n""")
def greedy_pairing(spark, d):
    """Documents and benchmark items paired one to one by their whole texts, case and space aside."""
    text = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[ \t\n\x0B\f\r]+", " "))
    name = F.sha2(text.cast("binary"), 256)
    path = lambda k, id_: F.concat(F.lit(f"/{k}/"), F.coalesce(F.col(id_).cast("string"), F.lit("")), F.lit("/"), name)
    m = t(spark, d, "documents").select(name.alias("name"), path("marked", "doc_id").alias("path"))
    r = t(spark, d, "benchmark").select(name.alias("name"), path("raw", "item_id").alias("path"))
    return matching.pair_names(m, r, "name")


_MILLI = "CAST(floor(1000 * CAST({} AS DOUBLE)) AS BIGINT)"


@query(f"""
WITH p AS (SELECT label, [{_MILLI.format("x")} FOR x IN embedding] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 3),
b AS (SELECT DISTINCT label, least(e[1], e[3]) AS x0, least(e[2], e[4]) AS y0, greatest(e[1], e[3]) AS x1, greatest(e[2], e[4]) AS y1 FROM p),
x AS (SELECT label, x AS l, lead(x) OVER (PARTITION BY label ORDER BY x) AS r FROM (SELECT label, x0 AS x FROM b UNION SELECT label, x1 FROM b)),
s AS (SELECT x.label, l, r, y0, y1, max(y1) OVER (PARTITION BY x.label, l ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
      FROM x JOIN b ON b.label = x.label AND x0 <= l AND x1 >= r WHERE r IS NOT NULL),
a AS (SELECT label, CAST(sum((r - l) * greatest(0, y1 - greatest(y0, coalesce(reach, y0)))) AS BIGINT) AS area FROM s GROUP BY label),
t AS (SELECT label, CAST(sum((greatest(e[1], e[3]) - least(e[1], e[3])) * (greatest(e[2], e[4]) - least(e[2], e[4]))) AS BIGINT) AS total FROM p GROUP BY label)
SELECT label AS key, coalesce(area, 0) AS area, total, coalesce(area, 0) < 0.999 * total AS overlaps FROM t LEFT JOIN a USING (label)""")
def union_of_rectangles(spark, d):
    """What the rectangles of each label cover together, in thousandths."""
    e = t(spark, d, "embeddings").where("label IS NOT NULL AND size(embedding) > 3")
    at = [F.floor(F.col("embedding")[i].cast("double") * 1000) for i in range(4)]
    b = e.select("label", F.least(at[0], at[2]).alias("x0"), F.least(at[1], at[3]).alias("y0"), F.greatest(at[0], at[2]).alias("x1"), F.greatest(at[1], at[3]).alias("y1"))
    return matching.union_area(b, "label").select("key", *(F.col(c).cast("long").alias(c) for c in ("area", "total")), "overlaps")


@query("""
SELECT event_type, count(*) AS n, count(*) FILTER (fixture) AS n_fixture FROM (SELECT event_type, coalesce(try_cast(regexp_extract(props, '"k":\\s*([0-9]+)', 1) AS BIGINT) < 10, false) AS fixture FROM events)
GROUP BY event_type""")
def fixture_filter(spark, d):
    """Rows of tests are told apart; rows whose JSON can't be read are kept."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.coalesce(k < 10, F.lit(False))).alias("n_fixture"))


@query("SELECT event_id, try_cast(regexp_extract(props, '\"k\":\\s*([0-9]+)', 1) AS BIGINT) AS k FROM events")
def json_field(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS p FROM orders) WHERE p <= 14")
def keep_newest(spark, d):
    return relational.top_per_key(t(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 14).select("o_custkey", "o_orderkey")


@query("""
SELECT l_suppkey, CAST(p AS INTEGER) AS place, reason FROM (SELECT l_suppkey, reason, row_number() OVER (PARTITION BY l_suppkey ORDER BY rank, first_at, reason) AS p FROM (
  SELECT l_suppkey, l_returnflag || l_linestatus || CAST(l_linenumber AS VARCHAR) AS reason, min(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) AS rank, min(l_orderkey) AS first_at FROM lineitem GROUP BY 1, 2)) WHERE p <= 4""")
def top_reasons(spark, d):
    reason = F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))
    g = t(spark, d, "lineitem").groupBy("l_suppkey", reason.alias("reason")).agg(F.min(F.when(F.col("l_returnflag") == "R", 0).otherwise(1)).alias("rank"), F.min("l_orderkey").alias("first_at"))
    return relational.top_per_key(g, ["l_suppkey"], [F.asc("rank"), F.asc("first_at"), F.asc("reason")], 4).select("l_suppkey", "place", "reason")


@query("""
SELECT event_type, floor(quantile_cont(value, 0.5) * 1000000) AS median, floor(quantile_cont(value, 0.9) * 1000000) AS p90, count(*) AS n FROM events GROUP BY event_type""")
def quantiles(spark, d):
    q = lambda p: F.floor(F.percentile("value", F.lit(p)) * 1000000).cast("double")
    return t(spark, d, "events").groupBy("event_type").agg(q(0.5).alias("median"), q(0.9).alias("p90"), F.count("*").alias("n"))


@query("SELECT DISTINCT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def raw_without_used(spark, d):
    return t(spark, d, "customer").select("c_nationkey").distinct().exceptAll(t(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("c_nationkey")).distinct())


@query("""
SELECT coalesce(a.k, b.k) AS o_custkey, CASE WHEN a.k IS NULL THEN 'unknown' ELSE 'undecided' END AS problem FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') a
FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def exact_cover(spark, d):
    o = t(spark, d, "orders")
    side = lambda s: o.where(F.col("o_orderstatus") == s).select("o_custkey").distinct()
    return relational.exact_cover(side("F"), side("O"), "o_custkey")


@query("""
SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS DECIMAL(18,3)) * CAST(l_tax AS DECIMAL(6,2)) * 75) AS DOUBLE) AS amount, bool_or(l_discount > 0.05) AS provisional
FROM lineitem GROUP BY l_orderkey, l_linenumber""")
def extra_over_lines(spark, d):
    """Extra-over lines grouped by drawing and description; one provisional part makes the line provisional."""
    v = F.col("l_quantity").cast("decimal(18,3)") * F.col("l_tax").cast("decimal(6,2)") * F.lit(75)
    return t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(v).cast("double").alias("amount"), F.bool_or(F.col("l_discount") > 0.05).alias("provisional"))


@query("SELECT p_partkey, greatest(1, CAST(round_even(p_size * 0.0254 / 72 / (0.0254 / 72), 0) AS INTEGER)) AS ratio, p_size * (0.0254 / 72) AS k FROM part")
def title_scale(spark, d):
    k = pricing.scale_of_title(F.col("p_size"))
    return t(spark, d, "part").select("p_partkey", pricing.ratio_of_scale(k).alias("ratio"), k.alias("k"))
