"""Queries that must run over whole tables and texts."""

from mensura.plans import registry

SF = "/root/testdata/sf0.001"


def test_range_join_of_all_parts(spark):
    sizes = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_size")
    whole = registry.QUERIES["range_join_whole"](spark, SF)
    assert whole.join(sizes, "p_partkey").select("p_size").distinct().count() > 10


def test_pairing_uses_whole_texts(spark, tmp_path):
    docs = [(1, "The quick brown fox  jumps\n"), (2, "The quick brown cat"), (3, "the QUICK brown fox jumps"), (4, "them"), (5, None), (None, "one more")]
    items = [(7, "the quick brown cat"), (8, "The quick brown fox jumps"), (9, "The quick brown dog"), (10, "One more")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = registry.QUERIES["greedy_pairing"](spark, str(tmp_path)).collect()
    of = lambda p: p and p.split("/")[2]
    got = sorted((of(r["marked"]), of(r["raw"])) for r in rows if r["marked"] and r["raw"])
    assert got == [("", "10"), ("1", "8"), ("2", "7")]
    assert sorted(of(r["marked"]) for r in rows if r["raw"] is None) == ["3", "4", "5"]
    assert [of(r["raw"]) for r in rows if r["marked"] is None] == ["9"]
