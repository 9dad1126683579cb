import pytest
from pyspark.sql import types as T

WORDS = "the quick brown fox of and to in river stone path light wind a house that is on for with".split()


def sentence(n, seed=0):
    return " ".join(WORDS[(i * 7 + seed * 5 + i * i * (seed + 1)) % len(WORDS)] + (str(seed) if i % 9 == 4 else "") for i in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, very long and repeated texts, ties, and rows that share an id."""
    long = "\n".join(sentence(40, k) + "." for k in range(400))
    rows = [
        (0, sentence(60, 1), "en", "b", 1), (1, sentence(60, 1), "en", "b", 1), (2, sentence(60, 1) + " more", "en", "a", 1),
        (3, None, "en", "a", None), (4, "", "en", None, 0), (5, "   \n\t ", None, "c", 6), (6, "one", "en", "c", 3),
        (7, long, "en", "a", None), (8, long + " end", "en", None, None), (None, sentence(50, 3), "en", "d", 5), (None, sentence(50, 3), "en", "d", 5),
        (9, sentence(70, 4), "en", "d", 5), (9, sentence(70, 4), "en", "d", 5), (9, sentence(80, 5), "en", "e", 5),
        (10, "é" * 150 + " ü" * 120, "fr", "e", 1), (11, "é" * 150, "fr", "e", 1), (12, "x" * 5000, "en", "a", 1), (13, "a\x0bb\x0cc\rd", "en", "é", 7),
        (14, "# * $ % & | < >" * 20, "en", "Z", 1), (15, "ABC def. " * 30, "en", "z", 1),
    ]
    return rows


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
CLASHES = ["doc", "h", "s", "at", "key", "node", "n", "size", "bucket", "score", "rank", "rid", "stats", "label", "y", "spans", "a", "b", "id", "part"]


def write(spark, folder, rows, labels, vectors, extra=True):
    docs = spark.createDataFrame(rows, SCHEMA)
    if extra:
        docs = docs.selectExpr("*", *(f"'{c}' AS {c}" for c in CLASHES))
    docs.coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    turns = [(r[0], k % 3, ("user", "assistant", None)[k % 3], r[1]) for k, r in enumerate(rows)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    items = [(1, "the quick brown fox"), (2, None), (3, ""), (None, "river stone"), (4, "river 3 é stone")] if rows else []
    spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS doc_id", "'y' AS term").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def odd_dir(spark, odd_rows, tmp_path_factory):
    nan, inf = float("nan"), float("inf")
    vectors = [
        (0, [0.5, -0.25], 1), (1, [0.5, -0.25], 1), (1, [0.5, -0.25], 1), (2, None, 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], None),
        (5, [None, 1.0], 1), (6, [0.1], 1), (7, [], 1), (100, [0.5, 0.5, 0.5], 1), (100, [0.5, 0.5, 0.5], 1), (None, [1.0, 1.0], 1), (8, [-0.3, 0.9], 2),
    ]
    labels = [(i, int(i % 3 != 0), int(i % 4 == 1)) for i in range(16)] + [(None, 1, 1), (3, None, None), (5, 1, 0)]
    return write(spark, tmp_path_factory.mktemp("odd"), odd_rows, labels, vectors)


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [], [], [])
