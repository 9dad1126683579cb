"""Quality rules: a threshold table compiled into one Spark projection.

Every statistic is a native expression over the text, so a pass over the corpus
is one scan without shuffle, Python or grouping. Counts that need the words of a
text together (repeated windows) use arrays of one document at a time.

Defined results: a null or empty text has no words and fails the base; texts of
any length are used whole; repeated rows give repeated results; an empty table
gives an empty result; rows without an id, or that share one, are judged like any
other; columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

# Common function words of the languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that it for on was be as with by this are at an from or he she they we you "
    "der die das und ist von zu mit den des im ein eine auf für nicht sie er dem "
    "le la les de et un une des du en que qui est dans pour par sur au il elle "
    "el los las y en un una que por con para del se es su al lo"
).split()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def repeated_window_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more in the same text.

    ``hashes`` holds a 64-bit hash per word. Windows are compared by a hash over
    their words; equal ones meet by sorting the windows of the one document.
    """

    def covered(keys: Column) -> Column:
        ordered = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def places(s: Column) -> Column:
            last = F.size(s) - 1
            twice = F.filter(
                F.transform(
                    s,
                    lambda x, j: F.when(
                        ((j > 0) & (F.get(s, F.greatest(j - 1, F.lit(0)))["k"] == x["k"]))
                        | ((j < last) & (F.get(s, F.least(j + 1, last))["k"] == x["k"])),
                        x["i"],
                    ),
                ),
                lambda i: i.isNotNull(),
            )
            return F.sort_array(twice)

        start = F.struct(F.lit(-window).cast("int").alias("at"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            let(ordered, places),
            start,
            lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(i - a["at"], F.lit(window))).cast("long").alias("n")),
            lambda a: a["n"],
        )

    def check(h: Column) -> Column:
        n = F.size(h)
        keys = F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: F.xxhash64(F.slice(h, i, window)))
        some = let(keys, lambda k: F.when(F.size(F.array_distinct(k)) < F.size(k), covered(k)).otherwise(F.lit(0).cast("long")))
        return F.when(n > window, some).otherwise(F.lit(0).cast("long"))

    return let(hashes, check)


def statistics(text: Column) -> Column:
    """One struct of the counts that rules refer to, for a text."""
    whole = F.coalesce(text, F.lit(""))

    def of(w: Column) -> Column:
        n = F.size(w).cast("long")
        chars = F.length(F.translate(whole, SPACES, "")).cast("long")
        lines = F.filter(F.split(whole, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
        stops = F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long")
        line_counts = let(lines, lambda v: F.struct(F.size(v).cast("long").alias("n"), (F.size(v) - F.size(F.array_distinct(v))).cast("long").alias("dup")))
        return F.struct(
            n.alias("n_words"),
            chars.alias("word_chars"),
            (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            line_counts["dup"].alias("n_dup_lines"),
            repeated_window_words(F.transform(w, lambda x: F.xxhash64(x))).alias("n_repeat_words"),
            line_counts["n"].alias("n_lines"),
            stops.alias("n_stop_words"),
        )

    return let(words(text), of)


# Fixed values: (rule, numerator, denominator, least ratio, greatest ratio); a document fails a rule outside the bounds.
RULES = (
    ("length", "n_words", None, 20.0, None),
    ("mean_word", "word_chars", "n_words", 2.0, 25.0),
    ("symbols", "n_symbols", "n_words", None, 0.20),
    ("stop_words", "n_stop_words", "n_words", 0.005, None),
    ("dup_lines", "n_dup_lines", "n_lines", None, 0.50),
    ("repeats", "n_repeat_words", "n_words", None, 0.30),
)


def failed_rules(stats: Callable[[str], Column], rules=RULES) -> Column:
    """Names of the rules of the table that a document's statistics break."""
    tests = []
    for name, top, bottom, least, most in rules:
        value = stats(top).cast("double") if bottom is None else stats(top) / F.greatest(stats(bottom), F.lit(1))
        broken = F.lit(False)
        if least is not None:
            broken = broken | (value < least)
        if most is not None:
            broken = broken | (value > most)
        tests.append(F.when(broken, F.lit(name)))
    return F.array_compact(F.array(*tests))


def apply_rules(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """``docs`` with a struct ``stats`` and the array ``failed`` of broken rules."""
    spare = docs.withColumn("__stats", statistics(F.col(text)))
    return spare.withColumn("__failed", failed_rules(lambda c: F.col("__stats")[c], rules))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    s = apply_rules(docs)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    flat = s.select("doc_id", "__stats.*", "__failed").withColumn("base_failed", base)
    return flat.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("__failed") == 0)).alias("kept"),
    )


def oracle() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
win AS (SELECT rid, i, array_to_string(ws[i : i + 7], ' ') AS k
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
cover AS (SELECT rid, sum(least(8, i - coalesce(p, i - 8))) AS n
          FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM twice) GROUP BY rid),
s AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls,
        len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS n_stop, coalesce(cover.n, 0) AS n_repeat_words
      FROM w LEFT JOIN cover USING (rid)),
b AS (SELECT *, len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines,
        (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, greatest(n_words, 1) AS nw FROM s)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND n_words >= 20 AND word_chars / nw BETWEEN 2.0 AND 25.0 AND n_symbols / nw <= 0.20 AND n_stop / nw >= 0.005
    AND n_dup_lines / greatest(n_lines, 1) <= 0.50 AND n_repeat_words / nw <= 0.30 AS kept
FROM b"""
