"""Quality rules: a threshold table compiled into Spark projections; no user functions.

Counts are taken from whole texts: words, their code points, symbols, lines equal to an earlier line, words inside
5-word windows that a text holds twice or more, stop words, words equal to the word before, exclamation marks. A rule
of the table bounds one count by a percentage of another, from a least number of words on, in whole numbers.
Everything is computed inside a row: nothing is shuffled, and a row's work is n log n in its words at most.

Windows are compared by the 64-bit hash of their words' 64-bit hashes, within one text only.

Defined results: a null or blank text has no words, fails the base rules and is not kept; equal rows get equal rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandex.llm.common import column, words_of

SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 5
#: Fails below so many words, or if over so many hundredths of the words lie in repeated windows.
BASE_WORDS, BASE_REPEAT = 10, 20
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = """the of and to in is that for it as was with be by on not this are or from at which but have an
der die das und ist nicht von zu mit den auf ein eine im dem des sich
le la les des et de un une du en que qui est dans pour par sur avec
el los las y del una por con su para se no lo""".split()

#: (count, at least or at most, percent, of count, from so many words on)
TABLE = [
    ("word_chars", "at least", 200, "n_words", 0),
    ("word_chars", "at most", 1500, "n_words", 0),
    ("n_symbols", "at most", 10, "n_words", 0),
    ("n_marks", "at most", 50, "n_words", 0),
    ("n_stop_words", "at least", 1, "n_words", 200),
    ("n_dup_lines", "at most", 50, "n_lines", 0),
    ("n_same_as_last", "at most", 30, "n_words", 0),
]


def _count(values: Column) -> Column:
    return F.size(values).cast("long")


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words, n_same_as_last, n_marks)."""
    text = F.coalesce(docs[text_col], F.lit(""))
    stop = sorted({form for w in STOP_WORDS for form in (w, w.capitalize())})
    base = docs.select(docs[id_col].alias("id"), text.alias("t"))
    cut = base.select(
        "id",
        words_of(F.col("t")).alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        _without(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        _without(F.col("t"), "[^!]+").cast("long").alias("n_marks"),
    )
    hashed = cut.select(
        "id",
        "n_symbols",
        "n_marks",
        _count(F.col("w")).alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _count(F.col("lines")).alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _count(F.filter("w", lambda x: x.isin(stop))).alias("n_stop_words"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    plain = ["id", "n_symbols", "n_marks", "n_words", "word_chars", "n_lines", "n_dup_lines", "n_stop_words"]
    starts = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int"))).otherwise(F.array().cast("array<int>"))
    windows = hashed.select(
        *plain,
        _count(F.filter("h", lambda x, i: x == F.get(F.col("h"), i - 1))).alias("n_same_as_last"),
        F.transform(starts, lambda i: F.xxhash64(*(F.get(F.col("h"), i + k) for k in range(WINDOW)))).alias("g"),
    )
    repeats = F.size(F.array_distinct("g")) < F.size("g")
    pairs = F.array_sort(F.transform("g", lambda x, i: F.struct(x.alias("g"), i.alias("at"))))
    ordered = windows.select(*plain, "n_same_as_last", F.when(repeats, pairs).otherwise(F.array().cast("array<struct<g:bigint,at:int>>")).alias("s"))
    s = F.col("s")
    twice = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["g"] == x["g"], F.lit(False)))
    at = F.array_sort(F.transform(twice, lambda x: x["at"]))
    covered = F.aggregate(
        at,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")),
        lambda acc: acc["n"].cast("long"),
    )
    return ordered.select(F.col("id").alias(id_col), *plain[1:], "n_same_as_last", F.when(F.size("s") > 0, covered).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"))


def verdict(table: list[tuple[str, str, int, str, int]] = TABLE) -> Column:
    """The table as one condition on counts."""
    kept = F.lit(True)
    for count, way, percent, of, least in table:
        have, bound = F.col(count) * 100, F.col(of) * percent
        kept = kept & ((F.col("n_words") < least) | (have >= bound if way == "at least" else have <= bound))
    return kept


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: list[tuple[str, str, int, str, int]] = TABLE) -> DataFrame:
    """Counts with base_failed and kept; kept is false where base_failed, else the table's verdict."""
    failed = (F.col("n_words") < BASE_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * BASE_REPEAT)
    return counts(docs, id_col, text_col).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(table))


def keep(docs: DataFrame, text_col: str = "text", table: list[tuple[str, str, int, str, int]] = TABLE) -> DataFrame:
    """The rows that are kept, with all their columns."""
    rows = docs.select(F.struct(*(column(docs, c) for c in docs.columns)).alias("__row"), column(docs, text_col).alias("__text"))
    judged = judge(rows, "__row", "__text", table)
    # Not where(): it would be pushed below the projections, and each count would be computed again at every mention.
    return judged.select(F.explode(F.when(F.col("kept"), F.array("__row"))).alias("__row")).select("__row.*")


def oracle_sql() -> str:
    """The same for DuckDB."""
    stop = ", ".join(sorted(f"'{form}'" for form in {form for w in STOP_WORDS for form in (w, w.capitalize())}))
    rules = " AND ".join(f"(n_words < {least} OR {count} * 100 {'>=' if way == 'at least' else '<='} {of} * {percent})" for count, way, percent, of, least in TABLE)
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{word}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM d),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT doc_id, i, word, lag(word) OVER o AS last, CASE WHEN lead(word, 4) OVER o IS NOT NULL THEN [word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o] END AS g FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g WHERE g IS NOT NULL) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) r(k) GROUP BY doc_id),
same AS (SELECT doc_id, count(*) AS n FROM g WHERE word = last GROUP BY doc_id),
c AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '{SYMBOLS}', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t, '[^!]+', '', 'g'))::BIGINT AS n_marks,
  len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  len(list_filter(w, lambda x: x IN ({stop})))::BIGINT AS n_stop_words,
  coalesce(same.n, 0)::BIGINT AS n_same_as_last, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN same USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT *, n_words < {BASE_WORDS} OR n_repeat_words * 100 > n_words * {BASE_REPEAT} AS base_failed,
  NOT (n_words < {BASE_WORDS} OR n_repeat_words * 100 > n_words * {BASE_REPEAT}) AND ({rules}) AS kept
FROM c"""
