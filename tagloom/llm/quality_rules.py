"""Quality rules: a threshold table compiled into one Spark projection, with no user functions.

Words are maximal runs of characters other than space and tab..carriage return. Null and empty texts have
no words and fail the base rule. Only `doc_id` and `text` are read, so extra columns and repeated rows pass
through untouched: a row in gives a row out, and the result depends on that row alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import SPACE, table, words_of

#: Frequent function words of English, German, French and Spanish (fixed values).
STOP_WORDS = """
the of and to in is was for that on with as it by be at are this from or an have not
der die das und in den von zu mit ist des dem ein eine im auf für nicht sich als auch
le la les de des et en un une du que est pour dans qui sur au avec par ce pas
el la los las de que y en un una por con para su se del lo al es no
""".split()

#: (name, SQL over the measures below, least, most). A measure outside its bounds rejects the document; null never does.
THRESHOLDS: list[tuple[str, str, float | None, float | None]] = [
    ("mean_word_chars", "word_chars / n_words", 2.0, 14.0),
    ("symbols_per_word", "n_symbols / n_words", None, 0.3),
    ("stop_word_ratio", "(n_stop_words + 2) / n_words", 0.06, None),
    ("dup_line_ratio", "n_dup_lines / n_lines", None, 0.5),
    ("words_per_line", "n_words / n_lines", 2.0, None),
]

#: A document under BASE_WORDS words, or with over BASE_REPEATS percent of its words in repeated windows, fails the base rule.
BASE_WORDS, BASE_REPEATS, WINDOW = 10, 20, 5


def measures(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to carry and the counts that rules are made of: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words, n_repeat_words."""
    later = ", ".join(f"get(_h, i + {k})" for k in range(1, WINDOW))
    return (
        docs.select(*carry, F.coalesce("text", F.lit("")).alias("_t"))
        .select(*carry, "_t", F.expr(words_of("_t")).alias("_w"), F.expr(f"filter(split(_t, '\n'), l -> l rlike '[^{SPACE}]')".replace("\\", "\\\\").replace("'\n'", "'\\n'")).alias("_l"))
        .select(
            *carry,
            F.size("_w").cast("long").alias("n_words"),
            F.char_length(F.regexp_replace("_t", f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
            F.char_length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            F.size("_l").cast("long").alias("n_lines"),
            (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
            F.size(F.filter("_w", lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
        )
        # One hash for each window of five words; fewer words have no window.
        .withColumn("_g", F.expr(f"slice(transform(_h, (h, i) -> xxhash64(h, {later})), 1, greatest(size(_h) - {WINDOW - 1}, 0))"))
        .withColumn("_all_new", F.expr("size(array_distinct(_g)) = size(_g)"))
        # Positions of windows whose hash has a neighbour in sorted order; what each covers ends where the next begins.
        .withColumn("_s", F.expr("if(_all_new, cast(array() as array<struct<g: bigint, p: int>>), array_sort(transform(_g, (g, i) -> struct(g, i as p))))"))
        .withColumn("_p", F.expr("sort_array(transform(filter(_s, (s, i) -> s.g = get(_s, i - 1).g or s.g = get(_s, i + 1).g), s -> s.p))"))
        .withColumn("n_repeat_words", F.expr(f"aggregate(transform(_p, (p, i) -> least({WINDOW}, coalesce(get(_p, i + 1) - p, {WINDOW}))), 0L, (a, x) -> a + x)"))
        .drop("_h", "_g", "_s", "_p", "_all_new")
    )


def verdict() -> Column:
    """The threshold table as one Boolean expression."""
    bounds = [f"({what}) {sign} {x!r}" for _, what, least, most in THRESHOLDS for sign, x in ((">=", least), ("<=", most)) if x is not None]
    return F.coalesce(F.expr(" and ".join(f"coalesce({b}, true)" for b in bounds)), F.lit(True))


def quality_rules(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row per document: the columns to carry, its counts, base_failed, and kept (not base_failed, and within every threshold)."""
    base = F.expr(f"n_words < {BASE_WORDS} or 100 * n_repeat_words > {BASE_REPEATS} * n_words")
    return measures(docs, carry).withColumn("base_failed", base).withColumn("kept", F.expr("n_words > 0") & ~base & F.when(F.col("n_words") > 0, verdict()).otherwise(F.lit(False)))


def passing(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """The columns to carry of the documents that are kept.

    The row number keeps the filter above the projection: moved below, it would repeat the measures in each other.
    """
    judged = quality_rules(docs, carry).withColumn("_row", F.monotonically_increasing_id())
    return judged.filter("kept and _row >= 0").select(*carry)


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_sql() -> str:
    """The same in DuckDB's SQL, from the words and lines themselves instead of hashes."""
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    bounds = [f"({what}) {sign} {x!r}" for _, what, least, most in THRESHOLDS for sign, x in ((">=", least), ("<=", most)) if x is not None]
    sp = r"\x20\x09-\x0D"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[{sp}]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{sp}]')) AS l FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS p, w FROM w WHERE len(w) >= 5),
h AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, array_to_string(w[p:p+4], ' ')) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p+1, p+2, p+3, p+4]) AS q FROM h WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, len(l) AS n_lines,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  len(list_filter(w, lambda x: x IN ({stops}))) AS n_stop_words, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_REPEATS} * n_words AS base_failed,
  n_words >= {BASE_WORDS} AND 100 * n_repeat_words <= {BASE_REPEATS} * n_words AND {" AND ".join(bounds)} AS kept
FROM m"""
