"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Every metric is a Column over one text, every rule of RULES a comparison of a metric with its bounds; compile_rules()
folds them into the verdict. Words are runs of ``[^\\x20\\x09-\\x0D]``. Null text counts as empty: all metrics 0,
base_failed (under 20 words), not kept. A ratio of an empty text is 0. Rows are judged alone, so repeated rows, ties and
null ids change nothing. Windows of words are equal when their 64-bit hashes are. A very long text is one row of arrays.
Other columns than doc_id and text are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WINDOW = 8
#: Frequent function words of the four languages.
STOP_WORDS = {
    "en": "the be to of and that have with is was are it for on as by this from at a in",
    "de": "der die das und ist von mit den zu auf nicht sich ein eine für im dem des",
    "fr": "le la les de des et un une est que qui dans pour par sur pas au du en elle",
    "es": "el la los de que y en un una es por con para su se las del al no lo",
}
#: Metric, least and most allowed value (None: no bound).
RULES: list[tuple[str, float | None, float | None]] = [
    ("n_words", 20, None),
    ("mean_word_chars", 2, 15),
    ("symbol_word_ratio", None, 0.1),
    ("upper_word_ratio", None, 0.5),
    ("alpha_word_ratio", 0.6, None),
    ("stop_word_ratio", 0.02, None),
    ("bullet_line_ratio", None, 0.9),
    ("ellipsis_line_ratio", None, 0.3),
    ("dup_line_ratio", None, 0.4),
    ("stutter_ratio", None, 0.3),
]


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once for each row."""
    return F.transform(F.array(value), body)[0]


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more; hashes: of the windows, in order."""
    keyed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    repeated = let(keyed, lambda k: F.filter(k, lambda x, j: same(x, F.get(k, j + 1)) | same(x, F.get(k, j - 1))))
    starts = F.array_sort(F.transform(repeated, lambda x: x["i"]))
    return let(starts, lambda s: F.aggregate(F.transform(s, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(s, j + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x))


def n_repeat_words(words: Column) -> Column:
    """Words of windows of 8 words that the text has twice or more, the first included."""
    no_window = F.array().cast("array<bigint>")
    # a word is hashed once, a window from the hashes of its words
    of_windows = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))
    hashes = F.when(F.size(words) < WINDOW, no_window).otherwise(let(F.transform(words, lambda x: F.xxhash64(x)), of_windows))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(h)))


def metrics() -> dict[str, Column]:
    """Columns over _w (words), _l (lines with a word) and _t (text), which judge() lays out first."""
    w, lines, t = F.col("_w"), F.col("_l"), F.col("_t")
    n, n_lines = F.size(w).cast("long"), F.size(lines)
    of_words = lambda x: F.when(n > 0, x / n).otherwise(0.0)
    of_lines = lambda x: F.when(n_lines > 0, x / n_lines).otherwise(0.0)
    stop = sorted({x for v in STOP_WORDS.values() for x in v.split()})
    chars = F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x))
    dup = (n_lines - F.size(F.array_distinct(lines))).cast("long")
    symbols = F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long")
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    return {
        "n_words": n,
        "word_chars": chars,
        "n_symbols": symbols,
        "n_dup_lines": dup,
        "n_repeat_words": n_repeat_words(w),
        "mean_word_chars": of_words(F.col("word_chars")),
        "symbol_word_ratio": of_words(F.col("n_symbols")),
        "upper_word_ratio": of_words(count(r"(?<![^ \t-\r])[A-Z]{2,}[^a-z \t-\r]*(?![^ \t-\r])")),
        "alpha_word_ratio": of_words(count(r"(?<![^ \t-\r])[^ \t-\r]*?\p{L}")),
        "stop_word_ratio": of_words(F.size(F.filter(w, lambda x: F.lower(x).isin(stop)))),
        "bullet_line_ratio": of_lines(count(r"(?md)^[ \t]*[-*•]")),
        "ellipsis_line_ratio": of_lines(count(r"(?md)(?:\.\.\.|…)[ \t]*$")),
        "stutter_ratio": of_words(F.size(F.filter(w, lambda x, i: x == F.coalesce(F.get(w, i - 1), F.lit(""))))),
        "dup_line_ratio": of_lines(F.col("n_dup_lines")),
    }


def compile_rules(rules=RULES) -> Column:
    """True where every metric lies within its bounds."""
    verdict = F.lit(True)
    for name, least, most in rules:
        if least is not None:
            verdict = verdict & (F.col(name) >= least)
        if most is not None:
            verdict = verdict & (F.col(name) <= most)
    return verdict


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """docs (doc_id, text) with all metrics, base_failed and kept."""
    all_metrics = metrics()
    base = {k: v for k, v in all_metrics.items() if k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    laid = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t"))
    laid = laid.withColumns({"_w": F.filter(F.split("_t", r"[ \t-\r]+"), lambda x: x != ""), "_l": F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))})
    measured = laid.withColumns(base).withColumns({k: v for k, v in all_metrics.items() if k not in base})
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measured.drop("_t", "_w", "_l").withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_verdict() -> str:
    parts = [f"{n} >= {a}" for n, a, _ in RULES if a is not None] + [f"{n} <= {b}" for n, _, b in RULES if b is not None]
    return " AND ".join(parts)


_STOPS = ", ".join(f"'{x}'" for x in sorted({x for v in STOP_WORDS.values() for x in v.split()}))
SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[ \\t-\\r]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS l FROM t),
win AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k + 7], ' '))) AS s FROM w),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS c FROM dup, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words, w, l
      FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
r AS (SELECT *, greatest(n_words, 1) AS d, greatest(len(l), 1) AS e FROM m),
q AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
             word_chars / d AS mean_word_chars, n_symbols / d AS symbol_word_ratio,
             len(list_filter(w, lambda x: regexp_full_match(x, '[A-Z]{{2,}}[^a-z]*'))) / d AS upper_word_ratio,
             len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) / d AS alpha_word_ratio,
             len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) / d AS stop_word_ratio,
             len(list_filter(l, lambda x: regexp_matches(x, '^[ \\t]*[-*•]'))) / e AS bullet_line_ratio,
             len(list_filter(l, lambda x: regexp_matches(x, '(?:\\.\\.\\.|…)[ \\t]*$'))) / e AS ellipsis_line_ratio,
             len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) / d AS stutter_ratio,
             n_dup_lines / e AS dup_line_ratio,
             (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {_sql_verdict()}) AS kept FROM q
"""
