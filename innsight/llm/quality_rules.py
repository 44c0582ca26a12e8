"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, let

SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8  # a power of two: hashes of windows are made by doubling
#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that it for with as was be this from on at by are or an "
    "der die das und in den von zu mit ist des im nicht ein eine als auch auf für "
    "de la el que y en los se del las un por con una su para es no al "
    "le les et des du une que dans qui pour pas sur plus par au avec"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails when `measure` is outside [low, high]; a null bound is open, a null measure passes."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The table: length, symbol, stop-word and line ratios.
RULES = (
    Rule("n_words", "n_words", 20, None),
    Rule("mean_word_chars", "word_chars / n_words", 2.0, 15.0),
    Rule("symbols_per_word", "n_symbols / n_words", None, 0.2),
    Rule("stop_word_ratio", "n_stop_words / n_words", 0.01, None),
    Rule("dup_line_ratio", "n_dup_lines / n_lines", None, 0.5),
    Rule("capital_ratio", "n_capitals / word_chars", None, 0.5),
)


def _removed(text: Column, chars: str) -> Column:
    """Characters of text that are in chars."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window found twice or more. Windows are compared by 64-bit hashes within one text."""
    n = F.size(words)

    def covered(hashes: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
            starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
            return let(starts, lambda p: F.aggregate(F.transform(p, lambda x, k: F.when(k == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), x - F.get(p, k - 1)))), F.lit(0).cast("long"), lambda a, x: a + x))

        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(pairs, of_sorted))

    def twice_as_wide(own: Column, step: int) -> Column:
        """Hashes of 2 * step words from those of step words; the last ones, which lack words, are cut off below."""
        return let(own, lambda x: F.zip_with(x, F.slice(x, step + 1, F.size(x)), lambda u, v: F.xxhash64(u, v)))

    def windows(own: Column) -> Column:
        return let(F.slice(twice_as_wide(twice_as_wide(twice_as_wide(own, 1), 2), 4), F.lit(1), n - (WINDOW - 1)), covered)

    return F.when(n > WINDOW, let(F.transform(words, lambda w: F.xxhash64(w)), windows)).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, n_lines and n_capitals of the whole text.

    Null text has no words and no lines. Columns of these names that docs has already are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, SPLIT), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r"), F.size(F.filter(w, lambda x: (F.length(x) <= max(map(len, STOP_WORDS))) & F.lower(x).isin(STOP_WORDS))).cast("long").alias("s"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))

    kept = [c for c in docs.columns if c not in ("_w", "_l")]
    base = docs.select(*kept, let(words, of_words).alias("_w"), let(lines, of_lines).alias("_l"))
    new = {
        "n_words": F.col("_w.n"),
        "word_chars": F.length(F.translate(t, BLANKS, "")).cast("long"),
        "n_symbols": _removed(t, SYMBOLS).cast("long"),
        "n_dup_lines": F.col("_l.d"),
        "n_repeat_words": F.col("_w.r"),
        "n_stop_words": F.col("_w.s"),
        "n_lines": F.col("_l.n"),
        "n_capitals": _removed(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long"),
    }
    return base.withColumns(new).drop("_w", "_l")


def verdict(rules=RULES) -> Column:
    """True if no rule of the table fails; all rules are one conjunction, evaluated in generated code."""
    out = F.lit(True)
    for r in rules:
        m = F.expr(f"try_divide({r.measure.split(' / ')[0]}, {r.measure.split(' / ')[1]})" if " / " in r.measure else r.measure)
        for bad in ([m < r.low] if r.low is not None else []) + ([m > r.high] if r.high is not None else []):
            out = out & ~F.coalesce(bad, F.lit(False))
    return out


def judge(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """docs with the measures, base_failed and kept. Empty and null texts have base_failed; repeated rows are judged alike."""
    m = measures(docs, text)
    m = m.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return m.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def query(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOP_SQL = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
ORACLE_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (
  SELECT doc_id, w, t, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
    (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_capitals,
    len(list_filter(w, lambda x: lower(x) IN ({_STOP_SQL})))::BIGINT AS n_stop
  FROM t),
p AS (SELECT doc_id, unnest(range(1, n_words - 6)) AS i FROM m WHERE n_words > 8),
g AS (SELECT p.doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM p JOIN m USING (doc_id)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, sum(least(8, coalesce(i - p, 8)))::BIGINT AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r) GROUP BY 1),
f AS (SELECT m.doc_id, n_words, word_chars, n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(l) AS n_lines, n_capitals, n_stop FROM m LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND word_chars / n_words BETWEEN 2.0 AND 15.0 AND n_symbols / n_words <= 0.2
    AND n_stop / n_words >= 0.01 AND n_dup_lines / n_lines <= 0.5 AND n_capitals / word_chars <= 0.5 AS kept
FROM f
"""
