"""Quality rules: a table of thresholds, compiled into one projection without user functions.

Words are runs of characters other than space and tab to carriage return. Each rule bounds a share,
in whole hundredths, so every comparison is between integers and exact. Two windows of five words
are taken as equal if a 64-bit hash of the five says so.

Defined cases: a null text is an empty one, without words; it and any text of fewer than ten words
fail the base; a null id stays null; repeated rows are judged once each; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5
# Common function words of English, French, German and Spanish.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was", "on", "are", "by", "this", "from", "at", "or", "an", "be", "a",
    "le", "la", "les", "de", "des", "du", "un", "une", "et", "en", "est", "que", "qui", "pour", "dans", "par", "sur", "au", "ou",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "dem", "ein", "eine", "ist", "im", "für", "auf", "nicht", "sich", "auch",
    "el", "los", "las", "y", "del", "se", "por", "con", "para", "no", "su", "al", "lo", "como", "más", "es",
]


class Rule(NamedTuple):
    """100 times ``part`` must lie between ``low`` and ``high`` times ``whole``; None is no bound."""

    name: str
    part: str
    whole: str
    low: int | None
    high: int | None


#: The threshold table. Parts and wholes are measures of ``measured``.
RULES = [
    Rule("enough words", "n_words", "one", 1_000, None),
    Rule("repeated windows", "n_repeat_words", "n_words", None, 20),
    Rule("word length", "word_chars", "n_words", 200, 1_500),
    Rule("symbols a word", "n_symbols", "n_words", None, 10),
    Rule("capitals", "n_capitals", "word_chars", None, 40),
    Rule("words with letters", "n_letter_words", "n_words", 70, None),
    Rule("stop words", "n_stop_words", "n_words", 2, None),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 30),
    Rule("echoed words", "n_echoed_words", "n_words", None, 20),
    Rule("bullet lines", "n_bullet_lines", "n_lines", None, 90),
    Rule("ellipsis lines", "n_ellipsis_lines", "n_lines", None, 30),
]
#: The rules that make up the base; their bounds are part of its definition.
BASE = ["enough words", "repeated windows"]


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _covered(hashes: str) -> Column:
    """Words inside a window that occurs more than once, from the hashes of the windows in order."""
    placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    ordered = F.sort_array(placed)
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), ordered)


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, and one column for each measure), a chain of projections over each row alone."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    cut = named.select(
        "doc_id", "text",
        F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n", -1), lambda s: _without(s, SPACE) != "").alias("lines"),
    )
    following = [F.lit(k) for k in range(1, WINDOW)]
    windows = F.transform(
        F.slice("words", 1, F.greatest(F.size("words") - (WINDOW - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *[F.get("words", i + k) for k in following]))
    trimmed = F.transform("lines", lambda s: F.ltrim(s))
    counted = cut.select(
        "doc_id",
        F.lit(1).alias("one"),
        F.size("words").alias("n_words"),
        F.length(_without(F.col("text"), SPACE)).alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).alias("n_symbols"),
        (F.length("text") - F.length(_without(F.col("text"), CAPITALS))).alias("n_capitals"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).alias("n_stop_words"),
        F.size(F.filter("words", lambda w: w.rlike(r"\p{L}"))).alias("n_letter_words"),
        F.size(F.filter("words", lambda w, i: w == F.get("words", i - 1))).alias("n_echoed_words"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size(F.filter(trimmed, lambda s: F.substring(s, 1, 1).isin("-", "*", "•"))).alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda s: s.rlike(r"(\.\.\.|…)\s*$"))).alias("n_ellipsis_lines"),
        windows.alias("windows"),
    )
    # Places of the windows that occur twice or more, in order of the text.
    ordered = counted.withColumn("ordered", _covered("windows"))
    twice = F.filter("ordered", lambda e, j: (e.h == F.get("ordered", j - 1).h) | (e.h == F.get("ordered", j + 1).h))
    places = ordered.withColumn("places", F.sort_array(F.transform(twice, lambda e: e.i)))
    steps = F.transform("places", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("places", j + 1) - p, F.lit(WINDOW))))
    covered = F.coalesce(F.aggregate(steps, F.lit(0), lambda a, b: a + b), F.lit(0))
    return places.withColumn("n_repeat_words", covered).drop("windows", "ordered", "places")


def passes(rule: Rule) -> Column:
    part, whole = 100 * F.col(rule.part).cast("bigint"), F.col(rule.whole).cast("bigint")
    bounds = [part >= rule.low * whole] if rule.low is not None else []
    bounds += [part <= rule.high * whole] if rule.high is not None else []
    return reduce(lambda a, b: a & b, bounds)


def verdict(rules: list[Rule]) -> Column:
    return reduce(lambda a, b: a & b, [passes(r) for r in rules])


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed),
    the last being the names of the rules that the text breaks."""
    base = [r for r in RULES if r.name in BASE]
    broken = F.array(*[F.when(~passes(r), F.lit(r.name)) for r in rules])
    return measured(docs, doc_id, text).select(
        "doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        (~verdict(base)).alias("base_failed"), (verdict(base) & verdict(rules)).alias("kept"),
        F.array_join(F.array_compact(broken), ", ").alias("failed"))


def _sql_share(rule: Rule) -> str:
    parts = [f"100 * {rule.part} >= {rule.low} * {rule.whole}"] if rule.low is not None else []
    parts += [f"100 * {rule.part} <= {rule.high} * {rule.whole}"] if rule.high is not None else []
    return " AND ".join(parts)


def sql(rules: list[Rule] = RULES) -> str:
    """The same table of rules for DuckDB."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    broken = ", ".join(f"CASE WHEN NOT ({_sql_share(r)}) THEN '{r.name}' END" for r in rules)
    base = " AND ".join(_sql_share(r) for r in RULES if r.name in BASE)
    every = " AND ".join(_sql_share(r) for r in rules)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
q AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i : i + 4], ' ')) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM q WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, 1 AS one, len(words) AS n_words,
  length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals,
  len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS n_stop_words,
  len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
  len(list_filter(list_zip(words, words[2:]), lambda x: x[1] = x[2])) AS n_echoed_words,
  len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  len(list_filter(lines, lambda x: ltrim(x)[1] IN ('-', '*', '•'))) AS n_bullet_lines,
  len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipsis_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, NOT ({base}) AS base_failed,
  ({base} AND {every}) AS kept, array_to_string(list_filter([{broken}], lambda x: x IS NOT NULL), ', ') AS failed FROM m
"""
