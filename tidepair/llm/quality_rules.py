"""Line-first cleaning: rules judge each line, failing lines go, then texts that lost too much.

DataFrame expressions only. A line (text between ``\\n``) with a word is removed if

- punctuation: no word in it ends in a sentence mark (closing quotes and brackets may follow),
  a tenth or more of it are symbols, or it holds three runs of two or more marks like ``!!``, one
  in a hundred characters or more;
- navigation: it holds two or more bars or arrows between items, one in forty characters or more;
  angle marks count only in lines that hold none of the other direction, which quotations do;
- boilerplate: it is short and holds a phrase of licences, notices or page furniture.

Lines without a word are never counted as lost and are dropped with their neighbours' ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepair.llm import text as tx

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"#*$%&|<>"
#: Base thresholds: least words, and most words in repeated windows, in per cent.
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
#: A text that loses more than this share of its characters goes, in per cent.
MOST_LOST = 40
#: Symbols in a line, in per cent of its characters.
MOST_SYMBOLS = 10
#: Boilerplate phrases count in lines up to this long; a paragraph may mention them.
NOTICE_CHARS = 200
#: A run of marks, or a separator of items, counts in lines of up to so many characters for each.
SHOUT_CHARS, ITEM_CHARS = 100, 40
SENTENCE = r"[.!?…。！？؟۔।॥][\"'\)\]»”’]*([\x20\x09-\x0D]|$)"
SHOUTS = r"[!?]{2}.*[^!?][!?]{2}.*[^!?][!?]{2}"
RUNS = r"[!?]{2,}"
BARS, ANGLES, OPENING = "|→", "»›", "«‹"
ITEMS = rf"[{BARS}{ANGLES}].*[{BARS}{ANGLES}]"
NOTICES = (
    "all rights reserved", "licensed under", "released under the", "spdx-license", "copyright ", "(c) 20",
    "terms of use", "terms of service", "privacy policy", "cookie", "javascript", "sign in", "log in",
    "subscribe", "newsletter", "click here", "read more", "back to top", "skip to content", "share this",
    "powered by", "lorem ipsum",
)


def line_fails(line: Column) -> dict[str, Column]:
    """Which rule families a line fails."""
    symbols = F.length(F.regexp_replace(line, f"[^{SYMBOLS}]+", ""))
    lowered = F.lower(line)
    notice = F.lit(False)
    for phrase in NOTICES:
        notice = notice | F.contains(lowered, F.lit(phrase))
    shouts = line.rlike(SHOUTS) & (SHOUT_CHARS * F.size(F.regexp_extract_all(line, F.lit(RUNS), F.lit(0))) >= F.length(line))
    only = lambda marks: F.length(F.regexp_replace(line, f"[^{marks}]+", ""))
    items = F.when(line.rlike(f"[{OPENING}]"), only(BARS)).otherwise(only(BARS + ANGLES))
    return {
        "punctuation": ~line.rlike(SENTENCE) | (100 * symbols >= MOST_SYMBOLS * F.length(line)) | shouts,
        "navigation": line.rlike(ITEMS) & (items >= 2) & (ITEM_CHARS * items >= F.length(line)),
        "boilerplate": (F.length(line) <= NOTICE_CHARS) & notice,
    }


def _repeat_words(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words covered by windows that the text holds twice or more.

    Windows are compared by hash in one array of the text. Only texts that have a repeated
    window sort (hash, position) pairs; the union of their windows is a sum over gaps.
    """
    docs = docs.withColumn(
        "_grams",
        F.when(
            F.col("n_words") >= WINDOW,
            F.transform(F.sequence(F.lit(1), F.col("n_words").cast("int") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW))),
        ),
    ).drop("_words")
    docs = docs.withColumn(
        "_pairs",
        F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    ).drop("_grams")
    same = lambda p, i: F.coalesce(F.get("_pairs", i)["h"] == p["h"], F.lit(False))
    docs = docs.withColumn("_at", F.sort_array(F.transform(F.filter("_pairs", lambda p, i: same(p, i - 1) | same(p, i + 1)), lambda p: p["i"]))).drop("_pairs")
    gaps = F.transform("_at", lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", i + 1) - at, F.lit(WINDOW))))
    return docs.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0), lambda s, g: s + g), F.lit(0)).cast("long")).drop("_at")


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts, base verdict, line cleaning and the final verdict.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, n_lines, n_failed_lines, lost_chars, line_chars and the cleaned text. A null text
    counts as empty: it fails the base rules. An empty table gives an empty result; repeated
    rows are judged alike; other columns of ``docs`` are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.withColumn("_words", F.regexp_extract_all("text", F.lit(tx.WORD), F.lit(0)))
    rows = rows.withColumn("n_words", F.size("_words").cast("long")).withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    rows = _repeat_words(rows)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(tx.WORD))
    rows = rows.withColumn("n_symbols", F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long")).withColumn("_lines", lines)

    def fails(line):
        punctuation, navigation, boilerplate = line_fails(line).values()
        return punctuation | navigation | boilerplate

    rows = rows.withColumn("_good", F.filter("_lines", lambda x: ~fails(x)))
    chars = lambda of: F.length(F.array_join(of, "")).cast("long")
    rows = rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))).alias("base_failed"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_good")).cast("long").alias("n_failed_lines"),
        chars("_lines").alias("line_chars"),
        (chars("_lines") - chars("_good")).alias("lost_chars"),
        F.array_join("_good", "\n").alias("cleaned"),
    )
    # A numbered row keeps the optimiser from copying the whole judgement into a filter on it.
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    kept = ~F.col("base_failed") & (100 * F.col("lost_chars") <= MOST_LOST * F.col("line_chars")) & (F.col("_row") >= 0)
    return rows.withColumn("kept", kept).drop("_row")


def clean(docs: DataFrame) -> DataFrame:
    """Documents that pass, with their failing lines removed; columns as in ``docs``.

    ``n_chars``, where there is one, becomes the length of the cleaned text. The row travels
    beside the judged columns in one struct, so clashing names can't meet.
    """
    judged = judge(docs.select(F.struct(*docs.columns).alias("doc_id"), "text")).where("kept")
    out = []
    for field in docs.schema.fields:
        if field.name == "text":
            value = F.col("cleaned")
        elif field.name == "n_chars":
            value = F.length("cleaned")
        else:
            value = F.col("doc_id").getField(field.name)
        out.append(value.cast(field.dataType).alias(field.name))
    return judged.select(*out)


_ITEMS_SQL = f"length(regexp_replace(line, CASE WHEN regexp_matches(line, '[{OPENING}]') THEN '[^{BARS}]+' ELSE '[^{BARS}{ANGLES}]+' END, '', 'g'))"
_LINE_SQL = f"""
        NOT regexp_matches(line, '{SENTENCE.replace("'", "''")}')
        OR 100 * length(regexp_replace(line, '[^{SYMBOLS}]+', '', 'g')) >= {MOST_SYMBOLS} * length(line)
        OR (regexp_matches(line, '{SHOUTS}') AND {SHOUT_CHARS} * len(regexp_extract_all(line, '{RUNS}')) >= length(line))
        OR (regexp_matches(line, '{ITEMS}') AND {_ITEMS_SQL} >= 2 AND {ITEM_CHARS} * {_ITEMS_SQL} >= length(line))
        OR (length(line) <= {NOTICE_CHARS} AND ({" OR ".join(f"contains(lower(line), '{p}')" for p in NOTICES)}))"""

SQL = f"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, unnest(regexp_extract_all(text, '{tx.WORD}')) AS w, generate_subscripts(regexp_extract_all(text, '{tx.WORD}'), 1) AS i FROM base),
counted AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars FROM words GROUP BY r),
grams AS (
    SELECT r, i, string_agg(w, ' ') OVER f AS g, count(*) OVER f AS n
    FROM words WINDOW f AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)
),
marked AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS times FROM grams WHERE n = {WINDOW}),
spread AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS gap FROM marked WHERE times > 1),
repeated AS (SELECT r, sum(least({WINDOW}, coalesce(gap, {WINDOW}))) AS n_repeat_words FROM spread GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM base),
judged AS (
    SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) AS n_lines, sum(length(line)) AS line_chars,
        count(*) FILTER (WHERE {_LINE_SQL}) AS n_failed_lines,
        sum(length(line)) FILTER (WHERE {_LINE_SQL}) AS lost_chars
    FROM lines WHERE regexp_matches(line, '{tx.WORD}') GROUP BY r
),
joined AS (
    SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
        length(regexp_replace(text, '[^{SYMBOLS}]+', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
        coalesce(n_failed_lines, 0) AS n_failed_lines, coalesce(line_chars, 0) AS line_chars, coalesce(lost_chars, 0) AS lost_chars
    FROM base LEFT JOIN counted USING (r) LEFT JOIN repeated USING (r) LEFT JOIN judged USING (r)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
    n_repeat_words::BIGINT AS n_repeat_words, (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AS base_failed,
    NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND 100 * lost_chars <= {MOST_LOST} * line_chars AS kept,
    n_lines::BIGINT AS n_lines, n_failed_lines::BIGINT AS n_failed_lines, lost_chars::BIGINT AS lost_chars, line_chars::BIGINT AS line_chars
FROM joined"""
