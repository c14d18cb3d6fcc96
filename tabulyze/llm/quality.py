"""Line-first cleaning of documents with built-in expressions only.

Every line is judged by itself, failing lines go, and a document that keeps too few of its
words is rejected. Nothing is shuffled: each document is one row from scan to result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# What separates words, and what the rules look for in a line.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
SENTENCE = r"""[.!?…]["'”»)]*([\x20\x09-\x0D]|\z)"""
NAVIGATION = (r"(?i)^[\x20\x09-\x0D]*(home|menu|skip to|back to top|read more|log ?in|sign (in|up))\b.{0,40}\z"
              r"|([|›»•·>][\x20]*[^|›»•·>]{1,30}){3,}")
BOILERPLATE = (r"(?i)all rights reserved|licensed under|privacy policy|cookie policy|terms of (use|service)"
               r"|enable javascript|copyright [0-9©(]|subscribe to our")


def words_of(text: Column) -> Column:
    """Words of a text in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def _count(text: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{keep}]+", "")).cast("long")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def line_passes(line: Column, words: Column) -> Column:
    """A line needs a sentence end, must be neither navigation nor boilerplate, and may not
    have more than one symbol, or one exclamation mark, for every two words."""
    return (line.rlike(SENTENCE) & ~line.rlike(NAVIGATION) & ~line.rlike(BOILERPLATE)
            & (2 * _count(line, SYMBOLS) <= words) & (2 * _count(line, "!") <= words))


def line_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 10,
                 max_repeat_percent: int = 20, window: int = 5, min_kept_percent: int = 50) -> DataFrame:
    """One row per document: ``doc_id``, counts, ``base_failed``, ``kept`` and ``clean_text``.

    Null and empty texts have no words and fail the base rules; a repeated row is judged
    again on its own; an empty table gives an empty result; other columns are not read, so
    their names do not matter. Texts of any length are read whole.
    """
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    cut = base.select("doc_id", "text", words_of(F.col("text")).alias("w"),
                      F.filter(F.split("text", "\n", -1), lambda x: x.rlike(NOT_SPACE)).alias("lines"))
    last = F.size("w") - window
    grams = F.when(last >= 0, F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(window)]))).otherwise(F.array().cast("array<bigint>"))
    judged = cut.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _count(F.col("text"), SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), grams.alias("grams"),
        F.transform("lines", lambda x: F.struct(
            x.alias("line"), F.regexp_count(x, F.lit(NOT_SPACE + "+")).cast("long").alias("n"))).alias("lines"))
    # most documents repeat no window: only the others pay for the sort
    repeats = F.size(F.array_distinct("grams")) < F.size("grams")
    placed = F.when(repeats, F.array_sort(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    kept = F.filter("lines", lambda x: line_passes(x["line"], x["n"]))
    ranked = judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", placed.alias("s"), kept.alias("good"))
    hit = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda k:
                   F.coalesce(F.get("s", k)["h"] == F.get("s", k - 1)["h"], F.lit(False))
                   | F.coalesce(F.get("s", k)["h"] == F.get("s", k + 1)["h"], F.lit(False)))
    found = ranked.select("*", F.when(F.col("s").isNotNull(), F.array_sort(
        F.transform(hit, lambda k: F.get("s", k)["i"]))).alias("p"))
    covered = F.coalesce(_sum(F.transform("p", lambda x, k: F.least(
        F.lit(window), F.coalesce(F.get("p", k + 1) - x, F.lit(window))).cast("long"))), F.lit(0).cast("long"))
    scored = found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"),
        _sum(F.transform("good", lambda x: x["n"])).alias("n_kept_words"),
        F.array_join(F.transform("good", lambda x: x["line"]), "\n").alias("clean_text"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return scored.select("*", failed.alias("base_failed"),
                         (~failed & (100 * F.col("n_kept_words") >= min_kept_percent * F.col("n_words"))).alias("kept"))


_LINE_SQL = f"""regexp_matches(x.line, '{SENTENCE.replace("'", "''")}') and not regexp_matches(x.line, '{NAVIGATION}')
  and not regexp_matches(x.line, '{BOILERPLATE}')
  and 2 * length(regexp_replace(x.line, '[^{SYMBOLS}]+', '', 'g')) <= x.n
  and 2 * length(regexp_replace(x.line, '[^!]+', '', 'g')) <= x.n"""

QUALITY_SQL = f"""
with base as (select doc_id, coalesce(text, '') as text, row_number() over () as r from documents),
cut as (select r, doc_id, text, list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda x: x <> '') as w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{NOT_SPACE}')) as lines from base),
wins as (select r, unnest(range(len(w) - 4)) as i, w from cut where len(w) >= 5),
grams as (select r, i, w[i+1:i+5] as g from wins),
twice as (select r, i from (select r, i, count(*) over (partition by r, g) as c from grams) where c > 1),
gaps as (select r, least(5, coalesce(lead(i) over (partition by r order by i) - i, 5)) as n from twice),
covered as (select r, sum(n)::BIGINT as n_repeat_words from gaps group by r),
judged as (select r, doc_id, len(w)::BIGINT as n_words, length(list_aggr(w, 'string_agg', ''))::BIGINT as word_chars,
  length(regexp_replace(text, '[^{SYMBOLS}]+', '', 'g'))::BIGINT as n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT as n_dup_lines,
  list_filter(list_transform(lines, lambda y: struct_pack(line := y, n := len(regexp_extract_all(y, '{NOT_SPACE}+')))),
    lambda x: {_LINE_SQL}) as good from cut),
scored as (select j.*, coalesce(c.n_repeat_words, 0)::BIGINT as n_repeat_words,
  coalesce(list_sum(list_transform(good, lambda x: x.n)), 0)::BIGINT as n_kept_words from judged j left join covered c using (r))
select doc_id, n_words, coalesce(word_chars, 0)::BIGINT as word_chars, n_symbols, n_dup_lines, n_repeat_words, n_kept_words,
  (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  (not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and 100 * n_kept_words >= 50 * n_words) as kept from scored"""
