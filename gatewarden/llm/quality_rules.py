"""Quality rules with cross-document line frequency, in DataFrame functions only.

Each document gets counts over its own words and lines (base rules). Then the normalised lines of all documents are hashed
and, for each host (the source column), the distinct texts that hold a line are counted. Lines held by more than a share of
a host's texts are taken out; a document that loses too much, or keeps too few words, is rejected.

A null or empty text has no words: all counts are 0 and the base rules reject it. Copies of one text count once as holders of
a line, so that a group of copies doesn't turn its own prose into boilerplate. Null hosts form one host of their own. Repeated rows are judged
alike, each with a row of its own. Columns other than those named are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BETWEEN, BLANKS, table

SYMBOLS = "#*$%&|<>"


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, BETWEEN), lambda w: w != "")


def repeated_words(words: Column, width: int = 8) -> Column:
    """Words inside windows of so many words that occur twice or more in words.

    Equal windows stand side by side once (hash, place) pairs are sorted; their places, sorted again, are swept once. Nothing is
    done but hashing where no hash repeats.
    """
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width)))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = F.flatten(
            F.transform(
                F.array(pairs),
                lambda p: F.array_sort(
                    F.transform(
                        F.filter(p, lambda x, i: ((i > 0) & (F.get(p, i - 1)["h"] == x["h"])) | (F.get(p, i + 1)["h"] == x["h"])),
                        lambda x: x["i"],
                    )
                ),
            )
        )
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("at"))
        return F.aggregate(twice, zero, lambda s, i: F.struct((s["n"] + F.least(F.lit(width), i - s["at"])).cast("long").alias("n"), i.alias("at")), lambda s: s["n"])

    some = F.transform(F.array(hashes), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) <= width, F.lit(0).cast("long")).otherwise(F.get(some, F.lit(0)))


def normalised(line: Column) -> Column:
    """A line as it is compared over documents: lower case, single blanks, no blanks at either end."""
    return F.trim(F.regexp_replace(F.lower(line), BETWEEN, " "))


def judge(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    max_share: float = 0.2,
    min_holders: int = 10,
    max_lost: float = 0.5,
    min_words: int = 20,
    small_rows: int = 50_000,
) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_words and kept.

    A line is boilerplate of a host if at least min_holders of its distinct texts hold it and more than max_share of them do, so a
    host has no more such lines than 1 / max_share times the mean number of lines of its texts. The table of them is
    broadcast where it has small_rows rows at most, and joined by a shuffle, whose skewed parts Spark splits, where it has more.
    """
    blank = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(blank, "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")
    docs = docs.withColumns({"__host": F.col(host), "__copy": F.xxhash64(blank, F.lit(7))})
    keyed = F.transform(lines, lambda x: F.xxhash64(normalised(x)))
    held = docs.select("__host", "__copy", F.explode(F.array_distinct(keyed)).alias("__line"))
    holders = held.groupBy("__host", "__line").agg(F.count_distinct("__copy").alias("__n")).where(F.col("__n") >= min_holders)
    texts = docs.groupBy("__host").agg(F.count_distinct("__copy").alias("__all"))
    common = (
        holders.join(texts, holders["__host"].eqNullSafe(texts["__host"]))
        .where(F.col("__n") > max_share * F.col("__all"))
        .select(holders["__host"].alias("__at"), "__line")
        .groupBy("__at")
        .agg(F.collect_set("__line").alias("__common"))
    )
    common = common.persist()
    if common.count() <= small_rows:
        common = F.broadcast(common)
    words = word_array(blank)
    base = docs.withColumn("__words", words).withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.translate(blank, BLANKS, "")).cast("long"),
            "n_symbols": (F.length(blank) - F.length(F.translate(blank, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": repeated_words(F.col("__words")),
        }
    )
    base = base.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    joined = base.join(common, F.col("__host").eqNullSafe(F.col("__at")), "left")
    gone = F.filter(lines, lambda x: F.array_contains(F.col("__common"), F.xxhash64(normalised(x))))
    lost = F.aggregate(gone, F.lit(0).cast("long"), lambda n, x: n + F.size(word_array(x)))
    return (
        joined.withColumn("lost_words", F.when(F.col("__common").isNull(), 0).otherwise(lost).cast("long"))
        .withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") <= max_lost * F.col("n_words")) & (F.col("n_words") - F.col("lost_words") >= min_words))
        .drop("__host", "__copy", "__words", "__at", "__common")
    )


def op6(spark, sf_dir: str) -> DataFrame:
    """The verdict for each row of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_words", "kept")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) > 0) AS ls
  FROM d
), grams AS (
  SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1
), swept AS (
  SELECT r, sum(least(8, i - before)) AS n FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -100) AS before FROM twice) GROUP BY r
), base AS (
  SELECT w.r, doc_id, source, t, ls, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(s.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN swept s ON s.r = w.r
), lines AS (
  SELECT r, source, t, x, trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS k FROM (SELECT r, source, t, unnest(ls) AS x FROM base)
), common AS (
  SELECT l.source, l.k FROM (SELECT source, k, count(DISTINCT t) AS n FROM lines GROUP BY source, k) l
  JOIN (SELECT source, count(DISTINCT t) AS m FROM base GROUP BY source) s ON s.source IS NOT DISTINCT FROM l.source
  WHERE n >= 10 AND n > 0.2 * m
), lost AS (
  SELECT r, sum(len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) AS n
  FROM lines JOIN common ON common.source IS NOT DISTINCT FROM lines.source AND common.k = lines.k GROUP BY r
), judged AS (
  SELECT base.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, coalesce(lost.n, 0)::BIGINT AS lost_words
  FROM base LEFT JOIN lost ON lost.r = base.r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_words,
       NOT base_failed AND lost_words <= 0.5 * n_words AND n_words - lost_words >= 20 AS kept
FROM judged
"""
