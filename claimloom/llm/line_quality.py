"""Quality rules with cross-document line frequency, in DataFrame functions alone.

Base rules count words, characters, symbols, repeated lines and repeated five-word windows in each text. The corpus rule
hashes the normalised lines, counts the distinct documents of each host that hold a line, removes lines above the limits
and rejects documents of which too few words remain. Only hashes and counts of lines are shuffled, never texts.

Defined cases: a null text has no word and fails the base rules; rows of the same doc_id and text are the same row to the
line counts but each is returned; a null host is a host of its own, as is a null doc_id a document; ties do not arise. An
empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import materialize

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 5


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+", -1), lambda w: w != "")


def n_repeat_words(words: Column) -> Column:
    """How many words lie in a five-word window that the text holds twice or more.

    Windows are hashed and sorted with their place; equal neighbours are repeats. Their places, sorted, cover a word each
    and up to four more, fewer where the next one begins sooner.
    """

    def places(hashed: Column) -> Column:
        same = lambda a, b: F.get(hashed, a)["h"] == F.get(hashed, b)["h"]
        repeated = F.filter(F.transform(hashed, lambda x, i: F.when(F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)), x["at"])), lambda p: p.isNotNull())
        return F.array_sort(repeated)

    def covered(at: Column) -> Column:
        return F.aggregate(
            at, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")), lambda acc: acc["n"].cast("long"))

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
        hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i + 1, WINDOW)))

        def count(h: Column) -> Column:
            pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(let(pairs, places), covered))

        return F.when(F.size(w) <= WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, count))

    return let(words, of)


def base_rules(docs: DataFrame) -> DataFrame:
    """doc_id, host, text_key and the counts of each row's text; computed where the text stands."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.regexp_replace(text, f"{SPACE}+", "")
    lines = let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    counted = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("host"), F.xxhash64(text).alias("text_key"),
        F.size(words_of(text)).cast("long").alias("n_words"), F.char_length(bare).cast("long").alias("word_chars"),
        (F.char_length(bare) - F.char_length(F.regexp_replace(bare, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        lines.cast("long").alias("n_dup_lines"), n_repeat_words(words_of(text)).alias("n_repeat_words"))
    return counted.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def host_lines(docs: DataFrame) -> DataFrame:
    """host, line, doc_id, text_key, words: a row for each distinct normalised line of a text, with its words over all its copies there.

    Normalised: outer white space gone, inner runs one space, lower case, digits as 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    normal = lambda x: F.regexp_replace(F.regexp_replace(F.lower(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))), f"{SPACE}+", " "), "[0-9]+", "0")
    exploded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("host"), F.xxhash64(text).alias("text_key"), F.posexplode(F.split(text, "\n", -1)).alias("at", "raw"))
    lines = exploded.where(F.col("raw").rlike(r"[^\x20\x09-\x0D]")).withColumn("normal", normal(F.col("raw")))
    one = lines.select("doc_id", "host", "text_key", "at", F.xxhash64("normal").alias("line"), (F.regexp_count("normal", F.lit(" ")) + 1).alias("words"))
    once = one.groupBy("host", "line", "doc_id", "text_key", "at").agg(F.max("words").alias("words"))  # repeated rows count once
    return once.groupBy("host", "line", "doc_id", "text_key").agg(F.sum("words").alias("words"))


def quality(docs: DataFrame, most_docs: int = 10, most_share: float = 0.005, least_left: float = 0.5, least_words: int = 10) -> DataFrame:
    """The base counts of each row and kept: not base_failed, and enough words left without the host's frequent lines.

    A line is above the limits if more than `most_docs` documents of its host hold it and more than `most_share` of the
    host's documents do. A document is depleted if under `least_left` of its words or under `least_words` words remain.
    """
    base = materialize(base_rules(docs), "quality-base")
    lines = materialize(host_lines(docs), "quality-lines")
    sizes = base.select("host", "doc_id").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    held = lines.select("host", "line", "doc_id").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > most_docs)
    host = lambda a, b: a["host"].eqNullSafe(b["host"])
    above = held.join(sizes.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of"))).where(F.col("held") > most_share * F.col("docs")).select("host", "line")
    above = materialize(above, "quality-above")
    removed = lines.join(above, (lines["line"] == above["line"]) & host(lines, above), "left_semi").groupBy("doc_id", "text_key").agg(F.sum("words").alias("lost"))
    removed = removed.select(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key"), "lost")
    joined = base.join(removed, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key")), "left")
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    depleted = (left < least_left * F.col("n_words")) | (left < least_words)
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~depleted).alias("kept"), F.coalesce("lost", F.lit(0)).cast("long").alias("n_frequent_line_words"))
