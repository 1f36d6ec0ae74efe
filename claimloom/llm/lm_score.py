"""Stupid-backoff language-model scores, held out: every document by the n-gram counts of all the others.

The score of a word is count(n-gram) / count(its context) for the longest n-gram that the rest of the corpus holds, times
`alpha` for each order given up; a single word scores count / number of words, and as one occurrence if no other document
holds it. A document's score is the sum of the words' logarithms. Counts are those of the whole corpus less the document's
own (`leave_out`); with leave_out=False they include it, and then no n-gram of the corpus backs off.

Documents are dealt by hash to blocks of about `block_bytes` of text. A block sends each n-gram that it has once, with its
occurrences there (rows equal in doc_id and text lie in one block): sorted hashes, cut at the bounds of buckets, which are ranges of the hash space. A bucket adds up what
all blocks send it and answers each block with the counts of its n-grams, in the block's order. Blocks then meet their
answers in a cogroup, take each document's own occurrences off and add up its words. Rows of both shuffles are arrays: an
n-gram costs its hash and a number, not a row. The most common word is one entry for each block, and buckets are as many
as keep each near `bucket_grams` entries, so no task grows with the corpus.

The corpus is done in `passes`, each over all documents and one part of the hash space: scratch space falls with their
number and texts are read as often, results are the same. Words are 64-bit hashes of their bytes, between ASCII white space.

score_by_rows() is the same in Spark's own rows, one for each distinct n-gram of a text, and checks score() in a test. There a
score telescopes: if others hold an n-gram they hold its parts, so each n-gram found replaces the shorter one that ends with
it, which gives, for every occurrence,
    log count(whole) - log count(without its last word) - log count(without its first) + log count(without both),
where the count of no word at all is the number of words. A row therefore adds its occurrences to its own n-gram, takes
them from its two parts and gives them to its middle; rows know these by their first places in the text. Added up by text
and n-gram these are the weights of the n-grams' logarithms, and added up by text the score.

Defined cases: a null text has no word; a text without words has n_words 0 and scores 0.0; repeated rows, also of the
same doc_id, count and are scored each; a null doc_id is kept. An empty table gives an empty table. Other columns are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import MAX_ID, discard, materialize, mix, rolling, slices, texts, word_hashes

BASE = 0x9E3779B97F4A7C55
KEY = ["order_id", "text_key"]
GRAMS = "order_id long, text_key long, gram long, at int, own int, head int, tail int, middle int"
#: What a block sends to a bucket, and gets back; words: those of the block, told in its first row.
SENT = "bucket long, block long, words long, hashes binary, counts binary"
ANSWERED = "bucket long, block long, words long, counts binary"
SCORED = "doc_id long, n_words long, log_score double, mean_log_score double"
WORD = r"[^\x20\x09-\x0D]+"


def _keyed(docs: DataFrame) -> DataFrame:
    return texts(docs).select("doc_id", F.coalesce("doc_id", F.lit(MAX_ID)).alias("order_id"), F.xxhash64("text").alias("text_key"), "text")


def first_places(gram: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each n-gram within its text's, and the first place of each number. text: that of each place."""
    number, kinds = pd.factorize(mix(gram + mix(text.astype(np.uint64))))
    first = np.empty(len(kinds), np.int64)
    first[number[::-1]] = np.arange(len(number) - 1, -1, -1)  # the first place is written last
    return number, first


def grams(docs: DataFrame, order: int, part: int = 0, parts: int = 1) -> DataFrame:
    """The distinct n-grams of each text up to the order, in one part of the hash space; own is how often the text has it.

    at tells an n-gram by its first place and order, as place * order + (n - 1). head, tail and middle tell in the same way
    those without the last word, without the first and without both, or are -1 where no word is left.
    """

    def explode(batches: Iterator) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                words, text = word_hashes(some["text"].to_pylist())
                start = np.searchsorted(text, np.arange(some.num_rows))
                out, known = [], []

                def code(n: int, place: np.ndarray, of: np.ndarray, known: list = known, start: np.ndarray = start) -> np.ndarray:
                    if n < 1:
                        return np.full(len(place), -1)
                    return (known[n - 1][place] - start[of]) * order + n - 1

                for n in range(1, order + 1):
                    gram = rolling(words, n, BASE + n - 1)
                    where = np.flatnonzero((text[: len(gram)] == text[n - 1 :]) & ((gram >> np.uint64(33)) % np.uint64(parts) == np.uint64(part)))
                    number, first = first_places(gram[where], text[where])
                    place = where[first]  # in the part, the first of its kind is the first of all
                    of = text[place]
                    out.append((of, gram[place], (place - start[of]) * order + n - 1, np.bincount(number, minlength=len(first)), code(n - 1, place, of), code(n - 1, place + 1, of), code(n - 2, place + 1, of)))
                    if n < order:
                        number, first = first_places(gram, text[: len(gram)])
                        known.append(first[number])
                of, gram, *numbers = (np.concatenate(c) for c in zip(*out, strict=True))
                keys = [pa.array(some[k].to_numpy()[of]) for k in KEY]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(gram.view(np.int64)), *(pa.array(c.astype(np.int32)) for c in numbers)], [f.split()[0] for f in GRAMS.split(", ")])

    return _keyed(docs).select(*KEY, "text").mapInArrow(explode, GRAMS)


def counted(docs: DataFrame, order: int, leave_out: bool, part: int, parts: int) -> DataFrame:
    """The rows of grams() that the corpus (less the text) holds, and how often: times in place of gram."""
    # one shuffle, read twice: the count table's columns and filters are those of the rows, so that Spark finds it is the same
    rows = grams(docs, order, part, parts).where("gram is not null and own is not null").repartition("gram")
    used = [F.count(c) for c in (*KEY, "at", "head", "tail", "middle")]
    table = rows.groupBy("gram").agg(F.sum("own").alias("times"), F.least(*used).alias("texts"))
    # a gram of one text alone has nothing to tell it
    table = table.where(f"texts >= {2 if leave_out else 1}").select("gram", "times")
    found = rows.join(table, "gram").withColumn("times", F.col("times") - (F.col("own") if leave_out else 0))
    return found.where("times > 0").select(*KEY, "at", "own", "times", "head", "tail", "middle")


def summed(found: DataFrame, order: int) -> DataFrame:
    """For each text: log_sum, the weighted logarithms of its n-grams' counts; twos and longer, its occurrences of found n-grams of two words, and of each further word.

    Rows of texts that occur several times under one doc_id come several times, and count once.
    """
    n, none = F.pmod("at", F.lit(order)) + 1, F.lit(0)
    own, null = F.col("own").cast("long"), F.lit(None).cast("long")
    whole = F.struct(F.col("at").alias("at"), own.alias("weight"), F.col("times").cast("long").alias("times"), F.lit(1).alias("rows"), F.when(n == 2, own).otherwise(none).alias("twos"), F.when(n >= 2, own).otherwise(none).alias("longer"))
    parts = [F.struct(F.col(c).alias("at"), w.alias("weight"), null.alias("times"), none.alias("rows"), none.cast("long").alias("twos"), none.cast("long").alias("longer")) for c, w in (("head", -own), ("tail", -own), ("middle", own))]
    sent = found.repartition(*KEY).select(*KEY, F.inline(F.array(whole, *parts))).where("at >= 0")
    each = sent.groupBy(*KEY, "at").agg(F.sum("weight").alias("weight"), F.max("times").alias("times"), F.sum("rows").alias("rows"), F.sum("twos").alias("twos"), F.sum("longer").alias("longer"))
    # without rows: a part of an n-gram found by mistake, as another's hash is the same; it counts as one occurrence
    return each.where("rows > 0").groupBy(*KEY).agg(
        F.sum(F.col("weight") / F.col("rows") * F.log("times")).alias("log_sum"), F.sum(F.col("twos") / F.col("rows")).alias("twos"), F.sum(F.col("longer") / F.col("rows")).alias("longer"))


def score_by_rows(docs: DataFrame, order: int = 3, alpha: float = 0.4, leave_out: bool = True, passes: int = 8) -> DataFrame:
    """As score(), by rows; it needs several times the time and space."""
    lengths = materialize(_keyed(docs).select("doc_id", *KEY, F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words")), "lm-lengths")
    total = lengths.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    found = [materialize(counted(docs, order, leave_out, i, passes).withColumn("slice", F.pmod("text_key", F.lit(passes)).cast("int")), f"lm-counts-{i}", "slice") for i in range(passes)]
    told = found[0]
    for more in found[1:]:
        told = told.unionByName(more)
    sums = [materialize(summed(told.where(F.col("slice") == i), order), f"lm-sums-{i}") for i in range(passes)]
    for table in found:
        discard(table)
    by_text = sums[0]
    for more in sums[1:]:
        by_text = by_text.unionByName(more)

    rows = lengths.join(by_text, KEY, "left").fillna(0.0, ["log_sum", "twos", "longer"])
    words = F.col("n_words")
    near = F.least(words, F.lit(order - 1))  # words with fewer than order - 1 before them
    given_up = near * (near + 1) / 2 + order * (words - near) - words - F.col("longer")
    others = F.greatest(F.lit(total) - (words if leave_out else F.lit(0)), F.lit(1))
    log_score = F.col("log_sum") - (words - F.col("twos")) * F.log(others) + F.lit(math.log(alpha)) * given_up
    return rows.select("doc_id", "n_words", log_score.alias("log_score")).withColumn("mean_log_score", F.col("log_score") / F.greatest("n_words", F.lit(1)))


def packed(numbers: np.ndarray) -> bytes:
    """64-bit numbers by bytes of equal weight, so that leading ones, which are alike, compress."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes, kind: type = np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind).ravel()


def block_grams(some: list[str], order: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The text of each word by number, and for each order the first places and hashes of all n-grams."""
    words, text = word_hashes(some)
    out = []
    for n in range(1, order + 1):
        gram = rolling(words, n, BASE + n - 1)
        where = np.flatnonzero(text[: len(gram)] == text[n - 1 :])
        out.append((where, gram[where]))
    return text, out


def answered(dealt: DataFrame, order: int, part: int, parts: int, buckets: int) -> DataFrame:
    """For each block and bucket of one part of the hash space: how often the corpus has each of the block's n-grams, ascending by hash."""
    bounds = np.array([((part * buckets + i) << 64) // (parts * buckets) for i in range(buckets)], np.uint64)
    last = np.uint64((((part + 1) << 64) // parts) - 1)

    def send(block: pa.Table) -> pa.Table:
        text, found = block_grams(block["text"].to_pylist(), order)
        mine = [g[(g >= bounds[0]) & (g <= last)] for _, g in found]
        hashes, counts = np.unique(np.concatenate(mine), return_counts=True)
        cuts = [*np.searchsorted(hashes, bounds), len(hashes)]
        name = block["block"][0].as_py()
        rows = [(part * buckets + i, name, len(text) if part == i == 0 else 0, packed(hashes[a:b]), packed(counts.astype(np.int64)[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a or part == i == 0]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], [f.split()[0] for f in SENT.split(", ")])

    def add(bucket: pa.Table) -> pa.Table:
        hashes = [unpacked(h, np.uint64) for h in bucket["hashes"].to_pylist()]
        counts = np.concatenate([unpacked(c) for c in bucket["counts"].to_pylist()])
        kinds, number = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.zeros(len(kinds), np.int64)
        np.add.at(total, number, counts)
        back = np.split(total[number], np.cumsum([len(h) for h in hashes])[:-1])
        return bucket.drop_columns(["hashes", "counts"]).append_column("counts", pa.array([packed(b) for b in back], pa.binary()))

    return dealt.select("block", "text").groupBy("block").applyInArrow(send, SENT).groupBy("bucket").applyInArrow(add, ANSWERED)


def word_scores(text: np.ndarray, rows: int, found: list[tuple[np.ndarray, np.ndarray]], corpus: np.ndarray, total: int, alpha: float, leave_out: bool) -> tuple[np.ndarray, np.ndarray]:
    """The number of words of each text and the sum of their scores. corpus: counts of the n-grams of found, in ascending order of their hashes."""
    number = np.unique(np.concatenate([g for _, g in found]), return_inverse=True)[1]
    times = corpus[number]
    if leave_out:
        of = np.concatenate([text[where] for where, _ in found])
        _, same, own = np.unique(number * np.int64(max(rows, 1)) + of, return_inverse=True, return_counts=True)
        times = times - own[same]
    n_words = np.bincount(text, minlength=rows)
    start = np.cumsum(n_words) - n_words
    near = np.minimum(np.arange(len(text)) - start[text], len(found) - 1)  # words before it that its score may look at
    others = np.maximum(total - n_words * leave_out, 1)
    score, context, at = np.empty(0), np.empty(0), 0
    for n, (where, _) in enumerate(found):
        mine = times[at : at + len(where)]
        at += len(where)
        # by hash alone a part may be missed; it counts as one occurrence
        log = np.log(np.maximum(mine, 1))
        if n == 0:
            score = log - np.log(others)[text] + math.log(alpha) * near
        else:
            held, end = mine > 0, where + n
            score[end[held]] = (log - context[where] + math.log(alpha) * (near[end] - n))[held]
        context = np.zeros(len(text))
        context[where] = log
    return n_words, np.bincount(text, weights=score, minlength=rows).astype(float)


def score(docs: DataFrame, order: int = 3, alpha: float = 0.4, leave_out: bool = True, passes: int = 4, block_bytes: int = 4 << 20, bucket_grams: int = 1 << 20) -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score of each row."""
    keyed = _keyed(docs)
    size = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = size // block_bytes + 1
    buckets = size * order // 9 // passes // bucket_grams + 1  # a word has about six bytes, and a third of all n-grams are in their block before
    dealt = keyed.select("doc_id", F.pmod(F.xxhash64(*KEY), F.lit(blocks)).alias("block"), "text")
    answers = [materialize(answered(dealt, order, i, passes, buckets), f"lm-counts-{i}") for i in range(passes)]
    told = answers[0]
    for more in answers[1:]:
        told = told.unionByName(more)
    total = told.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]

    def add_up(block: pa.Table, told: pa.Table) -> pa.Table:
        some = block["text"].to_pylist()
        text, found = block_grams(some, order)
        counts = [unpacked(c) for c in told.sort_by("bucket")["counts"].to_pylist()]
        n_words, log_score = word_scores(text, len(some), found, np.concatenate([np.empty(0, np.int64), *counts]), total, alpha, leave_out)
        columns = [block["doc_id"], pa.array(n_words, pa.int64()), pa.array(log_score), pa.array(log_score / np.maximum(n_words, 1))]
        return pa.Table.from_arrays(columns, [f.split()[0] for f in SCORED.split(", ")])

    return dealt.groupBy("block").cogroup(told.select("block", "bucket", "counts").groupBy("block")).applyInArrow(add_up, SCORED)
