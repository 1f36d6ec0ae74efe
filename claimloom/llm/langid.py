"""Language identification by words first, with backoff to shorter and shorter character n-grams.

Learning counts, with Spark, the words of labelled documents by language and the character n-grams of those words. Each
language keeps its own `n_words` most frequent words and `n_grams` most frequent n-grams of each length, so one with few
documents keeps its share (None keeps all that the sample has); a key that any language keeps has a log frequency in
each. A known word scores by them. An
unseen word is scored by its n-grams of the greatest length; each one that is unknown falls back to the mean of the two
next shorter ones inside it, down to single letters; what is unknown at every length does not count. A run of more than
64 letters, as texts without spaces have, is no word: all its n-grams count, and it weighs as much as its length over 64
words. The model is bounded by its parameters, so small enough to broadcast; at most about `sample` documents of each
language, chosen by a hash of doc_id, are learned from.

Prediction looks words and n-grams up in sorted tables of hashes, for a slice of texts at a time: no word is remembered
from slice to slice, and a slice is bounded by its bytes.

Defined cases: a null text or one without a letter is `und` with score 0; ties go to the first language in order of
name; without any labelled document every text is `und`; rows are kept one for one, also repeated ones and null doc_ids
(never held out). Documents with a null lang are not learned from. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import discard, materialize, run_hashes, slices, texts

UNKNOWN = "und"
FLOOR = 1e-7
#: Letters of the longest word; longer runs are scored by their n-grams alone.
LONGEST = 64
#: Places whose n-grams are scored at once.
PLACES = 1 << 17
#: What a word's n-grams together weigh against a known word's frequency.
WEIGHT = 0.5


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class Table:
    """Values by key: hashes of the keys, sorted, and a row of log frequencies for each."""

    def __init__(self, keys: list[str], values: np.ndarray):
        lengths = np.fromiter(map(len, keys), np.int64, len(keys))
        hi = np.cumsum(lengths)
        hashes = run_hashes(code_points("".join(keys)), hi - lengths, hi)
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], np.ascontiguousarray(values[order], np.float32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, -1 if it has none."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


@dataclass
class Model:
    languages: list[str]
    words: Table
    grams: list[Table]  # by length, from 1

    @classmethod
    def of(cls, languages: list[str], words: dict, grams: list[dict]) -> Model:
        """From log frequencies by key, a number for each language."""
        table = lambda d: Table(list(d), np.array(list(d.values()), np.float32).reshape(len(d), len(languages)))
        return cls(languages, table(words), [table(g) for g in grams])

    def backoff(self, points: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """A score in each language for the runs of letters from lo to hi, by their n-grams with < and > around them."""
        lengths = hi - lo + 2
        end = np.cumsum(lengths)
        start = end - lengths
        word = np.repeat(np.arange(len(lo)), lengths)
        inside = np.arange(len(word)) - start[word]
        padded = points[np.clip(lo[word] + inside - 1, 0, len(points) - 1)]
        padded[start], padded[end - 1] = ord("<"), ord(">")
        left = end[word] - np.arange(len(word))  # places from here to the end of the word
        top = np.minimum(lengths, len(self.grams))[word]
        total, count = np.zeros((len(lo), len(self.languages))), np.zeros(len(lo))
        for at in range(0, len(word), PLACES):
            some = slice(at, at + PLACES + len(self.grams))
            own = len(word[at : at + PLACES])
            score, known = self._places(padded[some], left[some], top[some])
            who, known = word[at : at + own], known[:own]
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(who, score[:own, k] * known, len(lo))
            count += np.bincount(who, known, len(lo))
        return total / np.maximum(count, 1)[:, None] * WEIGHT

    def _places(self, points: np.ndarray, left: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place the score of the n-gram of length top that starts there, and whether it has one."""
        n, places = len(points), np.arange(len(points))
        needed, rows = [np.zeros(n + 1, bool) for _ in self.grams], []
        for length in range(len(self.grams), 0, -1):
            wanted = needed[length - 1]
            wanted[:n] |= (top == length) & (left >= length)
            at = places[wanted[:n]]
            at = at[at + length <= n]
            row = self.grams[length - 1].find(run_hashes(points, at, at + length))
            rows.append((length, at, row))
            if length > 1:
                needed[length - 2][at[row < 0]] = needed[length - 2][at[row < 0] + 1] = True
        below, has = np.zeros((n + 1, len(self.languages)), np.float32), np.zeros(n + 1, np.float32)
        out, known = np.zeros((n, len(self.languages)), np.float32), np.zeros(n, np.float32)
        for length, at, row in reversed(rows):
            both = has[at] + has[at + 1]
            score = (below[at] + below[at + 1]) / np.maximum(both, 1)[:, None]
            score[row >= 0] = self.grams[length - 1].values[row[row >= 0]]
            below, has = np.zeros_like(below), np.zeros_like(has)
            has[at] = (row >= 0) | (both > 0)
            below[at] = score * has[at][:, None]
            is_top = top[at] == length
            out[at[is_top]], known[at[is_top]] = below[at[is_top]], has[at[is_top]]
        return out, known

    def shares(self, found: list[str | None]) -> np.ndarray:
        """For each text the posterior of each language by the mean of its words, sharpened by up to 20 words; zeros without a letter."""
        points = code_points("\n".join((t or "").lower() for t in found) + "\n")
        ends = np.cumsum(np.fromiter((len((t or "").lower()) + 1 for t in found), np.int64, len(found)))
        edge = np.diff(letters()[points].astype(np.int8), prepend=np.int8(0))
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        out = np.zeros((len(found), len(self.languages)))
        if not len(lo) or not self.languages:
            return out
        hashes, first, inverse = np.unique(run_hashes(points, lo, hi), return_index=True, return_inverse=True)
        lo_each, hi_each = lo[first], hi[first]
        row = np.where(hi_each - lo_each <= LONGEST, self.words.find(hashes), -1)
        score = np.zeros((len(hashes), len(self.languages)))
        score[row >= 0] = self.words.values[row[row >= 0]]
        unseen = np.flatnonzero(row < 0)
        if len(unseen):
            score[unseen] = self.backoff(points, lo_each[unseen], hi_each[unseen])
        weight = np.maximum(1.0, (hi - lo) / LONGEST)
        text = np.searchsorted(ends, lo, "right")
        heavy = np.bincount(text, weight, len(found))
        sums = np.stack([np.bincount(text, score[inverse, k] * weight, len(found)) for k in range(len(self.languages))], 1)
        some = heavy > 0
        mean = sums[some] / heavy[some, None] * np.minimum(heavy[some], 20)[:, None]
        share = np.exp(mean - mean.max(1, keepdims=True))
        out[some] = share / share.sum(1, keepdims=True)
        return out


def learned_from(doc_id: Column) -> Column:
    """Whether a document may be learned from: crc32 of its id as text, modulo 4, is not 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) != 2, F.lit(True))


def counts(labelled: DataFrame, longest: int = 4) -> DataFrame:
    """length (0: words), key, lang, n: words of texts in (text, lang) and their n-grams."""
    word = F.explode(F.expr(r"regexp_extract_all(lower(text), '\\p{L}+', 0)")).alias("word")
    words = materialize(labelled.select("lang", word).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "language-words")
    # a run in pieces, each with the letters after it that its last n-grams need, so that each n-gram is in one piece
    chunks = F.expr(f"regexp_extract_all(concat('<', word, '>'), '(?s).{{1,{LONGEST}}}', 0)")
    pieces = words.select("lang", "n", chunks.alias("chunks")).select(
        "lang", "n", F.explode(F.transform("chunks", lambda c, i: F.struct(c.alias("at"), F.coalesce(F.get(F.col("chunks"), i + 1), F.lit("")).alias("next")))).alias("c"),
        F.sequence(F.lit(1), F.lit(longest)).alias("lengths")).select("lang", "n", "c", F.explode("lengths").alias("length"))
    runs = pieces.select("lang", "n", "length", F.concat("c.at", F.expr("substring(c.next, 1, length - 1)")).alias("run")).where(F.length("run") >= F.col("length"))
    starts = F.sequence(F.lit(1), F.length("run") - F.col("length") + 1)
    grams = runs.select("length", "lang", "n", F.explode(F.transform(starts, _run_at)).alias("key")).groupBy("length", "key", "lang").agg(F.sum("n").alias("n"))
    return words.where(F.length("word") <= LONGEST).select(F.lit(0).alias("length"), F.col("word").alias("key"), "lang", "n").unionByName(grams)


def _run_at(start: Column) -> Column:
    return F.substring(F.col("run"), start, F.col("length"))


def learn(docs: DataFrame, sample: int = 4000, n_words: int | None = 10_000, n_grams: int | None = 10_000, longest: int = 4) -> Model:
    """docs: labelled documents (doc_id, text, lang). Only the bounded tables of the model reach the driver."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    sizes = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model.of([], {}, [{} for _ in range(longest)])
    chance = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n))])
    drawn = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000)) < chance[F.col("lang")] * 1_000_000)
    every = materialize(counts(drawn, longest), "language-counts")
    totals = {(r.length, r.lang): r.n for r in every.groupBy("length", "lang").agg(F.sum("n").alias("n")).collect()}
    rank = F.row_number().over(Window.partitionBy("length", "lang").orderBy(F.desc("n"), "key"))
    if n_words is not None or n_grams is not None:
        most = F.when(F.col("length") == 0, F.lit(n_words).cast("long")).otherwise(F.lit(n_grams).cast("long"))
        best = every.withColumn("rank", rank).where(most.isNull() | (F.col("rank") <= most)).select("length", "key").distinct()
        kept = every.join(best, ["length", "key"], "left_semi")
    else:
        kept = every
    found = kept.select("length", "key", "lang", "n").toArrow()
    discard(every)
    place = {k: i for i, k in enumerate(languages)}
    lengths, keys, langs, n = (found[c] for c in ("length", "key", "lang", "n"))
    lengths, n, at = lengths.to_numpy(), n.to_numpy(), np.array([place[x] for x in langs.to_pylist()], np.int64)
    tables = []
    for length in range(longest + 1):
        own = np.flatnonzero(lengths == length)
        index = keys.take(pa.array(own)).combine_chunks().dictionary_encode() if len(own) else pa.array([], pa.string()).dictionary_encode()
        values = np.zeros((len(index.dictionary), len(languages)))
        values[index.indices.to_numpy(), at[own]] = n[own]
        whole = np.array([max(totals.get((length, x), 1), 1) for x in languages])
        tables.append(Table(index.dictionary.to_pylist(), np.log(values / whole + FLOOR)))
    return Model(languages, tables[0], tables[1:])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text_key (a hash of the text), lang_pred, score: the posterior of the chosen language."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator) -> Iterator[pa.RecordBatch]:
        names = np.array([*sent.value.languages, UNKNOWN], object)
        for batch in batches:
            for part in slices(batch, "text"):
                share = sent.value.shares(part["text"].to_pylist())
                sure = share.max(1, initial=0.0)
                best = np.where(sure > 0, share.argmax(1) if share.shape[1] else 0, len(names) - 1)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["text_key"], pa.array(names[best], pa.string()), pa.array(sure)], ["doc_id", "text_key", "lang_pred", "score"])

    keyed = texts(docs).withColumn("text_key", F.xxhash64("text"))
    return keyed.mapInArrow(label, "doc_id long, text_key long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, predict all: doc_id, held_out, lang_pred, score."""
    model = learn(docs.where(learned_from(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", (~learned_from(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text has a language with at least that score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def passes(batches: Iterator) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sure = sent.value.shares(part["text"].to_pylist()).max(1, initial=0.0)
                yield part.filter(pa.array((sure > 0) & (sure >= least), pa.bool_()))

    return docs.mapInArrow(passes, docs.schema)
