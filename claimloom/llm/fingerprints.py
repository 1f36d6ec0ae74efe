"""Order MinHash fingerprints of documents.

Every k-mer of code points is numbered by its occurrence in the text. Each of `sketches` hash functions selects the
`tuple_size` least numbered k-mers; the tuple keeps their order in the text and is hashed to 32 bits. Two fingerprints
agree in a sketch if the same k-mers were selected in the same order, so the share of agreeing sketches (likeness) falls
with edit distance, not only with the k-mers in common.

Defined cases: a null text counts as empty; an empty text has the fingerprint of zeros, like only another empty text; a
text shorter than k is one k-mer; equal texts have equal fingerprints. Of repeated doc_ids every row counts, in order of
text; a null doc_id comes after all others. Other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import GOLDEN, materialize, mix, range_buckets, rows, texts

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
CHUNK = 8192


class OrderMinHash:
    def __init__(self, k: int = 6, tuple_size: int = 2, sketches: int = 32, seed: int = 7):
        draw = np.random.Generator(np.random.PCG64(seed))
        self.k, self.l, self.m = k, tuple_size, sketches
        self.flip = draw.integers(0, 2**64, (sketches, 1), np.uint64)
        self.times = draw.integers(0, 2**63, (sketches, 1), np.uint64) * np.uint64(2) + np.uint64(1)

    def numbered(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the occurrence-numbered k-mers, and where each stands."""
        points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
        k = min(self.k, len(points))
        n = len(points) - k + 1 if k else 0
        if not n:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h = h * GOLDEN + points[j : j + n]
        kmer = mix(h)
        at = np.argsort(kmer, kind="stable")  # equal k-mers in order of place
        kmer = kmer[at]
        index = np.arange(n)
        first = np.where(np.concatenate([[True], kmer[1:] != kmer[:-1]]), index, 0)
        occurrence = (index - np.maximum.accumulate(first)).astype(np.uint64)
        return mix(kmer + occurrence * GOLDEN), at

    def sign(self, text: str) -> np.ndarray:
        """One uint32 for each sketch."""
        ids, at = self.numbered(text)
        if not len(ids):
            return np.zeros(self.m, np.uint32)
        chosen = []
        for lo in range(0, len(ids), CHUNK):
            value = (ids[None, lo : lo + CHUNK] ^ self.flip) * self.times
            size, picks, every = value.shape[1], [], np.arange(self.m)
            for _ in range(min(self.l, size)):
                pick = value.argmin(1)
                picks.append(pick + lo)
                value[every, pick] = np.uint64(2**64 - 1)
            chosen.append(np.stack(picks, 1))
        best = np.concatenate(chosen, 1)
        if best.shape[1] > self.l:
            value = (ids[best] ^ self.flip) * self.times
            best = np.take_along_axis(best, np.argsort(value, 1, kind="stable")[:, : self.l], 1)
        best = np.take_along_axis(best, np.argsort(at[best], 1), 1)
        out = np.zeros(self.m, np.uint64)
        for j in range(best.shape[1]):
            out = mix(out + ids[best[:, j]])
        return (out >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def edited(text: str, following: str) -> str:
    """The last third of the text's code points replaced by as many of the following text's first ones, or all it has."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _compare(batches: Iterator, make: OrderMinHash) -> Iterator[pa.RecordBatch]:
    """Rows in order within each range; the last one of a range is only the text that follows it."""
    out, before = [], None
    for part, extra, doc_id, text in rows(batches):
        sign = make.sign(text)
        if before is not None and before[0] == part:
            _, old_id, old_text, old_sign = before
            changed = edited(old_text, text)
            changed_sign = make.sign(changed)
            out.append((old_id, len(old_text), hashlib.sha256(changed.encode()).hexdigest(), old_sign.astype(">u4").tobytes().hex(), changed_sign.astype(">u4").tobytes().hex(), likeness(old_sign, changed_sign), likeness(old_sign, sign)))
            if len(out) == 1000:
                yield _batch(out)
                out = []
        before = None if extra else (part, doc_id, text, sign)
    yield _batch(out)


def _batch(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [()] * 7
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def edit_likeness(docs: DataFrame, make: OrderMinHash | None = None) -> DataFrame:
    """Each document against its edited text and against the next document in descending order of doc_id.

    Documents are dealt to ranges of doc_id and sorted there: one shuffle of the texts. Each range also gets a copy of the
    first row of the next one (a row for each range, so small enough to broadcast their ids), so no range waits for another.
    """
    make = make or OrderMinHash()
    base = texts(docs).withColumn("order_id", F.coalesce("doc_id", F.lit(-(2**63))))
    dealt = range_buckets(base, "order_id", "part")
    heads = materialize(dealt.groupBy("part").agg(F.max("order_id").alias("order_id")), "fingerprint-heads")
    # each head closes the range before its own in descending order, the first one the last range; a row for each range
    last = Window.orderBy("part")
    closes = heads.select("part", "order_id", F.coalesce(F.lead("part").over(last), F.min("part").over(Window.partitionBy())).alias("closes"))
    first = dealt.join(F.broadcast(closes), ["part", "order_id"]).groupBy("closes").agg(F.min("text").alias("text"), F.first("order_id").alias("order_id"))
    tails = first.select(F.col("closes").alias("part"), F.lit(1).alias("extra"), F.lit(None).cast("long").alias("doc_id"), "text", "order_id")
    ordered = dealt.select("part", F.lit(0).alias("extra"), "doc_id", "text", "order_id").unionByName(tails)
    ordered = ordered.repartition("part").sortWithinPartitions("part", "extra", F.desc("order_id"), "text")
    return ordered.select("part", "extra", "doc_id", "text").mapInArrow(lambda batches: _compare(batches, make), SCHEMA)
