"""Removal of repeated passages by seed and extend.

Seeds: every run of `window` words holds a winnowed anchor, the least of its hashed `gram`-word runs (the leftmost of
equal ones), so two equal windows have the same anchor at the same place. Each anchor owns the consecutive windows of
which it is the least. Documents are joined on anchors. Extension goes both ways over the words that an anchor's windows
span: anchors with the same whole span are copies of each other, settled by the least doc_id; the first of each span
that meets other spans at its anchor is extended word by word, which is to say window by window on either side, and the
windows that a smaller document also holds are joined to maximal repeats. Their words are removed.

All comparisons group by content hashes of 128 bits with a minimum for each group: no pairs are made, whatever the size
of a group, and no group is gathered.

Defined cases: a null text has no word; under `window` words nothing is removed; rows of the same doc_id never remove
each other's words, whatever their texts; a null doc_id counts as greater than all others. An empty table gives an empty
table. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import MAX_ID, WordHashes, discard, materialize, mix, rolling, rows, texts

BASE_1, BASE_2 = 0x9E3779B97F4A7C55, 0xC2B2AE3D27D4EB4F
ANCHORS = "order_id long, text_key long, anchor long, span_1 long, span_2 long, lo int, hi int"
WINDOWS = "order_id long, text_key long, at int, w_1 long, w_2 long"


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value in each run of `width`, the leftmost of equal ones: running minima from block starts and block ends."""
    n = len(values)
    packed = (values & ~np.uint64(0xFFFFFFFF)) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    padded[:n] = packed
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    starts = np.arange(n - width + 1)
    return (np.minimum(behind[starts], ahead[starts + width - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def sums(words: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of words weighted by powers of an odd base, and the inverse powers: any run's hash in two steps."""
    n, b, inverse = len(words), base, pow(base, -1, 2**64)
    powers, back = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)
    if n:
        powers[1:], back[1:] = np.uint64(b), np.uint64(inverse)
        powers, back = np.multiply.accumulate(powers), np.multiply.accumulate(back)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers[:n], dtype=np.uint64)]), back


def run_hash(prefix: tuple[np.ndarray, np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    total, back = prefix
    return mix((total[hi] - total[lo]) * back[lo] + (hi - lo).astype(np.uint64))


def signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64), pa.int64())


def _keyed(docs: DataFrame) -> DataFrame:
    return texts(docs).select("doc_id", F.coalesce("doc_id", F.lit(MAX_ID)).alias("order_id"), F.xxhash64("text").alias("text_key"), "text")


def anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """A row for each anchor: the starts lo..hi of its windows, the anchor's hash and that of the words they span."""

    def find(batches: Iterator) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = []
                for order_id, text_key, text in zip(part["order_id"].to_pylist(), part["text_key"].to_pylist(), part["text"].to_pylist(), strict=True):
                    words = hashes.of(text.encode().split())
                    if len(words) < window:
                        continue
                    grams = rolling(words, gram, BASE_1)
                    chosen = sliding_least(grams, window - gram + 1)
                    lo = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
                    hi = np.append(lo[1:], len(chosen)) - 1
                    end = hi + window
                    shift = (chosen[lo] - lo).astype(np.uint64)  # the anchor's place in its span
                    span_1, span_2 = (mix(run_hash(sums(x, b), lo, end) + shift) for x, b in ((words, BASE_1), (mix(words), BASE_2)))
                    out.append((np.full(len(lo), order_id), np.full(len(lo), text_key), grams[chosen[lo]], span_1, span_2, lo, hi))
                if out:
                    a = [np.concatenate(c) for c in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(a[0]), pa.array(a[1]), signed(a[2]), signed(a[3]), signed(a[4]), pa.array(a[5].astype(np.int32)), pa.array(a[6].astype(np.int32))], ["order_id", "text_key", "anchor", "span_1", "span_2", "lo", "hi"])

    return _keyed(docs).select("order_id", "text_key", "text").mapInArrow(find, ANCHORS)


def repeats(docs: DataFrame, window: int = 50, gram: int = 20) -> DataFrame:
    """order_id, text_key, lo, hi: starts of windows that a document with a smaller id holds too."""
    found = materialize(anchors(docs, window, gram), "anchors")
    spans = found.groupBy("anchor", "span_1", "span_2").agg(F.min("order_id").alias("first"), F.max("order_id").alias("last"))
    spans = materialize(spans, "spans")
    # anchors that stand in two documents at least, and in two spans
    many = spans.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("least"), F.max("last").alias("most")).where("least < most")
    copied = spans.where("first < last").select("anchor", "span_1", "span_2", "first")
    span = ["anchor", "span_1", "span_2"]
    whole = found.join(copied, span).where(F.col("order_id") > F.col("first")).select("order_id", "text_key", "lo", "hi")
    whole = materialize(whole, "repeats-whole")
    # the first document of each span that meets others; its windows need a look one by one
    meeting = spans.join(many.where("n > 1").select("anchor"), "anchor", "left_semi").select(*span, "first")
    apart = found.join(meeting, span).where(F.col("order_id") == F.col("first")).select("order_id", "text_key", "lo", "hi")
    apart = materialize(apart.groupBy("order_id", "text_key").agg(F.collect_set(F.struct("lo", "hi")).alias("owned")), "repeats-apart")
    discard(found)
    discard(spans)

    def windows(batches: Iterator) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for order_id, text_key, text, owned in rows(batches):
            words = hashes.of(text.encode().split())
            at = np.unique(np.concatenate([np.arange(o["lo"], o["hi"] + 1) for o in owned]))
            w_1, w_2 = (run_hash(sums(x, b), at, at + window) for x, b in ((words, BASE_1), (mix(words), BASE_2)))
            n = len(at)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, order_id)), pa.array(np.full(n, text_key)), pa.array(at.astype(np.int32)), signed(w_1), signed(w_2)], ["order_id", "text_key", "at", "w_1", "w_2"])

    content = _keyed(docs).select("order_id", "text_key", "text").join(apart, ["order_id", "text_key"])
    each = materialize(content.dropDuplicates(["order_id", "text_key"]).mapInArrow(windows, WINDOWS), "windows")
    shared = each.groupBy("w_1", "w_2").agg(F.min("order_id").alias("first"), F.max("order_id").alias("last")).where("first < last").select("w_1", "w_2", "first")
    single = each.join(shared, ["w_1", "w_2"]).where(F.col("order_id") > F.col("first")).select("order_id", "text_key", F.col("at").alias("lo"), F.col("at").alias("hi"))
    single = materialize(single, "repeats-single")
    discard(each)
    return whole.unionByName(single)


def remove_repeats(docs: DataFrame, window: int = 50, gram: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept text of each row are derived from the spans of repeats()."""
    spans = repeats(docs, window, gram).groupBy("order_id", "text_key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    joined = _keyed(docs).join(spans, ["order_id", "text_key"], "left").select("doc_id", "text", "spans")

    def remove(batches: Iterator) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], []]
            for text, spans in zip(batch["text"], batch["spans"], strict=True):
                words, n = text.as_py().encode().split(), 0
                if spans.is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for s in spans.as_py():
                        edge[s["lo"]] += 1
                        edge[s["hi"] + window] -= 1
                    gone = np.cumsum(edge[:-1]) > 0
                    n, total = int(gone.sum()), len(words)
                    kept = [w for w, g in zip(words, gone, strict=True) if not g]
                else:
                    kept, total = words, len(words)
                for column, value in zip(out, (total, n, hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined.mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string")
