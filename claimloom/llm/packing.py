"""Best-fit packing of token sequences by hierarchical residual packing.

Documents are encoded and cut to pieces where they stand; only the piece table (ids, lengths, checksums) moves on. Pieces
are dealt to groups of bounded size and packed best-fit, longest first. Bins that are full, or too full for the smallest
open bin, are done; the underfull ones become items themselves and meet those of other groups in fewer, again bounded
groups, until one group or no further merge is left. Each round writes which bin went where; a piece's sequence and
offset follow from those rounds.

Where the pieces have a place in an order, such as that of a mix, groups are ranges of places instead of hashes, in every
round, and sequences are numbered from 0 by the least place in them: the order holds up to the size of a group.

Defined cases: a null text counts as empty and an empty document is its end id alone; repeated doc_ids (also null ones)
keep all their rows; an empty table gives an empty table. Of a document longer than the capacity every piece but the
first is full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm import mixing
from claimloom.llm.common import crc, materialize, rows, texts
from claimloom.llm.tokenize import encoder

PIECES = "doc_id long, text_key long, piece int, start long, length long, ids_crc32 long"
GROUP = 20_000
#: Places are counted by ranges of this many.
SPAN = 1024
#: Bins of a group are numbered from group * ROOM on.
ROOM = 1 << 22


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    def cut(batches: Iterator) -> Iterator[pa.RecordBatch]:
        encode, out = encoder(tokenizer), []
        for doc_id, text, text_key in rows(batches):
            ids = np.append(encode.encode(text), np.uint32(end_id))
            at, size = 0, (len(ids) - 1) % capacity + 1
            for number in range(-(-len(ids) // capacity)):
                out.append((doc_id, text_key, number, at, size, crc(ids[at : at + size])))
                at, size = at + size, capacity
            if len(out) >= 4096:
                yield _table(out)
                out = []
        yield _table(out)

    def _table(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 6
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "text_key", "piece", "start", "length", "ids_crc32"])

    return texts(docs).withColumn("text_key", F.xxhash64("text")).mapInArrow(cut, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; longest first, each into the open bin that it fills most.

    Open bins are kept by free room; a bit mask of the rooms in use finds the least that suffices.
    """
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n = 0, 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room, n = n, capacity, n + 1
        bins[i], offsets[i] = b, capacity - room
        if left := room - size:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets


def _numbered(items: DataFrame, key: str) -> DataFrame:
    """items with number, their rank by place and key from 0. Ranges of places are ranked inside; their counts, a row for each, are summed by one task."""
    spanned = items.withColumn("__span", F.floor(F.col("place") / SPAN))
    counts = spanned.groupBy("__span").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__span", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("__span").orderBy("place", key)
    return spanned.withColumn("__r", F.row_number().over(inside) - 1).join(before, "__span").withColumn("number", (F.col("before") + F.col("__r")).cast("long"))


def _round(items: DataFrame, key: str, capacity: int, groups: int, group: int, ordered: bool, name: str) -> DataFrame:
    """item, bin, at, fill, place (least of the bin): where each item of (key, size, place) went. Items are dealt by place or a hash of their key."""

    def fit(batches: pa.Table) -> pa.Table:
        table = batches.sort_by("item")
        sizes, places = table["size"].to_numpy(), table["place"].to_numpy()
        bins, at = best_fit(sizes, capacity)
        fill = np.bincount(bins, sizes).astype(np.int64)[bins]
        first = np.full(int(bins.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, bins, places)
        number = table["__group"][0].as_py()
        return pa.table([table["item"], pa.array(bins + number * ROOM), pa.array(at), pa.array(fill), pa.array(first[bins])], ["item", "bin", "at", "fill", "place"])

    if ordered:
        dealt = _numbered(items, key).select(F.col(key).alias("item"), "size", "place", F.floor(F.col("number") / group).cast("long").alias("__group"))
    else:
        dealt = items.select(F.col(key).alias("item"), "size", "place", F.pmod(F.xxhash64(key), F.lit(groups)).alias("__group"))
    return materialize(dealt.groupBy("__group").applyInArrow(fit, "item long, bin long, at long, fill long, place long"), name)


def pack(parts: DataFrame, capacity: int, group: int = GROUP) -> DataFrame:
    """parts with item (unique), length and, if they have an order, place (from 0); adds sequence_id and offset. Bounded groups, no bin or item is dropped."""
    ordered = "place" in parts.columns
    items = parts.select("item", F.col("length").alias("size"), (F.col("place") if ordered else F.lit(0)).cast("long").alias("place"))
    total = items.count()
    placed = _round(items, "item", capacity, max(1, -(-total // group)), group, ordered, "pack-0").withColumnRenamed("at", "offset")
    level, numbers = 0, max(1, -(-total // group)) * ROOM
    while True:
        bins = placed.groupBy("bin").agg(F.max("fill").alias("size"), F.min("place").alias("place"))
        open_bins = bins.where(F.col("size") < capacity)
        least = open_bins.agg(F.min("size")).first()[0]
        if least is None:
            break
        open_bins = open_bins.where(F.col("size") + F.lit(least) <= capacity)
        count = open_bins.count()
        if count < 2:
            break
        level += 1
        groups = max(1, -(-count // group))
        merged = _round(open_bins, "bin", capacity, groups, group, ordered, f"pack-{level}").select("item", (F.col("bin") + numbers).alias("into"), "at", F.col("fill").alias("filled"), F.col("place").alias("first"))
        left = merged.select("into").distinct().count()
        numbers += groups * ROOM
        joined = placed.join(merged, placed["bin"] == merged["item"], "left").select(
            placed["item"], F.coalesce("into", "bin").alias("bin"), (F.col("offset") + F.coalesce("at", F.lit(0))).alias("offset"), F.coalesce("filled", "fill").alias("fill"), F.coalesce("first", "place").alias("place"))
        placed = materialize(joined, f"packed-{level}")
        if groups == 1 or left == count:
            break
    if not ordered:
        return parts.join(placed.select("item", F.col("bin").alias("sequence_id"), "offset"), "item")
    numbered = _numbered(placed.select("bin", "place").distinct(), "bin").select("bin", F.col("number").alias("sequence_id"))
    return parts.join(placed.join(numbered, "bin").select("item", "sequence_id", "offset"), "item")


def pack_mixed(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, group: int = GROUP, **how) -> DataFrame:
    """As pack_documents(), in the order of mixing.mix(docs, **how), which the rows alone decide, not the files that they come from."""
    return pack_documents(docs, tokenizer, end_id, capacity, group, mixing.mix(docs, **how).select("doc_id", "text_key", "position"))


def _placed(made: DataFrame, places: DataFrame) -> DataFrame:
    """The pieces with their rows' places; rows of equal id and text have equal pieces, so any of them may have either place."""
    copy = F.row_number().over(Window.partitionBy("doc_id", "text_key", "piece").orderBy("item"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy("position"))
    theirs = places.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("position").alias("place"), nth.alias("__nth"))
    numbered = made.withColumn("__copy", copy)
    return numbered.join(theirs, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")) & (F.col("__copy") == F.col("__nth"))).drop("__id", "__key", "__nth", "__copy")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, group: int = GROUP, places: DataFrame | None = None) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. places: doc_id, text_key, position of each row."""
    cut = pieces(docs, tokenizer, end_id, capacity)
    made = materialize(cut.withColumn("item", F.monotonically_increasing_id()), "pieces")  # written once, so the numbers stay
    if places is not None:
        made = materialize(_placed(made, places), "placed-pieces")
    return pack(made, capacity, group).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
