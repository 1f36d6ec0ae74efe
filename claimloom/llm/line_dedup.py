"""Reversible line deduplication: sharded cuckoo filters backed by exact reference-count tables.

State, in the shared folder: `segments`, tables of references (shard, key, doc_id, change: 1 for an insertion, -1 for a
deletion), of which a key's reference count is the sum, and `filters`, a cuckoo filter of the distinct keys for each shard
of the hash space. Documents come in batches. A batch's keys are first put to the filters of their shards: those that no
filter knows are new and need no lookup; only the others are looked up in the exact tables, which settles the filter's
errors. A batch adds a segment of its own references and rewrites the filters of the shards that it touches, nothing
else. Filters delete as well as insert, so removing documents takes their references out, and keys without a reference
leave the filter: state after inserting and deleting equals the state as if the documents had never come.

Batches are ranges of ascending doc_id, so a line's owner, the least doc_id that holds it, comes no later than its copies:
a document loses the lines whose keys the filters and tables know from an earlier batch or a smaller doc_id of its own.

Defined cases: a null or empty text is one empty line; keys shorter than `least_chars` are never dropped; rows of the
same doc_id are one document, and each row keeps its own text; a null doc_id owns nothing and loses nothing; within its
owner a repeated line stays. An empty table gives an empty table. Other columns are kept by clean() and not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.common import discard, materialize, mix, texts

SPACE = " \t\n\x0b\x0c\r"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
REFS = "shard int, key binary, doc_id long, change int"
FILTERS = "shard int, filter binary, buckets int, keys int"
SLOTS = 4


def line_key(line: Column) -> Column:
    """The line without outer white space, A-Z lower-cased."""
    kept = F.btrim(line, F.lit(SPACE))
    return F.translate(kept, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_of(line: str) -> str:
    return line.strip(SPACE).encode().translate(LOWER).decode()


class CuckooFilter:
    """16-bit fingerprints in buckets of four; deletes as well as inserts."""

    def __init__(self, capacity: int = 16, table: np.ndarray | None = None, count: int = 0):
        size = 1 << max(2, int(np.ceil(np.log2(max(capacity, 1) / SLOTS / 0.8 + 1))))
        self.table = np.zeros((size, SLOTS), np.uint16) if table is None else table
        self.mask, self.count = np.uint64(len(self.table) - 1), count

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = ((hashes >> np.uint64(48)).astype(np.uint16)) | np.uint16(1)
        one = hashes & self.mask
        return mark, one.astype(np.int64), (one ^ (mix(mark.astype(np.uint64)) & self.mask)).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        mark, one, two = self.places(hashes)
        return (self.table[one] == mark[:, None]).any(1) | (self.table[two] == mark[:, None]).any(1)

    def insert(self, hashes: np.ndarray) -> bool:
        """False if there is no room: the caller rebuilds a larger filter from the exact keys."""
        mark, one, two = self.places(hashes)
        left = np.flatnonzero(~self._place(mark, one))
        left = left[~self._place(mark[left], two[left])]
        alternate = (mix(np.arange(1 << 16, dtype=np.uint64)) & self.mask).astype(np.int64)
        rng = np.random.default_rng(1)
        for m, a in zip(mark[left], one[left], strict=True):
            for _ in range(500):
                slot = int(rng.integers(SLOTS))
                m, self.table[a, slot] = self.table[a, slot], m
                a = a ^ alternate[m]
                free = np.flatnonzero(self.table[a] == 0)
                if len(free):
                    self.table[a, free[0]] = m
                    break
            else:
                return False
        self.count += len(hashes)
        return True

    def _place(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Put as many marks as their buckets have free slots for; which ones went in."""
        order = np.argsort(bucket, kind="stable")
        at = bucket[order]
        start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.empty(0, np.int64)
        rank = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
        taken = self.table[at] != 0
        fits = rank < SLOTS - taken.sum(1)
        slots = np.argsort(taken[fits], 1, kind="stable")  # free ones first
        self.table[at[fits], slots[np.arange(len(slots)), rank[fits]]] = mark[order][fits]
        went = np.zeros(len(bucket), bool)
        went[order[fits]] = True
        return went

    def delete(self, hashes: np.ndarray) -> None:
        mark, one, two = self.places(hashes)
        for m, a, b in zip(mark, one, two, strict=True):
            for bucket in (a, b):
                found = np.flatnonzero(self.table[bucket] == m)
                if len(found):
                    self.table[bucket, found[0]] = 0
                    self.count -= 1
                    break

    @classmethod
    def of(cls, hashes: np.ndarray, room: float = 1.0) -> CuckooFilter:
        """A filter of these keys with room for as many times their number."""
        capacity = max(16, int(len(hashes) * room))
        while True:
            made = cls(capacity)
            if made.insert(hashes):
                return made
            capacity *= 2


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(k[:8] for k in keys), "<u8").astype(np.uint64)


class LineIndex:
    """Segments and filters as tables; insert() and delete() return a new index and leave the old one valid."""

    def __init__(self, spark: SparkSession, shards: int = 64, segments: tuple[DataFrame, ...] = (), filters: DataFrame | None = None, least_chars: int = 10, room: float = 2.0, deleted: bool = False):
        self.spark, self.shards, self.segments, self.least_chars, self.room = spark, shards, segments, least_chars, room
        self.filters = spark.createDataFrame([], FILTERS) if filters is None else filters
        self.deleted = deleted  # whether any segment takes references out
        self.lost = None  # after insert(): the lines that the batch's documents lose

    def references(self, docs: DataFrame) -> DataFrame:
        """Distinct (shard, key, doc_id) of a batch. Keys are 128-bit hashes; copies within a text go before the shuffle."""
        lines = texts(docs).where(F.col("doc_id").isNotNull()).select("doc_id", F.explode(F.array_distinct(F.transform(F.split("text", "\n", -1), line_key))).alias("line"))
        keyed = lines.where(F.length("line") >= self.least_chars).select("doc_id", F.unhex(F.md5(F.col("line").cast("binary"))).alias("key"))
        return keyed.select(F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int").alias("shard"), "key", "doc_id").distinct()

    def refs(self) -> DataFrame:
        """The references that count: shard, key, doc_id."""
        if not self.segments:
            return self.spark.createDataFrame([], REFS).drop("change")
        rows = self.segments[0]
        for segment in self.segments[1:]:
            rows = rows.unionByName(segment)
        if not self.deleted:  # an insertion never repeats a reference, so there is nothing to add up
            return rows.drop("change")
        return rows.groupBy("shard", "key", "doc_id").agg(F.sum("change").alias("n")).where("n > 0").drop("n")

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with the batch's lines; references that it has already are not counted twice."""
        batch = materialize(self.references(docs), "line-batch")

        def probe(shard: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            """The batch's keys that the filter may know."""
            if not right.num_rows or not left.num_rows:
                return left.slice(0, 0)
            return left.filter(pa.array(_load(right).contains(_hashes(left["key"].to_pylist())), pa.bool_()))

        keys = batch.select("shard", "key").distinct()
        if self.segments:
            asked = materialize(keys.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(probe, "shard int, key binary"), "line-asked")
            known = materialize(self.refs().join(asked, ["shard", "key"], "left_semi"), "line-known")
            new, fresh = keys.join(known.select("shard", "key").distinct(), ["shard", "key"], "left_anti"), batch.join(known, ["shard", "key", "doc_id"], "left_anti")
            fresh = materialize(fresh.withColumn("change", F.lit(1)), "line-refs")
            discard(asked)
        else:
            known, new, fresh = None, keys, batch.withColumn("change", F.lit(1))
        after = self._with(fresh)
        after.filters = after._filtered(new.withColumn("add", F.lit(True)))
        after.lost = materialize(self._lost(batch, known), "line-lost")
        if known is not None:
            discard(batch)
            discard(known)
        return after

    def _lost(self, batch: DataFrame, known: DataFrame | None) -> DataFrame:
        """doc_id, key: lines of the batch that a smaller document holds, in the batch or among the known references.

        Owners are a table first: both sides of the join are then plain exchanges, which Spark splits where one key has
        many references, and it broadcasts the owners if their size in files is under its own limit.
        """
        owners = batch.groupBy("key").agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("n"))
        if known is not None:
            before = known.groupBy("key").agg(F.min("doc_id").alias("before"))
            owners = owners.join(before, "key", "left").select("key", F.least("owner", "before").alias("owner"), F.when(F.col("before").isNull(), F.col("n")).otherwise(2).alias("n"))
        return batch.join(materialize(owners.where("n > 1").select("key", "owner"), "line-owners"), "key").where(F.col("doc_id") > F.col("owner")).select("doc_id", "key")

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """The index without these documents (doc_id): keys that lose their last reference leave the filters."""
        refs = self.refs()
        gone = refs.join(doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi").select("shard", "key", "doc_id")
        gone = materialize(gone.withColumn("change", F.lit(-1)), "line-gone")
        after = self._with(gone)
        after.deleted = True
        touched = gone.select("shard", "key").distinct()
        lost = touched.join(after.refs().join(touched, ["shard", "key"], "left_semi"), ["shard", "key"], "left_anti")
        after.filters = after._filtered(lost.withColumn("add", F.lit(False)))
        return after

    def _with(self, segment: DataFrame) -> LineIndex:
        return LineIndex(self.spark, self.shards, (*self.segments, segment), self.filters, self.least_chars, self.room, self.deleted)

    def _filtered(self, changes: DataFrame) -> DataFrame:
        """The filters after the changes (shard, key, add); a shard whose filter has no room is built anew from its exact keys."""
        room = self.room

        def update(shard: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return right
            hashes = _hashes(left["key"].to_pylist())
            add = left["add"].to_numpy()
            if right.num_rows:
                made = _load(right)
                made.delete(hashes[~add])
                if made.count + add.sum() > 0.9 * made.table.size or not made.insert(hashes[add]):
                    made = None
            else:
                made = CuckooFilter.of(hashes[add], room)
            return _row(shard[0].as_py(), made)

        changed = materialize(changes.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(update, FILTERS), "line-filters")
        full = changed.where(F.col("filter").isNull()).select("shard")
        if full.isEmpty():
            return changed

        def build(shard: tuple, table: pa.Table) -> pa.Table:
            return _row(shard[0].as_py(), CuckooFilter.of(_hashes(table["key"].to_pylist()), room))

        rebuilt = self.refs().join(full, "shard", "left_semi").select("shard", "key").distinct().groupBy("shard").applyInArrow(build, FILTERS)
        return materialize(changed.where(F.col("filter").isNotNull()).unionByName(rebuilt), "line-filters")

    def owners(self) -> DataFrame:
        """Keys with more than one reference: key, owner."""
        return self.refs().groupBy("key").agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "owner")


def _load(table: pa.Table) -> CuckooFilter:
    data, count = table["filter"][0].as_py(), table["keys"][0].as_py()
    return CuckooFilter(table=np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy(), count=count)


def _row(shard: int, made: CuckooFilter | None) -> pa.Table:
    values = (shard, made.table.tobytes(), len(made.table), made.count) if made is not None else (shard, None, None, None)
    types = (pa.int32(), pa.binary(), pa.int32(), pa.int32())
    return pa.table([pa.array([v], t) for v, t in zip(values, types, strict=True)], ["shard", "filter", "buckets", "keys"])


def _kept_lines(text: str, lost: set[bytes], least_chars: int) -> tuple[int, list[str]]:
    lines = text.split("\n")
    if not lost:
        return len(lines), lines
    kept = []
    for line in lines:
        key = key_of(line)
        if len(key) < least_chars or hashlib.md5(key.encode()).digest() not in lost:
            kept.append(line)
    return len(lines), kept


def build_index(docs: DataFrame, least_chars: int = 10, batches: int = 4) -> tuple[LineIndex, DataFrame]:
    """An index of all the documents, inserted in ranges of ascending doc_id, and by doc_id the keys that it loses (bounded by its own lines).

    A shard for about every 4,096 documents, 64 at least.
    """
    held = docs.where(F.col("doc_id").isNotNull()).withColumn("__id", F.col("doc_id").cast("long"))
    steps = [i / batches for i in range(1, batches)]
    n, cuts = held.agg(F.count(F.lit(1)), F.percentile_approx("__id", steps) if steps else F.lit(None)).first()
    index, lost = LineIndex(docs.sparkSession, max(64, n // 4096), least_chars=least_chars, room=float(batches)), None
    bounds = [None, *sorted(set(cuts or [])), None]
    for lo, hi in zip(bounds, bounds[1:]):
        own = (F.col("__id") > lo if lo is not None else F.lit(True)) & (F.col("__id") <= hi if hi is not None else F.lit(True))
        index = index.insert(held.where(own).drop("__id"))
        lost = index.lost if lost is None else lost.unionByName(index.lost)
    return index, lost.groupBy("doc_id").agg(F.collect_set("key").alias("__lost"))


def line_report(docs: DataFrame, least_chars: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each row."""
    _, dropped = build_index(docs, least_chars)

    def digest(batches: Iterator) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], []]
            for text, lost in zip(batch.column("text"), batch.column("__lost"), strict=True):
                n, kept = _kept_lines(text.as_py(), set(lost.as_py() or ()), least_chars)
                for column, value in zip(out, (n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return texts(docs).join(dropped, "doc_id", "left").select("doc_id", "text", "__lost").mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def clean(docs: DataFrame, least_chars: int = 10) -> DataFrame:
    """docs with their columns, the repeated lines gone from text; texts of which nothing is left go as a whole."""
    lost = build_index(docs, least_chars)[1].withColumnRenamed("doc_id", "__lost_id")
    joined, names = docs.join(lost, F.col("doc_id").cast("long") == F.col("__lost_id"), "left").drop("__lost_id"), docs.columns

    def rewrite(batches: Iterator) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, lost in zip(batch.column("text"), batch.column("__lost"), strict=True):
                text, lost = text.as_py(), lost.as_py()
                out.append("\n".join(_kept_lines(text or "", set(lost), least_chars)[1]) if lost else text)
            arrays = [pa.array(out, batch.schema.field(f).type) if f == "text" else batch.column(f) for f in names]
            done = pa.RecordBatch.from_arrays(arrays, names)
            gone = [bool(lost.as_py()) and not (text or "").strip() for text, lost in zip(out, batch.column("__lost"), strict=True)]
            yield done.filter(pa.array([not g for g in gone], pa.bool_()))

    return joined.mapInArrow(rewrite, docs.schema)
