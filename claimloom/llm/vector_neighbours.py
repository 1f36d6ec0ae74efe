"""Near-duplicate vectors by Euclidean p-stable hashing, with exact cosine checks.

Vectors of one label are compared after normalisation, where cosine and distance are one thing. Each of several tables
projects a vector on random Gaussian directions and cuts every projection into cells of one width; the cells of a table,
hashed, are its bucket. How many directions a table has and how many tables there are follow from the data's size and the
target recall: as many directions as leave about one unlike vector (at a right angle) in a bucket, and as many tables as
bring a pair at the threshold into a common bucket with the target chance.

Equal vectors of a label are one class, so copies meet nowhere. Buckets are counted as (table, cells) without vectors;
only those with two classes or more are compared, and buckets with the same classes in several tables once. A bucket is
dealt into tiles of bounded size, where all cosines are one matrix product in double precision. A pair counts in the
first table that brings it together, so links are counted once. Only a class's number of links and a tie to the least
class that a tile links it with leave a tile, never pairs.

A bucket of n *different* near vectors costs n² products, and each of its vectors goes to n / tile tiles.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link
with nothing; vectors of unlike length neither. Repeated rows are copies, and count each as a row. A row without vec_id
links like others, but names no component (null if all of it lack one) and is not kept. An empty table gives an empty
table. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import discard, materialize, mix, rows
from claimloom.llm.components import components

THRESHOLD = 0.93
TILE = 512


def meets(distance: float, width: float) -> float:
    """Chance that two points at this distance fall into one cell of a random direction."""
    if distance <= 0:
        return 1.0
    r = width / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


class Projections:
    """width: of a cell; target: chance that a pair at the threshold meets in any table; many: vectors of the largest label."""

    def __init__(self, many: int, threshold: float = THRESHOLD, target: float = 0.995, width: float = 2.0, seed: int = 12):
        self.threshold, self.width, self.seed = threshold, width, seed
        near, far = meets(math.sqrt(2 - 2 * threshold), width), meets(math.sqrt(2), width)
        self.directions = max(1, math.ceil(math.log(max(2, many)) / -math.log(far)))
        self.tables = max(1, math.ceil(math.log(1 - target) / math.log(1 - near**self.directions)))
        self.drawn: dict[int, tuple] = {}

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """Four bytes for each vector (row) and table."""
        dim, n = unit.shape[1], self.tables * self.directions
        if dim not in self.drawn:
            draw = np.random.Generator(np.random.PCG64([self.seed, dim]))
            self.drawn[dim] = draw.standard_normal((dim, n)), draw.uniform(0, self.width, n)
        a, b = self.drawn[dim]
        cells = np.floor((unit @ a + b) / self.width).astype(np.int64).view(np.uint64).reshape(len(unit), self.tables, self.directions)
        out = np.zeros(cells.shape[:2], np.uint64)
        for d in range(self.directions):
            out = mix(out + cells[:, :, d] + np.uint64(1))
        return (out >> np.uint64(32)).astype("<u4")


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares stay in range."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _vectors(table: DataFrame) -> DataFrame:
    """vec_id, group (label and length; null: links with nothing), embedding, h_1, h_2 (128 bits of group and vector)."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    sound = F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    group = F.when(F.coalesce(sound, F.lit(False)), F.struct("label", F.size("embedding").alias("length")))
    return rows.select("vec_id", group.alias("group"), "embedding").select("vec_id", "group", "embedding", F.xxhash64("group", "embedding").alias("h_1"), F.xxhash64("embedding", "group", F.lit("second")).alias("h_2"))


def _classes(vectors: DataFrame) -> DataFrame:
    """rep (a number of its own), group, h_1, h_2, id (least vec_id), copies, vector (its doubles)."""

    def pack(batches: Iterator) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["embedding"]
            flat, ends = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), "<f8"), np.cumsum(lists.value_lengths().to_numpy())
            data = [flat[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("rep", "label", "length", "h_1", "h_2", "id", "copies")], pa.array(data, pa.binary())], ["rep", "label", "length", "h_1", "h_2", "id", "copies", "vector"])

    same = vectors.where("group is not null").groupBy("h_1", "h_2").agg(F.first("group").alias("group"), F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    numbered = same.select(F.monotonically_increasing_id().alias("rep"), "group.label", "group.length", "h_1", "h_2", "id", "copies", "embedding")
    # written once, so the numbers stay
    return materialize(numbered.mapInArrow(pack, "rep long, label string, length int, h_1 long, h_2 long, id long, copies long, vector binary"), "vector-classes")


def _signed(classes: DataFrame, hashing: Projections) -> DataFrame:
    """rep, label, length, copies, vector, keys (of all tables): written once, so that every step reads the same keys."""

    def sign(batches: Iterator) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                vectors, keys = [np.frombuffer(v, "<f8") for v in part["vector"].to_pylist()], [b""] * part.num_rows
                for length in {len(v) for v in vectors}:
                    of = [i for i, v in enumerate(vectors) if len(v) == length]
                    for i, k in zip(of, hashing.keys(unit_rows(np.stack([vectors[i] for i in of]))), strict=True):
                        keys[i] = k.tobytes()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.binary())], [*part.schema.names, "keys"])

    narrow = classes.select("rep", "label", "length", "copies", "vector")
    return materialize(narrow.mapInArrow(sign, "rep long, label string, length int, copies long, vector binary, keys binary"), "vector-keys")


def _tiles(signed: DataFrame, hashing: Projections, tile: int) -> DataFrame:
    """rep, tile, tile_2 (128 bits of a tile's name), tab, part: where each class is compared."""
    each = signed.select("rep", "label", "length", "keys", F.explode(F.sequence(F.lit(0), F.lit(hashing.tables - 1))).alias("tab"))
    entries = each.select("rep", "label", "length", "tab", F.expr("substring(keys, tab * 4 + 1, 4)").alias("cell"))
    bucket = ["label", "length", "tab", "cell"]
    who = F.sum(F.xxhash64("rep").cast("decimal(20,0)")).cast("decimal(38,0)")
    shared = entries.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("least"), who.alias("who")).where("n > 1")
    once = shared.groupBy("n", "least", "who").agg(F.min(F.struct("tab", "cell", "label", "length")).alias("g")).select("g.*", F.ceil(F.col("n") / tile).cast("int").alias("parts"))
    placed = entries.join(once, bucket).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    # a member of part p meets every other part once: tiles (p, q), and (p, p) alone
    other = placed.select("rep", *bucket, "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    name = [*bucket, F.least("part", "other"), F.greatest("part", "other")]
    return other.select("rep", F.xxhash64(*name).alias("tile"), F.xxhash64(*name, F.lit("second")).alias("tile_2"), "tab", "part")


def compare(members: list[tuple], tab: int, hashing: Projections) -> list[tuple]:
    """members: (part, rep, copies, vector, keys). rep, links (rows) and tie of those that are linked within the tile.

    A tile of one part compares all its members; one of two parts compares across them. Pairs that an earlier table
    brings together were compared there.
    """
    n = len(members)
    part, reps = np.array([m[0] for m in members]), np.array([m[1] for m in members], np.int64)
    copies = np.array([m[2] for m in members], np.int64)
    unit = unit_rows(np.stack([np.frombuffer(m[3], "<f8") for m in members]))
    near = np.triu(unit @ unit.T >= hashing.threshold, 1)
    if len(set(part)) > 1:
        near &= part[:, None] != part[None, :]
    x, y = np.nonzero(near)
    keys = np.stack([np.frombuffer(m[4], "<u4") for m in members])[:, :tab]
    first = np.ones(len(x), bool)
    for t in range(tab):
        first &= keys[x, t] != keys[y, t]
    x, y = x[first], y[first]
    counts = np.bincount(x, copies[y], n) + np.bincount(y, copies[x], n)
    label = np.arange(n)
    while len(x):  # least reachable member
        least = label.copy()
        np.minimum.at(least, x, label[y])
        np.minimum.at(least, y, label[x])
        least = np.minimum(least, least[least])
        if (least == label).all():
            break
        label = least
    return [(int(reps[i]), int(counts[i]), int(reps[label[i]])) for i in np.flatnonzero(counts)]


def _compared(signed: DataFrame, tiles: DataFrame, hashing: Projections) -> DataFrame:
    """Tiles stream through their tasks one after another, sorted by tile."""

    def check(batches: Iterator) -> Iterator[pa.RecordBatch]:
        out, held, now, tab = [], [], None, 0
        for tile, tile_2, t, *member in rows(batches):
            if (tile, tile_2, t) != now:
                if len(held) > 1:
                    out.extend(compare(held, tab, hashing))
                held, now, tab = [], (tile, tile_2, t), t
                if len(out) > 2000:
                    yield _found(out)
                    out = []
            held.append(tuple(member))
        if len(held) > 1:
            out.extend(compare(held, tab, hashing))
        yield _found(out)

    def _found(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 3)], ["rep", "links", "tie"])

    dealt = tiles.join(signed.select("rep", "copies", "vector", "keys"), "rep").repartition("tile").sortWithinPartitions("tile", "tile_2", "tab", "part", "rep")
    return dealt.select("tile", "tile_2", "tab", "part", "rep", "copies", "vector", "keys").mapInArrow(check, "rep long, links long, tie long")


def neighbours(table: DataFrame, threshold: float = THRESHOLD, target: float = 0.995, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vec_id, embedding, label."""
    vectors = _vectors(table)
    classes = _classes(vectors)
    many = classes.groupBy("label", "length").count().agg(F.max("count")).first()[0] or 0
    hashing = Projections(many, threshold, target)
    signed = _signed(classes, hashing)
    found = materialize(_compared(signed, _tiles(signed, hashing, tile), hashing), "vector-links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("others"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("tie").alias("b")))
    rooted = classes.select("rep", "h_1", "h_2", "id", "copies").join(counts, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rep"))
    rooted = materialize(rooted.select("h_1", "h_2", "id", "root", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links")), "vector-roots")
    for t in (classes, signed, found):
        discard(t)
    named = rooted.join(rooted.groupBy("root").agg(F.min("id").alias("component")), "root").select("h_1", "h_2", "links", "component")
    rows = vectors.select("vec_id", F.col("group").isNotNull().alias("sound"), "h_1", "h_2")
    linked = rows.where("sound").join(named, ["h_1", "h_2"]).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
