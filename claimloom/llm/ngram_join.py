"""N-gram Jaccard join of documents by a MinHash LSH forest with exact verification.

A document is its set of five-word shingles (lower case, words between ASCII white space). Documents with equal sets are
one class, which has a number of its own (rep); only one row of it goes on. Each tree of the forest is a prefix trie over
signatures of its own MinHash values: documents whose signatures begin alike, sorted together, are a node.

The join starts from the longest prefixes and shortens them, a value at a time. At each depth the nodes with more than
one branch compare their documents across branches; pairs that share a longer prefix anywhere have met before, so every
pair is verified once. After each depth the recall is estimated from the data: a verified pair of similarity s is found at
depth d with chance 1 - (1 - s^d)^trees, so the pairs found, each over its chance, add up to the pairs there are. Shortening
ends when the estimate reaches the target, at the latest at the depth that reaches it for pairs at the threshold itself.

Verification is exact, on the shingle sets: in each node the intersections of all members are products of their incidence
matrix with itself, in tiles of bounded size, one range of shingle hashes after another. Only a document's number of links, a few ties that hold linked documents
together and counts by similarity leave a tile, never pairs.

Results: class_id is the least doc_id of the documents tied by links, copy_id the least with the same shingles, n_links
the number of other rows at or above the threshold, copies included.

Defined cases: a null text counts as empty; under five words all words are one shingle; texts without a word have the
empty set and are alike only to one another; rows of the same doc_id count each as a row, with the same set or another;
rows with a null doc_id are compared and linked like others, but give no name (class_id is null if all of its class have
none). An empty table gives an empty table. Other columns are kept by keep_classes() and keep_one() and not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import MAX_ID, discard, materialize, mix, rolling, rows, slices, texts, word_hashes
from claimloom.llm.components import components

BASE = 0x9E3779B97F4A7C55
TILE = 1024
#: Bytes of shingles that a tile holds at a time: it goes through ranges of hashes, as many as it needs for that.
PIECE = 8 << 20
#: Similarities are counted in so many steps up to 1.
STEPS = 200


def shingle_sets(some: list[str], width: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of the runs of `width` words; all words if there are fewer."""
    words, of = word_hashes([t.lower() for t in some])
    cuts = np.searchsorted(of, np.arange(len(some) + 1))
    own = [words[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [np.unique(rolling(w, min(width, len(w)), BASE)) if len(w) else np.empty(0, np.uint64) for w in own]


def chance(similarity: float, depth: int, trees: int) -> float:
    """That two documents of this similarity share a prefix of this depth in any tree."""
    return 1 - (1 - similarity**depth) ** trees


def least_depth(threshold: float, trees: int, target: float, longest: int) -> int:
    """The greatest depth whose expected recall at the threshold reaches the target."""
    return next((d for d in range(longest, 1, -1) if chance(threshold, d, trees) >= target), 1)


class Forest:
    def __init__(self, threshold: float = 0.8, trees: int = 20, longest: int = 8, target: float = 0.9995, width: int = 5, seed: int = 3):
        self.threshold, self.trees, self.longest, self.target, self.width = threshold, trees, longest, target, width
        self.shortest = least_depth(threshold, trees, target, longest)
        draw = np.random.Generator(np.random.PCG64(seed))
        n = trees * longest
        self.flip = draw.integers(0, 2**64, (n, 1), np.uint64)
        self.times = draw.integers(0, 2**63, (n, 1), np.uint64) * np.uint64(2) + np.uint64(1)

    def sign(self, values: np.ndarray) -> bytes:
        """Tree by tree `longest` MinHash values of two bytes each."""
        least = np.full(len(self.flip), np.uint64(2**64 - 1))
        for at in range(0, len(values), 4096):
            least = np.minimum(least, ((values[None, at : at + 4096] ^ self.flip) * self.times).min(1))
        return mix(least).astype("<u2").tobytes()

    def prefixes(self, signatures: list[bytes], depth: int) -> np.ndarray:
        """A row for each signature and a column for each tree: a hash of the prefix."""
        values = np.frombuffer(b"".join(signatures), "<u2").reshape(-1, self.trees, self.longest)[:, :, :depth].astype(np.uint64)
        out = np.zeros(values.shape[:2], np.uint64)
        for d in range(depth):
            out = mix(out + values[:, :, d] + np.uint64(1))
        return out


def _sets(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, text_key, set_1, set_2 (128 bits of the shingle set), shingles, signature."""

    def sign(batches: Iterator) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values = shingle_sets(part["text"].to_pylist(), forest.width)
                with np.errstate(over="ignore"):
                    one = np.array([mix(v).sum(dtype=np.uint64) for v in values], np.uint64)
                    two = np.array([mix(v ^ np.uint64(BASE)).sum(dtype=np.uint64) for v in values], np.uint64)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["text_key"], pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([len(v) for v in values], pa.int32()), pa.array([forest.sign(v) for v in values], pa.binary())], ["doc_id", "text_key", "set_1", "set_2", "shingles", "signature"])

    keyed = texts(docs).withColumn("text_key", F.xxhash64("text"))
    return keyed.select("doc_id", "text_key", "text").mapInArrow(sign, "doc_id long, text_key long, set_1 long, set_2 long, shingles int, signature binary")


MEMBERS = "node long, tree int, low int, high int, piece int, part int, rep long, copies long, signature binary, set binary"
FOUND = "rep long, links long, tie long, step int, pairs long"
#: What tells tiles apart: a node's least member and tree, and the two parts of it that meet.
TILE_KEY = ["node", "tree", "low", "high"]


def _members(content: DataFrame, wanted: DataFrame, forest: Forest) -> DataFrame:
    """content: rep, text; wanted: rep, copies, signature, tiles. A row for each piece of the shingle set in each tile; the signature goes with the first."""

    def make(batches: Iterator) -> Iterator[pa.RecordBatch]:
        for rep, copies, signature, tiles, text in rows(batches):
            values, out, held = shingle_sets([text], forest.width)[0], [], 0
            for t in tiles:
                cuts = np.searchsorted(values, [np.uint64(2**64 * i // t["pieces"]) for i in range(t["pieces"])]).tolist() + [len(values)]
                for piece in range(t["pieces"]):
                    data = values[cuts[piece] : cuts[piece + 1]].tobytes()
                    out.append((*(t[k] for k in TILE_KEY), piece, t["part"], rep, copies, None if piece else signature, data))
                    held += len(data)
                    if held > 1 << 20 or len(out) >= 512:
                        yield _table(out)
                        out, held = [], 0
            if out:
                yield _table(out)

    def _table(out: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), *[pa.int32()] * 5, pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [*TILE_KEY, "piece", "part", "rep", "copies", "signature", "set"])

    return content.join(wanted, "rep").select("rep", "copies", "signature", "tiles", "text").mapInArrow(make, MEMBERS)


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sets share."""
    n, sizes = len(sets), [len(s) for s in sets]
    shared = np.zeros((n, n), np.float32)
    owner, (_, column, uses) = np.repeat(np.arange(n), sizes), np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    useful = uses[column] > 1
    owner, column = owner[useful], (np.cumsum(uses > 1) - 1)[column[useful]]
    order = np.argsort(column, kind="stable")
    owner, column, width = owner[order], column[order], 4096
    for lo in range(0, int((uses > 1).sum()), width):
        a, b = np.searchsorted(column, [lo, lo + width])
        block = np.zeros((n, width), np.float32)
        block[owner[a:b], column[a:b] - lo] = 1
        shared += block @ block.T
    return shared


def verify(members: list[tuple], pieces: Iterable[list[np.ndarray]], tree: int, depth: int, forest: Forest) -> list[tuple]:
    """Rows of FOUND: a member's linked rows and tie, and pairs by similarity. members: (part, rep, copies, signature).

    pieces: for each range of shingles the members' values in it, one range in memory at a time. Counts pairs that share no
    longer prefix in any tree and none of this depth in an earlier one. A tile of one part compares all its members; one of
    two parts compares across them.
    """
    n = len(members)
    part = np.array([m[0] for m in members])
    reps = np.array([m[1] for m in members], np.int64)
    copies = np.array([m[2] for m in members], np.int64)
    sizes, shared = np.zeros(n, np.float32), np.zeros((n, n), np.float32)
    for sets in pieces:
        sizes += np.array([len(s) for s in sets], np.float32)
        shared += common(sets)
    union = sizes[:, None] + sizes[None, :] - shared
    about = np.triu(shared >= np.float32(forest.threshold * 0.999) * union, 1)
    if len(set(part)) > 1:
        about &= part[:, None] != part[None, :]
    x, y = np.nonzero(about)
    alike = shared[x, y].astype(np.int64) * 1000 >= round(forest.threshold * 1000) * union[x, y].astype(np.int64)  # in whole numbers
    x, y = x[alike], y[alike]
    now = forest.prefixes([m[3] for m in members], depth)
    first = np.ones(len(x), bool)
    longer = forest.prefixes([m[3] for m in members], depth + 1) if depth < forest.longest else None
    for t in range(forest.trees):
        if longer is not None:
            first &= longer[x, t] != longer[y, t]
        if t < tree:
            first &= now[x, t] != now[y, t]
    x, y = x[first], y[first]
    if not len(x):
        return []
    counts = np.bincount(x, copies[y], n) + np.bincount(y, copies[x], n)
    label = np.arange(n)
    while True:  # least reachable member; a few passes, as ties are short
        least = label.copy()
        np.minimum.at(least, x, label[y])
        np.minimum.at(least, y, label[x])
        least = np.minimum(least, least[least])
        if (least == label).all():
            break
        label = least
    steps, pairs = np.unique((shared[x, y] / union[x, y] * STEPS).astype(np.int64), return_counts=True)
    return [(int(reps[i]), int(counts[i]), int(reps[label[i]]), None, None) for i in np.flatnonzero(counts)] + [(None, None, None, int(s), int(p)) for s, p in zip(steps, pairs, strict=True)]


def _verified(members: DataFrame, depth: int, forest: Forest) -> DataFrame:
    """Tiles stream through their tasks one after another, sorted by tile."""

    def check(batches: Iterator) -> Iterator[pa.RecordBatch]:
        out = []
        for (_, tree, _, _), tile in groupby(rows(batches), itemgetter(0, 1, 2, 3)):
            pieces = groupby(tile, itemgetter(4))
            first = list(next(pieces)[1])
            if len(first) > 1:
                members = [m[5:9] for m in first]
                sets = [[np.frombuffer(m[9], np.uint64) for m in first]]
                later = ([np.frombuffer(m[9], np.uint64) for m in piece] for _, piece in pieces)
                del first
                out.extend(verify(members, _each(sets, later), tree, depth, forest))
            if len(out) > 2000:
                yield _found(out)
                out = []
        yield _found(out)

    def _each(first: list, later: Iterator) -> Iterator:
        yield first.pop()  # not held while the others come
        yield from later

    def _found(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 5
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["rep", "links", "tie", "step", "pairs"])

    dealt = members.repartition(*TILE_KEY).sortWithinPartitions(*TILE_KEY, "piece", "part", "rep")  # each piece has all members, in one order
    return dealt.mapInArrow(check, FOUND)


def _entries(classes: DataFrame, forest: Forest, depth: int) -> DataFrame:
    """rep, tree, shingles, prefix, branch (the prefix one value longer) of each class that has shingles."""
    size = 2 * forest.longest
    cut = lambda n: F.expr(f"substring(signature, tree * {size} + 1, {2 * n})")
    each = classes.where("shingles > 0").select("rep", "signature", "shingles", F.explode(F.sequence(F.lit(0), F.lit(forest.trees - 1))).alias("tree"))
    return each.select("rep", "tree", "shingles", cut(depth).alias("prefix"), cut(min(depth + 1, forest.longest)).alias("branch"))


def _tiles(classes: DataFrame, forest: Forest, depth: int, tile: int, piece: int) -> DataFrame:
    """rep, tiles: where each class is compared at this depth, and in how many pieces. Nodes of the same members in several trees are compared in the first."""
    entries = _entries(classes, forest, depth)
    who = F.sum(F.xxhash64("rep").cast("decimal(20,0)")).cast("decimal(38,0)")
    nodes = entries.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("n"), F.sum("shingles").alias("values"), F.min("rep").alias("least"), who.alias("who"), F.min("branch").alias("a"), F.max("branch").alias("b")).where("n > 1")
    if depth < forest.longest:
        nodes = nodes.where("a <> b")
    parts = F.ceil(F.col("n") / tile).cast("int")
    once = nodes.groupBy("n", "values", "least", "who").agg(F.min(F.struct("tree", "prefix")).alias("g")).select("g.tree", "g.prefix", F.col("least").alias("node"), "values", parts.alias("parts"))
    # shingles are spread evenly, and so are members over parts; a tile holds two parts of its node
    held = 8 * F.col("values") * F.least(F.lit(1.0), 2 / F.col("parts"))
    once = once.withColumn("pieces", F.ceil(held / piece).cast("int")).drop("values")
    placed = entries.join(once, ["tree", "prefix"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    # a member of part p meets every other part once: tiles (p, q), and (p, p) alone
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    tiles = placed.select("rep", "tree", "node", "pieces", "part", other)
    tiles = tiles.select("rep", F.struct("node", "tree", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "pieces").alias("t"))
    return tiles.groupBy("rep").agg(F.collect_list("t").alias("tiles"))


def recall(pairs: dict[int, int], depth: int, trees: int) -> float:
    """Estimated from verified pairs by similarity step: pairs found over the pairs that there are; 0 without any."""
    there = sum(n / chance(step / STEPS, depth, trees) for step, n in pairs.items())
    return sum(pairs.values()) / there if there else 0.0


def linked(docs: DataFrame, classes: DataFrame, forest: Forest, tile: int = TILE, piece: int = PIECE) -> tuple[DataFrame, int, float]:
    """rep, links, tie of the classes, the depth at which shortening ended and the recall estimated there."""
    last = _entries(classes, forest, forest.shortest)
    alike = last.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    near = last.join(alike, ["tree", "prefix"], "left_semi").select("rep").distinct()
    near = materialize(classes.join(near, "rep", "left_semi"), "near-classes")
    keyed = texts(docs).withColumn("text_key", F.xxhash64("text")).withColumn("doc_id", F.coalesce("doc_id", F.lit(MAX_ID)))
    named = near.select("rep", "id", "rep_key")
    content = keyed.join(named, (keyed["doc_id"] == named["id"]) & (keyed["text_key"] == named["rep_key"])).dropDuplicates(["rep"]).select("rep", "text")
    content = materialize(content, "near-texts")
    levels, pairs, depth, reached = [], {}, forest.longest, 0.0
    for depth in range(forest.longest, forest.shortest - 1, -1):
        wanted = _tiles(near, forest, depth, tile, piece).join(near.select("rep", "copies", "signature"), "rep")
        level = materialize(_verified(_members(content, wanted, forest), depth, forest), "links")
        levels.append(level)
        for r in level.where("step is not null").groupBy("step").agg(F.sum("pairs").alias("n")).collect():  # at most a row for each step
            pairs[r.step] = pairs.get(r.step, 0) + r.n
        reached = recall(pairs, depth, forest.trees)
        if reached >= forest.target:
            break
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    found = materialize(found.where("rep is not null").select("rep", "links", "tie"), "forest-links")
    for table in (content, near, *levels):
        discard(table)
    return found, depth, reached


def _classed(docs: DataFrame, forest: Forest | None, tile: int = TILE, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """The signed rows; and of each shingle set: set_1, set_2, id (least doc_id, or MAX_ID), rep_key, n_links, root (the number of its class)."""
    forest = forest or Forest()
    signed = materialize(_sets(docs, forest), "signatures")
    ranked = F.struct(F.coalesce("doc_id", F.lit(MAX_ID)).alias("id"), F.col("text_key").alias("rep_key"))
    same = signed.groupBy("set_1", "set_2").agg(F.min(ranked).alias("least"), F.count(F.lit(1)).alias("copies"), F.first("signature").alias("signature"), F.max("shingles").alias("shingles"))
    # numbered and written once, so the numbers stay
    classes = materialize(same.select(F.monotonically_increasing_id().alias("rep"), "set_1", "set_2", "least.id", "least.rep_key", "copies", "shingles", "signature"), "shingle-classes")
    links, _, _ = linked(docs, classes, forest, tile, piece)
    counts = links.groupBy("rep").agg(F.sum("links").alias("others"))
    roots = components(links.select(F.col("rep").alias("a"), F.col("tie").alias("b")))
    classed = classes.join(counts, "rep", "left").join(roots, classes["rep"] == roots["node"], "left").select(
        "set_1", "set_2", "id", "rep_key", F.coalesce("root", "rep").alias("root"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    classed = materialize(classed, "classed")
    for table in (classes, links):
        discard(table)
    return signed, classed


def join_report(docs: DataFrame, forest: Forest | None = None, tile: int = TILE, piece: int = PIECE) -> DataFrame:
    """doc_id, text_key, copy_id, class_id, n_links of each row."""
    signed, classed = _classed(docs, forest, tile, piece)
    named = lambda c, name: F.when(F.col(c) < MAX_ID, F.col(c)).alias(name)
    ids = classed.join(classed.groupBy("root").agg(F.min("id").alias("class")), "root")
    return signed.join(ids, ["set_1", "set_2"]).select("doc_id", "text_key", named("id", "copy_id"), named("class", "class_id"), "n_links")


def keep_classes(docs: DataFrame, forest: Forest | None = None) -> DataFrame:
    """docs with their columns: of each class one row, the first by doc_id (null last) and text_key, also where two classes have one name."""
    _, classed = _classed(docs, forest)
    kept = classed.groupBy("root").agg(F.min(F.struct("id", "rep_key")).alias("k")).select(F.col("k.id").alias("__id"), F.col("k.rep_key").alias("__key"))
    keyed = docs.withColumn("__text_key", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    one = keyed.join(kept, (F.coalesce(F.col("doc_id").cast("long"), F.lit(MAX_ID)) == F.col("__id")) & (F.col("__text_key") == F.col("__key")), "left_semi")
    return one.dropDuplicates(["doc_id", "__text_key"]).drop("__text_key")


def keep_one(docs: DataFrame, forest: Forest | None = None) -> DataFrame:
    """As keep_classes(), but of classes with the same name only the one with the least text_key: each doc_id that is not null once."""
    kept = materialize(keep_classes(docs, forest).withColumn("__text_key", F.xxhash64(F.coalesce(F.col("text"), F.lit("")))), "kept")
    least = kept.groupBy("doc_id").agg(F.min("__text_key").alias("__least")).withColumnRenamed("doc_id", "__id")
    once = kept.join(least, (F.col("doc_id") == F.col("__id")) & (F.col("__text_key") == F.col("__least")), "left_semi")
    return once.unionByName(kept.where(F.col("doc_id").isNull())).drop("__text_key")
