"""How the sources of a language differ in their words: exact term counts by CountVectorizer, group sums, sparse pairs.

CountVectorizer's vocabulary has every term of a language that occurs in at least `least` of the language's documents,
without a limit on its size. One fit serves all languages: a token is its language, a unit separator and the term, so
document counts, minDF and vocabulary are each language's own, and no loop runs over languages.

What the fit and the model read are not the documents themselves but shorter ones that stand for a block of them (see
tokens()): a word as often as minDF asks for it, and a group's words once for each binary digit of their counts. So sums of
the model's sparse vectors, each times its digit, are the counts, and a word's repeats in a block cost nothing after it. The
sums are packed into a row for each bucket of indices, meet the names of their terms in one shuffle and are added up there.
Pairs of sources are evaluated sparsely too: only terms that both have meet in a join; terms that one of them has are
grouped by frequency, and all others differ alike.

A vocabulary goes to the driver and to every executor. Before the fit the distinct tokens, of which it is a part, are
therefore estimated, and the terms are dealt by hash to as many fits as keep each below `most_terms` (a bound on memory,
some 100 bytes a term); each fit reads its own words only. The rows are the same with any number, as a test holds.

Frequencies are whole numbers, p = 1 + floor(10^9 (count + 1) / (N + V)); the divergence of one term is
floor((p - q)² / q). Output: part `pair` (item: another source of the language; value: the sum over all terms of the
language) and part `term` (item: a term that the group uses more than the language does; the first `top` only).

Defined cases: null text, lang and source count as ''; a language without kept terms has pairs of value 0; a group without
terms is a group; a language with one source has no pairs; rows of one doc_id are documents of their own. An empty table
gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import materialize, shared_dir, slices

#: Lower-cased bytes of terms, 0 for all that lies between them ([\x00-\x40\x5B-\x60\x7B-\x7F]); the scale of frequencies; the largest vocabulary that Spark can name.
PLAIN = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
SCALE = 1_000_000_000
NO_LIMIT = 2**31 - 1
#: A thousandth of all 64-bit hashes.
SAMPLED = np.uint64(2**64 // 1000)
#: Bytes of text that a task counts at a time, words of a row at most, and what words are dealt to for a fit and its sums.
BLOCK, ROW, BUCKETS = 1 << 25, 1 << 14, 256
#: Entries of vectors that a task sums at a time.
ENTRIES = 1 << 20
#: Between language and term; no term holds it.
UNIT = "\x1f"


def words_of(text: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The words of texts without nulls, A-Z lower-cased, and where each text's words begin and the last ones end: taken byte by byte, as no byte of a longer character is below 128."""
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int32)
    data = PLAIN[np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    inside = data > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][np.diff(offsets) > 0]
    first[begins] = inside[begins]  # a text's first word, even where the text before ends in one
    starts = np.flatnonzero(first[inside]).astype(np.int32)
    data = data[inside]
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, np.int32(len(data)))), pa.py_buffer(data))
    return words, np.searchsorted(np.flatnonzero(first), offsets)


def tokens(docs: DataFrame, least: int = 3) -> DataFrame:
    """lang, source, times, words (language, separator and term), fit, bucket, sample: short documents that stand for the real ones, a block at a time.

    With fit = 1 a word is in as many rows as documents of the block and language have it, but in `least` at most: all that
    minDF asks. Such rows hold the words of one bucket by hash. With fit = 0 the rows of a group hold each word once for each
    binary digit of its count in the block, and `times` is what the digit stands for; a group without words has a row too.
    """
    schema = "lang string, source string, times long, words array<string>, bucket int, sample array<long>, fit int"

    def split(batches: Iterator) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text", most_bytes=1 << 22, most_rows=4096):
                words, at = words_of(part["text"])
                held.append((words, np.diff(at), part["lang"].to_pylist(), part["source"].to_pylist()))
                size += part["text"].nbytes
                if size >= BLOCK:
                    yield from block(held)
                    held, size = [], 0
        if held:
            yield from block(held)

    def block(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        coded = pa.concat_arrays([h[0] for h in held]).dictionary_encode()
        terms, codes = coded.dictionary, coded.indices.to_numpy()
        ends = np.cumsum(np.concatenate([h[1] for h in held]))
        groups: dict[str, dict[str, list]] = {}
        at = 0
        for end, lang, source in zip(ends.tolist(), (x for h in held for x in h[2]), (x for h in held for x in h[3]), strict=True):
            groups.setdefault(lang, {}).setdefault(source, []).append(codes[at:end])
            at = end
        held.clear()
        for lang, sources in groups.items():
            yield language(lang, sources, terms)

    def language(lang: str, sources: dict[str, list], terms: pa.Array) -> pa.RecordBatch:
        found, rows, picks = np.zeros(len(terms), np.int32), [], []
        for source, texts in sources.items():
            for text in texts:
                found[text] += 1  # once for all places of a word in it
            every = np.concatenate(texts)
            if 16 * len(every) > len(terms):
                count = np.bincount(every, minlength=len(terms))
                used = np.flatnonzero(count)
                count = count[used]
            else:
                used, count = np.unique(every, return_counts=True)
            for digit in range(max(1, int(count.max(initial=0)).bit_length())):
                pick = used[(count >> digit) & 1 == 1]
                for at in range(0, max(1, len(pick)), ROW):
                    rows.append((source, 1 << digit, None, None, 0))
                    picks.append(pick[at : at + ROW])
        seen = np.flatnonzero(found)
        named = pc.binary_join_element_wise(pa.scalar(lang), terms.take(pa.array(seen)), UNIT)
        hashes = hash_array(np.asarray(named.to_pylist(), object), categorize=False) if len(seen) else np.zeros(0, np.uint64)
        bucket = (hashes % np.uint64(BUCKETS)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        sample = hashes[hashes < SAMPLED].view(np.int64).tolist()
        for n in range(least):
            pick = order[found[seen[order]] > n]
            cuts = np.flatnonzero(np.diff(bucket[pick], prepend=-1))
            for part in np.split(pick, cuts[1:]) if len(pick) else []:
                rows.append((None, 0, int(bucket[part[0]]), sample, 1))
                picks.append(seen[part])
                sample = None
        place = np.zeros(len(terms), np.int64)
        place[seen] = np.arange(len(seen))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, picks)]), pa.int32()), named.take(pa.array(place[np.concatenate(picks)])))
        source, times, of, sample, fit = zip(*rows, strict=True)
        columns = [pa.array([lang] * len(rows)), pa.array(source, pa.string()), pa.array(times, pa.int64()), lists, pa.array(of, pa.int32()), pa.array(sample, pa.list_(pa.int64())), pa.array(fit, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "times", "words", "bucket", "sample", "fit"])

    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return plain.mapInArrow(split, schema)


def distinct_words(words: DataFrame) -> int:
    """About how many: words whose hash lies in the lowest thousandth of all are gathered while the text is split, and counted here."""
    return 1000 * words.where("fit = 1").select(F.explode("sample").alias("h")).agg(F.countDistinct("h")).first()[0]


def counts_by_vectors(words: DataFrame, least: int = 3, part: int = 0) -> DataFrame:
    """lang, source, id, term, count, everywhere, lead of kept terms, from the sparse vectors of CountVectorizer; see summed()."""
    spark = words.sparkSession
    vectorizer = CountVectorizer(inputCol="words", outputCol="vector", minDF=float(least), vocabSize=NO_LIMIT)
    # a fit without any term is an error; two terms of no language keep it whole and are never counted
    nothing = spark.range(least).select(F.array(F.lit(UNIT)).alias("words"))
    # all rows of a bucket in one task: what it sends to the fit's shuffle is a row for each term
    model = vectorizer.fit(words.where("fit = 1").repartition("bucket").select("words").unionByName(nothing))
    path = f"{shared_dir(spark)}/divergence-vocabulary-{uuid.uuid4().hex}"
    model.write().save(path)
    listed = spark.read.parquet(f"{path}/data").select(F.posexplode("vocabulary").alias("index", "name"))
    vectors = model.transform(words.where("fit = 0")).select("lang", "source", "times", F.unwrap_udt("vector").alias("v"))
    sums = summed(group_sums(vectors), listed)
    return sums.withColumn("id", F.lit(part).cast("long") * (1 << 32) + F.col("index")).drop("index")


def group_sums(vectors: DataFrame) -> DataFrame:
    """bucket, langs, sources, group, index, count: the sum of each group's sparse vectors v, each so many times, added up in each task, ENTRIES at a time.

    Rows of tokens() hold a word once, so the values of v are all 1 and only its indices are sent. A row of sums has a bucket of indices and is a sparse matrix: group is a place in langs and sources.
    """

    def add(batches: Iterator) -> Iterator[pa.RecordBatch]:
        numbers: dict[tuple, int] = {}
        held, entries = [], 0
        for b in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
            index, sizes = b["index"].flatten().to_numpy(), b["index"].value_lengths().to_numpy()
            of = np.array([numbers.setdefault(g, len(numbers)) for g in zip(b["lang"].to_pylist(), b["source"].to_pylist(), strict=True)], np.int64)
            held.append(((np.repeat(of, sizes) << 32) | index, np.repeat(b["times"].to_numpy(), sizes)))
            entries += len(held[-1][0])
            if entries >= ENTRIES:
                yield packed(*added(held), list(numbers))
                numbers, held, entries = {}, [], 0
        if entries:
            yield packed(*added(held), list(numbers))

    def packed(keys: np.ndarray, counts: np.ndarray, groups: list[tuple]) -> pa.RecordBatch:
        bucket = (keys & 0xFFFFFFFF) % BUCKETS
        order = np.argsort(bucket, kind="stable")
        keys, counts, bucket = keys[order], counts[order], bucket[order]
        group, index = keys >> 32, (keys & 0xFFFFFFFF).astype(np.int32)
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = np.append(starts[1:], len(keys))
        used, local = [], np.empty(len(keys), np.int32)
        for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
            own, local[lo:hi] = np.unique(group[lo:hi], return_inverse=True)
            used.append(own)
        offsets, named = pa.array(np.append(starts, len(keys)), pa.int32()), pa.array(np.cumsum([0, *map(len, used)]), pa.int32())
        flat = pa.array(np.concatenate(used))
        lists = [pa.ListArray.from_arrays(named, pa.array([g[i] for g in groups], pa.string()).take(flat)) for i in (0, 1)]
        lists += [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (local, index, counts)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32)), *lists], ["bucket", "langs", "sources", "group", "index", "count"])

    flat = vectors.select("lang", "source", "times", F.col("v.indices").alias("index"))
    return flat.mapInArrow(add, "bucket int, langs array<string>, sources array<string>, group array<int>, index array<int>, count array<long>")


def added(held: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys and the sums of their counts."""
    keys, counts = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def summed(parts: DataFrame, listed: DataFrame) -> DataFrame:
    """lang, source, index, term, count, everywhere (the term's count in its language), lead (1 in one row of each term, else 0).

    Rows of group_sums() and names of terms meet by bucket; a task adds up one bucket after another.
    """

    def add(batches: Iterator) -> Iterator[pa.RecordBatch]:
        now, numbers, held, names = None, {}, [], []
        for batch in batches:
            bucket = batch["bucket"].to_numpy()
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=True):
                if bucket[lo] != now:
                    if held:
                        yield bucket_sums(held, list(numbers), names)
                    now, numbers, held, names = bucket[lo], {}, [], []
                part = batch.slice(lo, hi - lo)
                known = part.filter(pc.is_valid(part["name"]))
                if known.num_rows:
                    names.append((known["number"].to_numpy(), known["name"]))
                part = part.filter(pc.is_null(part["name"]))
                for langs, sources, group, index, count in zip(*(part[c] for c in ("langs", "sources", "group", "index", "count")), strict=True):
                    of = np.array([numbers.setdefault(g, len(numbers)) for g in zip(langs.as_py(), sources.as_py(), strict=True)], np.int64)
                    held.append(((index.values.to_numpy().astype(np.int64) << 32) | of[group.values.to_numpy()], count.values.to_numpy()))
        if held:
            yield bucket_sums(held, list(numbers), names)

    def bucket_sums(held: list[tuple], groups: list[tuple], names: list[tuple]) -> pa.RecordBatch:
        keys, counts = added(held)
        index, group = keys >> 32, pa.array(keys & 0xFFFFFFFF)
        first = np.flatnonzero(np.diff(index, prepend=-1))
        lead = np.zeros(len(keys), np.int32)
        lead[first] = 1
        everywhere = np.repeat(np.add.reduceat(counts, first), np.diff(np.append(first, len(keys))))
        numbers = np.concatenate([n for n, _ in names])
        order = np.argsort(numbers)
        name = pa.concat_arrays([n for _, n in names]).take(pa.array(order[np.searchsorted(numbers[order], index)]))
        lang, source = (pa.array([g[i] for g in groups], pa.string()).take(group) for i in (0, 1))
        return pa.RecordBatch.from_arrays([lang, source, pa.array(index.astype(np.int32)), name, pa.array(counts), pa.array(everywhere), pa.array(lead)], ["lang", "source", "index", "term", "count", "everywhere", "lead"])

    terms = listed.select((F.col("index") % BUCKETS).alias("bucket"), F.col("index").alias("number"), F.substring_index("name", UNIT, -1).alias("name"))
    rows = parts.unionByName(terms, allowMissingColumns=True).repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(add, "lang string, source string, index int, term string, count long, everywhere long, lead int")


def term_counts(words: DataFrame, least: int = 3, most_terms: int = 4_000_000) -> DataFrame:
    """The counts of all terms, by as many fits as keep each vocabulary under most_terms: a term's hash names its fit."""
    parts = -(-int(1.1 * distinct_words(words)) // most_terms)  # near the bound the estimate is within a few hundredths, and not all terms are kept
    if parts <= 1:
        return counts_by_vectors(words, least)
    each = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    rest = ("lang", "source", "times", "bucket", "fit", "part")
    dealt = words.select("words", *rest[:-1], each).select(F.expr(f"filter(words, w -> pmod(xxhash64(w), {parts}) = part)").alias("words"), *rest)
    dealt = materialize(dealt.where(F.size("words") > 0), "divergence-parts", "part", "fit")
    out = counts_by_vectors(dealt.where("part = 0"), least)
    for part in range(1, parts):
        out = out.unionByName(counts_by_vectors(dealt.where(F.col("part") == part), least, part))
    return out


def frequency(count: Column, total: Column, terms: Column) -> Column:
    """In billionths, of whole numbers of any size; 1 where there are no terms at all."""
    among = F.nullif(total + terms, F.lit(0).cast("long"))
    up = F.call_function("div", (count + 1) * F.lit(SCALE).cast("long"), among)
    large = F.call_function("div", (count.cast("decimal(20,0)") + 1) * F.lit(SCALE).cast("decimal(10,0)"), among.cast("decimal(20,0)"))
    return F.lit(1).cast("long") + F.coalesce(F.when(count < SCALE, up).otherwise(large), F.lit(0).cast("long"))


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, least: int = 3, top: int = 200, most_terms: int = 4_000_000) -> DataFrame:
    """lang, source, part, item, value, rank."""
    words = materialize(tokens(docs, least), "divergence-words", "fit")
    groups = words.where("fit = 0").select("lang", "source").distinct()
    counts = materialize(term_counts(words, least, most_terms), "divergence-counts")
    zero = F.lit(0).cast("long")
    sums = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("own"), F.sum("lead").alias("lead"))
    langs = sums.groupBy("lang").agg(F.sum("lead").alias("terms"), F.sum("total").alias("all"))
    known = groups.join(langs, "lang", "left").join(sums.drop("lead"), ["lang", "source"], "left")
    known = known.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("terms", "all", "total", "own")])
    # one row for each group: what it has of a term that it does not use
    known = materialize(known.withColumn("none", frequency(zero, F.col("total"), F.col("terms"))), "divergence-groups")
    at = counts.join(known, ["lang", "source"]).withColumn("p", frequency(F.col("count"), F.col("total"), F.col("terms")))
    return _pairs(known, at).unionByName(_terms(at, top))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _terms(at: DataFrame, top: int) -> DataFrame:
    both = at.withColumn("q", frequency(F.col("everywhere"), F.col("all"), F.col("terms")))
    more = both.where("p > q").select("lang", "source", F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))
    return _ranked(more, "term").where(F.col("rank") <= top)


def _pairs(known: DataFrame, at: DataFrame) -> DataFrame:
    """Of two sources the terms that either has, taken as if the other had none of them; then all others; then what both have is put right."""
    a = known.select("lang", F.col("source").alias("a"), F.col("none").alias("none_a"), F.col("own").alias("own_a"), "terms")
    b = known.select("lang", F.col("source").alias("b"), F.col("none").alias("none_b"), F.col("own").alias("own_b"))
    pairs = a.join(b, "lang").where("a <> b")
    neither = pairs.select("lang", "a", "b", ((F.col("terms") - F.col("own_a") - F.col("own_b")) * difference(F.col("none_a"), F.col("none_b"))).alias("value"))
    uses = at.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times"))
    one = uses.withColumnRenamed("source", "a").join(b, "lang").where("a <> b").select("lang", "a", "b", (F.col("times") * difference(F.col("p"), F.col("none_b"))).alias("value"))
    other = uses.withColumnRenamed("source", "b").join(a, "lang").where("a <> b").select("lang", "a", "b", (F.col("times") * difference(F.col("none_a"), F.col("p"))).alias("value"))
    # both sides are alike up to their names, so they are one exchange
    x, y = (at.select("lang", "id", F.col("source").alias(n), F.col("p").alias(f"p_{n}"), F.col("none").alias(f"none_{n}")) for n in ("a", "b"))
    p, q, p0, q0 = (F.col(c) for c in ("p_a", "p_b", "none_a", "none_b"))
    right = difference(p, q) - difference(p, q0) - difference(p0, q) + difference(p0, q0)
    both = x.join(y, ["lang", "id"]).where("a <> b").groupBy("lang", "a", "b").agg(F.sum(right).alias("value"))
    parts = neither.unionByName(one.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))).unionByName(other.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))).unionByName(both)
    summed = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    return _ranked(summed.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value"), "pair")
