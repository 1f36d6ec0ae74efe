"""Every operator against brute force on awkward documents, and on an empty table."""

from __future__ import annotations

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from claimloom.llm import bitpack, fingerprints, line_dedup, line_quality, lm_score, mixing, ngram_join, packing, substring
from claimloom.llm.common import mix
from claimloom.llm.components import components
from tests.llm import awkward

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\x0c\r"
MAX = 2**63 - 1
ROWS = [(r[0], r[1] or "") for r in awkward.rows()]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def same(found, expected) -> None:
    assert Counter(map(tuple, found)) == Counter(map(tuple, expected))


def test_fingerprints(spark):
    got = fingerprints.edit_likeness(awkward.table(spark)).collect()
    order = sorted(ROWS, key=lambda r: r[1].encode())
    order.sort(key=lambda r: -(2**63) if r[0] is None else r[0], reverse=True)
    expected = []
    for i, (doc_id, text) in enumerate(order):
        following, cut = order[(i + 1) % len(order)][1], len(text) // 3
        expected.append((doc_id, len(text), sha(text[: len(text) - cut] + following[:cut])))
    same([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], expected)
    by_text = defaultdict(set)
    texts = {(r[0], len(r[1])): r[1] for r in ROWS}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text[texts[r.doc_id, r.n_chars]].add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    assert fingerprints.edit_likeness(awkward.empty(spark)).count() == 0


def test_fingerprint_follows_order_and_edits():
    make = fingerprints.OrderMinHash()
    words = [f"word{i}" for i in range(300)]
    text = " ".join(words)
    near = fingerprints.likeness(make.sign(text), make.sign(" ".join(words[:290] + ["new"] * 10)))
    moved = fingerprints.likeness(make.sign(text), make.sign(" ".join(words[150:] + words[:150])))
    assert fingerprints.likeness(make.sign(text), make.sign(text)) == 1
    assert near > 0.7 > moved > fingerprints.likeness(make.sign(text), make.sign(text[::-1]))
    assert fingerprints.likeness(make.sign(""), make.sign("")) == 1 and fingerprints.likeness(make.sign(""), make.sign("a")) == 0


def plain_order_minhash(make, text: str) -> list[tuple]:
    """Of each sketch the selected (k-mer, occurrence) in order of place, with ids made one by one from whole hashes."""
    mask, had, ids, k = 2**64 - 1, Counter(), [], min(make.k, len(text))
    for i in range(len(text) - k + 1):
        h = 0
        for c in text[i : i + k]:
            h = (h * int(fingerprints.GOLDEN) + ord(c)) & mask
        h = int(fingerprints.mix(np.array([h], np.uint64))[0])
        ids.append(int(fingerprints.mix(np.array([(h + had[h] * int(fingerprints.GOLDEN)) & mask], np.uint64))[0]))
        had[h] += 1
    out = []
    for flip, times in zip(make.flip[:, 0], make.times[:, 0], strict=True):
        least = sorted(range(len(ids)), key=lambda i: ((ids[i] ^ int(flip)) * int(times)) & mask)[: make.l]
        out.append(tuple(ids[i] for i in sorted(least)))
    return out


def test_fingerprint_does_not_depend_on_length():
    """Near copies whose numbers of k-mers lie on either side of a power of two."""
    draw, make = np.random.default_rng(8), fingerprints.OrderMinHash()
    text = "".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz "), 1035))
    plain = np.mean([a == b for a, b in zip(plain_order_minhash(make, text[:1020]), plain_order_minhash(make, text), strict=True)])
    assert fingerprints.likeness(make.sign(text[:1020]), make.sign(text)) == plain > 0.85


@pytest.mark.parametrize("text", ["abc", "ab" * 300, "to be or not to be " * 9 + "that is the question"])
def test_fingerprint_is_plain_order_minhash(text):
    make, out = fingerprints.OrderMinHash(), []
    for ids in plain_order_minhash(make, text):
        h = np.zeros(1, np.uint64)
        for i in ids:
            h = fingerprints.mix(h + np.uint64(i))
        out.append((int(h[0]) >> 32) | 1)
    assert list(make.sign(text)) == out


def test_fingerprint_chunks_do_not_matter(monkeypatch):
    text = " ".join(f"w{i * i % 977}" for i in range(4000))
    whole = fingerprints.OrderMinHash().sign(text)
    monkeypatch.setattr(fingerprints, "CHUNK", 977)
    assert (whole == fingerprints.OrderMinHash().sign(text)).all()


@pytest.mark.parametrize("width", [1, 3, 7, 16, 17, 31])
def test_packing_bits_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 2**width, 1001).astype("<u4")
    assert (bitpack.unpack(bitpack.pack(ids, width), len(ids), width) == ids).all()


def test_packed_file_random_access(tmp_path):
    uri = f"file://{tmp_path}/x.ids"
    draw = np.random.default_rng(0)
    docs = [draw.integers(0, 49408, n).astype("<u4") for n in (0, 1, 9000, 4096, 3, 70000)]
    writer = bitpack.Writer(uri, 49408)
    for i, ids in enumerate(docs):
        writer.add(i, ids)
    assert writer.close() == (6, sum(map(len, docs)))
    reader = bitpack.Reader(uri)
    assert reader.about["width"] == 16
    assert all((reader.document(i) == d).all() for i, d in enumerate(docs))
    whole = np.concatenate(docs)
    assert all((reader.ids(a, b) == whole[a:b]).all() for a, b in ((5, 6), (4095, 4097), (100, 80000), (7, 7)))


def test_bit_packed_ids(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = bitpack.read_packed(bitpack.write_packed(awkward.table(spark), path, 1)).collect()
    tokenizer, expected, at = Tokenizer.from_file(path), [], 0
    for doc_id, text in sorted(ROWS, key=lambda r: (MAX if r[0] is None else r[0], r[1].encode())):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        expected.append((doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    same(got, expected)
    assert bitpack.read_packed(bitpack.write_packed(awkward.empty(spark), path, 1)).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_frequent_pieces_are_merged_once_whatever_rare_ones_come(name):
    from claimloom.llm.tokenize import Encoder

    path = public_tokenizers.path(name)
    encoder, tokenizer, merged = Encoder(path, keep=60), Tokenizer.from_file(path), []
    merge = encoder.pieces.merge
    encoder.pieces.merge = lambda letters: merged.append(letters) or merge(letters)
    marks = ["", "it's  'll\n\n x", " 's  'S''s", "Ünï çÀ\n \n", "a 12 3,4 !?'d  ", " \nö'vex 've"]
    for i in range(600):
        text = f"and the {chr(97 + i % 26)}{chr(97 + i // 26)}qz, the {marks[i % 6]} the"
        assert encoder.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert sum(letters.lstrip("Ġ") == "the" for letters in merged) <= 2
    assert len(encoder.pieces) <= 60


def test_files_of_another_kind_go_through_the_whole_tokenizer(tmp_path):
    import json

    from claimloom.llm.tokenize import Encoder

    shape = json.loads(open(public_tokenizers.path("byte_bpe_50k.json")).read())
    assert Encoder(public_tokenizers.path("byte_bpe_50k.json")).known and Encoder(public_tokenizers.path("word_bpe_49k.json")).known
    shape["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "other.json").write_text(json.dumps(shape))
    made = Encoder(str(tmp_path / "other.json"))
    text = "Some Text of ANY kind, 12 lines"
    assert not made.known and list(made.encode(text)) == Tokenizer.from_file(str(tmp_path / "other.json")).encode(text, add_special_tokens=False).ids


def shingle_set(text: str) -> frozenset:
    words = text.lower().encode().split()
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def alike(a: frozenset, b: frozenset) -> bool:
    return a == b or 10 * len(a & b) >= 8 * len(a | b)


def test_ngram_join(spark):
    sets = [(i, shingle_set(t)) for i, t in ROWS]
    links, root = [0] * len(sets), list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if alike(sets[a][1], sets[b][1]):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = defaultdict(lambda: MAX)
    for i, (doc_id, _) in enumerate(sets):
        least[find(i)] = min(least[find(i)], MAX if doc_id is None else doc_id)
    expected = [(doc_id, None if least[find(i)] == MAX else least[find(i)], links[i]) for i, (doc_id, _) in enumerate(sets)]
    got = ngram_join.join_report(awkward.table(spark), tile=4).select("doc_id", "class_id", "n_links").collect()
    same(got, expected)
    assert ngram_join.join_report(awkward.empty(spark)).count() == 0


def test_keep_one_of_each_class(spark):
    docs = awkward.table(spark)
    got = ngram_join.keep_one(docs)
    assert got.columns == docs.columns
    kept = [r.doc_id for r in got.collect()]
    report = ngram_join.join_report(docs).collect()
    assert Counter(k for k in kept if k is not None) == Counter({r.class_id for r in report if r.class_id is not None})
    assert kept.count(None) == 1 and not {54, 55, 56, 61, 62} & set(kept)
    assert ngram_join.keep_one(awkward.empty(spark)).count() == 0


def test_ids_do_not_hide_texts(spark):
    """Unlike texts of one id keep their own links, null ids are linked, and one row of each class stays."""
    near = lambda p, own: " ".join([f"{p}{i}" for i in range(99)] + [own])
    rows = [(7, near("a", "x")), (7, near("b", "x")), (8, near("a", "y")), (9, near("b", "y")), (None, near("c", "x")), (None, near("c", "y")), (None, near("b", "z"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.join_report(docs).select("doc_id", "class_id", "n_links").collect()
    same(got, [(7, 7, 1), (7, 7, 2), (8, 7, 1), (9, 7, 2), (None, None, 1), (None, None, 1), (None, 7, 2)])
    kept = ngram_join.keep_classes(docs).collect()
    assert Counter((r.doc_id, r.text[0]) for r in kept) == Counter([(7, "a"), (7, "b"), (None, "c")])


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    awkward.table(spark).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    after = {r.doc_id for r in docs.collect()}
    assert after <= before and set(range(40)) <= after and not {54, 55, 56, 60, 61, 62, 63, 66} & after
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == len(after)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    awkward.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() == 0


def test_depths_and_recall():
    assert ngram_join.least_depth(0.8, 20, 0.9995, 10) == 5
    assert 1 - (1 - 0.8**5) ** 20 >= 0.9995 > 1 - (1 - 0.8**6) ** 20
    assert ngram_join.recall({}, 8, 20) == 0
    assert math.isclose(ngram_join.recall({200: 10}, 8, 20), 1)
    assert math.isclose(ngram_join.recall({160: 10}, 8, 20), 1 - (1 - 0.8**8) ** 20)


def near_copies(n: int, seed: int) -> list[tuple]:
    """Texts in groups whose members differ by a few words from a common one, so that similarities spread around the threshold."""
    draw, out = np.random.default_rng(seed), []
    for g in range(n):
        base = [f"w{g}x{i}" for i in range(150)]
        for _ in range(8):
            words = list(base)
            for at in draw.choice(150, int(draw.integers(0, 5)), replace=False):
                words[at] = f"own{draw.integers(10**9)}"
            out.append((len(out), " ".join(words)))
    return out


def test_the_forest_shortens_until_the_target_and_finds_the_pairs(spark):
    """Recall measured against brute force; a lower target ends at longer prefixes, one that needs them goes on to the last depth."""
    rows = near_copies(40, 1)
    sets = [shingle_set(t) for _, t in rows]
    links = sum(alike(sets[a], sets[b]) for a in range(len(rows)) for b in range(max(0, a - 8), a))
    docs, ends = spark.createDataFrame(rows, "doc_id long, text string"), {}
    for target in (0.5, 0.99, 0.9995):
        forest = ngram_join.Forest(target=target)
        signed = ngram_join._sets(docs, forest)
        got = sum(r.n_links for r in ngram_join.join_report(docs, forest).collect()) / 2
        classes = signed.dropDuplicates(["set_1", "set_2"]).selectExpr("doc_id as rep", "doc_id as id", "text_key as rep_key", "1L as copies", "shingles", "signature")
        _, ends[target], estimate = ngram_join.linked(docs, classes, forest)
        assert got / links >= min(target, 0.999) - 0.02 and abs(estimate - got / links) < 0.05, (target, got, links, estimate)
    assert ends[0.5] == 8 and ends[0.5] >= ends[0.99] >= ends[0.9995] >= 5 and ends[0.9995] < 8


def test_large_group_of_near_copies(spark):
    """A group over many tiles: every member links to every other."""
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:100] + [f"own{i}"] + base[101:])) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for piece in (ngram_join.PIECE, 5000):  # in one piece, and in many
        got = ngram_join.join_report(docs, tile=32, piece=piece).collect()
        assert {(r.class_id, r.n_links) for r in got} == {(0, 149)}


def test_pieces_of_a_tile_give_what_whole_sets_give():
    draw = np.random.default_rng(8)
    base = draw.integers(0, 2**64, 300, np.uint64)
    sets = [np.unique(np.concatenate([base[draw.random(300) < keep], draw.integers(0, 2**64, 5, np.uint64)])) for keep in draw.uniform(0.85, 1, 40)] + [base[:0], base[:1]]
    forest = ngram_join.Forest()
    members = [(i % 2, i, 1 + i % 3, forest.sign(s)) for i, s in enumerate(sets)]
    bounds = [0, *(2**64 * i // 7 for i in range(1, 7)), 2**64]
    pieces = [[np.array([v for v in s if lo <= int(v) < hi], np.uint64) for s in sets] for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
    whole = ngram_join.verify(members, [sets], 0, forest.longest, forest)
    assert whole and ngram_join.verify(members, pieces, 0, forest.longest, forest) == whole


def test_memory_of_a_tile_of_long_texts():
    """1,024 near copies of 20,000 shingles, 160 MB of sets, in the pieces that a join makes of them: under 200 MB."""
    base = mix(np.arange(20_000, dtype=np.uint64))
    forest, n = ngram_join.Forest(), 1024
    signature = forest.sign(base)
    count = -(-8 * len(base) * n // ngram_join.PIECE)
    part = np.sort(base) // np.uint64(2**64 // count + 1)
    ordered = np.sort(base)

    def pieces():
        for k in range(count):
            mine = ordered[part == k]
            yield [np.concatenate([mine, mix(np.arange(i, i + 1, dtype=np.uint64) + np.uint64(10**6 * (k + 1)))]) for i in range(n)]

    tracemalloc.start()
    found = ngram_join.verify([(0, i, 1, signature) for i in range(n)], pieces(), 0, forest.longest, forest)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {r[1] for r in found if r[0] is not None} == {n - 1} and peak < 200 << 20, peak


def line_key(line: str) -> str:
    return line.strip(SPACE).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def expected_lines(rows):
    held = defaultdict(set)
    for doc_id, text in rows:
        if doc_id is not None:
            for line in text.split("\n"):
                held[line_key(line)].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = text.split("\n")
        lost = lambda k, d=doc_id: d is not None and len(k) >= 10 and len(held[k]) > 1 and min(held[k]) != d
        kept = [x for x in lines if not lost(line_key(x))]
        out.append((doc_id, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def test_line_dedup(spark):
    more = [(90, "With Two Lines\nA repeated ROW that is long enough \nshort\nshort"), (91, "short\n\twith two lines")]
    docs = awkward.table(spark).select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    same(line_dedup.line_report(docs).collect(), expected_lines(ROWS + more))
    assert line_dedup.line_report(awkward.empty(spark)).count() == 0


def test_clean_drops_the_lines_and_empty_texts(spark):
    docs = awkward.table(spark)
    got = line_dedup.clean(docs)
    assert got.columns == docs.columns
    held = defaultdict(set)
    for doc_id, text in ROWS:
        if doc_id is not None:
            for line in text.split("\n"):
                held[line_key(line)].add(doc_id)
    expected = []
    for row in awkward.rows():
        doc_id, text = row[:2]
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc_id is None or len(line_key(x)) < 10 or len(held[line_key(x)]) < 2 or min(held[line_key(x)]) == doc_id]
        if len(kept) == len(lines):
            expected.append(row)
        elif "\n".join(kept).strip():
            expected.append((doc_id, "\n".join(kept), *row[2:]))
    same(got.collect(), expected)
    assert line_dedup.clean(awkward.empty(spark)).count() == 0


def test_line_index_is_reversible(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    first = [(i, f"line number {i % 5} of all\nanother line {i}") for i in range(20)]
    second = [(i, f"line number {i % 7} of all\nanother line {i - 3}") for i in range(20, 45)]
    one = line_dedup.LineIndex(spark, shards=3).insert(make(first))
    both = one.insert(make(second))
    fresh = line_dedup.LineIndex(spark, shards=3).insert(make(first + second))
    state = lambda x: sorted((r.shard, bytes(r.key), r.doc_id) for r in x.refs().collect())
    owners = lambda x: sorted((bytes(r.key), r.owner) for r in x.owners().collect())
    count = lambda x: {r.shard: r["keys"] for r in x.filters.collect()}
    assert state(both) == state(fresh) and owners(both) == owners(fresh)
    back = both.delete(make(second).select("doc_id"))
    assert state(back) == state(one) and count(back) == count(one)
    again = back.insert(make(second))
    assert state(again) == state(both) and count(again) == count(both)
    lost = lambda x: sorted((r.doc_id, bytes(r.key)) for r in x.lost.collect())
    assert lost(again) == lost(both) and lost(both)
    without = both.delete(make(first[:3]).select("doc_id"))
    assert owners(without) == owners(line_dedup.LineIndex(spark, shards=3).insert(make(first[3:] + second)))


def test_the_filters_decide_what_is_looked_up(spark):
    """With emptied filters the lines of earlier batches are not found: the result comes through the filters."""
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    one = line_dedup.LineIndex(spark, shards=2).insert(make([(1, "a line that is long enough\nsecond line of the text")]))
    batch = make([(2, "a line that is long enough"), (3, "a line of its own here")])
    assert [r.doc_id for r in one.insert(batch).lost.collect()] == [2]
    emptied = line_dedup.LineIndex(spark, 2, one.segments, one.filters.limit(0))
    assert emptied.insert(batch).lost.count() == 0


def test_cuckoo_filter():
    draw = np.random.default_rng(2)
    hashes = draw.integers(0, 2**64, 20_000, np.uint64)
    made = line_dedup.CuckooFilter.of(hashes[:12_000], room=2)
    assert made.insert(hashes[12_000:])
    assert made.contains(hashes).all() and made.count == len(hashes)
    assert made.contains(draw.integers(0, 2**64, 20_000, np.uint64)).mean() < 0.01
    made.delete(hashes[:10_000])
    assert made.contains(hashes[10_000:]).all() and made.count == 10_000 and made.contains(hashes[:10_000]).mean() < 0.01
    tight = line_dedup.CuckooFilter.of(hashes)
    assert tight.contains(hashes).all() and tight.count == len(hashes)


def test_residual_packing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack_documents(awkward.table(spark), path).collect()
    expected = Counter()
    for doc_id, text in ROWS:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        at, size, number = 0, (len(ids) - 1) % 1024 + 1, 0
        while at < len(ids):
            expected[doc_id, number, at, size, crc(ids[at : at + size])] += 1
            at, size, number = at + size, 1024, number + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    check_bins([(r.sequence_id, r.offset, r.length) for r in got], 1024)
    assert packing.pack_documents(awkward.empty(spark), path).count() == 0


def check_bins(placed, capacity):
    bins = defaultdict(list)
    for b, offset, length in placed:
        bins[b].append((offset, length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_merges_groups(spark):
    """Many groups that each leave underfull bins come close to the least number of bins."""
    sizes = np.random.default_rng(4).integers(1, 400, 3000)
    parts = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "item long, length long")
    got = packing.pack(parts, 1024, group=50).collect()
    assert len({r.item for r in got}) == 3000
    n = check_bins([(r.sequence_id, r.offset, r.length) for r in got], 1024)
    assert n <= -(-int(sizes.sum()) // 1024) * 1.01 + 1


def test_weights_of_the_mix_order_the_sequences(spark, tmp_path, monkeypatch):
    """With other weights the packing stage gives another order of sequences, whatever files and order its documents come in."""
    import corpus_pipeline

    draw = np.random.default_rng(2)
    rows = [(i, " ".join(str(x) for x in draw.integers(0, 999, 60)), "en", "ab"[i % 2]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    early, monkeyed = {}, dict(corpus_pipeline.MIX, block=4)
    whole = packing.pack_mixed
    monkeypatch.setattr(packing, "pack_mixed", lambda *a, **k: whole(*a, **{**k, "group": 40}))
    for name, weights, n in (("a", {"a": 9, "b": 1}, 1), ("a again", {"a": 9, "b": 1}, 7), ("b", {"a": 1, "b": 9}, 1)):
        monkeypatch.setattr(corpus_pipeline, "MIX", {**monkeyed, "weights": weights})
        got = corpus_pipeline.packed(spark, docs.repartition(n), "").collect()
        assert Counter(r.doc_id for r in got) == Counter(range(400))
        n_bins = check_bins([(r.sequence_id, r.offset, r.length) for r in got], 1024)
        assert {r.sequence_id for r in got} == set(range(n_bins))
        early[name] = Counter("ab"[r.doc_id % 2] for r in got if r.sequence_id < n_bins // 4)
    assert early["a"]["a"] > 0.8 * early["a"].total() and early["b"]["b"] > 0.8 * early["b"].total()
    assert early["a again"]["a"] > 0.8 * early["a again"].total()


@pytest.mark.parametrize("weights", [{"a": 3, "b": 2, "c": 1}, {"a": 7, "b": 1, "c": 1}, {"a": 5, "b": 4, "c": 4, "d": 3, "e": 1}])
def test_pfair_mix_stays_within_a_block(spark, weights):
    total, periods, block = sum(weights.values()), 3, 2
    rows = [(i, "t", s) for s, w in weights.items() for i in range(w * periods * block)]
    docs = spark.createDataFrame([(n, t, s) for n, (_, t, s) in enumerate(rows)], "doc_id long, text string, source string")
    got = sorted(mixing.mix(docs, weights, block=block, bucket_rows=5).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(rows))) and len({r.doc_id for r in got}) == len(rows)
    had = Counter()
    slots = sorted({(r.slot, r.source) for r in got})
    assert [s for s, _ in slots] == list(range(total * periods))
    for n, (_, source) in enumerate(slots, 1):
        had[source] += 1
        assert all(abs(had[s] - n * w / total) < 1 for s, w in weights.items())


def plain_schedule(weights: dict[str, int]) -> list[tuple[int, int]]:
    """One period slot by slot: of the released blocks of each class of equal weights the one due first, then the least weight."""
    share, total = Counter(), sum(weights.values())
    for w in weights.values():
        share[w] += w
    had, out = Counter(), []
    for slot in range(total):
        open_ = [w for w in sorted(share) if had[w] * total // share[w] <= slot]
        w = min(open_, key=lambda w: (-(-(had[w] + 1) * total // share[w]), w))
        out.append((w, had[w]))
        had[w] += 1
    return out


@pytest.mark.parametrize("weights", [{"a": 3, "b": 2, "c": 1}, {"a": 7, "b": 1, "c": 1}, {"a": 5, "b": 4, "c": 4, "d": 3, "e": 1}, {f"s{i:03}": 1 + i % 7 for i in range(300)}])
def test_schedule_is_earliest_deadline_first(spark, weights):
    share = Counter()
    for w in weights.values():
        share[w] += w
    got = mixing.schedule(spark.createDataFrame(list(share.items()), "weight long, share long")).collect()
    assert [(r.weight, r.turn) for r in sorted(got, key=lambda r: r.slot)] == plain_schedule(weights)


def test_mix_slots_against_a_plain_schedule(spark):
    """Also after sources have run out: every block keeps its slot, and positions close the gaps."""
    weights, rows = {"a": 3, "b": 2, "c": 2, "d": 1}, {"a": 20, "b": 3, "c": 11, "d": 9}
    docs = spark.createDataFrame([(i, f"{s}{i}", s) for s, n in rows.items() for i in range(n)], "doc_id long, text string, source string")
    got = mixing.mix(docs, weights, block=2, bucket_rows=4).collect()
    like, period = defaultdict(list), plain_schedule(weights)
    for s in sorted(weights):
        like[weights[s]].append(s)
    slots = {}
    for n in range(40):
        w, turn = period[n % len(period)]
        each = like[w]
        of_class = n // len(period) * w * len(each) + turn
        slots[each[of_class % len(each)], of_class // len(each)] = n
    assert all(r.slot == slots[r.source, r.block] and r.block == r.source_rank // 2 for r in got)
    order = sorted(got, key=lambda r: (r.slot, r.source_rank))
    assert [r.position for r in order] == list(range(len(got))) == sorted(r.position for r in got)


def test_mix_of_many_sources(spark):
    """2,000 sources without a weight of their own and of unlike sizes: one period, no phase for each that runs out."""
    from pyspark.sql import functions as F

    docs = spark.range(2000).select(F.explode(F.sequence(F.lit(0), F.col("id") % 7)).alias("n"), F.col("id").cast("string").alias("source"))
    docs = docs.select(F.xxhash64("n", "source").alias("doc_id"), F.lit("t").alias("text"), "source")
    got = mixing.mix(docs, {"5": 3, "7": 2}, block=1).collect()
    n = docs.count()
    assert sorted(r.position for r in got) == list(range(n))
    total = 2000 + 2 + 1
    had = Counter()
    for r in sorted(got, key=lambda r: r.slot)[:1900]:
        assert r.slot < total
        had[r.source] += 1
    assert max(had.values()) <= 3


def test_mix_keeps_every_row(spark):
    docs = awkward.table(spark)
    got = mixing.mix(docs, {"a": 3}, default=1, block=2).collect()
    same([(r.doc_id, r.source) for r in got], [(r[0], r[3]) for r in awkward.rows()])
    assert sorted(r.position for r in got) == list(range(len(got)))
    assert Counter(mixing.in_mixed_order(docs, weights={"a": 3}).collect()) == Counter(docs.collect())
    assert mixing.mix(awkward.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": 0})


def test_word_hashes():
    from claimloom.llm.common import word_hashes

    texts = ["to be\x0bor not", "", "é\u00a0x to", "be " * 50, "x" * 300 + " to"]
    for most in (8, 1 << 21):
        got, of = word_hashes(texts, most)
        words = [(i, w) for i, t in enumerate(texts) for w in t.encode().split()]
        assert list(of) == [i for i, _ in words]
        by = defaultdict(set)
        for (_, w), h in zip(words, got, strict=True):
            by[w].add(h)
        assert all(len(h) == 1 for h in by.values()) and len(set().union(*by.values())) == len(by)


def plain_scores(order: int, leave_out: bool, alpha: float = 0.4) -> list[tuple]:
    words = [(i, t.encode().split()) for i, t in ROWS]
    each = [Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)) for _, w in words]
    counts, total, out = sum(each, Counter()), sum(len(w) for _, w in words), []
    for (doc_id, w), own in zip(words, each, strict=True):
        left = lambda g, own=own: counts[g] - (own[g] if leave_out else 0)
        score = 0.0
        for i in range(len(w)):
            top = min(order, i + 1)
            n = next((n for n in range(top, 0, -1) if left(tuple(w[i - n + 1 : i + 1])) > 0), 0)
            if n > 1:
                score += math.log(left(tuple(w[i - n + 1 : i + 1])) / left(tuple(w[i - n + 1 : i])))
            else:
                score += math.log(max(left((w[i],)), 1) / (total - (len(w) if leave_out else 0)))
            score += (top - max(n, 1)) * math.log(alpha)
        out.append((doc_id, len(w), round(score, 5)))
    return out


@pytest.mark.parametrize(("order", "leave_out"), [(1, True), (2, True), (3, True), (3, False)])
def test_stupid_backoff(spark, order, leave_out):
    got = lm_score.score(awkward.table(spark), order=order, leave_out=leave_out, passes=2).collect()
    same([(r.doc_id, r.n_words, round(r.log_score, 5)) for r in got], plain_scores(order, leave_out))


def test_stupid_backoff_rows(spark):
    """Parts and first places against plain n-grams; repeated rows count once, and parts that are not found weigh nothing."""
    text = "a b a b c a b"
    docs = spark.createDataFrame([(1, text), (2, "a b"), (2, "a b")], "doc_id long, text string")
    rows = [r for part in range(3) for r in lm_score.grams(docs, 3, part, 3).where("order_id = 1").collect()]
    words, first, want = text.split(), {}, Counter()
    for n in (1, 2, 3):
        for i in range(len(words) - n + 1):
            first.setdefault(tuple(words[i : i + n]), i * 3 + n - 1)
            want[tuple(words[i : i + n])] += 1
    same([(r.at, r.own, r.head, r.tail, r.middle) for r in rows], [(first[g], k, first.get(g[:-1], -1), first.get(g[1:], -1), first.get(g[1:-1], -1)) for g, k in want.items()])
    found = spark.createDataFrame([(1, 7, 1, 2, 3, 0, 3, -1), (1, 7, 0, 3, 5, -1, -1, -1), (1, 7, 0, 3, 5, -1, -1, -1)], "order_id long, text_key long, at int, own int, times int, head int, tail int, middle int")
    got = lm_score.summed(found, 3).collect()
    same([(r.order_id, round(r.log_sum, 9), r.twos, r.longer) for r in got], [(1, round(2 * math.log(3) + (6 - 2) / 2 * math.log(5), 9), 2.0, 2.0)])


def test_stupid_backoff_of_many_blocks(spark):
    """Blocks and buckets change no score, rows give the same, and a block sends a common word once."""
    got = lm_score.score(awkward.table(spark), passes=3, block_bytes=500, bucket_grams=40).collect()
    same([(r.doc_id, r.n_words, round(r.log_score, 5)) for r in got], plain_scores(3, True))
    same([(r.doc_id, r.n_words, round(r.log_score, 5)) for r in lm_score.score_by_rows(awkward.table(spark), passes=2).collect()], plain_scores(3, True))
    docs = spark.range(90).selectExpr("id % 3 as block", "concat('the the ', id) as text")
    told = [r for part in range(2) for r in lm_score.answered(docs, 1, part, 2, 4).collect()]
    counts = [lm_score.unpacked(r.counts).tolist() for r in told]
    assert len(told) <= 3 * 8 and sum(r.words for r in told) == 270
    assert sorted(sum(counts, [])) == [1] * 90 + [180] * 3


def test_stupid_backoff_query(spark, tmp_path):
    from claimloom.llm.queries import QUERIES

    awkward.table(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op7_stupid_backoff"](spark, str(tmp_path)).collect()
    same([(r.doc_id, r.n_words, round(r.log_score, 5)) for r in got], plain_scores(3, True))
    assert lm_score.score(awkward.empty(spark)).count() == 0


def test_components_of_a_long_path_with_large_ids(spark):
    ids = [2**62 + 7 * i for i in range(40)]
    edges = spark.createDataFrame([*zip(ids, ids[1:]), (5, 5), (9, 8)], "a long, b long")
    assert {(r.node, r.root) for r in components(edges).collect()} == {(i, ids[0]) for i in ids} | {(9, 8), (8, 8)}


def test_quality_rules(spark):
    got = line_quality.quality(awkward.table(spark), most_docs=10).collect()
    expected = []
    for doc_id, text in ROWS:
        w = WORD.findall(text)
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {p for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        expected.append((doc_id, len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)))
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got], expected)
    assert all(r.kept == (not r.base_failed) for r in got)
    assert line_quality.quality(awkward.empty(spark)).count() == 0


def test_frequent_lines_deplete(spark):
    unique = lambda i: " ".join("abcdefghijklmno"[i] + "uvwxyzabcdefghi"[j] for j in range(15))
    common = "This line 7 stands on every page of the host"
    rows = [(i, f"{common}\n{unique(i)}", "h") for i in range(12)] + [(20, "\n".join([common.replace("7", "8")] * 3 + ["five more words stand here"]), "h"), (21, f"{common}\nshort of ten", "other")]
    got = {r.doc_id: r for r in line_quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string"), most_docs=10, most_share=0.1).collect()}
    assert all(got[i].kept and got[i].n_frequent_line_words == 10 for i in range(12))
    assert not got[20].kept and got[20].n_frequent_line_words == 30
    assert got[21].n_frequent_line_words == 0 and got[21].kept


@pytest.mark.parametrize(("window", "gram"), [(50, 20), (8, 3)])
def test_winnowed_repeats(spark, window, gram):
    rows = [(i, t.encode().split()) for i, t in ROWS]
    least: dict = {}
    for doc_id, w in rows:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, MAX), MAX if doc_id is None else doc_id)
    expected = []
    for doc_id, w in rows:
        gone = {p for i in range(len(w) - window + 1) if least[tuple(w[i : i + window])] < (MAX if doc_id is None else doc_id) for p in range(i, i + window)}
        expected.append((doc_id, len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()))
    same(substring.remove_repeats(awkward.table(spark), window, gram).collect(), expected)
    assert substring.remove_repeats(awkward.empty(spark)).count() == 0


def test_components_of_no_edges_and_of_edges_without_ends(spark):
    edge = "a long, b long, root long"
    assert components(spark.createDataFrame([], edge)).count() == 0
    rows = [(None, 1, 0), (2, None, 0), (None, None, 0), (3, 3, 0)]
    assert components(spark.createDataFrame(rows, edge)).count() == 0
    rows += [(5, 4, 0), (4, 5, 0), (5, 4, 1), (5, 9, 0), (-7, 8, 0)]
    got = components(spark.createDataFrame(rows, edge)).select("node", "root").collect()
    assert sorted(map(tuple, got)) == [(-7, -7), (4, 4), (5, 4), (8, -7), (9, 4)]
