"""Merkle manifest, near vectors and source divergence against brute force on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from claimloom.llm import divergence, merkle, vector_neighbours
from tests.llm import awkward


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def ascii_lower(text: str | None) -> str | None:
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def grown(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def around(levels: list[list[str]], i: int) -> list[tuple]:
    out = []
    for level in levels[:-1]:
        at = i // 8 * 8
        out.append((level[at:i], level[i + 1 : at + 8]))
        i //= 8
    return out


def plain_manifest(rows: list[tuple]) -> list[tuple]:
    """rows: doc_id, text, lang, source, n_chars."""
    leaf = lambda r, text: digest(field(r[0]), field(r[3]), field(r[2]), field(r[4]), field(text))
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    for k in langs:
        by[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = {k: grown([leaf(r, r[1]) for r in by[k]]) for k in langs}
    top = grown([trees[k][-1][0] for k in langs])
    out = []
    for i, k in enumerate(langs):
        for j, r in enumerate(by[k]):
            path = around(trees[k], j) + around(top, i)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = leaf(r, ascii_lower(r[1]) if hit else r[1])
            for left, right in path:
                node = digest(*left, node, *right)
            out.append((r[0], trees[k][0][j], trees[k][-1][0], top[-1][0], digest(*[x for left, right in path for x in left + right]), node, node == top[-1][0]))
    return out


MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def same(found, expected) -> None:
    assert Counter(map(tuple, found)) == Counter(map(tuple, expected))


def test_manifest(spark):
    same(merkle.manifest(awkward.table(spark)).select(MANIFEST).collect(), plain_manifest([r[:5] for r in awkward.rows()]))
    assert merkle.manifest(awkward.empty(spark)).select(MANIFEST).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 8, "b": 9}, {None: 65, "": 64, "z": 1, "é": 17}, {f"l{i:02}": 1 + i % 3 for i in range(11)}])
def test_manifest_of_tree_shapes(spark, sizes):
    """Lone leaves and languages, full runs, runs of one, more languages than a run holds."""
    rows, at = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((at, f"Text {at}", lang, "s", at))
            at += 1
    random.Random(2).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    same(merkle.manifest(docs).select(MANIFEST).collect(), plain_manifest(rows))


def test_manifest_numbers_across_ranges(spark):
    docs = awkward.table(spark)
    few, many = (merkle.leaves(docs, n).select("key", "n", "idx", "leaf").collect() for n in (5, 1000))
    same(few, many)


VECTORS = "vec_id long, embedding array<float>, label int, rep string, tile string, n_links string"


def some_vectors() -> list[tuple]:
    draw = np.random.default_rng(7)
    out: list[tuple] = []

    def add(vec_id, vector, label):
        out.append((vec_id, None if vector is None else [None if x is None else float(x) for x in vector], label, "x", "x", "x"))

    centre = draw.standard_normal(16)
    for i in range(60):  # a group of unlike near copies, and some farther away
        add(100 + i, centre + draw.standard_normal(16) * (0.15 if i % 3 else 0.5), i % 2)
    for i in range(40):
        add(200 + i, draw.standard_normal(16), i % 2)
    for i in range(30):
        add(300 + i, centre, 0)  # copies
    add(300, centre, 0)  # a repeated row
    add(400, centre * 1e30, 0)  # the same direction
    add(401, -centre, 0)
    add(402, centre, None)
    add(403, None, 0)
    add(404, [], 0)
    add(405, [0.0] * 16, 0)
    add(406, [float("nan"), *centre[1:]], 0)
    add(407, [float("inf"), *centre[1:]], 0)
    add(408, [None, *centre[1:]], 0)
    add(409, centre[:8], 0)  # another length
    add(410, centre[:8], 0)
    add(None, centre, 1)
    add(None, [0.0] * 16, 1)
    return out


def plain_neighbours(rows: list[tuple]) -> list[tuple]:
    good = lambda v: v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
    unit = [np.array(v) / np.linalg.norm(v) if good(v) and label is not None else None for _, v, label, *_ in rows]
    n, links = len(rows), defaultdict(set)
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            todo.extend(links[todo.pop()] - seen if todo else ())
            seen.update(todo)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out.append((rows[i][0], len(links[i]), min(ids, default=None), rows[i][0] is not None and rows[i][0] == min(ids)))
    return out


@pytest.mark.parametrize("tile", [512, 7])
def test_neighbours(spark, tile):
    rows = [(a, None if v is None else [None if x is None else float(np.float32(x)) for x in v], *more) for a, v, *more in some_vectors()]
    table = spark.createDataFrame(rows, VECTORS).repartition(3)
    found = vector_neighbours.neighbours(table, target=0.99999, tile=tile).select("vec_id", "n_links", "component_id", "kept").collect()
    same(found, plain_neighbours(rows))
    assert vector_neighbours.neighbours(spark.createDataFrame([], VECTORS)).count() == 0


def test_hashing_reaches_its_target():
    """Pairs at the threshold meet about as often as computed, and the number of tables follows the data's size."""
    hashing = vector_neighbours.Projections(5000)
    draw = np.random.default_rng(3)
    a = vector_neighbours.unit_rows(draw.standard_normal((3000, 64)))
    side = draw.standard_normal(a.shape)
    side = vector_neighbours.unit_rows(side - (side * a).sum(1, keepdims=True) * a)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * side
    assert ((hashing.keys(a) == hashing.keys(b)).any(1)).mean() > 0.985
    assert (hashing.keys(a)[:-1] == hashing.keys(a)[1:]).mean() < 0.001
    assert vector_neighbours.Projections(10**7).tables > hashing.tables > vector_neighbours.Projections(10).tables


TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain_audit(rows: list[tuple], top: int = 200) -> list[tuple]:
    """rows: lang, source, text, nulls as empty."""
    docs, count = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        words = TERM.findall(ascii_lower(text))
        docs[lang].update(set(words))
        count[lang, source].update(words)
    out = []
    for lang, source in count:
        kept = [t for t, n in docs[lang].items() if n >= 3]

        def freq(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        others = [s for k, s in count if k == lang and s != source]
        p, own = freq(count[lang, source]), count[lang, source]
        f = lambda p, q: (p - q) ** 2 // q
        pairs = [(s, sum(f(p[t], q[t]) for t in kept)) for s in others for q in [freq(count[lang, s])]]
        q = freq(sum((count[k, s] for k, s in count if k == lang), Counter()))
        terms = [(t, f(p[t], q[t])) for t in kept if own[t] > 0 and p[t] > q[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out.extend((lang, source, part, item, value, rank) for rank, (item, value) in enumerate(found, 1) if part == "pair" or rank <= top)
    return out


AUDIT = ["lang", "source", "part", "item", "value", "rank"]


@pytest.mark.parametrize(("top", "most", "entries"), [(200, 1_000_000, 1 << 22), (5, 1000, 50)])
def test_audit(spark, monkeypatch, top, most, entries):
    """Also with terms dealt to several fits, and vectors summed in many rounds."""
    monkeypatch.setattr(divergence, "distinct_words", lambda words: 2500)
    monkeypatch.setattr(divergence, "ENTRIES", entries)
    rows = [(r[2] or "", r[3] or "", r[1] or "") for r in awkward.rows()]
    rows += [("xx", s, t) for s in ("a", "b", "c") for t in ("Naïve naïve NAÏVE É é", "naïve É token \x1f a_b")] + [("x\x1fx", "a", "one two"), ("yy", "a", ""), ("yy", "b", "12 34")]
    docs = spark.createDataFrame([(i, s or None, t or None, lang or None, "x", "x") for i, (lang, s, t) in enumerate(rows)], "doc_id long, source string, text string, lang string, words string, term string").repartition(3)
    same(divergence.audit(docs, top=top, most_terms=most).select(AUDIT).collect(), plain_audit(rows, top))


def test_audit_of_no_terms(spark):
    schema = "doc_id long, source string, text string, lang string"
    assert divergence.audit(spark.createDataFrame([], schema)).count() == 0
    found = divergence.audit(spark.createDataFrame([(1, "a", None, "en"), (2, "b", "", "en")], schema)).select(AUDIT).collect()
    same(found, [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)])


def test_tokens_of_a_block(spark):
    """What the fit and the vectors read stands for the documents, and doesn't grow with repeats of words in a block."""
    rows = [(r[2] or "", r[3] or "", r[1] or "") for r in awkward.rows()] + [("zz", "s", "one two one"), ("zz", "t", "two"), ("zz", "t", "")] * 300
    docs = spark.createDataFrame([(i, s or None, t or None, lang or None) for i, (lang, s, t) in enumerate(rows)], "doc_id long, source string, text string, lang string").coalesce(1)
    texts, counts = Counter(), Counter()
    for lang, source, text in rows:
        words = TERM.findall(ascii_lower(text))
        texts.update({f"{lang}\x1f{w}" for w in words})
        counts.update((lang, source, f"{lang}\x1f{w}") for w in words)
    found, sums, groups, sent = Counter(), Counter(), set(), 0
    for r in divergence.tokens(docs).collect():
        assert len(r.words) == len(set(r.words))
        if r.fit:
            found.update(r.words)
        else:
            groups.add((r.lang, r.source))
            sums.update({(r.lang, r.source, w): r.times for w in r.words})
        sent += len(r.words) * (r.lang == "zz")
    assert found == {w: min(n, 3) for w, n in texts.items()}
    assert sums == counts
    assert groups == {(lang, source) for lang, source, _ in rows}
    assert sent <= 2 * 3 + 3 * 10 < 1200


def test_frequency_of_large_counts(spark):
    cases = [(0, 0, 0), (0, 5, 2), (999_999_998, 10**12, 7), (10**9, 10**12, 7), (9 * 10**15, 10**16 + 1, 3)]
    table = spark.createDataFrame(cases, "count long, total long, terms long")
    found = table.select("count", "total", "terms", divergence.frequency(*(table[c] for c in table.columns)).alias("p")).collect()
    same(found, [(c, n, v, 1 + (10**9 * (c + 1) // (n + v) if n + v else 0)) for c, n, v in cases])


def test_audit_in_small_pieces(spark, monkeypatch):
    """With a block for each slice of texts, two words a row and three buckets."""
    for name, value in (("BLOCK", 1), ("ROW", 2), ("BUCKETS", 3), ("ENTRIES", 5)):
        monkeypatch.setattr(divergence, name, value)
    rows = [("xx", s, t) for s in ("a", "b", "c") for t in ("one two one É é", "one two three a_b", "two É four")] + [("yy", "a", "")]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string").repartition(4)
    same(divergence.audit(docs).select(AUDIT).collect(), plain_audit(rows))
