"""As-of history, goals located by the index, and needles, against plain versions."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from claimloom.functions.needles import hits
from claimloom.operators import history, locate
from claimloom.sources.model import ClaimMap
from claimloom.sources.records import extract

LOG = "who string, at long, n long, state string"


def _events(seed: int, rows: int) -> list[tuple]:
    draw = random.Random(seed)
    # one key holds most rows; times tie
    return [(draw.choice(["hot"] * 5 + ["a", "b", None]), draw.choice([None, *range(40)]), i, draw.choice("xyz")) for i in range(rows)]


@pytest.mark.parametrize("rows_each", [7, 1_000_000])
def test_as_of_is_the_last_state_whatever_the_ranges(spark, rows_each):
    log, asked = _events(1, 120), _events(2, 90)
    got = history.as_of(spark.createDataFrame(log, LOG), spark.createDataFrame(asked, LOG).drop("state"), "who", "at", "n", ["state", "n"], rows_each)

    def stands(who, at):
        before = [] if who is None or at is None else [r for r in log if r[0] == who and r[1] is not None and r[1] <= at]
        return max(before, key=lambda r: (r[1], r[2])) if before else None

    want = [(who, at, n, s[3] if s else None, s[2] if s else None) for who, at, n, _ in asked for s in [stands(who, at)]]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("rows_each", [7, 1_000_000])
def test_changes_are_those_of_each_key(spark, rows_each):
    log = _events(3, 150)
    got = history.changes(spark.createDataFrame(log, LOG), "who", "at", "n", ["state"], rows_each)
    want = []
    for key in ("hot", "a", "b"):
        was = None
        for row in sorted((r for r in log if r[0] == key and r[1] is not None), key=lambda r: (r[1], r[2])):
            if row[3] != was:
                want.append((*row, was))
            was = row[3]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_empty_logs_and_questions(spark):
    none, some = spark.createDataFrame([], LOG), spark.createDataFrame(_events(4, 5), LOG)
    assert history.as_of(some, none, "who", "at", "n", ["state"]).count() == 0
    assert [r.state_state for r in history.as_of(none, some, "who", "at", "n", ["state"]).collect()] == [None] * 5
    assert history.changes(none, "who", "at", "n", ["state"]).count() == 0


@pytest.mark.parametrize("probes", [1, 3])
def test_pruned_index_gives_what_scoring_everything_gives(spark, probes):
    draw = random.Random(5)
    common, rare = ["the", "of", "and"], [f"w{c}" for c in "abcdefghijklmnopqrst"]
    subjects = [(i, f"b{i % 6}", " ".join(draw.choices(common, k=4) + draw.choices(rare, k=draw.randrange(8)))) for i in range(60)] + [(60, "b0", None), (61, "b1", "")]
    goals = [(f"g{i}", " ".join(draw.choices(common + rare, k=5))) for i in range(12)] + [("none", None), ("strange", "unheard")]
    made = spark.createDataFrame(subjects, "subject long, block string, text string")
    asked = locate.words(spark.createDataFrame(goals, "goal string, text string"), "text", "goal")
    index = locate.postings(locate.words(made, "text", "subject", "block"), len(subjects), asked)
    weights = {(r.word, r.subject): r.weight for r in index.collect()}
    want = []
    for goal, text in goals:
        said = set((text or "").split())
        scores = {s: sum(weights.get((w, s), 0) for w in said) for s, _, _ in subjects}
        best = sorted((-n, s) for s, n in scores.items() if n)[:4]
        want += [(goal, s, -n, i + 1, sorted(w for w in said if (w, s) in weights)) for i, (n, s) in enumerate(best)]
    got = locate.locate(asked, index, 4, probes).select("goal", "subject", "score", "rank", "scope_words")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_only_the_best_of_a_block_become_rows(spark):
    """300 subjects of 3 blocks and 50 goals share three words: a goal gets k rows from each block, not one for each subject."""
    index = spark.createDataFrame([(p, i, f"b{i % 3}", (7 * i + p) % 5 + 1) for i in range(300) for p in range(3)], "place long, subject long, block string, weight long")
    chosen = spark.createDataFrame([(f"g{i}", f"b{b}", [*range(i % 3 + 1)]) for i in range(50) for b in range(3)], "goal string, block string, words array<long>")
    got = locate._scores(index, chosen, 2).collect()
    want = []
    for i in range(50):
        for b in range(3):
            scores = {s: sum((7 * s + p) % 5 + 1 for p in range(i % 3 + 1)) for s in range(b, 300, 3)}
            want += [(f"g{i}", s, -n) for n, s in sorted((-n, s) for s, n in scores.items())[:2]]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize(("cells", "k"), [(1, 1), (9, 2), (1 << 20, 5)])
def test_goals_meet_a_block_in_slices(monkeypatch, cells, k):
    monkeypatch.setattr(locate._Block, "CELLS", cells)
    postings = pa.RecordBatch.from_pylist([{"place": p, "subject": s, "weight": w} for p, s, w in [(4, 9, 2), (4, 3, 2), (6, 9, 1), (8, 5, 3), (6, 3, 1)]])
    goals = pa.RecordBatch.from_pylist([{"words": w} for w in ([4], [8, 6], [4, 6, 8], [6])])
    got = [(int(g), int(s), int(n)) for found in locate._Block([postings]).best(goals, k) for g, s, n in zip(*found, strict=True)]
    want = [(0, 3, 2), (0, 9, 2), (1, 5, 3), (1, 3, 1), (1, 9, 1), (2, 3, 3), (2, 5, 3), (2, 9, 3), (3, 3, 1), (3, 9, 1)]
    assert sorted(got) == sorted(r for g in range(4) for r in [r for r in want if r[0] == g][:k])


def test_a_least_score_spares_postings_and_loses_nothing(monkeypatch):
    """With the score to beat known, a block reads a small part of the postings that its goals share with it."""
    draw = random.Random(8)
    drawn = {(min(int(draw.paretovariate(0.6)), 400), draw.randrange(500)): None for _ in range(30_000)}
    rows = [{"place": p, "subject": s, "weight": 20 * (p + 9) // draw.randrange(9, 40)} for p, s in drawn]
    asked = [sorted({min(int(draw.paretovariate(0.4)), 400) for _ in range(25)} | {401}) for _ in range(40)]
    weights, want = {(r["place"], r["subject"]): r["weight"] for r in rows}, []
    for g, words in enumerate(asked):
        scores = {s: sum(weights.get((w, s), 0) for w in words) for s in range(500)}
        want += [(g, s, -n) for n, s in sorted((-n, s) for s, n in scores.items() if n)[:3]]
    least = [next(n for i, _, n in reversed(want) if i == g) for g in range(40)]
    block, read = locate._Block([pa.RecordBatch.from_pylist(rows)]), []

    class Spy:
        def __init__(self, of):
            self.of = of

        def __getitem__(self, posting):
            read.append(len(posting))
            return self.of[posting]

    block.of = Spy(block.of)
    for cells in (1, 2000, 1 << 20):
        monkeypatch.setattr(locate._Block, "CELLS", cells)
        spent = []
        for given in ([0] * 40, least):
            read.clear()
            got = [(int(g), int(s), int(n)) for found in block.best(pa.record_batch({"words": asked, "least": given}), 3) for g, s, n in zip(*found, strict=True)]
            assert got == want
            spent.append(sum(read))
        assert spent[1] * 2 < spent[0], spent


@pytest.mark.parametrize(("block_chars", "probes", "slices"), [(40, 1, 1), (300, 2, 3), (1 << 20, 2, 1)])
def test_texts_are_located_as_by_scoring_everything(spark, monkeypatch, block_chars, probes, slices):
    """Subjects in several rows, of several sizes; null and empty texts; words in upper case and with other letters."""
    monkeypatch.setattr(locate, "FIRST_GOALS", 20 // slices)
    monkeypatch.setattr(locate, "PACK", 3)
    draw = random.Random(9)
    rare = [f"w{c}\u00e9" for c in "abcdefghijklmnopqrst"]
    texts = [(i % 50, " ".join(draw.choices(["The", "of"], k=2) + draw.choices(rare, k=draw.choice([0, 1, 3, 30])))) for i in range(70)] + [(50, None), (51, ""), (3, None)]
    goals = [(f"g{i}", " ".join(draw.choices(["the", "OF", *rare], k=6))) for i in range(20)] + [("none", None), ("strange", "unheard")]
    made = spark.createDataFrame(texts, "subject long, text string").repartition(3)
    asked = locate.words(spark.createDataFrame(goals, "goal string, text string"), "text", "goal")
    rows = locate.postings(locate.words(made.withColumn("block", locate.F.lit("b")), "text", "subject", "block"), 52, asked)
    weights = {(r.word, r.subject): r.weight for r in rows.collect()}
    index = locate.lists(made, 52, asked, block_chars)
    assert {(r.word, s): n for r in index.collect() for s, n in zip(r.subjects, r.weights, strict=True) if n} == weights
    want = []
    for goal, text in goals:
        said = set((text or "").lower().split())
        scores = {s: sum(weights.get((w, s), 0) for w in said) for s in range(52)}
        best = sorted((-n, s) for s, n in scores.items() if n)[:3]
        want += [(goal, s, -n, i + 1, sorted(w for w in said if (w, s) in weights)) for i, (n, s) in enumerate(best)]
    got = locate.locate(asked, index, 3, probes).select("goal", "subject", "score", "rank", "scope_words")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_rarer_and_repeated_words_weigh_more(spark):
    scopes = spark.createDataFrame([(1, "b", "rare rare all"), (2, "b", "half all"), (3, "b", "half all"), (4, "b", "rare2 all")], "subject long, block string, text string")
    weights = {(r.word, r.subject): r.weight for r in locate.postings(locate.words(scopes, "text", "subject", "block"), 4).collect()}
    assert weights[("rare", 1)] > weights[("half", 2)] and not any(w == "all" for w, _ in weights)


@pytest.mark.parametrize("most_bytes", [8, 1 << 20])
def test_needles_are_found_as_by_find(spark, most_bytes):
    texts = [(1, "abcabcé𝄞abc"), (2, ""), (3, None), (4, "zzzz"), (None, "é𝄞a bc")]
    needles = ["abc", "bca", "é𝄞a", "zz", "", None, "absent", "abc"]
    got = hits(spark.createDataFrame(texts, "id long, body string"), "id", "body", spark.createDataFrame([(n,) for n in needles], "n string"), "n", most_bytes)
    want = [(i, n, t.find(n), sum(t.startswith(n, k) for k in range(len(t)))) for i, t in texts if t for n in {n for n in needles if n} if n in t]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    none = spark.createDataFrame([], "n string")
    assert hits(spark.createDataFrame(texts, "id long, body string"), "id", "body", none, "n").count() == 0


def test_stems_are_dispatched_by_pattern(spark):
    stems = spark.createDataFrame([("tokamak_2020",), ("a_tokamak_note",), ("plasma",), ("unknown",)], "stem string")
    rules = spark.createDataFrame([("Tokamak", "P1", 2), ("tokamak_2020", "P2", 9), ("plasma", "P3", 1), ("note", "P4", 1), ("", "P5", 0)], "pattern string, paper_id string, priority int")
    claims = spark.createDataFrame([(f"P{i}", f"P{i}_C01", 0.9) for i in range(1, 6)], "paper_id string, claim_id string, confidence double")
    got = {(r.stem, r.paper_id) for r in extract(stems, ClaimMap(claims, claims, claims, claims, claims), rules).collect()}
    assert got == {("tokamak_2020", "P2"), ("a_tokamak_note", "P4"), ("plasma", "P3"), ("unknown", "unknown")}
