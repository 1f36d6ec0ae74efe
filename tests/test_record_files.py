"""Record files: ranges of any size give each record once, and what cannot be read is kept."""

from __future__ import annotations

import json

import pytest

from claimloom.sources.record_files import RecordReader, read_records

SCHEMA = "id long, label string"


def records(folder) -> tuple[list, list]:
    good = [{"id": i, "label": "é" * (i % 9) + f"𝄞{i}"} for i in range(60)]
    bad = ['{"id": 1', "[1, 2]", "plain words", '{"id": "seven"}', "7"]
    lines = [json.dumps(r, ensure_ascii=i % 2 == 0) for i, r in enumerate(good)]
    (folder / "deep").mkdir()
    (folder / "a.json").write_text("\n".join(lines[:40] + ["", "   "] + bad[:2]) + "\n")
    (folder / "deep" / "b.jsonl").write_bytes("\r\n".join(lines[40:] + bad[2:]).encode() + b"\n\xff\xfe{}")  # no end of line at the end
    (folder / "empty.json").write_text("")
    (folder / "_SUCCESS").write_text("not a record")
    return good, bad


@pytest.mark.parametrize("size", [1, 17, 300, 64 << 20])
def test_ranges_give_each_record_once(spark, tmp_path, size):
    good, bad = records(tmp_path)
    reader = RecordReader(f"file://{tmp_path}", True, size)
    found = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(found) == len({(r["path"], r["position"]) for r in found}) == len(good) + len(bad) + 1
    if size > 1:
        got = read_records(spark, f"file://{tmp_path}", SCHEMA, size=size).collect()
        assert sorted((r.id, r.label) for r in got if r.problem is None) == sorted((r["id"], r["label"]) for r in good)
        assert sorted(r.problem for r in got if r.problem) == ["no JSON", "no JSON", "no UTF-8", "no object", "no object", "other types"]
        assert {r.rejected for r in got if r.problem} == {*bad, "��{}"} and all(r.id is None for r in got if r.problem)


def test_whole_files_and_empty_folders(spark, tmp_path):
    (tmp_path / "one.json").write_text('{\n "id": 1,\n "label": null\n}\n')
    (tmp_path / "two.json").write_text('{"id": 2')
    got = read_records(spark, f"file://{tmp_path}", SCHEMA, lines=False).orderBy("path").collect()
    assert [(r.id, r.label, r.problem) for r in got] == [(1, None, None), (None, None, "no JSON")]
    (tmp_path / "none").mkdir()
    assert read_records(spark, f"file://{tmp_path}/none", SCHEMA).count() == 0
