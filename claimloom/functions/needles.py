"""Many needles in many texts at once: each text is read once by an Aho-Corasick automaton of the needles.

Needles are dealt by hash to as many automata as keep each below a size, a pass over the texts for each.

Defined cases: null texts hold nothing; null and empty needles are found nowhere; a needle given twice is found once; rows
of equal keys are looked through each. Upper and lower case differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of needles in an automaton; it takes some fifty times as much memory in a worker.
MOST_BYTES = 4 << 20


def hits(texts: DataFrame, key: str, text: str, needles: DataFrame, needle: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """key, needle, at (code points before its first place), times (overlapping ones too) of each needle in each text."""
    known = needles.select(F.col(needle).alias("needle")).where("needle <> ''").distinct()
    size = known.agg(F.sum(F.octet_length("needle"))).first()[0] or 0
    parts = max(1, -(-size // most_bytes))
    rows = texts.where(F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("__text"))
    found = None
    for part in range(parts):
        mine = known.where(F.pmod(F.xxhash64("needle"), F.lit(parts)) == part)
        one = _pass(rows, key, [r.needle for r in mine.collect()])  # about most_bytes of them, by the measured size
        found = one if found is None else found.unionByName(one)
    return found


def _pass(rows: DataFrame, key: str, needles: list[str]) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(needles)
    kind = rows.schema[key].dataType

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word in sent.value:
            automaton.add_word(word, word)
        automaton.make_automaton()
        for batch in batches:
            of, names, places, times = [], [], [], []
            for row in range(batch.num_rows if len(automaton) else 0):
                first, count = {}, {}
                for end, word in automaton.iter(batch.column(1)[row].as_py()):
                    first.setdefault(word, end - len(word) + 1)
                    count[word] = count.get(word, 0) + 1
                of.extend([row] * len(first))
                names.extend(first)
                places.extend(first.values())
                times.extend(count[w] for w in first)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(names, pa.string()), pa.array(places, pa.int64()), pa.array(times, pa.int64())], [key, "needle", "at", "times"])

    return rows.mapInArrow(look, f"`{key}` {kind.simpleString()}, needle string, at long, times long")
