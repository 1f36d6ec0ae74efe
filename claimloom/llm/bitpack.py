"""Token ids in files of fixed-width bit packing.

A file holds the documents of one range of doc_ids in ascending order. Every id takes the least bits that the vocabulary
allows; ids lie in blocks of BLOCK, and the footer has the byte offset of each block and the first id of each document,
so any document or id can be read by seeking to a few blocks, which numpy unpacks as a whole. Files are written by tasks
under names of their own into the shared folder; the manifest, a Spark table, names those of the tasks that succeeded, so
a lost executor or a second attempt leaves no wrong file in use.

Layout: blocks | doc_ids int64 | starts int64 (one more than documents) | block offsets int64 (one more than blocks) |
footer as JSON | its length as uint32 | MAGIC.

Defined cases: a null text counts as empty; an empty text holds only the end id; repeated doc_ids keep all their rows, in
order of text; a null doc_id comes last (stored as the greatest int64); an empty table gives no file and no row.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import MAX_ID, crc, materialize, range_buckets, rows, shared_dir, texts
from claimloom.llm.tokenize import encoder

MAGIC, BLOCK = b"BITPACK1", 4096
MANIFEST = "shard int, path string, n_docs long, n_ids long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def pack(ids: np.ndarray, width: int) -> bytes:
    bits = np.unpackbits(np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(bits[:, :width].ravel(), bitorder="little").tobytes()


def unpack(data: bytes, count: int, width: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: count * width].reshape(count, width)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :width] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Writer:
    def __init__(self, uri: str, vocabulary: int):
        system, self.path = filesystem(uri)
        self.out, self.width = system.open_output_stream(self.path), max(1, (vocabulary - 1).bit_length())
        self.vocabulary, self.doc_ids, self.starts, self.offsets = vocabulary, [], [0], [0]
        self.held, self.n_held = [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >= self.vocabulary:
            raise ValueError("an id is outside the vocabulary")
        self.doc_ids.append(MAX_ID if doc_id is None else doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK * 16:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, "<u4")
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for at in range(0, whole, BLOCK):
            data = pack(ids[at : min(at + BLOCK, whole)], self.width)
            self.out.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
        self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def close(self) -> tuple[int, int]:
        self._flush(True)
        for table in (self.doc_ids, self.starts, self.offsets):
            self.out.write(np.array(table, "<i8").tobytes())
        footer = json.dumps({"width": self.width, "vocabulary": self.vocabulary, "block": BLOCK, "docs": len(self.doc_ids), "blocks": len(self.offsets) - 1}).encode()
        self.out.write(footer + np.uint32(len(footer)).tobytes() + MAGIC)
        self.out.close()
        return len(self.doc_ids), self.starts[-1]


class Reader:
    def __init__(self, uri: str):
        system, path = filesystem(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        tail = self._at(size - 12, 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"{uri} is not a file of packed ids")
        length = int(np.frombuffer(tail[:4], "<u4")[0])
        self.about = json.loads(self._at(size - 12 - length, length))
        docs, blocks = self.about["docs"], self.about["blocks"]
        table = np.frombuffer(self._at(size - 12 - length - 8 * (2 * docs + blocks + 2), 8 * (2 * docs + blocks + 2)), "<i8")
        self.doc_ids, self.starts, self.offsets = table[:docs], table[docs : 2 * docs + 1], table[2 * docs + 1 :]

    def _at(self, offset: int, length: int) -> bytes:
        return self.file.read_at(length, offset)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi of the file, from the blocks that hold them."""
        if hi <= lo:
            return np.empty(0, "<u4")
        block, width = self.about["block"], self.about["width"]
        first, last = lo // block, (hi - 1) // block
        data = self._at(int(self.offsets[first]), int(self.offsets[last + 1] - self.offsets[first]))
        end = min((last + 1) * block, int(self.starts[-1]))
        if (block * width) % 8 == 0:  # whole bytes to a block: the blocks unpack as one
            return unpack(data, end - first * block, width)[lo - first * block : hi - first * block]
        parts = []
        for b in range(first, last + 1):
            at = int(self.offsets[b] - self.offsets[first])
            parts.append(unpack(data[at : at + int(self.offsets[b + 1] - self.offsets[b])], min((b + 1) * block, int(self.starts[-1])) - b * block, width))
        return np.concatenate(parts)[lo - first * block : hi - first * block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def write_packed(docs: DataFrame, tokenizer: str, end_id: int, uri: str | None = None) -> DataFrame:
    """Encode and write all documents; the manifest, a row for each file, is returned.

    One shuffle: texts go to ranges of doc_id. A range is encoded and written as it streams through its task.
    """
    uri = uri or f"{shared_dir(docs.sparkSession)}/packed-{uuid.uuid4().hex}"
    system, folder = filesystem(uri)
    system.create_dir(folder, recursive=True)

    def write(batches: Iterator) -> Iterator[pa.RecordBatch]:
        encode, done, shard, out = encoder(tokenizer), [], None, None
        for part, doc_id, text in rows(batches):
            if part != shard:
                if out:
                    done.append((shard, path, *out.close()))
                shard, path = part, f"{uri}/{part:06d}-{uuid.uuid4().hex}.ids"
                out = Writer(path, max(encode.size, end_id + 1))
            out.add(doc_id, np.append(encode.encode(text), np.uint32(end_id)))
        if out:
            done.append((shard, path, *out.close()))
        columns = list(zip(*done, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["shard", "path", "n_docs", "n_ids"])

    base = texts(docs).withColumn("order_id", F.coalesce("doc_id", F.lit(MAX_ID)))
    dealt = range_buckets(base, "order_id", "part").repartition("part").sortWithinPartitions("part", "order_id", "text")
    return materialize(dealt.select("part", "doc_id", "text").mapInArrow(write, MANIFEST), "packed-manifest")


def read_packed(manifest: DataFrame, at_once: int = 1 << 20) -> DataFrame:
    """Read the files back: place, number and checksum of each document's ids. A task opens its own files only."""

    def read(batches: Iterator) -> Iterator[pa.RecordBatch]:
        for path, base in rows(batches):
            file, i = Reader(path), 0
            starts = file.starts
            while i < len(file.doc_ids):
                j = max(i + 1, int(np.searchsorted(starts, starts[i] + at_once, "right")) - 1)
                ids = file.ids(int(starts[i]), int(starts[j]))
                cuts = starts[i : j + 1] - starts[i]
                sums = [crc(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                names = pa.array([None if d == MAX_ID else int(d) for d in file.doc_ids[i:j]], pa.int64())
                yield pa.RecordBatch.from_arrays([names, pa.array(starts[i:j] + base), pa.array(np.diff(starts[i : j + 1])), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                i = j

    # a row for each file, at most the number of ranges: small whatever the input
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    return placed.select("path", "base").repartition(max(1, min(manifest.count(), 4096))).mapInArrow(read, READ)
