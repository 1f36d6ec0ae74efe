"""Token ids of whole texts with a vocabulary file of the tokenizers library, fast for text that repeats its words.

A text is cut where no token can cross, each part is encoded once and remembered. Parts of plain Latin letters, digits
and ASCII marks are split by the tokenizer's own rule here and only merged by its model; any other part goes through the
whole tokenizer. The ids equal those of Tokenizer.encode(text, add_special_tokens=False).
"""

from __future__ import annotations

import json
import re

import numpy as np

LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
#: The pre-tokenizer patterns of the two kinds of file, restricted to the plain characters.
WORD_PIECES = re.compile(f"[{LATIN}]++|{SHORT}|[0-9]|[^\\s{LATIN}0-9]+")
BYTE_PIECES = re.compile(f" [{LATIN}]++|[{LATIN}]++|{SHORT}| ?[0-9]+| ?[^\\s{LATIN}0-9]+|\\s+(?!\\S)|\\s+")
#: What such files say of their normalizer and pre-tokenizer; a file of any other kind is left to the whole tokenizer.
SPLIT_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_KIND = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT_WORDS}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]})
BYTE_KIND = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})
PLAIN = re.compile("[ \n!-~À-ÖØ-öø-ÿ]*")
#: Spaces for Python but not for the tokenizers.
ODD = re.compile("[\x1c-\x1f]")
PART = re.compile(r"\s*\S+|\s+")


def byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """path: a BPE file of the tokenizers library with byte-level pieces."""

    def __init__(self, path: str, keep: int = 150_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        shape = json.loads(open(path).read())
        kind = (shape["normalizer"], shape["pre_tokenizer"])
        self.known, self.drops_space = kind in (WORD_KIND, BYTE_KIND), kind == WORD_KIND
        self.special = [t["content"] for t in shape["added_tokens"]]
        self.split = WORD_PIECES.findall if self.drops_space else BYTE_PIECES.findall
        self.pieces, self.parts = _Pieces(self.tokenizer, keep), _Parts(self, keep // 8)

    def encode(self, text: str) -> np.ndarray:
        if not self.known or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        if PLAIN.fullmatch(text):
            return np.frombuffer(self.plain(text), "<u4")
        if not self.drops_space and ODD.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        parts = text.encode().split() if self.drops_space else PART.findall(text)
        return np.frombuffer(b"".join(map(self.parts.__getitem__, parts)), "<u4")

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text.lower() if self.drops_space else text)))


class _Kept(dict):
    """What make() gives for a key, remembered for the keys seen of late: of two halves the older one goes once the newer is full."""

    def __init__(self, keep: int):
        self.keep, self.older = keep, {}

    def __missing__(self, key) -> bytes:
        if len(self) >= self.keep:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(key)
        if ids is None:
            ids = self.make(key)
        self[key] = ids
        return ids


class _Pieces(_Kept):
    """Ids of what the pre-tokenizer makes of a plain text, by the tokenizer's model."""

    def __init__(self, tokenizer, keep: int):
        super().__init__(keep)
        self.merge, self.letters = tokenizer.model.tokenize, byte_letters()
        self.bytes = [i.to_bytes(4, "little") for i in range(max(tokenizer.get_vocab().values()) + 1)]

    def make(self, piece: str) -> bytes:
        if piece.isascii():  # of a plain text, so all but these two stand for themselves
            letters = piece.replace(" ", self.letters[32]).replace("\n", self.letters[10])
        else:
            letters = piece.encode().decode("latin-1").translate(self.letters)
        ids = [self.bytes[t.id] for t in self.merge(letters)]
        return ids[0] if len(ids) == 1 else b"".join(ids)


class _Parts(_Kept):
    """Ids of the parts of other texts."""

    def __init__(self, of: Encoder, keep: int):
        super().__init__(keep)
        self.of = of

    def make(self, part) -> bytes:
        text = part.decode() if self.of.drops_space else part
        if PLAIN.fullmatch(text):
            return self.of.plain(text)
        return np.array(self.of.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
