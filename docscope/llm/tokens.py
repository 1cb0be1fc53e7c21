"""Word-cached tokenization: the ids of a text, as the tokenizers library gives them, at several times its speed.

A tokenizer whose file has the normalizer and the pre-tokenizer below cuts at white space before anything else, so a
text's ids are those of its white-space-separated pieces in order. Each worker keeps the ids of the pieces it has met;
the library encodes the rest. Two bounded tables hold raw pieces and their lower-cased parts. Any other tokenizer gets
whole texts, by the library alone.
"""

from __future__ import annotations

import json
import re
from struct import pack

import numpy as np

# The normalizer and the pre-tokenizer, as tokenizer files write them, that the fast path reproduces.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Pieces of printable ASCII and Latin-1 letters, which no normalization but lower-casing changes.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]{1,200}")
#: How this vocabulary's pre-tokenizer cuts such a piece once it is lower-case.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
#: str.split() also splits at these, which the tokenizer does not hold for white space.
NOT_SPACES = re.compile("[\x1c-\x1f]")
SPACES = re.compile(r"[ \t\n\r]+")


def _byte_letters() -> dict[int, str]:
    """Latin-1 letters as the byte-level alphabet writes their two UTF-8 bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


BYTE_LETTERS = _byte_letters()


class _Parts(dict):
    def __init__(self, tokenizer, limit: int) -> None:
        self.tokenize, self.limit = tokenizer.model.tokenize, limit

    def __missing__(self, part: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        ids = [t.id for t in self.tokenize(part if part.isascii() else part.translate(BYTE_LETTERS))]
        got = self[part] = pack(f"<{len(ids)}I", *ids)
        return got


class Encoder(dict):
    """piece -> ids as little-endian unsigned 32-bit integers. ``limit`` bounds the entries of either table."""

    def __init__(self, path: str, limit: int = 400_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.limit, self.parts = limit, _Parts(self.tokenizer, limit)
        held = json.loads(self.tokenizer.to_str())
        added = [t["content"] for t in held.get("added_tokens") or ()]
        self.fast = held["normalizer"] == NORMALIZER and held["pre_tokenizer"] == PRE_TOKENIZER and all(t.startswith("<|") for t in added)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        if "<|" not in piece and PLAIN.fullmatch(piece):
            got = b"".join(map(self.parts.__getitem__, PARTS.findall(piece.lower())))
        else:
            got = self.library(piece)
        if len(piece) > 200:
            return got  # such pieces are rare: not kept
        self[piece] = got
        return got

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """All ids of a text as bytes; nothing for a null or empty text."""
        if not text:
            return b""
        if not self.fast:
            return self.library(text)
        pieces = filter(None, SPACES.split(text)) if NOT_SPACES.search(text) else text.split()
        return b"".join(map(self.__getitem__, pieces))


    def largest(self) -> int:
        return max(self.tokenizer.get_vocab().values(), default=0)


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The worker's encoder for a tokenizer file; by default the public 49k word vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
