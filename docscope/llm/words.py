"""Words of whole Arrow columns by their hashes, without a Python object for each word.

The bytes of many texts are read as one array: word borders first, then the words' eight-byte parts, which are mixed
into 64 bits one after the other. Texts are taken in runs of about ``PART`` bytes, and a longer text in pieces cut at
word borders, so memory does not grow with a text but for its hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PART = 1 << 18
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
#: Translation tables of bytes: 1 for white space, and A-Z to a-z.
SPACES = bytes(1 if b == 0x20 or 9 <= b <= 13 else 0 for b in range(256))
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the len + 1 offsets of its texts; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8), at


def borders(inside: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and ends of the runs of ``inside``; a run ends at each of ``cuts``."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    if len(cuts):
        first[cuts] |= inside[cuts]
        last[cuts - 1] |= inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word data[start:end]; eight bytes must follow the last word."""
    eights = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))  # the eight bytes from each place on
    left = ends - starts
    out = mix((eights[starts] & _MASKS[np.minimum(left, 8)]) + left.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    more = np.flatnonzero(left > 8)
    step = 8
    while len(more):
        part = eights[starts[more] + step] & _MASKS[np.minimum(left[more] - step, 8)]
        with np.errstate(over="ignore"):
            out[more] = mix(out[more] * np.uint64(0x9E3779B97F4A7C55) + part)
        step += 8
        more = more[left[more] > step]
    return out


def parts(offsets: np.ndarray, size: int = PART) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts that hold about ``size`` bytes; a longer text is a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, end
        first = end


def pieces(data: bytes, spaces: bytes, size: int = PART) -> Iterator[bytes]:
    """A text in pieces of about ``size`` bytes, cut before white space."""
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data):
            step = data[end : end + 4096].translate(spaces).find(1)
            end += step if step >= 0 else 4096
            if step >= 0:
                break
        yield data[at:end]
        at = end


def _found(data: bytes, cuts: np.ndarray, spaces: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the words of prepared bytes."""
    inside = np.frombuffer(data.translate(spaces), bool)
    starts, ends = borders(~inside, cuts)
    return starts, hashes(np.frombuffer(data + bytes(8), np.uint8), starts, ends)


def lowered(data: bytes) -> bytes:
    return data.translate(LOWER)


def word_hashes(column: pa.Array, prepare=lowered, spaces: bytes = SPACES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, hashes, bounds) of runs of texts: text first + i has the hashes from bounds[i] to bounds[i + 1].

    ``prepare`` gives bytes of the same length to take words from.
    """
    data, offsets = raw(column)
    none = np.empty(0, np.int64)
    for first, end in parts(offsets):
        lo, hi = offsets[first], offsets[end]
        text = data[lo:hi].tobytes()
        if end == first + 1 and len(text) > 2 * PART:
            found = np.concatenate([_found(prepare(x), none, spaces)[1] for x in pieces(text, spaces)])
            yield first, end, found, np.array([0, len(found)])
            continue
        cuts = offsets[first + 1 : end] - lo
        starts, found = _found(prepare(text), cuts[(cuts > 0) & (cuts < hi - lo)], spaces)
        yield first, end, found, np.searchsorted(starts, offsets[first : end + 1] - lo)
