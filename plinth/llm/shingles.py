"""Hashed word shingles of many texts at once."""

from __future__ import annotations

import numpy as np

from plinth.llm.common import chunks, pieces

CHUNK = 400_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _numbers(n: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt << 32)) * _M1) | np.uint64(1)


_BYTES = _numbers(256, 1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PLACES = _numbers(4096, 2)


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of bytes that end in white space, and where they start."""
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    length = stop - start
    first = np.cumsum(length) - length
    place = np.arange(first[-1] + length[-1]) - np.repeat(first, length)
    far = place >> 12
    weight = _PLACES[place & 4095]
    if far.any():
        weight = weight * (2 * mixed(far.astype(np.uint64) * _M1) + np.uint64(1))
    return mixed(np.add.reduceat(_BYTES[data[~space]] * weight, first) + length.astype(np.uint64) * _M1), start


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


def sets(texts: list[str | None], width: int):
    """The sorted distinct shingle hashes (uint64) of each text, in order.

    A-Z are lower-cased, words part at ASCII white space; a text of fewer words than width is one shingle, one without words
    has none. Equal shingles have equal hashes on every machine. A text's words are hashed piece by piece; of the whole text only
    the hashes are held.
    """
    weights = _numbers(width, 3)
    none = np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        for a, b in chunks(texts, CHUNK):
            own = [t or "" for t in texts[a:b]]
            if len(own) == 1:
                word = np.concatenate([none, *(_words(np.frombuffer(_bytes(p) + b"\n", np.uint8))[0] for _, p in pieces(own[0], CHUNK))])
                upto = np.array([len(word)])
            else:
                parts = [_bytes(t) for t in own]
                word, start = _words(np.frombuffer(b"\n".join([*parts, b""]), np.uint8))
                upto = np.searchsorted(start, np.cumsum([len(p) + 1 for p in parts]))  # words of this text and those before
            n = len(word) - width + 1
            rows = mixed(sum((word[j : j + n] * weights[j] for j in range(width)), np.zeros(n, np.uint64))) if n > 0 else none
            at = 0
            for end in upto.tolist():
                if end - at >= width:
                    yield np.unique(rows[at : end - width + 1])
                elif end > at:
                    yield mixed(np.array([(word[at:end] * weights[: end - at]).sum() + np.uint64(end - at) * _M3], np.uint64))
                else:
                    yield none
                at = end
