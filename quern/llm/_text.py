"""Vectorised word hashing shared by the text operators.

Words are hashed over whole byte buffers with numpy, so no Python object is made for a word. A word's blocks of
eight bytes are mixed, each with its place, and summed; the hash is the same in every process.
"""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
#: Blocks of a word that are hashed side by side with those of other words; a longer word goes on alone.
_SIDE_BY_SIDE = 64
_CHUNK = 1 << 17

#: Upper-case ASCII letters to lower case, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Separators of words ``[^\x20\x09-\x0D]+``.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: By the number of bytes that a block has.
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def windows(buf: bytes) -> np.ndarray:
    """The eight bytes from each place of ``buf`` on, as a number; zeros follow its end."""
    return np.ndarray((len(buf) + 1,), "<u8", buf + bytes(8), strides=(1,))


def blocks(view: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of eight bytes of strings one after another (the last ones padded with zeros), and each string's number of them."""
    n = (length + 7) // 8
    past = np.cumsum(n)
    inside = (np.arange(past[-1] if len(past) else 0) - np.repeat(past - n, n)) * 8
    return view[np.repeat(start, n) + inside] & _BYTES[np.minimum(np.repeat(length, n) - inside, 8)], n


def _spans(arr: np.ndarray, seps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of bytes that are no separators."""
    inside = np.zeros(len(arr) + 2, np.int8)
    inside[1:-1] = ~seps[arr]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def hash_words(buf: bytes, seps: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words in ``buf``; word bytes count as they are, so lower-case first."""
    starts, ends = _spans(np.frombuffer(buf, np.uint8), seps)
    length = ends - starts
    view = windows(buf)
    out = length.astype(np.uint64)
    left, at = np.arange(len(starts)), 0
    while len(left) and at < _SIDE_BY_SIDE:
        rest = length[left] - 8 * at
        out[left] += mix((view[starts[left] + 8 * at] & _BYTES[np.minimum(rest, 8)]) ^ _places(at, 1))
        left, at = left[rest > 8], at + 1
    for i in left.tolist():
        out[i : i + 1] += _rest(buf[int(starts[i]) + 8 * at : int(ends[i])], at)
    return starts, ends, mix(out)


def _places(first: int, n: int) -> np.ndarray:
    return mix(np.arange(first + 1, first + n + 1, dtype=np.uint64) * np.uint64(_BASE))


def _rest(raw: bytes, first: int) -> np.ndarray:
    """The sum over the blocks of ``raw``, the first of which is a word's block ``first``."""
    cells = np.frombuffer(raw + bytes(-len(raw) % 8), "<u8")
    total = np.zeros(1, np.uint64)
    for i in range(0, len(cells), _CHUNK):
        part = cells[i : i + _CHUNK]
        total += mix(part ^ _places(first + i, len(part))).sum(dtype=np.uint64)
    return total


def batch_words(texts: list[bytes | None], seps: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all ``texts`` in order, and for each text the place of its first word (with the total last)."""
    texts = [t or b"" for t in texts]
    buf = b" ".join(texts).translate(LOWER)
    starts, _, hashes = hash_words(buf, seps)
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    return hashes, np.concatenate([[0], np.searchsorted(starts, ends)]).astype(np.int64)


def shingle_sets(texts: list[bytes | None], width: int = 5) -> list[np.ndarray]:
    """For each text its sorted distinct hashes of ``width`` words; the whole sequence as one where it is shorter; none without words."""
    words, first = batch_words(texts)
    n = len(words)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for j in range(width if len(rolled) else 0):
        rolled += words[j : j + len(rolled)] * np.uint64(pow(_BASE, 7 * j + 3, 1 << 64))
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(rolled[a : b - width + 1])
            out.append(s if len(s) < 2 else s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            h = b - a
            for w in words[a:b].tolist():
                h = (h * _BASE + w) & _MASK
                h ^= h >> 29
            out.append(mix(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
