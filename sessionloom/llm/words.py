"""Word hashes of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MUL2 = np.uint64(0xBF58476D1CE4E5B9)
_BASE = np.uint64(0x100000001B3)
_powers = np.ones(1, np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Strings of so many bytes are named exactly by a key of two 64-bit numbers; the last byte of it is their size.
KEY_BYTES = 15
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 256), _BASE, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * _MUL
    x = (x ^ (x >> np.uint64(29))) * _MUL2
    return x ^ (x >> np.uint64(32))


def joined(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, each text ended by a line feed, and where each text ends, behind that line feed. The array has 16 more bytes behind its end."""
    sizes = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    data = np.frombuffer(b"\n".join([*raw, bytes(16)]), np.uint8)
    return data[: len(data) - 16], np.cumsum(sizes)


def keys_of(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each string in data (of `joined`): its first KEY_BYTES bytes and its size, up to 255."""
    eight = np.ndarray((len(data) + 9,), "<u8", data.base if data.base is not None else data, strides=(1,))
    low = eight[begin] & _MASK[np.minimum(size, 8)]
    high = eight[begin + 8] & _MASK[np.clip(size - 8, 0, 7)]
    return low, high | (np.minimum(size, 255).astype(np.uint64) << np.uint64(56))


def _hashes(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash for each string in data. Longer strings than KEY_BYTES add a polynomial of all their bytes."""
    low, high = keys_of(data, begin, length)
    out = mix(low ^ mix(high))
    long = np.flatnonzero(length > KEY_BYTES)
    if len(long):
        size = length[long]
        at = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(at, size)
        values = (data[place + np.repeat(begin[long], size)].astype(np.uint64) + np.uint64(1)) * powers(int(size.max()))[place]
        out[long] = mix(out[long] ^ np.add.reduceat(values, at))
    return out


class Words:
    """The words of texts: hash has one value a word, doc its text's place in the list, first each text's first word.

    data holds all bytes, each text ended by a line feed; text_starts has where each begins.
    """

    def __init__(self, texts: list[str] | list[bytes], gaps: np.ndarray = SPACE):
        """texts: strings or their UTF-8 bytes. gaps: which bytes part words; a line feed must be one of them."""
        raw = [t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in texts]
        self.data, self.text_ends = joined(raw)
        self.text_starts = self.text_ends - np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
        inside = ~gaps[self.data]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        self.begin, self.end = edges[::2], edges[1::2]
        self.length = self.end - self.begin
        self.doc = np.searchsorted(self.text_ends, self.begin, "right")
        self.count = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.hash = _hashes(self.data, self.begin, self.length) if len(self.length) else np.zeros(0, np.uint64)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every run of n words inside a text, and the place of its first word."""
        k = len(self.hash) - n + 1
        if k <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = self.hash[:k].copy()
        for i in range(1, n):
            total *= _MUL
            total += self.hash[i : k + i]
        at = np.flatnonzero(self.doc[:k] == self.doc[n - 1 :])
        return mix(total[at]), at

    def shingles(self, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words, in order of the texts, and each one's text. A text of 1 to n-1 words has one, of all its words."""
        value, at = self.windows(n)
        doc = self.doc[at]
        short = np.flatnonzero((self.count > 0) & (self.count < n))
        if len(short):
            extra = np.zeros(len(short), np.uint64)
            for k, d in enumerate(short):
                own = self.hash[self.first[d] : self.first[d] + self.count[d]]
                extra[k] = (own * powers(n + 1)[1 : len(own) + 1]).sum(dtype=np.uint64) + np.uint64(len(own))
            value, doc = np.concatenate((value, mix(extra))), np.concatenate((doc, short))
            order = np.argsort(doc, kind="stable")
            value, doc = value[order], doc[order]
        return value, doc
