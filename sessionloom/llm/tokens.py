"""Token ids of whole texts by a public tokenizer's vocabulary, many texts at once, with a bounded table of pieces seen before."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from .words import KEY_BYTES, joined, keys_of, mix

#: Letters whose lower case and byte form need no care.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII letters 1, digits 2, marks but the apostrophe 3: a token never holds two of them. Of all else (0) that isn't said.
_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = _KIND[97:123] = 1
_KIND[48:58] = 2
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = 3
#: White space outside ASCII (U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000), in UTF-8.
_FAR_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80").search
_SLOTS = 20


def tokenizer_path(name: str) -> str:
    """name: a path, or a file of the installed public tokenizers."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable character by which byte-level vocabularies write each byte: itself where printable, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class _Pieces:
    """Ids of pieces seen before, by their exact bytes: entries in arrays, found through two hash slots each. Pieces of more than KEY_BYTES
    bytes are in a dict. Beyond `most` entries those that were used once go, and the less used ones until half are left."""

    def __init__(self, most: int):
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.slot = np.zeros(1 << _SLOTS, np.int32)
        self.low, self.high = np.zeros(4096, np.uint64), np.zeros(4096, np.uint64)
        self.start, self.size, self.used = np.zeros(4096, np.int64), np.zeros(4096, np.int64), np.zeros(4096, np.int32)
        self.flat = np.zeros(16384, np.uint32)
        self.n, self.n_flat, self.long = 1, 0, {}  # entry 0 is no piece

    def add(self, ids: list[int], sizes: list[int]) -> np.ndarray:
        """New entries without keys; ids: those of all of them after each other."""
        n, flat = self.n + len(sizes), self.n_flat + len(ids)
        for name, least in (("low", n), ("high", n), ("start", n), ("size", n), ("used", n), ("flat", flat)):
            own = getattr(self, name)
            if len(own) < least:
                setattr(self, name, np.concatenate((own, np.zeros(max(least - len(own), len(own) // 2), own.dtype))))
        self.flat[self.n_flat : flat] = ids
        self.size[self.n : n] = sizes
        self.start[self.n : n] = self.n_flat + np.cumsum(sizes) - sizes
        self.n, self.n_flat = n, flat
        return np.arange(n - len(sizes), n)

    def _slots(self, low, high):
        h = mix(low ^ mix(high))
        return h, (h >> np.uint64(64 - _SLOTS)).astype(np.int64), (h & np.uint64((1 << _SLOTS) - 1)).astype(np.int64)

    def find(self, low, high) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each key (0: none yet), and its hash."""
        h, one, two = self._slots(low, high)
        at = self.slot[one]
        no = np.flatnonzero((self.low[at] != low) | (self.high[at] != high))
        if len(no):
            other = self.slot[two[no]]
            at[no] = np.where((self.low[other] == low[no]) & (self.high[other] == high[no]), other, 0)
        return at, h

    def place(self, at: np.ndarray) -> None:
        """Lets entries be found by their keys; where both slots are taken the entry takes the first."""
        _, one, two = self._slots(self.low[at], self.high[at])
        free = self.slot[one] == 0
        self.slot[one[free]] = at[free]
        rest = at[self.slot[one] != at]
        if len(rest):
            _, one, two = self._slots(self.low[rest], self.high[rest])
            where = np.where(self.slot[two] == 0, two, one)
            self.slot[where] = rest

    def trim(self) -> None:
        """To be called between texts: entries' numbers change."""
        if self.n + len(self.long) <= self.most:
            return
        keyed = np.flatnonzero(self.high[: self.n])  # pieces of the dict have none
        keep = keyed[self.used[keyed] > 1]
        keep = keep[np.argsort(-self.used[keep], kind="stable")][: self.most // 2]
        low, high, used, size, start, flat = self.low[keep], self.high[keep], self.used[keep] // 2, self.size[keep], self.start[keep], self.flat
        self._clear()
        edge = np.cumsum(size) - size
        at = self.add(flat[np.arange(int(size.sum())) + np.repeat(start - edge, size)], size)
        self.low[at], self.high[at], self.used[at] = low, high, used
        self.place(at)


class Ids:
    """Ids of texts, as encode(text, add_special_tokens=False) gives them.

    Texts are cut at places where the tokenizer's own rules always end a token (around white space, or between ASCII letters, digits and
    marks), and pieces are looked up by their bytes. Only vocabularies of the two kinds named in `kind` can be cut so; others are
    encoded whole, and so are texts that may hold a special token or, where white space is kept, some outside ASCII.
    """

    def __init__(self, name: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer_path(name))
        config = str(self.tok.pre_tokenizer)
        self.lower = "Lowercase" in str(self.tok.normalizer)
        byte_level = "ByteLevel" in config
        self.kind = "words" if byte_level and self.lower and "Removed" in config else "bytes" if byte_level and self.tok.normalizer is None else "whole"
        space = r" ?" if self.kind == "bytes" else ""
        self.plain = re.compile(rf"{space}[{_LETTERS}]+").fullmatch
        self.letters, self.model = _byte_letters(), self.tok.model
        self.pieces = _Pieces(most)

    def _new(self, pieces: list[bytes]) -> np.ndarray:
        """Entries for pieces not seen before."""
        ids, sizes, plain, lower, letters, tokenize = [], [], self.plain, self.lower, self.letters, self.model.tokenize
        for raw in pieces:
            piece = raw.decode("utf-8", "surrogatepass")
            if plain(piece):  # letters only: the rules leave it as it is, so the model can be asked directly
                if lower:
                    raw = piece.lower().encode()
                own = [t.id for t in tokenize(raw.decode("latin-1").translate(letters))]
            else:
                own = self.whole(piece)
            ids += own
            sizes.append(len(own))
        return self.pieces.add(ids, sizes)

    def whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _cuts(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces begin and end in data; the last byte of each text, at ends - 1, is a line feed that is no part of it."""
        gap = _SPACE[data]
        after = np.empty_like(gap)  # white space or the text's edge comes before
        after[0], after[1:] = True, gap[:-1]
        kind = _KIND[data]
        start = np.zeros_like(gap)
        start[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        if self.kind == "words":  # white space is dropped
            start |= after & ~gap
            stop = np.empty_like(start)
            stop[-1], stop[:-1] = True, gap[1:] | start[1:]
            return np.flatnonzero(start), np.flatnonzero(stop & ~gap) + 1
        # of a run of white space before a word the last is apart, and with the word if it is a space
        last = np.zeros_like(gap)
        last[:-1] = gap[:-1] & ~gap[1:]
        last[ends - 1] = True
        head = np.zeros_like(gap)
        head[0] = True
        head[ends[:-1]] = True
        alone = after.copy()
        alone[1:] &= data[:-1] != 32
        alone |= head
        start |= last | np.where(gap, ~after | head, alone)
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(data))
        own = np.ones(len(data), bool)
        own[ends - 1] = False
        inside = own[begin]
        return begin[inside], end[inside]

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts after each other (unsigned 32-bit), and how many each text has; `end`, if given, closes each text."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        slow = [k for k, r in enumerate(raw) if self.kind == "whole" or b"<|" in r or (self.kind == "bytes" and not texts[k].isascii() and _FAR_SPACE(r))]
        if slow:
            raw = list(raw)
            for k in slow:
                raw[k] = b""
        ids, sizes = self._encode(raw, end)
        if not slow:
            return ids, sizes
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        for k in slow:
            parts[k] = np.array([*self.whole(texts[k]), *([] if end is None else [end])], np.uint32)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def _encode(self, raw: list[bytes], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        if not raw:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        store = self.pieces
        store.trim()
        data, ends = joined(raw)
        begin, stop = self._cuts(data, ends)
        size = stop - begin
        low, high = keys_of(data, begin, size)
        at, h = store.find(low, high)
        whole = data.data
        long = np.flatnonzero(size > KEY_BYTES)
        pieces = [bytes(whole[a:b]) for a, b in zip(begin[long].tolist(), stop[long].tolist(), strict=True)]
        new = [p for p in dict.fromkeys(pieces) if p not in store.long]
        store.long.update(zip(new, self._new(new).tolist(), strict=True))
        at[long] = [store.long[p] for p in pieces]
        while len(new := np.flatnonzero(at == 0)):
            hashes, first = np.unique(h[new], return_index=True)
            one = new[first]
            made = self._new([bytes(whole[a:b]) for a, b in zip(begin[one].tolist(), stop[one].tolist(), strict=True)])
            store.low[made], store.high[made] = low[one], high[one]
            store.place(made)
            # the same hash and another key waits for the next turn
            of = made[np.searchsorted(hashes, h[new])]
            same = (store.low[of] == low[new]) & (store.high[of] == high[new])
            at[new[same]] = of[same]
        store.used[: store.n] = np.minimum(store.used[: store.n] + np.bincount(at, minlength=store.n), 1 << 30)
        text = np.searchsorted(ends, begin, "right")
        count = np.bincount(text, minlength=len(raw))
        if end is not None:
            closing = store.add([end], [1])[0]
            every = np.empty(len(at) + len(raw), np.int64)
            every[np.arange(len(at)) + text] = at
            every[np.cumsum(count) + np.arange(len(raw))] = closing
            at, count = every, count + 1
        each = store.size[at]
        edge = np.concatenate(([0], np.cumsum(each)))
        place = np.arange(edge[-1]) + np.repeat(store.start[at] - edge[:-1], each)
        total = edge[np.cumsum(count)]
        return store.flat[place], np.diff(total, prepend=0)

    def __call__(self, text: str) -> bytes:
        return self.encode([text])[0].astype("<u4").tobytes()


@lru_cache(maxsize=1)
def ids_of(name: str) -> Ids:
    """One tokenizer at a time in a Python worker, so that its tasks share what was seen."""
    return Ids(name)
