"""Exact encoding with public tokenizer files, whole batches at a time.

The library spends microseconds on each word, and a corpus repeats its words.
Both vocabularies split a text before any merge, and no part of that split
crosses the borders used here, so each distinct part is encoded once by the
library and the ids of a text are the ids of its parts in turn. The tests hold
this against the library on whole texts.

Borders are found over the bytes of a batch at once. A part of at most
``SHORT`` bytes is looked up by its very bytes, as three machine words, in an
open hash table of numpy arrays; longer parts are looked up in a dictionary.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa

from ._common import single_threaded

#: Unicode White_Space beyond ASCII, as the tokenizers' patterns see it: texts with it are encoded whole.
_WIDE_SPACE = re.compile("[\x85\xa0  -     　]")
#: Punctuation whose runs are whole parts of either vocabulary's own split, next to letters or white space.
_MARKS = b".,;:!?%$&*#|"
_SPACE, _LETTER, _MARK, _OTHER = range(4)

_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[[*range(0x80, 0xC0), 0xC3]] = _LETTER  # letters of Latin-1 but for two signs; what else continues has an other byte in front
_KIND[list(_MARKS)] = _MARK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_U = np.uint64

#: Bytes of a part that the table keeps in its key, whose last byte is their count, and the part of each of three words that they fill.
SHORT = 23
_MASKS = np.array([[(1 << 8 * min(8, max(0, n - 8 * k))) - 1 for k in range(3)] for n in range(SHORT + 1)], dtype=_U)
#: Slots of the table; it is emptied at half as many parts, and the dictionary of longer ones at ``MOST_LONG``.
SLOTS, MOST_LONG = 1 << 21, 100_000
#: Longer parts than this are encoded each time.
LONGEST_KEPT = 96
#: Bytes looked at in one step; a longer text is a step of its own.
STEP = 1 << 20


def _mix(keys: np.ndarray) -> np.ndarray:
    h = keys[:, 0] * _U(0x9E3779B97F4A7C15)
    h ^= (h >> _U(32)) ^ keys[:, 1] * _U(0xC2B2AE3D27D4EB4F)
    h ^= (h >> _U(29)) ^ keys[:, 2] * _U(0x165667B19E3779F9)
    h *= _U(0xBF58476D1CE4E5B9)
    return ((h >> _U(40)) & _U(SLOTS - 1)).astype(np.int64)


def _of_runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each run, one after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class CachedEncoder:
    """``encode(texts)`` gives the ids of all texts in a row and how many each has.

    ``file`` is a tokenizers JSON file. ``keeps_space`` says whether the
    vocabulary has white space in its parts (byte-level) or drops it and lowers letters.
    """

    def __init__(self, file: str, keeps_space: bool, dtype: str = "<u4"):
        if sys.byteorder != "little":
            raise NotImplementedError("parts are compared as the machine holds them")
        single_threaded()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.keeps_space, self.dtype = keeps_space, np.dtype(dtype)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._empty()

    def _empty(self) -> None:
        self.slots = np.full(SLOTS, -1, dtype=np.int32)
        self.keys = np.zeros((1 << 14, 3), dtype=_U)
        self.starts, self.counts = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)
        self.flat, self.size, self.n = np.zeros(1 << 16, dtype=self.dtype), 0, 0
        self.long: dict[bytes, int] = {}

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def _learn(self, parts: list[bytes]) -> np.ndarray:
        """Encodes parts and returns their numbers."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)]
        counts = np.array([len(x) for x in ids], dtype=np.int64)
        new = np.array([x for y in ids for x in y], dtype=self.dtype)
        first, n = self.n, len(parts)
        while len(self.counts) < first + n:
            self.counts, self.starts = np.concatenate([self.counts, np.zeros_like(self.counts)]), np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)])
        while len(self.flat) < self.size + len(new):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.counts[first : first + n] = counts
        self.starts[first : first + n] = self.size + np.cumsum(counts) - counts
        self.flat[self.size : self.size + len(new)] = new
        self.size, self.n = self.size + len(new), first + n
        return np.arange(first, first + n)

    def _found(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, -1 where it is unknown."""
        slot = _mix(keys)
        got = self.slots[slot]
        differ = (self.keys[got] != keys).any(axis=1) & (got >= 0)
        todo = np.flatnonzero(differ)
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (SLOTS - 1)
            got[todo] = self.slots[slot[todo]]
            todo = todo[(got[todo] >= 0) & (self.keys[got[todo]] != keys[todo]).any(axis=1)]
        return got

    def _keep(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        self.keys[numbers] = keys
        slot = _mix(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.slots[slot[todo]] < 0]
            at, who = np.unique(slot[free], return_index=True)
            self.slots[at] = numbers[free[who]]
            todo = todo[self.slots[slot[todo]] != numbers[todo]]
            slot[todo] = (slot[todo] + 1) & (SLOTS - 1)

    def _borders(self, b: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the parts of bytes; ``begin`` are those at which texts start. White space counts only where it is kept."""
        kind = _KIND[b]
        ends = begin[1:] - 1  # last bytes of texts, where these are not empty
        ends = ends[np.diff(begin) > 0]
        firsts = begin[:-1][np.diff(begin) > 0]
        sign = np.flatnonzero(b[:-1] == 0xC3)  # two signs stand among the letters
        sign = sign[(b[sign + 1] == 0x97) | (b[sign + 1] == 0xB7)]
        kind[sign] = _OTHER
        white = kind == _SPACE
        edge = np.empty(len(b), dtype=bool)
        edge[0] = True
        np.not_equal(white[1:], white[:-1], out=edge[1:])
        edge[firsts] = True  # where a run of white space or of other bytes starts
        cut = np.empty(len(b), dtype=bool)
        cut[0] = False
        np.not_equal(kind[1:], kind[:-1], out=cut[1:])
        cut &= ~edge
        runs = np.flatnonzero(edge)
        within = np.flatnonzero(cut)
        if len(within):  # runs of letters and marks alone are cut where these meet
            plain = np.maximum.reduceat(kind, runs) < _OTHER
            within = within[plain[np.searchsorted(runs, within, side="right") - 1]]
            edge[within] = True
        if self.keeps_space:
            last = np.empty(len(b), dtype=bool)  # white space before other bytes of its text
            np.logical_and(white[:-1], ~white[1:], out=last[:-1])
            last[-1] = False
            last[ends] = False
            last = np.flatnonzero(last)
            edge[last] = True
            edge[last[b[last] == 0x20] + 1] = False  # one space belongs to what follows
            starts = np.flatnonzero(edge)
            return starts, np.diff(starts, append=len(b))
        starts = np.flatnonzero(edge)
        lengths = np.diff(starts, append=len(b))
        word = ~white[starts]
        return starts[word], lengths[word]

    def _numbers(self, raw: bytes, b: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Number of each part."""
        if self.n > SLOTS // 2 or len(self.long) > MOST_LONG:
            self._empty()
        out = np.empty(len(starts), dtype=np.int64)
        short = np.flatnonzero(lengths <= SHORT)
        at, n = starts[short], lengths[short]
        words = np.ndarray((len(b) - 7,), "<u8", buffer=raw, strides=(1,))
        keys = np.stack([words[at], words[at + 8], words[at + 16]], axis=1) & _MASKS[n]
        keys[:, 2] |= n.astype(_U) << _U(56)
        got = self._found(keys)
        new = np.flatnonzero(got < 0)
        if len(new):
            _, first, same = np.unique(np.ascontiguousarray(keys[new]).view("V24").reshape(-1), return_index=True, return_inverse=True)
            first = new[first]
            numbers = self._learn([raw[s : s + k] for s, k in zip(at[first].tolist(), n[first].tolist())])
            self._keep(keys[first], numbers)
            got[new] = numbers[same]
        out[short] = got
        long = np.flatnonzero(lengths > SHORT)
        if len(long):
            parts = [raw[s : s + k] for s, k in zip(starts[long].tolist(), lengths[long].tolist())]
            new = list(dict.fromkeys(p for p in parts if p not in self.long))
            once = dict(zip(new, self._learn(new).tolist())) if new else {}
            out[long] = [self.long[p] if p in self.long else once[p] for p in parts]
            self.long |= {p: k for p, k in once.items() if len(p) <= LONGEST_KEPT}
        return out

    def _step(self, raw: bytes, sizes: np.ndarray, odd: dict[int, str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their counts of texts whose bytes are ``raw``, followed by zeros; ``odd`` texts are encoded whole."""
        begin = np.concatenate([[0], np.cumsum(sizes)])
        n = int(begin[-1])
        counts = np.zeros(len(sizes), dtype=np.int64)
        if n:
            b = np.frombuffer(raw, np.uint8)
            starts, lengths = self._borders(b[:n], begin)
            number = self._numbers(raw, b, starts, lengths)
            many = self.counts[number]
            ids = self.flat[_of_runs(self.starts[number], many)]
            before = np.concatenate([[0], np.cumsum(many)])
            counts = np.diff(before[np.searchsorted(starts, begin)])
        else:
            ids = np.zeros(0, dtype=self.dtype)
        if odd:
            parts, before = [], np.concatenate([[0], np.cumsum(counts)])
            last = 0
            for k, text in odd.items():
                whole = self._whole(text)
                parts += [ids[before[last] : before[k]], whole]
                counts[k], last = len(whole), k + 1
            ids = np.concatenate([*parts, ids[before[last] :]])
        return ids, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and the count of each."""
        ids, counts = [], []
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        data = texts.buffers()[2] if len(texts) else None
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP, side="right")) - 1)
            raw = data.slice(offsets[at], offsets[end] - offsets[at]).to_pybytes() if data is not None else b""
            sizes = np.diff(offsets[at : end + 1])
            odd = self._odd(raw, sizes)
            if odd:  # their place stays empty
                begin = np.cumsum(sizes) - sizes
                kept = [b"" if k in odd else raw[s : s + n] for k, (s, n) in enumerate(zip(begin.tolist(), sizes.tolist()))]
                raw, sizes = b"".join(kept), np.array([len(x) for x in kept])
            if not self.keeps_space:
                raw = raw.translate(_LOWER.tobytes())
            got, many = self._step(raw + bytes(SHORT + 1), sizes, odd)
            ids.append(got)
            counts.append(many)
            at = end
        none = np.zeros(0, dtype=np.int64)
        return np.concatenate([np.zeros(0, dtype=self.dtype), *ids]), np.concatenate([none, *counts])

    def _odd(self, raw: bytes, sizes: np.ndarray) -> dict[int, str]:
        """Texts with special tokens, which may hold what the borders would cut, or with white space beyond ASCII."""
        places = []
        low = raw if self.keeps_space else raw.lower()
        for s in self.specials:
            at = low.find(s.encode())
            while at >= 0:
                places.append(at)
                at = low.find(s.encode(), at + 1)
        b = np.frombuffer(raw, np.uint8)
        if len(b) > 1 and not raw.isascii():
            lead = np.flatnonzero((b == 0xC2) | (b == 0xE1) | (b == 0xE2) | (b == 0xE3))
            lead = lead[lead < len(b) - 1]
            after = b[lead + 1]
            first = b[lead]
            may = (first == 0xC2) & ((after == 0x85) | (after == 0xA0)) | (first == 0xE1) & (after == 0x9A) | (first == 0xE2) & ((after == 0x80) | (after == 0x81)) | (first == 0xE3) & (after == 0x80)
            lead, first = lead[may], first[may]
            places += [p for p, f in zip(lead.tolist(), first.tolist()) if f == 0xC2 or _WIDE_SPACE.match(raw[p : p + 3].decode())]
        if not places:
            return {}
        begin = np.cumsum(sizes) - sizes
        whole = sorted({int(k) for k in np.searchsorted(begin, places, side="right") - 1})
        return {k: raw[begin[k] : begin[k] + sizes[k]].decode() for k in whole}

    def ids_many(self, texts: list[str]) -> list[bytes]:
        ids, counts = self.encode(pa.array(texts, pa.string()))
        ends = np.cumsum(counts)
        return [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), counts.tolist())]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with one more at the end of each text."""
    out = np.full(len(ids) + len(counts), end_id, dtype=ids.dtype)
    inside = np.ones(len(out), dtype=bool)
    inside[np.cumsum(counts + 1) - 1] = False
    out[inside] = ids
    return out, counts + 1


_encoders: dict[tuple, CachedEncoder] = {}


def encoder(file: str, keeps_space: bool, dtype: str = "<u4") -> CachedEncoder:
    """One encoder for each Python worker; workers are reused, and so is its table."""
    key = (file, keeps_space, dtype)
    if key not in _encoders:
        _encoders[key] = CachedEncoder(*key)
    return _encoders[key]


def default_file(name: str) -> str:
    """Where a public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
