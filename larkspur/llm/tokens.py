"""Token ids of texts by the public tokenizers, part by part with a bounded table.

Both vocabularies split a text before they merge, and no token spans a single space between two
characters that aren't white space (``byte_bpe``: the space goes with the part after it; ``word_bpe``:
white space is dropped). A text therefore encodes as its space-separated parts do, one after the
other. The tokenizers library encodes each distinct part once; a table from the part's 64-bit hash to
its ids then serves all its occurrences, by array operations. The first ``most`` parts, the frequent ones among
them, stay; of later ones a quarter as many are held at a time.
Where spaces carry meaning, a text with several spaces in a row, at an end, or next to other white space is
encoded whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from larkspur.llm.common import mix, text_chunks, word_hashes

#: Ends each document.
END_ID = 2
_HEAD = np.uint64(0x8F3C21D5A7B9E641)
_APART = -1
#: Keeps parts apart that are encoded together, and how many those are.
_SIGN = "\x01"
_TOGETHER = 200


class Table:
    """From 64-bit hashes to runs of ids: open addressing in arrays."""

    def __init__(self) -> None:
        self.slots = np.zeros(1 << 16, np.uint64)
        self.entry = np.zeros(1 << 16, np.int32)
        self.start, self.length = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int32)
        self.ids = np.zeros(1 << 17, np.uint32)
        self.n = self.used = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        mask = np.uint64(len(self.slots) - 1)
        at = (h & mask).astype(np.int64)
        got = self.slots[at]
        out = np.where(got == h, self.entry[at], -1)
        open_ = np.flatnonzero((got != h) & (got != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & int(mask)
            got = self.slots[at[open_]]
            hit = got == h[open_]
            out[open_[hit]] = self.entry[at[open_[hit]]]
            open_ = open_[~hit & (got != 0)]
        return out

    def _place(self, h: np.ndarray, entry: np.ndarray) -> None:
        mask = len(self.slots) - 1
        at = (h & np.uint64(mask)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = left[self.slots[at[left]] == 0]
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.slots[at[won]], self.entry[at[won]] = h[won], entry[won]
            done = np.zeros(len(h), bool)
            done[won] = True
            left = left[~done[left]]
            at[left] = (at[left] + 1) & mask

    def add(self, h: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        """Distinct new hashes, their ids one after the other, and how many each has (``_APART``: it doesn't stand alone)."""
        n, k = len(h), np.maximum(length, 0)
        while self.n + n > len(self.start):
            self.start, self.length = np.resize(self.start, 2 * len(self.start)), np.resize(self.length, 2 * len(self.length))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.start[self.n : self.n + n] = self.used + np.cumsum(k) - k
        self.length[self.n : self.n + n] = length
        self.ids[self.used : self.used + len(ids)] = ids
        new = np.arange(self.n, self.n + n, dtype=np.int32)
        self.n, self.used = self.n + n, self.used + len(ids)
        if 2 * self.n > len(self.slots):
            size = 1 << (4 * self.n).bit_length()
            old = self.slots != 0
            keys, entries = self.slots[old], self.entry[old]
            self.slots, self.entry = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._place(keys, entries)
        self._place(h, new)


    def cut(self, n: int) -> None:
        """Forget all but the first n entries."""
        kept = (self.slots != 0) & (self.entry < n)
        keys, entries = self.slots[kept], self.entry[kept]
        self.n, self.used = n, int(self.start[n])
        self.slots[:] = 0
        self._place(keys, entries)


class Encoder:
    def __init__(self, name: str, most: int = 1_600_000):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.spaced = name.startswith("byte_")
        self.most = most
        self.opens = next(t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values())
        self.sign_ids = self.whole(f" {_SIGN}")
        self.table = Table()

    @property
    def vocab_size(self) -> int:
        return self.tokenizer.get_vocab_size()

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, h: np.ndarray, parts: list[str], head: np.ndarray) -> None:
        """Add parts. Runs of them are encoded together, kept apart by a sign that none of them has."""
        texts = [p if not self.spaced or at_head else " " + p for p, at_head in zip(parts, head.tolist(), strict=True)]
        apart = np.array([self.spaced and (p[0].isspace() or p[-1].isspace()) for p in parts])
        single = ~apart & (head | np.array([_SIGN in p or self.opens in p for p in parts]) if self.spaced else np.array([_SIGN in p or self.opens in p for p in parts]))
        plain = np.flatnonzero(~single & ~apart)
        order = np.concatenate([np.flatnonzero(apart), np.flatnonzero(single), plain])
        codes = [self.whole(texts[i]) for i in np.flatnonzero(single)]
        length = [np.full(int(apart.sum()), _APART), np.array([len(c) for c in codes], np.int64)]
        glue = f" {_SIGN}" if self.spaced else f" {_SIGN} "
        for k in range(0, len(plain), _TOGETHER):
            ids = self.whole(glue.join([texts[i] for i in plain[k : k + _TOGETHER]]))
            cut = np.flatnonzero(ids == self.sign_ids[-1])
            length.append(np.diff(cut, prepend=-1, append=len(ids) + len(self.sign_ids) - 1) - len(self.sign_ids))
            codes.append(np.delete(ids, (cut[:, None] - np.arange(len(self.sign_ids))).ravel()))
        self.table.add(h[order], np.concatenate(codes) if codes else np.zeros(0, np.uint32), np.concatenate(length))

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a run of texts one after the other, each ended by ``END_ID``, and how many each has."""
        n = len(offs) - 1
        if self.table.n > self.most + self.most // 4:
            self.table.cut(self.most)
        inside = buf != 0x20
        first, last = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
        full = np.flatnonzero(np.diff(offs))
        first[offs[full]], last[offs[full + 1] - 1] = True, True
        before = np.zeros(len(buf), bool)
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | first))
        after = np.zeros(len(buf), bool)
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | last)) + 1
        row = np.searchsorted(offs, starts, "right") - 1
        h = word_hashes(buf, starts, ends, lower=False)
        h = mix(h + (ends - starts).astype(np.uint64)) | np.uint64(1)
        head = first[starts]
        alone = np.zeros(n, bool)  # to be encoded whole
        if self.spaced:
            h[head] = mix(h[head] ^ _HEAD) | np.uint64(1)
            blank = ~inside
            odd = blank & (first | last)
            odd[1:] |= blank[1:] & blank[:-1] & ~first[1:]
            alone[np.searchsorted(offs, np.flatnonzero(odd), "right") - 1] = True
        entry = self.table.find(h)
        lost = np.flatnonzero(entry < 0)
        if len(lost):
            keys, pick = np.unique(h[lost], return_index=True)
            raw, at = buf.tobytes(), lost[pick]
            self._learn(keys, [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], head[at])
            entry[lost] = self.table.find(h[lost])
        length = self.table.length[entry].astype(np.int64)
        alone[row[length == _APART]] = True
        length[length == _APART] = 0
        if alone.any():
            length[alone[row]] = 0
        count = np.bincount(row, length, n).astype(np.int64) + 1
        wholes = {}
        for i in np.flatnonzero(alone):
            wholes[i] = self.whole(buf[offs[i] : offs[i + 1]].tobytes().decode())
            count[i] = len(wholes[i]) + 1
        stop = np.cumsum(count)
        out = np.empty(int(stop[-1]) if n else 0, np.uint32)
        fill = np.ones(len(out), bool)
        fill[stop - 1] = False
        for i, ids in wholes.items():
            fill[stop[i] - count[i] : stop[i]] = False
            out[stop[i] - count[i] : stop[i] - 1] = ids
        out[stop - 1] = END_ID
        total = np.cumsum(length)
        if len(total) and total[-1]:
            out[fill] = self.table.ids[np.repeat(self.table.start[entry] - (total - length), length) + np.arange(int(total[-1]))]
        return out, count


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One encoder for each vocabulary in a Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


def encode_batches(batch: pa.RecordBatch, column: str, name: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids, counts) for runs of rows; a null text is empty."""
    for lo, _, buf, offs in text_chunks(batch, column):
        yield lo, *encoder(name).encode(buf, offs)
