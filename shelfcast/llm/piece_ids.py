"""Ids of distinct pieces: many pieces to a library call, and a compact memory of those seen lately."""

from __future__ import annotations

import os
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from shelfcast.llm.pretokens import byte_signs
from shelfcast.llm.text import spread

#: Pieces a worker process remembers: those met since the memory last turned over, and those met in the turn before.
REMEMBERED = 200_000
#: Bytes of a piece worth remembering.
REMEMBERED_BYTES = 64
#: Pieces joined to one text for the library.
JOINED = 64

Encoded = tuple[np.ndarray, np.ndarray]


class Memory:
    """Ids of pieces in two generations. A full young one becomes the old one, and what was not met since is forgotten."""

    def __init__(self, encode: Callable[[list[bytes]], Encoded], limit: int = REMEMBERED):
        self.encode, self.limit = encode, limit
        self.young, self.old = Generation(), Generation()

    def __call__(self, items: pa.Array) -> Encoded:
        """Ids of all distinct items (binary) end to end, and the number of ids of each."""
        if len(self.young.items) > self.limit:
            self.young, self.old = Generation(), self.young
        here = self.young.places(items)
        there = np.where(here < 0, self.old.places(items), -1)
        new = np.flatnonzero((here < 0) & (there < 0))
        made = self.encode(items.take(pa.array(new)).to_pylist())
        counts = np.empty(len(items), np.int64)
        parts = [(np.flatnonzero(here >= 0), self.young, here), (np.flatnonzero(there >= 0), self.old, there)]
        for at, generation, places in parts:
            counts[at] = generation.sizes[places[at]]
        counts[new] = made[1]
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.uint32)
        for at, generation, places in parts:
            out[spread(starts[at], counts[at])] = generation.ids[spread(generation.starts[places[at]], counts[at])]
        out[spread(starts[new], made[1])] = made[0]
        lengths = pc.binary_length(items).to_numpy(zero_copy_only=False)
        kept = np.flatnonzero((here < 0) & (lengths <= REMEMBERED_BYTES))
        self.young.add(items.take(pa.array(kept)), out[spread(starts[kept], counts[kept])], counts[kept])
        return out, counts


class Generation:
    def __init__(self):
        self.items = pa.array([], pa.large_binary())
        self.ids, self.sizes, self.starts = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def places(self, items: pa.Array) -> np.ndarray:
        """The number of each item here, -1 for others."""
        return pc.fill_null(pc.index_in(items, value_set=self.items), -1).to_numpy(zero_copy_only=False)

    def add(self, items: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.items = pa.concat_arrays([self.items, items.cast(pa.large_binary())])
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.ids = np.concatenate([self.ids, ids])
        self.sizes = np.concatenate([self.sizes, sizes.astype(np.int32)])


class LibraryPieces:
    """The tokenizers library on distinct pieces.

    It cuts a text before a space that follows something else than white space, so pieces that begin with a space and don't end with white
    space are joined to one text; which ids are whose follows from the bytes of the ids. ``joinable`` may be true of such pieces only.
    """

    def __init__(self, tokenizer, joinable: Callable[[bytes], bool]):
        self.joinable = joinable
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = tokenizer
        signs = byte_signs()
        self.bytes_of = np.zeros(tokenizer.get_vocab_size(), np.int64)
        for text, i in tokenizer.get_vocab().items():
            self.bytes_of[i] = len(text) if all(c in signs for c in text) else len(text.encode())

    def __call__(self, items: list[bytes]) -> Encoded:
        lead = np.fromiter(map(self.joinable, items), bool, len(items))
        joined, alone = np.flatnonzero(lead).tolist(), np.flatnonzero(~lead).tolist()
        texts = [b"".join([items[i] for i in joined[k : k + JOINED]]) for k in range(0, len(joined), JOINED)]
        ids = self._ids(texts)
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, sum(map(len, ids)))
        ends = np.concatenate([[0], np.cumsum(self.bytes_of[flat])])
        # An id ends where a piece ends, as none is cut across pieces.
        last = np.searchsorted(ends, np.cumsum([len(items[i]) for i in joined], dtype=np.int64))
        counts = np.empty(len(items), np.int64)
        counts[joined] = np.diff(last, prepend=0)
        own = self._ids([items[i] for i in alone])
        counts[alone] = [len(x) for x in own]
        out = np.empty(int(counts.sum()), np.uint32)
        starts = np.cumsum(counts) - counts
        out[spread(starts[joined], counts[joined])] = flat
        out[spread(starts[alone], counts[alone])] = np.fromiter(chain.from_iterable(own), np.uint32, sum(map(len, own)))
        return out, counts

    def _ids(self, texts: list[bytes]) -> list[list[int]]:
        # The library's results are large objects, so few at a time.
        out = []
        for k in range(0, len(texts), 1 << 12):
            out += [x.ids for x in self.tokenizer.encode_batch_fast([t.decode() for t in texts[k : k + (1 << 12)]], add_special_tokens=False)]
        return out


def closed(piece: bytes) -> bool:
    """Whether a piece begins with a space and ends with printable ASCII or a letter of two bytes from C3 on, none of which is white space."""
    return len(piece) > 1 and piece[0] == 0x20 and (0x20 < piece[-1] < 0x7F or piece[-1] >= 0x80 and 0xC3 <= piece[-2] <= 0xDF)
