"""Canonical length-limited Huffman codes over arrays of ids.

Codes are assigned in the order of their length, then of the symbol, so the lengths alone are the codebook.
Bits are packed from the highest of big-endian 32-bit words. A run of ids is cut into blocks of equal
numbers of ids; the bit at which each block begins is kept as a checkpoint, so blocks decode
independently, and many of them side by side: one table lookup per id, for all blocks at once.
"""

from __future__ import annotations

import numpy as np

#: Bits of the longest code, unless the symbols need more.
LONGEST = 16
#: Ids of a block.
BLOCK = 256


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most `longest` bits for the symbols with a count; zero for the others.

    Package-merge: at each level the lightest items are symbols or packages of two items of the level
    below; a symbol is as long as the number of levels at which it is taken.
    """
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    longest = max(longest, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    levels, items = [np.ones(len(weights), bool)], weights
    for _ in range(longest - 1):
        packages = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, packages])
        ranked = np.argsort(both, kind="stable")
        levels.append(ranked < len(weights))
        items = both[ranked]
    lengths, taken = np.zeros(len(weights), np.uint8), 2 * len(weights) - 2
    for symbols in reversed(levels):
        n = int(symbols[:taken].sum())
        lengths[:n] += 1
        taken = 2 * (taken - n)
    out[order] = lengths
    return out


class Codebook:
    """Codes and the decoding table of given code lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.width = int(lengths.max(initial=1))
        used = np.flatnonzero(lengths)
        order = used[np.argsort(lengths[used], kind="stable")]
        room = 1 << (self.width - self.lengths[order])
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = ((np.cumsum(room) - room) >> (self.width - self.lengths[order])).astype(np.uint64)
        # A lone symbol leaves half of the table unused.
        self.symbol = np.resize(np.repeat(order, room), 1 << self.width) if len(order) else np.zeros(2, np.int64)
        self.step = self.lengths[self.symbol] if len(order) else np.ones(2, np.int64)

    def pack(self, ids: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
        """The packed bits, and the first bit of each block."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        at = ends - size
        words = np.zeros(int(ends[-1] if len(ids) else 0) // 32 + 2, np.uint64)
        if len(ids):
            value = self.codes[ids] << (64 - (at & 31) - size).astype(np.uint64)
            word = at >> 5
            begins = np.flatnonzero(np.diff(word, prepend=-1))
            # Codes don't overlap, so a sum joins their bits.
            words[word[begins]] += np.add.reduceat(value >> np.uint64(32), begins)
            words[word[begins] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), begins)
        return words.astype(">u4").tobytes(), at[::block]

    def unpack(self, packed: bytes, checkpoints: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
        """The n ids packed behind these checkpoints."""
        words = np.frombuffer(packed, ">u4").astype(np.uint64)
        # The last block may be shorter: its idle steps read on into zeros.
        words = np.concatenate([words, np.zeros(block * self.width // 32 + 2, np.uint64)])
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        at, out = checkpoints.astype(np.int64), np.empty((min(block, n), len(checkpoints)), np.uint32)
        drop = np.uint64(64 - self.width)
        for i in range(len(out)):
            peek = (pairs[at >> 5] << (at & 31).astype(np.uint64)) >> drop
            out[i] = self.symbol[peek]
            at = at + self.step[peek]
        return out.T.reshape(-1)[:n] if len(checkpoints) else np.zeros(0, np.uint32)
