"""Order equal-length windows of bytes by deep-shallow sorting.

Shallow: multikey quicksort, which takes eight bytes for one character, down to a fixed depth, for all buckets side by side.
Deep: windows that agree to that depth are put into a blind trie, which compares a newcomer bit by bit only
where the trie branches, and then once with the leaf it meets.
"""

from __future__ import annotations

import numpy as np

#: Bytes by which multikey quicksort orders; a multiple of eight.
SHALLOW = 24


def eights(data: np.ndarray) -> np.ndarray:
    """At each place, the next eight bytes as a number; behind the end follow zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded, (len(data), 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64)


def multikey(places: np.ndarray, buckets: np.ndarray, words: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order the windows that begin at `places` inside their buckets by their first `shallow` bytes.

    Returns the order, and for each window in that order the number of its run of equal beginnings.
    Every round splits each run in three around the character of its middle window; runs that equal the pivot go one character deeper.
    """
    order = np.argsort(buckets, kind="stable")
    run = np.cumsum(np.concatenate([[0], (np.diff(buckets[order]) != 0).astype(np.int64)])) if len(order) else order
    depth = np.zeros(len(order), np.int64)
    while True:
        edges = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1, [len(run)]]) if len(run) else np.zeros(1, np.int64)
        sizes = np.diff(edges)
        open_ = (sizes > 1) & (depth[edges[:-1]] < shallow)
        if not open_.any():
            return order, run
        starts, counts = edges[:-1][open_], sizes[open_]
        at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        keys = words[places[order[at]] + depth[at]]
        middle = np.cumsum(counts) - counts + counts // 2
        pivot = np.repeat(keys[middle], counts)
        side = 1 + (keys > pivot).astype(np.int64) - (keys < pivot)
        owner = np.repeat(np.arange(len(counts)), counts)
        sorted_ = np.argsort(owner * 3 + side, kind="stable")
        order[at] = order[at][sorted_]
        side = side[sorted_]
        depth[at] += 8 * (side == 1)
        breaks = np.concatenate([[0], (np.diff(run) != 0).astype(np.int64)])
        inner = np.concatenate([[False], (np.diff(side) != 0) & (np.diff(owner) == 0)])
        breaks[at[inner]] = 1
        run = np.cumsum(breaks)


def blind_trie(windows: list[bytes]) -> list[list[int]]:
    """The numbers of the windows in ascending order of the windows, equal ones together."""
    values = [int.from_bytes(w, "big") for w in windows]
    leaves: list[list[int]] = [[0]]
    # A node is a bit and the nodes below it; a leaf is a number of `leaves`.
    top: int | list = 0
    for k in range(1, len(values)):
        value, node = values[k], top
        while node.__class__ is list:
            node = node[1 + (value >> node[0] & 1)]
        apart = value ^ values[leaves[node][0]]
        if not apart:
            leaves[node].append(k)
            continue
        bit = apart.bit_length() - 1
        leaves.append([k])
        above, turn, node = None, 0, top
        while node.__class__ is list and node[0] > bit:
            above, turn = node, 1 + (value >> node[0] & 1)
            node = node[turn]
        new = [bit, node, len(leaves) - 1] if value >> bit & 1 else [bit, len(leaves) - 1, node]
        if above is None:
            top = new
        else:
            above[turn] = new
    out, stack = [], [top]
    while stack:
        node = stack.pop()
        if node.__class__ is list:
            stack += (node[2], node[1])
        else:
            out.append(leaves[node])
    return out


def equal_windows(data: np.ndarray, places: np.ndarray, buckets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the windows of `length` bytes at `places` in each bucket, and the number of each one's run of equals."""
    order, run = multikey(places, buckets, eights(data), min(SHALLOW, length // 8 * 8))
    edges = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1, [len(run)]]) if len(run) else np.zeros(1, np.int64)
    raw = data.tobytes()
    breaks = np.zeros(len(run), bool)
    breaks[edges[:-1]] = True
    for a, b in zip(edges[:-1][np.diff(edges) > 1].tolist(), edges[1:][np.diff(edges) > 1].tolist()):
        own = order[a:b]
        equals = blind_trie([raw[p : p + length] for p in places[own].tolist()])
        if len(equals) > 1:
            order[a:b] = own[[k for group in equals for k in group]]
            breaks[a + np.cumsum([len(group) for group in equals])[:-1]] = True
    return order, np.cumsum(breaks) - 1
