"""Growth of regression trees on binned inputs, from sums that don't depend on the order of rows.

Inputs are bin numbers; a cell is a bin of one input, numbered through all inputs. Targets are whole numbers in
float64 whose sums stay below 2**53, so sums are exact and a tree is the same however its rows are dealt out. What
a split needs is the count and the sum in every cell of a node; whether they come from one task or from many,
:func:`best_splits` decides.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

# Rows, so that their bins stay in the processor's cache, and cells of all searched nodes, that are counted at a time.
ROWS_AT_A_TIME = 1 << 14
CELLS_AT_A_TIME = 1 << 22
# Cells of all searched nodes up to which their sums are kept, to take siblings' sums from.
CELLS_KEPT = 1 << 19
# Nodes up to which each is counted by itself.
NODES_APART = 16
# A gain below this share of the sums it is the difference of is rounding.
LEAST_GAIN = 1e-12


@dataclass(frozen=True)
class Rules:
    """How trees grow. ``max_leaves`` 0: no limit. ``random_thresholds``: one drawn threshold for each node and input."""

    depth: int
    least_rows: float = 1
    penalty: float = 0.0
    max_leaves: int = 0
    random_thresholds: bool = False
    seed: int = 0


@dataclass(frozen=True)
class Cells:
    """Per input the upper edges of all its bins but the last."""

    edges: tuple[np.ndarray, ...]
    starts: np.ndarray = field(init=False)
    inputs: np.ndarray = field(init=False)
    total: int = field(init=False)

    def __post_init__(self):
        sizes = np.array([len(e) + 1 for e in self.edges], np.int64)
        object.__setattr__(self, "starts", np.cumsum(sizes) - sizes)
        object.__setattr__(self, "inputs", np.repeat(np.arange(len(sizes)), sizes))
        object.__setattr__(self, "total", int(sizes.sum()))

    def bins(self, values: np.ndarray) -> np.ndarray:
        """Bin numbers of rows of values."""
        return np.column_stack([np.searchsorted(e, values[:, k], side="left") for k, e in enumerate(self.edges)]).astype(np.uint8)


class Tree:
    """Nodes in the order they were found. A node's path has one bit for each step from the root, after a leading one."""

    def __init__(self, path: int = 1, n: float = 0.0, g: float = 0.0):
        self.path, self.n, self.g = [path], [n], [g]
        self.input, self.bin, self.gain, self.left, self.searched = [-1], [0], [-np.inf], [-1], [False]

    def add(self, path: int, n: float, g: float) -> int:
        for column, value in zip((self.path, self.n, self.g, self.input, self.bin, self.gain, self.left, self.searched), (path, n, g, -1, 0, -np.inf, -1, False)):
            column.append(value)
        return len(self.path) - 1

    def split(self, node: int, column: int, bin_number: int, gain: float, left: tuple[float, float]) -> None:
        n, g = self.n[node], self.g[node]
        self.input[node], self.bin[node], self.gain[node] = column, bin_number, gain
        self.left[node] = self.add(2 * self.path[node], *left)
        self.add(2 * self.path[node] + 1, n - left[0], g - left[1])

    def graft(self, node: int, other: "Tree") -> None:
        """Put another tree, grown from the node's rows, in the node's place."""
        places = {0: node}
        self.n[node], self.g[node] = other.n[0], other.g[0]
        for i in range(len(other.path)):
            here = places[i]
            self.searched[here] = True
            if other.input[i] >= 0:
                child = other.left[i]
                self.input[here], self.bin[here], self.gain[here] = other.input[i], other.bin[i], other.gain[i]
                self.left[here] = self.add(other.path[child], other.n[child], other.g[child])
                self.add(other.path[child + 1], other.n[child + 1], other.g[child + 1])
                places[child], places[child + 1] = self.left[here], self.left[here] + 1

    def arrays(self) -> dict[str, np.ndarray]:
        return {
            "path": np.array(self.path, np.int64), "input": np.array(self.input, np.int16), "bin": np.array(self.bin, np.int16), "gain": np.array(self.gain),
            "left": np.array(self.left, np.int32), "n": np.array(self.n), "g": np.array(self.g),
        }

    @staticmethod
    def of_arrays(found: dict[str, np.ndarray]) -> "Tree":
        out = Tree()
        for name, values in found.items():
            setattr(out, name, values.tolist())
        out.searched = [True] * len(out.path)
        return out


def nodes_to_search(tree: Tree, rules: Rules) -> list[int]:
    """Nodes whose best split has to be known next: all of a level, or those that best-first growth would reach with what is known."""
    able = [not s and p.bit_length() - 1 < rules.depth and n >= 2 * rules.least_rows for s, p, n in zip(tree.searched, tree.path, tree.n)]
    if not rules.max_leaves:
        return [i for i, ok in enumerate(able) if ok]
    if able[0]:
        return [0]
    wanted, heap, leaves = [], [], 1
    if tree.input[0] >= 0:
        heap.append((-tree.gain[0], tree.path[0], 0))
    while heap and leaves < rules.max_leaves:
        _, _, node = heapq.heappop(heap)
        leaves += 1
        for child in (tree.left[node], tree.left[node] + 1):
            if able[child]:
                wanted.append(child)
            elif tree.input[child] >= 0:
                heapq.heappush(heap, (-tree.gain[child], tree.path[child], child))
    return wanted


def best_first(tree: Tree, max_leaves: int) -> Tree:
    """The tree that growth by the largest gain gives up to ``max_leaves`` leaves; 0: the tree as it is."""
    if not max_leaves:
        return tree
    out = Tree(tree.path[0], tree.n[0], tree.g[0])
    heap = [(-tree.gain[0], tree.path[0], 0, 0)] if tree.input[0] >= 0 else []
    leaves = 1
    while heap and leaves < max_leaves:
        _, _, node, here = heapq.heappop(heap)
        leaves += 1
        child = tree.left[node]
        out.split(here, tree.input[node], tree.bin[node], tree.gain[node], (tree.n[child], tree.g[child]))
        for k in (0, 1):
            if tree.input[child + k] >= 0:
                heapq.heappush(heap, (-tree.gain[child + k], tree.path[child + k], child + k, out.left[here] + k))
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(keys: np.ndarray, *streams: int) -> np.ndarray:
    """A number in [0, 1) for each key, fixed by the key and the streams."""
    state = np.asarray(keys).astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        for stream in streams:
            state = mixed(state + np.uint64(0x9E3779B97F4A7C15) * np.uint64((stream + 1) & 0xFFFFFFFF))
    return (state >> np.uint64(11)).astype(np.float64) * 2.0**-53


def dense_sums(slots: np.ndarray | None, bins: np.ndarray, rows: np.ndarray, n: np.ndarray | None, g: np.ndarray, cells: Cells, slot_count: int) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum of every cell of every slot over some rows. ``slots``: of each of them; None if there is one. ``n``: None if every row counts once."""
    count, total = np.zeros((slot_count, cells.total)), np.zeros((slot_count, cells.total))
    step, ends = max(ROWS_AT_A_TIME, slot_count << 8), np.append(cells.starts[1:], cells.total).tolist()
    for i in range(0, len(rows), step):
        part = rows[i : i + step]
        block, times, sums = bins[part], None if n is None else n[part], g[part]
        own = None if slots is None else slots[i : i + step] << 8
        for k, (start, end) in enumerate(zip(cells.starts.tolist(), ends)):
            keys = block[:, k].astype(np.intp)
            keys = keys if own is None else keys + own
            count[:, start:end] += np.bincount(keys, weights=times, minlength=slot_count << 8).reshape(slot_count, 256)[:, : end - start]
            total[:, start:end] += np.bincount(keys, weights=sums, minlength=slot_count << 8).reshape(slot_count, 256)[:, : end - start]
    return count.ravel(), total.ravel()


def cell_counts(bins: np.ndarray, cells: Cells) -> np.ndarray:
    """Rows in every cell."""
    return np.concatenate([np.bincount(bins[:, k], minlength=len(e) + 1) for k, e in enumerate(cells.edges)]).astype(np.float64)


def most_rows_sums(bins: np.ndarray, unseen: np.ndarray, g: np.ndarray, cells: Cells, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum of every cell over all rows but the unseen ones, whose ``g`` is 0. ``counts``: :func:`cell_counts` of all rows."""
    total = np.zeros(cells.total)
    for i in range(0, len(bins), ROWS_AT_A_TIME):
        block, sums = bins[i : i + ROWS_AT_A_TIME], g[i : i + ROWS_AT_A_TIME]
        for k, (start, e) in enumerate(zip(cells.starts.tolist(), cells.edges)):
            total[start : start + len(e) + 1] += np.bincount(block[:, k], weights=sums, minlength=len(e) + 1)
    return (counts - cell_counts(bins[unseen], cells) if len(unseen) else counts), total


def sums_of_nodes(lists: list[np.ndarray], bins: np.ndarray, n: np.ndarray | None, g: np.ndarray, cells: Cells) -> tuple[np.ndarray, np.ndarray]:
    """:func:`dense_sums` of nodes, of which each has a list of its rows."""
    if len(lists) <= NODES_APART:
        return tuple(np.concatenate(x) for x in zip(*(dense_sums(None, bins, rows, n, g, cells, 1) for rows in lists)))
    slots = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return dense_sums(slots, bins, np.concatenate(lists), n, g, cells, len(lists))


def occupied(count: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every occupied cell: key (slot * cells + cell, ascending), n, g."""
    used = np.flatnonzero(count)
    return used, count[used], total[used]


def cell_sums(slots: np.ndarray, bins: np.ndarray, n: np.ndarray, g: np.ndarray, cells: Cells, slot_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count and sum of every occupied cell of every slot, which are dense node numbers."""
    return occupied(*dense_sums(slots, bins, np.arange(len(bins)), n, g, cells, slot_count))


def best_splits(keys: np.ndarray, n: np.ndarray, g: np.ndarray, paths: np.ndarray, tree: int, cells: Cells, rules: Rules) -> dict[str, np.ndarray]:
    """The best split of each slot: slot, input, bin, gain (-inf: none), n and g of the left part, and of the node.

    Of equal gains the first input's lowest bin.
    """
    slot, cell = keys // cells.total, keys % cells.total
    column = cells.inputs[cell]
    opens = np.concatenate([[True], (slot[1:] != slot[:-1]) | (column[1:] != column[:-1])])
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(keys)) - 1
    run = np.cumsum(opens) - 1
    sums_n, sums_g = np.cumsum(n), np.cumsum(g)
    n_left = sums_n - (sums_n[first] - n[first])[run]
    g_left = sums_g - (sums_g[first] - g[first])[run]
    n_all, g_all = n_left[last][run], g_left[last][run]
    n_right, g_right = n_all - n_left, g_all - g_left
    allowed = (n_left >= rules.least_rows) & (n_right >= max(rules.least_rows, 1e-9))
    if rules.random_thresholds:
        allowed &= _drawn(slot, cell, column, first, last, paths, tree, cells, rules)
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = g_left * g_left / (n_left + rules.penalty) + g_right * g_right / (n_right + rules.penalty)
        gain = parts - g_all * g_all / (n_all + rules.penalty)
    gain = np.where(allowed & (gain > LEAST_GAIN * parts), gain, -np.inf)
    slots, begins = np.unique(slot, return_index=True)
    best = np.maximum.reduceat(gain, begins)
    at = np.flatnonzero(gain == best[np.searchsorted(slots, slot)])
    chosen = at[np.unique(slot[at], return_index=True)[1]]
    out = {"slot": slots, "input": column[chosen], "bin": cell[chosen] - cells.starts[column[chosen]], "gain": best}
    return out | {"n_left": n_left[chosen], "g_left": g_left[chosen], "n": n_all[chosen], "g": g_all[chosen]}


def _drawn(slot, cell, column, first, last, paths, tree, cells: Cells, rules: Rules) -> np.ndarray:
    """Marks in each run of cells (one node and input) the entry that the drawn threshold cuts after."""
    marked = np.zeros(len(slot), bool)
    runs = np.flatnonzero(last > first)
    draw = uniform(paths[slot[first[runs]]], rules.seed, tree)
    draw = (draw + uniform(paths[slot[first[runs]]] * 1024 + column[first[runs]], rules.seed, tree)) % 1.0
    for k, edges in enumerate(cells.edges):
        here = column[first[runs]] == k
        if not here.any():
            continue
        own = runs[here]
        low, high = cell[first[own]] - cells.starts[k], cell[last[own]] - cells.starts[k]
        # Between the smallest and the largest value, as far as bins tell them.
        threshold = edges[low] + draw[here] * (edges[high - 1] - edges[low])
        cut = np.clip(np.searchsorted(edges, threshold, side="left"), low, high - 1)
        total = cells.total
        entry = np.searchsorted(slot * total + cell, slot[first[own]] * total + cells.starts[k] + cut, side="right") - 1
        marked[entry] = True
    return marked


def grow(bins: np.ndarray, n: np.ndarray, g: np.ndarray, path: int, tree: int, cells: Cells, rules: Rules) -> Tree:
    """The tree below one node from all its rows."""
    return grow_on(bins, np.ascontiguousarray(bins.T), np.arange(len(bins)), None if (n == 1).all() else n, g, path, tree, cells, rules)


def grow_on(
    bins: np.ndarray, columns: np.ndarray, seen: np.ndarray, n: np.ndarray | None, g: np.ndarray, path: int, tree: int, cells: Cells, rules: Rules,
    sums: tuple[np.ndarray, np.ndarray] | None = None,
) -> Tree:
    """The tree below one node from its rows ``seen``, which may be some of those given.

    ``columns``: the bins, a row for each input. ``n``: None if every row counts once. ``sums``: of the node's cells, if known.
    """
    out = Tree(path, float(len(seen) if n is None else n[seen].sum()), float(g[seen].sum()))
    lists = {0: seen}
    kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    while nodes := nodes_to_search(out, rules):
        paths, parts = np.array([out.path[x] for x in nodes]), []
        if len(nodes) * cells.total <= CELLS_KEPT:
            found = {0: sums} if sums and 0 in nodes else _sums_with_siblings(out, nodes, lists, bins, n, g, cells, kept)
            # Best-first growth comes back to nodes found long before.
            kept = kept | found if rules.max_leaves else found
            parts.append(best_splits(*occupied(*(np.concatenate(x) for x in zip(*(found[node] for node in nodes)))), paths, tree, cells, rules))
        else:
            block = max(1, CELLS_AT_A_TIME // cells.total)
            for i in range(0, len(nodes), block):
                some = sums_of_nodes([lists[x] for x in nodes[i : i + block]], bins, n, g, cells)
                part = best_splits(*occupied(*some), paths[i : i + block], tree, cells, rules)
                parts.append(part | {"slot": part["slot"] + i})
        apply(out, nodes, {c: np.concatenate([x[c] for x in parts]) for c in parts[0]})
        for node in nodes:
            _deal(out, node, lists, columns)
    return out


def _deal(tree: Tree, node: int, lists: dict[int, np.ndarray], columns: np.ndarray) -> None:
    """The list of a node's rows, dealt to the nodes below it if there are any."""
    rows = lists.pop(node)
    if tree.input[node] >= 0:
        right = columns[tree.input[node]][rows] > tree.bin[node]
        lists[tree.left[node]], lists[tree.left[node] + 1] = rows[~right], rows[right]


def _sums_with_siblings(tree, nodes, lists, bins, n, g, cells, kept) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sums of all nodes by node. Of two siblings the smaller one is counted; the larger one is what is left of the node above."""
    above = {tree.left[i] + k: i for i in kept if tree.left[i] >= 0 for k in (0, 1)}
    sibling = lambda node: node + 1 if tree.left[above[node]] == node else node - 1
    wanted = set(nodes)
    derived = {x for x in nodes if x in above and sibling(x) in wanted and (tree.n[x], x) > (tree.n[sibling(x)], sibling(x))}
    counted = [x for x in nodes if x not in derived]
    count, total = sums_of_nodes([lists[x] for x in counted], bins, n, g, cells)
    parts = {x: (count[k * cells.total : (k + 1) * cells.total], total[k * cells.total : (k + 1) * cells.total]) for k, x in enumerate(counted)}
    for x in derived:
        whole, part = kept[above[x]], parts[sibling(x)]
        parts[x] = whole[0] - part[0], whole[1] - part[1]
    return parts


def apply(tree: Tree, nodes: list[int], found: dict[str, np.ndarray]) -> None:
    """Put the splits found for the nodes' slots into the tree; all of them count as searched."""
    for node in nodes:
        tree.searched[node] = True
    for slot, column, bin_number, gain, n_left, g_left, n, g in zip(*(x.tolist() for x in found.values())):
        node = nodes[slot]
        tree.n[node], tree.g[node] = n, g
        if gain > -np.inf:
            tree.split(node, column, bin_number, gain, (n_left, g_left))


def leaves_of(tree: dict[str, np.ndarray], bins: np.ndarray, limits: np.ndarray | None = None) -> np.ndarray:
    """The node where each row ends. ``limits``: real thresholds, for rows of values in place of bins."""
    at = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins))
    limits = tree["bin"] if limits is None else limits
    while len(rows):
        here = at[rows]
        inner = tree["input"][here] >= 0
        rows, here = rows[inner], here[inner]
        at[rows] = tree["left"][here] + (bins[rows, tree["input"][here]] > limits[here])
    return at


def leaves_by_column(tree: Tree, columns: np.ndarray) -> np.ndarray:
    """:func:`leaves_of` of many rows and a tree of few nodes. ``columns``: the bins, a row for each input."""
    lists, at = {0: np.arange(columns.shape[1])}, np.zeros(columns.shape[1], np.int64)
    for node in range(len(tree.path)):
        if tree.input[node] < 0:
            at[lists.pop(node)] = node
        else:
            _deal(tree, node, lists, columns)
    return at


def edges_of(values: Iterable[float], bins: int) -> np.ndarray:
    """Upper edges of at most ``bins`` bins: between all distinct values if they are few, else between evenly spaced ones."""
    ordered = np.sort(np.asarray(values, np.float64))
    distinct = np.unique(ordered)
    if len(distinct) > bins:
        picked, times = np.unique(ordered[(np.arange(1, bins) * len(ordered)) // bins], return_counts=True)
        at = np.searchsorted(distinct, picked, side="left")
        # Below each picked value; a value picked more than once is cut off from above, too.
        below = np.unique(np.concatenate([at - 1, at[times > 1]]))
        below = below[(below >= 0) & (below < len(distinct) - 1)]
    else:
        below = np.arange(len(distinct) - 1)
    low, high = distinct[below], distinct[below + 1]
    middle = low + (high - low) / 2
    return np.where(middle < high, middle, low)
