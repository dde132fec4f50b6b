"""Remove strings of a fixed length that also begin earlier in the corpus.

Suffixes are taken where they can matter. Every window of 100 bytes has an anchor, the 32 bytes inside it that are
least by a hash of their beginning; equal windows have equal anchors at equal places, and neighbouring
windows mostly share theirs, so a corpus has some thirty times fewer anchors than bytes. A run is the windows that
share an anchor, and its context the bytes that they cover.

1. Each group of texts sends the earliest of its equal contexts to the shard of the anchor, as hashes.
2. The shard answers: no such anchor elsewhere, nothing to do; an equal context earlier, then the run is covered;
   or other contexts around the same anchor.
3. Of the last kind the context's bytes go to a shard, which sorts all their windows by deep-shallow suffix
   sorting and says which of them begin earlier.
4. Each group marks what is covered in its texts.

The texts are shuffled once and the exchange is read three times.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.suffix_sort import equal_windows
from shelfcast.llm.text import dealt_by, mixed, pieces, spread, text_groups, utf8

LENGTH = 100
ANCHOR = 32
#: Bytes of text whose anchors are found at a time; a dozen numbers are held for each.
PIECE = 1 << 20
#: A byte's value in the hash of a context, and the base of its powers with its inverse modulo 2 to the 64th.
BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
FIRST = -(1 << 63)

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    if len(_powers.get(int(base), ())) < n:
        out = np.full(max(n, 1 << 20), base, np.uint64)
        out[0] = 1
        _powers[int(base)] = np.cumprod(out)
    return _powers[int(base)][:n]


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring values, by doubling."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :])


class Runs:
    """The runs of all texts of a group. Per run: text, first window, number of windows, hash of anchor and of context, place of the anchor."""

    def __init__(self, texts: pa.ChunkedArray, length: int, anchor: int):
        self.data, self.offsets = utf8(texts)
        parts = [_runs(self.data[self.offsets[i] : self.offsets[j]], self.offsets[i : j + 1] - self.offsets[i], length, anchor) for i, j in pieces(self.offsets, PIECE)]
        self.begin = np.concatenate([p[0] + self.offsets[i] for p, (i, _) in zip(parts, pieces(self.offsets, PIECE))] or [np.zeros(0, np.int64)])
        self.count, self.gram, self.context, self.lead = (np.concatenate([p[k] for p in parts] or [np.zeros(0, kind)]) for k, kind in ((1, np.int64), (2, np.uint64), (3, np.uint64), (4, np.int64)))
        self.text = np.searchsorted(self.offsets, self.begin, side="right") - 1
        self.start = self.begin - self.offsets[self.text]


def _runs(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int):
    empty = np.zeros(0, np.int64)
    sizes = np.maximum(0, np.diff(offsets) - length + 1)
    if not sizes.any():
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), empty
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (n, 8), (1, 1)).copy().view("<u8").ravel()
    grams = n - anchor + 1
    ranked = ((eight[:grams] * BASE) & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)
    at = (least_in_windows(ranked, length - anchor + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    windows = spread(offsets[:-1], sizes)
    at = at[windows]
    first = np.ones(len(windows), bool)
    first[1:] = (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)
    edges = np.flatnonzero(first)
    begin, count, at = windows[edges], np.diff(np.append(edges, len(windows))), at[edges]
    gram = np.zeros(len(at), np.uint64)
    for k in range(0, anchor, 8):
        gram = mixed(gram * BASE + eight[at + k])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * powers(BASE, n))])
    lead = at - begin
    context = mixed((sums[begin + count - 1 + length] - sums[begin]) * powers(INVERSE, n)[begin] + lead.astype(np.uint64) * np.uint64(257) + count.astype(np.uint64))
    return begin, count, gram, context, lead


class Entries:
    """The distinct contexts of a group, by hash of anchor and of context, with the earliest run of each."""

    def __init__(self, table: pa.Table, length: int, anchor: int):
        self.runs = Runs(table.column("text"), length, anchor)
        ids = table.column("doc_id").fill_null(FIRST).to_numpy()
        marks = table.column("mark").to_numpy()
        order = np.lexsort((marks, ids))
        new = np.ones(len(order), bool)
        new[1:] = (ids[order][1:] != ids[order][:-1]) | (marks[order][1:] != marks[order][:-1])
        rank = np.zeros(len(order), np.int64)
        rank[order] = np.cumsum(new) - 1
        self.ids, self.marks = ids[order][new], marks[order][new]
        runs = self.runs
        # Equal rows are one text: they have the same rank and so the same places.
        self.place = (rank[runs.text] << 32) + runs.start
        sorted_ = np.lexsort((self.place, runs.context, runs.gram))
        gram, context = runs.gram[sorted_], runs.context[sorted_]
        fresh = np.ones(len(sorted_), bool)
        fresh[1:] = (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])
        self.entry = np.zeros(len(sorted_), np.int64)
        self.entry[sorted_] = np.cumsum(fresh) - 1
        self.earliest = sorted_[fresh]
        self.later = self.place != self.place[self.earliest][self.entry]

    def by_shard(self, shards: int) -> list[np.ndarray]:
        shard = (self.runs.gram[self.earliest] % np.uint64(shards)).astype(np.int64)
        return np.split(np.argsort(shard, kind="stable"), np.cumsum(np.bincount(shard, minlength=shards))[:-1])


ALONE, COVERED, DISPUTED = 0, 1, 2


def find_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, digests: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, spans (begin, end) and kept, the remaining bytes.

    A byte of a text's UTF-8 is removed if a string of `length` bytes that covers it also starts earlier: in a text with a
    smaller doc_id, or further up in the same one, judged on the input. Strings never cross texts. A null text
    is the empty text, which like any text shorter than `length` stays whole. A null doc_id counts as the smallest
    number. Of rows that share a doc_id, the one with the smaller hash of its text is earlier; equal rows are one text
    and get equal results. An empty table gives no rows; other columns are left out. With digests,
    kept_sha256 (lowercase hex) stands in place of spans and kept. Equal contexts are known by two 64-bit hashes.
    """
    groups = text_groups(docs)
    dealt = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.expr("xxhash64(coalesce(text, ''))").alias("mark"), F.expr(f"cast(pmod(xxhash64(doc_id, text), {groups}) AS int)").alias("grp")
    )
    dealt = dealt_by(dealt, groups, "grp")

    def ask(table: pa.Table) -> pa.Table:
        entries = Entries(table, length, anchor)
        runs, grp, rows = entries.runs, table.column("grp")[0].as_py(), []
        for shard, own in enumerate(entries.by_shard(groups)):
            run = entries.earliest[own]
            text, used = np.unique(entries.place[run] >> 32, return_inverse=True)
            rows.append((shard, grp, len(own), runs.gram[run].tobytes(), runs.context[run].tobytes(), used.astype("<i4").tobytes(), runs.start[run].astype("<u4").tobytes(), entries.ids[text].tobytes(), entries.marks[text].tobytes()))
        return _table(rows, ASKED)

    def answer(table: pa.Table) -> pa.Table:
        """What is known of each entry, in the order in which each group sent them."""
        n = table.column("n").to_numpy()
        gram, context, used, start, ids, marks = (_joined(table, name, kind) for name, kind in (("gram", "<u8"), ("context", "<u8"), ("used", "<i4"), ("start", "<u4"), ("ids", "<i8"), ("marks", "<i8")))
        texts = np.array([len(x) // 8 for x in table.column("ids").to_pylist()])
        used = used + np.repeat(np.cumsum(texts) - texts, n)
        verdict = np.zeros(len(gram), np.uint8)
        # Anchors that only one entry has need no order.
        _, inverse, times = np.unique(gram, return_inverse=True, return_counts=True)
        some = np.flatnonzero(times[inverse] > 1)
        if len(some):
            order = some[np.lexsort((start[some], marks[used[some]], ids[used[some]], context[some], gram[some]))]
            g, c = gram[order], context[order]
            new_gram = np.concatenate([[True], g[1:] != g[:-1]])
            new = new_gram | np.concatenate([[True], c[1:] != c[:-1]])
            contexts = np.bincount(np.cumsum(new_gram) - 1, weights=new)
            verdict[order] = np.where(new, np.where(contexts[np.cumsum(new_gram) - 1] > 1, DISPUTED, ALONE), COVERED)
        cuts = np.cumsum(n)[:-1]
        return _table([(g, 0, s, part.tobytes(), b"") for g, s, part in zip(table.column("grp").to_pylist(), table.column("shard").to_pylist(), np.split(verdict, cuts))], TOLD)

    def verdicts(entries: Entries, answers: pa.Table) -> np.ndarray:
        out = np.zeros(len(entries.earliest), np.uint8)
        parts = entries.by_shard(groups)
        for kind, shard, told in zip(answers.column("kind").to_pylist(), answers.column("shard").to_pylist(), answers.column("told")):
            if kind == 0:
                out[parts[shard]] = np.frombuffer(told.as_py(), np.uint8)
        return out

    def dispute(texts: pa.Table, answers: pa.Table) -> pa.Table:
        """The contexts about which other texts disagree, with their bytes."""
        entries = Entries(texts, length, anchor)
        runs, grp, rows = entries.runs, texts.column("grp")[0].as_py(), []
        verdict = verdicts(entries, answers)
        for shard, own in enumerate(entries.by_shard(groups)):
            own = own[verdict[own] == DISPUTED]
            if not len(own):
                continue
            run = entries.earliest[own]
            text, used = np.unique(entries.place[run] >> 32, return_inverse=True)
            size = runs.count[run] + length - 1
            rows.append(
                (
                    shard, grp, len(own), own.astype("<i4").tobytes(), runs.gram[run].tobytes(), runs.lead[run].astype(np.uint8).tobytes(), runs.count[run].astype(np.uint8).tobytes(), used.astype("<i4").tobytes(),
                    runs.start[run].astype("<u4").tobytes(), entries.ids[text].tobytes(), entries.marks[text].tobytes(), runs.data[spread(runs.begin[run], size)].tobytes(),
                )
            )
        return _table(rows, DISPUTES)

    def settle(table: pa.Table) -> pa.Table:
        """For each disputed context which of its windows begin earlier elsewhere."""
        n = table.column("n").to_numpy()
        own, gram, lead, count, used, start, ids, marks, data = (
            _joined(table, name, kind)
            for name, kind in (("own", "<i4"), ("gram", "<u8"), ("lead", "u1"), ("count", "u1"), ("used", "<i4"), ("start", "<u4"), ("ids", "<i8"), ("marks", "<i8"), ("data", "u1"))
        )
        texts = np.array([len(x) // 8 for x in table.column("ids").to_pylist()])
        used = used + np.repeat(np.cumsum(texts) - texts, n)
        lead, count = lead.astype(np.int64), count.astype(np.int64)
        size = count + length - 1
        inside = spread(np.zeros(len(count), np.int64), count)
        context = np.repeat(np.arange(len(count)), count)
        places = (np.cumsum(size) - size)[context] + inside
        # A bucket: windows with the same anchor at the same place.
        _, anchors = np.unique(gram, return_inverse=True)
        buckets = anchors[context] * 256 + lead[context] - inside
        order, run = equal_windows(data, places, buckets, length)
        by_place = np.lexsort((start, marks[used], ids[used]))
        early = np.empty(len(by_place), np.int64)
        early[by_place] = np.arange(len(by_place))
        # Equal windows inside one context would have two anchors at one place, so the order of contexts decides.
        best = np.full(int(run[-1]) + 1 if len(run) else 0, len(by_place), np.int64)
        np.minimum.at(best, run, early[context[order]])
        covered = np.zeros(len(places), np.uint8)
        covered[order] = early[context[order]] != best[run]
        ends = np.cumsum(np.concatenate([[0], count]))
        edges = np.concatenate([[0], np.cumsum(n)])
        return _table([(g, 1, 0, covered[ends[a] : ends[b]].tobytes(), own[a:b].astype("<i4").tobytes()) for g, a, b in zip(table.column("grp").to_pylist(), edges[:-1].tolist(), edges[1:].tolist())], TOLD)

    def mark(texts: pa.Table, answers: pa.Table) -> pa.Table:
        entries = Entries(texts, length, anchor)
        runs = entries.runs
        verdict = verdicts(entries, answers)
        change = np.zeros(len(runs.data) + 1, np.int32)
        whole = entries.later | (verdict[entries.entry] == COVERED)
        np.add.at(change, runs.begin[whole], 1)
        np.add.at(change, runs.begin[whole] + runs.count[whole] + length - 1, -1)
        by_entry = np.argsort(entries.entry, kind="stable")
        first = np.searchsorted(entries.entry[by_entry], np.arange(len(entries.earliest) + 1))
        for kind, told, own in zip(answers.column("kind").to_pylist(), answers.column("told"), answers.column("own")):
            if kind == 1:
                own = np.frombuffer(own.as_py(), "<i4").astype(np.int64)
                flags = np.frombuffer(told.as_py(), np.uint8).astype(bool)
                count = runs.count[entries.earliest[own]]
                offset = np.cumsum(count) - count
                # All runs of an entry that aren't later ones are the same place of equal rows.
                times = first[own + 1] - first[own]
                run = by_entry[spread(first[own], times)]
                entry = np.repeat(np.arange(len(own)), times)
                keep = ~entries.later[run]
                run, entry = run[keep], entry[keep]
                windows = spread(runs.begin[run], count[entry])[flags[spread(offset[entry], count[entry])]]
                np.add.at(change, windows, 1)
                np.add.at(change, windows + length, -1)
        # In place and in 32 bits: these are the largest arrays of a group.
        gone = np.cumsum(change, out=change)[:-1] > 0
        del change
        edge = np.flatnonzero(gone[1:] != gone[:-1]) + 1
        lengths = np.diff(runs.offsets)
        filled = runs.offsets[:-1][lengths > 0]
        # Bounds of spans: where the mark changes, and the ends of texts.
        cuts = np.union1d(edge, np.append(filled, len(gone)))
        marked = gone[cuts[:-1]]
        begins, ends = cuts[:-1][marked], cuts[1:][marked]
        spans = np.searchsorted(begins, runs.offsets)
        covered = np.concatenate([[0], np.cumsum(ends - begins)])
        removed = covered[spans]
        raw, left = runs.data[~gone].tobytes(), (runs.offsets - removed).tolist()
        kept = [raw[a:b] for a, b in zip(left, left[1:])]
        out = {"doc_id": texts.column("doc_id"), "n_bytes": np.diff(runs.offsets), "n_removed": np.diff(removed), "n_spans": np.diff(spans)}
        if digests:
            return pa.table(out | {"kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept]})
        bounds = np.column_stack([begins, ends])
        found = [[{"begin": int(a - o), "end": int(b - o)} for a, b in bounds[i:j]] for o, i, j in zip(runs.offsets.tolist(), spans.tolist(), spans[1:].tolist())]
        return pa.table(out | {"spans": pa.array(found, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary())})

    told = "grp int, kind int, shard int, told binary, own binary"
    asked = dealt.groupBy("grp").applyInArrow(ask, "shard int, grp int, n int, gram binary, context binary, used binary, start binary, ids binary, marks binary")
    answered = dealt_by(asked, groups, "shard").groupBy("shard").applyInArrow(answer, told)
    disputed = dealt.groupBy("grp").cogroup(dealt_by(answered, groups, "grp").groupBy("grp")).applyInArrow(
        dispute, "shard int, grp int, n int, own binary, gram binary, lead binary, count binary, used binary, start binary, ids binary, marks binary, data binary"
    )
    settled = dealt_by(disputed, groups, "shard").groupBy("shard").applyInArrow(settle, told)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digests else "spans array<struct<begin: long, end: long>>, kept binary")
    # Dealt after the union, which would not keep the partitions of its parts.
    answers = dealt_by(answered.unionByName(settled), groups, "grp")
    return dealt.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(mark, schema)


ASKED = pa.schema([("shard", pa.int32()), ("grp", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("gram", "context", "used", "start", "ids", "marks"))])
TOLD = pa.schema([("grp", pa.int32()), ("kind", pa.int32()), ("shard", pa.int32()), ("told", pa.binary()), ("own", pa.binary())])
DISPUTES = pa.schema([("shard", pa.int32()), ("grp", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("own", "gram", "lead", "count", "used", "start", "ids", "marks", "data"))])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([row[k] for row in rows], field.type) for k, field in enumerate(schema)], schema=schema)


def _joined(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
