"""Language-model scores by a weighted backoff automaton.

States are contexts seen in training, arcs the words that followed them. An arc weighs the log-probability of its word;
where a state has no arc for a word, its failure arc leads to the next shorter context and weighs the share left to
words not seen there. A text is scored in one pass from left to right that carries the state.

The automaton of a large corpus fits no single machine, and need not: a group of texts walks only over its own
n-grams. Documents are dealt into groups. Each group counts its n-grams and sends them, as hashes, to
shards that add up the counts of all groups; each shard answers every group with the totals of what it
sent. A group then has all weights of its part of the automaton. Text, counts and answers are shuffled once each.

Probabilities: the share left to unseen words after contexts of one length is the Good-Turing estimate, the
share of n-grams that occurred once. p(w | context) is then (1 - share) c(context w) / c(context) + share p(w |
shorter context); with no context, (c + 0.5) / (N + 0.5 (V + 1)), where all unknown words are one more word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.text import dealt_by, dictionary, lowered, mixed, pieces, remainder, text_groups, utf8, words

# Marks of the two ends of a text; no word is empty, and none has a hash of its own that is chosen.
START, END = np.uint64(xxhash.xxh64_intdigest(b"", 1)), np.uint64(xxhash.xxh64_intdigest(b"", 2))
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Tokens that a lane walks; a longer text is walked in several lanes, each from its own state.
LANE = 2048
#: The share left to unseen words stays inside these.
SHARES = (1e-6, 1 - 1e-6)


def tokens(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of start, lower-cased words and end of every text, and the bounds of the texts."""
    data, offsets = utf8(texts)
    hashes, counts = [], []
    for i, j in pieces(offsets):
        items, before = words(lowered(data[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i])
        distinct, places = dictionary(items)
        hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))[places])
        counts.append(np.diff(before))
    count = np.concatenate([*counts, np.zeros(0, np.int64)])
    bounds = np.concatenate([[0], np.cumsum(count + 2)])
    out = np.empty(bounds[-1], np.uint64)
    inner = np.ones(len(out), bool)
    inner[bounds[:-1]] = inner[bounds[1:] - 1] = False
    out[inner] = np.concatenate([*hashes, np.zeros(0, np.uint64)])
    out[bounds[:-1]], out[bounds[1:] - 1] = START, END
    return out, bounds


class Grams:
    """The n-grams of a group of texts: per order the distinct keys, and for each token the n-gram that ends there.

    Order 0 holds the start marks alone, which are contexts but no tokens.
    """

    def __init__(self, texts: pa.ChunkedArray, order: int):
        self.tokens, self.bounds = tokens(texts)
        n = len(self.tokens)
        # 32 bits are enough for places in a group, and halve what a group holds.
        self.place = (np.arange(n) - np.repeat(self.bounds[:-1], np.diff(self.bounds))).astype(np.int32)
        keys, self.distinct, self.at = self.tokens, [], []
        for k in range(order + 1):
            if k > 1:
                keys = np.concatenate([[np.uint64(0)], mixed(keys[:-1] * STEP + self.tokens[1:])])
            valid = self.valid(k)
            distinct, inverse = np.unique(keys[valid], return_inverse=True)
            at = np.full(n, -1, np.int32)
            at[valid] = inverse
            self.distinct.append(distinct)
            self.at.append(at)

    def valid(self, k: int) -> np.ndarray:
        """Whether an n-gram of order k ends at each token."""
        return self.place == 0 if k == 0 else self.place >= max(1, k - 1)

    def counts(self, trained: np.ndarray) -> list[np.ndarray]:
        """How often each n-gram occurs in the texts that are marked."""
        within = np.repeat(trained, np.diff(self.bounds))
        return [np.bincount(at[(at >= 0) & within], minlength=len(d)) for at, d in zip(self.at, self.distinct)]


def score_texts(docs: DataFrame, order: int = 2, folds: int = 5, held_out: int = 1) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from texts whose crc32 of doc_id as text, mod `folds`, isn't `held_out`. Words are runs without ASCII
    white space, A-Z lower-cased; the end of a text is a token. score: log10 of the text's probability. base_score: that
    of its words taken alone. A null or empty text is the end token only; a null doc_id counts as the empty text in
    the fold; repeated rows are counted and scored one by one; an empty table gives no rows, and without training
    texts every token has probability one. N-grams are told apart by 64-bit hashes. Other columns are left out.
    """
    groups = text_groups(docs)
    dealt = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", remainder(F.col("doc_id"), folds).cast("int").alias("fold"), F.expr(f"cast(pmod(xxhash64(doc_id, text), {groups}) AS int)").alias("grp")
    )
    dealt = dealt_by(dealt, groups, "grp")

    def ask(table: pa.Table) -> pa.Table:
        grams = Grams(table.column("text"), order)
        counts = grams.counts(table.column("fold").to_numpy() != held_out)
        rows = {"shard": [], "grp": [], "sizes": [], "keys": [], "counts": []}
        parts = [_by_shard(keys, groups) for keys in grams.distinct]
        for shard in range(groups):
            own = [(keys[chosen[shard]], n[chosen[shard]]) for keys, n, chosen in zip(grams.distinct, counts, parts)]
            rows["shard"].append(shard)
            rows["grp"].append(table.column("grp")[0].as_py())
            rows["sizes"].append([len(keys) for keys, _ in own])
            rows["keys"].append(b"".join(keys.astype("<u8").tobytes() for keys, _ in own))
            rows["counts"].append(b"".join(n.astype("<u4").tobytes() for _, n in own))
        return pa.table(rows, schema=pa.schema([("shard", pa.int32()), ("grp", pa.int32()), ("sizes", pa.list_(pa.int64())), ("keys", pa.binary()), ("counts", pa.binary())]))

    def answer(table: pa.Table) -> pa.Table:
        """Totals over all groups, in the order in which each group asked, and the shard's share of the corpus counts."""
        sizes = np.array(table.column("sizes").to_pylist())
        keys = [np.frombuffer(x.as_py(), "<u8") for x in table.column("keys")]
        counts = [np.frombuffer(x.as_py(), "<u4") for x in table.column("counts")]
        ends = np.cumsum(sizes, axis=1)
        totals, facts = [[] for _ in keys], []
        for k in range(order + 1):
            spans = [slice(e[k] - s[k], e[k]) for e, s in zip(ends, sizes)]
            _, inverse = np.unique(np.concatenate([x[s] for x, s in zip(keys, spans)]), return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate([x[s] for x, s in zip(counts, spans)])).astype(np.int64)
            facts += [int(n.sum()), int((n > 0).sum()), int((n == 1).sum())]
            found = n[inverse]
            cuts = np.cumsum(sizes[:, k])[:-1]
            for held, part in zip(totals, np.split(found, cuts)):
                held.append(part.astype("<i8").tobytes())
        rows = {"grp": table.column("grp"), "shard": table.column("shard"), "totals": [b"".join(x) for x in totals], "facts": [facts] * len(keys)}
        return pa.table(rows, schema=pa.schema([("grp", pa.int32()), ("shard", pa.int32()), ("totals", pa.binary()), ("facts", pa.list_(pa.int64()))]))

    def walk(texts: pa.Table, answers: pa.Table) -> pa.Table:
        grams = Grams(texts.column("text"), order)
        totals = [np.zeros(len(keys), np.int64) for keys in grams.distinct]
        parts = [_by_shard(keys, groups) for keys in grams.distinct]
        facts = np.zeros(3 * (order + 1), np.int64)
        for shard, packed, own in zip(answers.column("shard").to_pylist(), answers.column("totals"), answers.column("facts").to_pylist()):
            values, at = np.frombuffer(packed.as_py(), "<i8"), 0
            for total, chosen in zip(totals, parts):
                total[chosen[shard]] = values[at : at + len(chosen[shard])]
                at += len(chosen[shard])
            facts += np.array(own)
        base, known, score = Automaton(grams, totals, facts.reshape(-1, 3)).scores()
        return pa.table(
            {
                "doc_id": texts.column("doc_id"),
                "held_out": pa.array(texts.column("fold").to_numpy() == held_out),
                "n_tokens": pa.array(np.diff(grams.bounds) - 1, pa.int64()),
                "n_known": pa.array(known, pa.int64()),
                "train_tokens": pa.array(np.full(len(known), facts[3]), pa.int64()),
                "base_score": pa.array(base),
                "score": pa.array(score),
            }
        )

    asked = dealt.groupBy("grp").applyInArrow(ask, "shard int, grp int, sizes array<long>, keys binary, counts binary")
    answered = dealt_by(asked, groups, "shard").groupBy("shard").applyInArrow(answer, "grp int, shard int, totals binary, facts array<long>")
    return dealt.groupBy("grp").cogroup(dealt_by(answered, groups, "grp").groupBy("grp")).applyInArrow(
        walk, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def _by_shard(keys: np.ndarray, shards: int) -> list[np.ndarray]:
    """The places of the keys of each shard, ascending."""
    shard = (keys % np.uint64(shards)).astype(np.int64)
    return np.split(np.argsort(shard, kind="stable"), np.cumsum(np.bincount(shard, minlength=shards))[:-1])


class Automaton:
    """The part of the automaton that a group of texts walks over.

    totals: the count of each distinct n-gram. facts: for each order, tokens, distinct n-grams, n-grams seen once.
    """

    def __init__(self, grams: Grams, totals: list[np.ndarray], facts: np.ndarray):
        self.grams, self.order = grams, len(totals) - 1
        n, v = facts[1, 0], facts[1, 1]
        room = n + 0.5 * (v + 1)
        self.arcs = [np.zeros(0), np.log10((totals[1] + 0.5) / room)]
        self.seen = [total > 0 for total in totals]
        self.fails = [0.0, 0.0]
        tokens = np.flatnonzero(grams.place > 0)
        chance = np.zeros(len(grams.tokens))
        chance[tokens] = 10 ** self.arcs[1][grams.at[1][tokens]]
        for k in range(2, self.order + 1):
            share = float(np.clip(facts[k, 2] / max(1, facts[k, 0]), *SHARES))
            at = np.flatnonzero(grams.valid(k))
            before = at - 1
            # The start mark is a context of its own kind.
            opening = grams.place[before] == 0
            context = np.zeros(len(at), np.int64)
            context[opening] = totals[0][grams.at[0][before[opening]]]
            context[~opening] = totals[k - 1][grams.at[k - 1][before[~opening]]]
            held = context > 0
            at, context = at[held], context[held]
            chance[at] = share * chance[at] + (1 - share) * totals[k][grams.at[k][at]] / context
            weights = np.zeros(len(totals[k]))
            weights[grams.at[k][at]] = np.log10(chance[at])
            self.arcs.append(weights)
            self.fails.append(float(np.log10(share)))

    def state(self, at: np.ndarray) -> np.ndarray:
        """The number of tokens in the longest context that ends at these tokens."""
        out = np.zeros(len(at), np.int64)
        opening = self.grams.place[at] == 0
        if self.order > 1:
            out[opening] = self.seen[0][self.grams.at[0][at[opening]]] if len(self.seen[0]) else 0
        for k in range(1, self.order):
            place = self.grams.at[k][at]
            out[(place >= 0) & self.seen[k][np.maximum(place, 0)] & ~opening] = k
        return out

    def scores(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the base score, the known tokens and the score."""
        grams = self.grams
        n = len(grams.bounds) - 1
        sizes = np.diff(grams.bounds) - 1
        tokens = np.flatnonzero(grams.place > 0)
        owner = np.repeat(np.arange(n), sizes)
        single = grams.at[1][tokens]
        base = np.bincount(owner, weights=self.arcs[1][single], minlength=n)
        known = np.bincount(owner, weights=self.seen[1][single], minlength=n).astype(np.int64)
        # Lanes of at most LANE tokens, longest first, so that those still walking are the first ones.
        per = -(-sizes // LANE)
        text = np.repeat(np.arange(n), per)
        inner = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        first = grams.bounds[text] + 1 + inner * LANE
        length = np.minimum(LANE, sizes[text] - inner * LANE)
        order = np.argsort(-length, kind="stable")
        text, first, length = text[order], first[order], length[order]
        walking = np.searchsorted(-length, -np.arange(LANE), side="left")
        total = np.zeros(len(text))
        state = self.state(first - 1)
        for t in range(int(length.max(initial=0))):
            m = walking[t]
            at, now = first[:m] + t, state[:m]
            weight, open_ = np.zeros(m), np.ones(m, bool)
            for k in range(self.order, 1, -1):
                here = np.flatnonzero(open_ & (now == k - 1))
                arc = grams.at[k][at[here]]
                has = self.seen[k][arc]
                weight[here[has]] += self.arcs[k][arc[has]]
                open_[here[has]] = False
                # The failure arc.
                weight[here[~has]] += self.fails[k]
                now = now.copy()
                now[here[~has]] = k - 2
            here = np.flatnonzero(open_)
            weight[here] += self.arcs[1][grams.at[1][at[here]]]
            total[:m] += weight
            state = self.state(at)
        return base, known, np.bincount(text, weights=total, minlength=n)
