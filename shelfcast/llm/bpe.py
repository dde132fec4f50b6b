"""Byte-level BPE: backtracking encoder and offset-table decoder.

Encoder: an Aho-Corasick automaton over the bytes of all tokens gives the longest token at every
place. Tokens are tried from the longest to its shorter prefixes; a token may follow another only
if no merge would have crossed the bound between them (the pair-compatibility table, filled as pairs
occur). A place from which no token can go on is never entered again, so the work is linear in the
text, and the one sequence whose pairs are all compatible is the one that the merges would give.

Decoder: all tokens' bytes in one block with an offset per id; a text is one gather over the block.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfcast.llm.piece_ids import Memory
from shelfcast.llm.pretokens import byte_signs, pretokens
from shelfcast.llm.text import distinct, held, rows_of, spread

#: Pairs of tokens whose compatibility a worker process remembers before it starts anew.
PAIRS = 1 << 18
#: Bytes of text encoded at a time: cutting them takes some dozen times their memory.
PIECE = 1 << 20


class Vocabulary:
    """Tokens and merges of a tokenizer file; the tables that encoding and decoding need."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        signs = byte_signs()
        tokens = {text: i for text, i in spec["model"]["vocab"].items()}
        self.special = {x["content"].encode(): x["id"] for x in spec["added_tokens"]}
        size = max([*tokens.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for text, i in tokens.items():
            self.bytes[i] = bytes(signs[c] for c in text)
        for text, i in self.special.items():
            self.bytes[i] = text
        self.size = [len(b) for b in self.bytes]
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = tokens[left], tokens[right]
            self.merged[a, b] = rank
            self.parts.setdefault(tokens[left + right], (a, b, rank))
        by_bytes = {self.bytes[i]: i for i in tokens.values()}
        self.automaton = ahocorasick.Automaton()
        self.shorter = [-1] * size
        for content, i in by_bytes.items():
            self.automaton.add_word(content.decode("latin-1"), i)
            for n in range(len(content) - 1, 0, -1):
                if (prefix := by_bytes.get(content[:n])) is not None:
                    self.shorter[i] = prefix
                    break
        self.automaton.make_automaton()
        self.offsets = np.concatenate([[0], np.cumsum(self.size)])
        self.block = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.compatible: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.memory = None

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens at one side of a token as its merges build it up, each with the rank of the merge that ends it."""
        if (out := self.edges[side].get(token)) is None:
            chain, until, x = [], float("inf"), token
            while True:
                chain.append((x, until))
                if x not in self.parts:
                    break
                until, x = self.parts[x][2], self.parts[x][side]
            out = self.edges[side][token] = chain[::-1]
        return out

    def fits(self, a: int, b: int) -> bool:
        """Whether no merge crosses the bound when b follows a."""
        pair = a << 32 | b
        if (known := self.compatible.get(pair)) is not None:
            return known
        if len(self.compatible) >= PAIRS:
            self.compatible.clear()
        left, right = self.edge(a, 1), self.edge(b, 0)
        i = j = 0
        answer = True
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            rank = self.merged.get((x, y))
            # Of equal ranks the leftmost merge comes first.
            if rank is not None and rank < x_ends and rank <= y_ends:
                answer = False
                break
            if i + 1 == len(left) and j + 1 == len(right):
                break
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1
        self.compatible[pair] = answer
        return answer

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece inside which merges happen."""
        text, fits = piece.decode("latin-1"), self.fits
        out = [token for _, token in self.automaton.iter_long(text)]
        for a, b in zip(out, out[1:]):
            if not fits(a, b):
                return self.backtrack(text)
        return out

    def backtrack(self, text: str) -> list[int]:
        n, size, shorter, fits = len(text), self.size, self.shorter, self.fits
        longest = [-1] * n
        reach = [0] * n
        for end, token in self.automaton.iter(text):
            start = end + 1 - size[token]
            if size[token] > reach[start]:
                longest[start], reach[start] = token, size[token]
        closed = bytearray(n + 1)
        out: list[int] = []
        place, token = 0, longest[0]
        while place < n:
            while token >= 0 and (closed[place + size[token]] or (out and not fits(out[-1], token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                place += size[token]
                token = longest[place] if place < n else -1
            else:
                closed[place] = 1
                last = out.pop()
                place -= size[last]
                token = shorter[last]
        return out

    def encode_distinct(self, items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all items end to end, and the number of ids of each."""
        lists = [[self.special[item]] if item in self.special else self.encode_piece(item) for item in items]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(counts.sum())), counts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids before each text."""
        special = next(iter(self.special), b"")
        items, before = pretokens(data, offsets, special)
        pieces, places = distinct(items)
        pool, counts = self.memory(pieces) if self.memory else self.encode_distinct(pieces.to_pylist())
        starts = np.cumsum(counts) - counts
        lengths = counts[places]
        ids = pool[spread(starts[places], lengths)]
        return ids, np.concatenate([[0], np.cumsum(lengths)])[before]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The text of each run of ids; bytes that aren't UTF-8 become U+FFFD."""
        lengths = self.offsets[ids + 1] - self.offsets[ids]
        data = self.block[spread(self.offsets[ids], lengths)].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[bounds].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


def vocabulary(definition: str) -> Vocabulary:
    """Built once in each worker process, with a memory of the pieces met lately."""

    def make() -> Vocabulary:
        out = Vocabulary(definition)
        out.memory = Memory(out.encode_distinct)
        return out

    return held(("bpe", definition), make)


def round_trips(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Encode every text and decode its ids.

    Returns doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded, one row per row of
    docs. A null text is the empty text, which has no ids. Bytes that aren't UTF-8 count as U+FFFD. Rows
    are independent: repeated rows give equal rows, an empty table gives none, other columns are left out.
    The vocabulary file is read by the driver and sent along: its size doesn't depend on the corpus.
    """
    return docs.select("doc_id", "text").mapInArrow(_coder(docs, vocabulary_path, digests=False), "doc_id long, n_tokens long, ids binary, decoded string")


def round_trip_digests(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """round_trips with SHA-256 digests in lowercase hex, ids_sha256 and decoded_sha256, in place of the ids and texts."""
    return docs.select("doc_id", "text").mapInArrow(_coder(docs, vocabulary_path, digests=True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _coder(docs: DataFrame, vocabulary_path: str, digests: bool):
    sent = docs.sparkSession.sparkContext.broadcast(Path(vocabulary_path).read_text(encoding="utf-8"))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids", "decoded"]

    def work(batches) -> Iterator[pa.RecordBatch]:
        coder = vocabulary(sent.value)
        for rows, data, offsets in rows_of(batches, ["doc_id", "text"], PIECE):
            ids, bounds = coder.encode(data, offsets)
            decoded = coder.decode(ids, bounds)
            packed = ids.astype("<u4").tobytes()
            runs = [packed[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            if digests:
                runs = [hashlib.sha256(x).hexdigest() for x in runs]
                decoded = [hashlib.sha256(x.encode("utf-8")).hexdigest() for x in decoded]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).cast(pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(runs, pa.string() if digests else pa.binary()), pa.array(decoded, pa.string())], names
            )

    return work
