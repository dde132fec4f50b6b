"""Alignment of two tokenizers over the same texts.

Both tokenizations of a text cover the same bytes. The incidence of tokens and bytes is a sparse matrix for each; the row
products of one with the other's transpose (Gustavson's method) give the pairs of tokens that share bytes, and
by how many. Where a pair ends at the same byte, both tokenizations have a bound, and these bounds cut the tokens into
groups; products of the token-group matrices give the pairs that share a group.

Neither tokenizer merges across a space that follows something else, so a text is a run of segments that are
tokenized and aligned by themselves, each distinct one once for each chunk of texts. How often a pair of ids is linked in
the whole corpus is counted from the chunks' distinct pairs, and the counts are joined back to the chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.piece_ids import LibraryPieces, closed
from shelfcast.llm.pretokens import byte_signs, valid
from shelfcast.llm.tables import stored
from shelfcast.llm.text import binary_array, dictionary, held, packed, pieces, rows_of, spread, unpacked

#: Bytes of text whose distinct segments and pairs are counted together; a longer text is a chunk of its own.
CHUNK = 16 << 20
#: Segments given to the piece model at a time, whose results are large objects, and segments aligned at a time.
BATCH = 1 << 12
BLOCK = 1 << 15
#: Segments of texts written out at a time.
SLICE = 1 << 16
OVERLAP, GROUP, END = KINDS = ("overlap", "group", "end")
# Fixed value: the sign that stands for a space in pieces.
SPACE_SIGN = "▁"


class Vocabularies:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, definition: str, model: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.byte_level = Tokenizer.from_str(definition)
        self.byte_level.no_truncation()
        self.byte_level.no_padding()
        self.byte_level.encode_special_tokens = True
        self.byte_pieces = LibraryPieces(self.byte_level, closed)
        self.pieces = SentencePieceProcessor(model_proto=model)
        signs = byte_signs()
        a = [b""] * self.byte_level.get_vocab_size()
        for text, i in self.byte_level.get_vocab().items():
            a[i] = bytes(signs[c] for c in text) if all(c in signs for c in text) else text.encode()
        b = []
        for i in range(self.pieces.get_piece_size()):
            text = self.pieces.id_to_piece(i)
            b.append(bytes([int(text[3:5], 16)]) if self.pieces.is_byte(i) else b"" if self.pieces.is_control(i) or self.pieces.is_unknown(i) else text.replace(SPACE_SIGN, " ").encode())
        self.a, self.b = TokenBytes(a), TokenBytes(b)
        self.lone_space = self.pieces.piece_to_id(SPACE_SIGN)
        # A piece with a space inside could join what stands on both sides of it.
        self.cuts_at_spaces = not any(b" " in x.lstrip(b" ") for x in b)
        self.digits = TokenBytes([str(i).encode() for i in range(max(len(a), len(b)))])

    def encode(self, segments: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """By each tokenizer the ids of all segments, and how many of each; a segment begins with a space, which the second adds by itself."""
        found = [], []
        for i in range(0, len(segments), BATCH):
            texts = [s[1:].decode() for s in segments[i : i + BATCH]]
            lists = [x if t else [self.lone_space] for x, t in zip(self.pieces.encode(texts, num_threads=1), texts)]
            found[1].append(np.fromiter(map(len, lists), np.int32, len(lists)))
            found[0].append(np.fromiter(chain.from_iterable(lists), np.int32, int(found[1][-1].sum())))
        b = tuple(np.concatenate([*x, np.zeros(0, np.int32)]) for x in found)
        return [self.byte_pieces(segments), b]


class TokenBytes:
    """The bytes of every id, end to end."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.block = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.block[spread(self.starts[ids], self.sizes[ids])]


def vocabularies(definition: str, model: bytes) -> Vocabularies:
    """Built once in each worker process."""
    return held(("cross tokens", definition, model), lambda: Vocabularies(definition, model))


@dataclass
class Csr:
    """A sparse matrix of ones: row i has the columns indices[bounds[i]:bounds[i + 1]]."""

    bounds: np.ndarray
    indices: np.ndarray

    @staticmethod
    def of_runs(sizes: np.ndarray) -> "Csr":
        """Row i has the next sizes[i] columns."""
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        return Csr(bounds, np.arange(bounds[-1]))

    @staticmethod
    def of_labels(labels: np.ndarray) -> "Csr":
        """Row i has the one column labels[i]."""
        return Csr(np.arange(len(labels) + 1), labels)

    def transposed(self, columns: int) -> "Csr":
        order = np.argsort(self.indices, kind="stable")
        rows = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        return Csr(np.concatenate([[0], np.cumsum(np.bincount(self.indices, minlength=columns))]), rows[order])

    def times(self, other: "Csr") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row products with other: rows, columns and values of the entries, by row, then column.

        Each entry of a row fetches other's row of that column; equal columns of one row are added up.
        """
        rows = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        fetched = np.diff(other.bounds)[self.indices]
        rows = np.repeat(rows, fetched)
        columns = other.indices[spread(other.bounds[self.indices], fetched)]
        width = int(columns.max()) + 1 if len(columns) else 1
        keys = rows * width + columns
        if len(keys) and (keys[1:] < keys[:-1]).any():
            keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[first] // width, keys[first] % width, np.diff(np.append(first, len(keys)))


@dataclass
class Alignment:
    """Both tokenizations of some segments. Tokens are numbered through all segments; *_before: those before each segment."""

    whole: np.ndarray
    a: np.ndarray
    b: np.ndarray
    a_before: np.ndarray
    b_before: np.ndarray
    overlaps: tuple[np.ndarray, np.ndarray, np.ndarray]
    a_group: np.ndarray
    b_group: np.ndarray
    ends_together: np.ndarray

    def links(self, kind: str) -> tuple[np.ndarray, np.ndarray]:
        """Linked tokens: those that share a byte, a group, or their last byte."""
        rows, columns, _ = self.overlaps
        if kind == OVERLAP:
            return rows, columns
        if kind == END:
            return rows[self.ends_together], columns[self.ends_together]
        groups = int(self.a_group[-1]) + 1 if len(self.a_group) else 0
        rows, columns, _ = Csr.of_labels(self.a_group).times(Csr.of_labels(self.b_group).transposed(groups))
        return rows, columns


def align(segments: list[bytes], pair: Vocabularies) -> Alignment:
    """Align both tokenizations of every segment. A segment whose bytes one of them doesn't give back has no tokens."""
    encoded = pair.encode(segments)
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    data = np.frombuffer(b"".join(segments), np.uint8)
    whole = np.ones(len(segments), bool)
    for tokens, (ids, counts) in zip((pair.a, pair.b), encoded):
        joined = tokens.joined(ids)
        ends = np.concatenate([[0], np.cumsum(tokens.sizes[ids])])[np.cumsum(counts, dtype=np.int64)]
        given = np.diff(np.concatenate([[0], ends]))
        if (given == sizes).all():
            whole[np.searchsorted(ends, np.flatnonzero(joined != data), side="right")] = False
        else:
            text = joined.tobytes()
            whole &= np.fromiter((text[y - n : y] == s for y, n, s in zip(ends.tolist(), given.tolist(), segments)), bool, len(segments))
    (a, a_counts), (b, b_counts) = ((ids[np.repeat(whole, counts)].astype(np.int64), np.where(whole, counts, 0)) for ids, counts in encoded)
    by_byte = Csr.of_runs(pair.a.sizes[a])
    other = Csr.of_runs(pair.b.sizes[b])
    overlaps = by_byte.times(other.transposed(int(other.bounds[-1])))
    together = by_byte.bounds[1:][overlaps[0]] == other.bounds[1:][overlaps[1]]
    cuts = by_byte.bounds[1:][overlaps[0][together]]
    groups = (np.searchsorted(cuts, x.bounds[1:]) for x in (by_byte, other))
    before = (np.concatenate([[0], np.cumsum(x)]) for x in (a_counts, b_counts))
    return Alignment(whole, a, b, *before, overlaps, *groups, together)


def segments(data: np.ndarray, offsets: np.ndarray, cuts: bool) -> tuple[pa.Array, np.ndarray]:
    """A space and the text, cut before each space that follows a sign which is no white space; segments before each text.

    An empty text has no segment. With ``cuts`` false a text is one segment.
    """
    data, offsets, _ = valid(data, offsets)
    spaced = np.insert(data, offsets[:-1], 0x20)
    bounds = offsets + np.arange(len(offsets))
    starts = np.zeros(len(spaced) + 1, bool)
    if cuts and len(spaced) > 1:
        # Printable ASCII, or letters of two bytes, whose first byte is C3 or later: none of these is white space.
        plain = (spaced > 0x20) & (spaced < 0x7F)
        plain[1:] |= (spaced[1:] >= 0x80) & (spaced[:-1] >= 0xC3) & (spaced[:-1] <= 0xDF)
        starts[1:-1] = (spaced[1:] == 0x20) & plain[:-1]
    starts[bounds] = True
    # The space of an empty text, alone between two bounds, belongs to none.
    empty = bounds[:-1][np.diff(bounds) == 1]
    keep = np.ones(len(spaced), bool)
    keep[empty] = False
    starts[empty] = False
    at = np.flatnonzero(starts)
    place = np.concatenate([[0], np.cumsum(keep)])
    edges = place[at] if len(at) else np.zeros(1, np.int64)
    if edges[0] != 0 or edges[-1] != place[-1]:
        edges = np.unique(np.concatenate([[0], edges, [place[-1]]]))
    return binary_array(spaced[keep], edges), np.searchsorted(edges, place[bounds])


def _group_texts(found: Alignment, pair: Vocabularies) -> tuple[np.ndarray, np.ndarray]:
    """The groups of every segment as text, each group ended by a semicolon: bytes, and the bytes before each segment."""
    groups = int(found.a_group[-1]) + 1 if len(found.a_group) else 0
    n_a, n_b = np.bincount(found.a_group, minlength=groups), np.bincount(found.b_group, minlength=groups)
    first = np.cumsum(n_a + n_b) - n_a - n_b
    rank_a = np.arange(len(found.a)) - (np.cumsum(n_a) - n_a)[found.a_group]
    rank_b = np.arange(len(found.b)) - (np.cumsum(n_b) - n_b)[found.b_group]
    cells = np.zeros(len(found.a) + len(found.b), np.int64)
    marks = np.full(len(cells), ord(","), np.uint8)
    at_a, at_b = first[found.a_group] + rank_a, (first + n_a)[found.b_group] + rank_b
    cells[at_a], cells[at_b] = found.a, found.b
    marks[first + n_a - 1], marks[first + n_a + n_b - 1] = ord("|"), ord(";")
    sizes = pair.digits.sizes[cells]
    ends = np.cumsum(sizes + 1)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[spread(ends - sizes - 1, sizes)] = pair.digits.joined(cells)
    out[ends - 1] = marks
    cells_before = found.a_before + found.b_before
    return out, np.concatenate([[0], ends])[cells_before]


def _vocabulary_files(docs: DataFrame, vocabulary_path: str, model_path: str):
    """Both files, which don't grow with the corpus, sent to the executors."""
    return docs.sparkSession.sparkContext.broadcast((Path(vocabulary_path).read_text(encoding="utf-8"), Path(model_path).read_bytes()))


def _sums(per_segment: np.ndarray, places: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The sum over the segments of each text."""
    return np.diff(np.concatenate([[0], np.cumsum(per_segment[places])])[before])


@dataclass
class Summary:
    """Of distinct segments: whether both tokenizers give each back, its tokens, groups and links, the ids linked, and its groups as text."""

    whole: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    linked: np.ndarray
    text_sizes: np.ndarray
    texts: np.ndarray


def summary(distinct: list[bytes], pair: Vocabularies, kind: str) -> Summary:
    """Segments are aligned in blocks, as the products are far larger than what is kept of them."""
    parts = []
    for i in range(0, max(1, len(distinct)), BLOCK):
        found = align(distinct[i : i + BLOCK], pair)
        texts, before = _group_texts(found, pair)
        left, right = found.links(kind)
        ends = np.concatenate([[0], found.a_group + 1])
        parts.append(
            (
                found.whole, np.diff(found.a_before), np.diff(found.b_before), np.diff(ends[found.a_before]),
                np.diff(np.searchsorted(left, found.a_before)), found.a[left] << 32 | found.b[right], np.diff(before), texts,
            )
        )
    return Summary(*(np.concatenate(x) for x in zip(*parts)))


def chunks(docs: DataFrame, vocabulary_path: str, model_path: str, kind: str, size: int = CHUNK) -> DataFrame:
    """One row per chunk of texts: counts and digests per text, its segments, their pairs, and the chunk's distinct pairs with counts."""
    sent = _vocabulary_files(docs, vocabulary_path, model_path)

    def work(batches) -> Iterator[pa.RecordBatch]:
        pair = vocabularies(*sent.value)
        number = 0
        for rows, data, offsets in rows_of(batches, ["doc_id", "text", "part"], size):
            # Cut in smaller pieces, for their masks.
            cut = [segments(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], pair.cuts_at_spaces) for i, j in pieces(offsets)]
            distinct, places = dictionary(pa.chunked_array([items for items, _ in cut]).combine_chunks())
            before = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x) for _, x in cut]))])
            del cut
            found = summary(distinct, pair, kind)
            # A text with a segment that isn't given back has no tokens at all.
            broken = _sums(~found.whole, places, before) > 0
            n_segments = np.where(broken, 0, np.diff(before))
            places = places[~np.repeat(broken, np.diff(before))]
            before = np.concatenate([[0], np.cumsum(n_segments)])
            times = np.bincount(places, minlength=len(distinct))
            keys, pair_of_link = np.unique(found.linked, return_inverse=True)
            counts = np.bincount(pair_of_link, weights=np.repeat(times, found.n_links), minlength=len(keys)).astype(np.int64)
            per_text = [_sums(x, places, before) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)]
            # Frequent segments get small numbers, which pack well.
            order = np.argsort(-times, kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            links_before = np.cumsum(found.n_links) - found.n_links
            pairs_by_rank = pair_of_link[spread(links_before[order], found.n_links[order])]
            doc_ids = rows.column(0).cast(pa.int64()).to_pylist()
            binaries = (rank[places], n_segments, pairs_by_rank, found.n_links[order])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows.column(2)[0].as_py() << 32 | number], pa.int64()),
                    pa.array([doc_ids], pa.list_(pa.int64())),
                    pa.array([np.column_stack(per_text).astype("<i8").tobytes()], pa.binary()),
                    pa.array([_digests(found, places, before)], pa.list_(pa.string())),
                    *(pa.array([packed(x)], pa.binary()) for x in binaries),
                    pa.array([keys], pa.list_(pa.int64())),
                    pa.array([counts], pa.list_(pa.int64())),
                ],
                _CHUNK_NAMES,
            )
            number += 1

    return docs.select("doc_id", "text", F.spark_partition_id().cast("long").alias("part")).mapInArrow(work, _CHUNK_SCHEMA)


def _digests(found: Summary, places: np.ndarray, before: np.ndarray) -> list[str]:
    """SHA-256 of the groups of every text, empty for a text without tokens."""
    text_before = np.cumsum(found.text_sizes) - found.text_sizes
    out = []
    for i, j in _slices(before):
        own = places[before[i] : before[j]]
        sizes = found.text_sizes[own]
        raw = found.texts[spread(text_before[own], sizes)].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[before[i : j + 1] - before[i]].tolist()
        # Without the semicolon after the last group.
        out += [hashlib.sha256(raw[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(ends, ends[1:])]
    return out


_CHUNK_SCHEMA = (
    "chunk long, doc_ids array<long>, sizes binary, digests array<string>, places binary, n_segments binary, "
    "pair_of_link binary, n_links binary, keys array<long>, counts array<long>"
)
_CHUNK_NAMES = [x.split()[0] for x in _CHUNK_SCHEMA.split(", ")]


def _slices(before: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about SLICE segments."""
    i, n = 0, len(before) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(before, before[i] + SLICE, side="right")) - 1)
        yield i, j
        i = j


def alignment_counts(docs: DataFrame, vocabulary_path: str, model_path: str, kind: str = END, size: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of docs.

    Tokens are those of a space and the text, by a byte-level vocabulary (a) and a piece model (b), without special
    tokens. A pair of ids counts as often as it is linked in all docs; n_best: links whose count is the highest of
    their b id, ties included; count_sum: the sum of the links' counts. ``kind`` says what links two tokens: a shared
    byte, a shared group, or the same last byte. A text that is null, empty, or that one of the tokenizers doesn't
    give back byte by byte (bytes that aren't UTF-8 count as U+FFFD) has no tokens: zeros and an empty digest.
    Repeated rows count and return one by one; a null doc_id stays null; an empty table gives no rows; other columns
    are left out.
    """
    made, _ = stored(chunks(docs, vocabulary_path, model_path, kind, size), "alignment-chunks")
    pairs = made.select("chunk", F.explode(F.arrays_zip("keys", "counts")).alias("pair")).select(F.col("chunk").alias("of_chunk"), F.col("pair.keys").alias("key"), F.col("pair.counts").alias("n"))
    totals = pairs.groupBy("key").agg(F.sum("n").alias("total"))
    # The right id is the lower half of the key.
    totals = totals.withColumn("b", F.col("key").bitwiseAND(F.lit((1 << 32) - 1)))
    highest = totals.groupBy("b").agg(F.max("total").alias("highest"))
    totals = totals.join(highest, "b").select("key", "total", (F.col("total") == F.col("highest")).alias("best"))
    answers = pairs.select("of_chunk", "key").join(totals, "key").select("of_chunk", "key", "total", "best")

    def work(key, left: pa.Table, right: pa.Table) -> pa.Table:
        get = lambda name: unpacked(left.column(name)[0].as_py())
        # The chunk's keys are in ascending order.
        order = np.argsort(right.column("key").to_numpy())
        total, best = right.column("total").to_numpy()[order], right.column("best").to_numpy()[order]
        of_link, before = get("pair_of_link"), np.concatenate([[0], np.cumsum(get("n_links"))])
        of_segment = [np.diff(np.concatenate([[0], np.cumsum(x[of_link], dtype=np.int64)])[before]) for x in (best, total)]
        places, texts_before = get("places"), np.concatenate([[0], np.cumsum(get("n_segments"))])
        found = [_sums(x, places, texts_before) for x in of_segment]
        sizes = np.frombuffer(left.column("sizes")[0].as_py(), "<i8").reshape(-1, 4)
        columns = [left.column("doc_ids")[0].values, *(pa.array(x, pa.int64()) for x in (*sizes.T, *found)), left.column("digests")[0].values]
        return pa.table(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return made.drop("keys", "counts").groupBy("chunk").cogroup(answers.groupBy("of_chunk")).applyInArrow(work, schema)


def aligned(docs: DataFrame, vocabulary_path: str, model_path: str, kind: str = OVERLAP) -> DataFrame:
    """doc_id, a_ids, b_ids, groups (the ids of each group) and links (places of the linked tokens, bytes they share) of every row.

    Rows and texts without tokens as in alignment_counts.
    """
    sent = _vocabulary_files(docs, vocabulary_path, model_path)

    def work(batches) -> Iterator[pa.RecordBatch]:
        pair = vocabularies(*sent.value)
        for rows, data, offsets in rows_of(batches, ["doc_id", "text"]):
            items, before = segments(data, offsets, pair.cuts_at_spaces)
            every = items.to_pylist()
            out = []
            for i, j in zip(before[:-1].tolist(), before[1:].tolist()):
                found = align(every[i:j], pair)
                if not found.whole.all():
                    found = align([], pair)
                shared = {(x, y): n for x, y, n in zip(*(c.tolist() for c in found.overlaps))}
                groups = [{"a": [], "b": []} for _ in range(int(found.a_group[-1]) + 1 if len(found.a_group) else 0)]
                for side, ids, of in (("a", found.a, found.a_group), ("b", found.b, found.b_group)):
                    for token, g in zip(ids.tolist(), of.tolist()):
                        groups[g][side].append(token)
                links = [{"a": x, "b": y, "bytes": shared.get((x, y), 0)} for x, y in zip(*(c.tolist() for c in found.links(kind)))]
                out.append((found.a.tolist(), found.b.tolist(), groups, links))
            group_type = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
            types = [pa.list_(pa.int32()), pa.list_(pa.int32()), group_type, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("bytes", pa.int32())]))]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).cast(pa.int64()), *(pa.array([x[k] for x in out], kind_of) for k, kind_of in enumerate(types))], ["doc_id", "a_ids", "b_ids", "groups", "links"]
            )

    schema = "doc_id long, a_ids array<int>, b_ids array<int>, groups array<struct<a: array<int>, b: array<int>>>, links array<struct<a: int, b: int, bytes: int>>"
    return docs.select("doc_id", "text").mapInArrow(work, schema)
