"""Near-duplicates by SimHash: pigeonhole blocks, join on blocks, Hamming distance.

A fingerprint is cut into one block more than bits may differ, so that two close fingerprints agree in
at least one block. Fingerprints with an equal block form a bucket, in which distances are measured.
A bucket that is too large is cut again by the same rule, over the bits that its fingerprints do not
already share, until it is small; the last cuts leave so few free bits that it must be.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.components import components
from shelfcast.llm.tables import stored
from shelfcast.llm.text import rows_of, unused

BITS = 64
# Fixed value: the seed of the shingle hash.
SEED = 42
#: Fingerprints that are compared with one another in one bucket.
BUCKET = 4096


def fingerprint(shingles: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    if not len(shingles):
        return 0
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    most = 2 * bits.sum(axis=0, dtype=np.int64) > len(shingles)
    return int(np.packbits(most, bitorder="little").view("<u8")[0])


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each run of `width` lower-cased words (of all words, if fewer), repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = zip(*(words[i:] for i in range(width))) if len(words) >= width else [words]
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(SEED)), np.uint64)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint of every text as a signed long; text_hash tells apart rows that share a doc_id.

    Words are runs without ASCII white space; A-Z are lower-cased. A null text or one without words has fingerprint zero.
    """

    def work(batches) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in rows_of(batches, ["doc_id", "text"]):
            raw, bounds = data.tobytes(), offsets.tolist()
            texts = [raw[a:b] for a, b in zip(bounds, bounds[1:])]
            marks = np.fromiter(map(xxhash.xxh64_intdigest, texts, repeat(SEED)), np.uint64, len(texts))
            prints = np.fromiter((fingerprint(shingle_hashes(x, shingle)) for x in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(marks.view(np.int64)), pa.array(prints.view(np.int64))], ["doc_id", "text_hash", "fp"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, text_hash long, fp long")


def cut(free: list[int], parts: int) -> list[list[int]]:
    """Bit numbers dealt into runs of nearly equal length."""
    size, more = divmod(len(free), parts)
    ends = [size * (i + 1) + min(i + 1, more) for i in range(parts)]
    return [free[a:b] for a, b in zip([0, *ends], ends)]


def as_mask(bits: list[int]) -> int:
    """The mask of these bits as a signed long."""
    mask = sum(1 << b for b in bits)
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def links(prints: DataFrame, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """prints: distinct fingerprints, (fp). Returns (a, b), which link all that are connected by steps of `distance` bits or fewer.

    Inside a bucket only a spanning forest is returned: no link between fingerprints of different
    parts of the graph is lost, and the rows never exceed the fingerprints in the bucket.
    """
    masks = {as_mask(block): block for block in cut(list(range(BITS)), distance + 1)}
    rows = prints.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("mask"))
    found = None
    while True:
        rows = rows.withColumn("shared", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("mask", "shared").agg(F.count("*").alias("size"))
        # So few free bits that a bucket can't be large, or can't be cut.
        last = F.col("mask").isin([m for m, used in masks.items() if BITS - len(used) <= max(distance, bucket.bit_length() - 1)])
        small = rows.join(sizes.where((F.col("size") > 1) & ((F.col("size") <= bucket) | last)).drop("size"), ["mask", "shared"])
        pairs = _forests(small, distance)
        found = pairs if found is None else found.unionByName(pairs)
        large, _ = stored(sizes.where((F.col("size") > bucket) & ~last).drop("size"), "buckets")
        if large.isEmpty():
            return found
        finer = {m: [used + part for part in cut([b for b in range(BITS) if b not in set(used)], distance + 1) if part] for m, used in masks.items()}
        below = F.create_map(*(x for m, cuts in finer.items() for x in (F.lit(m), F.array(*(F.lit(as_mask(c)) for c in cuts)))))
        rows = rows.join(large, ["mask", "shared"]).select("fp", F.explode(F.element_at(below, F.col("mask"))).alias("mask"))
        masks = {as_mask(c): sorted(c) for cuts in finer.values() for c in cuts}


def _forests(rows: DataFrame, distance: int) -> DataFrame:
    """A spanning forest of each bucket (mask, shared), which is not larger than the bound."""

    def work(batches) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 3), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.column_stack([batch.column(i).to_numpy() for i in range(3)])])
            if len(held):
                # The last bucket may go on in the next batch.
                last = np.flatnonzero((held[:, :2] != held[-1, :2]).any(axis=1))
                end = last[-1] + 1 if len(last) else 0
                yield forest(held[:end], distance)
                held = held[end:]
        yield forest(held, distance)

    dealt = rows.select("mask", "shared", "fp").repartition("mask", "shared").sortWithinPartitions("mask", "shared")
    return dealt.mapInArrow(work, "a long, b long")


def forest(rows: np.ndarray, distance: int) -> pa.RecordBatch:
    """rows: mask, shared bits and fingerprint, buckets in runs. Each fingerprint with the first one of its tree."""
    n = len(rows)
    prints = rows[:, 2].copy().view(np.uint64)
    edge = np.append(np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1, n) if n else np.zeros(0, np.int64)
    end = np.repeat(edge, np.diff(edge, prepend=0)) if n else edge
    root = np.arange(n)
    here, step = np.arange(n), 1
    while True:
        here = here[here + step < end[here]]
        if not len(here):
            break
        near = here[np.bitwise_count(prints[here] ^ prints[here + step]) <= distance]
        near = near[root[near] != root[near + step]]
        for a, b in zip(root[near].tolist(), root[near + step].tolist()):
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
        if len(near):
            while (above := root[root]).tobytes() != root.tobytes():
                root = above
        step += 1
    joined = np.flatnonzero(root != np.arange(n))
    out = prints.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(out[joined]), pa.array(out[root[joined]])], ["a", "b"])


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, fingerprint (16 lowercase hex digits), component_id, the smallest doc_id reachable by links.

    Equal fingerprints are one node of the graph, so copies cost nothing beyond their own row. Texts without
    words (null, empty) have fingerprint zero and are linked like any other. A null doc_id is never the smallest
    unless the whole component has none, and then component_id is null; rows that share a doc_id are told apart by
    their text only. An empty table gives no rows; other columns are left out.
    """
    return _rooted(docs, shingle, distance).drop("root")


def _rooted(docs: DataFrame, shingle: int, distance: int) -> DataFrame:
    """near_duplicates with root, a fingerprint that names the component."""
    prints, _ = stored(fingerprints(docs, shingle), "fingerprints")
    classes, _ = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes.select("fp"), distance))
    members = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = members.groupBy("root").agg(F.min("least").alias("component_id"))
    named = members.select("fp", "root").join(least, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp").select("doc_id", "text_hash", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "root")


def one_of_each(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with the smallest doc_id stays.

    Ties on doc_id (repeated rows, null) go to the smallest hash of the text; of rows that agree in both, one stays. A null
    and an empty text are one text, and all texts without words one component. All columns are kept; an empty table stays empty.
    """
    of_doc, of_text, text_hash = unused(docs.columns, "of_doc", "of_text", "text_hash")
    # By root, as a doc_id names no component: several may share their smallest one, or have none.
    stays = _rooted(docs, shingle, distance).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_hash")).alias("row"))
    stays = stays.select(F.col("row.doc_id").alias(of_doc), F.col("row.text_hash").alias(of_text))
    stays, _ = stored(stays, "kept")
    marked = docs.withColumn(text_hash, F.expr("xxhash64(coalesce(text, ''))"))
    kept = marked.join(stays.hint("merge"), F.col("doc_id").eqNullSafe(F.col(of_doc)) & (F.col(text_hash) == F.col(of_text)), "left_semi")
    return kept.dropDuplicates(["doc_id", text_hash]).select(*(F.col(f"`{c}`") for c in docs.columns))
