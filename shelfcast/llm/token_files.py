"""Token ids of a corpus as compressed files in document order.

The files are a table of segments. A segment holds whole documents in ascending order as one binary value:
a header, doc ids and lengths, the checkpoints of its blocks, and the Huffman-packed ids. A second table
holds the code lengths. Both are written and read by Spark, so they can lie in any store that it reaches.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfcast.llm.huffman import BLOCK, Codebook, code_lengths
from shelfcast.llm.piece_ids import LibraryPieces, Memory, closed
from shelfcast.llm.pretokens import pretokens
from shelfcast.llm.tables import discard, stored
from shelfcast.llm.text import distinct, held, partitions, pieces, rows_of, spread

#: Bytes of text whose distinct pieces are encoded together; a longer text is a chunk of its own.
CHUNK = 8 << 20
#: Ids of a segment; a longer document is a segment of its own.
SEGMENT = 1 << 20
# First bytes and header of a segment: documents, ids, ids of a block, checkpoints, whether each doc_id is null.
MAGIC = b"SHID"
HEADER = struct.Struct("<4sQQIQ")


class LibraryCoder:
    """The tokenizers library, asked for each distinct piece of the texts.

    The library merges inside pieces only and takes each piece by itself, so the ids of a text are those
    of its pieces in a row.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = next((token.content.encode() for token in added), b"")
        self.memory = Memory(LibraryPieces(self.tokenizer, closed))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids before each text."""
        # Cut in smaller parts, for the masks that cutting takes.
        cut = [pretokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], self.special) for i, j in pieces(offsets)]
        known, places = distinct(pa.chunked_array([items for items, _ in cut], pa.large_binary()).combine_chunks())
        before = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x) for _, x in cut] or [np.zeros(0, np.int64)]))])
        del cut
        pool, counts = self.memory(known)
        lengths = counts[places]
        return pool[spread((np.cumsum(counts) - counts)[places], lengths)], np.concatenate([[0], np.cumsum(lengths)])[before]


def encoded(docs: DataFrame, vocabulary_path: str, end_id: int = 0) -> DataFrame:
    """(doc_id, n_tokens, ids): the ids of every text and the end id, little-endian, in two bytes each if all fit, else four."""
    return _encoded(docs, vocabulary_path, end_id).where("counts IS NULL").drop("counts")


def _encoded(docs: DataFrame, vocabulary_path: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens, ids, counts): the rows of encoded, and one row per task that has only counts, of every id in the task's texts."""
    sent = docs.sparkSession.sparkContext.broadcast(Path(vocabulary_path).read_text(encoding="utf-8"))
    names = ["doc_id", "n_tokens", "ids", "counts"]

    def work(batches) -> Iterator[pa.RecordBatch]:
        coder = held(("token files", sent.value), lambda: LibraryCoder(sent.value))
        size = coder.tokenizer.get_vocab_size()
        total = np.zeros(max(size, end_id + 1), np.int64)
        for rows, data, offsets in rows_of(batches, ["doc_id", "text"], CHUNK):
            ids, bounds = coder.encode(data, offsets)
            closed = np.insert(ids, bounds[1:], end_id).astype(_kind(size))
            total += np.bincount(closed, minlength=len(total))
            ends = bounds + np.arange(len(bounds))
            raw, width = closed.tobytes(), closed.itemsize
            runs = [raw[width * a : width * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array(runs, pa.binary()), pa.nulls(len(rows), pa.binary())], names)
        used = np.flatnonzero(total)
        packed = np.column_stack([used, total[used]]).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([packed], pa.binary())], names)

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_tokens long, ids binary, counts binary")


def _kind(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _ids(run: bytes, n: int) -> np.ndarray:
    return np.frombuffer(run, "<u2" if len(run) == 2 * n else "<u4")


def id_counts(counted: DataFrame) -> DataFrame:
    """(id, n) over all documents, from the tasks' counts."""

    def work(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0):
                pairs = np.frombuffer(packed.as_py(), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["id", "n"])

    return counted.where("counts IS NOT NULL").select("counts").mapInArrow(work, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, vocabulary_path: str, path: str, end_id: int = 0, segment: int = SEGMENT) -> None:
    """Write the ids of all texts, each followed by end_id, as compressed segments in ascending doc_id order.

    A null text is the empty text. Rows without doc_id come first; rows that share a doc_id are ordered by
    their number of ids, then by their hash. Only the counts and lengths of ids, no more than the
    vocabulary has, reach the driver; the vocabulary file is sent to the executors. Repeated rows are written one by
    one, a very long text as a segment of its own, an empty table as files without segments; other columns are left out.
    """
    spark = docs.sparkSession
    made, path_of_ids = stored(_encoded(docs, vocabulary_path, end_id), "token-ids", compression="zstd")
    counts = id_counts(made).collect()
    ids = made.where("counts IS NULL").select("doc_id", "n_tokens", "ids")
    total = np.zeros(max([x.id for x in counts], default=0) + 1, np.int64)
    for x in counts:
        total[x.id] = x.n
    lengths = code_lengths(total)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id long, length int").coalesce(1).write.parquet(f"{path}/codebook")

    def work(batches) -> Iterator[pa.RecordBatch]:
        book = Codebook(lengths)
        held: list[tuple[int | None, int, bytes]] = []
        size = number = 0
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if held and size + row[1] > segment:
                    yield _segment(book, number, held)
                    held, size, number = [], 0, number + 1
                held.append((row[0], row[1], row[2].as_py()))
                size += row[1]
        if held:
            yield _segment(book, number, held)

    ordered = ids.withColumn("tie", F.xxhash64("ids")).repartitionByRange(partitions(docs), F.col("doc_id").asc_nulls_first(), "n_tokens", "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n_tokens", "tie")
    segments = ordered.select("doc_id", "n_tokens", "ids").mapInArrow(work, "segment int, n_docs long, n_tokens long, packed binary")
    segments.withColumn("part", F.spark_partition_id()).write.option("compression", "none").parquet(f"{path}/segments")
    discard(spark, path_of_ids)


def _segment(book: Codebook, number: int, held: list[tuple[int | None, int, bytes]]) -> pa.RecordBatch:
    ids = np.concatenate([_ids(run, n) for _, n, run in held])
    bits, checkpoints = book.pack(ids)
    value = b"".join(
        (
            HEADER.pack(MAGIC, len(held), len(ids), BLOCK, len(checkpoints)),
            np.array([doc_id is None for doc_id, _, _ in held], np.uint8).tobytes(),
            np.array([doc_id or 0 for doc_id, _, _ in held], "<i8").tobytes(),
            np.array([n for _, n, _ in held], "<i8").tobytes(),
            checkpoints.astype("<i8").tobytes(),
            bits,
        )
    )
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([len(held)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([value], pa.binary())], ["segment", "n_docs", "n_tokens", "packed"])


def _opened(book: Codebook, value: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Doc ids, lengths and ids of a segment."""
    magic, n_docs, n, block, blocks = HEADER.unpack_from(value)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    at = HEADER.size
    absent = np.frombuffer(value, np.uint8, n_docs, at).astype(bool)
    doc_ids = np.frombuffer(value, "<i8", n_docs, at + n_docs)
    sizes = np.frombuffer(value, "<i8", n_docs, at + 9 * n_docs)
    checkpoints = np.frombuffer(value, "<i8", blocks, at + 17 * n_docs)
    ids = book.unpack(value[at + 17 * n_docs + 8 * blocks :], checkpoints, n, block)
    return [None if gone else x for gone, x in zip(absent.tolist(), doc_ids.tolist())], sizes, ids


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the files, from the packed ids.

    start: ids of all documents before it. ids: little-endian unsigned 32-bit integers, left out on request.
    """
    schema = "segment int, n_docs long, n_tokens long, packed binary, part int"
    segments = spark.read.schema(schema).parquet(f"{path}/segments")
    # As many rows as the vocabulary has ids, at most.
    lengths = {x.id: x.length for x in spark.read.schema("id long, length int").parquet(f"{path}/codebook").collect()}

    def work(batches) -> Iterator[pa.RecordBatch]:
        table = np.zeros(max(lengths, default=0) + 1, np.uint8)
        table[list(lengths)] = list(lengths.values())
        book = Codebook(table)
        for batch in batches:
            for k, value in enumerate(batch.column(2)):
                doc_ids, sizes, ids = _opened(book, value.as_py())
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                raw = ids.astype("<u4").tobytes()
                runs = [raw[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                n = len(doc_ids)
                columns = [
                    pa.array([batch.column(0)[k].as_py()] * n, pa.int32()),
                    pa.array([batch.column(1)[k].as_py()] * n, pa.int32()),
                    pa.array(doc_ids, pa.int64()),
                    pa.array(bounds[:-1], pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([zlib.crc32(x) for x in runs], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array(runs, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["part", "segment", "doc_id", "inside", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    rows = segments.select("part", "segment", "packed").mapInArrow(work, "part int, segment int, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    sizes = segments.select("part", "segment", "n_tokens")
    earlier = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition that wrote.
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("before_part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = sizes.withColumn("in_part", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).join(parts, "part").select("part", "segment", (F.col("before_part") + F.col("in_part")).alias("before"))
    return rows.join(starts, ["part", "segment"]).select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
