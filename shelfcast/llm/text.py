"""Texts as Arrow buffers: bytes, words and word dictionaries without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text worked on at a time; a longer text is one piece of its own.
PIECE = 4 << 20

# The bytes that separate words, space and tab to carriage return.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_SEPARATES = np.zeros(256, bool)
_SEPARATES[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += ord("a") - ord("A")


_held: dict = {}


def held(key, make):
    """What a worker process keeps between tasks for one operator. That of the operator before is dropped, as workers are used again."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of text that a group of texts has on average, at most. A longer text is no larger than itself.
GROUP_BYTES = 64 << 20


def text_groups(df: DataFrame, size: int = GROUP_BYTES) -> int:
    """The number of groups a corpus is dealt into: the session's shuffle partitions, and more if groups would be too large for a task."""
    total = df.agg(F.sum(F.octet_length(F.col("text")))).first()[0] or 0
    return max(partitions(df), -(-total // size))


def dealt_by(df: DataFrame, groups: int, column: str) -> DataFrame:
    """Rows with group number 0, 1, ... in partitions of these numbers, so that no two groups meet in a task and none stays idle."""
    return df.repartitionById(groups, F.col(column))


def unused(columns: list[str], *names: str) -> list[str]:
    """Names like these that none of the columns has, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def remainder(doc_id, divisor: int):
    """crc32(doc_id as text) mod divisor; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, end to end, and the offset of each (one more than texts).

    Null is the empty text. The arrays are views of Arrow memory: not to be written to.
    """
    # Wide offsets first: the chunks together may have more bytes than narrow ones can count.
    column = column.cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of consecutive texts of about `size` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, j
        i = j


def rows_of(batches, columns: list[str], size: int = PIECE) -> Iterator[tuple]:
    """For each piece of the batches: the piece as a record batch, its bytes and its offsets."""
    for batch in batches:
        data, offsets = utf8(batch.column(columns.index("text")))
        for i, j in pieces(offsets, size):
            yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased; other bytes stay."""
    return _LOWER[data]


def binary_array(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Spans that lie end to end, as an Arrow binary array over the same bytes."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts as an Arrow array, and the number of words before each text."""
    inside = ~_SEPARATES[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts_of_texts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[starts_of_texts] = inside[starts_of_texts]
    starts = np.flatnonzero(begins)
    # Without the separators the words lie end to end.
    place = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=place[1:])
    bounds = np.append(place[starts], place[-1])
    return binary_array(data[inside], bounds), np.searchsorted(starts, offsets)


def distinct(items: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct items as an Arrow array, and for each item its place among them."""
    coded = items.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def dictionary(items: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """Distinct items, and for each item its place among them."""
    coded = items.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[0], starts[0]+1, ... for lengths[0] of them, then those of the next item, and so on."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of 64-bit values, in place of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def packed(numbers: np.ndarray) -> bytes:
    """Numbers of 32 bits, their lowest bytes first, then the next ones, compressed."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(value: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(value), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
