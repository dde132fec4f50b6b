"""Quality of texts by supervised subword embeddings.

A word stands for itself and its character n-grams, two neighbouring words for their pair; each is hashed to
a bucket that has a learned vector. A document is the average of its vectors, put through a softmax layer.
Vectors and layer are trained together by stochastic gradient descent in numpy.

To score, each bucket's vector is first multiplied with the layer: what is averaged is then one number for
each bucket, and the same for each distinct word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.llm.tables import stored
from shelfcast.llm.text import dictionary, held, mixed, rows_of, spread, unused, words

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 4000
BUCKETS = 1 << 16
WIDTH = 8
NGRAMS = (3, 4, 5)
EPOCHS, RATE, SEED = 6, 0.6, 17
#: Distinct words a worker process remembers before it starts anew.
REMEMBERED = 400_000
#: Words whose n-grams are hashed at a time: some hundred bytes for each n-gram.
WORDS = 1 << 13
#: The bucket of a word that stands next to itself, whichever word it is.
REPEATED = 0


def word_buckets(word: bytes) -> list[int]:
    """The buckets of a word and of the character n-grams of the word in angle brackets."""
    text = "<" + word.decode("utf-8", "replace") + ">"
    grams = [word, *(text[i : i + n].encode() for n in NGRAMS for i in range(len(text) - n + 1))]
    return [xxhash.xxh64_intdigest(g) % BUCKETS for g in grams]


# The primes of XXH64.
P1, P2, P3, P4, P5 = (
    np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def hashes_of_runs(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """XXH64 with seed 0 of the `length` (below 32) bytes from each start."""
    byte = lambda k: data[starts + k].astype(np.uint64)
    word = lambda k, n: sum((byte(k + j) << np.uint64(8 * j) for j in range(1, n)), byte(k))
    h, k = np.full(len(starts), P5 + np.uint64(length), np.uint64), 0
    while length - k >= 8:
        h = _turned(h ^ (_turned(word(k, 8) * P2, 31) * P1), 27) * P1 + P4
        k += 8
    if length - k >= 4:
        h = _turned(h ^ (word(k, 4) * P1), 23) * P2 + P3
        k += 4
    for j in range(k, length):
        h = _turned(h ^ (byte(j) * P5), 11) * P1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def word_scores(items: list[bytes], scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the scores of each word's buckets, and their number: what word_buckets gives, for many words at once."""
    total, count = np.zeros(len(items)), np.zeros(len(items), np.int64)
    if not items:
        return total, count
    whole = b"".join(b"<" + w + b">" for w in items)
    try:
        whole.decode("utf-8")
    except UnicodeDecodeError:
        lists = [word_buckets(w) for w in items]
        return np.array([scores[x].sum() for x in lists]), np.array([len(x) for x in lists])
    data = np.frombuffer(whole, np.uint8)
    ends = np.cumsum(np.fromiter(map(len, items), np.int64, len(items)) + 2)
    signs = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    sign_ends = np.searchsorted(signs, ends)
    sizes = np.diff(sign_ends, prepend=0)
    total += scores[(_hashes(items) % np.uint64(BUCKETS)).astype(np.int64)]
    count += 1
    for n in NGRAMS:
        grams = np.maximum(0, sizes - n + 1)
        first = spread(sign_ends - sizes, grams)
        starts, lengths = signs[first], signs[first + n] - signs[first]
        found = np.empty(len(first))
        for length in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == length)
            found[at] = scores[(hashes_of_runs(data, starts[at], length) % np.uint64(BUCKETS)).astype(np.int64)]
        total += np.bincount(np.repeat(np.arange(len(items)), grams), weights=found, minlength=len(items))
        count += grams
    return total, count


def _pairs(hashes: np.ndarray, places: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every pair of neighbouring words, and whether both are of one text."""
    codes = hashes[places]
    buckets = (mixed(codes[:-1] * np.uint64(3) + codes[1:]) % np.uint64(BUCKETS)).astype(np.int64)
    buckets[places[:-1] == places[1:]] = REPEATED
    inside = np.ones(max(0, len(codes) - 1), bool)
    edges = before[1:-1]
    inside[edges[(edges > 0) & (edges < len(codes))] - 1] = False
    return buckets, inside


def _hashes(distinct: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The buckets of each text, repeats included."""
    items, before = words(data, offsets)
    distinct, places = dictionary(items)
    lists = [np.array(word_buckets(w), np.int64) for w in distinct]
    pairs, inside = _pairs(_hashes(distinct), places, before)
    for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
        own = pairs[a : max(a, b - 1)][inside[a : max(a, b - 1)]]
        yield np.concatenate([*(lists[k] for k in places[a:b].tolist()), own]) if b > a else np.zeros(0, np.int64)


@dataclass
class Model:
    """vectors: buckets x width. layer: width x 2. bias: 2."""

    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    def bucket_scores(self) -> np.ndarray:
        """What each bucket adds, before averaging, to the log odds of label 1."""
        return (self.vectors @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float64)

    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def train(examples: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """examples: label, distinct buckets, how often each occurs. Without examples every score is one half."""
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    layer, bias = np.zeros((WIDTH, 2)), np.zeros(2)
    done, steps = 0, max(1, epochs * len(examples))
    shares = [counts / counts.sum() if len(counts) else counts for _, _, counts in examples]
    for _ in range(epochs):
        for k in random.permutation(len(examples)):
            label, buckets, _ = examples[k]
            step = rate * (1 - done / steps)
            done += 1
            hidden = shares[k] @ vectors[buckets] if len(buckets) else np.zeros(WIDTH)
            odds = hidden @ layer + bias
            slope = np.exp(odds - odds.max())
            slope /= slope.sum()
            slope[label] -= 1
            back = layer @ slope
            layer -= step * np.outer(hidden, slope)
            bias -= step * slope
            # The average spreads the gradient thinly: each vector moves by its share of the document, times their number.
            if len(buckets):
                vectors[buckets] -= step * np.minimum(1.0, shares[k] * len(buckets))[:, None] * back[None, :]
    return Model(vectors, layer, bias)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on at most `sample` labelled texts, those with the smallest hash of doc_id.

    labels: doc_id, label (0 or 1). Rows without either count for nothing; a doc_id with both labels is taken as 0.
    Documents become bucket counts where they lie; one task of the bounded sample's counts trains.
    """
    chosen = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    # No more rows than the bound, so it may be sent to every executor.
    chosen, _ = stored(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labelled")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").dropDuplicates(["doc_id"])

    def count(batches) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in rows_of(batches, ["doc_id", "label", "text"]):
            found = [np.unique(x, return_counts=True) for x in features(data, offsets)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *(pa.array([x[k].astype("<i4").tobytes() for x in found], pa.binary()) for k in (0, 1))], ["doc_id", "label", "buckets", "counts"]
            )

    def learn(batches) -> Iterator[pa.RecordBatch]:
        examples = [
            (doc_id, label, np.frombuffer(a, "<i4"), np.frombuffer(b, "<i4"))
            for batch in batches
            for doc_id, label, a, b in zip(*(batch.column(k).to_pylist() for k in range(4)))
        ]
        # In an order that doesn't depend on how the rows were dealt.
        model = train([x[1:] for x in sorted(examples, key=lambda x: x[0])])
        yield pa.RecordBatch.from_arrays([pa.array([x.astype("<f8").tobytes()], pa.binary()) for x in (model.vectors, model.layer, model.bias)], ["vectors", "layer", "bias"])

    counted, _ = stored(rows.mapInArrow(count, "doc_id long, label int, buckets binary, counts binary"), "examples")
    found = counted.coalesce(1).mapInArrow(learn, "vectors binary, layer binary, bias binary").first()
    if found is None:
        return train([])
    vectors, layer, bias = (np.frombuffer(bytes(x), "<f8") for x in found)
    return Model(vectors.reshape(BUCKETS, WIDTH), layer.reshape(WIDTH, 2), bias)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with one more column: how likely label 1 is, from the whole text.

    A null, empty or blank text has no features and gets the score that the bias alone gives. Repeated rows
    get equal scores; an empty table stays empty; a column of the same name is replaced. The model has a fixed size.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.bucket_scores(), model.offset()))
    version = xxhash.xxh64_hexdigest(model.bucket_scores().tobytes())
    kept = [c for c in docs.columns if c != column]
    plain = docs.select(*kept)

    def work(batches) -> Iterator[pa.RecordBatch]:
        scores, offset = sent.value
        known: dict[bytes, tuple[float, int]] = held(("quality", version), dict)
        for rows, data, offsets in rows_of(batches, kept):
            items, before = words(data, offsets)
            distinct, places = dictionary(items)
            if len(known) > REMEMBERED:
                known.clear()
            new = [word for word in distinct if word not in known]
            for i in range(0, len(new), WORDS):
                some = new[i : i + WORDS]
                known.update(zip(some, zip(*(x.tolist() for x in word_scores(some, scores)))))
            own = np.array([known[w] for w in distinct], np.float64).reshape(-1, 2)[places]
            pairs, inside = _pairs(_hashes(distinct), places, before)
            both = np.column_stack([np.where(inside, scores[pairs], 0.0), inside])
            sums = np.concatenate([np.zeros((1, 2)), np.cumsum(own, axis=0)])
            more = np.concatenate([np.zeros((1, 2)), np.cumsum(both, axis=0)])
            last = np.minimum(before, len(more) - 1)
            total = (sums[before[1:]] - sums[before[:-1]]) + (more[last[1:]] - more[last[:-1]])
            odds = offset + total[:, 0] / np.maximum(total[:, 1], 1)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(1 / (1 + np.exp(-odds)), pa.float64())], [*kept, column])

    return plain.mapInArrow(work, T.StructType([*plain.schema.fields, T.StructField(column, T.DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of docs whose score, by a model fitted on them and the labels, is at least `least`; their columns.

    Rows without text, repeated rows and empty tables as in score; a column named score is kept as it is.
    """
    (name,) = unused(docs.columns, "score")
    return score(docs, fit(docs, labels), name).where(F.col(name) >= least).select(*(F.col(f"`{c}`") for c in docs.columns))
