"""Phrases whose words stand together more often than apart, by best-first growth.

A phrase of two to four words is cut into a first and a last part; its score at a cut relates its count to theirs, and
the lowest cut counts. Growth begins with the phrases of two words. What is known of a prefix bounds all that can be
grown from it: a phrase counts no more than its prefix q, and at the cut after the first word w it scores at most
2,000,000 f(q) / (f(w) + f(q)). So prefixes are expanded from the best bound down, for all languages at once, in
rounds: a round sets a threshold for each language, counts only extensions of prefixes whose bound reaches it, and
ends a language once as many phrases as are asked for survive above the threshold, ties included; the next
round lowers it for the others, at last to zero. A phrase above the threshold is extended on both sides, as a longer one that
occurs nearly as often takes its place.

Texts are cut into words once. Words and phrases go by 64-bit hashes, so a round is a pass over arrays of numbers.
Sets of phrases reach the tasks as bitmaps of bounded size; a wrong hit there only counts a phrase in vain.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.tables import discard, stored
from shelfcast.llm.text import binary_array, dictionary, lowered, mixed, packed, rows_of, unpacked, utf8

LEAST, LONGEST, SHARE, TOP = 30, 4, 80, 2000
SCALE = 2_000_000
#: Bytes of text whose phrases are counted together before they are shuffled; a longer text is a chunk of its own.
CHUNK = 4 << 20
#: Rows of counts handed on at a time.
ROWS = 1 << 16
#: Phrases of two words above a language's threshold in the first round, and by how much more in each later one.
FIRST, MORE = 4 * TOP, 8
#: Thresholds lie on multiples of this.
STEP_OF_SCORES = 1000
#: Bits of a bitmap: so many for each key, within these limits (a power of two each).
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 27
STEP = np.uint64(0x9E3779B97F4A7C15)

# The bytes between words, and those that also end a piece.
BLANKS = b" \t"
ENDS_OF_PIECES = b".,;:!?\n\x0b\x0c\r"
UNKNOWN = "und"

_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(ENDS_OF_PIECES)] = 2


def words_in_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and of each whether it stands in the same piece as the one before."""
    kind = _KIND[data]
    inside = kind == 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    # A batch has less than 2 GB, so 32 bits count its bytes.
    place = np.zeros(len(data) + 1, np.int32)
    np.cumsum(inside, out=place[1:])
    items = binary_array(data[inside], np.append(place[starts], place[-1]))
    # Pieces passed so far: separators, and texts begun.
    passed = np.cumsum(kind == 2, dtype=np.int32)
    piece = passed[starts] + np.searchsorted(offsets, starts, side="right")
    joined = np.zeros(len(starts), bool)
    joined[1:] = piece[1:] == piece[:-1]
    return items, joined


def hashed(lang: str, words: list[bytes]) -> np.ndarray:
    """What xxhash64(lang, word) is in SQL."""
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def chunks(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """One row per language of each chunk of texts: its distinct words with hashes and counts, and its words in order as places among them."""

    def work(batches) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in rows_of(batches, ["text", "lang"], size):
            langs = rows.column(1)
            for lang in pc.unique(langs).to_pylist():
                data, offsets = utf8(rows.column(0).filter(pc.equal(langs, lang)))
                items, joined = words_in_pieces(lowered(data), offsets)
                distinct, places = dictionary(items)
                if not distinct:
                    continue
                counts = np.bincount(places, minlength=len(distinct))
                # Frequent words get small places, which pack well.
                order = np.argsort(-counts, kind="stable")
                rank = np.empty_like(order)
                rank[order] = np.arange(len(order))
                distinct = [distinct[i] for i in order.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang], pa.string()),
                        pa.array([distinct], pa.list_(pa.binary())),
                        pa.array([counts[order]], pa.list_(pa.int64())),
                        pa.array([hashed(lang, distinct).tobytes()], pa.binary()),
                        pa.array([packed(rank[places])], pa.binary()),
                        pa.array([np.packbits(joined).tobytes()], pa.binary()),
                    ],
                    ["lang", "words", "counts", "hashes", "places", "joined"],
                )

    texts = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"))
    return texts.mapInArrow(work, "lang string, words array<binary>, counts array<long>, hashes binary, places binary, joined binary")


def bitmap(keys: DataFrame) -> np.ndarray:
    """The keys' lowest bits as a bitmap, whose size has a bound whatever the number of keys."""
    n = keys.count()
    bits = LEAST_BITS
    while bits < min(MOST_BITS, BITS_PER_KEY * n):
        bits *= 2
    # Positions count from one here; a bucket has 32,768 of them.
    place = F.pmod(F.col("key"), F.lit(bits)) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("part")).collect()
    out = np.zeros((bits // 32768, 4096), np.uint8)
    for row in parts:
        out[row.bucket - 1] = np.frombuffer(bytes(row.part), np.uint8)
    return out.ravel()


def holds(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bitmap has each key's bit."""
    place = (keys & np.uint64(8 * len(held) - 1)).astype(np.int64)
    return (held[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


class Grams:
    """The phrases of a chunk that consist of frequent words: per length k the key of the one that ends at each word."""

    def __init__(self, row: Mapping[str, bytes], frequent: np.ndarray):
        hashes, places = np.frombuffer(row["hashes"], np.uint64), unpacked(row["places"])
        joined = np.unpackbits(np.frombuffer(row["joined"], np.uint8), count=len(places)).astype(bool)
        known = holds(frequent, hashes)[places]
        self.keys = {1: hashes[places]}
        self.valid = {1: known}
        joined[1:] &= known[:-1]
        self.joined = joined & known

    def grow(self, k: int, allowed: np.ndarray | None = None) -> None:
        """Keys of k words from those of k - 1; ``allowed`` is a bitmap of phrases of k words."""
        keys = np.zeros_like(self.keys[1])
        keys[1:] = mixed(self.keys[k - 1][:-1] * STEP + self.keys[1][1:])
        valid = self.joined & self.valid[k - 1]
        valid[1:] &= self.valid[k - 1][:-1]
        valid[:1] = False
        if allowed is not None:
            valid[valid] = holds(allowed, keys[valid])
        self.keys[k], self.valid[k] = keys, valid

    def counted(self, k: int, chosen: np.ndarray, parts: bool) -> tuple[np.ndarray, ...]:
        """Distinct keys of k words at the chosen places: key and count, with prefix and suffix if asked for."""
        at = np.flatnonzero(chosen & self.valid[k])
        if not parts:
            return np.unique(self.keys[k][at], return_counts=True)
        keys, first, n = np.unique(self.keys[k][at], return_index=True, return_counts=True)
        return keys, n, self.keys[k - 1][at[first] - 1], self.keys[k - 1][at[first]]


def count_grams(cut: DataFrame, k: int, sets: Mapping[str, np.ndarray], parts: bool) -> DataFrame:
    """(key, n) over all chunks, with prefix and suffix if ``parts``, of phrases of k words; sets of phrases as bitmaps.

    words, pairs: the frequent ones. grow, left: phrases of k - 1 words that are extended to the right, to the left. only:
    phrases of k words. Without any of the last three all are counted.
    """
    sent = cut.sparkSession.sparkContext.broadcast(dict(sets))

    def work(batches) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                grams = Grams({name: batch.column(i)[row].as_py() for i, name in enumerate(("hashes", "places", "joined"))}, held["words"])
                for length in range(2, k + 1):
                    grams.grow(length, held.get("pairs") if length == 2 else None)
                chosen = grams.valid[k].copy()
                if "grow" in held:
                    chosen[1:] &= holds(held["grow"], grams.keys[k - 1][:-1]) | holds(held["left"], grams.keys[k - 1][1:])
                if "only" in held:
                    chosen &= holds(held["only"], grams.keys[k])
                found = grams.counted(k, chosen, parts)
                del grams, chosen
                for start in range(0, len(found[0]), ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(x[start : start + ROWS].view(np.int64)) for x in found], names)

    names = ["key", "n", "prefix", "suffix"] if parts else ["key", "n"]
    counted = cut.select("hashes", "places", "joined").mapInArrow(work, ", ".join(f"{x} long" for x in names))
    return counted.groupBy("key").agg(F.sum("n").alias("n"), *(F.first(x).alias(x) for x in names[2:]))


def joined_parts(counted: DataFrame, lower: DataFrame) -> DataFrame:
    """Phrases with their words, and the counts of their first and last parts, from those one word shorter."""
    first = lower.select(F.col("key").alias("prefix"), "lang", "words", "left", F.col("n").alias("n_prefix"))
    last = lower.select(F.col("key").alias("suffix"), F.element_at("words", -1).alias("last"), "right", F.col("n").alias("n_suffix"))
    return counted.join(first, "prefix").join(last, "suffix").select(
        "key", "n", "lang", "prefix", "suffix",
        F.concat("words", F.array("last")).alias("words"),
        F.concat("left", F.array("n_prefix")).alias("left"),
        F.concat("right", F.array("n_suffix")).alias("right"),
    )


# left: counts of the first 1, 2, ... words; right: of the last 1, 2, ... Of equal scores the smallest cut is the least struct.
SCORED = f"""array_min(transform(sequence(1, size(left)), k -> struct(
    CAST(n AS DECIMAL(38, 0)) * {SCALE} div (left[k - 1] + right[size(left) - k]) AS score, k, left[k - 1] AS l, right[size(left) - k] AS r)))"""
BOUND = f"CAST(n AS DECIMAL(38, 0)) * {SCALE} div (left[0] + n)"


def scored(phrases: DataFrame) -> DataFrame:
    """With ``cut`` (score, k, l, r) and ``bound``, above which nothing grown from the phrase can score."""
    return phrases.withColumns({"cut": F.expr(SCORED), "bound": F.expr(BOUND)})


def thresholds(pairs: DataFrame, langs: DataFrame, most: int) -> DataFrame:
    """(lang, least): the highest step that at least ``most`` pairs reach, else zero. One row for each language and step is ordered."""
    steps = pairs.groupBy("lang", F.expr(f"cut.score div {STEP_OF_SCORES}").alias("step")).agg(F.count("*").alias("n"))
    reached = steps.withColumn("reached", F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("step"))))
    found = reached.where(F.col("reached") >= most).groupBy("lang").agg((F.max("step") * STEP_OF_SCORES).alias("least"))
    return langs.join(found, "lang", "left").select("lang", F.coalesce("least", F.lit(0)).alias("least"))


def mine_phrases(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP, first: int = FIRST, size: int = CHUNK) -> DataFrame:
    """The best phrases of every language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into words at spaces and
    tabs. A phrase has two to four words of one piece and occurs at least ``least`` times in texts of its language (a). Its
    score is floor(2,000,000 a / (l + r)) at the cut into parts that occur l and r times where it is lowest; of equal
    ones the first cut. A phrase is left out if a longer one that holds it has at least ``share`` percent of its count.
    rank: by score, count, then phrase in byte order, up to ``top``. n: words of the language.

    A null text is empty and a null lang counts as ``und``; repeated rows count one by one; texts without words and an empty table
    give nothing. Other columns are left out. Phrases are told apart by 64-bit hashes.
    """
    cut, _ = stored(chunks(docs, size), "phrase-chunks")
    each = cut.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("lang", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    none = F.array().cast("array<bigint>")
    frequent = each.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    words, _ = stored(frequent.withColumn("key", F.xxhash64("lang", "word")), "phrase-words")
    sets = {"words": bitmap(words)}
    frequent_pairs, _ = stored(count_grams(cut, 2, sets, parts=False).where(F.col("n") >= least), "phrase-pair-counts")
    sets["pairs"] = bitmap(frequent_pairs)
    named = count_grams(cut, 2, sets, parts=True).select("key", "prefix", "suffix").join(frequent_pairs, "key")
    singles = words.withColumns({"words": F.array("key"), "left": none, "right": none})
    pairs, _ = stored(scored(joined_parts(named, singles)), "phrase-pairs")

    open_langs, _ = stored(pairs.select("lang").distinct(), "phrase-langs")
    settled = []
    while not open_langs.isEmpty():
        limits, _ = stored(thresholds(pairs, open_langs, first), "phrase-thresholds")
        alive = survivors(cut, pairs, limits, sets, least, share)
        counts = limits.join(alive.groupBy("lang").agg(F.count("*").alias("found")), "lang", "left")
        done, _ = stored(counts.where((F.col("least") == 0) | (F.col("found") >= top)).select("lang"), "phrase-langs")
        settled.append(alive.join(done, "lang"))
        open_langs, _ = stored(open_langs.join(done, "lang", "left_anti"), "phrase-langs")
        first *= MORE
    n = cut.select("lang", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked(settled or [scored(pairs)], words, n, top)


def survivors(cut: DataFrame, pairs: DataFrame, limits: DataFrame, sets: Mapping[str, np.ndarray], least: int, share: int) -> DataFrame:
    """All phrases of the limits' languages that score at least the limit and aren't replaced by a longer one."""
    lower, kept, spent = pairs.join(limits, "lang"), [], []
    for k in range(2, LONGEST + 1):
        lower, path = stored(lower, f"phrases-{k}")
        spent.append(path)
        able = lower.where(F.col("cut.score") >= F.col("least"))
        if k == LONGEST:
            kept.append(able)
            break
        grow = {"grow": bitmap(lower.where(F.col("bound") >= F.col("least"))), "left": bitmap(able)}
        raw, path = stored(count_grams(cut, k + 1, {**sets, **grow}, parts=True).where(F.col("n") >= least), f"phrase-counts-{k + 1}")
        spent.append(path)
        longest = raw.select(F.col("prefix").alias("key"), "n").union(raw.select("suffix", "n")).groupBy("key").agg(F.max("n").alias("longer"))
        # Above the limit both sides were extended, so the longer phrases are complete.
        replaced = F.col("longer").cast("decimal(38,0)") * 100 >= F.col("n").cast("decimal(38,0)") * share
        kept.append(able.join(longest, "key", "left").where(F.col("longer").isNull() | ~replaced).drop("longer"))
        if k > 2:
            # Last parts that were no prefix worth growing have to be counted for the cut after the first word.
            wanted = raw.join(lower.select(F.col("key").alias("prefix")), "prefix", "left_semi").select(F.col("suffix").alias("key")).distinct()
            wanted, path = stored(wanted.join(lower, "key", "left_anti"), "phrase-parts")
            spent.append(path)
            more = count_grams(cut, k, {**sets, "only": bitmap(wanted)}, parts=True).join(wanted, "key", "left_semi")
            lower = lower.unionByName(scored(joined_parts(more, shorter)).join(limits, "lang"))
        shorter, lower = lower, scored(joined_parts(raw, lower)).join(limits, "lang")
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    out, _ = stored(out.select("lang", "words", "n", "cut"), "phrases")
    for path in spent:
        discard(cut.sparkSession, path)
    return out


def ranked(settled: list[DataFrame], words: DataFrame, n: DataFrame, top: int) -> DataFrame:
    """The first phrases of each language, with their words."""
    out = settled[0].select("lang", "words", "n", "cut")
    for more in settled[1:]:
        out = out.unionByName(more.select("lang", "words", "n", "cut"))
    out = out.select("lang", F.col("n").alias("a"), "cut.l", "cut.r", "cut.score", *(F.get("words", F.lit(i)).alias(f"w{i}") for i in range(LONGEST)))
    for i in range(LONGEST):
        # Words are only a name here: those of few phrases.
        out = out.join(words.select(F.col("key").alias(f"w{i}"), F.col("word").cast("string").alias(f"word{i}")), f"w{i}", "left")
    out = out.withColumn("phrase", F.concat_ws(" ", *(f"word{i}" for i in range(LONGEST))))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
