"""Benchmark items inside documents: SimHash windows, multi-index Hamming blocks, exact similarity.

Windows are as long as the items. A window's similarity to an item is bounded by the number of its places that hold
a shingle of the items of its length, in whatever order, so every window with enough such places is built, and no
other can be a leak. Their SimHash is looked up among the items' fingerprints of the same length. Fingerprints are cut into blocks; if two differ in no more bits than
the radius, some block differs in no more than radius // blocks bits, and items are entered under all such
values of each block, so one equality join finds every item within the radius. What it finds is verified
by bit count and then by the similarity of the shingles with their counts.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.tables import stored
from shelfcast.llm.text import unused

BITS = 64
#: Shingles of the benchmark that may be sent to every executor, 16 bytes each; a larger set is joined by shuffle.
SENT_SHINGLES = 1 << 20


def _words(text: Column) -> Column:
    """Lower-cased runs without white space."""
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _shingled(df: DataFrame, key: list[str], width: int) -> DataFrame:
    """key, n_words and shingles: the hash of each run of `width` words; none in a text of fewer."""
    hashes = df.select(*key, F.transform(_words(F.col("text")), lambda w: F.xxhash64(w)).alias("words"))
    run = ", ".join(f"get(words, i + {k})" for k in range(width))
    runs = f"CASE WHEN size(words) >= {width} THEN transform(sequence(0, size(words) - {width}), i -> xxhash64({run})) ELSE array() END"
    return hashes.select(*key, F.size("words").alias("n_words"), F.expr(runs).alias("shingles"))


def _simhash(shingles: str) -> Column:
    """The bits set in over half of the hashes, as a long."""
    return F.expr(f"aggregate(sequence(0, {BITS - 1}), 0L, (sum, b) -> sum | CASE WHEN 2 * size(filter({shingles}, x -> getbit(x, b) = 1)) > size({shingles}) THEN shiftleft(1L, b) ELSE 0L END)")


def _block(column: str, size: int) -> Column:
    """The blocks of a fingerprint, each with its number."""
    return F.array(*(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(F.col(column), k * size).bitwiseAND(F.lit((1 << size) - 1)).cast("int").alias("bits")) for k in range(BITS // size)))


def _starts(width: int, similarity: float) -> Column:
    """All starts of windows with enough places in `at` to reach the similarity, from n_words, size and the ordered `at`.

    Of a and b shingles c can be common only if the window has c places, and c / (a + b - c) reaches s where c reaches
    s (a + b) / (1 + s). A window belongs to its first place, so none is listed twice.
    """
    own, theirs = f"(least(n_words, size) - {width - 1})", f"(size - {width - 1})"
    # The small number is for rounding: a window too many does no harm.
    enough = f"cast(greatest(1, ceil({similarity!r}D * ({own} + {theirs}) / {1 + similarity!r}D - 1e-6D)) AS int)"
    low = f"greatest(0, coalesce(get(at, i - 1), -1) + 1, get(at, i + {enough} - 1) - {own} + 1)"
    high = "least(get(at, i), greatest(0, n_words - size))"
    runs = f"transform(sequence(0, size(at) - {enough}), i -> CASE WHEN {low} <= {high} THEN sequence({low}, {high}) ELSE array() END)"
    return F.expr(f"CASE WHEN size(at) >= {enough} THEN flatten({runs}) ELSE array() END")


def within_radius(windows: DataFrame, items: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(window, item, distance): all pairs of one size whose fingerprints differ in at most `radius` bits.

    windows: window, size, window_print. items: item, size, item_print. If two differ in no more bits than the radius, one of the
    blocks differs in no more than radius // blocks; items are entered under all such values of each block.
    """
    size = BITS // blocks
    flips = [sum(1 << b for b in chosen) for n in range(radius // blocks + 1) for chosen in combinations(range(size), n)]
    entered = items.select("item", "item_print", "size", F.explode(_block("item_print", size)).alias("p")).withColumn("flip", F.explode(F.array(*map(F.lit, flips))))
    probes = entered.select("item", "item_print", "size", "p.block", F.col("p.bits").bitwiseXOR(F.col("flip")).alias("bits"))
    looked = windows.select("window", "window_print", "size", F.explode(_block("window_print", size)).alias("p")).select("window", "window_print", "size", "p.block", "p.bits")
    distance = F.bit_count(F.col("window_print").bitwiseXOR(F.col("item_print")))
    # Entries are far more than the items they come from, by whose size Spark would judge them: no broadcast.
    met = looked.join(probes.hint("merge"), ["size", "block", "bits"]).withColumn("distance", distance)
    return met.where(F.col("distance") <= radius).select("window", "item", "distance").distinct()


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 15, blocks: int = 4) -> DataFrame:
    """(doc_id, text_hash, item_id, start, n_words, distance, similarity): the best window for each text and item it holds.

    docs: doc_id, text. benchmark: item_id, text. Similarity is the sum of the smaller counts over the sum of
    the larger counts of all shingles of `width` lower-cased words, and must reach `similarity`; the
    SimHash distance must not exceed `radius`. Ties go to the smaller distance, then to the earlier window. A
    document shorter than the item is one window. Null and empty texts, and items and documents of fewer
    words than a shingle, match nothing; neither does anything in an empty table. A text is searched whole, whatever its length. Repeated rows
    give equal rows once (doc_id and text_hash tell texts apart); other columns are left out.

    The radius: of windows at the least similarity, about one in thirty lies further off than 15 bits, and fewer the more
    similar they are; four blocks of 16 bits enter 697 of 65,536 values each, so an unrelated pair meets in 4 of 100 cases.
    """
    items, _ = stored(
        _shingled(benchmark.select("item_id", "text").distinct(), ["item_id"], width)
        .where(F.size("shingles") > 0)
        .withColumn("item_print", _simhash("shingles"))
        .withColumn("item", F.monotonically_increasing_id()),
        "items",
    )
    held_by = items.select(F.col("n_words").alias("size"), F.explode("shingles").alias("shingle")).distinct()
    known = held_by.select("shingle").distinct()
    if known.count() <= SENT_SHINGLES:
        known = F.broadcast(known)
    key = ["doc_id", "text_hash"]
    texts = docs.select("doc_id", "text", F.expr("xxhash64(coalesce(text, ''))").alias("text_hash"))
    shingled = _shingled(texts, key, width)
    # The outer form: the other one puts a filter below, which computes all shingles a second time.
    hits = shingled.select(*key, "n_words", F.posexplode_outer("shingles").alias("at", "shingle")).join(known, "shingle", "left_semi")
    hits = hits.select(*key, "n_words", "at", "shingle").join(held_by, "shingle")
    # Places of a text, so bounded by it; repeated rows give them once.
    hits = hits.groupBy(*key, "n_words", "size").agg(F.sort_array(F.collect_set("at")).alias("at"))
    windows, _ = stored(hits.select(*key, F.explode(_starts(width, similarity)).alias("start"), "size"), "windows")
    # Only texts with a window are cut into words again.
    held = windows.groupBy(*key).agg(F.collect_set(F.struct("start", "size")).alias("windows"))
    held = held.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "windows")
    # Joins with texts are the same at every size.
    again = texts.join(held.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select(*key, "text", "windows").dropDuplicates(key)
    cut = _shingled(again, [*key, "windows"], width).select(*key, "shingles", F.explode("windows").alias("w"))
    cut = cut.select(*key, F.col("w.start").alias("start"), F.col("w.size").alias("size"), F.slice("shingles", F.col("w.start") + 1, F.col("w.size") - (width - 1)).alias("shingles"))
    printed, _ = stored(cut.withColumn("window_print", _simhash("shingles")).withColumn("window", F.monotonically_increasing_id()), "prints")
    near = within_radius(printed, items.select("item", "item_print", F.col("n_words").alias("size")), radius, blocks)
    near, _ = stored(near, "near")
    ours = printed.join(near.select("window").distinct(), "window", "left_semi").select("window", F.explode("shingles").alias("shingle")).groupBy("window", "shingle").agg(F.count("*").alias("n"))
    theirs = items.select("item", F.explode("shingles").alias("shingle")).groupBy("item", "shingle").agg(F.count("*").alias("m"))
    common = near.join(ours, "window").join(theirs, ["item", "shingle"]).groupBy("window", "item", "distance").agg(F.sum(F.least("n", "m")).alias("common"))
    sizes = printed.select("window", *key, "start", F.col("size").alias("n_words"), F.size("shingles").alias("of_window"))
    measured = common.join(sizes, "window").join(items.select("item", "item_id", F.size("shingles").alias("of_item")), "item")
    measured = measured.withColumn("similarity", F.col("common") / (F.col("of_window") + F.col("of_item") - F.col("common"))).where(F.col("similarity") >= similarity)
    best = F.max_by(F.struct("start", "n_words", "distance", "similarity"), F.struct("similarity", -F.col("distance"), -F.col("start")))
    return measured.groupBy(*key, "item_id").agg(best.alias("best")).select(*key, "item_id", "best.start", "best.n_words", "best.distance", "best.similarity")


def without_leaks(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of docs in which find_leaks finds nothing, with all their columns."""
    of_doc, of_text = unused(docs.columns, "of_doc", "of_text")
    found, _ = stored(find_leaks(docs, benchmark, **settings).select(F.col("doc_id").alias(of_doc), F.col("text_hash").alias(of_text)).distinct(), "leaks")
    same = F.col("doc_id").eqNullSafe(F.col(of_doc)) & (F.expr("xxhash64(coalesce(text, ''))") == F.col(of_text))
    return docs.join(found.hint("merge"), same, "left_anti")
