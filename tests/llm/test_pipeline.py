"""Benchmark items against brute force; the pipeline's stages and what they do together."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from shelfcast.llm import bpe, decontamination, line_dedup, simhash_dedup
from shelfcast.llm.queries import all_queries, all_sql

DATA = "/root/testdata/sf0.001"
TEXTS = "doc_id long, text string"


def shingles(words, width=5):
    return [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]


def leaks_by_hand(docs, items, least=0.8):
    """The best similarity of a window that holds a shingle at its place, by document and item."""
    out = {}
    for i, text in docs:
        words = (text or "").lower().split()
        for item, other in items:
            theirs = (other or "").lower().split()
            if min(len(words), len(theirs)) < 5:
                continue
            own, known = shingles(words), shingles(theirs)
            starts = {max(0, min(a - b, len(words) - len(theirs))) for a, x in enumerate(own) for b, y in enumerate(known) if x == y}
            for start in starts:
                window = Counter(own[start : start + len(known)])
                common = sum((window & Counter(known)).values())
                similarity = common / (sum(window.values()) + len(known) - common)
                if similarity >= least:
                    out[i, item] = max(out.get((i, item), 0), similarity)
    return out


def planted(spark):
    random.seed(9)
    word = lambda: f"w{random.randint(0, 3000)}"
    items = [(k, " ".join(word() for _ in range(random.choice([20, 60, 80])))) for k in range(20)] + [(20, "too few words"), (21, None)]
    docs = []
    for i in range(120):
        words = [word() for _ in range(random.randint(0, 150))]
        if i % 3 == 0:
            passage = random.choice(items[:20])[1].split()
            for _ in range(random.choice([0, 0, 1, 2, 9])):
                passage[random.randrange(len(passage))] = random.choice(["changed", "other words"])
            at = random.randint(0, len(words))
            words[at:at] = passage
        docs.append((i, " ".join(words)))
    return docs, items


def test_leaks_by_hand(spark):
    docs, items = planted(spark)
    got = decontamination.find_leaks(spark.createDataFrame(docs, TEXTS), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r.doc_id, r.item_id): r.similarity for r in got.collect()}
    expected = leaks_by_hand(docs, items)
    assert len(expected) > 20 and any(s < 1 for s in expected.values())
    assert found == pytest.approx(expected)


def test_leaks_of_the_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    found = all_queries()["op2_benchmark_leaks"](spark, DATA).collect()
    assert {(r.doc_id, r.item_id): r.similarity for r in found} == pytest.approx(leaks_by_hand(docs, items))


def test_larger_shingle_sets_take_the_other_join(spark, monkeypatch):
    docs, items = planted(spark)
    monkeypatch.setattr(decontamination, "SENT_SHINGLES", 0)
    got = decontamination.find_leaks(spark.createDataFrame(docs, TEXTS), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == set(leaks_by_hand(docs, items))


def test_multi_index_blocks_find_all_within_the_radius(spark):
    """All pairs of a window and an item of one size within the radius, and no others, for several cuts; few pairs meet beyond it."""
    random_ = np.random.default_rng(2)
    items = [(k, int(random_.integers(0, 1 << 62)), 10 + k % 2) for k in range(40)]
    windows = []
    for k, (_, print_, size) in enumerate(items):
        for bits in range(0, 30):
            apart = sum(1 << int(b) for b in random_.choice(62, bits, replace=False))
            windows.append((len(windows), print_ ^ apart, size if bits % 7 else 21 - size))
    left = spark.createDataFrame(windows, "window long, window_print long, size int")
    right = spark.createDataFrame(items, "item long, item_print long, size int")
    for radius, blocks in ((15, 4), (20, 8), (3, 4)):
        found = {tuple(r) for r in decontamination.within_radius(left, right, radius, blocks).collect()}
        every = {(w, i, (a ^ b).bit_count()) for w, a, n in windows for i, b, m in items if n == m}
        assert found == {x for x in every if x[2] <= radius} and len(found) > 40


def test_index_finds_what_every_start_would(spark):
    """Of the leaks that comparing every start by shingles gives, displaced ones included, at least nine in ten."""
    docs, items = planted(spark)
    expected = set(leaks_by_hand(docs, items))
    got = decontamination.find_leaks(spark.createDataFrame(docs, TEXTS), spark.createDataFrame(items, "item_id long, text string"))
    assert len({(r.doc_id, r.item_id) for r in got.collect()} & expected) >= 0.9 * len(expected)


def test_leaks_of_awkward_rows(spark, awkward):
    items = spark.createDataFrame([(1, "One two three. Four five six. Seven eight nine."), (1, "One two three. Four five six. Seven eight nine."), (2, None), (3, ""), (None, "it's 12 o'clock <|endoftext|> naïve 日本語")], "item_id long, text string")
    found = decontamination.find_leaks(awkward, items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (2, 1), (8, None)}
    clean = decontamination.without_leaks(awkward, items)
    assert clean.columns == awkward.columns
    assert sorted((r.doc_id or -1 for r in clean.collect())) == [-1, -1, -1, 2, 3, 4, 5, 6, 7]
    assert decontamination.without_leaks(awkward.limit(0), items).count() == 0
    assert decontamination.find_leaks(awkward, items.limit(0)).count() == 0


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "BPE encoding and decoding"]


def test_pipeline_is_its_stages(spark):
    """Each stage's result by hand from the one before."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    good = corpus_pipeline.good_documents(spark, docs, DATA)
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    good_rows = good.collect()
    assert {tuple(r) for r in good_rows} <= {tuple(r) for r in docs.collect()}
    from test_dedup import lines_by_hand, print_by_hand, roots_by_hand

    lines = lines_by_hand({(r.doc_id, r.text) for r in good_rows})
    texts = sorted((i, t) for (i, _), t in lines.items())
    got = corpus_pipeline.without_repeated_lines(spark, good, DATA)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == texts and got.columns == docs.columns
    prints = [print_by_hand(t) for _, t in texts]
    roots = roots_by_hand(len(texts), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    single = [texts[k] for k in sorted(set(roots))]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leaking = {i for i, _ in leaks_by_hand(single, items)}
    clean = sorted((i, t) for i, t in single if i not in leaking)
    final = corpus_pipeline.run(spark, DATA).collect()
    expected = bpe.round_trip_digests(spark.createDataFrame(clean, TEXTS), corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sorted(map(tuple, final)) == sorted(map(tuple, expected))


def test_stages_on_awkward_rows(spark, awkward):
    """All stages but the last keep the columns, whatever they are called."""
    docs = awkward.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.char_length("text").cast("long").alias("n_chars"), "grp", "text_hash")
    for table in (docs, docs.limit(0)):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, DATA)
            assert now.columns == docs.columns, name
            now.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, now, DATA).count() == now.count()


def test_changed_texts_have_their_own_length(spark, awkward):
    docs = awkward.select("doc_id", "text", F.char_length("text").cast("long").alias("n_chars"))
    out = corpus_pipeline.without_repeated_lines(spark, docs, DATA)
    assert out.where("n_chars <> char_length(text)").count() == 0 and out.where("text IS NULL AND n_chars IS NOT NULL").count() == 0


def test_registered():
    names = set(all_queries())
    assert {int(n.split("_")[0][2:]) for n in names} == set(range(1, 14)) and set(all_sql()) <= names


def test_native_operators_run_no_python(spark):
    docs, items = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    for df in (line_dedup.dedup_lines(docs), line_dedup.covered_lines(docs), decontamination.find_leaks(docs, items), decontamination.without_leaks(docs, items)):
        plan = df._jdf.queryExecution().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_near_dedup_takes_its_own_parameters():
    assert simhash_dedup.near_duplicates.__defaults__ == (3, 2)


def leaks_of_every_start(docs, items, least=0.8):
    """The best similarity of any window, by document and item."""
    out = {}
    for i, text in docs:
        own = shingles((text or "").lower().split())
        for item, other in items:
            known = shingles((other or "").lower().split())
            if not own or not known:
                continue
            for start in range(max(1, len(own) - len(known) + 1)):
                window = Counter(own[start : start + len(known)])
                common = sum((window & Counter(known)).values())
                similarity = common / (sum(window.values()) + len(known) - common)
                if similarity >= least:
                    out[i, item] = max(out.get((i, item), 0), similarity)
    return out


def test_leaks_with_displaced_parts(spark):
    """Halves of an item that changed places inside a longer document, or in one as long as or shorter than the item."""
    random.seed(21)
    word = lambda: f"w{random.randint(0, 9000)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([40, 50, 59, 100, 100, 60])]
    docs = [(100, " ".join(word() for _ in range(300)))]
    for k, text in items:
        words = text.split()
        for at in (len(words) // 2, len(words) // 3):
            swapped = words[at:] + words[:at]
            docs.append((len(docs), " ".join([word() for _ in range(100)] + swapped + [word() for _ in range(100)])))
            docs += [(len(docs), " ".join(swapped)), (len(docs) + 1, " ".join(swapped[3:])), (len(docs) + 2, " ".join(swapped[:20] * 4))]
    expected = leaks_of_every_start(docs, items)
    assert len(expected) > len(leaks_by_hand(docs, items))
    found = decontamination.find_leaks(spark.createDataFrame(docs, TEXTS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.similarity for r in found} == pytest.approx(expected)


def test_starts_are_those_with_enough_places(spark):
    random.seed(4)
    rows = []
    for _ in range(300):
        n, size = random.randint(5, 60), random.randint(5, 40)
        rows.append((n, size, sorted(random.sample(range(n - 4), random.randint(int(0.6 * (n - 4)), n - 4)))))
    got = spark.createDataFrame(rows, "n_words int, size int, at array<int>").select("*", decontamination._starts(5, 0.8).alias("starts")).collect()
    for r in got:
        own, theirs = min(r.n_words, r["size"]) - 4, r["size"] - 4
        reach = [s for s in range(max(0, r.n_words - r["size"]) + 1) if (c := sum(s <= p < s + own for p in r.at)) and 10 * c >= 8 * (own + theirs - c)]
        assert r.starts == reach
