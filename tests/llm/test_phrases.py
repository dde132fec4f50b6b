import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shelfcast.llm import phrases
from shelfcast.llm.queries import op11_phrases

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least=30, share=80, top=2000):
    """The contract, with counts of all phrases."""
    out = []
    counts = defaultdict(Counter)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                counts["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        replaced = set()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    if 100 * a >= share * f[p[i : i + k]]:
                        replaced.add(p[i : i + k])
        found = []
        for p, a in candidates.items():
            if p not in replaced:
                score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        n = sum(c for p, c in f.items() if len(p) == 1)
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out, key=lambda x: x[:2])


def rows_of(found):
    return sorted((tuple(r) for r in found.collect()), key=lambda x: x[:2])


def invented(seed, texts=300):
    """Few words, so that phrases repeat; passages that many texts share; pieces, tabs and odd signs."""
    random.seed(seed)
    words = ["the", "of", "a", "Über", "x1", "naïve", "日本", "zz", "qq", "in", "to", "\x00", "\x1f"]
    passages = [" ".join(random.choices(words + [f"r{k}{i}" for i in range(4)], k=random.randrange(3, 8))) for k in range(6)]
    out = []
    for i in range(texts):
        parts = [random.choice([*words, *passages, ".", ",", "\n", "\t", "  "]) for _ in range(random.randrange(0, 40))]
        out.append((i, random.choice([" ".join(parts), " ".join(parts).upper()]) if i % 50 else None, random.choice(["en", "en", "en", "de", None, ""])))
    return out


@pytest.mark.parametrize("seed, top, first, size", [(1, 2000, 8000, 1 << 24), (2, 5, 4, 2000), (3, 12, 1, 500), (4, 40, 20, 3000)])
def test_equal_to_counts_of_all_phrases(spark, seed, top, first, size):
    rows = invented(seed)
    docs = spark.createDataFrame(rows, SCHEMA)
    # Small tops and first rounds make several rounds with thresholds above zero.
    found = rows_of(phrases.mine_phrases(docs, least=5, top=top, first=first, size=size))
    assert found == brute([r[1:] for r in rows], least=5, top=top)
    assert len({r[0] for r in found}) == 4


def test_query_equals_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("text", "lang").collect()
    found = rows_of(op11_phrases(spark, tables))
    assert found == brute([tuple(d) for d in docs]) and len(found) > 30


def test_languages_end_in_rounds_of_their_own(spark):
    """Ten copies of a phrase score highest; the common words of the other language need lower thresholds."""
    rows = [(i, f"alpha{i % 3} beta{i % 3} . common thing", "en") for i in range(60)] + [(i, "only common words here", "de") for i in range(40)]
    rows += [(i, "common " * 5, "de") for i in range(50)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for first in (1, 2, 100):
        assert rows_of(phrases.mine_phrases(docs, least=10, top=2, first=first)) == brute([r[1:] for r in rows], least=10, top=2)


def test_bitmaps_hold_their_keys_and_few_others(spark):
    keys = spark.range(-3000, 3000).select(F.xxhash64("id").alias("key"))
    held = phrases.bitmap(keys)
    inside = np.array([r.key for r in keys.collect()], np.int64).view(np.uint64)
    others = np.random.default_rng(1).integers(0, 1 << 63, 20000, dtype=np.uint64)
    assert phrases.holds(held, inside).all() and phrases.holds(held, others).mean() < 0.1
    assert not phrases.holds(phrases.bitmap(keys.limit(0)), inside).any()


def test_hashes_are_those_of_sql(spark):
    row = spark.sql("SELECT xxhash64('de', CAST('über' AS BINARY)) AS a, xxhash64('', CAST('x' AS BINARY)) AS b").first()
    ours = [int(phrases.hashed(lang, [word.encode()]).view(np.int64)[0]) for lang, word in (("de", "über"), ("", "x"))]
    assert [row.a, row.b] == ours
    assert xxhash.xxh64_intdigest(b"x", 42) != ours[1]


def test_awkward_tables(spark):
    schema = SCHEMA + ", n long, score string, words string"
    assert phrases.mine_phrases(spark.createDataFrame([], schema)).collect() == []
    blank = [(1, None, None, 1, "s", "w"), (2, "", "en", 1, "s", "w"), (3, " .\t", "en", None, None, None)]
    assert phrases.mine_phrases(spark.createDataFrame(blank, schema)).collect() == []
    rows = [*blank, (None, "one two " * 40, None, 1, "s", "w"), (5, "one two", None, 1, None, None), (5, "one two", None, 1, None, None), (6, "w " * 200_000, "en", 1, None, None)]
    found = rows_of(phrases.mine_phrases(spark.createDataFrame(rows, schema)))
    assert found == brute([r[1:3] for r in rows])
