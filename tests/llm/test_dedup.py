"""Line, string and near-duplicate removal against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from compare import connect, differences

from shelfcast.llm import line_dedup, simhash_dedup, suffix_dedup
from shelfcast.llm.components import components
from shelfcast.llm.queries import all_queries, all_sql
from shelfcast.llm.suffix_sort import blind_trie, equal_windows, multikey, eights

TEXTS = "doc_id long, text string"


# Lines


def lines_by_hand(rows, width=3):
    """rows: distinct (doc_id, text). The remaining text of each."""
    order = lambda i: (i is not None, i or 0)
    first = {}
    for i, text in rows:
        lines = text.split("\n") if text else []
        for k in range(len(lines) - width + 1):
            window = tuple(lines[k : k + width])
            if any(x.strip(" ") for x in window):
                first[window] = min(first.get(window, (order(i), k)), (order(i), k))
    out = {}
    for i, text in rows:
        lines = text.split("\n") if text else []
        gone = set()
        for k in range(len(lines) - width + 1):
            window = tuple(lines[k : k + width])
            if window in first and first[window] != (order(i), k):
                gone.update(range(k, k + width))
        out[i, text] = "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else text
    return out


def test_lines_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert differences(all_queries()["op7_line_dedup"](spark, folder), connect(folder).execute(all_sql()["op7_line_dedup"])) is None


def test_lines_by_hand(spark):
    random.seed(5)
    rows = [(i, "\n".join(random.choices(["a", "b", "c", "", " "], k=random.randint(0, 9)))) for i in range(150)] + [(None, "a\nb\nc\na\nb\nc")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, TEXTS).withColumnRenamed("doc_id", "doc_id")).collect()
    expected = lines_by_hand(rows)
    assert sorted(((r.doc_id is not None, r.doc_id or 0, r.text) for r in got)) == sorted((i is not None, i or 0, t) for (i, _), t in expected.items())


def test_lines_of_awkward_rows(spark, awkward):
    got = line_dedup.dedup_lines(awkward, counts=False)
    assert got.columns == awkward.columns and got.count() == awkward.count()
    expected = lines_by_hand({(r.doc_id, r.text) for r in awkward.collect()})
    assert {(r.doc_id, r.text) for r in got.collect()} == {(i, t) for (i, _), t in expected.items()}
    assert got.where("doc_id = 2 AND text = ''").count() == 2
    assert line_dedup.dedup_lines(awkward.limit(0)).count() == 0


# Strings


def strings_by_hand(rows, length):
    """rows: distinct (doc_id, text)."""
    order = lambda i, t: (-(1 << 63) if i is None else i, _signed(t))
    first = {}
    for i, text in sorted(rows, key=lambda r: order(*r)):
        raw = (text or "").encode()
        for k in range(len(raw) - length + 1):
            first.setdefault(raw[k : k + length], (order(i, text), k))
    out = {}
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if first[raw[k : k + length]] < (order(i, text), k):
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out[i, text] = (len(raw), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1])), kept)
    return out


def _signed(text):
    return int(np.uint64(xxhash.xxh64_intdigest((text or "").encode(), 42)).astype(np.int64))


def same_strings(spark, rows, length, anchor):
    got = suffix_dedup.find_repeats(spark.createDataFrame(rows, TEXTS), length, anchor).collect()
    expected = strings_by_hand(set(rows), length)
    hashes = {(i, *v[:3], v[3]) for (i, _), v in expected.items()}
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == hashes
    for r in got:
        assert sum(s.end - s.begin for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans
    return got


def test_strings_of_small_alphabets(spark):
    random.seed(3)
    rows = []
    for i in range(120):
        text = "".join(random.choices("ab é", k=random.randint(0, 60)))
        if rows and random.random() < 0.6:
            other = random.choice(rows)[1]
            a = random.randint(0, len(other))
            text = text[:10] + other[a : a + random.randint(0, 60)] + text[10:]
        rows.append((i * 7 % 1000, text))
    rows += [(5000, "a" * 300), (5001, "b" + "a" * 200), (5002, None), (5003, ""), (5003, "ab" * 40), (5003, "ba" * 40), (None, "ab" * 40), (None, "ab" * 40)]
    assert sum(r.n_removed for r in same_strings(spark, rows, 20, 8)) > 1000


def test_strings_of_documents(spark, documents):
    same_strings(spark, [tuple(r) for r in documents.select("doc_id", "text").collect()], 100, 32)


def test_strings_of_awkward_rows(spark, awkward):
    same_strings(spark, [(r.doc_id, r.text) for r in awkward.collect() if r.doc_id != 6], 100, 32)
    assert suffix_dedup.find_repeats(awkward).count() == awkward.count()
    assert suffix_dedup.find_repeats(awkward.limit(0)).count() == 0


def test_string_digests(spark, awkward):
    plain = {(r.doc_id, r.n_bytes, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.find_repeats(awkward).collect()}
    assert {(r.doc_id, r.n_bytes, r.kept_sha256) for r in suffix_dedup.find_repeats(awkward, digests=True).collect()} == plain


def test_multikey_quicksort():
    random_ = np.random.default_rng(1)
    data = random_.integers(97, 99, 3000, dtype=np.uint8)
    places, buckets = random_.integers(0, 2900, 700), random_.integers(0, 5, 700)
    order, run = multikey(places, buckets, eights(data), 16)
    key = [(buckets[k], data[places[k] : places[k] + 16].tobytes()) for k in order]
    assert key == sorted(key)
    assert (np.diff(run) > 0).tolist() == [a != b for a, b in zip(key, key[1:])]


def test_blind_trie():
    random.seed(2)
    windows = [bytes(random.choices(b"ab", k=12)) for _ in range(300)]
    groups = blind_trie(windows)
    assert [windows[g[0]] for g in groups] == sorted(set(windows))
    assert sorted(k for g in groups for k in g) == list(range(300)) and all(len({windows[k] for k in g}) == 1 for g in groups)


def test_equal_windows_are_ordered():
    random_ = np.random.default_rng(4)
    data = np.tile(random_.integers(97, 100, 400, dtype=np.uint8), 3)
    places = random_.integers(0, 1100, 500)
    order, run = equal_windows(data, places, np.zeros(500, np.int64), 60)
    windows = [data[places[k] : places[k] + 60].tobytes() for k in order]
    assert windows == sorted(windows) and [int(x) for x in run] == [sorted(set(windows)).index(w) for w in windows]


# Near-duplicates


def print_by_hand(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def roots_by_hand(n, linked):
    top = list(range(n))

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return [find(a) for a in range(n)]


def near_copies(spark):
    """Texts of which some differ by a word or two."""
    random.seed(11)
    rows = []
    for i in range(60):
        words = [f"w{random.randint(0, 400)}" for _ in range(random.randint(150, 400))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(random.randint(0, 4)):
            words = list(words)
            words[random.randrange(len(words))] = "changed"
            rows.append((len(rows), " ".join(words)))
    random.shuffle(rows)
    return rows


def test_near_duplicates(spark):
    rows = sorted(near_copies(spark))
    prints = [print_by_hand(t) for _, t in rows]
    roots = roots_by_hand(len(rows), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert len(set(roots)) < len(rows)
    got = sorted(simhash_dedup.near_duplicates(spark.createDataFrame(rows, TEXTS)).collect())
    assert [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got] == [(i, p, rows[k][0]) for (i, _), p, k in zip(rows, prints, roots)]
    kept = simhash_dedup.one_of_each(spark.createDataFrame(rows, TEXTS))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({rows[k][0] for k in roots})


@pytest.mark.parametrize("bucket", [3, 40, 4096])
def test_links_of_large_buckets(spark, bucket):
    random.seed(7)
    centre = [random.getrandbits(64) for _ in range(6)]
    prints = list({c ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 4))) for c in centre for _ in range(80)})
    roots = roots_by_hand(len(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    found = components(simhash_dedup.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 2, bucket)).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.root, set()).add(r.node)
    expected = {}
    for x, k in zip(signed, roots):
        expected.setdefault(k, set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in expected.values() if len(g) > 1)


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1002, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000, 1002: 1000}
    assert components(links.limit(0)).count() == 0


def test_near_duplicates_of_awkward_rows(spark, awkward):
    got = simhash_dedup.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    rows = awkward.collect()
    assert sorted((r.doc_id or -1, r.fingerprint) for r in got) == sorted((r.doc_id or -1, f"{print_by_hand(r.text):016x}") for r in rows)
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {None, 3, 4, 5} and {r.component_id for r in zero} == {3}
    assert {r.component_id for r in got if r.doc_id in (1, 2) and r.fingerprint == f"{print_by_hand(rows[0].text):016x}"} == {1}
    kept = simhash_dedup.one_of_each(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 6, 7, 8]
    assert simhash_dedup.one_of_each(awkward.limit(0)).count() == 0


def test_text_hash_is_that_of_spark(spark, awkward):
    here = {(r.doc_id, r.text_hash) for r in simhash_dedup.fingerprints(awkward).collect()}
    assert here == {(r.doc_id, r.h) for r in awkward.selectExpr("doc_id", "xxhash64(coalesce(text, '')) AS h").collect()}


def test_one_of_each_component_where_ids_collide(spark):
    """One doc_id on unlinked texts, and texts without doc_id whose fingerprints are a bit or two apart."""
    random.seed(19)
    own = lambda: " ".join(f"w{random.randint(0, 4000)}" for _ in range(300))

    def close(text):
        while True:
            words = text.split()
            words[random.randrange(len(words))] = f"x{random.randint(0, 4000)}"
            if 1 <= (print_by_hand(" ".join(words)) ^ print_by_hand(text)).bit_count() <= 2:
                return " ".join(words)

    one, two, three, four = own(), own(), own(), own()
    rows = [(7, one), (7, two), (9, close(two)), (12, close(two)), (None, three), (None, close(three)), (None, three), (3, four), (None, close(four))]
    prints = [print_by_hand(t) for _, t in rows]
    roots = roots_by_hand(len(rows), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert len(set(roots)) == 4
    expected = {}
    for (i, t), k in zip(rows, roots):
        key = (i is None, i or 0, _signed(t))
        expected[k] = min(expected.get(k, (key, i, t)), (key, i, t))
    kept = simhash_dedup.one_of_each(spark.createDataFrame(rows, TEXTS)).collect()
    assert sorted((r.doc_id or -1, r.text) for r in kept) == sorted((i or -1, t) for _, i, t in expected.values())


def test_lines_of_texts_that_share_a_doc_id(spark):
    """One passage at the same place of different texts under one doc_id or none stays once; equal rows are one text."""
    for own in (None, 7):
        texts = [f"a\nb\nc\nend {k}" for k in range(5)]
        rows = [(own, t) for t in texts] + [(own, texts[0])]
        got = sorted((r.text, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, TEXTS)).collect())
        earliest = min(texts, key=_signed)
        assert got == sorted((t, 0) if t == earliest else (t.split("\n")[-1], 3) for _, t in rows)
