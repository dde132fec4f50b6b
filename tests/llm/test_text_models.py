"""Language-model scores and role recovery by hand; the quality classifier on held-out labels."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import backoff_lm, chat, quality
from shelfcast.llm.queries import all_queries
from shelfcast.llm.text import remainder

DATA = "/root/testdata/sf0.001"
TEXTS = "doc_id long, text string"


# Language model


def scores_by_hand(rows, order):
    words = lambda x: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or "")), "</s>"]
    texts = [(i, words(x)) for i, x in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in texts]
    counts = [Counter() for _ in range(order + 1)]
    for (_, tokens), out in zip(texts, held):
        if not out:
            line = ["<s>", *tokens]
            counts[0]["<s>",] += 1
            for j in range(1, len(line)):
                for k in range(1, order + 1):
                    if j >= max(1, k - 1):
                        counts[k][tuple(line[j - k + 1 : j + 1])] += 1
    n, v = sum(counts[1].values()), len(counts[1])
    room = n + 0.5 * (v + 1)
    shares = [0, 0] + [min(max(sum(x == 1 for x in c.values()) / max(1, sum(c.values())), 1e-6), 1 - 1e-6) for c in counts[2:]]
    found = []
    for (i, tokens), out in zip(texts, held):
        line, base, score = ["<s>", *tokens], 0.0, 0.0
        for j in range(1, len(line)):
            p = (counts[1][line[j],] + 0.5) / room
            base += math.log10(p)
            for k in range(2, order + 1):
                if j >= k - 1:
                    context = tuple(line[j - k + 1 : j])
                    times = counts[0][context] if context == ("<s>",) else counts[k - 1][context]
                    if times:
                        p = shares[k] * p + (1 - shares[k]) * counts[k][tuple(line[j - k + 1 : j + 1])] / times
            score += math.log10(p)
        found.append((i, out, len(tokens), sum(counts[1][w,] > 0 for w in tokens), n, round(base, 6), round(score, 6)))
    return found


@pytest.mark.parametrize("order,lane", [(1, 64), (2, 64), (3, 7), (4, 2048)])
def test_scores(spark, documents, monkeypatch, order, lane):
    monkeypatch.setattr(backoff_lm, "LANE", lane)
    rows = [tuple(r) for r in documents.select("doc_id", "text").limit(60).collect()]
    got = [tuple(r)[:5] + (round(r.base_score, 6), round(r.score, 6)) for r in backoff_lm.score_texts(spark.createDataFrame(rows, TEXTS), order).collect()]
    assert len(got) == len(rows)
    for a, b in zip(sorted(got), sorted(scores_by_hand(rows, order))):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=2e-6)


def test_scores_of_awkward_rows(spark, awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got = sorted((tuple(r) for r in backoff_lm.score_texts(awkward).collect()), key=key)
    for a, b in zip(got, sorted(scores_by_hand(rows, 2), key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-5, rel=1e-9)
    assert backoff_lm.score_texts(awkward.limit(0)).count() == 0


def test_probabilities_of_a_context_sum_to_one():
    """Over the vocabulary and one unknown word, after a seen and an unseen context."""
    train = [(0, "a b a c"), (0, "b a b")]
    texts = [f"{c} {w}" for c in ("a", "zz") for w in ("a", "b", "c", "unknown")] + ["a", "zz"]
    rows = train + [(5 + k, t) for k, t in enumerate(texts)]
    import pyarrow as pa

    grams = backoff_lm.Grams(pa.chunked_array([pa.array([t for _, t in rows])]), 2)
    trained = np.array([k < 2 for k in range(len(rows))])
    totals = grams.counts(trained)
    facts = np.array([[int(n.sum()), int((n > 0).sum()), int((n == 1).sum())] for n in totals])
    auto = backoff_lm.Automaton(grams, totals, facts)
    for start in (2, 6):
        chance = []
        for k in range(start, start + 4):
            at = grams.bounds[k] + 2
            state = auto.state(np.array([at - 1]))[0]
            arc = grams.at[2][at]
            chance.append(10 ** (auto.arcs[2][arc] if state == 1 and auto.seen[2][arc] else (auto.fails[2] if state == 1 else 0) + auto.arcs[1][grams.at[1][at]]))
        end = grams.bounds[10 + (start == 6)] + 2
        state, arc = auto.state(np.array([end - 1]))[0], grams.at[2][end]
        chance.append(10 ** (auto.arcs[2][arc] if state == 1 and auto.seen[2][arc] else (auto.fails[2] if state == 1 else 0) + auto.arcs[1][grams.at[1][end]]))
        assert sum(chance) == pytest.approx(1)


def test_scores_beat_the_base_on_held_out_texts(spark):
    r = all_queries()["op3_backoff_scores"](spark, DATA).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


# Quality


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    r = all_queries()["op5_quality_scores"](spark, folder).where("held_out").join(labels, "doc_id").toPandas()
    good, bad = r.score[r.quality == 1].to_numpy(), r.score[r.quality == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert (good >= 0.3).mean() > 0.95 and set(r.predicted) == {0, 1}


def test_quality_of_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(1, 1), (1, 1), (6, 1), (7, 0), (8, 0), (8, 1), (2, None), (None, 1), (99, 0)], "doc_id long, label int")
    model = quality.fit(awkward, labels)
    got = quality.score(awkward, model)
    assert got.columns == awkward.columns and got.count() == awkward.count()
    rows = got.collect()
    assert all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4, 5)}) == 1
    kept = quality.keep_good(awkward, labels, 0.0)
    assert kept.columns == awkward.columns and kept.where("score = 'own'").count() == awkward.count()
    assert quality.score(awkward.limit(0), model).count() == 0
    untrained = quality.fit(awkward.limit(0), labels)
    assert {r.score for r in quality.score(awkward, untrained).collect()} == {0.5}


def test_word_scores_add_up_to_the_average(spark, awkward):
    """The scoring path against vectors that are averaged one by one."""
    import pyarrow as pa

    from shelfcast.llm.text import utf8

    random = np.random.default_rng(3)
    model = quality.Model(random.normal(size=(quality.BUCKETS, quality.WIDTH)), random.normal(size=(quality.WIDTH, 2)), random.normal(size=2))
    rows = awkward.select("doc_id", "text").distinct().collect()
    data, offsets = utf8(pa.array([r.text for r in rows], pa.string()))
    got = {(r.doc_id, r.text): r.score for r in quality.score(awkward.select("doc_id", "text"), model).collect()}
    for r, buckets in zip(rows, quality.features(data, offsets)):
        hidden = model.vectors[buckets].mean(axis=0) if len(buckets) else np.zeros(quality.WIDTH)
        odds = np.exp(hidden @ model.layer + model.bias)
        assert got[r.doc_id, r.text] == pytest.approx(odds[1] / odds.sum())


def test_training_is_the_same_however_rows_are_dealt(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    one, two = quality.fit(docs, labels), quality.fit(docs.repartition(5), labels)
    assert np.array_equal(one.vectors, two.vectors)
    assert quality.fit(docs, labels, sample=3).bias is not None


# Chat


def model_of_three():
    random = np.random.default_rng(1)
    return chat.Model(random.integers(0, 50, (3, chat.FORMS)), np.array([2, 5, 1]), random.integers(1, 20, (3, 3)))


def test_viterbi_against_all_paths():
    model = model_of_three()
    rows = [(0, None, "be brief"), (1, "user", "User: what now?\nand then"), (2, None, "Assistant: this")]
    block = chat.Block(rows, model)

    def weight(path):
        total = model.start[path[0]] + block.emitted[0][path[0]]
        return total + sum(model.moves[a, b] + block.emitted[k + 1][b] for k, (a, b) in enumerate(zip(path, path[1:])))

    best = max(itertools.product(range(chat.STATES), repeat=len(block.lines)), key=weight)
    assert weight(block.path(None, None)) == pytest.approx(weight(best))


def test_blocks_give_the_path_of_the_whole():
    model = model_of_three()
    rows = [(k, [None, "user", "assistant"][k % 3], f"{'bot: ' * (k % 4 == 0)}line {k}?\nmore") for k in range(12)]
    whole = chat.Block(rows, model)
    parts = [chat.Block(rows[k : k + 3], model) for k in range(0, 12, 3)]
    found = chat.chained([(k, b.summary(), b.opening()) for k, b in enumerate(parts)])
    assert [s for b, (_, entry, last) in zip(parts, found) for s in b.path(entry, last)] == whole.path(None, None)


def test_markers_and_rendering(spark):
    text = "System: be kind\nUser: hello there\nhow are you?\n**Assistant:** fine\nthanks  "
    rows = chat.format_turns(spark.createDataFrame([(1, 0, None, text)], "conv_id long, turn long, role string, text string")).orderBy("part").collect()
    assert [r.rendered for r in rows] == ["<|im_start|>system\nbe kind<|im_end|>\n", "<|im_start|>user\nhello there\nhow are you?<|im_end|>\n", "<|im_start|>assistant\nfine\nthanks<|im_end|>\n"]


def test_lost_labels_are_recovered(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    lost = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(6))
    told = F.when(lost == 1, F.concat(F.initcap("role"), F.lit(": "), F.col("text"))).otherwise(F.col("text"))
    blurred = df.select("conv_id", "turn", F.when(lost >= 2, F.col("role")).alias("role"), told.alias("text"))
    got = chat.format_turns(blurred).where("part = 0 AND given_role IS NULL").select("conv_id", "turn", F.col("role").alias("found"))
    r = got.join(df, ["conv_id", "turn"]).select(F.avg((F.col("found") == F.col("role")).cast("int"))).first()[0]
    assert r > 0.9
    whole = chat.format_turns(df)
    assert whole.count() == df.count() and whole.where("role <> given_role").count() == 0


def test_awkward_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 0, "assistant", "hi"), (1, None, None, None), (1, 1, "nobody", ""), (None, 0, "GPT ", "x\ny"), (None, None, None, "z"), (2, 600, "user", "a\n" * 3000), (2, 5, None, "Human: b")]
    df = spark.createDataFrame([(*r, "own", 1) for r in rows], "conv_id long, turn long, role string, text string, grp string, block int")
    got = chat.format_turns(df).collect()
    pieces = {(r.conv_id, r.turn, r.given_role) for r in got}
    assert pieces == {(a, b, c) for a, b, c, _ in rows}
    # The user who says the same twice is rendered twice.
    assert sorted(r.role for r in got if r.conv_id == 1 and r.turn == 0) == ["assistant", "user", "user"]
    assert {r.role for r in got if r.given_role == "GPT "} == {"assistant"} and sum(r.n_lines for r in got if r.conv_id == 2) == 3002
    assert all(re.fullmatch(r"(?s)<\|im_start\|>(system|user|assistant)\n.*<\|im_end\|>\n", r.rendered) for r in got)
    assert chat.format_turns(df.limit(0)).count() == 0


def test_blocks_are_bounded_where_turns_are_not_distinct(spark):
    """Rows without conv_id or turn, and turns that repeat: blocks by position, and the same turns as from one block."""
    rows = [(None, k % 8, ["user", "assistant", None][k % 3], f"{'bot: ' * (k % 5 == 0)}line {k}?") for k in range(90)]
    rows += [(1, None, ["user", "assistant"][k % 2], f"text {k}") for k in range(40)] + [(1, 3, None, f"text {k}\nmore") for k in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.placed(df, 16).collect()
    assert len(found) == len(rows) and max(Counter((r.conv_id, r.block) for r in found).values()) <= 16
    key = lambda r: (r.conv_id is not None, r.conv_id or 0, r.turn is not None, r.turn or 0, r.text, r.role or "")
    assert [r.text for r in sorted(found, key=lambda r: r.place)] == [r.text for r in sorted(found, key=key)]
    model = model_of_three()
    one, many = (sorted(map(str, chat.format_turns(df, block, model).collect())) for block in (1 << 30, 16))
    assert one == many and len(one) >= len(rows)


def test_followers_are_counted_across_blocks(spark):
    """However rows are cut, and where turns are sparse or shared."""
    random = np.random.default_rng(6)
    rows = [(conv, turn, str(random.choice(["user", "assistant", "system"])), f"{turn} {k:03}") for conv in (None, 1, 2) for k, turn in enumerate([*range(0, 9000, 600), *[9000] * 20, *range(9001, 9010)])]
    follows, start = np.zeros((3, 3)), np.zeros(3)
    role = lambda r: chat.ROLES.index(r[2])
    for a, b in zip(rows, rows[1:]):
        if a[0] == b[0]:
            follows[role(a), role(b)] += 1
    for conv in (None, 1, 2):
        start[role(next(r for r in rows if r[0] == conv))] += 1
    expected = chat.Model(np.zeros((3, chat.FORMS)), start, follows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for block in (1, 7, 512):
        model = chat.learn(chat.placed(df, block))
        assert np.allclose(model.moves, expected.moves) and np.allclose(model.start[:3], expected.start[:3])


def test_scores_of_many_words_are_those_of_each():
    import random

    import xxhash

    from shelfcast.llm.text import spread

    random.seed(4)
    items = list({"".join(random.choices("abcdeéß日👍-", k=random.randrange(1, 25))).encode() for _ in range(2000)})
    scores = np.random.default_rng(1).normal(size=quality.BUCKETS)
    total, count = quality.word_scores(items, scores)
    lists = [quality.word_buckets(w) for w in items]
    assert count.tolist() == [len(x) for x in lists]
    assert total == pytest.approx([scores[x].sum() for x in lists], abs=1e-9)
    broken = [b"\xff\xfe", b"a\x80b"]
    assert quality.word_scores(broken, scores)[0] == pytest.approx([scores[quality.word_buckets(w)].sum() for w in broken])
    assert quality.word_scores([], scores)[0].tolist() == []
    data = np.frombuffer(bytes(range(1, 120)), np.uint8)
    for length in range(1, 32):
        starts = np.arange(0, 80, 7)
        assert quality.hashes_of_runs(data, starts, length).tolist() == [xxhash.xxh64_intdigest(data[s : s + length].tobytes()) for s in starts]
    assert spread(np.array([3]), np.array([2])).tolist() == [3, 4]
