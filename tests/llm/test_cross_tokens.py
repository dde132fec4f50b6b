import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from shelfcast.llm import cross_tokens
from shelfcast.llm.bpe import byte_signs
from shelfcast.llm.queries import PIECES, VOCABULARY, op13_token_alignment

A, B = public_tokenizers.path(VOCABULARY), public_tokenizers.path(PIECES)


class Plain:
    """Both libraries on whole texts, and loops in place of matrices."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        self.names, self.signs = {i: t for t, i in self.a.get_vocab().items()}, byte_signs()

    def tokens(self, text):
        """(id, first byte, end) of both tokenizations, or None."""
        if not text:
            return None
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        contents = (
            [bytes(self.signs[c] for c in self.names[i]) for i in a],
            [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in b],
        )
        if any(b"".join(x) != (" " + text).encode() for x in contents):
            return None
        ends = [np.cumsum([len(x) for x in content]).tolist() for content in contents]
        return [[(i, e - len(x), e) for i, x, e in zip(ids, content, end)] for ids, content, end in zip((a, b), contents, ends)]

    def groups(self, tokens):
        a, b = tokens
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        return [[[i for i, _, e in side if low < e <= high] for side in (a, b)] for low, high in zip([0, *cuts], cuts)]

    def linked(self, tokens, kind):
        a, b = tokens
        cuts = np.array(sorted({e for _, _, e in a} & {e for _, _, e in b}))
        test = {
            "overlap": lambda x, y: x[1] < y[2] and y[1] < x[2],
            "end": lambda x, y: x[2] == y[2],
            "group": lambda x, y: np.searchsorted(cuts, x[2]) == np.searchsorted(cuts, y[2]),
        }[kind]
        return [(x[0], y[0]) for x in a for y in b if test(x, y)]

    def rows(self, texts, kind="end"):
        found = [self.tokens(t) for t in texts]
        links = [self.linked(t, kind) if t else [] for t in found]
        counts = Counter(x for own in links for x in own)
        top = {}
        for (_, y), n in counts.items():
            top[y] = max(top.get(y, 0), n)
        out = []
        for tokens, own in zip(found, links):
            if not tokens:
                out.append((0, 0, 0, 0, 0, 0, ""))
                continue
            groups = self.groups(tokens)
            digest = hashlib.sha256(";".join("|".join(",".join(map(str, side)) for side in g) for g in groups).encode()).hexdigest()
            out.append((len(tokens[0]), len(tokens[1]), len(groups), len(own), sum(counts[x] == top[x[1]] for x in own), sum(counts[x] for x in own), digest))
        return out


@pytest.fixture(scope="module")
def plain():
    return Plain()


ODD = ["", None, " ", "  ", "a", "a ", "a  ", "\n a", "a\n b", "x▁y", "<|endoftext|> a <s> </s>", "  b  c", "café d", "　 z", "日本 語 です",
       "ok \U0001f600 ok", "it's  we'll 12 345", "\t\t x", "a\u0085 b", "<0x41> q", "é é", "\x00 a\x01 b", "  a  b"]


def odd_texts():
    random.seed(3)
    parts = ["a", "b ", "  ", "é", "\n", "'s", "1", "日", " ", ".", " the"]
    return ODD + ["".join(random.choice(parts) for _ in range(random.randrange(1, 40))) for _ in range(120)]


@pytest.mark.parametrize("kind", cross_tokens.KINDS)
def test_equal_to_loops_over_whole_texts(spark, plain, kind):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_a string")
    # Chunks of a few texts, so that counts are joined between chunks.
    found = {r.doc_id: tuple(r)[1:] for r in cross_tokens.alignment_counts(docs, A, B, kind, size=200).collect()}
    assert [found[i] for i in range(len(texts))] == plain.rows(texts, kind)


def test_query_equals_loops(spark, plain, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: tuple(r)[1:] for r in op13_token_alignment(spark, tables).collect()}
    tokens = [plain.tokens(d.text) for d in docs]
    links = [[(a[0], b[0]) for a, b in _ends(t)] if t else [] for t in tokens]
    counts = Counter(x for own in links for x in own)
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    for d, t, own in zip(docs, tokens, links):
        sizes = (len(t[0]), len(t[1])) if t else (0, 0)
        assert found[d.doc_id][:6] == (*sizes, len(own), len(own), sum(counts[x] == top[x[1]] for x in own), sum(counts[x] for x in own))


def _ends(tokens):
    by_end = {x[2]: x for x in tokens[0]}
    return [(by_end[y[2]], y) for y in tokens[1] if y[2] in by_end]


def test_links_and_groups_of_texts(spark, plain):
    texts = [t for t in odd_texts() if plain.tokens(t)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in cross_tokens.aligned(docs, A, B).collect():
        a, b = plain.tokens(texts[row.doc_id])
        assert row.a_ids == [x[0] for x in a] and row.b_ids == [x[0] for x in b]
        assert [[g.a, g.b] for g in row.groups] == plain.groups((a, b))
        shared = [(i, j, min(x[2], y[2]) - max(x[1], y[1])) for i, x in enumerate(a) for j, y in enumerate(b)]
        assert [tuple(x) for x in row.links] == [x for x in shared if x[2] > 0]


def test_row_products_equal_dense_ones():
    random = np.random.default_rng(5)
    for _ in range(20):
        left, right = (random.random(shape) < 0.3 for shape in ((6, 8), (8, 5)))
        sparse = [cross_tokens.Csr(np.concatenate([[0], np.cumsum(m.sum(1))]), np.nonzero(m)[1]) for m in (left, right)]
        rows, columns, values = sparse[0].times(sparse[1])
        dense = np.zeros((6, 5), int)
        dense[rows, columns] = values
        assert (dense == left.astype(int) @ right.astype(int)).all()
        rows, columns, _ = sparse[0].times(cross_tokens.Csr.of_labels(np.arange(8)))
        assert set(zip(rows.tolist(), columns.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(left))))


def test_awkward_tables(spark):
    schema = "doc_id long, text string, chunk string, key string"
    assert cross_tokens.alignment_counts(spark.createDataFrame([], schema), A, B).collect() == []
    rows = [(None, None, "c", "k"), (None, "a b", "c", None), (1, "a b", None, None), (1, "a b", None, None), (2, "", None, None), (3, "word " * 100_000, None, None)]
    found = cross_tokens.alignment_counts(spark.createDataFrame(rows, schema), A, B).collect()
    assert sorted((r.doc_id or 0, r.n_links) for r in found) == [(0, 0), (0, 2), (1, 2), (1, 2), (2, 0), (3, 100_001)]
    only_empty = cross_tokens.alignment_counts(spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string"), A, B).collect()
    assert sorted(tuple(r) for r in only_empty) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
