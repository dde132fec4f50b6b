"""BPE round trips and token files against the tokenizers library; Huffman codes by round trip."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shelfcast.llm import bpe, token_files
from shelfcast.llm.huffman import Codebook, code_lengths
from shelfcast.llm.pretokens import kinds
from shelfcast.llm.tables import stored
from shelfcast.llm.text import utf8
from shelfcast.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    return bpe.Vocabulary(open(PATH, encoding="utf-8").read())


def ids_of(coder, texts):
    ids, bounds = coder.encode(*utf8(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])], coder.decode(ids, bounds)


def test_random_texts(coder, library):
    random.seed(1)
    signs = [*"ab cdst'rvelm  \n\t\r!?.12 é²½中👍‍　́", "'s", "'re", "'ll", "<|endoftext|>", "<|endof", "  ", "http"]
    texts = ["".join(random.choices(signs, k=random.randint(0, 30))) for _ in range(5000)]
    got, decoded = ids_of(coder, texts)
    assert got == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert decoded == [library.decode(x, skip_special_tokens=False) for x in got]


def test_long_pieces(coder, library):
    texts = ["a" * 3000, "abab" * 700, "!" * 999, "\n" * 500 + "x", " " * 333, "ß" * 400]
    assert ids_of(coder, texts)[0] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_kinds_are_those_of_the_library(library):
    pre, table = library.pre_tokenizer, kinds()
    for c in [*range(0x3100), *range(0xA640, 0xAC10), *range(0x10400, 0x11000, 3), *range(0x1E400, 0x1E700)]:
        one = [len(pre.pre_tokenize_str(like + chr(c))) == 1 for like in "a1!"]
        assert table[c] == ([1, 2, 3][one.index(True)] if any(one) else 0), hex(c)


def test_whole_table(spark, documents, library):
    got = {r.doc_id: r for r in bpe.round_trip_digests(documents, PATH).collect()}
    for row in documents.collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        expected = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert tuple(got[row.doc_id])[1:] == expected


def test_awkward_rows(spark, awkward, library):
    got = bpe.round_trips(awkward, PATH).collect()
    expected = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids, r.text or "") for r in awkward.collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in got), key=key) == sorted(expected, key=key)
    assert bpe.round_trips(awkward.limit(0), PATH).count() == 0


@pytest.mark.parametrize("segment", [50, 1 << 20])
def test_files_round_trip(spark, awkward, library, segment):
    path = scratch_path(spark, "files")
    token_files.write_token_files(awkward, PATH, path, segment=segment)
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    texts = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in awkward.collect()]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert [r.doc_id for r in got] == sorted((x for x, _ in texts), key=lambda x: (x is not None, x or 0))
    read = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got]
    key = lambda x: (x[0] is not None, x[0] or 0, len(x[1]), x[1])
    assert sorted(read, key=key) == sorted(texts, key=key)
    assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.n_tokens == len(r.ids) // 4 for r in got)


def test_files_of_an_empty_table(spark, awkward):
    path = scratch_path(spark, "files")
    token_files.write_token_files(awkward.limit(0), PATH, path)
    assert token_files.read_token_files(spark, path).count() == 0


def test_vocabularies_of_many_ids_take_four_bytes():
    assert token_files._kind(1 << 16) == "<u2" and token_files._kind((1 << 16) + 1) == "<u4"
    assert token_files._ids(np.array([70000, 1], "<u4").tobytes(), 2).tolist() == [70000, 1]


@pytest.mark.parametrize("n,longest", [(1, 16), (2, 16), (3, 2), (200, 8), (5000, 16), (300, 4)])
def test_huffman_codes(n, longest):
    random_ = np.random.default_rng(n)
    counts = np.concatenate([[0], np.ceil(1e6 / np.arange(1, n + 1) ** 3).astype(np.int64)])
    lengths = code_lengths(counts, longest)
    limit = max(longest, (n - 1).bit_length())
    assert lengths[0] == 0 and lengths.max() <= limit and (lengths[1:] > 0).all()
    assert sum(2.0 ** -int(x) for x in lengths if x) <= 1
    book = Codebook(lengths)
    for size in (0, 1, 255, 256, 257, 3000):
        ids = random_.integers(1, n + 1, size)
        bits, checkpoints = book.pack(ids)
        assert book.unpack(bits, checkpoints, size).tolist() == ids.tolist()


def test_code_lengths_are_optimal():
    """Against Huffman's own construction, where the limit doesn't bind."""
    import heapq

    counts = np.random.default_rng(3).integers(1, 1000, 60)
    heap, cost = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert int((code_lengths(counts, 32).astype(int) * counts).sum()) == cost


def test_a_block_decodes_by_its_checkpoint():
    counts = np.array([50, 30, 10, 5, 1])
    book, ids = Codebook(code_lengths(counts)), np.random.default_rng(5).integers(0, 5, 1000)
    bits, checkpoints = book.pack(ids)
    assert book.unpack(bits, checkpoints[2:3], 256).tolist() == ids[512:768].tolist()


def test_stored_tables_lie_in_the_shared_folder(spark):
    _, path = stored(spark.range(3), "ids")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))
