import random

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from shelfcast.llm.piece_ids import LibraryPieces, Memory, closed

PATH = public_tokenizers.path("byte_bpe_50k.json")


def lists(found):
    ids, counts = found
    ends = counts.cumsum()
    return [ids[e - n : e].tolist() for e, n in zip(ends, counts)]


def test_joined_pieces_have_their_own_ids():
    tokenizer = Tokenizer.from_file(PATH)
    items = [b" the", b"the", b" ", b"  ", b" \n", " caf\u00e9".encode(), " \u00a0".encode(), " \u3000".encode(), b" 123", b" ...", b" '", b"'s", " \u65e5\u672c".encode(), b"<|endoftext|>"]
    random.seed(2)
    items += list({(" " + "".join(random.choices("abcxyz\u00e9\u00df", k=random.randrange(1, 12)))).encode() for _ in range(500)})
    assert 400 < sum(map(closed, items)) < len(items)
    assert not any(map(closed, [b" ", b"  ", b" \n", " \u00a0".encode(), " \u3000".encode(), b"the", b""]))
    found = lists(LibraryPieces(tokenizer, closed)(items))
    assert found == [tokenizer.encode(x.decode(), add_special_tokens=False).ids for x in items]
    assert lists(LibraryPieces(tokenizer, closed)([])) == []


def test_memory_turns_over_and_forgets():
    asked = []

    def encode(items):
        import numpy as np

        asked.extend(items)
        return np.array([b for x in items for b in x], np.uint32), np.array([len(x) for x in items], np.int64)

    memory = Memory(encode, limit=3)
    batches = [[b"a", b"bb", b"ccc", b"dddd"], [b"a", b"x" * 70], [b"bb", b"ee", b"f", b"g", b""], [b"a", b"ee", b"ccc"], [b"h"], [b"a", b"x" * 70]]
    for batch in batches:
        assert lists(memory(pa.array(batch, pa.large_binary()))) == [list(x) for x in batch]
    # What was met in the turn before is known; what was not is asked again; long pieces are never kept.
    assert asked.count(b"a") == 1 and asked.count(b"ee") == 1 and asked.count(b"ccc") == 2 and asked.count(b"x" * 70) == 2
    assert len(memory.young.items) + len(memory.old.items) <= 10
