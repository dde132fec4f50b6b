"""Cut texts into the pieces inside which a byte-level BPE merges, for whole batches at once.

The pattern of byte-level tokenizers takes, at each place, the first of: a contraction; an optional
space with letters, numbers or other signs; white space that ends a text or stands before its own
last character; white space. Put as bounds between neighbouring characters, it needs no pattern
engine: a bound stands where the kind of character changes, except after a single space.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from tokenizers.pre_tokenizers import ByteLevel

from shelfcast.llm.text import binary_array

SPACE, LETTER, NUMBER, OTHER = range(4)

# What follows an apostrophe in a contraction.
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ("re", "ve", "ll")


@cache
def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in the vocabulary file: printable bytes for themselves, the others from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def kinds() -> np.ndarray:
    """The kind of each code point; of recent ones, as the tokenizers library has them."""
    every = np.arange(0x110000, dtype=np.uint32)
    every[0xD800:0xE000] = 0xE000
    text = every.tobytes().decode("utf-32-le")
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\s+", SPACE), (r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for found in regex.finditer(pattern, text):
            out[found.start() : found.end()] = kind
    library = ByteLevel(add_prefix_space=False)
    for kind, like in ((LETTER, "a"), (NUMBER, "1")):
        for c in np.flatnonzero(out == kind).tolist():
            if unicodedata.category(chr(c)) == "Cn" and len(library.pre_tokenize_str(like + chr(c))) > 1:
                out[c] = OTHER
    return out


def valid(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, offsets and code points, with bytes that aren't UTF-8 replaced by U+FFFD."""
    try:
        text = data.tobytes().decode("utf-8")
    except UnicodeDecodeError:
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
        text = "".join(texts)
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(x.encode("utf-8")) for x in texts])])
    return data, offsets, np.frombuffer(text.encode("utf-32-le"), np.uint32)


def pretokens(data: np.ndarray, offsets: np.ndarray, special: bytes = b"") -> tuple[pa.Array, np.ndarray]:
    """All pieces of the texts, end to end, and the number of pieces before each text.

    special: a string that is one piece wherever it stands, and on whose sides texts end and begin.
    """
    data, offsets, code = valid(data, offsets)
    n = len(code)
    if not n:
        return binary_array(data, np.zeros(1, np.int64)), np.zeros(len(offsets), np.int64)
    byte_of = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(byte_of, offsets)] = True
    fixed = []
    if special:
        whole = data.tobytes()
        at = whole.find(special)
        while at >= 0:
            k = int(np.searchsorted(byte_of, at))
            # Not across the bound of two texts.
            if not first[k + 1 : k + len(special)].any():
                fixed.append(k)
            at = whole.find(special, at + (len(special) if fixed and fixed[-1] == k else 1))
        for k in fixed:
            first[k] = first[k + len(special)] = True
    kind = kinds()[code]
    space = kind == SPACE
    starts = np.zeros(n + 1, bool)
    starts[n] = True
    body = starts[:n]
    opens = first[:n]
    before_space = np.zeros(n, bool)
    before_space[1:] = space[:-1]
    before_space &= ~opens
    # The last white-space character before something else of the same text.
    leads = np.zeros(n, bool)
    leads[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    changes = np.ones(n, bool)
    changes[1:] = kind[1:] != kind[:-1]
    after_blank = np.zeros(n, bool)
    after_blank[1:] = code[:-1] == 0x20
    after_blank &= ~opens
    body |= space & (~before_space | leads)
    body |= ~space & (opens | changes) & ~after_blank
    marks = np.flatnonzero((code == 0x27) & body)
    marks = marks[marks + 1 < n]
    marks = marks[~first[marks + 1]]
    if len(marks):
        one = code[marks + 1]
        short = np.isin(one, [ord(c) for c in SHORT_ENDINGS])
        two = np.zeros(len(marks), np.uint32)
        longer = (marks + 2 < n) & ~first[np.minimum(marks + 2, n)]
        two[longer] = code[marks[longer] + 2]
        long = np.zeros(len(marks), bool)
        for ending in LONG_ENDINGS:
            long |= (one == ord(ending[0])) & (two == ord(ending[1]))
        for chosen, size in ((short, 2), (long & ~short, 3)):
            starts[marks[chosen] + 1] = False
            starts[marks[chosen] + size] = True
    for k in fixed:
        starts[k + 1 : k + len(special)] = False
        starts[k] = starts[k + len(special)] = True
    at = np.flatnonzero(starts)
    bounds = np.append(byte_of, len(data))[at]
    return binary_array(data, bounds), np.searchsorted(bounds, offsets)
