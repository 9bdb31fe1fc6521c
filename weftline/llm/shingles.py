"""Word shingles of whole texts as sorted arrays of 64-bit hashes, many texts at a time.

Words are runs of anything but ASCII white space, with A-Z in lower case. A word's hash
scrambles its bytes eight at a time; a shingle's hash scrambles those of its words in order.
Hashes stand for shingles everywhere else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Bytes of texts that are hashed together; a longer text is a block of its own.
BLOCK = 1 << 19

MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
STEP = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


#: What is kept of eight bytes of which the first k count, by k.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: A longer word's hash is a cryptographic one.
LONG_WORD = 64


def word_hashes(block: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, and the number of words of each text.

    A word is scrambled eight bytes at a time, from its length on; up to eight bytes, words
    of one length never share a hash.
    """
    sizes = np.array([len(b) + 1 for b in block])
    raw = b"\n".join(block) + b"\n" + bytes(8)
    data = np.frombuffer(raw, np.uint8)[:-8]
    edge = np.flatnonzero(np.diff(BLANK[data].view(np.int8), prepend=np.int8(1)))
    start, end = edge[0::2], edge[1::2]
    n = end - start
    eight = np.ndarray((len(raw) - 7,), np.dtype("<u8"), raw, strides=(1,))
    h = mixed((eight[start] & FIRST_BYTES[np.minimum(n, 8)]) ^ (n.astype(np.uint64) * STEP[0]))
    at, k = np.flatnonzero(n > 8), 8
    while len(at) and k < LONG_WORD:
        h[at] = mixed((h[at] * STEP[1]) ^ (eight[start[at] + k] & FIRST_BYTES[np.minimum(n[at] - k, 8)]))
        k += 8
        at = at[n[at] > k]
    for i in at.tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]], digest_size=8).digest(), "little")
    ends = np.searchsorted(start, np.cumsum(sizes))
    return h, np.diff(ends, prepend=0)


def sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of ``width`` words, sorted.

    A text of fewer words has one shingle, all its words; one without words has none.
    """
    block, held = [], 0
    for t in texts:
        b = (t or "").encode("utf-8", "replace").lower()
        if held and held + len(b) > BLOCK:
            yield from _sets(block, width)
            block, held = [], 0
        block.append(b)
        held += len(b) + 1
    if block:
        yield from _sets(block, width)


def _sets(block: list[bytes], width: int) -> Iterator[np.ndarray]:
    words, counts = word_hashes(block)
    joined = words.copy() if len(words) else words
    for i in range(1, width):
        # order counts: what stands for the words so far is scrambled before the next joins
        joined = mixed(joined[: len(words) - i] * STEP[0] + words[i:] * STEP[1] + np.uint64(i)) if len(words) > i else joined[:0]
    at = 0
    for n in counts.tolist():
        if n >= width:
            yield np.unique(joined[at : at + n - width + 1])
        elif n:
            x = words[at : at + 1]
            for i in range(1, n):
                x = mixed(x * STEP[0] + words[at + i : at + i + 1] * STEP[1] + np.uint64(i))
            yield mixed(x ^ np.uint64(n))
        else:
            yield np.zeros(0, np.uint64)
        at += n
