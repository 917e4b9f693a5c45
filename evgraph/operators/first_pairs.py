"""The pairs of two lists whose MD5 begins low, for orders by hash of a whole space of pairs: hashes of one source with many targets at once, in numpy."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 55  # bytes of a message that is hashed as one block
_K = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_TURN = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_WORD = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


class Tails:
    """Ends of messages, of n bytes at most: their 32-bit words, with the byte that closes a message, at each of the four places in a word that they can begin at."""

    def __init__(self, tails: list[bytes]) -> None:
        self.sizes = np.array([len(t) for t in tails], dtype=np.uint32)
        longest = int(self.sizes.max(initial=0))
        self.words = []
        for at in range(4):
            width = -(-(at + longest + 1) // 4) * 4
            rows = np.frombuffer(b"".join((b"\0" * at + t + b"\x80").ljust(width, b"\0") for t in tails), dtype="<u4")
            self.words.append(np.ascontiguousarray(rows.reshape(len(tails), width // 4).T))


def first_words(heads: list[bytes], tails: Tails) -> np.ndarray:
    """The first four bytes, as a number, of the MD5 of head + tail: a row for each head, a column for each tail. Heads are equally long, messages have BLOCK bytes at most."""
    long, shape = len(heads[0]), (len(heads), len(tails.sizes))
    own = np.frombuffer(b"".join(h.ljust(64, b"\0") for h in heads), dtype="<u4").reshape(len(heads), 16).T[:, :, None]
    words = list(own)
    for i, w in enumerate(tails.words[long % 4], start=long // 4):
        words[i] = words[i] | w
    words[14] = ((tails.sizes + np.uint32(long)) * np.uint32(8))[None, :]
    state = [np.full(shape, x, dtype=np.uint32) for x in _START]
    f, g = np.empty(shape, dtype=np.uint32), np.empty(shape, dtype=np.uint32)
    # the first word of the digest is settled three steps before the end
    for i in range(61):
        a, b, c, d = state
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f), np.add(f, words[_WORD[i]] + np.uint32(_K[i]), out=f)
        np.left_shift(f, np.uint32(_TURN[i]), out=g), np.right_shift(f, np.uint32(32 - _TURN[i]), out=f), np.bitwise_or(f, g, out=f)
        np.add(f, b, out=a)
        state = [d, a, b, c]
    return (state[1] + np.uint32(_START[0])).byteswap()


def below(batches: Iterator[pa.RecordBatch], seed: int, bound: int, at_once: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """Rows of many sources and many targets (lists of id and text) become the pairs (source, target) for which the first 32 bits of md5(seed|source|target) are `bound` at most.

    Pairs with a missing id, and those too long for a block, are all returned. About `at_once` pairs are hashed together.
    """
    for batch in batches:
        for row in range(batch.num_rows):
            s, t = (batch.column(c).slice(row, 1).flatten() for c in ("sources", "targets"))
            heads = [None if x is None else f"{seed}|{x}|".encode() for x in s.field("text").to_pylist()]
            tails = [None if x is None else x.encode() for x in t.field("text").to_pylist()]
            groups: dict[int | None, list[int]] = {}
            for k, head in enumerate(heads):
                groups.setdefault(None if head is None else len(head), []).append(k)
            for size, group in groups.items():
                short = np.array([i for i, x in enumerate(tails) if size is not None and x is not None and size + len(x) <= BLOCK], dtype=np.int64)
                rest = np.setdiff1d(np.arange(len(tails)), short)
                packed, width = Tails([tails[i] for i in short]), max(1, at_once // max(1, len(short)))
                found = [(np.repeat(group, len(rest)), np.tile(rest, len(group)))]
                for i in range(0, len(group) if len(short) else 0, width):
                    some = group[i : i + width]
                    r, c = np.nonzero(first_words([heads[k] for k in some], packed) <= bound)
                    found.append((np.array(some)[r], short[c]))
                for k, at in found:
                    if len(at):
                        yield pa.RecordBatch.from_arrays([s.field("id").take(pa.array(k)), t.field("id").take(pa.array(at))], names=["source", "target"])
