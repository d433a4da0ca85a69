"""Repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

The suffixes are those at anchors (see ``repeats``): each chunk sorts its own and sends them as a front-coded
run, each suffix without the prefix that it shares with the one before. A bucket combines its chunks' runs with a
loser tree. Every entry carries the length of the prefix that it shares with the last one put out; of two entries the
one with the longer such prefix is smaller, and only at equal lengths are bytes compared, from that length on,
so known prefixes are never compared again. The merged order with its common-prefix lengths, and the bytes
before the anchors, give the classes of equal strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import U64, _BYTE, mix
from .repeats import LENGTH, Contexts, Method, answer, byte_units, constant_pieces, pack, remove_repeats, unpack

GRAM = 20


def common(a: bytes, b: bytes, known: int) -> int:
    """The length of the common prefix, at least ``known``; only bytes from there on are looked at."""
    end, at = min(len(a), len(b)), known
    if a[at:end] == b[at:end]:
        return end
    step = 8
    while a[at : at + step] == b[at : at + step]:
        at += step
    while a[at] == b[at]:
        at += 1
    return at


def front_code(suffixes: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Shared prefix lengths with the one before, lengths of the rest, and the rests."""
    shared, rests, before = [], [], b""
    for s in suffixes:
        n = common(before, s, 0)
        shared.append(n)
        rests.append(s[n:])
        before = s
    return np.array(shared, np.int16), np.array([len(r) for r in rests], np.int16), b"".join(rests)


class Run:
    """A sorted run that is decoded as it is read."""

    __slots__ = ("shared", "rest", "tails", "at", "place", "suffix", "known")

    def __init__(self, shared: np.ndarray, rest: np.ndarray, tails: bytes):
        self.shared, self.rest, self.tails = shared.tolist(), rest.tolist(), tails
        self.at, self.place, self.suffix, self.known = -1, 0, b"", 0

    def advance(self) -> bool:
        self.at += 1
        if self.at >= len(self.shared):
            return False
        n, m = self.shared[self.at], self.rest[self.at]
        self.suffix = self.suffix[:n] + self.tails[self.place : self.place + m]
        self.place += m
        self.known = n  # shared with the one before in this run, which is the last one put out
        return True


def merge(runs: list[Run]) -> Iterator[tuple[int, int, int]]:
    """(run, index in it, prefix shared with the one put out before) in sorted order, by a loser tree."""
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    alive = [i < len(runs) and runs[i].advance() for i in range(leaves)]
    for r in runs:
        r.known = 0

    def winner(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes the one shared with the winner."""
        if not alive[a]:
            return b, a
        if not alive[b]:
            return a, b
        x, y = runs[a], runs[b]
        if x.known != y.known:
            return (a, b) if x.known > y.known else (b, a)
        s, t = x.suffix, y.suffix
        n = common(s, t, x.known)
        if n == len(s) or (n < len(t) and s[n] < t[n]):
            y.known = n
            return a, b
        x.known = n
        return b, a

    losers = [0] * leaves
    best = list(range(leaves))
    while len(best) > 1:
        base, nxt = len(best) // 2, []
        for i in range(base):
            w, loser = winner(best[2 * i], best[2 * i + 1])
            losers[base + i] = loser
            nxt.append(w)
        best = nxt
    top = best[0]
    while alive[top]:
        run = runs[top]
        yield top, run.at, run.known
        alive[top] = run.advance()
        node = (top + leaves) // 2
        while node:
            top, losers[node] = winner(top, losers[node])
            node //= 2


def encode(c: Contexts) -> bytes:
    """A sorted front-coded run of the contexts' suffixes at their anchors, with what belongs to each."""
    first = np.concatenate([[0], np.cumsum(c.size)])
    raw = c.symbols.tobytes()
    suffixes = [raw[a + n : b] for a, b, n in zip(first[:-1].tolist(), first[1:].tolist(), c.left.tolist(), strict=True)]
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    shared, rest, tails = front_code([suffixes[i] for i in order])
    lefts = b"".join(raw[first[i] : first[i] + c.left[i]] for i in order)
    at = np.array(order)
    return pack(shared, rest, np.frombuffer(tails, np.uint8), c.context[at], c.least[at], c.most[at], c.left[at].astype(np.int16), c.size[at].astype(np.int16), np.frombuffer(lefts, np.uint8))


def resolver(gram: int, length: int):
    most_left = length - gram

    def resolve(received: list[tuple[int, bytes]]) -> tuple[np.ndarray, ...]:
        parts = [unpack(blob) for _, blob in received]
        count = [len(p[3]) for p in parts]
        first = np.concatenate([[0], np.cumsum(count)])
        order, shared = [], []
        for run, at, known in merge([Run(p[0], p[1], p[2].tobytes()) for p in parts]):
            order.append(first[run] + at)
            shared.append(known)
        order, shared = np.array(order, np.int64), np.array(shared, np.int64)
        context, least, most, left, size = (np.concatenate([p[i] for p in parts]) for i in range(3, 8))
        left, size = left.astype(np.int64), size.astype(np.int64)
        before = np.concatenate([p[8] for p in parts])
        before_first = np.concatenate([[0], np.cumsum(left)])
        chunk = np.repeat(np.array([c for c, _ in received], np.int64), count)
        # distinct contexts, in the merged order
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        by = np.lexsort((rank, context))
        heads = np.flatnonzero(np.concatenate([[True], context[by][1:] != context[by][:-1]]))
        lowest = np.minimum.reduceat(least[by], heads)
        one = by[heads]
        index = np.empty(len(order), np.int64)
        index[by] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(by))))
        place, n_left, n_right = rank[one], left[one], size[one] - left[one]
        n_passages = size[one] - length + 1
        start = np.concatenate([[0], np.cumsum(n_passages)])
        result = np.repeat(lowest, n_passages)
        # the bytes before the anchor, from the anchor on; hashed one by one as strings grow to the left
        back = before_first[one] + n_left
        hashed = np.zeros(len(one), np.uint64)
        for o in range(most_left + 1):
            if o:
                at = np.maximum(back - o, 0)
                hashed = mix(hashed + _BYTE[before[np.minimum(at, max(len(before) - 1, 0))]] if len(before) else hashed)
            sel = np.flatnonzero((n_left >= o) & (n_right >= length - o))
            if not len(sel):
                continue
            # contexts whose suffixes share what the string has of them stand together in the merged order
            group = np.cumsum(shared < length - o)
            key = mix(hashed[sel] + group[place[sel]].astype(np.uint64) * U64(0x9E3779B97F4A7C15))
            by = np.argsort(key, kind="stable")
            heads = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))
            value = np.repeat(np.minimum.reduceat(lowest[sel][by], heads), np.diff(np.append(heads, len(by))))
            result[start[sel[by]] + n_left[sel[by]] - o] = value
        return answer(index, chunk, context, most, constant_pieces(result, n_passages))

    return resolve


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts in a document with a smaller id.

    Texts are UTF-8 bytes; strings never cross documents, overlaps count, and strings are judged on the input. One
    row a document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256; ``with_text`` adds what
    stays as text, with a replacement sign where a character was cut. A null text is empty; texts shorter than
    ``length`` keep all; documents of equal id never remove from each other; a null id counts as larger than all others; an
    empty table gives no rows; other columns are ignored.
    """
    method = Method(byte_units, gram, encode, resolver(gram, length))
    return remove_repeats(docs, method, id_col, text_col, length, with_text).withColumnRenamed("n_units", "n_bytes")
