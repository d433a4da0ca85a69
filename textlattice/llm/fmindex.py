"""Repeated word passages by a compressed FM-index per shard.

A shard is one bucket of the exchange in ``repeats``: contexts that hold the same anchors. Its index is a
Burrows-Wheeler transform, compressed by run lengths: a wavelet matrix of bit vectors with block ranks over the heads of its
runs, a bit vector of where they start, and for each place the context that it came from, in 32 bits. Neither the text nor the
suffix array is kept. The documents' contexts are streamed against it: backward search extends each match to the left
one word at a time, for all open places at once. The words that it can take while the match occurs anywhere else are the
place's matching statistic, counted up to the threshold; the interval of a place that reaches it holds all its occurrences,
and so the smallest document id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import U64, owner
from .repeats import LENGTH, Contexts, Method, answer, constant_pieces, gather, pack, remove_repeats, unpack, word_units

GRAM = 8
#: Passages that are searched side by side.
LANES = 200_000


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` symbols at least, by prefix doubling."""
    n = len(text)
    rank, step = text.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        step *= 2
        if step >= depth or new[order[-1]] == n - 1:
            return order
        rank = new


class BitVector:
    """Bits in 64-bit words with the count before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words)[:-1], out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word = at >> 6
        mask = (U64(1) << (at & 63).astype(np.uint64)) - U64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, levels: int):
        self.size, self.levels, self.vectors, self.zeros = len(values), levels, [], []
        for level in range(levels - 1, -1, -1):
            bits = (values >> level) & 1
            self.vectors.append(BitVector(bits))
            self.zeros.append(int(len(bits) - bits.sum()))
            values = np.concatenate([values[bits == 0], values[bits == 1]])

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the symbol's occurrences before each place end among all values, put in the order of their last level."""
        for k, vector in enumerate(self.vectors):
            ones = vector.ones(at)
            bit = (symbol >> (self.levels - 1 - k)) & 1
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return at


class RunLengths:
    """A sequence of symbols below ``size`` by its runs, with ranks: repetitive shards have far fewer runs than places."""

    def __init__(self, values: np.ndarray, size: int):
        change = np.ones(len(values), np.uint8)
        change[1:] = values[1:] != values[:-1]
        self.starts = np.flatnonzero(change).astype(np.int32)
        self.begins = BitVector(change)
        self.symbol = values[self.starts].astype(np.int32)
        self.heads = WaveletMatrix(self.symbol, max(1, int(size - 1).bit_length()))
        runs = np.arange(len(self.starts))
        lengths = np.zeros(len(runs) + 1, np.int32)
        lengths[1 + self.heads.descend(self.symbol, runs)] = np.diff(np.append(self.starts, len(values)))
        self.total = np.cumsum(lengths, dtype=np.int32)  # lengths of the runs in the matrix' last order, before each
        self.first = self.heads.descend(np.arange(size), np.zeros(size, np.int64))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of the symbol before each place."""
        last = np.maximum(self.begins.ones(at) - 1, 0)  # the run that the place before is in
        whole = self.total[self.heads.descend(symbol, last)] - self.total[self.first[symbol]]
        return whole + np.where(self.symbol[last] == symbol, at - self.starts[last], 0)


class FMIndex:
    """Index over texts of positive symbols; 0 separates texts. ``source``: what each place of the text came from."""

    def __init__(self, text: np.ndarray, source: np.ndarray, depth: int):
        self.alphabet, coded = np.unique(text, return_inverse=True)
        order = suffix_array(coded, depth)
        size = len(self.alphabet)
        self.length = len(text)
        self.last = RunLengths(coded[order - 1], size)  # the first suffix wraps round to the end, a separator
        self.heads = self.last.heads
        self.before = np.concatenate([[0], np.cumsum(np.bincount(coded, minlength=size))])[:-1]
        self.source = source[order].astype(np.int32)

    def codes(self, text: np.ndarray) -> np.ndarray:
        """The index's numbers of a text's symbols, all of which it holds."""
        return np.searchsorted(self.alphabet, text).astype(np.int32)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the matches with one more symbol at their left."""
        both = self.last.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.tile(self.before[symbol], 2)
        return both[: len(symbol)], both[len(symbol) :]

    def statistics(self, codes: np.ndarray, end: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place of a streamed text that is indexed itself, the longest string before it that occurs twice or more.

        Lengths up to ``threshold``, at which a search stops; then its interval too, else (0, 0).
        """
        matched, low, high = np.zeros(len(end), np.int16), np.zeros(len(end), np.int64), np.zeros(len(end), np.int64)
        for a in range(0, len(end), LANES):
            lanes = np.arange(a, min(a + LANES, len(end)))
            lo, hi = np.zeros(len(lanes), np.int64), np.full(len(lanes), self.length, np.int64)
            for step in range(1, threshold + 1):
                lo, hi = self.extend(codes[end[lanes] - step], lo, hi)
                open_ = hi - lo > 1
                if not open_.all():
                    lanes, lo, hi = lanes[open_], lo[open_], hi[open_]
                if not len(lanes):
                    break
                matched[lanes] = step
            low[lanes], high[lanes] = lo, hi
        return matched, low, high


def encode(c: Contexts) -> bytes:
    return pack(c.context, c.key, c.least, c.most, c.left.astype(np.int16), c.size.astype(np.int16), c.symbols)


def resolver(length: int):
    def resolve(received: list[tuple[int, bytes]]) -> tuple[np.ndarray, ...]:
        parts = [unpack(blob) for _, blob in received]
        context, key, least, most, _, size, symbols = (np.concatenate([p[i] for p in parts]) for i in range(7))
        size = size.astype(np.int64)
        first = np.concatenate([[0], np.cumsum(size)])
        chunk = np.repeat(np.array([c for c, _ in received], np.int64), [len(p[0]) for p in parts])
        by = np.argsort(context, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], context[by][1:] != context[by][:-1]]))
        lowest, one = np.minimum.reduceat(least[by], heads), by[heads]
        index = np.empty(len(context), np.int64)
        index[by] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(by))))
        n_passages = size[one] - length + 1
        start = np.concatenate([[0], np.cumsum(n_passages)])
        # the index holds each distinct context once, closed by a separator
        n = size[one]
        text = np.zeros(int(n.sum()) + len(n), np.uint64)
        at = np.concatenate([[0], np.cumsum(n + 1)])
        text[np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(int(n.sum()))] = gather(symbols, first[one], n)
        found = FMIndex(text, np.minimum(owner(at), len(lowest) - 1), length)
        passage = np.arange(int(n_passages.sum())) - np.repeat(start[:-1], n_passages)
        matched, low, high = found.statistics(found.codes(text), np.repeat(at[:-1], n_passages) + passage + length, length)
        result = np.repeat(lowest, n_passages)
        several = np.flatnonzero(matched >= length)
        if len(several):
            # intervals of one length are equal or disjoint
            ids = lowest[found.source]
            lows, which = np.unique(low[several], return_inverse=True)
            highs = np.zeros(len(lows), np.int64)
            highs[which] = high[several]
            bounds = np.stack([lows, highs], 1).ravel()
            values = np.minimum.reduceat(np.append(ids, np.iinfo(np.int64).max), bounds)[::2]
            result[several] = values[which]
        return answer(index, chunk, context, most, constant_pieces(result, n_passages))

    return resolve


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """Remove each word covered by ``length`` consecutive words that also start in a document with a smaller id.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; passages never cross documents and are judged on the input. One row a
    document: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space); ``with_text`` adds them. A null
    text has no words; texts shorter than ``length`` words keep all; documents of equal id never remove from each
    other; a null id counts as larger than all others; an empty table gives no rows; other columns are ignored.
    """
    method = Method(word_units, gram, encode, resolver(length))
    return remove_repeats(docs, method, id_col, text_col, length, with_text).drop("n_spans").withColumnRenamed("n_units", "n_words")
