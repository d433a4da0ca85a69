"""Word segmentation of unspaced strings: greedy and beam decoders, run once for each distinct string."""

from __future__ import annotations

import gc
import math
import pickle
import re
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from hashlib import md5
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlattice.functions import normalize as N
from textlattice.sources.tables import shared_folder

from . import gramkeys
from .ngram import BOS, EOS, K, CountTables

LONGEST, BEAM, OOV = 20, 20, -18.0
_SCORE = itemgetter(0)
#: Characters of distinct strings that are decoded together, with the model rows that they can use (one longer string is a block).
BLOCK_CHARS = 1 << 17
#: Rows that a kernel gives at once.
CHUNK = 50_000


class TrigramModel:
    """Counts as dictionaries, with the penalised back-off of ``ngram.trigram_log_prob``."""

    def __init__(self, uni: dict, bi: dict, tri: dict, k: float = K, stats: tuple[int, int] | None = None):
        """``stats``: tokens and types of the whole model, if the counts are part of it."""
        self.uni, self.bi, self.tri, self.k = uni, bi, tri, k
        self.vocab = {w for w in uni if w not in (BOS, EOS)}
        self.total, types = stats or (sum(c for w, c in uni.items() if w in self.vocab), len(self.vocab))
        self.v = types + 1
        self._tri = self._bi = self._after = None

    def log_prob(self, w: str, before: str, last: str) -> float:
        k, v = self.k, self.v
        context = self.bi.get((before, last), 0)
        if context:
            return math.log((self.tri.get((before, last, w), 0) + k) / (context + k * v))
        one = self.uni.get(last, 0)
        if one:
            return math.log((self.bi.get((last, w), 0) + k) / (one + k * v)) - 1.0
        return math.log((self.uni.get(w, 0) + k) / (self.total + k * v)) - 2.0

    def after(self, before: str, last: str) -> tuple[dict, float, float, float]:
        """(counts, n, penalty, value of an unseen word) of what follows: ``log_prob`` of w is log((its count + k) / n) - penalty. Made once."""
        if self._tri is None:
            self._tri, self._bi, self._after = {}, {}, {}
            for (a, b, c), n in self.tri.items():
                self._tri.setdefault((a, b), {})[c] = n
            for (a, b), n in self.bi.items():
                self._bi.setdefault(a, {})[b] = n
        context = self.bi.get((before, last), 0)
        key = (before, last) if context else last
        made = self._after.get(key)
        if made is None:
            if context:
                counts, n, less = self._tri.get(key, {}), context + self.k * self.v, 0.0
            elif one := self.uni.get(last, 0):
                counts, n, less = self._bi.get(last, {}), one + self.k * self.v, 1.0
            else:
                counts, n, less = self.uni, self.total + self.k * self.v, 2.0
            made = self._after[key] = counts, n, less, math.log(self.k / n) - less
        return made


def greedy(text: str, vocab, longest: int = LONGEST) -> list[str]:
    """The longest known word each time, else one character."""
    out, at = [], 0
    while at < len(text):
        size = next((n for n in range(min(longest, len(text) - at), 1, -1) if text[at : at + n] in vocab), 1)
        out.append(text[at : at + size])
        at += size
    return out


def beam(text: str, lm: TrigramModel, vocab=None, longest: int = LONGEST, width: int = BEAM) -> tuple[list[str], float]:
    """Best cut and its score. States are the last two words; equal scores keep the longer last word, then the better earlier state."""
    vocab = lm.vocab if vocab is None else vocab
    states: list[list[tuple]] = [[(0.0, BOS, BOS, -1, -1)]]
    # of each place's states, (score, last word, what can follow)
    heads: list[list[tuple]] = [[(0.0, BOS, *lm.after(BOS, BOS))]]
    k, log = lm.k, math.log
    for end in range(1, len(text) + 1):
        found = []
        for start in range(max(0, end - longest), end):
            w = text[start:end]
            if w in vocab:
                for i, (score, last, counts, n, less, unseen) in enumerate(heads[start]):
                    c = counts.get(w) if counts else None
                    found.append((score + (unseen if c is None else log((c + k) / n) - less), last, w, start, i))
            elif end - start == 1:
                found += [(head[0] + OOV, head[1], w, start, i) for i, head in enumerate(heads[start])]
        if end == len(text):
            states.append([max(found, key=_SCORE)] if found else [])
            break
        found.sort(key=_SCORE, reverse=True)
        best, seen, after = [], set(), []
        for state in found:
            score, last, w, _, _ = state
            if (last, w) not in seen:
                seen.add((last, w))
                best.append(state)
                after.append((score, w, *lm.after(last, w)))
                if len(best) == width:
                    break
        states.append(best)
        heads.append(after)
    if not states[-1]:
        return list(text), 0.0
    state, out = states[-1][0], []
    score = state[0]
    while state[3] >= 0:
        out.append(state[2])
        state = states[state[3]][state[4]]
    return out[::-1], score


def collect_model(lm: CountTables) -> TrigramModel:
    """The counts on the driver, for small models and tests; ``segment_beam`` takes tables of any size as they are."""
    uni = dict(lm.uni.toPandas().itertuples(index=False))
    bi = {(a, b): c for a, b, c in lm.bi.toPandas().itertuples(index=False)}
    tri = {(a, b, c): n for a, b, c, n in lm.tri.toPandas().itertuples(index=False)}
    return TrigramModel(uni, bi, tri)


def segment_greedy(strings: DataFrame, lexicon: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(s, tokens) for the distinct values of column ``s``.

    The substrings that can be words meet the lexicon's ``word`` column in a join, so that it may have any size.
    """
    distinct = strings.select("s").where("s is not null").distinct()

    def substrings(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for at in range(0, len(pdf), 256):
                rows = [(s, s[i : i + n]) for s in pdf["s"].iloc[at : at + 256] for i in range(len(s)) for n in range(2, min(longest, len(s) - i) + 1)]
                yield pd.DataFrame(rows, columns=["s", "word"]).drop_duplicates()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            known = [set(w) if w is not None else set() for w in pdf["known"]]
            yield pd.DataFrame({"s": pdf["s"], "tokens": [greedy(s, w, longest) for s, w in zip(pdf["s"], known, strict=True)]})

    words = distinct.mapInPandas(substrings, "s string, word string").join(lexicon.select("word").distinct(), "word")
    known = words.groupBy("s").agg(F.collect_set("word").alias("known"))
    return distinct.join(known, "s", "left").mapInPandas(run, "s string, tokens array<string>")


def segment_beam(strings: DataFrame, model: TrigramModel | CountTables, longest: int = LONGEST, width: int = BEAM) -> DataFrame:
    """(s, tokens, score) for the distinct values of column ``s``; concatenated tokens are the string.

    A TrigramModel is broadcast. CountTables have no bound: they are joined with what the strings can use of them.
    """
    distinct = strings.select("s").where("s is not null").distinct()
    if isinstance(model, CountTables):
        return _beam_by_blocks(distinct, model, longest, width)
    lm = strings.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield _decoded(pdf["s"], lm.value, longest, width)

    return distinct.mapInPandas(run, DECODED)


DECODED = "s string, tokens array<string>, score double"


def _decoded(strings: Iterable[str], lm: TrigramModel, longest: int, width: int) -> pd.DataFrame:
    found = [beam(s, lm, None, longest, width) if s else ([], 0.0) for s in strings]
    return pd.DataFrame({"s": list(strings), "tokens": [t for t, _ in found], "score": [x for _, x in found]})


@contextmanager
def _no_collection() -> Iterator[None]:
    """Without the search for cycles: a block makes millions of tuples, which hold none."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def _asked(block: int, state: tuple, keys: np.ndarray) -> Iterator[pd.DataFrame]:
    """A row that carries a block's state, and a row for each n-gram to look up; ``item`` is its place in the block's list."""
    yield pd.DataFrame({"block": [block], "state": [pickle.dumps(state)], "item": [-1], "k1": [0], "k2": [0]})
    k1, k2 = (np.ascontiguousarray(k).view(np.int64) for k in keys)
    for at in range(0, len(k1), CHUNK):
        part = slice(at, at + CHUNK)
        yield pd.DataFrame({"block": block, "state": None, "item": np.arange(at, at + len(k1[part])), "k1": k1[part], "k2": k2[part]})


ASKED = "block bigint, state binary, item bigint, k1 bigint, k2 bigint"


def _per_block(asked: DataFrame, counts: DataFrame, tasks: int, step: Callable[[int, tuple, np.ndarray, np.ndarray], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``step(block, state, items, counts)`` for each block, of those items that were counted."""

    def run(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, items, found = None, [], []
        for pdf in parts:
            carries = pdf["state"].notna()
            if carries.any():
                state = pickle.loads(pdf["state"][carries].iloc[0])
            rows = pdf[~carries]
            items.append(rows["item"].to_numpy(np.int64))
            found.append(rows["c"].to_numpy(np.int64))
        items, found = np.concatenate(items), np.concatenate(found)
        order = np.argsort(items)
        with _no_collection():
            yield from step(int(key[0]), state, items[order], found[order])

    summed = counts.groupBy("k1", "k2").agg(F.sum("c").alias("c"))
    found = asked.where("state is null").join(summed, ["k1", "k2"]).select("block", F.lit(None).cast("binary").alias("state"), "item", "c")
    states = asked.where("state is not null").select("block", "state", "item", F.lit(0).cast("bigint").alias("c"))
    # dealt by number, as few bytes may be many seconds of work
    return found.unionByName(states).repartition(tasks, "block").groupBy("block").applyInPandas(run, schema)


class Lattice:
    """The known words that the decoder can put into strings, as edges between places, by start and end; and what can follow them."""

    def __init__(self, strings: list[str], ids: dict[str, int], longest: int):
        of, pieces, words, held = ids.get, [[], [], []], [], 0
        first, base = [], 0

        def keep() -> None:
            found = np.array(words, np.int64)
            starts, ends = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, to))
            known = found >= 0
            for piece, part in zip(pieces, (starts[known], ends[known], found[known]), strict=True):
                piece.append(part)

        at, to = [], []
        for s in strings:
            size = len(s)
            first.append(base)
            for low in range(0, size, 4096):
                high = min(low + 4096, size)
                words += [of(s[i:j], -1) for i in range(low, high) for j in range(i + 1, min(i + longest, size) + 1)]
                starts, ends = _places(high - low, min(size - low, 4096 + longest), longest)
                at.append(starts + (base + low))
                to.append(ends + (base + low))
                held += len(starts)
                if held >= 1 << 20:
                    keep()
                    at, to, words, held = [], [], [], 0
            base += size + 1
        keep()
        self.start, self.end, self.word = (np.concatenate(x) for x in pieces)
        # edges that start a string, and all neighbours: edges first and second
        self.begin = np.flatnonzero(np.isin(self.start, np.array(first, np.int64)))
        degree = np.bincount(self.start, minlength=base + 1)
        self.first, self.second = _expanded((np.cumsum(degree) - degree)[self.end], degree[self.end])

    def pairs(self, m: int) -> np.ndarray:
        """Neighbours as first * m + second, in order; m - 1 is the start mark."""
        mark = (m - 1) * m
        return np.unique(np.concatenate([[mark + m - 1], mark + self.word[self.begin], self.word[self.first] * m + self.word[self.second]]).astype(np.int64))

    def triples(self, m: int, seen: np.ndarray, whole: bool) -> np.ndarray:
        """What can follow the pairs of ``seen``, as its place there * m + the word; ``whole``: only where the last two are such a pair too."""

        def place(codes: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(seen, codes), len(seen) - 1)
            return np.where(seen[at] == codes, at, -1)

        if not len(seen):
            return np.zeros(0, np.int64)
        mark = (m - 1) * m
        places, at_begin = place(self.word[self.first] * m + self.word[self.second]), place(mark + self.word[self.begin])
        start = place(np.array([mark + m - 1]))[0]
        # the neighbours that a trigram can end in, by their first edge
        last = np.flatnonzero(places >= 0) if whole else np.arange(len(places))
        degree = np.bincount(self.first[last], minlength=len(self.word))
        offset = np.cumsum(degree) - degree

        def after(place_: np.ndarray, edge: np.ndarray) -> np.ndarray:
            one, two = _expanded(offset[edge], degree[edge])
            return place_[one] * m + self.word[self.second[last[two]]]

        counted, begun = np.flatnonzero(places >= 0), np.flatnonzero(at_begin >= 0)
        out = [after(places[counted], self.second[counted]), after(at_begin[begun], self.begin[begun])]
        if start >= 0:
            out.append(start * m + self.word[self.begin[begun] if whole else self.begin])
        return np.unique(np.concatenate(out))


def _expanded(offset: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, offset[i] + 0 .. size[i] - 1) for each i."""
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + offset[which]


@lru_cache(1024)
def _places(starts: int, size: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the substrings of a string of that size, in order, that begin in its first places."""
    sizes = np.minimum(longest, size - np.arange(starts))
    which, ends = _expanded(np.arange(starts) + 1, sizes)
    return which, ends


def _beam_by_blocks(distinct: DataFrame, lm: CountTables, longest: int, width: int) -> DataFrame:
    """Blocks of strings meet the counts that the decoder can ask for: words and neighbours, then what follows a counted pair.

    A block's strings travel with its n-grams, each n-gram once a block, so that frequent ones are no hot keys. Words are first held against
    a sieve of the vocabulary, and the training n-grams against one of what was asked, so that neither all substrings nor all n-grams are sent.
    """
    spark = distinct.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n_tokens, n_types = lm.stats().first()
    vocabulary = gramkeys.sieve(gramkeys.keyed(lm.uni, 1), n_types, 32)
    sents = lm.texts if lm.texts is not None else lm.sents
    # of sentences, the last two words of a trigram are a bigram
    whole = sents is not None

    def counted(n: int, asked) -> DataFrame:
        return gramkeys.keyed((lm.uni, lm.bi, lm.tri)[n - 1], n, asked) if n == 1 or sents is None else gramkeys.count_asked(sents, n, asked)

    def written(rows: DataFrame, name: str) -> DataFrame:
        at = shared_folder(spark, name)
        rows.write.parquet(at)
        return spark.read.schema(rows.schema).parquet(at)

    def kept(rows: DataFrame, name: str) -> tuple[DataFrame, object]:
        rows = written(rows, name)
        grams = rows.where("state is null")
        return rows, gramkeys.sieve(grams, grams.count())

    def words(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held, chars = TaskContext.get().partitionId() << 32, [], 0

        def given() -> Iterator[pd.DataFrame]:
            names = [*dict.fromkeys(s[i : i + n] for s in held for i in range(len(s)) for n in range(1, min(longest, len(s) - i) + 1))]
            keys = gramkeys.word_keys(names)
            possible = vocabulary.value.holds(gramkeys.gram_keys(keys, np.arange(len(names)))) if names else []
            names = [w for w, p in zip(names, possible, strict=True) if p and w not in (BOS, EOS)] + [BOS]
            m, ids, keys = len(names), {w: i for i, w in enumerate(names[:-1])}, gramkeys.word_keys(names)
            pairs = Lattice(held, ids, longest).pairs(m)
            asked = gramkeys.gram_keys(keys, np.arange(m)), gramkeys.gram_keys(keys, pairs // m, pairs % m)
            return _asked(block, (held, names, pairs), np.concatenate(asked, axis=1))

        for pdf in parts:
            for s in pdf["s"]:
                held.append(s)
                chars += len(s)
                if chars >= BLOCK_CHARS:
                    with _no_collection():
                        yield from given()
                    block, held, chars = block + 1, [], 0
        if held:
            with _no_collection():
                yield from given()

    def followers(block: int, state: tuple, items: np.ndarray, counts: np.ndarray) -> Iterator[pd.DataFrame]:
        held, names, pairs = state
        m = len(names)
        uni = dict(zip(items[items < m].tolist(), counts[items < m].tolist(), strict=True))
        bi, bi_counts = pairs[items[items >= m] - m], counts[items >= m]
        triples = Lattice(held, {names[w]: w for w in uni if w < m - 1}, longest).triples(m, bi, whole)
        pair = bi[triples // m]
        keys = gramkeys.gram_keys(gramkeys.word_keys(names), pair // m, pair % m, triples % m)
        return _asked(block, (held, names, uni, bi, bi_counts, triples), keys)

    def cut(block: int, state: tuple, items: np.ndarray, counts: np.ndarray) -> Iterator[pd.DataFrame]:
        held, names, uni, bi, bi_counts, triples = state
        m = len(names)
        pairs = [(names[p // m], names[p % m]) for p in bi.tolist()]
        tri = {(*pairs[t // m], names[t % m]): c for t, c in zip(triples[items].tolist(), counts.tolist(), strict=True)}
        lm = TrigramModel({names[w]: c for w, c in uni.items()}, dict(zip(pairs, bi_counts.tolist(), strict=True)), tri, stats=(n_tokens, n_types))
        yield _decoded(held, lm, longest, width)

    # neighbours in order have most n-grams in common; sorted, so that a task that runs again makes the same blocks
    strings = written(distinct, "strings").repartitionByRange(tasks, "s").sortWithinPartitions("s")
    asked, sieve = kept(strings.mapInPandas(words, ASKED), "asked-pairs")
    asked, sieve = kept(_per_block(asked, counted(1, sieve).unionByName(counted(2, sieve)), tasks, followers, ASKED), "asked-triples")
    return _per_block(asked, counted(3, sieve), tasks, cut, DECODED)


def typing_merges(words: Column, *seed: Column | str, probability: float = 0.08) -> Column:
    """Array of (token, n_words): the space before each further word is left out with the probability, by a hash of seed and place."""
    cut = int(probability * (1 << 32))
    # one mark before a word that starts a token, another before one that is glued on
    marked = F.transform(words, lambda w, i: F.concat(F.when(i == 0, F.lit("")).when(N.hashed("merge", *seed, i) < cut, F.lit("\u0002")).otherwise(F.lit("\u0001")), w))
    tokens = F.filter(F.split(F.array_join(marked, ""), "\u0001"), lambda t: t != "")
    return F.transform(tokens, lambda t: F.struct(F.replace(t, F.lit("\u0002"), F.lit("")).alias("token"), F.size(F.split(t, "\u0002")).cast("bigint").alias("n_words")))


def merged_words(turns: DataFrame, *seed: str, probability: float = 0.08) -> DataFrame:
    """(s): the distinct cleaned tokens of two words or more that ``typing_merges`` makes of ``text`` with the named columns as seed, by an Arrow kernel."""
    cut = int(probability * (1 << 32))
    space = re.compile("[ \t\n\x0b\f\r]+")
    small = bytes(range(256)).lower()
    dropped = bytes(b for b in range(256) if not (chr(b).isascii() and chr(b).isalnum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {}
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for text, *key in zip(*columns, strict=True):
                if text is None:
                    continue
                words = [w for w in space.split(text) if w]
                made = md5("|".join(["merge", *(k for k in key if k is not None), ""]).encode())
                marked = words[:1]
                for i in range(1, len(words)):
                    place = made.copy()
                    place.update(b"%d" % i)
                    marked.append("\x02" if int.from_bytes(place.digest()[:4], "big") < cut else "\x01")
                    marked.append(words[i])
                for token in "".join(marked).split("\x01"):
                    if "\x02" in token:
                        found[token.encode().translate(small, dropped)] = None
            found.pop(b"", None)
            yield pa.RecordBatch.from_arrays([pa.array([*found], pa.binary()).cast(pa.string())], ["s"])

    return turns.select("text", *[F.col(c).cast("string") for c in seed]).mapInArrow(run, "s string").distinct()
