"""Repeated passages over a whole corpus, in units of bytes or words: the exchange that two operators share.

A passage is ``LENGTH`` consecutive units of one document. Each passage has an anchor: of its ``gram``-unit
grams, the one with the smallest hash, leftmost if tied. Equal passages have equal anchors at the same place in
them. Consecutive passages with one anchor form a run; a run's units are its context.

1. Documents are dealt into chunks by a hash, as many as their bytes call for. Each scan task sends the distinct (anchor, chunk)
   pairs it saw, eight bytes each, to the anchor's bucket. A very common anchor is one pair a chunk.
2. A bucket tells each chunk which of its anchors other chunks hold too, and which of these are heavy: held by many chunks.
3. A chunk keeps the runs whose anchor occurs in another chunk or another of its own documents. Their
   distinct contexts go to the anchor's bucket with the smallest and largest id in the chunk that has them. A run at a heavy anchor
   is first split by where its passages have the anchor, and each part is dealt by all units that its passages share: a common
   phrase in ever other surroundings then meets its own surroundings only.
4. A bucket finds, for each passage of each context, the smallest document id (its resolver's job: a merge of sorted
   suffix runs, or an FM-index), and answers each chunk.
5. A chunk removes the units of passages that a document with a smaller id holds.

Steps 1, 3 and 5 read all documents, the last two from one exchange; steps 2 and 4 read only what they are sent. Nothing is sampled or capped.
Contexts are distinct within a chunk before they are sent, so copies do not grow a bucket; what can still grow one are passages that differ
from each other in the ``LENGTH`` / ``SPLIT`` outermost units only.

Grams, contexts and words are compared by 64-bit hashes (grams across chunks by 41 to 48 bits of them, which can only send too much): of n different
strings two are equal by accident with odds of about n * n / 2**65, for contexts within one bucket; that is 3e-8 for a million.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, ByteHash, RollHash, _BYTE, blocks, mix, owner, per_range, slim, word_spans

LENGTH = 50
#: Anchors kept in a task before they are sent on: 24 MB.
HELD = 3_000_000
#: Text bytes of a chunk, on average; a chunk is held by one task at a time.
CHUNK_BYTES = 32 << 20
#: Chunks that hold an anchor from which on it is heavy, and the parts that a run is then split into.
HEAVY, SPLIT = 256, 7
NO_ID = np.iinfo(np.int64).max
#: Chunks up to which they have labels of their own (a literal in the plan); more are many a partition, and even without.
LABELLED = 1 << 15


@dataclass
class Units:
    """One block as units: hash values, symbols, first unit of each document (n + 1), and for words their bytes' bounds."""

    values: np.ndarray
    symbols: np.ndarray
    first: np.ndarray
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None


def byte_units(data: np.ndarray, offsets: np.ndarray) -> Units:
    return Units(_BYTE[data], data, offsets)


def word_units(data: np.ndarray, offsets: np.ndarray) -> Units:
    starts, ends, first = word_spans(data, offsets)
    words = ByteHash(data).ranges(starts, ends)
    return Units(words, words, first, starts, ends)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


@dataclass
class Runs:
    doc: np.ndarray  # index within the block
    start: np.ndarray  # first unit of the context
    end: np.ndarray
    anchor: np.ndarray
    key: np.ndarray
    context: np.ndarray  # hash of the context's units
    deal: np.ndarray  # what the bucket comes from


def runs_of(units: Units, gram: int, length: int = LENGTH, heavy: Callable[[np.ndarray], np.ndarray] | None = None) -> Runs:
    """All runs; those whose key is ``heavy`` in parts, with the ``deal`` that such a part goes by."""
    n = len(units.values)
    if n < length:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, none, *[none.astype(np.uint64)] * 3)
    roll = RollHash(units.values)
    grams = roll.all_of(gram)
    # 32 bits of hash, then the place: the same choice wherever the passage stands
    least = _sliding_min((grams & U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64), length - gram + 1)
    at = (least & U64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(len(at) + 1, np.int32)  # passages that cross the end of a document
    ends = np.unique(units.first[1:-1])
    ends = ends[(ends > 0) & (ends < n)]
    np.add.at(inside, np.clip(ends - length + 1, 0, len(at)), 1)
    np.add.at(inside, np.clip(ends, 0, len(at)), -1)
    valid = np.cumsum(inside[:-1]) == 0
    change = np.ones(len(at) + 1, bool)
    change[1:-1] = (at[1:] != at[:-1]) | ~valid[1:] | ~valid[:-1]
    start, last = np.flatnonzero(change[:-1] & valid), np.flatnonzero(change[1:] & valid)
    end = last + length
    anchor = at[start]
    key = deal = grams[anchor]
    parted = heavy(key) if heavy else np.zeros(len(key), bool)
    if parted.any():
        # passages by the units before their anchor: first * width to (first + 1) * width - 1 of them in a part
        width = -(-(length - gram + 1) // SPLIT)
        most, fewest = (anchor - start) // width, (anchor - (end - length)) // width
        count = np.where(parted, most - fewest + 1, 1)
        run = np.repeat(np.arange(len(key)), count)
        part = np.repeat(fewest, count) + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        own = parted[run]
        anchor, key = anchor[run], key[run]
        low, high = np.maximum(start[run], anchor - (part + 1) * width + 1), np.minimum(end[run] - length, anchor - part * width)
        start, end = np.where(own, low, start[run]), np.where(own, high + length, end[run])
        deal = key.copy()
        a, p = anchor[own], part[own]
        deal[own] = mix(key[own] ^ roll.ranges(a - p * width, a - (p + 1) * width + 1 + length))
    doc = np.searchsorted(units.first, start, "right") - 1
    return Runs(doc, start, end, anchor, key, roll.ranges(start, end), deal)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of any types, with their lengths and types ahead."""
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), ord(a.dtype.char)))], np.int64)
    return head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(blob: bytes) -> list[np.ndarray]:
    count = int(np.frombuffer(blob, np.int64, 1)[0])
    head, at, out = np.frombuffer(blob, np.int64, 2 * count, 8), 8 + 16 * count, []
    for n, char in head.reshape(-1, 2):
        dtype = np.dtype(chr(char))
        out.append(np.frombuffer(blob, dtype, n, at))
        at += n * dtype.itemsize
    return out


def gather(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The ranges' values, one after the other."""
    total = int(length.sum())
    before = np.concatenate([[0], np.cumsum(length)[:-1]]) if len(length) else np.zeros(0, np.int64)
    return values[np.repeat(start - before, length) + np.arange(total)]


@dataclass
class Contexts:
    """Distinct contexts of one chunk for one bucket; or of all chunks, where ``chunk`` tells them apart."""

    context: np.ndarray  # u64 hash
    key: np.ndarray
    least: np.ndarray  # smallest and largest document id in the chunk
    most: np.ndarray
    left: np.ndarray  # units before the anchor
    size: np.ndarray  # units
    symbols: np.ndarray  # of all contexts, one after the other
    chunk: np.ndarray | None = None


Encode = Callable[[Contexts], bytes]
#: From a bucket's (chunk, blob) pairs to (chunk, context, first passage, end passage, smallest id) arrays.
Resolve = Callable[[list[tuple[int, bytes]]], tuple[np.ndarray, ...]]


@dataclass
class Method:
    """What the operator adds to the exchange."""

    units: Callable[[np.ndarray, np.ndarray], Units]
    gram: int
    encode: Encode
    resolve: Resolve


def _combine(column: pa.ChunkedArray) -> pa.Array:
    joined = column.combine_chunks()
    if isinstance(joined, pa.ChunkedArray):
        joined = pa.concat_arrays(joined.chunks) if joined.num_chunks else pa.array([], column.type)
    return joined


def kept_text(method: Method, data: np.ndarray, units: Units, removed: np.ndarray) -> list[bytes]:
    """What stays of each document: bytes, or words joined by one space."""
    out, spaced = [], np.append(data, np.uint8(32))
    for a, b in zip(units.first[:-1], units.first[1:], strict=True):
        keep = ~removed[a:b]
        if units.starts is None:
            out.append(data[a:b][keep].tobytes())
        else:
            s, e = units.starts[a:b][keep], units.ends[a:b][keep]
            if not len(s):
                out.append(b"")
                continue
            # each word and the byte after it, which is made a space
            whole = gather(spaced, s, e - s + 1)
            whole[np.cumsum(e - s + 1) - 1] = 32
            out.append(whole[:-1].tobytes())
    return out


RESULT = "doc_id bigint, n_units bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
WITH_TEXT = RESULT + ", kept string"


def remove_repeats(docs: DataFrame, method: Method, id_col: str, text_col: str, length: int = LENGTH, with_text: bool = False, asked_only: bool = False) -> DataFrame:
    """One row a document: units, removed units, maximal removed runs, digest of what stays (``with_text``: and that itself).

    A null id counts as larger than all others. All five steps are one plan; both passes over the chunks read one exchange.
    Only the bytes are counted before, for the number of chunks. ``asked_only``: what step 3 sends, to look at.
    """
    spark = docs.sparkSession
    rows = slim(docs, id_col, text_col).toDF("doc_id", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = parts * max(1, -(-size // (CHUNK_BYTES * parts)))
    bits = max(16, (n - 1).bit_length())  # of a pair's 64, for the chunk
    low = U64((1 << bits) - 1)
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")
    if n <= LABELLED:
        # labels that an exchange deals evenly, so that no two chunks share a partition by accident while others have none
        labels = even_labels(parts, n)
        chunk = F.element_at(F.lit(labels), chunk + 1)
    else:
        labels = range(n)
    place = {int(x): i for i, x in enumerate(labels)} if n <= LABELLED else labels
    rows = rows.select(chunk.alias("chunk"), "doc_id", "text")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def out():
            v = np.unique(np.concatenate(held))
            bucket = ((v >> U64(bits)) % U64(n)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            v, cuts = v[order], np.searchsorted(bucket[order], np.arange(n + 1))
            some = np.flatnonzero(np.diff(cuts))
            return pa.RecordBatch.from_arrays([pa.array([labels[b] for b in some], pa.int32()), pa.array([v[cuts[b] : cuts[b + 1]].tobytes() for b in some], pa.binary())], names=["bucket", "pairs"])

        for batch in batches:
            chunk = np.array([place[x] for x in batch.column(0).to_pylist()], np.uint64)
            for i, _, data, offsets in blocks(batch.column(1)):
                runs = runs_of(method.units(data, offsets), method.gram, length)
                held.append(np.unique((runs.key & ~low) | chunk[i + runs.doc]))
                count += len(held[-1])
                if count >= HELD:
                    yield out()
                    held, count = [], 0
        if count:
            yield out()

    def shared(group: pa.Table) -> pa.Table:
        v = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in group.column("pairs").to_pylist()]))
        heads = _heads(v & ~low)
        holders = np.repeat(np.diff(np.append(heads, len(v))), np.diff(np.append(heads, len(v))))
        v, holders = v[holders > 1], holders[holders > 1]
        chunk = (v & low).astype(np.int64)
        order = np.argsort(chunk, kind="stable")
        # the last bit of a key tells that it is heavy
        v, cuts = ((v & ~low) | (holders >= HEAVY).astype(np.uint64))[order], np.searchsorted(chunk[order], np.arange(n + 1))
        some = np.flatnonzero(np.diff(cuts))
        return pa.table({"chunk": pa.array([labels[c] for c in some], pa.int32()), "keys": pa.array([v[cuts[c] : cuts[c + 1]].tobytes() for c in some], pa.binary())})

    def among(keys: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        keys = np.sort(keys)

        def test(key: np.ndarray) -> np.ndarray:
            if not len(keys):
                return np.zeros(len(key), bool)
            key = key & ~low
            return keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key

        return test

    def contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        text, number = _combine(left.column("text")), _numbers(left.column("doc_id"))
        keys = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in right.column("keys").to_pylist())])
        heavy = keys[keys & U64(1) == 1] & ~low
        known, split = among(keys & ~low), among(heavy)
        found, symbols, shift = [], [], 0
        for i, _, data, offsets in blocks(text):
            units = method.units(data, offsets)
            r = runs_of(units, method.gram, length, split)
            found.append((r.doc + i, r.start + shift, r.end + shift, r.anchor + shift, r.key & ~low, r.context, r.deal & ~low))
            symbols.append(units.symbols)
            shift += len(units.symbols)
        out: list[tuple] = []
        if found:
            f = Runs(*(np.concatenate(p) for p in zip(*found, strict=True)))
            symbols = np.concatenate(symbols)
            hit = known(f.key)
            # anchors in several documents of this chunk
            order = np.argsort(f.key, kind="stable")
            heads = _heads(f.key[order])
            if len(heads):
                d = f.doc[order]
                several = np.maximum.reduceat(d, heads) != np.minimum.reduceat(d, heads)
                hit[order] |= np.repeat(several, np.diff(np.append(heads, len(d))))
            f = Runs(*(x[hit] for x in (f.doc, f.start, f.end, f.anchor, f.key, f.context, f.deal)))
            mine = number[f.doc]
            order = np.argsort(f.context, kind="stable")
            heads = _heads(f.context[order])
            if len(heads):
                chunk = place[left.column("chunk")[0].as_py()]
                if len(heavy):
                    out.append((labels[chunk], chunk, None, heavy.tobytes()))
                least, most = np.minimum.reduceat(mine[order], heads), np.maximum.reduceat(mine[order], heads)
                one = order[heads]
                bucket = ((f.deal[one] >> U64(bits)) % U64(n)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                one, least, most, bucket = one[by], least[by], most[by], bucket[by]
                edges = np.append(_heads(bucket), len(bucket))
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    o = one[a:b]
                    size = f.end[o] - f.start[o]
                    blob = method.encode(Contexts(f.context[o], f.key[o], least[a:b], most[a:b], f.anchor[o] - f.start[o], size, gather(symbols, f.start[o], size)))
                    out.append((labels[int(bucket[a])], chunk, blob, None))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table({c: pa.array(x, t) for c, x, t in zip(["part", "chunk", "blob", "heavy"], columns, kinds, strict=True)})

    def resolve(group: pa.Table) -> pa.Table:
        rows = list(zip(group.column("chunk").to_pylist(), group.column("blob").to_pylist(), group.column("heavy").to_pylist(), strict=True))
        out = [(labels[c], None, heavy) for c, _, heavy in rows if heavy]  # a chunk's note to itself
        received = [(c, blob) for c, blob, _ in rows if blob]
        if received:
            chunk, context, lo, hi, least = method.resolve(received)
            order = np.lexsort((context, chunk))
            chunk, context, lo, hi, least = chunk[order], context[order], lo[order], hi[order], least[order]
            some, cuts = np.unique(chunk, return_index=True)
            cuts = np.append(cuts, len(chunk))
            out += [(labels[int(c)], pack(context[a:b], lo[a:b].astype(np.int16), hi[a:b].astype(np.int16), least[a:b]), None) for c, a, b in zip(some, cuts[:-1], cuts[1:], strict=True)]
        columns = list(zip(*out, strict=True)) or [[]] * 3
        return pa.table({c: pa.array(x, t) for c, x, t in zip(["chunk", "answer", "heavy"], columns, [pa.int32(), pa.binary(), pa.binary()], strict=True)})

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = [unpack(x) for x in right.column("answer").to_pylist() if x]
        split = among(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in right.column("heavy").to_pylist() if x)]))
        context, lo, hi, least = (np.concatenate(x) for x in zip(*answers, strict=True)) if answers else (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
        order = np.argsort(context, kind="stable")
        context, lo, hi, least = context[order], lo[order].astype(np.int64), hi[order].astype(np.int64), least[order]
        ids, number, out = left.column("doc_id").to_pylist(), _numbers(left.column("doc_id")), []
        for i, _, data, offsets in blocks(_combine(left.column("text"))):
            units = method.units(data, offsets)
            r = runs_of(units, method.gram, length, split)
            a, b = np.searchsorted(context, r.context, "left"), np.searchsorted(context, r.context, "right")
            piece, run = gather(np.arange(len(context)), a, b - a), np.repeat(np.arange(len(a)), b - a)
            smaller = least[piece] < number[i + r.doc[run]]
            piece, run = piece[smaller], run[smaller]
            cover = np.zeros(len(units.values) + 1, np.int64)
            np.add.at(cover, r.start[run] + lo[piece], 1)
            np.add.at(cover, r.start[run] + hi[piece] - 1 + length, -1)
            removed = np.cumsum(cover[:-1]) > 0
            head = removed.copy()
            head[1:] &= ~removed[:-1]
            edge = units.first[:-1][np.diff(units.first) > 0]
            head[edge] = removed[edge]
            gone, runs = per_range(removed, units.first), per_range(head, units.first)
            for d, kept in enumerate(kept_text(method, data, units, removed)):
                row = (ids[i + d], int(units.first[d + 1] - units.first[d]), int(gone[d]), int(runs[d]), hashlib.sha256(kept).hexdigest())
                out.append((*row, kept.decode("utf-8", "replace")) if with_text else row)
        names = [c.split()[0] for c in (WITH_TEXT if with_text else RESULT).split(", ")]
        kinds = [pa.int64()] * 4 + [pa.string()] * (2 if with_text else 1)
        columns = list(zip(*out, strict=True)) or [[]] * len(names)
        return pa.table({c: pa.array(x, t) for c, x, t in zip(names, columns, kinds, strict=True)})

    keys = rows.select("chunk", "text").mapInArrow(anchors, "bucket int, pairs binary").groupBy("bucket").applyInArrow(shared, "chunk int, keys binary")
    asked = rows.groupBy("chunk").cogroup(keys.groupBy("chunk")).applyInArrow(contexts, "part int, chunk int, blob binary, heavy binary")
    if asked_only:
        return asked
    answers = asked.groupBy("part").applyInArrow(resolve, "chunk int, answer binary, heavy binary")
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(remove, WITH_TEXT if with_text else RESULT)


def spark_hash(values: np.ndarray) -> np.ndarray:
    """Spark's hash of 32-bit whole numbers, by which an exchange deals them (32-bit Murmur3, seed 42)."""
    def rotate(x, by):
        return (x << np.uint32(by)) | (x >> np.uint32(32 - by))

    #: The constants of the hash function.
    k = rotate(values.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = rotate(np.uint32(42) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(4)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def even_labels(parts: int, n: int) -> list[int]:
    """n whole numbers, the k-th of which a hash exchange deals to partition k modulo ``parts``."""
    each, size = -(-n // parts), 16 * n + 64
    while True:
        part = spark_hash(np.arange(size, dtype=np.int32)).astype(np.int64) % parts
        order = np.argsort(part, kind="stable")
        first = np.searchsorted(part[order], np.arange(parts + 1))
        if np.diff(first).min() >= each:
            return [int(order[first[k % parts] + k // parts]) for k in range(n)]
        size *= 2


def _heads(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


def _numbers(ids: pa.ChunkedArray) -> np.ndarray:
    return np.array([NO_ID if x is None else x for x in ids.to_pylist()], np.int64)


def constant_pieces(least: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From the smallest id of each passage of each context, (context index, first, end, id) of its constant stretches."""
    first = np.concatenate([[0], np.cumsum(count)])
    own = owner(first)
    head = np.ones(len(least), bool)
    head[1:] = (least[1:] != least[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(head)
    end = np.append(at[1:], len(least))
    return own[at], at - first[own[at]], end - first[own[at]], least[at]


def answer(index: np.ndarray, chunk: np.ndarray, context: np.ndarray, most: np.ndarray, pieces: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The pieces of distinct context ``index`` for each request, where an id of that chunk can be larger."""
    own, lo, hi, least = pieces
    bounds = np.searchsorted(own, np.arange(int(index.max(initial=-1)) + 2))
    n = bounds[index + 1] - bounds[index]
    at, request = gather(np.arange(len(own)), bounds[index], n), np.repeat(np.arange(len(index)), n)
    useful = least[at] < most[request]
    at, request = at[useful], request[useful]
    return chunk[request], context[request], lo[at], hi[at], least[at]
