"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and runs of white space become one space. An item of m characters may differ from a
passage by k = m * rate edits (rounded down). It is cut into k + 1 pieces, so a passage within k edits
holds at least one piece unchanged, near its place. One Aho-Corasick pass over a document finds all piece hits;
around each, Myers' bit-parallel algorithm gives the least distance of the item to any substring.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slim, strings

RATE = 0.08
#: Characters of items that one pass broadcasts. A larger benchmark takes several passes over the documents.
BLOCK_CHARS = 2_000_000
SCHEMA = "doc_id bigint, item_id bigint, distance bigint, end bigint"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 consecutive parts of nearly equal length, with where they start."""
    n, parts = len(item), budget + 1
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Myers:
    """Least edit distance of a pattern to a substring of a text, with Python's integers as bit vectors."""

    def __init__(self, pattern: str):
        self.m = len(pattern)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str, budget: int) -> tuple[int, int] | None:
        """(distance, end) of the first best match within the budget."""
        m, full, top = self.m, (1 << self.m) - 1, 1 << (self.m - 1)
        pv, mv, score, found, get = full, 0, self.m, None, self.masks.get
        for at, c in enumerate(text):
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv)
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score <= budget and (found is None or score < found[0]):
                    found = (score, at + 1)
                    if not score:
                        return found
            ph <<= 1
            pv = ((mh << 1) | ~(xv | ph)) & full
            mv = ph & xv & full
        return found


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.auto, owners = ahocorasick.Automaton(), {}
        self.items = {}
        for item, text in items:
            budget = int(len(text) * rate)
            if text and text not in owners.setdefault(None, {}):
                self.items[item] = (text, budget, Myers(text))
                owners[None][text] = [item]
                for start, piece in pieces(text, budget):
                    owners.setdefault(piece, []).append((item, start + len(piece)))
            elif text:
                owners[None][text].append(item)
        self.equal = {ids[0]: ids for ids in owners.pop(None, {}).values()}
        for piece, value in owners.items():
            self.auto.add_word(piece, value)
        self.auto.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item, distance, end in the normalised text) of each item's best match."""
        if not self.items:
            return []
        spots: dict[int, set[int]] = {}
        for end, hits in self.auto.iter(text):
            for item, reach in hits:
                spots.setdefault(item, set()).add(end + 1 - reach)
        out = []
        for item, starts in spots.items():
            whole, budget, myers = self.items[item]
            best, seen = None, -1
            runs: list[list[int]] = []
            for s in sorted(starts):  # windows that overlap are searched as one
                a, b = max(0, s - budget), s + len(whole) + budget
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            for a, b in runs:
                if hit := myers.best(text[a:b], budget):
                    if best is None or hit[0] < best[0]:
                        best = (hit[0], a + hit[1])
                    if not best[0]:
                        break
            if best:
                out += [(same, *best) for same in self.equal[item]]
        return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, size: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, streamed to the driver one partition at a time."""
    block, chars = [], 0
    for row in slim(benchmark, item_col, text_col).orderBy(item_col, text_col).toLocalIterator():
        if row[0] is None or row[1] is None or not (text := normal(row[1])):
            continue
        block.append((row[0], text))
        chars += len(text)
        if chars >= size:
            yield block
            block, chars = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document and item that it holds within the edit budget: least distance, and where it ends.

    ``end`` counts characters of the normalised text. Null or blank texts and items, and null item ids, match
    nothing; items of equal text share their matches; repeated rows give repeated results; empty tables give no
    rows; other columns are ignored.
    """
    rows, out = slim(docs, id_col, text_col).toDF("doc_id", "text").where("text is not null"), None

    def matches(items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items.value, rate)
            for batch in batches:
                found = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True) for hit in matcher.find(normal(text))]
                columns = [*zip(*((d, i, n, e) for d, i, n, e in found), strict=True)] or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "distance", "end"])

        return run

    for block in _blocks(benchmark, item_col, item_text_col, block_chars):
        part = rows.mapInArrow(matches(docs.sparkSession.sparkContext.broadcast(block)), SCHEMA)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.sparkSession.createDataFrame([], SCHEMA)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, with all their columns, that hold no item. Rows with a null id are kept."""
    id_col = options.get("id_col", "doc_id")
    leaked = find_leaks(docs, benchmark, **options).select(F.col("doc_id").alias("__leaked")).distinct()
    # nothing bounds the number of leaked documents, so they are never broadcast
    return docs.join(leaked.hint("merge"), docs[id_col] == leaked["__leaked"], "left_anti")
