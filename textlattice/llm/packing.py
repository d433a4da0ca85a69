"""Sum-of-squares packing of token sequences.

A document longer than a window fills whole windows first. What remains goes into the open window whose
fill level keeps the sum over all levels of (number of windows at that level) squared smallest; ties go to
the fullest. The counts are one level array.

Open windows are closed by the same rule: while a task has more of them than it may hold, or at its end more than one, the
emptiest is given up and each of its pieces is placed anew, whole where it fits. Where it fits nowhere it is cut at a
window's end, what is left opens a window, and the rule chooses that window by the levels that this leaves. The
tokens of the very last open window are cut into powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import slim, strings

WINDOW = 2048
#: Open windows that a task holds at most (4 MB a thousand, at most); beyond it the emptiest is placed anew, nothing is lost.
OPEN_WINDOWS = 4096
END = (1).to_bytes(4, "little")
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_SPECIAL = {"<|endoftext|>": 50256}  # fixed value of the public vocabulary
_PIECE, _WIDE = re.compile(r" ?[^ \n]+|\n| "), re.compile(r"\s\s|\s\Z")


class Encoder(dict):
    """Ids of the byte-level BPE file, as packed little-endian 32-bit values.

    A single space or line feed between other characters is always a pre-token border of this vocabulary's
    pattern, so texts are cut there and each piece is encoded once and remembered. Texts with wider or
    final white space are encoded whole. Equality with the ``tokenizers`` library is tested.
    """

    def __init__(self, name: str = "byte_bpe_50k", remembered: int = 400_000):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=_SPECIAL)
        self.remembered = remembered

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.bpe.encode(piece, allowed_special="all"), "<u4").tobytes()
        if len(piece) < 64:
            if len(self) >= self.remembered:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if _WIDE.search(text):
            return np.array(self.bpe.encode(text, allowed_special="all"), "<u4").tobytes()
        return b"".join(map(self.__getitem__, _PIECE.findall(text)))


class Packer:
    """Places (doc, first token, packed ids, tokens of the document) pieces; ``rows`` are the finished ones."""

    def __init__(self, first_sequence: int, window: int = WINDOW, most_open: int = OPEN_WINDOWS):
        self.window, self.most_open, self.next = window, most_open, first_sequence
        self.levels = np.zeros(window + 1, np.int64)  # open windows by fill
        self.stacks: dict[int, list[list[tuple]]] = {}
        self.n_open = 0
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next, at))
            at += n
        self.next += 1

    def add(self, doc, ids: bytes) -> None:
        w, total = self.window, len(ids) // 4
        whole = total - total % w
        for s in range(0, whole, w):
            self.emit([(doc, s, ids[4 * s : 4 * (s + w)], total)])
        if rest := total - whole:
            self.place((doc, whole, ids[4 * whole :], total), rest)

    def place(self, piece: tuple, rest: int) -> None:
        """Put a piece of ``rest`` tokens whole into an open window or a new one."""
        w, levels = self.window, self.levels
        # Change of the sum of squares when a window goes from level h to h + rest; full windows don't count.
        change = 2 - 2 * levels[: w - rest + 1] + 2 * levels[rest:]
        change[-1] = 1 - 2 * levels[w - rest]
        change[0] = 2 * levels[rest] + 1 if rest < w else 0
        change[1:][levels[1 : w - rest + 1] == 0] = np.iinfo(np.int64).max
        self._into(w - rest - int(np.argmin(change[::-1])), piece, rest)
        while self.n_open > self.most_open:
            self.give_up()

    def replace(self, piece: tuple, rest: int) -> None:
        """Put a piece into open windows only: whole where it fits, else cut at a window's end; the sum of squares chooses."""
        w, levels = self.window, self.levels
        fits = np.flatnonzero(levels[1 : w - rest + 1]) + 1
        if len(fits):
            after = levels[np.minimum(fits + rest, w)]
            change = np.where(fits + rest == w, 1, 2 + 2 * after) - 2 * levels[fits]
        else:
            fits = np.flatnonzero(levels[1:]) + 1  # every one of these ends within the piece
            change = 2 - 2 * levels[fits] + 2 * levels[fits + rest - w]
        h = int(fits[::-1][np.argmin(change[::-1])])
        room = w - h
        if rest <= room:
            self._into(h, piece, rest)
            return
        doc, start, ids, total = piece
        self._into(h, (doc, start, ids[: 4 * room], total), room)
        self._into(0, (doc, start + room, ids[4 * room :], total), rest - room)

    def _into(self, h: int, piece: tuple, rest: int) -> None:
        pieces = []
        if h:
            pieces = self.stacks[h].pop()
            self.levels[h] -= 1
            self.n_open -= 1
        pieces.append(piece)
        if h + rest == self.window:
            self.emit(pieces)
            return
        self.stacks.setdefault(h + rest, []).append(pieces)
        self.levels[h + rest] += 1
        self.n_open += 1

    def _take(self) -> list[tuple]:
        """The pieces of the emptiest open window, which is open no more."""
        h = int(np.flatnonzero(self.levels)[0])
        self.levels[h] -= 1
        self.n_open -= 1
        return self.stacks[h].pop()

    def give_up(self) -> None:
        for piece in self._take():
            self.replace(piece, len(piece[2]) // 4)

    def finish(self) -> None:
        """Close all open windows; the last one's tokens go into powers of two."""
        while self.n_open > 1:
            self.give_up()
        pieces = self._take() if self.n_open else []
        left = sum(len(p[2]) // 4 for p in pieces)
        queue, current = iter(pieces), None
        for size in (1 << b for b in range(self.window.bit_length(), -1, -1) if left >> b & 1):
            out, need = [], size
            while need:
                doc, start, ids, total = current or next(queue)
                take = min(need, len(ids) // 4)
                out.append((doc, start, ids[: 4 * take], total))
                current = (doc, start + take, ids[4 * take :], total) if take < len(ids) // 4 else None
                need -= take
            self.emit(out)


def pack_sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """Pieces of all documents and the sequences that hold them, one row a piece.

    Each scan task packs what it reads, so nothing is shuffled; a task that runs again gives the same rows.
    A sequence's id is the task's number times 2**36 plus a count within the task. A null text is empty,
    so its document is the single end id; repeated rows and null ids are packed as they are; an empty table gives
    no rows; other columns are ignored. A very long text is cut like any other that is longer than a window. The windows that a
    rule ties for are told apart by their fill; of equal levels the window that was opened or filled last is taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder(tokenizer), Packer(TaskContext.get().partitionId() << 36, window)

        def out() -> pa.RecordBatch:
            columns = [*zip(*packer.rows, strict=True)] or [[] for _ in range(7)]
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                packer.add(doc, encoder.encode(text) + END)
                if len(packer.rows) >= 20_000:
                    yield out()
        packer.finish()
        yield out()

    return slim(docs, id_col, text_col).mapInArrow(run, SCHEMA)
