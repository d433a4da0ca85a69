"""Line quality: a linear-chain conditional random field labels each line content or boilerplate.

Features of a line are numbers in [0, 1]; weights and transitions are trained by gradient ascent on the
conditional likelihood of documents whose quality is labelled. Viterbi decoding labels the lines; the share
of words in content lines decides whether a document is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, ByteHash, blocks, mix, owner, per_range, slim, word_spans

#: Labelled documents a class that the model is fitted on, in expectation (chosen by a hash of the id).
FIT_DOCS = 600
STEPS, RATE, RIDGE = 120, 0.5, 1e-3
KEEP_SHARE = 0.5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCHEMA = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in BASE) + ", base_failed boolean, kept boolean, n_lines bigint, n_content_lines bigint, content_share double"
_SYMBOL = np.array([chr(b) in "#*$%&|<>" for b in range(256)])
_SHOUT = np.array([chr(b) in "!?" for b in range(256)])
_DIGIT = np.array([48 <= b < 58 for b in range(256)])
_UPPER = np.array([65 <= b < 91 for b in range(256)])
_LETTER = np.array([65 <= b < 91 or 97 <= b < 123 or b >= 128 for b in range(256)])
_STOP = np.array([chr(b) in '.!?:;"' for b in range(256)])
#: Words of notices and page furniture.
_NOTICE = re.compile(rb"licen[sc]e|copyright|rights reserved|cookie|privacy policy|terms of (?:use|service)|subscribe|click here|sign up|log ?in\b", re.I)
N_FEATURES = 11


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each line between line feeds, and per document the first line's index (n + 1 values)."""
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    # An empty document has one empty line, as any split has.
    count = 1 + np.diff(np.searchsorted(feeds, offsets))
    first = np.concatenate([[0], np.cumsum(count)])
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    last = first[1:] - 1
    ends[last] = offsets[1:]
    return starts, ends, first


def measure(data: np.ndarray, offsets: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    """The base counts of each document; features, words and first index of its lines with a word."""
    n_docs = len(offsets) - 1
    hashes = ByteHash(data)
    ws, we, first = word_spans(data, offsets)
    words, doc = hashes.ranges(ws, we), owner(first)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    out = {"n_words": np.diff(first), "word_chars": per_range(points[we] - points[ws], first), "n_symbols": per_range(_SYMBOL[data], offsets)}
    # 3-word windows that are found twice or more in their document
    covered = np.zeros(len(words) + 1, np.int64)
    if len(words) > 2:
        inside = np.flatnonzero(doc[2:] == doc[:-2])
        key = mix(mix(words[:-2] * U64(3) + words[1:-1]) * U64(5) + words[2:])[inside]
        key = mix(key + doc[inside].astype(np.uint64) * U64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = inside[twice]
        np.add.at(covered, at, 1)
        covered[3:] -= np.bincount(at, minlength=len(covered))[:-3]
        covered = np.cumsum(covered)
    out["n_repeat_words"] = per_range(covered[:-1] > 0, first)
    ls, le, lf = lines_of(data, offsets)
    line_doc = owner(lf)
    n_words = np.searchsorted(ws, le) - np.searchsorted(ws, ls)
    real = n_words > 0
    ls, le, line_doc, n_words = ls[real], le[real], line_doc[real], n_words[real]
    key = mix(hashes.ranges(ls, le) + line_doc.astype(np.uint64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    bounds = np.searchsorted(line_doc, np.arange(n_docs + 1))
    out["n_dup_lines"] = per_range(again, bounds)

    def share(flags):
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags[data], out=total[1:])
        return (total[le] - total[ls]) / np.maximum(le - ls, 1)

    wf = np.searchsorted(ws, ls)
    repeat = np.zeros(len(words) + 1, np.int64)
    if len(words) > 1:
        np.cumsum((words[1:] == words[:-1]) & (doc[1:] == doc[:-1]), out=repeat[2:])
    run = repeat[wf + n_words] - repeat[np.minimum(wf + 1, len(words))]
    letters = np.maximum(share(_LETTER), 1e-9)
    closing = data[we[wf + n_words - 1] - 1] if len(wf) else np.zeros(0, np.uint8)
    whole, notice = data.tobytes(), np.zeros(len(ls))
    for m in _NOTICE.finditer(whole):
        k = int(np.searchsorted(ls, m.start(), "right")) - 1
        if k >= 0 and m.end() <= le[k]:
            notice[k] = 1
    x = np.stack([np.ones(len(ls)), np.minimum(n_words / 50, 1), np.minimum(share(_SYMBOL) * 5, 1), np.minimum(share(_SHOUT) * 5, 1), np.minimum(share(_DIGIT) * 3, 1), np.minimum(share(_UPPER) / letters, 1), 1 - np.minimum(letters, 1), run / np.maximum(n_words - 1, 1), (~_STOP[closing]).astype(float), notice, again.astype(float)], 1)
    return out, x, n_words, bounds


def fit_crf(sequences: list[tuple[np.ndarray, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Weights (feature) for boilerplate against content, and transitions (2, 2), from (line features, quality, lines of the whole document)."""
    w, t = np.zeros(N_FEATURES), np.zeros((2, 2))
    if not sequences:
        return w, t
    sequences = sorted(sequences, key=lambda s: -len(s[0]))
    lengths = np.array([len(s[0]) for s in sequences])
    wide = np.zeros((len(sequences), lengths[0], N_FEATURES), np.float32)
    for i, (x, _, _) in enumerate(sequences):
        wide[i, : len(x)] = x
    gold = np.array([1 - q for _, q, _ in sequences])
    whole = np.array([n for _, _, n in sequences])
    part = lengths / whole
    mask = np.arange(lengths[0]) < lengths[:, None]
    share = 0.5 / max(1, part[gold == 0].sum()), 0.5 / max(1, part[gold == 1].sum())
    # Each document counts alike within its class, whole or in pieces, and both classes alike.
    weight = np.where(gold == 1, share[1], share[0])[:, None] * mask / whole[:, None]
    alive = [int((lengths > s).sum()) for s in range(lengths[0])]
    for _ in range(STEPS):
        unary = wide @ w
        alpha, beta = np.zeros((*mask.shape, 2)), np.zeros((*mask.shape, 2))
        alpha[:, 0, 1] = unary[:, 0]
        for s in range(1, lengths[0]):
            k = alive[s]
            alpha[:k, s] = np.logaddexp(alpha[:k, s - 1, :1] + t[0], alpha[:k, s - 1, 1:] + t[1])
            alpha[:k, s, 1] += unary[:k, s]
        for s in range(lengths[0] - 2, -1, -1):
            k = alive[s + 1]
            nxt = beta[:k, s + 1] + np.stack([np.zeros(k), unary[:k, s + 1]], 1)
            beta[:k, s] = np.logaddexp(t[:, 0] + nxt[:, :1], t[:, 1] + nxt[:, 1:])
        both = alpha + beta
        p = 1 / (1 + np.exp(np.clip(both[..., 0] - both[..., 1], -35, 35)))
        grad = (((gold[:, None] - p) * weight)[..., None] * wide).sum((0, 1)) - RIDGE * w
        total = np.logaddexp(both[:, 0, 0], both[:, 0, 1])
        gt = np.zeros((2, 2))
        pair_weight = weight[:, 1:]
        for a in (0, 1):
            for b in (0, 1):
                joint = alpha[:, :-1, a] + t[a, b] + beta[:, 1:, b] + (unary[:, 1:] if b else 0) - total[:, None]
                gt[a, b] = (pair_weight * (((gold == a) & (gold == b))[:, None] - np.exp(np.clip(joint, -60, 0)))).sum()
        w, t = w + 8 * RATE * grad, t + RATE * (gt - RIDGE * t)
    return w, t


def viterbi(x: np.ndarray, bounds: np.ndarray, w: np.ndarray, t: np.ndarray) -> np.ndarray:
    """For each line, whether it is content; documents are decoded side by side. Ties are content."""
    unary, n = x @ w, np.diff(bounds)
    content = np.ones(len(x), bool)
    order = np.argsort(-n, kind="stable")
    start, n = bounds[:-1][order], n[order]
    if not len(n) or not n[0]:
        return content
    back = []
    c, b = np.zeros(len(n)), np.zeros(len(n))
    k = int((n > 0).sum())
    b[:k] = unary[start[:k]]
    for s in range(1, n[0]):
        k = int(np.searchsorted(-n, -s, "left"))
        from_b = c[:k] + t[0, 0] < b[:k] + t[1, 0], c[:k] + t[0, 1] < b[:k] + t[1, 1]
        nc = np.where(from_b[0], b[:k] + t[1, 0], c[:k] + t[0, 0])
        b[:k] = np.where(from_b[1], b[:k] + t[1, 1], c[:k] + t[0, 1]) + unary[start[:k] + s]
        c[:k] = nc
        back.append(from_b)
    state = b > c
    for s in range(n[0] - 1, -1, -1):
        k = int(np.searchsorted(-n, -s, "left"))
        content[start[:k] + s] = ~state[:k]
        if s:
            state[:k] = np.where(state[:k], back[s - 1][1], back[s - 1][0])
    return content


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = FIT_DOCS, most_lines: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions. With labels of one class only, or none, all are zero and every line is content.

    Sampled documents of more than ``most_lines`` lines with a word are cut into consecutive sequences of so many.
    """
    known = slim(labels, id_col, label_col).toDF("doc_id", "q").where("doc_id is not null and q is not null").groupBy("doc_id").agg(F.min("q").cast("int").alias("q"))
    sizes = {int(r["q"] > 0): r["count"] for r in known.groupBy(F.expr("int(q > 0)").alias("q")).count().collect()}
    if len(sizes) < 2:
        return fit_crf([])
    share = F.when(F.col("q") > 0, per_class / sizes[1]).otherwise(per_class / sizes[0])
    chosen = known.where(F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 24)) / (1 << 24) < share)
    rows = slim(docs, id_col, text_col).toDF("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "q", "text")  # 2 * FIT_DOCS ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, j, data, offsets in blocks(batch.column(2)):
                _, x, _, bounds = measure(data, offsets)
                out += [x[a:b].astype("<f4").tobytes() if a < b else None for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc_id", "q", "x"])

    seen = sorted((r["doc_id"], int(r["q"] > 0), bytes(r["x"])) for r in rows.mapInArrow(run, "doc_id bigint, q int, x binary").collect() if r["x"])
    lines = [(np.frombuffer(x, "<f4").reshape(-1, N_FEATURES), q) for _, q, x in seen]
    return fit_crf([(x[at : at + most_lines], q, len(x)) for x, q in lines for at in range(0, len(x), most_lines)])


def judge(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep_share: float = KEEP_SHARE) -> DataFrame:
    """Per row: the base counts, whether they fail, and whether the document is kept.

    A null or blank text has no words, so it fails. Repeated rows give repeated results; an empty table gives no
    rows; other columns are ignored.
    """
    w, t = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, _, data, offsets in blocks(batch.column(1)):
                base, x, n_words, bounds = measure(data, offsets)
                content = viterbi(x, bounds, w, t)
                share = per_range(n_words * content, bounds) / np.maximum(base["n_words"], 1)
                failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
                parts.append([*(base[c] for c in BASE), failed, ~failed & (share >= keep_share), np.diff(bounds), per_range(content, bounds), share])
            if parts:
                columns = [pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return slim(docs, id_col, text_col).toDF("doc_id", "text").mapInArrow(run, SCHEMA)
