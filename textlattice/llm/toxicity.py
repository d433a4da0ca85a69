"""Toxicity by logistic regression with FTRL-proximal updates over hashed word n-grams and skip-grams.

Each coordinate has its own learning rate, and the L1 term keeps most weights at exactly zero, so the
broadcast model is the few non-zero weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_ALNUM, U64, ByteHash, blocks, crc_remainder, mix, owner, slim, word_spans

BITS = 20
#: Labelled documents a class that the model is fitted on, in expectation (chosen by a hash of the id).
FIT_DOCS = 2000
ROUNDS = 6
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 0.1
#: Features of fewer fitted documents stay at zero.
MIN_DOCS = 4
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document index and hashed feature of every unigram, bigram, and pair with one or two words between."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, offsets, NOT_ALNUM)
    words, doc = ByteHash(low).ranges(starts, ends), owner(first)
    docs, found = [doc], [words]
    for gap in (1, 2, 3):
        if len(words) > gap:
            same = doc[gap:] == doc[:-gap]
            docs.append(doc[gap:][same])
            found.append(mix(words[:-gap] * U64(2 * gap + 1) + words[gap:])[same])
    return np.concatenate(docs), (np.concatenate(found) >> U64(64 - BITS)).astype(np.int64)


def ftrl(examples: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, float]:
    """Weights and bias from (label, distinct features) pairs, in the order given, ROUNDS times."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    seen = np.zeros(1 << BITS, np.int32)
    for _, found in examples:
        seen[found] += 1
    examples = [(label, found[seen[found] >= MIN_DOCS]) for label, found in examples]

    def weights(at):
        zz = z[at]
        w = -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zz) <= L1, 0.0, w)

    bias = np.array([1 << BITS])
    for _ in range(ROUNDS):
        for label, found in examples:
            at = np.concatenate([found, bias])
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - label
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange((1 << BITS) + 1))
    return w[:-1].astype(np.float32), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fold: int = 5, held: int = 0, per_class: int = FIT_DOCS) -> tuple[np.ndarray, float]:
    """Weights and bias from about as many documents of either class, so both kinds of error cost the same. Ids with several labels count as toxic if any is; null labels and ids don't count.

    With labels of one class only, all weights are zero and the bias is -8 or 8; with none, -8.
    """
    known = slim(labels, id_col, label_col).toDF("doc_id", "y").where("doc_id is not null and y is not null")
    known = known.where(crc_remainder("doc_id", fold) != held).groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    sizes = {int(r["y"] > 0): r["count"] for r in known.groupBy(F.expr("int(y > 0)").alias("y")).count().collect()}
    if len(sizes) < 2:
        return np.zeros(1 << BITS, np.float32), 8.0 if sizes.get(1) else -8.0
    share = F.when(F.col("y") > 0, per_class / sizes[1]).otherwise(per_class / sizes[0])
    chosen = known.where(F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1 << 24)) / (1 << 24) < share)
    # about 2 * FIT_DOCS ids, whatever the tables' sizes
    rows = slim(docs, id_col, text_col).toDF("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, j, data, offsets in blocks(batch.column(2)):
                doc, found = features(data, offsets)
                pairs = np.unique(doc << BITS | found)
                cuts = np.searchsorted(pairs, np.arange(j - i + 1) << BITS)
                out += [(pairs[a:b] & ((1 << BITS) - 1)).astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc_id", "y", "found"])

    seen = rows.mapInArrow(run, "doc_id bigint, y int, found binary").collect()
    seen.sort(key=lambda r: (hash((r["doc_id"] * 2654435761) & 0xFFFFFFFF), r["doc_id"], bytes(r["found"])))
    examples = [(int(r["y"] > 0), np.frombuffer(bytes(r["found"]), "<u4").astype(np.int64)) for r in seen]
    weights, bias = ftrl(examples)
    return weights, bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", fold: int = 5, held: int = 0) -> DataFrame:
    """Per row: the probability that the text is toxic, over its whole text.

    A null text is empty and gets the bias alone. Repeated rows give repeated results; null ids are kept; an
    empty table gives no rows; other columns are ignored.
    """
    weights, bias = model
    at = np.flatnonzero(weights)
    shared = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), weights[at]))  # 2**BITS pairs at most, 8 MB
    rows = slim(docs, id_col, text_col).toDF("doc_id", "text").withColumn("held_out", crc_remainder("doc_id", fold) == held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BITS, np.float32)
        table[shared.value[0]] = shared.value[1]
        for batch in batches:
            out = [np.zeros(0)]
            for i, j, data, offsets in blocks(batch.column(1)):
                doc, found = features(data, offsets)
                hit = np.flatnonzero(table[found])
                pairs = np.unique(doc[hit] << BITS | found[hit])
                total = np.bincount(pairs >> BITS, table[pairs & ((1 << BITS) - 1)], j - i) + bias
                out.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
            p = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, SCHEMA)
