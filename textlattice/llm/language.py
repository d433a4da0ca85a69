"""Language identification by mixture inference.

Each language has a smoothed model of hashed byte trigrams. A document's words are drawn from a mixture of
languages: expectation-maximisation estimates the proportions, and the language set (nested in order of
proportion) is the one with the highest likelihood less half a log of the number of words for each further
language. Sets of up to three are always tried, larger ones as long as the last language was worth its price.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, LOWER, blocks, crc_remainder, owner, per_range, slim, strings, word_spans

#: Documents a language that the trigram models are fitted on, in expectation (chosen by a hash of the id).
FIT_DOCS = 400
#: Languages up to which blocks of texts have their full size; with more, blocks are smaller.
LANGUAGES = 64
BUCKETS = 1 << 16
ROUNDS = 6
#: Sets of so many languages are tried for every text.
TRIED = 3
UND = "und"
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double, languages array<string>, shares array<double>"
_LETTER = re.compile(r"[^\W\d_]")
_ASCII_LETTER = np.array([65 <= b < 91 or 97 <= b < 123 for b in range(256)])


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bucket of the trigram at each byte; BUCKETS where a document has no three bytes left."""
    low = LOWER[data].astype(np.uint32)
    out = np.full(len(data), BUCKETS, np.uint32)
    if len(data) > 2:
        x = low[:-2] * np.uint32(0x9E3779B1) ^ low[1:-1] * np.uint32(0x85EBCA77) ^ low[2:] * np.uint32(0xC2B2AE3D)
        out[:-2] = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)
        for back in (1, 2):
            out[np.maximum(offsets[1:] - back, offsets[:-1])[np.diff(offsets) > 0]] = BUCKETS
    return out


def fit(docs: DataFrame, lang_col: str, id_col: str, text_col: str, per_language: int = FIT_DOCS) -> tuple[list[str], np.ndarray]:
    """Names, and log likelihoods (language, bucket). Counts are summed by Spark; BUCKETS rows a language come back at most."""
    rows = slim(docs, id_col, text_col, lang_col).toDF("doc_id", "text", "lang").where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").count()
    sizes = sorted((r["lang"], per_language / r["count"]) for r in sizes.collect())
    names = [lang for lang, _ in sizes]
    if not names:
        return [], np.zeros((0, BUCKETS + 1), np.float32)
    shares = docs.sparkSession.createDataFrame(sizes, "lang string, share double")
    drawn = (F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 24)) / (1 << 24)) < F.col("share")
    chosen = rows.join(F.broadcast(shares), "lang").where(drawn).select("doc_id", "text", "lang")  # a row a language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), BUCKETS + 1), np.int64)
        at = {name: i for i, name in enumerate(names)}
        for batch in batches:
            langs = batch.column(2).to_pylist()
            for i, _, data, offsets in blocks(batch.column(1), 1):
                total[at[langs[i]]] += np.bincount(grams(data, offsets), minlength=BUCKETS + 1)
        k, g = np.nonzero(total[:, :BUCKETS])
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(g, pa.int64()), pa.array(total[k, g])], names=["k", "g", "n"])

    found = chosen.mapInArrow(count, "k bigint, g bigint, n bigint").groupBy("k", "g").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros((len(names), BUCKETS))
    total[found["k"].to_numpy(int), found["g"].to_numpy(int)] = found["n"].to_numpy(float)
    logs = np.log((total + 0.5) / (total.sum(1, keepdims=True) + 0.5 * BUCKETS))
    return names, np.hstack([logs, np.zeros((len(names), 1))]).astype(np.float32)


def mixture(words: np.ndarray, bounds: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (document, language) and log likelihoods by EM. words: (language, word) likelihoods; active: allowed ones."""
    n = np.maximum(np.diff(bounds), 1)
    doc = owner(bounds)
    share = active / np.maximum(active.sum(1, keepdims=True), 1)
    for _ in range(ROUNDS):
        joint = [w * share[:, k].astype(np.float32)[doc] for k, w in enumerate(words)]
        whole = np.maximum(sum(joint), 1e-30)
        share = np.stack([per_range(j / whole, bounds, np.float64) / n for j in joint], 1)
    whole = np.maximum(sum(w * share[:, k].astype(np.float32)[doc] for k, w in enumerate(words)), 1e-30)
    return share, per_range(np.log(whole), bounds, np.float64)


def infer(logs: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and the chosen set (document, language)."""
    n_docs, n_lang = len(offsets) - 1, len(logs)
    starts, _, first = word_spans(data, offsets)
    gram = grams(data, offsets)
    if len(starts):
        table = np.stack([np.add.reduceat(row[gram], starts) for row in logs])
    else:
        table = np.zeros((n_lang, 0), np.float32)
    top = table.max(0) if n_lang else table
    table -= top
    np.maximum(table, -60, out=table)
    alone = np.stack([per_range(row, first, np.float64) for row in table], 1)
    words = np.exp(table)
    every = np.ones((n_docs, n_lang))
    share, _ = mixture(words, first, every)
    order = np.argsort(-share, 1, kind="stable")
    rank = np.argsort(order, 1, kind="stable")
    best = np.argmax(alone, 1)
    chosen = np.zeros((n_docs, n_lang), bool)
    chosen[np.arange(n_docs), best] = True
    final, value = chosen.astype(float), alone[np.arange(n_docs), best].copy()
    price = 0.5 * np.log(np.maximum(np.diff(first), 2))
    grows = every_doc = np.arange(n_docs)
    for m in range(2, n_lang + 1):
        tried = every_doc if m <= TRIED else grows
        if not len(tried):
            break
        active = rank[tried] < m
        among = np.isin(every_doc, tried)
        bounds = np.concatenate([[0], np.cumsum(np.diff(first)[tried])])
        s, like = mixture(words if among.all() else words[:, among[owner(first)]], bounds, active.astype(float))
        like -= price[tried] * (m - 1)
        better = like > value[tried]
        grows = tried[better]
        value[grows], chosen[grows], final[grows] = like[better], active[better], s[better]
    # The score of a single language is its posterior against the others.
    one = chosen.sum(1) == 1
    post = np.exp(np.maximum(alone - alone.max(1, keepdims=True), -700))
    post /= post.sum(1, keepdims=True)
    final[one] = np.where(chosen[one], post[one], 0)
    return final, chosen


def block_bytes(n_lang: int) -> int:
    """Bytes of text whose words have likelihoods for all languages at once."""
    return max(1, BLOCK_BYTES * LANGUAGES // max(n_lang, LANGUAGES))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", fold: int = 3, held: int = 1) -> DataFrame:
    """Per row: predicted language, score, and the language set with its shares, largest first.

    A null text, or one with no letter, is ``und`` with score 0 and an empty set, as is everything if no
    language was learned. Repeated rows give repeated results; ties go to the language first by name; an
    empty table gives no rows; other columns are ignored.
    """
    names, logs = model
    shared = docs.sparkSession.sparkContext.broadcast(logs)  # BUCKETS floats a language, 256 kB
    rows = slim(docs, id_col, text_col).toDF("doc_id", "text").withColumn("held_out", crc_remainder("doc_id", fold) == held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score, sets, shares = [], [], [], []
            for i, j, data, offsets in blocks(batch.column(1), block_bytes(len(names))):
                letter = per_range(_ASCII_LETTER[data], offsets) > 0
                other = per_range(data >= 128, offsets) > 0
                for d in np.flatnonzero(~letter & other):
                    letter[d] = bool(_LETTER.search(strings(batch.column(1).slice(i + d, 1))[0]))
                if not names:
                    letter[:] = False
                    final = chosen = np.zeros((j - i, 1))
                else:
                    final, chosen = infer(shared.value, data, offsets)
                for d in range(j - i):
                    k = [int(x) for x in np.argsort(-final[d], kind="stable") if chosen[d, x]] if letter[d] else []
                    pred.append(names[k[0]] if k else UND)
                    score.append(min(1.0, float(final[d, k[0]])) if k else 0.0)
                    sets.append([names[x] for x in k])
                    shares.append([float(final[d, x]) for x in k])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return rows.mapInArrow(run, SCHEMA)


def accepted(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all columns, that ``identify`` does not call ``und``.

    The likelihoods decide nothing here: each text has a likeliest language, so one in no learned language
    stays too. If no language was learned, nothing can be told and every row with a letter stays.
    """
    names, logs = model
    shared = docs.sparkSession.sparkContext.broadcast(logs)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [np.zeros(0, bool)]
            for i, j, data, offsets in blocks(batch.column(at), block_bytes(len(names))):
                letter = per_range(_ASCII_LETTER[data], offsets) > 0
                for d in np.flatnonzero(~letter & (per_range(data >= 128, offsets) > 0)):
                    letter[d] = bool(_LETTER.search(strings(batch.column(at).slice(i + d, 1))[0]))
                if names:
                    final, chosen = infer(shared.value, data, offsets)
                    letter &= chosen.any(1) & np.isfinite(final).all(1)
                keep.append(letter)
            yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
