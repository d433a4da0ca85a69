"""Part-of-speech tagging, span alignment and error attribution."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<START>", "<END>"
K = 1e-4


def sequences(events: DataFrame) -> DataFrame:
    """(user_id, pos, word, tag): each user's events in order of time as a tagged sequence."""
    steps = F.array_sort(F.collect_list(F.struct("ts", "event_id", F.get_json_object("props", "$.k").alias("word"), F.col("event_type").alias("tag"))))
    return events.groupBy("user_id").agg(steps.alias("s")).select("user_id", F.posexplode("s").alias("pos", "x")).select("user_id", F.col("pos").cast("bigint"), "x.word", "x.tag")


def train_mft(seq: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((word, tag): most frequent tag, ties to the tag first by name; one row (tag): the modal tag)."""
    counts = seq.groupBy("word", "tag").agg(F.count("*").alias("c"))
    best = F.min(F.struct((-F.col("c")).alias("k"), F.col("tag"))).alias("b")
    modal = counts.groupBy("tag").agg(F.sum("c").alias("c")).agg(best).select("b.tag")
    return counts.groupBy("word").agg(best).select("word", "b.tag"), modal


def predict_mft(rows: DataFrame, mft: DataFrame, modal: DataFrame) -> DataFrame:
    known = mft.select("word", F.col("tag").alias("known"))
    return rows.join(known, "word", "left").crossJoin(F.broadcast(modal.select(F.col("tag").alias("modal")))).withColumn("pred", F.coalesce("known", "modal")).drop("known", "modal")


def transitions(seq: DataFrame, key: str = "user_id") -> DataFrame:
    """(prev, cur, c) over sequences padded with a start and an end mark."""
    tags = seq.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda s: s["tag"]).alias("t"))
    pairs = F.arrays_zip(F.concat(F.array(F.lit(START)), F.col("t")).alias("prev"), F.concat(F.col("t"), F.array(F.lit(END))).alias("cur"))
    return tags.select(F.explode(pairs).alias("x")).groupBy("x.prev", "x.cur").agg(F.count("*").alias("c"))


def emissions(seq: DataFrame) -> DataFrame:
    return seq.groupBy("tag", "word").agg(F.count("*").alias("c"))


def transition_log_probs(trans: DataFrame, k: float = K) -> DataFrame:
    """(prev, cur, logprob) for all pairs of tags and the start mark. The start mark's total is 0 by definition, so values may be positive."""
    tags = trans.where(F.col("cur") != END).select(F.col("cur").alias("tag")).distinct()
    totals = trans.groupBy("cur").agg(F.sum("c").alias("total")).withColumnRenamed("cur", "prev")
    n = tags.agg(F.count("*").alias("n_tags"))
    # a tag set is small whatever the data: it is the label set
    grid = tags.select(F.col("tag").alias("cur")).crossJoin(F.broadcast(tags.select(F.col("tag").alias("prev")).unionByName(tags.sparkSession.createDataFrame([(START,)], "prev string"))))
    out = grid.join(trans, ["prev", "cur"], "left").join(totals, "prev", "left").crossJoin(F.broadcast(n))
    value = F.ln((F.coalesce("c", F.lit(0)) + F.lit(k)) / (F.coalesce("total", F.lit(0)) + F.lit(k) * F.col("n_tags").cast("double")))
    return out.select("prev", "cur", value.alias("logprob"))


def emission_log_probs(emit: DataFrame, k: float = K) -> DataFrame:
    """(tag, word, logprob) for all tags and words."""
    totals = emit.groupBy("tag").agg(F.sum("c").alias("total"))
    words = emit.select("word").distinct()
    v = words.agg(F.count("*").alias("v"))
    out = words.crossJoin(F.broadcast(totals)).join(emit, ["tag", "word"], "left").crossJoin(F.broadcast(v))
    value = F.ln((F.coalesce("c", F.lit(0)) + F.lit(k)) / (F.col("total") + F.lit(k) * (F.col("v") + 1).cast("double")))
    return out.select("tag", "word", value.alias("logprob"))


def viterbi(words: list[str], tags: list[str], trans: np.ndarray, start: np.ndarray, emit: dict[str, np.ndarray], unknown: np.ndarray) -> tuple[list[str], float]:
    """Best tags and score; ties go to the tag first by name; there is no step to the end mark."""
    return best_tags([emit.get(w, unknown) for w in words], tags, trans, start)


def best_tags(scores: list[np.ndarray], tags: list[str], trans: np.ndarray, start: np.ndarray) -> tuple[list[str], float]:
    """``viterbi`` over the emission scores of each word."""
    if not len(scores):
        return [], 0.0
    score, back = start + scores[0], []
    for emitted in scores[1:]:
        into = score[:, None] + trans
        back.append(into.argmax(0))
        score = into.max(0) + emitted
    at = int(score.argmax())
    best, path = float(score[at]), [at]
    for b in reversed(back):
        at = int(b[at])
        path.append(at)
    return [tags[i] for i in reversed(path)], best


def decode(seqs: DataFrame, trans: DataFrame, emit: DataFrame, key: str = "user_id", k: float = K) -> DataFrame:
    """(key, pos, pred_tag, best_score) of (key, words array) rows.

    The driver holds tags x tags numbers and two for each tag. The words meet their counts by tag in a join, so the lexicon has no bound.
    """
    # logarithms of quotients by the C library, as in SQL: another form may break near ties between paths another way
    counts = {(r["prev"], r["cur"]): r["c"] for r in trans.collect()}
    tags = sorted({b for _, b in counts if b != END})
    into = {t: sum(c for (_, b), c in counts.items() if b == t) for t in tags}
    matrix, start = ([[math.log((counts.get((a, b), 0) + k) / (into.get(a, 0) + k * len(tags))) for b in tags] for a in of] for of in (tags, [START]))
    matrix, start = np.array(matrix), np.array(start[0])
    totals = dict(emit.groupBy("tag").agg(F.sum("c")).collect())
    types = emit.select("word").distinct().count()
    below = [totals.get(t, 0) + k * (types + 1) for t in tags]

    def run(parts):
        known = {}
        for pdf in parts:
            out = []
            for ident, counts in zip(pdf[key], pdf["s"], strict=True):
                scores = []
                for seen in counts:
                    c = tuple(seen) if seen is not None else (0,) * len(tags)
                    if c not in known:
                        if len(known) >= 1 << 16:
                            known.clear()
                        known[c] = np.array([math.log((n + k) / b) for n, b in zip(c, below, strict=True)])
                    scores.append(known[c])
                found, best = best_tags(scores, tags, matrix, start)
                out += [(ident, i, t, best) for i, t in enumerate(found)]
            yield pd.DataFrame(out, columns=[key, "pos", "pred_tag", "best_score"])

    # the counts of a word by tag
    seen = emit.groupBy("word").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("tag") == t, F.col("c"))), F.lit(0)) for t in tags]).alias("seen"))
    words = seqs.select(key, F.posexplode("words").alias("pos", "word"))
    steps = F.transform(F.array_sort(F.collect_list(F.struct("pos", "seen"))), lambda x: x["seen"])
    lines = words.join(seen, "word", "left").groupBy(key).agg(steps.alias("s"))
    return lines.mapInPandas(run, f"{key} bigint, pos bigint, pred_tag string, best_score double")


#: Tags of other sets, in small letters, and their treebank tags.
TREEBANK_TAGS = {
    "noun": "NN", "verb": "VB", "adj": "JJ", "adv": "RB", "det": "DT", "adp": "IN", "pron": "PRP", "conj": "CC", "prt": "RP", "num": "CD", "x": "FW",
    "jj": "JJ", "jjt": "JJR", "jjs": "JJS", "nn": "NN", "nns": "NNS", "np": "NNP", "nps": "NNPS",
    "vb": "VB", "vbd": "VBD", "vbg": "VBG", "vbn": "VBN", "vbz": "VBZ", "md": "MD", "rb": "RB", "rbr": "RBR", "rbs": "RBS",
    "pp$": "PRP$", "ppo": "PRP", "pn": "PRP", "at": "DT", "dt": "DT", "cc": "CC", "in": "IN", "rp": "RP", "to": "TO", "pos": "POS", "uh": "UH", "cd": "CD", "fw": "FW", "ex": "EX",
    "wdt": "WDT", "wp": "WP", "wpo": "WP", "wrb": "WRB", "wq": "WP", ".": ".", ",": ",", ":": ":", ";": ":", "(": "-LRB-", ")": "-RRB-",
}


def reconcile(tags: Column, parser_tags: Column) -> Column:
    """Array of treebank tags: the parser's where it has one. Arrays of different lengths are an error."""
    table = F.create_map(*[F.lit(x) for kv in TREEBANK_TAGS.items() for x in kv])
    merged = F.transform(F.arrays_zip(tags.alias("t"), parser_tags.alias("p")), lambda s: F.coalesce(F.nullif(s["p"], F.lit("")), F.try_element_at(table, F.lower(s["t"])), F.upper(s["t"])))
    return F.when(F.size(tags) == F.size(parser_tags), merged).otherwise(F.raise_error(F.lit("tag sequences must have the same length")))


def boundaries(tokens: Column) -> Column:
    """Places of the cuts between tokens, in characters."""
    run = F.aggregate(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("cuts")), lambda acc, t: F.struct((acc["at"] + F.length(t)).alias("at"), F.concat(acc["cuts"], F.array(acc["at"] + F.length(t))).alias("cuts")))
    return run["cuts"]


def boundary_metrics(gold: Column, pred: Column) -> Column:
    """struct(p, r, f1, exact). No cuts on either side: all 1; on one side only: all 0."""
    g, q = F.size(gold), F.size(pred)
    hit = F.size(F.array_intersect(gold, pred)).cast("double")
    p = F.when((g == 0) & (q == 0), 1.0).when((g == 0) | (q == 0), 0.0).otherwise(hit / F.greatest(q, F.lit(1)))
    r = F.when((g == 0) & (q == 0), 1.0).when((g == 0) | (q == 0), 0.0).otherwise(hit / F.greatest(g, F.lit(1)))
    return F.struct(p.alias("p"), r.alias("r"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), (gold == pred).alias("exact"))


def spans(rows: DataFrame, tokens: str, *keys: str) -> DataFrame:
    """(keys, pos, start, end, token): character spans in the unspaced string."""
    ends = F.concat(boundaries(F.col(tokens)), F.array(F.length(F.array_join(tokens, "")).cast("bigint")))
    zipped = F.arrays_zip(F.col(tokens).alias("token"), ends.alias("end"))
    x = F.col("x")
    return rows.select(*keys, F.posexplode(zipped).alias("pos", "x")).select(*keys, F.col("pos").cast("bigint"), (x["end"] - F.length(x["token"])).alias("start"), x["end"].alias("end"), x["token"].alias("token"))


def attribute(gold: DataFrame, pred: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, correct, tag_err, seg_err and rates) from (keys, start, end, tag) spans."""
    other = pred.select(*keys, "start", "end", F.col("tag").alias("pred_tag"), F.lit(1).alias("there"))
    joined = gold.join(other, [*keys, "start", "end"], "left")
    there, same = F.col("there").isNotNull(), F.col("tag") == F.col("pred_tag")
    out = joined.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(there & same).alias("correct"), F.count_if(there & ~same).alias("tag_err"), F.count_if(~there).alias("seg_err"))
    return out.select(*keys, "n", "correct", "tag_err", "seg_err", *[(F.col(c) / F.col("n")).alias(f"{c}_rate") for c in ("correct", "tag_err", "seg_err")])


def confusion(pairs: DataFrame, top: int = 8) -> DataFrame:
    """(gold, one column a label): counts over the ``top`` most frequent gold labels."""
    labels = [r["gold"] for r in pairs.groupBy("gold").count().orderBy(F.desc("count"), "gold").limit(top).collect()]
    kept = pairs.where(F.col("gold").isin(labels) & F.col("pred").isin(labels))
    return kept.groupBy("gold").pivot("pred", sorted(labels)).agg(F.count(F.lit(1))).na.fill(0)
