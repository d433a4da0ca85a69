"""N-gram count tables and the three language-model families over them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOS, EOS = "<BOS>", "<EOS>"
K = 0.05
FLOOR = 1e-30


def padded(words: Column) -> Column:
    return F.concat(F.array(F.lit(BOS), F.lit(BOS)), words, F.array(F.lit(EOS)))


def grams(p: Column, n: int) -> Column:
    """Array of structs w1..wn. Whole slices are zipped: in a lambda, ``p`` would be made again at each place."""
    return F.arrays_zip(*[F.slice(p, k + 1, F.size(p) - (n - 1)).alias(f"w{k + 1}") for k in range(n)])


def count_grams(sents: DataFrame, n: int) -> DataFrame:
    """(w or w1.., c): counts over sentences padded with two start marks and one end mark."""
    return padded_grams(sents, n).groupBy(*(["w"] if n == 1 else _names(n))).agg(F.count("*").alias("c"))


def padded_grams(sents: DataFrame, n: int) -> DataFrame:
    """(w or w1..): the n-grams of padded sentences, as often as they stand there."""
    padded_sents = sents.select(padded(F.col("words")).alias("p"))
    if n == 1:
        return padded_sents.select(F.explode("p").alias("w"))
    return padded_sents.select(F.explode(grams(F.col("p"), n)).alias("g")).select("g.*")


def _names(n: int) -> list[str]:
    return [f"w{i + 1}" for i in range(n)]


@dataclass
class CountTables:
    """``sents``: the sentences that were counted, if at hand; then what is asked for is counted with them and no whole table is joined.

    ``texts``: the same as ``corpus.marked`` texts, for those who count in kernels.
    """

    uni: DataFrame
    bi: DataFrame
    tri: DataFrame
    sents: DataFrame | None = None
    texts: DataFrame | None = None

    def of(self, asked: DataFrame, n: int) -> DataFrame:
        """(w1..wn, c): the distinct rows of ``asked`` with their counts, 0 for unseen ones."""
        names = _names(n)
        asked = asked.toDF(*names)
        if self.sents is None:
            table = (self.uni, self.bi, self.tri)[n - 1].toDF(*names, "c")
            return asked.distinct().join(table, names, "left").select(*names, F.coalesce("c", F.lit(0)).alias("c"))
        seen = padded_grams(self.sents, n).toDF(*names).select(*names, F.lit(1).cast("bigint").alias("c"), F.lit(False).alias("asked"))
        both = asked.select(*names, F.lit(0).cast("bigint").alias("c"), F.lit(True).alias("asked")).unionByName(seen)
        return both.groupBy(*names).agg(F.sum("c").alias("c"), F.max("asked").alias("asked")).where("asked").drop("asked")

    def stats(self) -> DataFrame:
        """One row: tokens, and types without the marks."""
        inner = ~F.col("w").isin(BOS, EOS)
        return self.uni.where(inner).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_tokens"), F.count("*").alias("n_types"))


def train(sents: DataFrame) -> CountTables:
    return CountTables(count_grams(sents, 1), count_grams(sents, 2), count_grams(sents, 3), sents)


def inject(uni: DataFrame, extra: DataFrame) -> DataFrame:
    """Counts with seed counts added."""
    return uni.unionByName(extra).groupBy("w").agg(F.sum("c").alias("c"))


def pair_counts(pairs: DataFrame, lm: CountTables) -> DataFrame:
    """(w1, w2, c_pair, c_one, c_uni) of the distinct pairs: counts of the pair, its first and its second word."""
    one, uni = lm.uni.toDF("w1", "c_one"), lm.uni.toDF("w2", "c_uni")
    return lm.of(pairs, 2).withColumnRenamed("c", "c_pair").join(one, "w1", "left").join(uni, "w2", "left").select("w1", "w2", "c_pair", F.coalesce("c_one", F.lit(0)).alias("c_one"), F.coalesce("c_uni", F.lit(0)).alias("c_uni"))


def triple_counts(triples: DataFrame, lm: CountTables, pairs: DataFrame | None = None) -> DataFrame:
    """(w1, w2, w3, c_tri, c_ctx, c_pair, c_one, c_uni, n_tokens, n_types) of the distinct triples: of w1 w2 w3, w1 w2, w2 w3, w2, w3 and the whole.

    ``pairs``: the neighbours in the triples, if they are cheaper to have.
    """
    triples = triples.toDF(*_names(3))
    if pairs is None:
        pairs = triples.select(F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("x")).select("x.*")
    ctx = lm.of(pairs, 2).withColumnRenamed("c", "c_ctx")
    pair = pair_counts(pairs, lm).select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), "c_pair", "c_one", "c_uni")
    return lm.of(triples, 3).withColumnRenamed("c", "c_tri").join(ctx, ["w1", "w2"], "left").join(pair, ["w2", "w3"], "left").crossJoin(F.broadcast(lm.stats()))  # one row


def _penalised(k: float) -> tuple[Column, Column]:
    """(branch, logprob) over the columns of ``triple_counts``: add-k, backing off with penalties 1 and 2."""
    v = (F.col("n_types") + 1).cast("double")

    def p(c, n):
        return F.ln((F.coalesce(F.col(c), F.lit(0)) + F.lit(k)) / (n + F.lit(k) * v))

    branch = F.when(F.col("c_ctx") > 0, "trigram").when(F.col("c_one") > 0, "bigram").otherwise("unigram")
    value = F.when(F.col("c_ctx") > 0, p("c_tri", F.col("c_ctx"))).when(F.col("c_one") > 0, p("c_pair", F.col("c_one")) - 1.0).otherwise(p("c_uni", F.col("n_tokens")) - 2.0)
    return branch, value


def _smoothed_pair(k: float) -> Column:
    """Probability of the pair's second word over the columns of ``pair_counts`` and the whole's; unseen contexts fall back on the unigram without a penalty."""
    v = F.greatest(F.col("n_types") + 2, F.lit(1)).cast("double")
    return F.when(F.col("c_one") > 0, (F.col("c_pair") + F.lit(k)) / (F.col("c_one") + F.lit(k) * v)).otherwise((F.col("c_uni") + F.lit(k)) / (F.col("n_tokens") + F.lit(k) * v))


def trigram_log_prob(rows: DataFrame, lm: CountTables, k: float = K) -> DataFrame:
    """(w_prev2, w_prev1, w, branch, logprob) of the distinct rows: ``w`` given ``w_prev2 w_prev1``; add-k, backing off with penalties 1 and 2."""
    branch, value = _penalised(k)
    found = triple_counts(rows.select("w_prev2", "w_prev1", "w"), lm)
    return found.select(F.col("w1").alias("w_prev2"), F.col("w2").alias("w_prev1"), F.col("w3").alias("w"), branch.alias("branch"), value.alias("logprob"))


def smoothed_unigram(rows: DataFrame, lm: CountTables, k: float = K) -> DataFrame:
    """Adds ``prob`` of ``w2``; the vocabulary holds both marks."""
    out = rows.join(lm.uni.select(F.col("w").alias("w2"), F.col("c").alias("c_uni")), "w2", "left").crossJoin(F.broadcast(lm.stats()))
    v = F.greatest(F.col("n_types") + 2, F.lit(1)).cast("double")
    return out.withColumn("prob", (F.coalesce("c_uni", F.lit(0)) + F.lit(k)) / (F.col("n_tokens") + F.lit(k) * v)).drop("c_uni", "n_tokens", "n_types")


def smoothed_bigram(rows: DataFrame, lm: CountTables, k: float = K) -> DataFrame:
    """(w1, w2, prob) of the distinct rows: ``w2`` after ``w1``; unseen contexts fall back on the unigram without a penalty."""
    return pair_counts(rows.select("w1", "w2"), lm).crossJoin(F.broadcast(lm.stats())).select("w1", "w2", _smoothed_pair(k).alias("prob"))


def _smoothed_triple(k: float) -> Column:
    v = F.greatest(F.col("n_types") + 2, F.lit(1)).cast("double")
    return F.when(F.col("c_ctx") > 0, (F.col("c_tri") + F.lit(k)) / (F.col("c_ctx") + F.lit(k) * v)).otherwise(_smoothed_pair(k))


def smoothed_trigram(rows: DataFrame, lm: CountTables, k: float = K, pairs: DataFrame | None = None) -> DataFrame:
    """(w1, w2, w3, prob) of the distinct rows: ``w3`` after ``w1 w2``; unseen contexts fall back on the bigram ``w2 w3``."""
    return triple_counts(rows.select(*_names(3)), lm, pairs).select(*_names(3), _smoothed_triple(k).alias("prob"))


def sentence_grams(sents: DataFrame, n: int) -> DataFrame:
    """(doc_id, sent_id, n_words, w1..wn): the n-grams that score a sentence, with n - 1 start marks and the end mark."""
    p = F.concat(F.array_repeat(F.lit(BOS), n - 1), F.col("words"), F.array(F.lit(EOS)))
    lines = sents.select("doc_id", "sent_id", F.size("words").cast("bigint").alias("n_words"), p.alias("p"))
    return lines.select("doc_id", "sent_id", "n_words", F.explode(grams(F.col("p"), n)).alias("g")).select("doc_id", "sent_id", "n_words", "g.*")


def _summed(sents: DataFrame, probs: DataFrame, order: int, *values: str) -> DataFrame:
    """(doc_id, sent_id, n_words, values): sums over the n-grams of each sentence."""
    names = _names(order)
    return sentence_grams(sents, order).join(probs.select(*names, *values), names).groupBy("doc_id", "sent_id", "n_words").agg(*[F.sum(v).alias(v) for v in values])


def score_smoothed(sents: DataFrame, lm: CountTables, order: int, k: float = K) -> DataFrame:
    """(doc_id, sent_id, logprob, ppl): floored log probability, and exp of minus its mean a word (infinite from 700 on)."""
    asked = sentence_grams(sents, order).select(*_names(order))
    # distinct n-grams are scored once and joined back
    scored = smoothed_bigram(asked, lm, k) if order == 2 else smoothed_trigram(asked, lm, k, padded_grams(sents, 2))
    sums = _summed(sents, scored.withColumn("logprob", F.ln(F.greatest("prob", F.lit(FLOOR)))), order, "logprob")
    mean = F.col("logprob") / F.col("n_words")
    ppl = F.when(mean <= -700, F.lit(float("inf"))).otherwise(F.exp(-mean))
    return sums.select("doc_id", "sent_id", "logprob", ppl.alias("ppl"), "n_words")


def score_trigram_q1(sents: DataFrame, lm: CountTables, k: float = K) -> DataFrame:
    """(doc_id, sent_id, total, avg) under the penalised back-off model, end mark included; avg is a word."""
    scored = triple_counts(sentence_grams(sents, 3).select(*_names(3)), lm, padded_grams(sents, 2)).withColumn("total", _penalised(k)[1])
    sums = _summed(sents, scored, 3, "total")
    return sums.select("doc_id", "sent_id", "total", (F.col("total") / F.col("n_words")).alias("avg"), "n_words")


def score_both(sents: DataFrame, lm: CountTables, k: float = K) -> DataFrame:
    """(doc_id, sent_id, n_words, bigram, trigram): the log probability of ``score_smoothed`` of order 2 and the total of ``score_trigram_q1``, in one pass.

    A sentence's bigrams are the last two words of its trigrams, so the counts of a trigram tell both.
    """
    scored = triple_counts(sentence_grams(sents, 3).select(*_names(3)), lm, padded_grams(sents, 2))
    scored = scored.withColumns({"bigram": F.ln(F.greatest(_smoothed_pair(k), F.lit(FLOOR))), "trigram": _penalised(k)[1]})
    return _summed(sents, scored, 3, "bigram", "trigram")


def score_fallback(sents: DataFrame, context: float, k: float = K, v: int = 45000) -> DataFrame:
    """The constant score used without any model: every word is unseen after a context of that count."""
    n = F.size("words").cast("double")
    each = F.ln(F.lit(k) / (F.lit(context) + F.lit(k) * F.lit(float(v))))
    return sents.select("doc_id", "sent_id", (n * each).alias("total"), each.alias("avg"))


def cascade_bigram(sents: DataFrame, lm: CountTables | None = None, spelling: Callable[[DataFrame], DataFrame] | None = None, k: float = K) -> DataFrame:
    """(doc_id, sent_id, total, avg) by the first model at hand: smoothed bigrams, the spelling model's scores, the constant."""
    if lm is not None:
        return score_smoothed(sents, lm, 2, k).select("doc_id", "sent_id", F.col("logprob").alias("total"), (F.col("logprob") / F.col("n_words")).alias("avg"))
    return spelling(sents) if spelling is not None else score_fallback(sents, 100.0, k)


def cascade_trigram(sents: DataFrame, lm: CountTables | None = None, backoff: CountTables | None = None, k: float = K) -> DataFrame:
    """(doc_id, sent_id, total, avg) by the first model at hand: smoothed trigrams, the penalised back-off, the constant."""
    if lm is not None:
        return score_smoothed(sents, lm, 3, k).select("doc_id", "sent_id", F.col("logprob").alias("total"), (F.col("logprob") / F.col("n_words")).alias("avg"))
    return score_trigram_q1(sents, backoff, k).select("doc_id", "sent_id", "total", "avg") if backoff is not None else score_fallback(sents, 50.0, k)
