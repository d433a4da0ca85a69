"""Sentence verdicts: token streams to sentences, the three-tier decision rule, comparison tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlattice.functions import normalize as N

#: Least log probability a word for each tier.
PCFG_OUTLIER, TRIGRAM_GOOD, TRIGRAM_SPARSE, BIGRAM_GOOD, MISSING = -15.0, -8.8, -11.0, -8.5, -20.0


def token_sentences(events: DataFrame) -> DataFrame:
    """(doc_id, sent_id, text, n_tokens, num_merges, num_spells) from (doc_id, pos, token, alert) rows.

    A token that holds ``.``, ``!`` or ``?`` ends a sentence, as does the last. Sentences without a clean word are dropped.
    """
    ends = F.col("token").rlike("[.!?]").cast("bigint")
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    flat = events.withColumn("g", F.coalesce(F.sum(ends).over(before), F.lit(0))).withColumnRenamed("pos", "i")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("i", "token"))), lambda s: s["token"])
    clean = F.size(F.flatten(F.collect_list(N.clean_words(F.col("token"))))).cast("bigint")
    grouped = flat.groupBy("doc_id", "g").agg(N.tidy_spacing(N.strip(F.array_join(texts, " "))).alias("text"), clean.alias("n_tokens"), F.count_if(F.contains("alert", F.lit("[SEGMENT-ALERT]"))).alias("num_merges"), F.count_if(F.contains("alert", F.lit("[SPELL-ALERT]"))).alias("num_spells"))
    kept = grouped.where("n_tokens > 0 and text <> ''")
    numbered = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("g", "text", "n_tokens", "num_merges", "num_spells"))).alias("s")).select("doc_id", F.posexplode("s").alias("sent_id", "s"))
    return numbered.select("doc_id", F.col("sent_id").cast("bigint"), "s.text", "s.n_tokens", "s.num_merges", "s.num_spells")


def decide(pcfg: Column, trigram: Column, bigram: Column, n_tokens: Column) -> Column:
    """struct(method, verdict) from total scores; null scores count as -20 a word, a null parse score goes to the next tier."""
    n = F.greatest(n_tokens, F.lit(1)).cast("double")
    tri = F.coalesce(trigram / n, F.lit(MISSING))
    bi = F.coalesce(bigram / n, F.lit(MISSING))

    def said(method, verdict):
        return F.struct(F.lit(method).alias("method"), F.lit(verdict).alias("verdict"))

    return (
        F.when(pcfg / n >= PCFG_OUTLIER, said("PCFG", "Grammatical"))
        .when(tri >= TRIGRAM_GOOD, said("Trigram LM", "Grammatical"))
        .when(tri >= TRIGRAM_SPARSE, said("Trigram LM", "Questionable"))
        .when(bi >= BIGRAM_GOOD, said("Bigram LM", "Grammatical"))
        .otherwise(said("Bigram LM", "Ungrammatical"))
    )


def comparison_table(scored: DataFrame) -> DataFrame:
    """The eight result columns from (sentence_text, n_tokens, pcfg, bigram, trigram, num_merges, num_spells, ids).

    Scores are rounded to 4 places before the rule sees them, and a score of exactly 0 counts as missing.
    """
    def value(c):
        return F.nullif(F.round(c, 4), F.lit(0.0))

    keys = [c for c in ("doc_id", "sent_id") if c in scored.columns]
    rounded = scored.withColumns({c: value(c) for c in ("pcfg", "bigram", "trigram")})
    verdict = decide(F.col("pcfg"), F.col("trigram"), F.col("bigram"), F.col("n_tokens"))
    return rounded.withColumn("v", verdict).select(
        *keys, "sentence_text", F.when(F.col("pcfg").isNull(), "Unparseable").otherwise(F.format_string("%.4f", "pcfg")).alias("pcfg_result"), F.col("bigram").alias("bigram_score"), F.col("trigram").alias("trigram_score"),
        F.col("v.method").alias("chosen_method"), F.col("v.verdict").alias("final_verdict"), F.coalesce("num_merges", F.lit(0)).cast("bigint").alias("num_merges"), F.coalesce("num_spells", F.lit(0)).cast("bigint").alias("num_spells"),
    )


def summary(table: DataFrame) -> DataFrame:
    verdicts = [F.count_if(F.col("final_verdict") == v).alias(v.lower()) for v in ("Grammatical", "Questionable", "Ungrammatical")]
    return table.agg(F.count("*").alias("total"), *verdicts, F.coalesce(F.sum("num_merges"), F.lit(0)).alias("merges"), F.coalesce(F.sum("num_spells"), F.lit(0)).alias("spells"))
