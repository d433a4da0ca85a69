"""Registered queries over whole tables, by key. Counts are bigint, fractions are rounded to 6 places."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlattice.functions import normalize as N
from textlattice.operators import benchmark, depparse, editor, gramkeys, ngram, passage, pcfg, segment, spelling, tagging
from textlattice.sources import corpus
from textlattice.sources.registry import Registry, export_models
from textlattice.sources.tables import read_table, shared_folder
from textlattice.streaming.editor_stream import editor_stream as run_editor_stream

from . import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def long(c) -> object:
    return c.cast("bigint")


def r6(c) -> object:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def docs(spark, d, lang=None) -> DataFrame:
    found = read_table(spark, d, "documents")
    return found if lang is None else found.where(F.col("lang") == lang)


def sents(spark, d) -> DataFrame:
    return corpus.sentences(docs(spark, d, "en"))


def _train_condition(spark, d):
    return corpus.prefix_condition(corpus.sentence_counts(docs(spark, d, "en")))


def split(spark, d, *more: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, sent_id, words and ``more``) of the first 80 % of sentences and of the others; the texts are cut once."""
    s = _written(corpus.sentence_words(docs(spark, d, "en"), "text" in more).select("doc_id", "sent_id", "words", *more), "sentences")
    cond = corpus.prefix_condition(s.groupBy("doc_id").agg(F.count("*").alias("n")))
    return s.where(cond), s.where(~cond)


def model(train) -> ngram.CountTables:
    """The language model of sentences that ``split`` has written; its words are counted once."""
    lm = ngram.train(train)
    return replace(lm, uni=_written(lm.uni, "unigrams"))


def beam_model(spark, d) -> ngram.CountTables:
    """``model`` of the training sentences of ``split`` for the beam decoder: their texts are written as such and counted in kernels."""
    texts = corpus.marked_prefix(_written(corpus.marked(docs(spark, d, "en")), "marked"))
    line = F.explode(F.split("marked", N.SENTENCE_MARK)).alias("line")
    lm = ngram.train(texts.select(line).select(F.split("line", " ").alias("words")))
    return replace(lm, uni=_written(gramkeys.count_words(texts), "unigrams"), texts=texts)


def vocab(spark, d) -> DataFrame:
    return spelling.vocabulary(spelling.alpha_stream(docs(spark, d, "en")))


def _written(df, name) -> DataFrame:
    """The rows as a table in the shared folder, so that what is read several times is computed once and outlives executors."""
    at = shared_folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _vocab_once(spark, d) -> DataFrame:
    """``vocab`` for plans that join it several times: the texts are read once."""
    return _written(vocab(spark, d), "vocab")


# -- normalisation and corpora


@query
def clean_ascii(spark, d):
    return docs(spark, d, "en").select(F.explode(N.clean_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query
def clean_unicode(spark, d):
    w = docs(spark, d).select("lang", F.explode(N.clean_words(F.col("text"), N.clean_unicode)).alias("w"))
    return w.groupBy("lang", "w").agg(F.count("*").alias("c")).groupBy("lang").agg(F.sum("c").alias("n_tokens"), F.count("*").alias("n_types"))


@query
def corpus_clean_en(spark, d):
    return docs(spark, d, "en").select("doc_id", long(F.size(N.clean_words(F.col("text")))).alias("n_tokens"))


@query
def corpus_clean_es(spark, d):
    w = N.clean_words(F.col("text"), N.clean_spanish)
    return docs(spark, d, "es").select("doc_id", long(F.size(w)).alias("n_tokens"), long(F.length(F.array_join(w, ""))).alias("n_chars"))


@query
def corpus_split_80_20(spark, d):
    s = sents(spark, d)
    return s.groupBy(F.when(_train_condition(spark, d), "train").otherwise("test").alias("split")).agg(F.count("*").alias("n_sents"), long(F.sum(F.size("words"))).alias("n_tokens"))


@query
def sentence_split_text(spark, d):
    return corpus.sentences(docs(spark, d)).select("doc_id", "sent_id", "text")


@query
def sentence_split_tokens(spark, d):
    events = spark.createDataFrame([(0, i, t, a) for i, (t, a) in enumerate(fixtures.EVENTS)], "doc_id bigint, pos bigint, token string, alert string")
    words = docs(spark, d).select((F.col("doc_id") + 1).alias("doc_id"), F.posexplode(N.words(F.col("text"))).alias("pos", "token")).select("doc_id", long(F.col("pos")).alias("pos"), "token", F.lit(None).cast("string").alias("alert"))
    return passage.token_sentences(events.unionByName(words))


@query
def filter_alnum_tokens(spark, d):
    kept = F.size(N.alnum_words(F.col("text")))
    return docs(spark, d).select("doc_id", long(kept).alias("n_kept"), long(F.size(N.words(F.col("text"))) - kept).alias("n_dropped"))


@query
def cli_tokenize(spark, d):
    return read_table(spark, d, "conversations").select("conv_id", "turn", long(F.size(N.cli_tokens(F.col("text")))).alias("n_tokens"))


@query
def cli_detokenize(spark, d):
    return read_table(spark, d, "conversations").select("conv_id", "turn", N.cli_join(N.cli_tokens(F.col("text"))).alias("text"))


@query
def morph_tag_compose(spark, d):
    c = corpus.conllu(fixtures.conllu_frame(spark)).where("upos <> 'PUNCT'")
    return c.select("sent_id", "id", corpus.morph_tag(F.col("upos"), F.col("feats")).alias("tag"))


@query
def conllu_parse(spark, d):
    return corpus.conllu(fixtures.conllu_frame(spark)).select("sent_id", "id", "form", "upos", "head", "deprel")


@query
def passage_sample(spark, d):
    return corpus.sample_passages(sents(spark, d))


@query
def adjacent_pairs(spark, d):
    return corpus.adjacent_pairs(sents(spark, d))


@query
def spell_vocab(spark, d):
    return vocab(spark, d)


@query
def seg_vocab_filter(spark, d):
    return spelling.segmentation_vocabulary(vocab(spark, d))


# -- n-gram models


@query
def ngram_unigrams(spark, d):
    return ngram.count_grams(split(spark, d)[0], 1)


@query
def ngram_bigrams(spark, d):
    return ngram.count_grams(split(spark, d)[0], 2)


@query
def ngram_trigrams(spark, d):
    return ngram.count_grams(split(spark, d)[0], 3)


@query
def ngram_from_lm(spark, d):
    s = ngram.train(split(spark, d)[0]).stats()
    return s.select((F.col("n_types") + 1).alias("v_q1"), F.greatest(F.col("n_types") + 2, F.lit(1)).alias("v_q4"), "n_tokens")


@query
def seed_injection(spark, d):
    extra = spark.createDataFrame([("despejado", 10)], "w string, c bigint")
    return ngram.inject(ngram.count_grams(split(spark, d)[0], 1), extra)


@query
def lm_logprob_q1(spark, d):
    train, test = split(spark, d)
    rows = ngram.sentence_grams(test, 3).select(F.col("w1").alias("w_prev2"), F.col("w2").alias("w_prev1"), F.col("w3").alias("w")).distinct()
    return ngram.trigram_log_prob(rows, model(train)).select("w_prev2", "w_prev1", "w", "branch", r6("logprob").alias("logprob"))


@query
def ng_unigram_prob(spark, d):
    train, test = split(spark, d)
    rows = ngram.sentence_grams(test, 2).select("w2").distinct()
    return ngram.smoothed_unigram(rows, model(train)).select(F.col("w2").alias("w"), F.round("prob", 12).alias("prob"))


@query
def ng_bigram_prob(spark, d):
    train, test = split(spark, d)
    return ngram.smoothed_bigram(ngram.sentence_grams(test, 2).select("w1", "w2").distinct(), model(train)).select("w1", "w2", F.round("prob", 12).alias("prob"))


@query
def ng_trigram_prob(spark, d):
    train, test = split(spark, d)
    return ngram.smoothed_trigram(ngram.sentence_grams(test, 3).select("w1", "w2", "w3").distinct(), model(train)).select("w1", "w2", "w3", F.round("prob", 12).alias("prob"))


def _scores(spark, d, order):
    train, test = split(spark, d)
    return ngram.score_smoothed(test, model(train), order).select("doc_id", "sent_id", F.round("logprob", 4).alias("logprob"), F.round(F.ln("ppl"), 4).alias("ln_ppl"))


@query
def ng_score_bigram(spark, d):
    return _scores(spark, d, 2)


@query
def ng_score_trigram(spark, d):
    return _scores(spark, d, 3)


@query
def ng_perplexity(spark, d):
    train, test = split(spark, d)
    lm = model(train)
    parts = [ngram.score_smoothed(test, lm, o).select(F.lit(o).cast("bigint").alias("order"), "ppl") for o in (2, 3)]
    return parts[0].unionByName(parts[1]).groupBy("order").agg(F.count("*").alias("n"), F.round(F.avg(F.ln("ppl")), 4).alias("mean_ln_ppl"))


@query
def score_trigram_q1(spark, d):
    train, test = split(spark, d)
    return ngram.score_trigram_q1(test, model(train)).select("doc_id", "sent_id", F.round("total", 4).alias("total"), F.round("avg", 4).alias("avg"))


@query
def score_bigram_q3(spark, d):
    test = split(spark, d)[1]
    return _q3(spark, d, test).select("doc_id", "sent_id", F.round("total", 4).alias("total"), F.round("avg", 4).alias("avg"))


def _q3(spark, d, test):
    """First word by unigram, then add-one bigrams without marks; floored."""
    stream = spelling.alpha_stream(docs(spark, d, "en"))
    v, pairs = spelling.vocabulary(stream), spelling.stream_bigrams(stream)
    w = F.col("words")
    rows = test.select("doc_id", "sent_id", F.size("words").alias("n_words"), F.explode(F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.struct(F.when(i > 0, F.get(w, F.greatest(i - 1, F.lit(0)))).alias("w1"), F.get(w, i).alias("w2")))).alias("x")).select("doc_id", "sent_id", "n_words", "x.*")
    probs = _q3_probs(rows.select("w1", "w2").distinct(), v, pairs).withColumnsRenamed({"w1": "x1", "w2": "x2"})
    joined = rows.join(probs, F.col("w1").eqNullSafe(F.col("x1")) & (F.col("w2") == F.col("x2")))
    sums = joined.groupBy("doc_id", "sent_id", "n_words").agg(F.sum(F.ln(F.greatest("prob", F.lit(1e-30)))).alias("total"))
    return sums.select("doc_id", "sent_id", "total", (F.col("total") / F.col("n_words")).alias("avg"))


def _q3_probs(rows, v, pairs):
    stats = v.agg(F.sum("n").alias("total"), F.count("*").alias("types"))
    out = rows.join(pairs.withColumnRenamed("c", "c2"), ["w1", "w2"], "left").join(v.select(F.col("word").alias("w1"), F.col("n").alias("c1")), "w1", "left").join(v.select(F.col("word").alias("w2"), F.col("n").alias("c0")), "w2", "left").crossJoin(F.broadcast(stats))
    two = (F.coalesce("c2", F.lit(0)) + 1).cast("double") / (F.coalesce("c1", F.lit(0)) + F.col("types"))
    return out.select("w1", "w2", F.when(F.col("w1").isNull(), F.coalesce("c0", F.lit(0)).cast("double") / F.col("total")).otherwise(two).alias("prob"))


@query
def score_fallback(spark, d):
    test = split(spark, d)[1]
    two, three = ngram.score_fallback(test, 100.0), ngram.score_fallback(test, 50.0).withColumnsRenamed({"total": "t3", "avg": "a3"})
    return two.join(three, ["doc_id", "sent_id"]).select("doc_id", "sent_id", r6("total").alias("bigram_total"), r6("t3").alias("trigram_total"))


@query
def spell_unigram_prob(spark, d):
    v = vocab(spark, d)
    return v.crossJoin(F.broadcast(v.agg(F.sum("n").alias("total")))).select("word", F.round(F.col("n") / F.col("total"), 12).alias("prob"))


@query
def spell_bigram_prob(spark, d):
    stream = spelling.alpha_stream(docs(spark, d, "en"))
    pairs = spelling.stream_bigrams(stream)
    return _q3_probs(pairs.select("w1", "w2"), spelling.vocabulary(stream), pairs).select("w1", "w2", F.round("prob", 12).alias("prob"))


# -- spelling


@query
def deletions(spark, d):
    return spelling.deletions(vocab(spark, d))


@query
def symdelete_index(spark, d):
    return spelling.deletions(vocab(spark, d)).groupBy("del").agg(F.count("*").alias("n_words"))


def mutated(v):
    op, word = spelling.mutate(F.col("word"), "q4")
    return v.select("word", op.alias("op"), word.alias("mutated"))


@query
def mutate_q4(spark, d):
    return mutated(vocab(spark, d))


@query
def mutate_q3(spark, d):
    v = vocab(spark, d)
    op, word = spelling.mistake(F.col("word"), "q3")
    return spelling.gate(v.select("word", op.alias("op"), word.alias("mutated")), v, False).select("word", "op", "mutated")


@query
def corrupt_words(spark, d):
    """Half of the words, by a hash, are mutated, half become the join of a pair that starts with them (the first by name)."""
    pairs = corpus.adjacent_pairs(sents(spark, d)).groupBy("left").agg(F.min("right").alias("right"))
    op, word = spelling.mutate(F.col("word"), "q4")
    merge = (N.hashed("corrupt", F.col("word")) % 2 == 0) & F.col("right").isNotNull()
    joined = vocab(spark, d).join(pairs, F.col("word") == F.col("left"), "left")
    return joined.select("word", F.when(merge, "merge").otherwise(op).alias("op"), F.when(merge, F.concat("word", "right")).otherwise(word).alias("mutated"))


def _queries(v):
    return mutated(v).select(F.col("mutated").alias("query")).where("query <> ''").distinct()


@query
def spell_candidates_a(spark, d):
    v = _vocab_once(spark, d)
    return spelling.candidates_a(_queries(v), v)


@query
def spell_candidates_b(spark, d):
    v = _vocab_once(spark, d)
    return spelling.candidates_b(_queries(v), v)


@query
def spell_correct_nonword(spark, d):
    v = _vocab_once(spark, d)
    q = _written(_queries(v), "queries")
    parts = [spelling.correct_non_word(q, v, f).select("query", F.lit(m).alias("method"), "correction") for m, f in (("A", spelling.best_a), ("B", spelling.best_b))]
    return parts[0].unionByName(parts[1])


def _conversation_words(spark, d):
    """(conv_id, turn, pos, token, word, prev). Whole arrays are zipped: in a lambda, a turn would be cut again at each of its words."""
    t = N.cli_tokens(F.col("text"))
    pairs = F.arrays_zip(t.alias("token"), F.slice(F.concat(F.array(F.lit(None).cast("string")), t), F.lit(1), F.size(t)).alias("before"))
    x = read_table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(pairs).alias("pos", "x"))
    return x.select("conv_id", "turn", long(F.col("pos")).alias("pos"), "x.token", F.lower("x.token").alias("word"), F.lower("x.before").alias("prev"))


def _real(spark, d, rows, v=None):
    pairs = spelling.stream_bigrams(spelling.alpha_stream(docs(spark, d, "en")))
    return spelling.correct_real_word(rows, _vocab_once(spark, d) if v is None else v, pairs)


@query
def spell_correct_realword(spark, d):
    rows = _conversation_words(spark, d).where(F.col("word").rlike(r"^\p{L}+$"))
    return _real(spark, d, rows).select("conv_id", "turn", "pos", "word", "correction")


@query
def spell_sentence(spark, d):
    """Words that are not alphabetic pass; unknown ones get a non-word correction, known ones a real-word one; changes are marked."""
    rows, v = _conversation_words(spark, d), _vocab_once(spark, d)
    alpha = F.col("word").rlike(r"^\p{L}+$")
    asked = rows.where(alpha).select(F.col("word").alias("query")).distinct()
    non = spelling.correct_non_word(asked, v).withColumnRenamed("correction", "non").withColumnRenamed("query", "qw")
    known = v.select(F.col("word").alias("kw"))
    real = _real(spark, d, rows.where(alpha), v).select("conv_id", "turn", "pos", F.col("correction").alias("real"))
    out = rows.join(known, F.col("word") == F.col("kw"), "left").join(non, F.col("word") == F.col("qw"), "left").join(real, ["conv_id", "turn", "pos"], "left")
    fixed = F.when(~alpha, F.col("word")).when(F.col("kw").isNull(), F.col("non")).otherwise(F.col("real"))
    changed = alpha & (fixed != F.col("word"))
    shown = F.when(changed, F.concat(F.lit("**"), fixed, F.lit("**"))).otherwise(F.col("token"))
    lines = out.groupBy("conv_id", "turn").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", shown.alias("t")))), lambda s: s["t"]).alias("t"), F.count_if(changed).alias("n_changed"))
    return lines.select("conv_id", "turn", N.cli_join(F.col("t")).alias("text"), "n_changed")


@query
def spell_accuracy(spark, d):
    """Share of non-word and real-word mistakes that method B restores (real words in no context)."""
    v = _vocab_once(spark, d)
    op, word = spelling.mistake(F.col("word"), "q3")
    made = v.select("word", word.alias("mutated"))
    non = spelling.gate(made, v, False).where("mutated <> word")
    q = non.select(F.col("mutated").alias("query")).distinct()
    first = non.join(spelling.correct_non_word(q, v), F.col("mutated") == F.col("query")).select(F.lit("nonword").alias("kind"), "word", "correction")
    real = spelling.gate(made, v, True).where("mutated <> word").select(F.col("word").alias("orig"), F.lit(None).cast("string").alias("prev"), F.col("mutated").alias("word"))
    second = _real(spark, d, real, v).select(F.lit("realword").alias("kind"), F.col("orig").alias("word"), "correction")
    return first.unionByName(second).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg((F.col("word") == F.col("correction")).cast("double")), 6).alias("accuracy"))


# -- segmentation


def merged(spark, d):
    c = read_table(spark, d, "conversations").withColumn("w", N.words(F.col("text")))
    x = c.select("conv_id", "turn", "w", F.posexplode(segment.typing_merges(F.col("w"), F.col("conv_id"), F.col("turn"))).alias("token_id", "x"))
    return x.select("conv_id", "turn", long(F.col("token_id")).alias("token_id"), "x.token", "x.n_words")


@query
def merge_generator(spark, d):
    return merged(spark, d)


def _merge_queries(spark, d):
    return segment.merged_words(read_table(spark, d, "conversations"), "conv_id", "turn")


@query
def segment_greedy(spark, d):
    return segment.segment_greedy(_merge_queries(spark, d), spelling.segmentation_vocabulary(vocab(spark, d))).select("s", F.array_join("tokens", " ").alias("tokens"))


@query
def segment_dp(spark, d):
    lm = ngram.train(fixtures.toy_sentences(spark))
    strings = spark.createDataFrame([(s,) for s in fixtures.TOY_STRINGS], "s string")
    return segment.segment_beam(strings, lm).select("s", F.array_join("tokens", " ").alias("tokens"), r6("score").alias("score"))


@query
def segment_dp_merged(spark, d):
    """``segment_dp``, whose SQL is of toy strings, over all merged tokens under the trained model."""
    return segment.segment_beam(_merge_queries(spark, d), beam_model(spark, d)).select("s", F.array_join("tokens", " ").alias("tokens"), r6("score").alias("score"))


def _gold_pred(spark, d):
    c = read_table(spark, d, "conversations").withColumn("gold", N.words(F.col("text")))
    return c.withColumn("pred", F.transform(segment.typing_merges(F.col("gold"), F.col("conv_id"), F.col("turn")), lambda x: x["token"]))


@query
def seg_boundaries(spark, d):
    return _gold_pred(spark, d).select("conv_id", "turn", F.array_join(tagging.boundaries(F.col("pred")), ",").alias("cuts"))


@query
def seg_metrics(spark, d):
    m = tagging.boundary_metrics(tagging.boundaries(F.col("gold")), tagging.boundaries(F.col("pred")))
    return _gold_pred(spark, d).select("conv_id", "turn", m.alias("m")).select("conv_id", "turn", r6("m.p").alias("p"), r6("m.r").alias("r"), r6("m.f1").alias("f1"), "m.exact")


# -- tagging


def seq(spark, d):
    return tagging.sequences(read_table(spark, d, "events"))


def _halves(spark, d):
    s = seq(spark, d)
    return s.where("user_id % 5 <> 0"), s.where("user_id % 5 = 0")


@query
def mft_train(spark, d):
    return tagging.train_mft(_halves(spark, d)[0])[0]


def _mft(spark, d):
    train, test = _halves(spark, d)
    return tagging.predict_mft(test, *tagging.train_mft(train))


@query
def mft_predict(spark, d):
    return _mft(spark, d).select("user_id", "pos", "pred")


@query
def hmm_transitions(spark, d):
    return tagging.transitions(seq(spark, d))


@query
def hmm_emissions(spark, d):
    return tagging.emissions(seq(spark, d))


@query
def hmm_transition_logprob(spark, d):
    return tagging.transition_log_probs(tagging.transitions(seq(spark, d))).select("prev", "cur", r6("logprob").alias("logprob"))


@query
def hmm_emission_logprob(spark, d):
    return tagging.emission_log_probs(tagging.emissions(seq(spark, d))).select("tag", "word", r6("logprob").alias("logprob"))


@query
def hmm_viterbi(spark, d):
    s = seq(spark, d)
    lines = s.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("words"))
    return tagging.decode(lines, tagging.transitions(s), tagging.emissions(s)).select("user_id", "pos", "pred_tag", F.round("best_score", 4).alias("best_score"))


@query
def agreement_ratio(spark, d):
    p = tagging.transition_log_probs(tagging.transitions(seq(spark, d))).where(F.col("prev") != tagging.START)
    a, b = p.select("prev", F.col("cur").alias("cur_a"), F.col("logprob").alias("la")), p.select("prev", F.col("cur").alias("cur_b"), F.col("logprob").alias("lb"))
    return a.join(b, "prev").where("cur_a <> cur_b").select("prev", "cur_a", "cur_b", r6(F.exp(F.col("la") - F.col("lb"))).alias("ratio"))


@query
def reconcile_tags(spark, d):
    rows = spark.createDataFrame([(["NOUN", "at", "zz", "("], ["", "DT", None, None])], "hmm array<string>, pcfg array<string>")
    x = rows.select(F.posexplode(F.arrays_zip(F.col("hmm").alias("hmm_tag"), F.col("pcfg").alias("pcfg_tag"), tagging.reconcile(F.col("hmm"), F.col("pcfg")).alias("tag"))).alias("pos", "x"))
    return x.select(long(F.col("pos")).alias("pos"), "x.hmm_tag", "x.pcfg_tag", "x.tag")


@query
def token_spans(spark, d):
    return tagging.spans(_gold_pred(spark, d), "pred", "conv_id", "turn").select("conv_id", "turn", "pos", "start", "end", "token")


@query
def error_attribution(spark, d):
    g = _gold_pred(spark, d)
    tag = F.when(F.length("token") > 4, "long").otherwise("short")
    gold = tagging.spans(g, "gold", "conv_id", "turn").withColumn("tag", tag)
    pred = tagging.spans(g, "pred", "conv_id", "turn").withColumn("tag", F.when(F.length("token") > 5, "long").otherwise("short"))
    out = tagging.attribute(gold, pred, "conv_id", "turn")
    return out.select("conv_id", "turn", "n", "correct", "tag_err", "seg_err", *[r6(f"{c}_rate").alias(f"{c}_rate") for c in ("correct", "tag_err", "seg_err")])


def _segmented(test, words, cut, trans, emit, name):
    """(metric, value) for each sequence: boundary metrics of the cuts of its unspaced words, and attribution after HMM tagging of them."""
    gold = words.select("user_id", F.col("words").alias("gold"), F.array_join("words", "").alias("s"))
    both = gold.join(cut.select("s", F.col("tokens").alias("pred")), "s")
    m = tagging.boundary_metrics(tagging.boundaries(F.col("gold")), tagging.boundaries(F.col("pred")))
    seg = {"precision": F.col("m.p"), "recall": F.col("m.r"), "f1": F.col("m.f1"), "exact": F.col("m.exact").cast("double")}
    tagged = tagging.decode(both.select("user_id", F.col("pred").alias("words")), trans, emit).select("user_id", "pos", F.col("pred_tag").alias("tag"))
    pred = tagging.spans(both, "pred", "user_id").join(tagged, ["user_id", "pos"])
    true = tagging.spans(gold, "gold", "user_id").join(test.select("user_id", "pos", "tag"), ["user_id", "pos"])
    rates = {"accuracy": F.col("correct_rate"), "tag_err": F.col("tag_err_rate"), "seg_err": F.col("seg_err_rate")}
    parts = ((both.select(m.alias("m")), seg, f"{name}_"), (tagging.attribute(true, pred, "user_id"), rates, f"{name}_hmm_"))
    long_rows = [rows.select(F.explode(F.array(*[F.struct(F.lit(prefix + k).alias("metric"), v.alias("value")) for k, v in of.items()])).alias("x")).select("x.*") for rows, of, prefix in parts]
    return long_rows[0].unionByName(long_rows[1])


@query
def tagging_benchmark(spark, d):
    """Macro means over held-out sequences: MFT and HMM accuracy on gold words; for the greedy and the DP segmenter on
    the unspaced words, boundary metrics, and end-to-end accuracy and error rates with the HMM. ``typing_f1`` is of the typing merges."""
    train, test = _halves(spark, d)
    mft = _mft(spark, d).groupBy("user_id").agg(F.avg((F.col("pred") == F.col("tag")).cast("double")).alias("a")).select(F.lit("mft_accuracy").alias("metric"), F.col("a").alias("value"))
    trans, emit = tagging.transitions(train), tagging.emissions(train)
    lines = _lines(test)
    hmm = tagging.decode(lines, trans, emit).join(test, ["user_id", "pos"]).groupBy("user_id").agg(F.avg((F.col("pred_tag") == F.col("tag")).cast("double")).alias("a")).select(F.lit("hmm_accuracy").alias("metric"), F.col("a").alias("value"))
    seg = seg_metrics(spark, d).select(F.lit("typing_f1").alias("metric"), F.col("f1").alias("value"))
    out = mft.unionByName(hmm).unionByName(seg)
    lexicon = train.select("word").distinct()
    strings = lines.select(F.array_join("words", "").alias("s"))
    cuts = {"greedy": segment.segment_greedy(strings, lexicon), "dp": segment.segment_beam(strings, ngram.train(_lines(train)))}
    for name, cut in cuts.items():
        out = out.unionByName(_segmented(test, lines, cut, trans, emit, name))
    return out.groupBy("metric").agg(F.round(F.avg("value"), 4).alias("value"))


def _lines(rows):
    return rows.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("words"))


@query
def confusion_matrix(spark, d):
    return tagging.confusion(_mft(spark, d).select(F.col("tag").alias("gold"), "pred"))


# -- dependency parsing


def _steps(spark):
    return depparse.transitions(corpus.conllu(fixtures.conllu_frame(spark)))


@query
def arc_oracle(spark, d):
    return _steps(spark).select("sent_id", "step", "action")


@query
def arc_features(spark, d):
    return _steps(spark).select("sent_id", "step", *depparse.FEATURES)


@query
def action_distribution(spark, d):
    return depparse.action_distribution(_steps(spark))


@query
def arc_onehot(spark, d):
    return depparse.one_hot(_steps(spark))


def _classifier(spark):
    steps = depparse.transitions(fixtures.treebank_frame(spark))
    return steps, *depparse.fit_classifier(steps)


@query
def arc_classifier(spark, d):
    steps, fitted, labels = _classifier(spark)
    return depparse.accuracy(fitted, labels, steps).select("n", r6("accuracy").alias("accuracy"))


@query
def arc_top3(spark, d):
    steps, fitted, labels = _classifier(spark)
    return depparse.ranked(fitted, labels, steps).where("rank <= 3").withColumn("p", F.round("p", 3))


@query
def arc_parse(spark, d):
    steps, fitted, labels = _classifier(spark)
    return depparse.parse_sentences(fixtures.treebank_frame(spark), fitted, labels)


@query
def uas_las(spark, d):
    gold = corpus.conllu(fixtures.conllu_frame(spark)).where("sent_id = 0")
    pred = gold.select("sent_id", "id", F.when(F.col("id") == 4, 3).otherwise(F.col("head")).alias("head"), F.when(F.col("id") == 6, "obj").otherwise(F.col("deprel")).alias("deprel"))
    return depparse.attachment(gold, pred).select("n", r6("uas").alias("uas"), r6("las").alias("las"))


# -- grammars


@query
def pcfg_rules(spark, d):
    return pcfg.rules(fixtures.trees_frame(spark)).select("lhs", F.array_join("rhs", " ").alias("rhs"), "c", r6("prob").alias("prob"))


@query
def pcfg_rule_kinds(spark, d):
    return pcfg.kinds(pcfg.rules(fixtures.trees_frame(spark))).groupBy("kind").agg(F.count("*").alias("n"))


def _parses(spark):
    s = spark.createDataFrame([(i, t.split()) for i, t in enumerate(fixtures.PARSE_SENTENCES)], "sent_id bigint, words array<string>")
    return pcfg.parse_sentences(s, fixtures.grammar_frame(spark))


@query
def cky_parse(spark, d):
    return _parses(spark).select("sent_id", F.col("tree").isNotNull().alias("parsed"))


@query
def cky_tree(spark, d):
    return _parses(spark).select("sent_id", "tree")


@query
def cky_logprob(spark, d):
    return _parses(spark).select("sent_id", r6("logprob").alias("logprob"))


@query
def pcfg_score(spark, d):
    return _parses(spark).select("sent_id", pcfg.display(F.col("logprob")).alias("display"))


# -- verdicts


def scored(spark, d):
    train, test = split(spark, d, "text")
    both = ngram.score_both(test, model(train)).withColumnRenamed("n_words", "n_tokens")
    parses = pcfg.found_parses(test, fixtures.grammar_frame(spark), "S", "doc_id", "sent_id").select("doc_id", "sent_id", F.col("logprob").alias("pcfg"))
    texts = test.select("doc_id", "sent_id", F.col("text").alias("sentence_text"))
    out = texts.join(both, ["doc_id", "sent_id"]).join(parses, ["doc_id", "sent_id"], "left")
    return out.select("doc_id", "sent_id", "sentence_text", "n_tokens", "pcfg", "bigram", "trigram", F.lit(0).alias("num_merges"), F.lit(0).alias("num_spells"))


@query
def decision_rule(spark, d):
    v = passage.decide(F.col("pcfg"), F.round("trigram", 4), F.round("bigram", 4), F.col("n_tokens"))
    return scored(spark, d).select("doc_id", "sent_id", v.alias("v")).select("doc_id", "sent_id", "v.method", "v.verdict")


@query
def comparison_table(spark, d):
    return passage.comparison_table(scored(spark, d))


@query
def passage_analysis(spark, d):
    """Verdicts of held-out sentences under models trained on the first 80 % of sentences."""
    return passage.comparison_table(scored(spark, d)).select("doc_id", "sent_id", "bigram_score", "trigram_score", "chosen_method", "final_verdict")


@query
def verdict_summary(spark, d):
    return passage.summary(passage.comparison_table(scored(spark, d)))


@query
def parsed_verdicts(spark, d):
    """Verdicts of short sentences of which some parse under the fixture grammar, so that the rule's first tier runs."""
    return passage.comparison_table(fixtures.scored_frame(spark, _parses(spark))).select("sent_id", "pcfg_result", "chosen_method", "final_verdict")


@query
def score_cascade(spark, d):
    """Bigram and trigram scores of held-out sentences, each by the first model at hand: none for the first third of ids, one for the next."""
    train, test = split(spark, d)
    lm = model(train)
    third = F.pmod(F.col("doc_id"), F.lit(3))
    parts = []
    for k, smoothed, backoff in ((0, None, None), (1, None, lm), (2, lm, lm)):
        some = test.where(third == k)
        spell = None if k == 0 else (lambda rows: _q3(spark, d, rows))
        two = ngram.cascade_bigram(some, smoothed, spell).select("doc_id", "sent_id", F.col("total").alias("bigram_total"))
        three = ngram.cascade_trigram(some, smoothed, backoff).select("doc_id", "sent_id", F.col("total").alias("trigram_total"))
        parts.append(two.join(three, ["doc_id", "sent_id"]))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("doc_id", "sent_id", F.round("bigram_total", 4).alias("bigram_total"), F.round("trigram_total", 4).alias("trigram_total"))


# -- editor


def checked(spark, d):
    lm = model(split(spark, d)[0])
    v = _vocab_once(spark, d)
    tokens = merged(spark, d).select(F.col("conv_id"), "turn", F.col("token_id").alias("pos"), "token")
    return editor.check_tokens(tokens, spelling.segmentation_vocabulary(v), v, lm), lm, v


@query
def editor_token_check(spark, d):
    return checked(spark, d)[0].select("conv_id", "turn", "pos", "token", "corrected", "alert_kind")


@query
def segment_then_spell(spark, d):
    v = _vocab_once(spark, d)
    lm = model(split(spark, d)[0])
    tokens = merged(spark, d).select("conv_id", "turn", F.col("token_id").alias("pos"), "token")
    return editor.check_tokens(tokens, v, v, lm, restore=False).select("conv_id", "turn", "pos", "token", "corrected")


def _as_lines(rows):
    """Turns of a conversation as one stream of tokens."""
    return rows.withColumn("doc_id", F.col("conv_id")).withColumn("pos", F.col("turn") * 1_000_000 + F.col("pos"))


def _windows(spark, d):
    tokens = _as_lines(merged(spark, d).select("conv_id", "turn", F.col("token_id").alias("pos"), F.col("token").alias("corrected")).withColumn("clean", N.clean_unicode(F.col("corrected"))))
    return editor.trigger_windows(tokens)


@query
def editor_trigger(spark, d):
    pairs = spelling.stream_bigrams(spelling.alpha_stream(docs(spark, d, "en")))
    out = editor.trigger_checks(_windows(spark, d), model(split(spark, d)[0]), _vocab_once(spark, d), pairs)
    return out.select(F.col("doc_id").alias("conv_id"), "pos", "window", r6("logprob").alias("logprob"), "alert")


@query
def grammar_trigger_score(spark, d):
    tokens = _as_lines(merged(spark, d).select("conv_id", "turn", F.col("token_id").alias("pos"), "token"))
    return editor.trigger_scores(tokens, model(split(spark, d)[0])).select(F.col("doc_id").alias("conv_id"), "pos", r6("logprob").alias("logprob"))


@query
def alert_console(spark, d):
    kinds = checked(spark, d)[0].where("alert_kind is not null").groupBy("alert_kind").agg(F.count("*").alias("n"))
    return kinds.select("alert_kind", editor.colour(F.col("alert_kind")).alias("colour"), "n")


@query
def editor_stream(spark, d):
    """The trigger windows of ``editor_trigger`` from a stream over the same tokens, read from the shared scratch folder until it is used up."""
    at = shared_folder(spark, "editor")
    tokens = _as_lines(merged(spark, d).select("conv_id", "turn", F.col("token_id").alias("pos"), F.col("token").alias("corrected")))
    rows = tokens.select("doc_id", "pos", "corrected", N.clean_unicode(F.col("corrected")).alias("clean"), F.lit(None).cast("string").alias("alert_kind"))
    rows.write.parquet(f"{at}/in")
    found = run_editor_stream(spark.readStream.schema(rows.schema).parquet(f"{at}/in"))
    found.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").where("window is not null").select(F.col("doc_id").alias("conv_id"), "pos", "window")


# -- registry


@query
def model_roundtrip(spark, d):
    registry = Registry(spark, shared_folder(spark, "models"))
    registry.save_counts("en", ngram.train(split(spark, d)[0]))
    back = registry.load_counts("en")
    parts = [t.agg(F.lit(n).alias("table"), F.count("*").alias("rows"), F.sum("c").alias("total")) for n, t in (("uni", back.uni), ("bi", back.bi), ("tri", back.tri))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def exported_models(spark, d):
    """Rows of each table of all models, trained and saved at once and read again."""
    train = split(spark, d)[0]
    found = export_models(Registry(spark, shared_folder(spark, "export")), train, spelling.alpha_stream(docs(spark, d, "en")), _halves(spark, d)[0], fixtures.trees_frame(spark))
    parts = [spark.read.parquet(path).agg(F.lit(name).alias("table"), F.count("*").alias("rows")) for name, path in found.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query
def conllu_files(spark, d):
    """Tagged sentences with morphology from CoNLL-U files, one for each split."""
    at = shared_folder(spark, "conllu")
    for name in ("train", "dev"):
        spark.createDataFrame([(fixtures.CONLLU,)], "value string").coalesce(1).write.text(f"{at}/{name}")
    found = corpus.tagged_sentences(corpus.conllu_files(spark, f"{at}/*/*.txt"), morphology=True)
    return found.groupBy("sent_id", F.array_join("words", " ").alias("words"), F.array_join("tags", " ").alias("tags")).agg(F.count("*").alias("files"))


@query
def pcfg_first_trees(spark, d):
    """The grammar of the first two trees as they are, without binary rules."""
    found = pcfg.rules(fixtures.trees_frame(spark), cnf=False, limit=2)
    return found.select("lhs", F.array_join("rhs", " ").alias("rhs"), "c", r6("prob").alias("prob"))


# -- the whole editor: checks, then triggers on corrected tokens, then alerts and verdicts


def _live(spark, d):
    """Typed tokens with their corrections, alerts and trigger alerts, in the order of their conversation."""
    found, lm, v = checked(spark, d)
    tokens = _written(_as_lines(found), "live")
    stream = spelling.alpha_stream(docs(spark, d, "en"))
    windows = editor.trigger_windows(tokens)
    fired = editor.trigger_checks(windows, lm, v, spelling.stream_bigrams(stream)).select("doc_id", "pos", F.col("alert").alias("trigger"))
    return tokens.select("doc_id", "pos", "token", "corrected", "alert_kind").join(fired, ["doc_id", "pos"], "left")


@query
def editor_live(spark, d):
    """Each typed token of the conversations: its correction, its alert and what the trigger said at it."""
    return _live(spark, d).select(F.col("doc_id").alias("conv_id"), "pos", "token", "corrected", "alert_kind", "trigger")


@query
def live_alert_console(spark, d):
    """Alerts of the whole editor by kind, grammar ones with them."""
    kind = F.explode(F.array_compact(F.array("alert_kind", F.when(F.col("trigger").isNotNull(), "GRAMMAR")))).alias("alert_kind")
    return _live(spark, d).select(kind).groupBy("alert_kind").agg(F.count("*").alias("n")).select("alert_kind", editor.colour(F.col("alert_kind")).alias("colour"), "n")


@query
def live_passages(spark, d):
    """Verdicts of the sentences of corrected tokens, with the merges and spelling changes in them."""
    found, lm, v = checked(spark, d)
    mark = F.when(F.col("alert_kind").isNotNull(), F.concat(F.lit("["), "alert_kind", F.lit("-ALERT]")))
    tokens = _as_lines(found).select("doc_id", "pos", F.col("corrected").alias("token"), mark.alias("alert"))
    sentences = _written(passage.token_sentences(tokens).withColumn("words", N.clean_words(F.col("text"))), "sentences")
    keys = ["doc_id", "sent_id"]
    both = ngram.score_both(sentences, lm).drop("n_words")
    parses = pcfg.found_parses(sentences, fixtures.grammar_frame(spark), "S", *keys).select(*keys, F.col("logprob").alias("pcfg"))
    rows = sentences.withColumnRenamed("text", "sentence_text").join(both, keys).join(parses, keys, "left")
    return passage.comparison_table(rows).select(*keys, "pcfg_result", "chosen_method", "final_verdict", "num_merges", "num_spells")


@query
def editor_benchmark(spark, d):
    """Pipeline A (cut, then spell) and B (grammar trigger) over corrupted words: tokens, seconds, milliseconds a token, within a frame or not."""
    v, words = _vocab_once(spark, d), _written(corrupt_words(spark, d).select("mutated"), "words")
    train = split(spark, d)[0]
    tokens = words.select(F.lit(0).cast("bigint").alias("doc_id"), F.xxhash64("mutated").alias("pos"), F.col("mutated").alias("token"))
    return benchmark.report(tokens, {
        "A": lambda lm: editor.check_tokens(tokens, v, v, lm, restore=False),
        "B": lambda lm: editor.trigger_scores(tokens, lm),
    }, model(train))
