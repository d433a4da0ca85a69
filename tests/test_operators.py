"""Goldens, enumeration and properties of the text-analytics operators."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlattice.functions import normalize as N
from textlattice.operators import depparse, editor, gramkeys, ngram, passage, pcfg, segment, spelling, tagging
from textlattice.plans import catalog, fixtures
from textlattice.sources import corpus
from textlattice.sources.registry import Registry
from textlattice.streaming.editor_stream import clean


@pytest.fixture(scope="session")
def toy(spark):
    return segment.collect_model(ngram.train(fixtures.toy_sentences(spark)))


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_cleaners(spark):
    assert one(spark, N.clean_ascii, "Éa-B1") == "ab1"
    assert one(spark, N.clean_unicode, "Éa-B1") == "éab1"
    assert one(spark, N.clean_spanish, "ÑÉçx!") == "ñéx"
    assert one(spark, N.alnum_words, "fox. Fox é1") == ["fox", "é1"]
    text = "I hav a good feeling about this."
    assert one(spark, N.cli_tokens, text) == ["I", "hav", "a", "good", "feeling", "about", "this", "."]
    assert one(spark, lambda c: N.cli_join(N.cli_tokens(c)), text) == text
    assert one(spark, N.sentence_texts, " One. Two!  three? ") == ["One.", "Two!", "three?"]
    assert [one(spark, N.is_title, w) for w in ("The", "THE", "the", "1")] == [True, False, False, False]


@pytest.mark.parametrize("text,tokens,score", [("thecatsat", "the cat sat", -1.65178), ("acatran", "a cat ran", -4.968537), ("thexcat", "the x cat", -21.753549)])
def test_beam_goldens(toy, text, tokens, score):
    found, value = segment.beam(text, toy)
    assert " ".join(found) == tokens and value == pytest.approx(score, abs=1e-6)


def test_beam_against_all_cuts(toy):
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice("thecasx") for _ in range(rng.randint(1, 9)))
        best = -math.inf
        for cuts in itertools.product((0, 1), repeat=len(text) - 1):
            words, at = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    words.append(text[at:i])
                    at = i
            words.append(text[at:])
            if any(len(w) > 1 and w not in toy.vocab for w in words):
                continue
            context, score = ("<BOS>", "<BOS>"), 0.0
            for w in words:
                score += toy.log_prob(w, *context) if w in toy.vocab else segment.OOV
                context = (context[1], w)
            best = max(best, score)
        tokens, value = segment.beam(text, toy)
        assert "".join(tokens) == text and value == pytest.approx(best)


@pytest.mark.parametrize("chars", [1, 1 << 13])
def test_beam_over_tables_equals_the_model_held_whole(spark, monkeypatch, chars):
    rng = random.Random(2)
    words = ["the", "cat", "cats", "a", "at", "he", "sat", "s", "th", "éc"]
    sents = spark.createDataFrame([(i, 0, rng.choices(words, k=rng.randint(1, 6))) for i in range(40)], "doc_id bigint, sent_id bigint, words array<string>")
    lm = ngram.train(sents)
    whole = segment.collect_model(lm)
    texts = ["".join(rng.choices([*words, "x"], k=rng.randint(1, 7))) for _ in range(60)] + ["", "x", "the" * 40, "thecat"]
    monkeypatch.setattr(segment, "BLOCK_CHARS", chars)
    got = segment.segment_beam(spark.createDataFrame([(s,) for s in [*texts, None]], "s string"), lm).collect()
    assert sorted(r["s"] for r in got) == sorted(set(texts))
    for r in got:
        tokens, score = segment.beam(r["s"], whole) if r["s"] else ([], 0.0)
        assert r["tokens"] == tokens and r["score"] == pytest.approx(score)


def test_dp_cuts_all_merged_tokens(spark):
    d = "/root/testdata/sf0.001"
    whole = segment.collect_model(ngram.train(catalog.split(spark, d)[0]))
    got = {r["s"]: (r["tokens"], r["score"]) for r in catalog.QUERIES["segment_dp_merged"](spark, d).collect()}
    assert set(got) == {r["s"] for r in catalog._merge_queries(spark, d).collect()} and got
    for s, (tokens, score) in got.items():
        want, value = segment.beam(s, whole)
        assert tokens == " ".join(want) and score == pytest.approx(value, abs=2e-6)


def test_greedy():
    assert segment.greedy("thecatsat", {"the", "cat", "cats", "sat", "a"}) == ["the", "cats", "a", "t"]
    assert segment.greedy("", {"a"}) == [] and segment.greedy("xy", set()) == ["x", "y"]


def test_language_model_goldens(spark):
    lm = ngram.train(fixtures.toy_sentences(spark))
    rows = spark.createDataFrame([("<BOS>", "<BOS>", "the"), ("the", "cat", "sat"), ("sat", "cats", "ran"), ("zz", "zz", "cat")], "w_prev2 string, w_prev1 string, w string")
    got = {(r["w_prev2"], r["w"]): r["logprob"] for r in ngram.trigram_log_prob(rows, lm).collect()}
    want = {("<BOS>", "the"): -0.355034, ("the", "sat"): -0.805625, ("sat", "ran"): -1.251314, ("zz", "cat"): -3.398514}
    assert all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())
    sents = spark.createDataFrame([(0, 0, "the cat sat".split()), (0, 1, "a cats sat".split()), (0, 2, "zz cat".split())], "doc_id bigint, sent_id bigint, words array<string>")
    two = [(r["logprob"], r["ppl"]) for r in ngram.score_smoothed(sents, lm, 2).orderBy("sent_id").collect()]
    three = [(r["logprob"], r["ppl"]) for r in ngram.score_smoothed(sents, lm, 3).orderBy("sent_id").collect()]
    assert two == [pytest.approx(x, abs=1e-5) for x in ((-2.182590, 2.069962), (-8.901480, 19.436638), (-10.746027, 215.511287))]
    assert three == [pytest.approx(x, abs=1e-5) for x in ((-1.856706, 1.856888), (-8.254852, 15.667953), (-10.099399, 155.975618))]
    q1 = [r["total"] for r in ngram.score_trigram_q1(sents, lm).orderBy("sent_id").collect()]
    assert q1 == [pytest.approx(x, abs=1e-5) for x in (-1.788356, -10.149635, -13.069115)]


def edits(q):
    letters = spelling.LETTERS
    cut = [(q[:i], q[i:]) for i in range(len(q) + 1)]
    return {a + b[1:] for a, b in cut if b} | {a + b[1] + b[0] + b[2:] for a, b in cut if len(b) > 1} | {a + c + b[1:] for a, b in cut if b for c in letters} | {a + c + b for a, b in cut for c in letters}


def test_spelling_candidates(spark):
    counts = {"the": 10, "then": 3, "they": 4, "form": 5, "from": 8, "cat": 6, "cart": 2, "act": 3, "aa": 1, "a": 1, "caté": 1, "cét": 1, "é": 1, "ab": 1}
    vocab = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    asked = ["teh", "thhe", "catt", "frm", "frmo", "tac", "act", "ca", "thea", "xyz", "a", "b", "aa", "ct", "é"]
    queries = spark.createDataFrame([(q,) for q in asked], "query string")

    def drops(w):
        return {w[:i] + w[i + 1 :] for i in range(len(w))}

    a, b = {q: set() for q in asked}, {q: set() for q in asked}
    for r in spelling.candidates_a(queries, vocab).collect():
        a[r["query"]].add(r["candidate"])
    for r in spelling.candidates_b(queries, vocab).collect():
        b[r["query"]].add(r["candidate"])
    assert a == {q: edits(q) & set(counts) for q in asked}
    assert b == {q: {w for w in counts if drops(w) & drops(q) or q in drops(w)} for q in asked}
    fixed = {r["query"]: r["correction"] for r in spelling.correct_non_word(queries, vocab, spelling.candidates_b(queries, vocab)).collect()}
    assert {q: fixed[q] for q in ("thhe", "catt", "tac", "act", "xyz")} == {"thhe": "they", "catt": "cart", "tac": "act", "act": "act", "xyz": "xyz"}


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    tags = ["A", "B", "C"]
    trans, start = rng.normal(size=(3, 3)), rng.normal(size=3)
    emit = {w: rng.normal(size=3) for w in "xyz"}
    for n in range(6):
        words = list(rng.choice(list("xyz"), n))
        path, best = tagging.viterbi(words, tags, trans, start, emit, np.zeros(3))
        scores = [start[p[0]] + sum(emit[w][t] for w, t in zip(words, p, strict=True)) + sum(trans[s, t] for s, t in itertools.pairwise(p)) for p in itertools.product(range(3), repeat=n)] if n else [0.0]
        assert len(path) == n and best == pytest.approx(max(scores))


def test_hmm_goldens(spark):
    train = [("the", "DET"), ("dog", "NOUN"), ("runs", "VERB")], [("the", "DET"), ("run", "NOUN"), ("ended", "VERB")], [("dogs", "NOUN"), ("run", "VERB")]
    seq = spark.createDataFrame([(u, i, w, t) for u, s in enumerate(train) for i, (w, t) in enumerate(s)], "user_id bigint, pos bigint, word string, tag string")
    lines = spark.createDataFrame([(0, "the run ended".split()), (1, "dogs run".split()), (2, "the cat runs".split()), (3, ["run"]), (4, [])], "user_id bigint, words array<string>")
    got = tagging.decode(lines, tagging.transitions(seq), tagging.emissions(seq)).orderBy("user_id", "pos").collect()
    by = {u: ([r["pred_tag"] for r in got if r["user_id"] == u], next((r["best_score"] for r in got if r["user_id"] == u), None)) for u in range(5)}
    assert by[0] == (["DET", "NOUN", "VERB"], pytest.approx(6.606967, abs=1e-6)) and by[1] == (["NOUN", "VERB"], pytest.approx(5.914270, abs=1e-6))
    assert by[2] == (["DET", "NOUN", "VERB"], pytest.approx(-2.603473, abs=1e-6)) and by[3] == (["NOUN"], pytest.approx(7.013082, abs=1e-6)) and by[4] == ([], None)


def test_tagging_benchmark_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    got = {r["metric"]: r["value"] for r in catalog.tagging_benchmark(spark, d).collect()}
    train, test = catalog._halves(spark, d)
    lines = {}
    for r in test.orderBy("user_id", "pos").collect():
        lines.setdefault(r["user_id"], []).append((r["word"], r["tag"]))
    lm = segment.collect_model(ngram.train(catalog._lines(train)))
    values = {}

    def places(tokens):
        return set(itertools.accumulate(map(len, tokens[:-1])))

    def spans(tokens, tags):
        return {(e - len(w), e): t for w, t, e in zip(tokens, tags, itertools.accumulate(map(len, tokens)), strict=True)}

    cuts = {(name, u): f("".join(w for w, _ in line)) for u, line in lines.items() for name, f in (("greedy", lambda s: segment.greedy(s, lm.vocab)), ("dp", lambda s: segment.beam(s, lm)[0]))}
    rows = spark.createDataFrame([(i, cuts[k]) for i, k in enumerate(cuts)], "user_id bigint, words array<string>")
    tags = {}
    for r in tagging.decode(rows, tagging.transitions(train), tagging.emissions(train)).orderBy("user_id", "pos").collect():
        tags.setdefault(list(cuts)[r["user_id"]], []).append(r["pred_tag"])
    for (name, u), tokens in cuts.items():
        gold = [w for w, _ in lines[u]]
        g, q = places(gold), places(tokens)
        p, r = (len(g & q) / len(q), len(g & q) / len(g)) if g and q else (float(not g and not q),) * 2
        true, pred = spans(gold, [t for _, t in lines[u]]), spans(tokens, tags[name, u])
        right, hit = sum(pred.get(k) == t for k, t in true.items()), len(true.keys() & pred.keys())
        each = {"precision": p, "recall": r, "f1": 2 * p * r / (p + r) if p + r else 0.0, "exact": g == q, "hmm_accuracy": right / len(true), "hmm_tag_err": (hit - right) / len(true), "hmm_seg_err": 1 - hit / len(true)}
        for k, v in each.items():
            values.setdefault(f"{name}_{k}", []).append(float(v))
    assert set(got) == {*values, "mft_accuracy", "hmm_accuracy", "typing_f1"}
    assert all(got[k] == pytest.approx(np.mean(v), abs=6e-5) for k, v in values.items())


def test_boundary_metrics_and_reconcile(spark):
    rows = spark.createDataFrame([("the quick brown fox".split(), "thequick brown fox".split()), (["a"], ["a"]), (["ab"], ["a", "b"])], "g array<string>, p array<string>")
    m = [tuple(r[0]) for r in rows.select(tagging.boundary_metrics(tagging.boundaries(F.col("g")), tagging.boundaries(F.col("p")))).collect()]
    assert m[0] == (1.0, pytest.approx(2 / 3), pytest.approx(0.8), False) and m[1] == (1.0, 1.0, 1.0, True) and m[2] == (0.0, 0.0, 0.0, False)
    with pytest.raises(Exception, match="same length"):
        spark.createDataFrame([(["a"], ["b", "c"])], "t array<string>, p array<string>").select(tagging.reconcile(F.col("t"), F.col("p"))).collect()


@pytest.mark.parametrize(
    "pcfg_,tri,bi,want",
    [(-15.0, None, None, ("PCFG", "Grammatical")), (-15.01, -8.8, None, ("Trigram LM", "Grammatical")), (None, -8.81, None, ("Trigram LM", "Questionable")), (None, -11.0, 0.0, ("Trigram LM", "Questionable")),
     (None, -11.01, -8.5, ("Bigram LM", "Grammatical")), (None, -11.01, -8.51, ("Bigram LM", "Ungrammatical")), (None, None, None, ("Bigram LM", "Ungrammatical"))],
)
def test_decision_rule(spark, pcfg_, tri, bi, want):
    row = spark.createDataFrame([(pcfg_, tri, bi, 1)], "p double, t double, b double, n int")
    assert tuple(row.select(passage.decide(F.col("p"), F.col("t"), F.col("b"), F.col("n"))).first()[0]) == want


def test_grammar():
    g = pcfg.Grammar(fixtures.GRAMMAR, "S")
    tree, score = g.parse("she saw the dog with the telescope".split())
    assert score == pytest.approx(math.log(0.00096)) and tree.startswith("(S (NP (PRP she)) (VP (VP")
    assert g.parse(["saw", "she"]) is None and g.parse([]) is None
    assert pcfg.show(pcfg.read_tree(fixtures.TREES[2])) == fixtures.TREES[2]


def test_oracle_rebuilds_trees():
    rows = fixtures.treebank()
    for k in {r[0] for r in rows}:
        gold = [(i, tag, head, lab) for s, i, _, tag, head, lab in rows if s == k]
        steps = depparse.oracle(gold)
        state = depparse.State({i: t for i, t, _, _ in gold})
        for action, features in steps:
            assert state.features() == features and state.legal(action)
            state.apply(action)
        assert sorted(state.arcs, key=lambda a: a[1]) == [(h, i, lab) for i, _, h, lab in gold]


def test_parser_learns_its_templates(spark):
    gold = fixtures.treebank_frame(spark)
    steps = depparse.transitions(gold)
    fitted, labels = depparse.fit_classifier(steps, 60)
    score = depparse.attachment(gold, depparse.parse_sentences(gold, fitted, labels)).first()
    assert score["uas"] > 90 and score["las"] > 90


def test_prefix_condition_is_a_prefix(spark):
    rows = spark.createDataFrame([(d, s) for d in (-5, 0, 3, 90_000) for s in range(d % 4 + 1)], "doc_id bigint, sent_id bigint")
    ordered = sorted(tuple(r) for r in rows.collect())
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    for ratio in (0.0, 0.3, 0.8, 1.0):
        for per_step in (3, 1 << 20):
            kept = sorted(tuple(r) for r in rows.where(corpus.prefix_condition(counts, ratio, per_step)).collect())
            assert kept == ordered[: int(len(ordered) * ratio)]
    assert rows.where(corpus.prefix_condition(counts.limit(0))).count() == 0


def test_sentence_counts_are_those_of_the_sentences(spark):
    texts = ["One. Two!  three? ", None, "", "...", " a.b. ... c! \u00e9. d", "x\u0001 y. z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    made = {}
    for r in corpus.sentences(docs).collect():
        made.setdefault(r["doc_id"], []).append((r["sent_id"], r["text"], r["words"]))
    assert {r["doc_id"]: r["n"] for r in corpus.sentence_counts(docs).collect()} == {d: len(s) for d, s in made.items()}
    assert sorted(made[0]) == [(0, "One.", ["one"]), (1, "Two!", ["two"]), (2, "three?", ["three"])]
    assert sorted(made[4]) == [(0, "a.b.", ["ab"]), (1, "c!", ["c"]), (2, "d", ["d"])]


def test_words_are_cleaned_one_by_one(spark):
    rng = random.Random(3)
    for _ in range(40):
        text = "".join(rng.choice(" \t\n\u00a0aB1\u00e9\u00d1\u0130.,'_-") for _ in range(rng.randint(0, 30)))
        plain = [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
        assert one(spark, N.words, text) == plain
        assert one(spark, N.clean_words, text) == [c for w in plain if (c := "".join(x for x in w if x.isascii() and x.isalnum()).lower())]
        assert one(spark, N.alpha_words, text) == [w.lower() for w in plain if w.isalpha()]
        assert one(spark, N.alnum_words, text) == [w.lower() for w in plain if w.isalnum()]


def test_greedy_over_a_lexicon_of_any_size(spark):
    rng = random.Random(4)
    words = {"the", "cat", "cats", "sat", "he", "at", "a", "x" * 20, "x" * 21}
    texts = ["".join(rng.choices([*words, "q"], k=rng.randint(1, 8))) for _ in range(50)] + ["", "q"]
    lexicon = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r["s"]: r["tokens"] for r in segment.segment_greedy(spark.createDataFrame([(t,) for t in [*texts, None]], "s string"), lexicon).collect()}
    assert got == {t: segment.greedy(t, words) for t in texts}


def test_long_sentences_are_parsed(spark):
    words = "she saw the dog".split() + "with the telescope".split() * 20
    rows = spark.createDataFrame([(0, words), (1, words), (2, ["xyz"] * 300), (3, [])], "sent_id bigint, words array<string>")
    got = {r["sent_id"]: r["logprob"] for r in pcfg.parse_sentences(rows, fixtures.grammar_frame(spark)).collect()}
    assert got[0] is not None and got[0] == got[1] and got[2] is None and got[3] is None


def test_editor_benchmark_reports_both_pipelines(spark):
    from textlattice.operators import benchmark

    tokens = spark.range(50).withColumnRenamed("id", "pos")
    got = {r["pipeline"]: r for r in benchmark.report(tokens, {"A": lambda lm: tokens, "B": lambda lm: tokens}, None).collect()}
    assert set(got) == {"A", "B"} and all(r["n_tokens"] == 50 and r["ms_per_token"] == pytest.approx(20 * r["seconds"]) for r in got.values()) and got["A"]["speedup"] == 1


def test_live_editor_feeds_corrected_tokens_to_the_triggers(spark, toy):
    lm = ngram.train(fixtures.toy_sentences(spark))
    tokens = spark.createDataFrame([(0, i, t) for i, t in enumerate(["a", "cat", "sat", "the", "thecat", "ran"])], "doc_id bigint, pos bigint, token string")
    vocab = spark.createDataFrame([(w, c) for w, c in toy.uni.items() if w in toy.vocab], "word string, n bigint")
    found = editor.check_tokens(tokens, vocab, vocab, lm)
    assert [tuple(r) for r in editor.trigger_windows(found).collect()] == [(0, 4, ["a", "cat", "sat", "the", "thecat"])]
    assert {r["pos"]: r["corrected"] for r in found.collect()}[4] == "the cat"


def test_registry(spark, tmp_path):
    registry = Registry(spark, str(tmp_path))
    lm = registry.load_or_train(["new", "old"], lambda: ngram.train(fixtures.toy_sentences(spark)))
    assert registry.load_counts("new").uni.count() == lm.uni.count() == 8
    extra = registry.load("new", "lexicon", lambda: spark.createDataFrame([("x",)], "word string"))
    assert extra.count() == 1


def test_stream_equals_batch(spark):
    d = "/root/testdata/sf0.001"
    batch = {(r["doc_id"], r["pos"], " ".join(r["window"])) for r in catalog._windows(spark, d).collect()}
    assert {tuple(r) for r in catalog.editor_stream(spark, d).collect()} == batch and batch
    assert clean("L'été_1!") == "lété1"


def test_token_checks(spark, toy):
    tokens = spark.createDataFrame([(0, 0, "Thecat,"), (0, 1, "cat"), (0, 2, "..."), (0, 3, "caat"), (0, 4, "sqqqqt")], "doc_id bigint, pos bigint, token string")
    vocab = spark.createDataFrame([(w, c) for w, c in toy.uni.items() if w in toy.vocab], "word string, n bigint")
    got = {r["pos"]: (r["corrected"], r["alert_kind"]) for r in editor.check_tokens(tokens, vocab, vocab, toy).collect()}
    assert got == {0: ("The cat,", "SEGMENT"), 1: ("cat", None), 2: ("...", None), 3: ("cats", "SPELL"), 4: ("sqqqqt", None)}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_best_candidates_and_context_without_pairs(spark):
    """The best candidate by deletion key is that of all pairs, and the context rule is that of all options; no plan makes the pairs."""
    rnd = random.Random(7)
    words = sorted({"".join(rnd.choice("abé") for _ in range(rnd.randint(1, 4))) for _ in range(60)})
    n = {w: rnd.randint(1, 4) for w in words}
    vocab = spark.createDataFrame(list(n.items()), "word string, n bigint")
    asked = sorted({"".join(rnd.choice("abéc") for _ in range(rnd.randint(1, 5))) for _ in range(60)})
    queries = spark.createDataFrame([(q,) for q in asked], "query string")
    options = {}
    for pairs, best in ((spelling.candidates_a, spelling.best_a), (spelling.candidates_b, spelling.best_b)):
        options = {}
        for q, c in pairs(queries, vocab).collect():
            options.setdefault(q, []).append(c)
        assert {r["query"]: r["best"]["candidate"] for r in best(queries, vocab).collect()} == {q: min(cs, key=lambda w: (-n[w], w)) for q, cs in options.items()}
        got = dict(spelling.correct_non_word(queries, vocab, best).collect())
        assert got == dict(spelling.correct_non_word(queries, vocab, pairs(queries, vocab)).collect())
    seen = {(a, b): rnd.randint(1, 5) for a in words[:6] for b in rnd.sample(words, 25)}
    bigrams = spark.createDataFrame([(*k, c) for k, c in seen.items()], "w1 string, w2 string, c bigint")
    rows = spark.createDataFrame([(p, q) for p in [None, "zz", *words[:6]] for q in asked], "prev string, word string")
    total, types = sum(n.values()), len(n)
    changed = 0
    for p, q, found in spelling.correct_real_word(rows, vocab, bigrams).select("prev", "word", "correction").collect():
        prob = {c: n.get(c, 0) / total if p is None else (seen.get((p, c), 0) + 1) / (n.get(p, 0) + types) for c in [*options.get(q, []), q]}
        top = min(prob, key=lambda c: (-prob[c], c))
        assert found == (top if prob[top] > 1.5 * prob[q] else q), (p, q)
        changed += found != q
    assert changed > 20
    assert "levenshtein" not in spelling.candidates_a(queries, vocab)._jdf.queryExecution().optimizedPlan().toString()


def test_grams_of_long_lines_make_their_padding_once(spark):
    line = spark.createDataFrame([(0, 0, ["a", "b", "c"]), (0, 1, ["a"])], "doc_id bigint, sent_id bigint, words array<string>")
    assert sorted(tuple(r) for r in ngram.count_grams(line, 3).collect()) == sorted([("<BOS>", "<BOS>", "a", 2), ("<BOS>", "a", "b", 1), ("a", "b", "c", 1), ("b", "c", "<EOS>", 1), ("<BOS>", "a", "<EOS>", 1)])
    for plan in (ngram.count_grams(line, 3), ngram.sentence_grams(line, 3), tagging.transitions(spark.createDataFrame([(1, 0, "w", "t")], "user_id bigint, pos bigint, word string, tag string"))):
        assert "lambda" not in plan._jdf.queryExecution().optimizedPlan().toString().replace("lambda s_", "").lower() or "sequence(" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_decode_takes_logarithms_as_sql_does(spark):
    """Scores are bit for bit those of quotients' logarithms, added in SQL's order."""
    seq = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "b", "y"), (1, 2, "a", "y"), (2, 0, "b", "x"), (2, 1, "a", "x"), (3, 0, "c", "y")], "user_id bigint, pos bigint, word string, tag string")
    lines = spark.createDataFrame([(i, list(w)) for i, w in enumerate(["ab", "acb", "cba", "zab", *("aab" * n for n in range(4, 40))])], "user_id bigint, words array<string>")
    trans = {(a, b): c for a, b, c in tagging.transitions(seq).collect()}
    emit, k, tags = {(t, w): c for t, w, c in tagging.emissions(seq).collect()}, tagging.K, ["x", "y"]
    into = {a: sum(c for (_, b), c in trans.items() if b == a) for a in tags}
    step = {(a, b): math.log((trans.get((a, b), 0) + k) / (into.get(a, 0) + k * 2)) for a in [*tags, tagging.START] for b in tags}
    out = {(t, w): math.log((emit.get((t, w), 0) + k) / (sum(c for (u, _), c in emit.items() if u == t) + k * 4)) for t in tags for w in "abcz"}
    got = {r["user_id"]: r["best_score"] for r in tagging.decode(lines, tagging.transitions(seq), tagging.emissions(seq)).collect()}
    for i, words in lines.collect():
        score = {t: step[tagging.START, t] + out[t, words[0]] for t in tags}
        for w in words[1:]:
            score = {t: max(score[a] + step[a, t] for a in tags) + out[t, w] for t in tags}
        assert got[i] == max(score.values())


def test_sentence_words_are_the_sentences_of_the_expressions(spark):
    texts = ["", " ", None, "One.  Two! three?\n\nFour", "a\u0001b. c", "É. caf\u00e9 İstanbul x_y Z9!", "end. \u0085", "end \n\u2028", " \u2029", "x \u2028 ", "\x0bA.\x0cB?\rC.\u00a0D", "!!! ... ?", "no stop", "a.b. c .d", "q.\u0001 r", "tail.\r\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = sorted(corpus.sentences(docs).select("doc_id", "sent_id", "text", "words").collect())
    assert sorted(corpus.sentence_words(docs, text=True).select("doc_id", "sent_id", "text", "words").collect()) == want
    assert sorted(corpus.sentence_words(docs).collect()) == [(r["doc_id"], r["sent_id"], r["words"]) for r in want]


def test_counts_of_what_is_asked_need_no_whole_table(spark):
    lm = ngram.train(fixtures.toy_sentences(spark))
    asked = spark.createDataFrame([("the", "cat", "sat"), ("the", "cat", "sat"), ("<BOS>", "<BOS>", "a"), ("x", "cat", "ran"), ("cat", "sat", "<EOS>"), ("x", "y", "z")], "w_prev2 string, w_prev1 string, w string")
    saved = ngram.CountTables(lm.uni, lm.bi, lm.tri)
    want = sorted(ngram.trigram_log_prob(asked, saved).collect())
    got = ngram.trigram_log_prob(asked, ngram.CountTables(lm.uni, None, None, lm.sents))  # bigrams and trigrams are counted with what is asked
    assert sorted(got.collect()) == want and len(want) == 5
    assert lm.of(asked, 3).where("c > 0").count() == 3
    sents = spark.createDataFrame([(0, 0, ["the", "cat", "flew"]), (0, 1, ["cats"])], "doc_id bigint, sent_id bigint, words array<string>")
    both = {r["sent_id"]: (r["n_words"], round(r["bigram"], 9), round(r["trigram"], 9)) for r in ngram.score_both(sents, lm).collect()}
    two, three = ngram.score_smoothed(sents, saved, 2).collect(), {r["sent_id"]: r["total"] for r in ngram.score_trigram_q1(sents, saved).collect()}
    assert both == {r["sent_id"]: (r["n_words"], round(r["logprob"], 9), round(three[r["sent_id"]], 9)) for r in two}


def test_sentences_with_unknown_words_are_not_dealt_to_the_parser(spark):
    rows = spark.createDataFrame([(0, "she saw the dog".split()), (1, ["She", "SAW", "the", "xyz"]), (2, []), (2, ["saw", "she"]), (3, None)], "sent_id bigint, words array<string>")
    grammar = fixtures.grammar_frame(spark)
    assert {r["sent_id"] for r in pcfg.found_parses(rows, grammar).collect()} == {0, 2}
    assert sorted((r["sent_id"], r["tree"] is not None) for r in pcfg.parse_sentences(rows, grammar).collect()) == [(0, True), (1, False), (2, False), (2, False), (3, False)]


def test_alpha_stream_is_that_of_the_expressions(spark):
    texts = ["", None, "The cat's CAT, sat\x0bOn \x1c x\x1cy \u00a0 a\u00a0b", "É café İstanbul ½ x² 1a ß ÀÉ \u0149", "ΣΑΣ слово Ok", "“quoted” it’s plain", "日本 two", " A\tb\r\nC "] + ["word " * 200_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want = docs.where("text is not null").select("doc_id", N.alpha_words(F.col("text")).alias("words"))
    got = spelling.alpha_stream(docs)
    assert got.schema["doc_id"].dataType == docs.schema["doc_id"].dataType and got.count() == len(texts)
    assert sorted(got.where("doc_id <> 1").collect()) == sorted(want.collect())
    assert spelling._alpha("plain É text") is not None and spelling._alpha("слово") is None  # which way a text takes


def test_words_of_long_turns_are_cut_once(spark, tmp_path):
    rows = [(1, 0, "Hi there, you!"), (1, 1, ""), (1, 2, None), (2, 0, "..."), (3, 0, "Word " * 40_000)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    began = time.time()
    got = sorted(catalog._conversation_words(spark, str(tmp_path)).collect(), key=lambda r: r[:3])
    assert time.time() - began < 60  # the turn of 40,000 words took its square before
    assert [tuple(r) for r in got[:8]] == [(1, 0, 0, "Hi", "hi", None), (1, 0, 1, "there", "there", "hi"), (1, 0, 2, ",", ",", "there"), (1, 0, 3, "you", "you", ","), (1, 0, 4, "!", "!", "you"), (2, 0, 0, ".", ".", None), (2, 0, 1, ".", ".", "."), (2, 0, 2, ".", ".", ".")]
    assert len(got) == 8 + 40_000 and tuple(got[-1]) == (3, 0, 39_999, "Word", "word", "word")


def test_training_ngrams_that_nobody_asks_for_are_not_sent(spark):
    rng = random.Random(5)
    words = ["the", "cat", "", "\x01", "a b", "é", None, *(f"w{i}" for i in range(400))]
    lines = [rng.choices(words, k=rng.randint(0, 9)) for _ in range(800)] + [[], None]
    sents = spark.createDataFrame([(x,) for x in lines], "words array<string>")
    one = {(r["w"],): r["c"] for r in ngram.count_grams(sents, 1).where("w is not null").collect()}
    assert {(r["w"],): r["c"] for r in gramkeys.count_words(sents).collect()} == one
    for n in (2, 3):
        table = ngram.count_grams(sents, n).dropna()
        want = {tuple(r)[:n]: r["c"] for r in table.collect()}
        asked = [*rng.sample(sorted(want), 50), *[("no", "such", "gram")[:n]] * 2]
        asked_keys = gramkeys.keyed(spark.createDataFrame([(*g, 0) for g in asked], ", ".join(f"w{i} string" for i in range(n)) + ", c bigint"), n)
        sieve = gramkeys.sieve(asked_keys, len(asked), 64)
        sent = gramkeys.count_asked(sents, n, sieve).groupBy("k1", "k2").sum("c").toDF("k1", "k2", "c")
        assert 50 <= sent.count() < 60 < len(want) / 10
        # by the tables, as of a model that was loaded, the same
        assert sorted(map(tuple, sent.collect())) == sorted(map(tuple, gramkeys.keyed(table, n, sieve).collect()))
        got = sorted(r["c"] for r in asked_keys.drop("c").join(sent, ["k1", "k2"]).collect())
        assert got == sorted(want[g] for g in asked if g in want)


def test_marked_texts_hold_the_training_sentences(spark):
    texts = ["One two. Three!  four?\n\nFive", " .  a\x01b.  c", "é. ê!", "", None, "A.b c.\x85 D \x02e", "x. y. z. ", "\x01\x01q"] * 3
    docs = spark.createDataFrame([(i - 4 if i % 7 else 3, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    made = corpus.marked(docs)
    s = corpus.sentence_words(docs)
    counts = s.groupBy("doc_id").agg(F.count("*").alias("n"))
    for ratio in (0.0, 0.3, 0.5, 0.8, 1.0):
        want = sorted(r["words"] for r in s.where(corpus.prefix_condition(counts, ratio)).collect())
        assert sorted(line.split(" ") for r in corpus.marked_prefix(made, ratio).collect() for line in r["marked"].split("\x01")) == want


def test_merged_words_are_those_of_the_expressions(spark):
    rng = random.Random(6)
    turns = [(i if i % 5 else None, i % 3, " \t\n".join(rng.choices(["The", "ca.t", "É", "a\x01b", "c\x02d", " x", "\x01", "9"], k=rng.randint(0, 30)))) for i in range(60)] + [(1, 1, None), (2, None, " ")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn int, text string")
    made = df.select(F.explode(segment.typing_merges(N.words(F.col("text")), F.col("conv_id"), F.col("turn"))).alias("x")).where("x.n_words > 1")
    want = made.select(N.clean_ascii(F.col("x.token")).alias("s")).where("s <> ''").distinct()
    assert sorted(map(tuple, segment.merged_words(df, "conv_id", "turn").collect())) == sorted(map(tuple, want.collect())) != []


def test_what_follows_a_state_is_valued_as_by_log_prob(toy):
    for before in ("<BOS>", "the", "cat", "zz"):
        for last in ("<BOS>", "the", "cats", "a", "zz"):
            counts, n, less, unseen = toy.after(before, last)
            for w in ("the", "cat", "sat", "ran", "zz"):
                value = unseen if w not in counts else math.log((counts[w] + toy.k) / n) - less
                assert value == pytest.approx(toy.log_prob(w, before, last), abs=1e-12)


def test_beam_over_loaded_tables_equals_the_model_held_whole(spark):
    # tables of a registry come without their sentences, and need not agree with each other
    uni = spark.createDataFrame([("a", 3), ("b", 2), ("ab", 1), ("<BOS>", 4), ("<EOS>", 2)], "w string, c bigint")
    bi = spark.createDataFrame([("<BOS>", "<BOS>", 2), ("<BOS>", "a", 2), ("a", "b", 1)], "w1 string, w2 string, c bigint")
    tri = spark.createDataFrame([("<BOS>", "<BOS>", "ab", 2), ("a", "b", "a", 3), ("<BOS>", "a", "ab", 1)], "w1 string, w2 string, w3 string, c bigint")
    lm = ngram.CountTables(uni, bi, tri)
    whole, texts = segment.collect_model(lm), ["abab", "aab", "ba", "xab", "", "abaab"]
    got = segment.segment_beam(spark.createDataFrame([(s,) for s in texts], "s string"), lm).collect()
    assert sorted((r["s"], r["tokens"], round(r["score"], 9)) for r in got) == sorted((s, t, round(x, 9)) for s in texts for t, x in [segment.beam(s, whole) if s else ([], 0.0)])
