"""Small self-authored inputs for the operators whose corpora are not at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TOY_SENTENCES = ["the cat sat", "the cat ran", "a cat sat", "the cats ran"]
TOY_STRINGS = ["thecatsat", "acatran", "thecatsran", "thexcat", "catsat"]

CONLLU = "\n".join(
    [
        "# sent_id = 1",
        *("\t".join(str(x) for x in (i, f, f.lower(), u, "_", feats, h, d, "_", "_")) for i, f, u, feats, h, d in [
            (1, "The", "DET", "_", 2, "det"), (2, "cat", "NOUN", "Gender=Masc|Number=Sing", 3, "nsubj"), (3, "sat", "VERB", "Number=Sing|Tense=Past", 0, "root"), (4, "on", "ADP", "_", 6, "case"),
            (5, "the", "DET", "_", 6, "det"), (6, "mat", "NOUN", "Number=Sing", 3, "obl"), (7, ".", "PUNCT", "_", 3, "punct"),
        ]),
        "",
        "# sent_id = 2",
        "1-2\tdel\t_\t_\t_\t_\t_\t_\t_\t_",
        *("\t".join(str(x) for x in (i, f, f.lower(), u, "_", feats, h, d, "_", "_")) for i, f, u, feats, h, d in [
            (1, "a", "X", "_", 3, "dep"), (2, "b", "X", "Gender=Fem|Number=Plur", 4, "dep"), (3, "c", "X", "_", 0, "root"), (4, "d", "X", "_", 3, "dep"),
        ]),
        "3.1\te\t_\t_\t_\t_\t_\t_\t_\t_",
    ]
)

TREES = [
    "(S (NP (PRP she)) (VP (VB saw) (NP (DT the) (NN dog))))",
    "(S (NP (DT the) (NN man)) (VP (VB saw) (NP (PRP her))))",
    "(S (NP (DT the) (NN dog)) (VP (VB saw) (NP (DT the) (NN man)) (PP (IN with) (NP (DT the) (NN telescope)))))",
]
GRAMMAR = [
    ("S", ["NP", "VP"], False, 1.0), ("NP", ["DT", "NN"], False, 0.5), ("NP", ["NP", "PP"], False, 0.3), ("NP", ["PRP"], False, 0.2), ("VP", ["VB", "NP"], False, 0.6), ("VP", ["VP", "PP"], False, 0.4), ("PP", ["IN", "NP"], False, 1.0),
    ("DT", ["the"], True, 1.0), ("NN", ["man"], True, 0.4), ("NN", ["dog"], True, 0.4), ("NN", ["telescope"], True, 0.2), ("VB", ["saw"], True, 1.0), ("IN", ["with"], True, 1.0), ("PRP", ["she"], True, 1.0),
]
PARSE_SENTENCES = ["she saw the dog", "she saw the dog with the telescope", "saw she", "she saw xyz", ""]

EVENTS = [
    ("the grand", "[SEGMENT-ALERT] thegrand"), ("jury", None), ("commented", None), ("on", None), ("the", None), ("election.", None),
    ("The", None), ("mayor", None), ("accepted", "[SPELL-ALERT] acepted"), ("the", None), ("nomination!", None), ("...", None),
    ("colorless", None), ("green", None), ("ideas", None), ("sleep furiously", None),
]

#: Templates for a learnable treebank: (form, tag, head, label) of each token.
_TEMPLATES = [
    [("the", "DET", 2, "det"), ("N", "NOUN", 3, "nsubj"), ("V", "VERB", 0, "root")],
    [("N", "NOUN", 2, "nsubj"), ("V", "VERB", 0, "root"), ("the", "DET", 4, "det"), ("N", "NOUN", 2, "obj")],
    [("the", "DET", 3, "det"), ("A", "ADJ", 3, "amod"), ("N", "NOUN", 4, "nsubj"), ("V", "VERB", 0, "root"), ("R", "ADV", 4, "advmod")],
    [("P", "PRON", 2, "nsubj"), ("V", "VERB", 0, "root"), ("on", "ADP", 5, "case"), ("the", "DET", 5, "det"), ("N", "NOUN", 2, "obl")],
]
_WORDS = {"N": ["cat", "dog", "man", "mat", "bird"], "V": ["sat", "ran", "saw", "slept", "sang"], "A": ["big", "old", "red", "shy", "wet"], "R": ["well", "fast", "often", "now", "here"], "P": ["she", "he", "it", "they", "we"]}


def treebank() -> list[tuple[int, int, str, str, int, str]]:
    """(sent_id, id, form, upos, head, deprel): each template with each choice of words."""
    out = []
    for k in range(5 * len(_TEMPLATES)):
        for i, (form, tag, head, label) in enumerate(_TEMPLATES[k % len(_TEMPLATES)], 1):
            out.append((k, i, _WORDS[form][(k + i) % 5] if form in _WORDS else form, tag, head, label))
    return out


def treebank_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(treebank(), "sent_id bigint, id int, form string, upos string, head int, deprel string")


def conllu_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("inline", CONLLU)], "file string, text string")


def trees_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(TREES)), "tree_id bigint, bracketed string")


def grammar_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GRAMMAR, "lhs string, rhs array<string>, is_lexical boolean, prob double")


def toy_sentences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, 0, s.split()) for i, s in enumerate(TOY_SENTENCES)], "doc_id bigint, sent_id bigint, words array<string>")


def scored_frame(spark: SparkSession, parses: DataFrame) -> DataFrame:
    """Rows of the verdict table for the sentences to parse: scores that would say ungrammatical wherever there is no parse."""
    texts = spark.createDataFrame([(i, t, len(t.split()) or 1) for i, t in enumerate(PARSE_SENTENCES)], "sent_id bigint, sentence_text string, n_tokens int")
    return texts.join(parses.withColumnRenamed("logprob", "pcfg"), "sent_id").selectExpr("sent_id", "sentence_text", "n_tokens", "pcfg", "-100D as bigram", "-100D as trigram", "0 as num_merges", "0 as num_spells")
