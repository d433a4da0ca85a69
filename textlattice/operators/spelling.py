"""Edit-distance spelling correction as joins on deletion keys."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlattice.functions import normalize as N

LETTERS = "abcdefghijklmnopqrstuvwxyz"
REAL_WORD_FACTOR = 1.5
#: Words of one or two letters that the segmentation lexicon keeps.
SHORT_WORDS = ["a", "i", "am", "an", "as", "at", "be", "by", "do", "go", "he", "if", "in", "is", "it", "me", "my", "no", "of", "on", "or", "so", "to", "up", "us", "we"]


_SPACE = re.compile("[ \\t\\n\\x0b\\f\\r]+")
#: Words that are given to Arrow at once.
CHUNK = 1 << 17


def _alpha(text: str) -> list | None:
    """``N.alpha_words`` of a text; nothing if that needs letters beyond the Latin ones, which another version of Unicode may take another way."""
    if text.isascii():
        return [w for w in text.lower().encode().split() if w.isalpha()]
    out = []
    for w in _SPACE.split(text):
        if w.isalpha():
            if not w.isascii() and max(w) >= "\u0250":
                return None
            out.append(w.lower())
    return out


def alpha_stream(docs: DataFrame) -> DataFrame:
    """(doc_id, words): lower-cased alphabetic words of each document in order. An Arrow kernel takes most texts, the expressions the others."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, rest, flat, ends = 0, [], [], [0]

            def given(upto: int, batch=batch) -> pa.RecordBatch:
                words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.string()))
                return pa.RecordBatch.from_arrays([batch.column(0).slice(begin, upto - begin), pa.array(rest, pa.string()), words], names=["doc_id", "rest", "words"])

            for at, text in enumerate(batch.column(1)):
                text = text.as_py()
                found = [] if text is None else _alpha(text)
                rest.append(text if found is None else None)
                flat += found or []
                ends.append(len(flat))
                if len(flat) >= CHUNK:
                    yield given(at + 1)
                    begin, rest, flat, ends = at + 1, [], [], [0]
            if rest:
                yield given(batch.num_rows)

    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, rest string, words array<string>")
    return found.select("doc_id", F.when(F.col("rest").isNull(), F.col("words")).otherwise(N.alpha_words(F.col("rest"))).alias("words"))


def vocabulary(stream: DataFrame) -> DataFrame:
    return stream.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def stream_bigrams(stream: DataFrame) -> DataFrame:
    w = F.col("words")
    pairs = F.arrays_zip(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))).alias("w1"), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))).alias("w2"))
    return stream.where(F.size("words") > 1).select(F.explode(pairs).alias("p")).groupBy("p.w1", "p.w2").agg(F.count("*").alias("c"))


def segmentation_vocabulary(lexicon: DataFrame) -> DataFrame:
    return lexicon.where((F.length("word") >= 3) | F.col("word").isin(SHORT_WORDS))


def deletions_of(word: Column) -> Column:
    """The distinct strings with one character less."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(word.substr(F.lit(1), i - 1), word.substr(i + 1, F.length(word)))))


def deletions(vocab: DataFrame) -> DataFrame:
    return vocab.select("word", F.explode(deletions_of(F.col("word"))).alias("del"))


def _keys_b(queries: DataFrame, *more: str) -> DataFrame:
    """A row for each key by which a query meets the deletion index: its deletions and itself."""
    q = F.col("query")
    return queries.select(*more, "query", F.explode(F.array_distinct(F.concat(deletions_of(q), F.array(q)))).alias("del"))


def candidates_b(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """(query, candidate): vocabulary words that share a deletion with the query, or have it as one."""
    index = deletions(vocab).select("del", F.col("word").alias("candidate"))
    return _keys_b(queries).join(index, "del").select("query", "candidate").distinct()


def _first(by: Column) -> Column:
    """Of the rows of a group, the one with the largest number, then the first candidate by name."""
    return F.min(F.struct((-by).alias("k"), F.col("candidate"))).alias("best")


def best_b(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """(query, best): the most frequent of ``candidates_b``, ties first by name, without making the pairs: each deletion keeps its best word only."""
    index = vocab.select(F.col("word").alias("candidate"), "n", F.explode(deletions_of(F.col("word"))).alias("del")).groupBy("del").agg(_first(F.col("n")))
    return _keys_b(queries).join(index, "del").groupBy("query").agg(F.min("best").alias("best"))


def _letters(word: Column) -> Column:
    """Array of (del, at, letter): the word without the letter at each place."""
    one = F.lit(1)
    return F.transform(F.sequence(one, F.length(word)), lambda i: F.struct(F.concat(word.substr(one, i - 1), word.substr(i + 1, F.length(word))).alias("del"), i.alias("at"), word.substr(i, one).alias("letter")))


def _keys_a(queries: DataFrame) -> DataFrame:
    """(query, key, at): at > 0: what is left around a letter to replace; 0: the query, to put a letter in; -1: the query with a letter deleted or two swapped."""
    q, one, word, grow = F.col("query"), F.lit(1), F.lit(-1), F.lit(0)
    cut = queries.select("query", F.explode(_letters(q)).alias("x")).select("query", F.explode(F.array(F.struct(F.col("x.del").alias("key"), F.col("x.at").alias("at")), F.struct(F.col("x.del").alias("key"), word.alias("at")))).alias("y")).select("query", "y.*")
    swaps = F.transform(F.sequence(one, F.length(q) - 1), lambda i: F.concat(q.substr(one, i - 1), q.substr(i + 1, one), q.substr(i, one), q.substr(i + 2, F.length(q))))
    swapped = queries.where(F.length(q) > 1).select("query", F.explode(swaps).alias("key"), word.alias("at"))
    return cut.unionByName(swapped).unionByName(queries.select("query", q.alias("key"), grow.alias("at")))


def _index_a(vocab: DataFrame) -> DataFrame:
    """(key, at, candidate, n): the words under the keys of ``_keys_a``; only letters of a-z are put in."""
    w = F.col("word")
    put = vocab.select("n", w.alias("candidate"), F.explode(_letters(w)).alias("x")).where(F.col("x.letter").rlike("^[a-z]$"))
    put = put.select("n", "candidate", F.explode(F.array(F.struct(F.col("x.del").alias("key"), F.col("x.at").alias("at")), F.struct(F.col("x.del").alias("key"), F.lit(0).alias("at")))).alias("y")).select("y.*", "candidate", "n")
    return put.unionByName(vocab.select(w.alias("key"), F.lit(-1).alias("at"), w.alias("candidate"), "n"))


def candidates_a(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """(query, candidate): vocabulary words one delete, swap, replace or insert away. No edits are listed and no pair is tested: keys that hold the place of the edit join."""
    return _keys_a(queries).join(_index_a(vocab), ["key", "at"]).select("query", "candidate").distinct()


def best_a(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """(query, best): the most frequent of ``candidates_a``, ties first by name, without making the pairs."""
    index = _index_a(vocab).groupBy("key", "at").agg(_first(F.col("n")))
    return _keys_a(queries).join(index, ["key", "at"]).groupBy("query").agg(F.min("best").alias("best"))


def correct_non_word(queries: DataFrame, vocab: DataFrame, candidates: DataFrame | Callable[[DataFrame, DataFrame], DataFrame] = best_b) -> DataFrame:
    """(query, correction): known words stay; else the most frequent candidate, first by name if tied; else unchanged.

    ``candidates``: (query, candidate) pairs, or what finds the best of them for queries, as ``best_a`` and ``best_b`` do.
    """
    known = vocab.select(F.col("word").alias("query"), F.lit(True).alias("known"))
    marked = queries.join(known, "query", "left")
    if isinstance(candidates, DataFrame):
        ranked = candidates.join(vocab.select(F.col("word").alias("candidate"), "n"), "candidate").groupBy("query").agg(_first(F.col("n")))
    else:
        ranked = candidates(marked.where("known is null").select("query"), vocab)
    return marked.join(ranked, "query", "left").select("query", F.when(F.col("known"), F.col("query")).otherwise(F.coalesce("best.candidate", "query")).alias("correction"))


def correct_real_word(rows: DataFrame, vocab: DataFrame, bigrams: DataFrame) -> DataFrame:
    """Adds ``correction`` to (prev, word) rows: a candidate (method B) more than 1.5 times as likely in context replaces the word.

    ``prev`` null: unigram probabilities. Vocabulary and bigrams are of one stream. After a word, only what was seen there can
    be likelier, so the asked words meet the bigrams' deletions by (prev, del), each with its best word; no pairs are made.
    """
    asked = rows.select("prev", F.col("word").alias("query")).distinct()
    stats = vocab.agg(F.sum("n").alias("total"), F.count("*").alias("types"))
    there = asked.where("prev is not null")
    seen = bigrams.select(F.col("w1").alias("prev"), F.col("w2").alias("candidate"), "c").join(there.select("prev").distinct(), "prev", "left_semi")
    index = seen.select("prev", "candidate", "c", F.explode(deletions_of(F.col("candidate"))).alias("del")).groupBy("prev", "del").agg(_first(F.col("c")))
    found = _keys_b(there, "prev").join(index, ["prev", "del"]).groupBy("prev", "query").agg(F.min("best").alias("best")).select("prev", "query", F.col("best.k").alias("k"), F.col("best.candidate").alias("top"))
    own = found.join(seen.select("prev", F.col("candidate").alias("query"), F.col("c").alias("own")), ["prev", "query"], "left").join(vocab.select(F.col("word").alias("prev"), F.col("n").alias("c1")), "prev", "left")
    below = F.coalesce("c1", F.lit(0)) + F.col("types")
    two = own.crossJoin(F.broadcast(stats)).select("prev", "query", "top", ((1 - F.col("k")).cast("double") / below).alias("p"), ((F.coalesce("own", F.lit(0)) + 1).cast("double") / below).alias("own"))
    alone = asked.where("prev is null").select("query")
    first = best_b(alone, vocab).select("query", F.col("best.k").alias("k"), F.col("best.candidate").alias("top")).join(vocab.select(F.col("word").alias("query"), F.col("n").alias("own")), "query", "left").crossJoin(F.broadcast(stats))
    one = first.select(F.lit(None).cast("string").alias("prev"), "query", "top", ((-F.col("k")).cast("double") / F.col("total")).alias("p"), (F.coalesce("own", F.lit(0)).cast("double") / F.col("total")).alias("own"))
    better = two.unionByName(one).where(F.col("p") > F.col("own") * REAL_WORD_FACTOR).select(F.col("prev").alias("bp"), F.col("query").alias("bw"), F.col("top").alias("better"))
    return rows.join(better, F.col("prev").eqNullSafe(F.col("bp")) & (F.col("word") == F.col("bw")), "left").withColumn("correction", F.coalesce("better", "word")).drop("bp", "bw", "better")


def letter(h: Column) -> Column:
    return F.lit(LETTERS).substr((h % 26 + 1).cast("int"), F.lit(1))


def mutate(word: Column, seed: str) -> tuple[Column, Column]:
    """(operation, mutated): one edit chosen by a hash. Words of one letter are replaced or extended; a replaced letter is another one."""
    n, h = F.length(word), N.hashed(seed, F.lit("op"), word)
    op = F.when(n == 1, F.element_at(F.array(F.lit("replace"), F.lit("insert")), (h % 2 + 1).cast("int"))).otherwise(F.element_at(F.array(*map(F.lit, ["delete", "transpose", "replace", "insert"])), (h % 4 + 1).cast("int")))
    at = N.hashed(seed, F.lit("at"), word)
    new = N.hashed(seed, F.lit("letter"), word)

    def cut(i, j=None):
        return word.substr(F.lit(1), i) if j is None else word.substr(i, j)

    i = (at % n).cast("int")
    t = (at % F.greatest(n - 1, F.lit(1))).cast("int")
    e = (at % (n + 1)).cast("int")
    old = F.ascii(word.substr(i + 1, F.lit(1))) - 97
    inside = (old >= 0) & (old < 26)
    pick = F.when(inside, (old + 1 + new % 25) % 26).otherwise(new % 26)
    mutated = (
        F.when(op == "delete", F.concat(cut(i), cut(i + 2, n)))
        .when(op == "transpose", F.concat(cut(t), cut(t + 2, F.lit(1)), cut(t + 1, F.lit(1)), cut(t + 3, n)))
        .when(op == "replace", F.concat(cut(i), letter(pick), cut(i + 2, n)))
        .otherwise(F.concat(cut(e), letter(new), cut(e + 1, n)))
    )
    return op, mutated


def mistake(word: Column, seed: str) -> tuple[Column, Column]:
    """(operation, mutated) of the evaluation's generator: words under three letters stay; a swap at the last letter inserts instead."""
    n, h = F.length(word), N.hashed(seed, F.lit("op"), word)
    op = F.element_at(F.array(*map(F.lit, ["delete", "transpose", "replace", "insert"])), (h % 4 + 1).cast("int"))
    i = (N.hashed(seed, F.lit("at"), word) % n).cast("int")
    new = letter(N.hashed(seed, F.lit("letter"), word))
    one = F.lit(1)
    head, tail = word.substr(one, i), word.substr(i + 2, n)
    mutated = (
        F.when(n < 3, word)
        .when(op == "delete", F.concat(head, tail))
        .when((op == "transpose") & (i < n - 1), F.concat(head, word.substr(i + 2, one), word.substr(i + 1, one), word.substr(i + 3, n)))
        .when(op == "replace", F.concat(head, new, tail))
        .otherwise(F.concat(head, new, word.substr(i + 1, n)))
    )
    return op, mutated


def gate(mutations: DataFrame, vocab: DataFrame, real_word: bool) -> DataFrame:
    """Keeps a mutation only where it is (``real_word``) or is not a known word; else the word stays."""
    known = vocab.select(F.col("word").alias("mutated"), F.lit(True).alias("known"))
    joined = mutations.join(known, "mutated", "left")
    good = F.col("known").isNotNull() & (F.col("mutated") != F.col("word")) if real_word else F.col("known").isNull()
    return joined.withColumn("mutated", F.when(good, F.col("mutated")).otherwise(F.col("word"))).drop("known")
