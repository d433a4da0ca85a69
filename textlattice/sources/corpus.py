"""Corpora as relations: sentences and tokens of documents, deterministic splits, CoNLL-U text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlattice.functions import normalize as N


def _worded(text: Column) -> Column:
    """The parts of a text that have a clean word, which is to say an ASCII letter or digit."""
    return F.filter(N.sentence_parts(text), lambda s: s.rlike("[a-zA-Z0-9]"))


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, sent_id, text, words): sentences with at least one clean word, numbered from 0 in their document."""
    cut = docs.select("doc_id", F.posexplode(_worded(F.col("text"))).alias("sent_id", "s"))
    return cut.select("doc_id", F.col("sent_id").cast("bigint"), N.strip(F.col("s")).alias("text"), N.clean_words(F.col("s")).alias("words"))


_CUT = re.compile("(?<=[.!?])[ \t\n\x0b\f\r]+|" + N.SENTENCE_MARK)
#: For ``bytes.translate``: capitals become small; what is no ASCII letter, digit or white space goes, and so every byte of other characters.
_SMALL = bytes(range(256)).lower()
_DROPPED = bytes(b for b in range(256) if not chr(b).isascii() or not (chr(b).isalnum() or chr(b) in " \t\n\x0b\f\r"))
#: Words that are given to Arrow at once.
CHUNK = 1 << 17


def _stripped(text: str) -> str:
    """``N.strip``: its ``$`` also holds before a last line end, of which three are no white space there."""
    end = len(text) - (text[-1:] in ("\x85", "\u2028", "\u2029"))
    return text[:end].strip(" \t\n\x0b\f\r") + text[end:]


def sentence_words(docs: DataFrame, text: bool = False) -> DataFrame:
    """(doc_id, sent_id, words), and ``text`` if asked for: the rows of ``sentences``. An Arrow kernel, several times faster than the same in expressions."""
    schema = pa.schema([("doc_id", pa.int64()), ("sent_id", pa.int64()), *([("text", pa.string())] if text else []), ("words", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given() -> pa.RecordBatch:
            words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.string()))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int64()), *([pa.array(parts, pa.string())] if text else []), words], schema=schema)

        ids, places, parts, flat, ends = [], [], [], [], [0]
        for batch in batches:
            for ident, whole in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if (whole := whole.as_py()) is None:
                    continue
                at = 0
                for part in _CUT.split(_stripped(whole)):
                    if found := part.encode().translate(_SMALL, _DROPPED).split():
                        ids.append(ident)
                        places.append(at)
                        at += 1
                        if text:
                            parts.append(_stripped(part))
                        flat += found
                        ends.append(len(flat))
                        if len(flat) >= CHUNK:
                            yield given()
                            ids, places, parts, flat, ends = [], [], [], [], [0]
        if ids:
            yield given()

    kind = "doc_id bigint, sent_id bigint, " + ("text string, " if text else "") + "words array<string>"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, kind)


#: Marks the ends of sentences in ``marked`` texts; a text that holds it is cut there, as ``N.sentence_parts`` cuts it.
_END = re.compile(rb"([.!?])[ \t\n\x0b\f\r]+")
_MARK = N.SENTENCE_MARK.encode()
_DROPPED_BUT_MARK = bytes(b for b in _DROPPED if b != _MARK[0])


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, n, marked): the words of ``sentences``, one space between words and one mark between sentences; n sentences, one at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, texts = [], [], []
            for ident, whole in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if (whole := whole.as_py()) is None:
                    continue
                parts = _END.sub(_MARK, whole.encode()).translate(_SMALL, _DROPPED_BUT_MARK).split(_MARK)
                lines = [b" ".join(words) for part in parts if (words := part.split())]
                if lines:
                    ids.append(ident)
                    sizes.append(len(lines))
                    texts.append(_MARK.join(lines))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n", "marked"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n bigint, marked string")


def sentence_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n): sentences of each document; none are made for it."""
    return docs.select("doc_id", F.size(_worded(F.col("text"))).cast("bigint").alias("n")).where("n > 0")


def english(docs: DataFrame) -> DataFrame:
    return docs.where("lang = 'en'")


def prefix_condition(counts: DataFrame, ratio: float = 0.8, per_step: int = 1 << 16) -> Column:
    """A condition that holds for the first int(n * ratio) sentences in (doc_id, sent_id) order, from (doc_id, n) counts."""
    cut = prefix_cut(counts, ratio, per_step)
    if cut is None:
        return F.lit(False)
    return (F.col("doc_id") < cut[0]) | ((F.col("doc_id") == cut[0]) & (F.col("sent_id") < cut[1]))


def marked_prefix(texts: DataFrame, ratio: float = 0.8) -> DataFrame:
    """(marked): of ``marked`` rows, the sentences for which ``prefix_condition`` holds."""
    cut = prefix_cut(texts.select("doc_id", "n"), ratio)
    if cut is None:
        return texts.where("false").select("marked")
    last = F.when(F.col("doc_id") < cut[0], F.col("marked")).otherwise(F.substring_index("marked", N.SENTENCE_MARK, cut[1]))
    return texts.where(F.col("doc_id") <= cut[0]).select(last.alias("marked")).where("marked <> ''")


def prefix_cut(counts: DataFrame, ratio: float = 0.8, per_step: int = 1 << 16) -> tuple[int, int] | None:
    """The document that holds the end of the first int(n * ratio) sentences, and how many of its sentences belong to them.

    No global sort: the cut is found by summing counts over ranges of doc_id, at most ``per_step`` sums a step come
    back. Ids that lie close together need one pass over the
    texts; the bounds come from the ids alone, and any further pass reads one range of ids only.
    """
    low, high = counts.agg(F.min("doc_id"), F.max("doc_id")).first()
    left = None
    while low is not None:
        width = max(1, -(-(high - low + 1) // per_step))
        ranges = F.floor((F.col("doc_id") - low) / width).cast("bigint")
        sums = counts.where(F.col("doc_id").between(low, high)).groupBy(ranges.alias("b")).agg(F.sum("n").alias("n")).collect()
        if left is None:
            left = int(sum(r["n"] for r in sums) * ratio)
        if not left:
            break
        for row in sorted(sums):
            if left <= row["n"]:
                low += row["b"] * width
                high = low + width - 1
                break
            left -= row["n"]
        if width == 1:
            return low, left
    return None


def conllu(text: DataFrame) -> DataFrame:
    """(file, sent_id, id, form, upos, head, deprel, feats) from whole CoNLL-U files, one per row (``text`` column, ``file`` key).

    Comments, ranges and empty nodes are skipped; a blank line ends a sentence; the last needs none.
    """
    blocks = F.filter(F.split(F.col("text"), r"\n[ \t\r]*\n"), lambda b: N.strip(b) != "")
    lines = text.select("file", F.posexplode(blocks).alias("sent_id", "block")).select("file", "sent_id", F.posexplode(F.split("block", r"\r?\n")).alias("line_no", "line"))
    cells = lines.where("line <> '' and not startswith(line, '#')").withColumn("c", F.split("line", "\t")).where(F.col("c")[0].rlike("^[0-9]+$"))
    c = F.col("c")
    return cells.select("file", F.col("sent_id").cast("bigint"), c[0].cast("int").alias("id"), c[1].alias("form"), c[3].alias("upos"), F.expr("try_cast(c[6] as int)").alias("head"), c[7].alias("deprel"), c[5].alias("feats"))


def conllu_files(spark: SparkSession, path: str) -> DataFrame:
    """The tokens of all CoNLL-U files under a path (a file, a folder or a pattern), each file by its name."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("text"))
    return conllu(files)


def tagged_sentences(tokens: DataFrame, morphology: bool = False) -> DataFrame:
    """(file, sent_id, words, tags) of CoNLL-U tokens without punctuation; ``morphology``: tags with gender and number."""
    tag = morph_tag(F.col("upos"), F.col("feats")) if morphology else F.col("upos")
    kept = tokens.where("upos <> 'PUNCT'").select("file", "sent_id", "id", N.clean_spanish(F.col("form")).alias("word"), tag.alias("tag")).where("word <> ''")
    line = kept.groupBy("file", "sent_id").agg(F.array_sort(F.collect_list(F.struct("id", "word", "tag"))).alias("s"))
    return line.select("file", "sent_id", F.col("s.word").alias("words"), F.col("s.tag").alias("tags"))


def morph_tag(upos: Column, feats: Column) -> Column:
    """``UPOS-Gender-Number``, with ``None`` for what is absent."""
    def of(name):
        found = F.regexp_extract(feats, rf"(?:^|\|){name}=([^|]*)", 1)
        return F.when(feats.isNull() | (found == ""), F.lit("None")).otherwise(found)

    return F.concat_ws("-", upos, of("Gender"), of("Number"))


def adjacent_pairs(sents: DataFrame) -> DataFrame:
    """(left, right, n): neighbours within a sentence."""
    w = F.col("words")
    pairs = F.arrays_zip(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))).alias("left"), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))).alias("right"))
    return sents.where(F.size("words") > 1).select(F.explode(pairs).alias("p")).groupBy("p.left", "p.right").agg(F.count("*").alias("n"))


def sample_passages(sents: DataFrame, least: int = 5, most: int = 8, seed: str = "passage") -> DataFrame:
    """One run of ``least`` to ``most`` consecutive sentences of each document that has as many, spacing tidied."""
    texts = sents.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sent_id", "text"))), lambda s: s["text"]).alias("t"))
    n = F.size("t").cast("bigint")
    take = F.least(n, F.lit(least) + N.hashed(seed, F.lit("n"), F.col("doc_id")) % (most - least + 1))
    start = N.hashed(seed, F.lit("s"), F.col("doc_id")) % (n - take + 1)
    return texts.where(n >= least).select("doc_id", N.tidy_spacing(F.array_join(F.slice("t", (start + 1).cast("int"), take.cast("int")), " ")).alias("passage"))
