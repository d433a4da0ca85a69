"""Probabilistic grammars from bracketed trees, and best parses by CKY in log space."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PART = re.compile(r"[()]|[^\s()]+")


def read_tree(text: str) -> tuple:
    """(label, children); a leaf is a string."""
    stack: list[list] = [[]]
    for part in _PART.findall(text):
        if part == "(":
            stack.append([])
        elif part == ")":
            done = stack.pop()
            stack[-1].append((done[0], tuple(done[1:])))
        else:
            stack[-1].append(part)
    return stack[0][0]


def show(tree) -> str:
    return tree if isinstance(tree, str) else f"({tree[0]} {' '.join(show(c) for c in tree[1])})"


def binary(tree, history: int = 2) -> tuple:
    """Right-factored: further children go under new symbols that name the parent and the next ``history`` children."""
    label, children = tree
    children = tuple(c if isinstance(c, str) else binary(c, history) for c in children)
    if len(children) <= 2:
        return label, children
    names = [c if isinstance(c, str) else c[0] for c in children]

    def rest(at: int):
        if at == len(children) - 1:
            return children[at]
        return f"{label}|<{'-'.join(names[at : at + history])}>", (children[at], rest(at + 1))

    return label, (children[0], rest(1))


def productions(tree) -> Iterator[tuple[str, list[str], bool]]:
    label, children = tree
    yield label, [c if isinstance(c, str) else c[0] for c in children], all(isinstance(c, str) for c in children)
    for c in children:
        if not isinstance(c, str):
            yield from productions(c)


def rules(trees: DataFrame, cnf: bool = True, limit: int | None = None) -> DataFrame:
    """(lhs, rhs, is_lexical, c, prob) from (tree_id, bracketed): relative frequencies. ``limit``: the first trees by id."""
    if limit is not None:
        trees = trees.orderBy("tree_id").limit(limit)

    def run(parts):
        for pdf in parts:
            rows = [p for text in pdf["bracketed"] if text for p in productions(binary(read_tree(text)) if cnf else read_tree(text))]
            yield pd.DataFrame(rows, columns=["lhs", "rhs", "is_lexical"])

    counts = trees.select("bracketed").mapInPandas(run, "lhs string, rhs array<string>, is_lexical boolean").groupBy("lhs", "rhs", "is_lexical").agg(F.count("*").alias("c"))
    totals = counts.groupBy("lhs").agg(F.sum("c").alias("total"))
    return counts.join(totals, "lhs").select("lhs", "rhs", "is_lexical", "c", (F.col("c") / F.col("total")).alias("prob"))


def kinds(found: DataFrame) -> DataFrame:
    """Adds ``kind``: lexical, binary, unary or other."""
    n = F.size("rhs")
    return found.withColumn("kind", F.when(F.col("is_lexical") & (n == 1), "lexical").when(n == 2, "binary").when(n == 1, "unary").otherwise("other"))


class Grammar:
    """Rules by right-hand side, made once for each worker."""

    def __init__(self, found: list[tuple[str, list[str], bool, float]], start: str):
        self.start, self.pairs, self.unary, self.words = start, {}, {}, {}
        for lhs, rhs, lexical, p in sorted(found, key=lambda r: (r[0], list(r[1]))):
            table, key = (self.words, rhs[0]) if lexical and len(rhs) == 1 else (self.unary, rhs[0]) if len(rhs) == 1 else (self.pairs, tuple(rhs)) if len(rhs) == 2 else (None, None)
            if table is not None and p > 0:
                table.setdefault(key, []).append((lhs, math.log(p)))
        self.after: dict[str, list] = {}
        for (left, right), rules_ in sorted(self.pairs.items()):
            self.after.setdefault(left, []).append((right, rules_))

    def close(self, cell: dict) -> None:
        """Unary rules until nothing gets better."""
        todo = list(cell)
        while todo:
            below = todo.pop(0)
            for lhs, p in self.unary.get(below, ()):
                if (score := cell[below][0] + p) > cell.get(lhs, (-math.inf,))[0]:
                    cell[lhs] = (score, (below,))
                    todo.append(lhs)

    def parse(self, words: list[str]) -> tuple[str, float] | None:
        """(bracketed tree, log probability) or nothing. Words are looked up as they are, else in small letters; ties: the first split, then the symbol first by name."""
        n = len(words)
        if not n or not all(self.words.get(w) or self.words.get(w.lower()) for w in words):
            return None  # a word that the grammar lacks has no cell, and so no tree above it
        chart: list[list[dict]] = [[{} for _ in range(n + 1)] for _ in range(n + 1)]
        for i, w in enumerate(words):
            for lhs, p in self.words.get(w) or self.words.get(w.lower(), ()):
                chart[i][i + 1][lhs] = (p, w)
            self.close(chart[i][i + 1])
        for width in range(2, n + 1):
            for i in range(n - width + 1):
                j, cell = i + width, chart[i][i + width]
                for k in range(i + 1, j):
                    below, beside = chart[i][k], chart[k][j]
                    if not below or not beside:
                        continue
                    for left in sorted(below):
                        for right, found in self.after.get(left, ()):
                            if right not in beside:
                                continue
                            both = below[left][0] + beside[right][0]
                            for lhs, p in found:
                                if (score := both + p) > cell.get(lhs, (-math.inf,))[0]:
                                    cell[lhs] = (score, (k, left, right))
                self.close(cell)
        if self.start not in chart[0][n]:
            return None

        def build(i, j, symbol) -> str:
            back = chart[i][j][symbol][1]
            if isinstance(back, str):
                return f"({symbol} {back})"
            if len(back) == 1:
                return f"({symbol} {build(i, j, back[0])})"
            k, left, right = back
            return f"({symbol} {build(i, k, left)} {build(k, j, right)})"

        return build(0, n, self.start), chart[0][n][self.start][0]


def parse_sentences(sents: DataFrame, found: DataFrame, start: str = "S", *keys: str) -> DataFrame:
    """(keys, tree, logprob) of (keys, words) rows, ``sent_id`` if no keys are named; null where there is no parse.

    Sentences of any length are parsed; the chart is cubic in their words. Each distinct word sequence is parsed once.
    """
    keys = keys or ("sent_id",)
    known = F.coalesce(_known(_rules(found)), F.lit(False))
    none = sents.where(~known).select(*keys, F.lit(None).cast("string").alias("tree"), F.lit(None).cast("double").alias("logprob"))
    return found_parses(sents, found, start, *keys).unionByName(none)


def _rules(found: DataFrame) -> list[tuple]:
    return [(r["lhs"], list(r["rhs"]), r["is_lexical"], r["prob"]) for r in found.collect()]  # a grammar's rules


def _known(held: list[tuple]) -> Column:
    """Whether the grammar can have all words. Words of other scripts pass, as their small letters may be made another way here than in the kernel."""
    words = sorted({rhs[0] for _, rhs, lexical, p in held if lexical and len(rhs) == 1 and p > 0})
    return F.forall("words", lambda w: w.isin(words) | F.lower(w).isin(words) | w.rlike(r"[^\x00-\x7F]"))


def found_parses(sents: DataFrame, found: DataFrame, start: str = "S", *keys: str) -> DataFrame:
    """The rows of ``parse_sentences`` that can have a parse: sentences with a word that the grammar lacks are left out before any is dealt."""
    keys = keys or ("sent_id",)
    held = _rules(found)
    grammar = sents.sparkSession.sparkContext.broadcast(held)
    sents = sents.where(_known(held))

    def run(parts):
        g = Grammar(grammar.value, start)
        for pdf in parts:
            best = [g.parse(list(w)) for w in pdf["words"]]
            yield pd.DataFrame({"line": pdf["line"], "tree": [b and b[0] for b in best], "logprob": [b and b[1] for b in best]})

    rows = sents.select(*keys, "words", F.to_json("words").alias("line"))
    parsed = rows.select("line", "words").dropDuplicates(["line"]).mapInPandas(run, "line string, tree string, logprob double")
    return rows.join(parsed, "line").select(*keys, "tree", "logprob")


def display(logprob) -> object:
    """The score as text with four places, floored at ln 1e-300, or Unparseable."""
    return F.when(logprob.isNull(), "Unparseable").otherwise(F.format_string("%.4f", F.greatest(logprob, F.lit(math.log(1e-300)))))
