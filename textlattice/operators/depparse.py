"""Arc-standard dependency parsing: oracle transitions, a classifier over four tags, greedy decoding, attachment scores."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ["stack_top", "stack_second", "buffer_first", "buffer_second"]
NONE = "NULL"


class State:
    """Stack, buffer and arcs of one sentence; token 0 is the root."""

    def __init__(self, tags: dict[int, str]):
        self.tags = {0: "ROOT", **tags}
        self.stack, self.buffer, self.arcs = [0], sorted(tags), []

    def features(self) -> tuple[str, str, str, str]:
        ids = [*reversed(self.stack[-2:]), *[None] * (2 - len(self.stack[-2:])), *self.buffer[:2], *[None] * (2 - len(self.buffer[:2]))]
        return tuple(NONE if i is None else self.tags[i] for i in ids)

    def legal(self, action: str) -> bool:
        if action == "SHIFT":
            return bool(self.buffer)
        if len(self.stack) < 2:
            return False
        return self.stack[-2] != 0 if action.startswith("LEFT") else True

    def apply(self, action: str) -> None:
        if action == "SHIFT":
            self.stack.append(self.buffer.pop(0))
            return
        label = action.partition(":")[2]
        child = self.stack.pop(-2 if action.startswith("LEFT") else -1)
        self.arcs.append((self.stack[-1], child, label))

    def done(self) -> bool:
        return not self.buffer and len(self.stack) == 1


def oracle(tokens: list[tuple[int, str, int, str]]) -> list[tuple[str, tuple]]:
    """(action, features) steps of a gold tree of (id, tag, head, label); it ends where no step fits (crossing arcs)."""
    heads = {i: (h, lab) for i, _, h, lab in tokens}
    waiting = Counter(h for _, _, h, _ in tokens)  # children that are not attached yet
    state, out = State({i: tag for i, tag, _, _ in tokens}), []
    while not state.done():
        action = None
        if len(state.stack) > 1:
            top, second = state.stack[-1], state.stack[-2]
            if second and heads[second][0] == top and not waiting[second]:
                action = f"LEFT-ARC:{heads[second][1]}"
                waiting[top] -= 1
            elif heads[top][0] == second and not waiting[top]:
                action = f"RIGHT-ARC:{heads[top][1]}"
                waiting[second] -= 1
        if action is None:
            if not state.buffer:
                break
            action = "SHIFT"
        out.append((action, state.features()))
        state.apply(action)
    return out


def transitions(conllu: DataFrame) -> DataFrame:
    """(sent_id, step, action, four features) of each gold tree."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        steps = oracle(list(zip(pdf["id"], pdf["upos"], pdf["head"], pdf["deprel"], strict=True)))
        return pd.DataFrame([(pdf["sent_id"].iloc[0], n, a, *f) for n, (a, f) in enumerate(steps, 1)], columns=["sent_id", "step", "action", *FEATURES])

    return conllu.groupBy("sent_id").applyInPandas(run, "sent_id bigint, step bigint, action string, " + ", ".join(f"{f} string" for f in FEATURES))


def action_distribution(steps: DataFrame, top: int = 10) -> DataFrame:
    counts = steps.groupBy("action").agg(F.count("*").alias("n")).crossJoin(F.broadcast(steps.agg(F.count("*").alias("total"))))
    return counts.select("action", "n", F.round(F.col("n") * 100.0 / F.col("total"), 4).alias("pct")).orderBy(F.desc("n"), "action").limit(top)


def one_hot(steps: DataFrame) -> DataFrame:
    """(feature, value, idx): the columns of the indicator encoding, in order of feature and value."""
    values = steps.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES])).alias("x")).select("x.*").distinct()
    # one row a feature value: tags, a label set
    listed = values.agg(F.array_sort(F.collect_list(F.struct("feature", "value"))).alias("v"))
    return listed.select(F.posexplode("v").alias("idx", "x")).select("x.feature", "x.value", F.col("idx").cast("bigint"))


def fit_classifier(steps: DataFrame, max_iter: int = 500):
    """A multinomial logistic regression over indicator features. Equal rows are one weighted row first."""
    rows = steps.groupBy(*FEATURES, "action").agg(F.count("*").cast("double").alias("weight"))
    n = rows.agg(F.sum("weight")).first()[0]
    index = StringIndexer(inputCols=FEATURES, outputCols=[f"{f}_i" for f in FEATURES], handleInvalid="keep", stringOrderType="alphabetAsc")
    label = StringIndexer(inputCol="action", outputCol="label", stringOrderType="alphabetAsc")
    hot = OneHotEncoder(inputCols=[f"{f}_i" for f in FEATURES], outputCols=[f"{f}_h" for f in FEATURES], dropLast=False, handleInvalid="keep")
    joined = VectorAssembler(inputCols=[f"{f}_h" for f in FEATURES], outputCol="features")
    model = LogisticRegression(family="multinomial", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=max_iter, weightCol="weight")
    labels = label.fit(rows)
    fitted = Pipeline(stages=[index, hot, joined, model]).fit(labels.transform(rows))
    return fitted, labels.labels


def ranked(fitted, labels: list[str], feature_rows: DataFrame) -> DataFrame:
    """(four features, rank, action, p) for each distinct feature tuple."""
    named = F.array(*map(F.lit, labels))
    scored = fitted.transform(feature_rows.select(*FEATURES).distinct()).select(*FEATURES, F.transform(vector_to_array("probability"), lambda p, i: F.struct((-p).alias("k"), F.get(named, i).alias("action"))).alias("x"))
    return scored.select(*FEATURES, F.posexplode(F.array_sort("x")).alias("rank", "x")).select(*FEATURES, (F.col("rank") + 1).cast("bigint").alias("rank"), "x.action", (-F.col("x.k")).alias("p"))


def accuracy(fitted, labels: list[str], steps: DataFrame) -> DataFrame:
    best = ranked(fitted, labels, steps).where("rank = 1").select(*FEATURES, F.col("action").alias("pred"))
    return steps.join(best, FEATURES).agg(F.count("*").alias("n"), F.avg((F.col("action") == F.col("pred")).cast("double")).alias("accuracy"))


def parse(tags: list[tuple[int, str]], rank: Callable[[tuple], list[str]]) -> list[tuple[int, int, str]]:
    """(head, child, label) by the best legal action each time; if none is legal: shift, then attach as dep."""
    state = State(dict(tags))
    while not state.done():
        options = [*rank(state.features()), "SHIFT", "RIGHT-ARC:dep", "LEFT-ARC:dep"]
        action = next((a for a in options if state.legal(a)), None)
        if action is None:
            break
        state.apply(action)
    return state.arcs


def parse_sentences(conllu: DataFrame, fitted, labels: list[str]) -> DataFrame:
    """(sent_id, id, head, deprel). Rankings are made once for each tuple of known tags, which are a label set."""
    tags = [r[0] for r in conllu.select("upos").distinct().orderBy("upos").collect()]
    tables = [[*tags, "ROOT", NONE], [*tags, "ROOT", NONE], [*tags, NONE], [*tags, NONE]]
    grid = conllu.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, tables[0]))).alias(FEATURES[0]))
    for f, values in zip(FEATURES[1:], tables[1:], strict=True):
        grid = grid.select("*", F.explode(F.array(*map(F.lit, values))).alias(f))
    order = {tuple(r[f] for f in FEATURES): r["a"] for r in ranked(fitted, labels, grid).groupBy(*FEATURES).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "action"))), lambda s: s["action"]).alias("a")).collect()}
    shared = conllu.sparkSession.sparkContext.broadcast(order)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        arcs = parse(list(zip(pdf["id"], pdf["upos"], strict=True)), lambda f: shared.value.get(f, []))
        return pd.DataFrame([(pdf["sent_id"].iloc[0], c, h, lab) for h, c, lab in sorted(arcs, key=lambda a: a[1])], columns=["sent_id", "id", "head", "deprel"])

    return conllu.groupBy("sent_id").applyInPandas(run, "sent_id bigint, id int, head int, deprel string")


def attachment(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row (n, uas, las) over all gold tokens, in percent; a label counts only where the head is right."""
    other = pred.select("sent_id", "id", F.col("head").alias("h"), F.col("deprel").alias("d"))
    head = F.coalesce(F.col("head") == F.col("h"), F.lit(False))
    both = head & F.coalesce(F.col("deprel") == F.col("d"), F.lit(False))
    return gold.join(other, ["sent_id", "id"], "left").agg(F.count("*").alias("n"), (100 * F.avg(head.cast("double"))).alias("uas"), (100 * F.avg(both.cast("double"))).alias("las"))
