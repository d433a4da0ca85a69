"""Trained models as Parquet tables under one path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from textlattice.operators import ngram, pcfg, spelling, tagging
from textlattice.operators.ngram import CountTables


class Registry:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, model: str, tables: dict[str, DataFrame]) -> None:
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{self.root}/{model}/{name}")

    def load(self, model: str, name: str, missing: Callable[[], DataFrame] | None = None) -> DataFrame:
        """A table; where an older model lacks it, what ``missing`` makes."""
        try:
            return self.spark.read.parquet(f"{self.root}/{model}/{name}")
        except AnalysisException:
            if missing is None:
                raise
            return missing()

    def save_counts(self, model: str, lm: CountTables) -> None:
        self.save(model, {"uni": lm.uni, "bi": lm.bi, "tri": lm.tri})

    def load_counts(self, model: str) -> CountTables:
        return CountTables(*(self.load(model, n) for n in ("uni", "bi", "tri")))

    def load_or_train(self, models: list[str], train: Callable[[], CountTables]) -> CountTables:
        """The first saved model of the list, else a new one, saved under the first name."""
        for model in models:
            try:
                return self.load_counts(model)
            except AnalysisException:
                continue
        self.save_counts(models[0], train())
        return self.load_counts(models[0])


def export_models(registry: Registry, sents: DataFrame, stream: DataFrame, tagged: DataFrame, trees: DataFrame) -> dict[str, str]:
    """Train and save every model: language model, spelling, both taggers, grammar. The paths of their tables by name.

    ``sents``: (words) sentences; ``stream``: (words) alphabetic words; ``tagged``: (user_id, pos, word, tag); ``trees``: (tree_id, bracketed).
    """
    lm, vocab = ngram.train(sents), spelling.vocabulary(stream)
    mft, modal = tagging.train_mft(tagged)
    models = {
        "lm": {"uni": lm.uni, "bi": lm.bi, "tri": lm.tri},
        "spelling": {"vocab": vocab, "bigrams": spelling.stream_bigrams(stream), "deletions": spelling.deletions(vocab)},
        "segmentation": {"lexicon": spelling.segmentation_vocabulary(vocab)},
        "mft": {"words": mft, "modal": modal},
        "hmm": {"transitions": tagging.transitions(tagged), "emissions": tagging.emissions(tagged)},
        "grammar": {"rules": pcfg.rules(trees)},
    }
    for model, tables in models.items():
        registry.save(model, tables)
    return {f"{model}/{name}": f"{registry.root}/{model}/{name}" for model, tables in models.items() for name in tables}
