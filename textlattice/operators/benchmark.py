"""Latencies of the editor's pipelines over a table of tokens."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngram import CountTables

#: Milliseconds between two frames of a display.
FRAME_MS = 16.0


def seconds(df: DataFrame) -> float:
    """Wall-clock time of computing all rows and columns, without keeping them."""
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def report(tokens: DataFrame, pipelines: dict[str, Callable[[CountTables], DataFrame]], lm: CountTables) -> DataFrame:
    """One row a pipeline: n_tokens, seconds, ms_per_token, tokens_per_second, within_frame, speedup over the first.

    Models are counted in a pipeline's time as far as its plan makes them. Latency a token is the mean of a whole table's
    run, since tokens are checked side by side; an empty table has none.
    """
    n = tokens.count()
    spent = {name: seconds(run(lm)) for name, run in pipelines.items()}
    first = next(iter(spent.values()))
    rows = [(name, n, s, 1000 * s / n if n else None, n / s, first / s) for name, s in spent.items()]
    out = tokens.sparkSession.createDataFrame(rows, "pipeline string, n_tokens bigint, seconds double, ms_per_token double, tokens_per_second double, speedup double")
    return out.withColumn("within_frame", F.col("ms_per_token") <= FRAME_MS)
