"""The live editor as a stateful stream: per document, the number of tokens so far and the last five corrected ones."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

EVERY = 5
_STATE = "n bigint, last array<string>"
SCHEMA = "doc_id bigint, pos bigint, corrected string, alert_kind string, window string"
_NOT_WORD = re.compile(r"[\W_]+")


def clean(token: str) -> str:
    return _NOT_WORD.sub("", token).lower()


def editor_stream(checked: DataFrame) -> DataFrame:
    """Adds to (doc_id, pos, corrected, clean, alert_kind) rows the trigger window where one fires, null elsewhere.

    Token checks need no state and are joined before; here each document keeps five tokens and a counter,
    so state is bounded. Rows of one document are taken in order of ``pos`` within a batch.
    """
    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, [])
        last = list(last)
        rows = []
        for r in pd.concat(list(parts)).sort_values("pos").itertuples():
            n += 1
            last = [*last, r.corrected][-EVERY:]
            window = None
            if n % EVERY == 0 and r.clean:
                words = [w for w in map(clean, last) if w]
                window = " ".join(words) if len(words) >= 3 else None
            rows.append((key[0], r.pos, r.corrected, r.alert_kind, window))
        state.update((n, last))
        yield pd.DataFrame(rows, columns=["doc_id", "pos", "corrected", "alert_kind", "window"])

    return checked.groupBy("doc_id").applyInPandasWithState(run, SCHEMA, _STATE, "append", GroupStateTimeout.NoTimeout)
