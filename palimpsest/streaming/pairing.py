"""Stateful pairing of a stream of log entries: a trailing user waits in the state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_PAIR = "session_id string, project_name string, user_line long, assistant_line long, user_text string, assistant_text string, ts timestamp"
#: Waiting user (line, text), if any, and the last line read.
_STATE = "line long, text string, last long"


def _pair(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    line, text, last = state.get if state.exists else (None, None, 0)
    rows = pd.concat(list(batches)).sort_values("line")
    out = []
    for r in rows.itertuples():
        if r.line <= last:  # sent again
            continue
        last = int(r.line)
        if r.role == "user":
            line, text = last, r.text
        elif r.role == "assistant":
            if line is not None:
                out.append((key[0], r.project_name, line, last, (text or "").strip(), (r.text or "").strip(), r.ts))
            line = text = None
    state.update((line, text, last))
    yield pd.DataFrame(out, columns=["session_id", "project_name", "user_line", "assistant_line", "user_text", "assistant_text", "ts"])


def streamed_pairs(entries: DataFrame) -> DataFrame:
    """Turn pairs of a stream of entries, each session in line order.

    The state of a session is its waiting user and its cursor, so an entry that is sent
    again changes nothing and a pair is never split between batches.
    """
    talk = entries.where(F.col("role").isin("user", "assistant"))
    return talk.groupBy("session_id").applyInPandasWithState(_pair, _PAIR, _STATE, "append", GroupStateTimeout.NoTimeout)
