"""The same operators on streams: decisions row by row, handlers per micro-batch, adjacent turns over micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.engine import across
from ..operators import decision
from ..operators.notify import Notifier, events
from ..policy import Policy


def check_stream(stream: DataFrame, text: str = "text", policy: Policy | None = None) -> DataFrame:
    """Decisions on a stream: no state, so that a batch and a stream give the same rows."""
    return decision.check(stream, text, policy)


def notify_batches(notifier: Notifier, policy: Policy | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch, which may repeat a batch: events carry the batch's number, so that handlers can tell repeats."""

    def deliver(batch: DataFrame, number: int) -> None:
        meta = F.create_map(F.lit("batch_id"), F.lit(str(number)))
        notifier.deliver(events(batch, policy, meta=meta))

    return deliver


def violations_per_window(decisions: DataFrame, ts: str = "ts", late: str = "10 minutes", window: str = "10 minutes") -> DataFrame:
    """Blocked rows and rows at all per window of event time; rows later than late are left out of closed windows."""
    return decisions.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w")).agg(F.count("*").alias("n"), F.count(F.when(~F.col("allowed"), 1)).alias("blocked"))


def turns_across_batches(stream: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, match): injections over a user's turn and the assistant's next one, also where they come in different micro-batches.

    The state of a conversation is its last turn. Turns of a conversation must come in order of micro-batches; within one they are sorted.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(turn)
        last_role, last_text = state.get if state.exists else ("", "")
        out = []
        for r in rows.itertuples(index=False):
            now_role, now = (getattr(r, role) or "").lower(), getattr(r, text) or ""
            if last_role == "user" and now_role == "assistant":
                out += [(key[0], getattr(r, turn), m) for _, m in across(last_text, now)]
            last_role, last_text = now_role, now
        state.update((last_role, last_text))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "match"])

    keyed = stream.select(F.col(conversation).cast("long").alias(conversation), F.col(turn).cast("long").alias(turn), role, text)
    return keyed.groupBy(conversation).applyInPandasWithState(step, "conv_id long, turn long, match string", "role string, text string", "append", GroupStateTimeout.NoTimeout)
