"""Thread assignment for a stream of messages, with a conversation's threads as state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spindle.operators.classify import analyzed
from spindle.operators.conversation import THREADS, Replay


def stream_threads(messages: DataFrame) -> DataFrame:
    """As conversation.threads, for a streaming DataFrame (conv_id, turn, role, text).

    Messages of a conversation must arrive in order of turn between batches; within a batch they are
    sorted. The state of a conversation is its threads' domains and topic words.
    """
    told = analyzed(messages.select("conv_id", "turn", "role", "text"), "text").select("conv_id", "turn", "role", "domain", "is_followup", "is_reference", "is_new_topic", "continues", "topic")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = Replay(json.loads(state.get[0]) if state.exists else None)
        rows = pd.concat(list(batches)).sort_values("turn")
        out = [(r.conv_id, r.turn, *own.feed(r)) for r in rows.itertuples(index=False)]
        state.update((json.dumps(own.state()),))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "thread_id", "domain", "is_new"])

    return told.groupBy("conv_id").applyInPandasWithState(step, THREADS, "state string", "append", GroupStateTimeout.NoTimeout)
