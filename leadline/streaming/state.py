"""State by key: soft bounces against a budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

BUDGET = 3


def soft_bounces(bounces: DataFrame, recipient: str = "recipient", budget: int = BUDGET) -> DataFrame:
    """(recipient, soft, suppressed) after each batch that brings a soft bounce of the recipient (OP-T04); state is one number a key."""

    def step(key, frames, state):
        n = (state.get[0] if state.exists else 0) + sum(len(f) for f in frames)
        state.update((n,))
        yield pd.DataFrame({"recipient": [key[0]], "soft": [n], "suppressed": [n >= budget]})

    soft = bounces.where("kind = 'soft'").selectExpr(f"cast({recipient} as string) as recipient", "kind")
    return soft.groupBy("recipient").applyInPandasWithState(step, "recipient string, soft long, suppressed boolean", "soft long", "update", GroupStateTimeout.NoTimeout)
