"""The retry state of a keyed event stream, in batch and as a stateful stream.

A dirty event blocks and sets the count of retries: to 1 where the event is not part of a retry (``active`` false),
else to one more than the count before (at least 1).  An active dirty event that finds ``most`` retries
used up, like any clean event, clears the state and passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def retry_decisions(events: DataFrame, most: int = 2) -> DataFrame:
    """events (key, seq, dirty, active) -> key, seq, retries (after the event), blocked, note.

    Clean and inactive events set the state whatever it was; after such a one, active dirty events go through
    2 .. most, 0, again and again, so a place in its island gives an event's state.  note: "accepted" for a clean
    active event after retries, "gave up" for a dirty one that passes.
    """
    order = Window.partitionBy("key").orderBy("seq")
    follows = F.col("dirty") & F.col("active")
    island = events.withColumn("island", F.sum(F.when(follows, 0).otherwise(1)).over(order))
    place = F.sum(follows.cast("long")).over(Window.partitionBy("key", "island").orderBy("seq"))
    cycle = F.pmod(place - 1, F.lit(most)) if most else F.lit(0)
    n = F.when(~F.col("dirty") | F.lit(most == 0), 0).when(~F.col("active"), 1).when(cycle < most - 1, cycle + 2).otherwise(0).cast("long")
    out = island.withColumn("retries", n).withColumn("before", F.coalesce(F.lag("retries").over(order), F.lit(0)))
    note = F.when(~F.col("dirty") & F.col("active") & (F.col("before") > 0), "accepted").when(F.col("dirty") & (F.col("retries") == 0), "gave up")
    return out.select("key", "seq", "retries", (F.col("dirty") & (F.col("retries") > 0)).alias("blocked"), note.alias("note"))


class RetryState(StatefulProcessor):
    """The same state machine for ``transformWithStateInPandas``.

    A batch's rows of a key are handled in order of seq.  A row whose seq is not greater than the last one handled comes
    too late: it is given out with the note "late", never blocks and leaves the state as it is.
    """

    def __init__(self, most: int = 2):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("retries", "retries long, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        n, last = self.state.get() if self.state.exists() else (0, None)
        batch = pd.concat([part[["seq", "dirty", "active"]] for part in rows]).sort_values("seq", kind="stable")
        out = []
        for seq, dirty, active in zip(batch["seq"].tolist(), batch["dirty"].tolist(), batch["active"].tolist(), strict=True):
            if last is not None and seq <= last:
                out.append((key[0], seq, n, False, "late"))
                continue
            before, stored = n, max(1, n) if active else 0
            n = stored + 1 if dirty and stored < self.most else 0
            note = "accepted" if not dirty and active and before else "gave up" if dirty and not n else None
            out.append((key[0], seq, n, bool(dirty and n), note))
            last = seq
        self.state.update((n, last))
        yield pd.DataFrame(out, columns=["key", "seq", "retries", "blocked", "note"])

    def close(self) -> None:
        pass


def retry_stream(events: DataFrame, most: int = 2) -> DataFrame:
    return events.groupBy("key").transformWithStateInPandas(RetryState(most), "key long, seq long, retries long, blocked boolean, note string", "Append", "None")
