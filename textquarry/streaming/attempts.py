"""The ledger of a fetch run kept by a stream: attempts may come in any order, and late."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from textquarry.operators.ledger import MAX_RETRIES, RETRY_STATUSES, ledger_totals, outcome

ATTEMPTS = "query_id long, attempt int, status int, at timestamp"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = ("query_id array<long>, retries array<long>, first array<int>, outcome array<string>, "
          "settled array<boolean>, until array<long>")
_OUTCOMES = "query_id long, outcome string, attempts long"
#: Ids that are equal but for so many last bits have their state kept and updated together.
GROUP_BITS = 10


class _Settling(StatefulProcessor):
    """A group of ids: which retries of each were seen, and its first final attempt known.

    The outcome of an id is settled when all attempts before the final one are known, or when
    the watermark has passed all that was seen. A settled id only waits for its time, so that
    an attempt delivered twice is not told twice; then it is dropped. The group has one
    timer, for the id whose time comes first.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("attempts", _STATE)

    def _known(self) -> dict[int, list]:
        if not self.state.exists():
            return {}
        return {entry[0]: list(entry) for entry in zip(*self.state.get())}

    def _keep(self, known: dict[int, list]) -> None:
        registered = list(self.handle.listTimers())
        wanted = min((entry[5] for entry in known.values()), default=None)
        for timer in registered:
            if timer != wanted:
                self.handle.deleteTimer(timer)
        if wanted is None:
            self.state.clear()
            return
        if wanted not in registered:
            self.handle.registerTimer(wanted)
        self.state.update(tuple(map(list, zip(*known.values()))))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, touched = self._known(), set()
        for batch in rows:
            for name, attempt, found, until in zip(*(batch[c].tolist() for c in ("query_id", "attempt", "outcome", "until"))):
                entry = known.setdefault(name, [name, 0, None, None, False, until])
                touched.add(name)
                entry[5] = max(entry[5], until)
                if found == "retry":
                    entry[1] |= 1 << attempt
                elif entry[2] is None or attempt < entry[2]:
                    entry[2], entry[3] = attempt, found
        told = []
        for name in touched:
            _, retries, first, outcome, settled, _ = entry = known[name]
            if not settled and first is not None and retries & ((1 << first) - 1) == (1 << first) - 1:
                entry[4] = True
                told.append((name, outcome, first + 1))
        self._keep(known)
        if told:
            yield self._told(told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self._known()
        # all whose time has come, not only that of the timer
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        over = [entry for entry in known.values() if entry[5] <= now]
        self._keep({entry[0]: entry for entry in known.values() if entry[5] > now})
        told = [(name, outcome, first + 1) for name, _, first, outcome, settled, _ in over
                if first is not None and not settled]
        if told:
            yield self._told(told)

    @staticmethod
    def _told(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["query_id", "outcome", "attempts"])

    def close(self) -> None:
        pass


def settled_ids(attempts: DataFrame, delay: str = "1 day", max_retries: int = MAX_RETRIES,
                retry_statuses: tuple[int, ...] = RETRY_STATUSES) -> DataFrame:
    """(query_id, outcome, attempts) of a stream of attempts (query_id, attempt, status, at).

    Attempts may come in any order, up to ``delay`` after later ones; those that come after
    that are dropped, as the watermark wants it. An id's state is dropped once the watermark
    has passed its last attempt. Attempts without id or time are left out. State is kept in
    RocksDB, which the session is set to.
    """
    attempts.sparkSession.conf.set(PROVIDER, ROCKS)
    judged = (attempts.withWatermark("at", delay)
              .where(F.col("attempt").between(0, max_retries) & F.col("query_id").isNotNull() & F.col("at").isNotNull())
              .select("query_id", "attempt", "at", outcome(max_retries, retry_statuses).alias("outcome"),
                      F.unix_millis("at").alias("until")))
    return judged.withColumn("group", F.shiftright("query_id", GROUP_BITS)).groupBy("group").transformWithStateInPandas(
        _Settling(), outputStructType=_OUTCOMES, outputMode="Append", timeMode="EventTime")


def keep_ledger(spark: SparkSession, directory: str, target: str, checkpoint: str,
                delay: str = "1 day", **retry) -> StreamingQuery:
    """Append the outcomes settled by the attempt files that arrived since the last call, then stop."""
    arriving = spark.readStream.schema(ATTEMPTS).option("recursiveFileLookup", "true").parquet(directory)
    return (settled_ids(arriving, delay, **retry).writeStream.format("parquet").option("path", target)
            .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())


def kept_ledger(spark: SparkSession, target: str, base_processed: int = 0) -> DataFrame:
    """The run's totals from the outcomes that :func:`keep_ledger` has written."""
    return ledger_totals(spark.read.schema(_OUTCOMES).parquet(target), base_processed)
