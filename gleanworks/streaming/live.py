"""Progress of runs while their answers arrive: counts, exact lower median latency and what is pending, as keyed state.

The state of a run is a map of its latencies to how often each occurred, sums, and the keys answered so far: an answer that
is delivered twice counts once, and a restarted stream goes on where it stopped. A run from which nothing has come for a
while is reported as idle and its state is dropped, so that state does not grow with the runs that were ever seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ANSWERED = "run_id string, record_id string, answered_at timestamp, latency_ms long, failed boolean, retries long, prompt_tokens long, total long"
PROGRESS = "run_id string, done long, parse_failures long, retries long, median_latency long, prompt_tokens long, pending long, eta double, idle boolean"


def lower_median(counts: dict[int, int]) -> int | None:
    """The lower of the two middle values, of values with how often each occurs."""
    n = sum(counts.values())
    for value in sorted(counts):
        n -= 2 * counts[value]
        if n <= 0:
            return value
    return None


class RunProgress(StatefulProcessor):
    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.answered = handle.getMapState("answered", "record_id string", "seen boolean")
        self.latencies = handle.getMapState("latencies", "latency_ms long", "n long")
        self.sums = handle.getValueState("sums", "done long, failures long, retries long, tokens long, spent long, total long, latest long")

    def _row(self, key: tuple, idle: bool) -> pd.DataFrame:
        done, failures, retries, tokens, spent, total, _ = self.sums.get()
        median = lower_median({k[0]: v[0] for k, v in self.latencies.iterator()})
        pending = max(total - done, 0)
        return pd.DataFrame({"run_id": [key[0]], "done": [done], "parse_failures": [failures], "retries": [retries], "median_latency": pd.array([median], "Int64"), "prompt_tokens": [tokens], "pending": [pending], "eta": [round(spent / done * pending, 6) if done else 0.0], "idle": [idle]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        sums = list(self.sums.get()) if self.sums.exists() else [0] * 7
        for batch in rows:
            for r in batch.itertuples():
                sums[6] = max(sums[6], int(r.answered_at.timestamp() * 1000))
                if self.answered.containsKey((r.record_id,)):
                    continue
                self.answered.updateValue((r.record_id,), (True,))
                if not pd.isna(r.latency_ms):
                    latency = (int(r.latency_ms),)
                    n = self.latencies.getValue(latency)[0] if self.latencies.containsKey(latency) else 0
                    self.latencies.updateValue(latency, (n + 1,))
                values = (1, bool(r.failed), r.retries, r.prompt_tokens, r.latency_ms)
                sums[:5] = [a + (0 if pd.isna(b) else int(b)) for a, b in zip(sums[:5], values, strict=True)]
                sums[5] = max(sums[5], 0 if pd.isna(r.total) else int(r.total))
        self.sums.update(tuple(sums))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(sums[6] + self.idle_ms)
        yield self._row(key, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.sums.exists():
            yield self._row(key, True)
            for state in (self.answered, self.latencies, self.sums):
                state.clear()

    def close(self) -> None:
        pass


def run_progress(answers: DataFrame, idle: float = 3600.0, late: str = "10 minutes") -> DataFrame:
    """A row per run after each micro-batch in which answers of it came (ANSWERED): PROGRESS, that is the numbers of
    ``operators.runs.run_progress`` over all answers so far, with what is pending.

    Repeated answers to a record count once, nulls count as nothing, an answer without a time and one later than ``late``
    are left out. When answers elsewhere are ``idle`` seconds on, a run gets a last row, and is a new one afterwards. The
    session needs the RocksDB state store.
    """
    timed = answers.where("answered_at IS NOT NULL").withWatermark("answered_at", late)
    return timed.groupBy("run_id").transformWithStateInPandas(RunProgress(int(idle * 1000)), outputStructType=PROGRESS, outputMode="Update", timeMode="EventTime")
