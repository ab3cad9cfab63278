"""The gate as a stateful stream.

Steps arrive as files and are taken chunk by chunk as they come:
``groupBy(run).transformWithStateInPandas`` keeps, in the RocksDB store, one
small value per run (the step that is next, latch, counts, energy) and a list
of the steps that came ahead of their turn.  A run's steps are numbered without
gaps; a step waits in the list until those before it have come.  If they do not
come, the wait ends with the micro-batch or, for a stream that goes on, by a
timer of ``patience_ms``, and the waiting steps are decided in order.  A step
that comes after its turn is decided when it comes; none is dropped.  Memory is bounded by a chunk and by what is ahead of its
turn, not by the run.  Exactly-once comes from the stream's checkpoint.  For
steps that all arrive the output equals the batch latch step for step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STEP_SCHEMA = "run long, step long, prob double, phase string, delta_norm double"
OUT_SCHEMA = ("run long, step long, prob double, probe_fire boolean, held boolean, fired boolean, "
              "latch_remaining int, n_calls long, n_fired long, n_hysteresis_holds long, energy double")
#: ``next``: the step that is next; ``least``: the smallest step that waits.
STATE_SCHEMA = "next long, latch int, n_calls long, n_fired long, holds long, energy double, least long"
AHEAD = ["step", "prob", "phase", "delta_norm"]
AHEAD_SCHEMA = "step long, prob double, phase string, delta_norm double"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Steps of a run in one slice of the source.
SLICE_STEPS = 1 << 14


def latch_block(fire: np.ndarray, latch: int, n_hold: int) -> tuple[np.ndarray, np.ndarray]:
    """(held, latch after each decision) of consecutive decisions that begin
    with ``latch`` holds left."""
    k = np.arange(len(fire))
    # the latch that is left counts as a fire before the first decision
    last = np.maximum.accumulate(np.where(fire, k, latch - n_hold - 1))
    left = np.maximum(n_hold - (k - last), 0)
    held = ~fire & (k - last <= n_hold) if n_hold else np.zeros(len(fire), bool)
    return held, np.where(fire, n_hold, left)


def _arrays(rows: pd.DataFrame) -> list[np.ndarray]:
    """The columns ``AHEAD``.  A run is often a few steps, for which making
    pandas frames costs more than deciding them."""
    return [rows[c].to_numpy() for c in AHEAD]


def _in_order(batch: list[np.ndarray]) -> list[np.ndarray]:
    """The rows by step; those of the same step stay in their order."""
    if (batch[0][1:] >= batch[0][:-1]).all():
        return batch
    order = np.argsort(batch[0], kind="stable")
    return [c[order] for c in batch]


class GateProcessor(StatefulProcessor):
    """The gate of one run."""

    def __init__(self, threshold: float, n_hold: int, prefill_unsteered: bool = True, patience_ms: int | None = None):
        self.threshold, self.n_hold, self.prefill_unsteered, self.patience_ms = threshold, n_hold, prefill_unsteered, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.gate = handle.getValueState("gate", STATE_SCHEMA)
        self.ahead = handle.getListState("ahead", AHEAD_SCHEMA)

    def close(self) -> None:
        pass

    def _load(self) -> None:
        kept = self.gate.get()
        self.at = [1, 0, 0, 0, 0, 0.0, None] if kept is None else list(kept)

    def _decide(self, run, batch: list[np.ndarray]) -> pd.DataFrame:
        """Decisions of steps in their order; the state moves on."""
        _, latch, n_calls, n_fired, holds, energy, _ = self.at
        step, prob, phase, delta = batch
        decode = phase.astype(object) == "decode"
        calls = n_calls + np.cumsum(decode | self.prefill_unsteered)
        own = prob[decode]
        fire = own > self.threshold
        held, left = latch_block(fire, latch, self.n_hold)
        fired = fire | held
        spent = np.where(decode, 0.0, 0.0 if self.prefill_unsteered else delta)
        spent[decode] = np.where(fired, delta[decode], 0.0)
        spent = energy + np.cumsum(spent)
        fires, holds = n_fired + np.cumsum(fire), holds + np.cumsum(held)
        out = pd.DataFrame({
            "run": np.full(len(own), run, dtype=np.int64), "step": step[decode], "prob": own,
            "probe_fire": fire, "held": held, "fired": fired, "latch_remaining": left.astype(np.int32),
            "n_calls": calls[decode], "n_fired": fires, "n_hysteresis_holds": holds, "energy": spent[decode]}, copy=False)
        if len(own):
            self.at[1], self.at[3], self.at[4] = int(left[-1]), int(fires[-1]), int(holds[-1])
        self.at[2], self.at[5] = int(calls[-1]), float(spent[-1])
        return out

    def _take(self, run, batch: list[np.ndarray]) -> pd.DataFrame | None:
        """Decides what is due of some steps; the rest waits."""
        batch = _in_order(batch)
        steps = batch[0]
        coming = np.unique(steps[steps >= self.at[0]])
        self.at[0] += int((coming == self.at[0] + np.arange(len(coming))).cumprod().sum())
        due = steps < self.at[0]
        if due.all():
            return self._decide(run, batch) if len(due) else None
        rest = [c[~due] for c in batch]
        self.ahead.appendList(list(zip(*(c.tolist() for c in rest))))
        least = int(rest[0][0])
        self.at[6] = least if self.at[6] is None else min(least, self.at[6])
        return self._decide(run, [c[due] for c in batch]) if due.any() else None

    def _waiting(self) -> list[np.ndarray]:
        rows = _arrays(pd.DataFrame(list(self.ahead.get()), columns=AHEAD))
        self.ahead.clear()
        self.at[6] = None
        return rows

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        for chunk in rows:
            out = self._take(key[0], _arrays(chunk))
            while True:
                if out is not None and len(out):
                    yield out
                if self.at[6] is None or self.at[6] > self.at[0]:
                    break
                out = self._take(key[0], self._waiting())
        if self.at[6] is not None and self.patience_ms is None:
            yield self._give_up(key[0])
        elif self.at[6] is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
        self.gate.update(tuple(self.at))

    def _give_up(self, run) -> pd.DataFrame:
        """Decides the steps that wait, whatever is missing before them."""
        waiting = _in_order(self._waiting())
        self.at[0] = int(waiting[0][-1]) + 1
        return self._decide(run, waiting)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        if self.at[6] is not None:
            yield self._give_up(key[0])
            self.gate.update(tuple(self.at))


def gate_stream(steps: DataFrame, threshold: float = 0.5, n_hold: int = 2, patience_ms: int | None = None) -> DataFrame:
    """Streaming DataFrame of per-step gate decisions keyed by run.  The
    session's state store must be RocksDB (see ``run_available_now``).  With
    ``patience_ms`` steps wait across micro-batches; timers need a trigger that
    goes on, as with them Spark never calls a stream finished."""
    return steps.groupBy("run").transformWithStateInPandas(
        GateProcessor(threshold, n_hold, patience_ms=patience_ms), OUT_SCHEMA, "Append",
        "None" if patience_ms is None else "ProcessingTime")


def write_step_files(steps: DataFrame, path: str, slice_steps: int = SLICE_STEPS) -> None:
    """Write the steps as folders of ``slice_steps`` steps of each run, in step
    order: the arriving stream.  Inside a slice a run's steps are in order in
    one file, and a slice is written before the next.  The steps are computed
    once."""
    spark = steps.sparkSession
    whole = f"{path.rstrip('/')}-whole"
    cols = ["run", "step", "prob", "phase", "delta_norm"]
    steps.select(*cols).write.parquet(whole)
    kept = spark.read.schema(STEP_SCHEMA).parquet(whole)
    last = int(kept.agg(F.max("step")).first()[0] or 0)
    for i in range(max(1, -(-last // slice_steps))):
        part = kept.where((F.col("step") > i * slice_steps) & (F.col("step") <= (i + 1) * slice_steps))
        part.repartition("run").sortWithinPartitions("run", "step").write.parquet(f"{path}/part_{i:06d}")


def run_available_now(spark: SparkSession, src: str, sink: str, checkpoint: str,
                      threshold: float = 0.5, n_hold: int = 2, files_per_batch: int = 64) -> DataFrame:
    """Process every file in ``src``, oldest first, with an availableNow
    trigger into a Parquet sink (exactly-once through the checkpoint), then
    read it back."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        steps = (spark.readStream.schema(STEP_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
                 .option("recursiveFileLookup", "true").parquet(src))
        q = (gate_stream(steps, threshold, n_hold).writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink))
        q.awaitTermination()
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
    return spark.read.schema(OUT_SCHEMA).parquet(sink)
