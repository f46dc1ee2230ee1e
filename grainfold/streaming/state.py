"""Costs as keyed state of a stream: each leg's running total, its cap, and legs that have gone quiet."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from grainfold.session import ship_package

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COSTS = "leg string, kind string, call_no bigint, cost_usd double, leg_usd double, over_cap boolean"


class LegTotals(StatefulProcessor):
    """The state of a leg: micro-dollars and calls so far. Costs are summed as whole millionths, so that no order of batches
    changes a total. A timer is set `quiet` milliseconds of event time behind the leg's last call; a leg without a call
    until then gives a row of kind 'quiet', once."""

    def __init__(self, cap: float, quiet: int):
        self.cap, self.quiet = round(cap * 1e6), quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("spent", "millionths bigint, calls bigint, timer bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        millionths, calls, timer = self.state.get() if self.state.exists() else (0, 0, 0)
        part = pd.concat(list(rows)).sort_values("call_no", kind="stable")  # a micro-batch's calls of one leg
        spent = millionths + (part["cost_usd"] * 1e6).round().astype("int64").cumsum()
        last = max(timer, int(part["ts"].max().timestamp() * 1000) + self.quiet)
        if last != timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last)
        self.state.update((int(spent.iloc[-1]), calls + len(part), last))
        yield pd.DataFrame({
            "leg": part["leg"], "kind": "call", "call_no": part["call_no"], "cost_usd": part["cost_usd"],
            "leg_usd": (spent / 1e6).round(6), "over_cap": spent > self.cap,
        })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        millionths, calls, timer = self.state.get() if self.state.exists() else (0, 0, 0)
        if timer == expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((millionths, calls, 0))
            yield pd.DataFrame({"leg": [key[0]], "kind": ["quiet"], "call_no": [calls], "cost_usd": [0.0], "leg_usd": [millionths / 1e6], "over_cap": [millionths > self.cap]})

    def close(self) -> None:
        pass


def keep_state(spark: SparkSession) -> None:
    """Keyed state of more than one value needs the embedded store; state then need not fit in memory."""
    spark.conf.set(STORE, ROCKS)


def leg_totals(calls: DataFrame, cap: float, late: str = "10 minutes", quiet_minutes: int = 60) -> DataFrame:
    """calls: a stream of leg, call_no, cost_usd, ts. COSTS of each call, and of each leg that goes quiet (call_no: its calls)."""
    ship_package(calls.sparkSession)
    keep_state(calls.sparkSession)
    rows = calls.select("leg", "call_no", "cost_usd", "ts").withWatermark("ts", late)
    return rows.groupBy("leg").transformWithStateInPandas(LegTotals(cap, quiet_minutes * 60_000), COSTS, "Append", "EventTime")
