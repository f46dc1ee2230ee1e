"""Running cost and event counts from files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfold.operators.experiments import priced

CALLS = "leg string, model string, in_tokens bigint, out_tokens bigint, ts timestamp"


def call_stream(spark: SparkSession, path: str) -> DataFrame:
    """Model calls from JSON lines in a folder."""
    return spark.readStream.schema(CALLS).json(path)


def running_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost by leg so far: one state row a leg (output mode complete or update). An unknown model costs as much as the
    dearest one. prices is a table of models and broadcast."""
    return priced(calls, prices).groupBy("leg").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


def window_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", step: str | None = None) -> DataFrame:
    """Events and their value by time window and type; a window is closed once the watermark has passed it. With a step shorter
    than the width windows overlap, and an event counts in each that holds it."""
    window = F.window("ts", width, step or width)
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """A user's events without a pause of `gap` or longer: start, end (of the last event), number and value.

    In a stream a session is held as state, grows and joins with its neighbour as events come, late ones too, and is given
    out once the watermark has passed its end and the gap; an event later than that is left out.
    """
    window = F.session_window("ts", gap)
    made = events.withWatermark("ts", late).groupBy(window.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"), F.max("ts").alias("end"))
    return made.select("user_id", F.col("w.start").alias("start"), "end", "n", "value")
