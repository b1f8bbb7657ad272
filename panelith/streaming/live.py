"""Streams: the same features over rows as they come (an addition to the batch panel).

``ema`` keeps one mean an asset in the state store; ``bars`` aggregates
events into time windows behind a watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bars(events: DataFrame, asset: str, time: str, value: str, width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Open, high, low, close and count of each asset and window; rows later than ``lateness`` go."""
    stamped = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", lateness)
    out = stamped.groupBy(F.window("__t", width).alias("w"), F.col(asset).alias("asset")).agg(
        F.min_by(value, "__t").alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, "__t").alias("close"), F.count(value).alias("volume")
    )
    return out.select("asset", F.col("w.start").cast("timestamp_ntz").alias("time"), "open", "high", "low", "close", "volume")


def exponential_mean(events: DataFrame, asset: str, time: str, value: str, window: int) -> DataFrame:
    """The ``ema`` of each asset, row by row as they come, ordered within a batch; the first
    window - 1 rows are missing, since a stream cannot fill them from what follows."""
    kind = events.schema[asset].dataType.simpleString()
    alpha = 2 / (window + 1)

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean = state.get if state.exists else (0, 0.0)
        for pdf in frames:
            pdf = pdf.sort_values(time)
            out = []
            for x in pdf[value].fillna(0.0):
                n += 1
                mean = mean + x if n <= window else alpha * x + (1 - alpha) * mean
                if n == window:
                    mean *= alpha
                out.append(mean if n >= window else None)
            yield pd.DataFrame({"asset": key[0], "time": pdf[time], "value": pd.array(out, dtype="Float64")})
        state.update((n, mean))

    rows = events.select(asset, time, value)
    return rows.groupBy(asset).applyInPandasWithState(step, f"asset {kind}, time timestamp_ntz, value double", "n long, mean double", "append", GroupStateTimeout.NoTimeout)
