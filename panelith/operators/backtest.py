"""Backtests: a strategy looks at trailing bars and gives orders that fill at the next open.

A run steps through the bars of all its assets in order, so one run is one group; runs (strategies,
commission rates) are independent and go through in parallel.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .panel import Panel


class Direction(Enum):
    BUY = 1
    SELL = -1


class Status(Enum):
    PENDING = "pending"
    FILLED = "filled"
    REJECTED = "rejected"


@dataclass
class MarketOrder:
    asset: object
    direction: Direction
    quantity: float
    price: float = -1.0  # until it is filled
    status: Status = Status.PENDING

    def __post_init__(self):
        if not self.quantity > 0:
            raise ValueError("an order has a positive quantity")


@dataclass
class State:
    cash: float
    positions: dict = field(default_factory=dict)
    value: float = 0.0
    bar: int = 0


class Strategy(ABC):
    """next sees the last ``window`` bars: {column: array (bars, assets)} and the assets' order."""

    window: int = 1

    @abstractmethod
    def next(self, market: dict[str, np.ndarray], assets: list, state: State) -> list[MarketOrder]: ...


class NoTrades(Strategy):
    def next(self, market, assets, state):
        return []


class BuyAndHold(Strategy):
    """All cash, split evenly, at the first chance."""

    def next(self, market, assets, state):
        if state.positions:
            return []
        close = market["close"][-1]
        return [MarketOrder(a, Direction.BUY, state.cash / len(assets) / p) for a, p in zip(assets, close) if p > 0]


class Momentum(Strategy):
    """Holds the asset with the best return over the window."""

    def __init__(self, window: int = 10):
        self.window = window

    def next(self, market, assets, state):
        close = market["close"]
        if len(close) < self.window:
            return []
        change = np.where(close[0] > 0, close[-1] / np.where(close[0] > 0, close[0], 1) - 1, -np.inf)
        best = assets[int(np.argmax(change))]
        held = {a: q for a, q in state.positions.items() if q > 1e-9}
        if set(held) == {best}:
            return []
        orders = [MarketOrder(a, Direction.SELL, q) for a, q in held.items() if a != best]
        price = close[-1][assets.index(best)]
        return orders + ([MarketOrder(best, Direction.BUY, state.value / price)] if price > 0 and state.value > 0 else [])


def fill(orders: list[MarketOrder], state: State, opens: dict, commission: float) -> list[MarketOrder]:
    """Fills at open prices; returns the orders that have to wait (no valid price).

    A buy is cut to what the cash allows, after commission; sells always fill.  Commission is a
    share of the money moved.
    """
    waiting = []
    for o in orders:
        p = opens.get(o.asset)
        if p is None or not math.isfinite(p) or p <= 0:
            waiting.append(o)
            continue
        n = o.quantity
        if o.direction is Direction.BUY:
            n = min(n, state.cash / (p * (1 + commission)))
            if n < 1e-6:
                o.status = Status.REJECTED
                continue
        sign = o.direction.value
        state.cash -= sign * n * p + commission * n * p
        state.positions[o.asset] = state.positions.get(o.asset, 0.0) + sign * n
        o.price, o.quantity, o.status = p, n, Status.FILLED
    return waiting


def simulate(bars: pd.DataFrame, strategy: Strategy, cash: float, commission: float) -> pd.DataFrame:
    """bars: time, asset, open, high, low, close, volume.  Orders given at a bar fill at the next
    bar's open; the value at that bar's close is stored at the bar of the signal (``fill_time``
    tells the other).  The last bar repeats the last value."""
    wide = {c: bars.pivot(index="time", columns="asset", values=c) for c in ("open", "high", "low", "close", "volume")}
    assets, times = list(wide["close"].columns), list(wide["close"].index)
    arrays = {c: w.to_numpy(float) for c, w in wide.items()}
    arrays["close"] = np.nan_to_num(wide["close"].ffill().to_numpy(float))
    state, queue, rows = State(cash, {}, cash), [], []
    for t in range(len(times) - 1):
        state.bar = t
        seen = {c: a[max(0, t + 1 - strategy.window) : t + 1] for c, a in arrays.items()}
        queue += strategy.next(seen, assets, state)
        queue = fill(queue, state, dict(zip(assets, arrays["open"][t + 1])), commission)
        close = dict(zip(assets, arrays["close"][t + 1]))
        state.value = state.cash + sum(q * close[a] for a, q in state.positions.items())
        rows.append((times[t], times[t + 1], state.cash, state.value, len(queue)))
    if times:
        rows.append((times[-1], pd.NaT, state.cash, state.value, len(queue)))
    return pd.DataFrame(rows, columns=["time", "fill_time", "cash", "value", "waiting"])


def check_bars(panel: Panel) -> None:
    """Raises unless every asset has the same number of bars and all five columns."""
    missing = {"open", "high", "low", "close", "volume"} - set(panel.df.columns)
    if missing:
        raise ValueError(f"no column {sorted(missing)}")
    low, high = panel.df.groupBy(panel.asset).count().agg(F.min("count"), F.max("count")).first()
    if low != high:
        raise ValueError("assets have unequal numbers of bars")


#: Most bars (rows) of a run: its task holds them all, some 100 bytes each, five tables wide.
MAX_BARS = 10_000_000


def run(panel: Panel, strategies: dict[str, Strategy], cash: float = 100_000.0, commissions: list[float] | float = 0.0, check: bool = False, max_bars: int = MAX_BARS) -> DataFrame:
    """One group a strategy and commission rate: run, commission, time, fill_time, cash, value, waiting.

    A run steps through its bars in order, in one task; a panel of more than ``max_bars`` rows is an
    error."""
    if panel.df.limit(max_bars + 1).count() > max_bars:
        raise ValueError(f"a backtest of more than {max_bars} bars")
    if check:
        check_bars(panel)
    rates = commissions if isinstance(commissions, list) else [commissions]
    pairs = [(name, float(rate)) for name in strategies for rate in rates]
    # the grid of runs is a short list; every run needs all bars
    grid = F.explode(F.array(*[F.struct(F.lit(n).alias("run"), F.lit(r).alias("commission")) for n, r in pairs]))
    bars = panel.df.select(F.col(panel.asset).alias("asset"), F.col(panel.time).alias("time"), *[F.col(c).cast("double") for c in ("open", "high", "low", "close", "volume")], grid.alias("__g")).select("*", "__g.*").drop("__g")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        name, rate = pdf["run"].iloc[0], float(pdf["commission"].iloc[0])
        out = simulate(pdf, strategies[name], cash, rate)
        out.insert(0, "run", name)
        out.insert(1, "commission", rate)
        return out

    return bars.groupBy("run", "commission").applyInPandas(one, "run string, commission double, time timestamp_ntz, fill_time timestamp_ntz, cash double, value double, waiting int")


def log_returns(path: DataFrame, by: list[str]) -> DataFrame:
    """Adds log_return and cumulative_log_return of a value path; what is not finite counts as 0."""
    w = Window.partitionBy(*by).orderBy("time")
    step = F.log1p(F.try_divide(F.col("value"), F.lag("value").over(w)) - 1)
    df = path.withColumn("log_return", F.coalesce(F.when(F.abs(step) < float("inf"), step), F.lit(0.0)))
    return df.withColumn("cumulative_log_return", F.sum("log_return").over(w.rowsBetween(Window.unboundedPreceding, 0)))


# ---- metrics -----------------------------------------------------------------------------------



def profit_factor(path: DataFrame, by: list[str]) -> DataFrame:
    """Gains over losses: 1 if there is neither, infinite without losses."""
    w = Window.partitionBy(*by).orderBy("time")
    d = path.withColumn("__d", F.col("value") - F.lag("value").over(w))
    g, l = F.sum(F.greatest("__d", F.lit(0.0))), F.sum(F.greatest(-F.col("__d"), F.lit(0.0)))
    gain, loss = F.coalesce(g, F.lit(0.0)), F.coalesce(l, F.lit(0.0))
    return d.groupBy(*by).agg(F.when(loss > 0, F.try_divide(gain, loss)).when(gain > 0, F.lit(float("inf"))).otherwise(F.lit(1.0)).alias("profit_factor"))


def daily(path: DataFrame, by: list[str]) -> DataFrame:
    """The last value of each day and its change."""
    days = path.groupBy(*by, F.to_date("time").alias("day")).agg(F.max_by("value", "time").alias("value"))
    w = Window.partitionBy(*by).orderBy("day")
    return days.withColumn("change", F.try_divide(F.col("value"), F.lag("value").over(w)) - 1)


def period_rate(yearly: float, periods: int) -> float:
    return (1 + yearly) ** (1 / periods) - 1


def sharpe(path: DataFrame, by: list[str], risk_free: float = 0.01, periods: int = 252) -> DataFrame:
    """Yearly excess return over its deviation, from daily changes; 0 where there are too few."""
    d = daily(path, by).withColumn("__x", F.col("change") - period_rate(risk_free, periods))
    ratio = F.try_divide(F.avg("__x"), F.stddev_samp("__x")) * math.sqrt(periods)
    return d.groupBy(*by).agg(F.when(F.count("__x") >= 2, F.coalesce(ratio, F.lit(0.0))).otherwise(F.lit(0.0)).alias("sharpe"))


def _drawdown(path: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    return path.withColumn("__dd", F.try_divide(F.col("value"), F.max("value").over(w)) - 1)


def max_drawdown(path: DataFrame, by: list[str]) -> DataFrame:
    return _drawdown(path, by).groupBy(*by).agg(F.min("__dd").alias("max_drawdown"))


def ulcer_index(path: DataFrame, by: list[str]) -> DataFrame:
    """Root mean square of drawdowns in percent."""
    return _drawdown(path, by).groupBy(*by).agg(F.sqrt(F.avg(F.pow(F.col("__dd") * 100, F.lit(2.0)))).alias("ulcer_index"))


def martin_ratio(path: DataFrame, by: list[str], risk_free: float = 0.01, periods: int = 252) -> DataFrame:
    """Mean excess return a bar over the ulcer index; infinite or 0 without drawdown."""
    w = Window.partitionBy(*by).orderBy("time")
    change = path.withColumn("__x", F.try_divide(F.col("value"), F.lag("value").over(w)) - 1 - period_rate(risk_free, periods))
    mean = change.groupBy(*by).agg(F.avg("__x").alias("__m"))
    both = mean.join(ulcer_index(path, by), by)
    none = F.when(F.col("__m") > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    return both.select(*by, F.when(F.col("ulcer_index") > 0, F.col("__m") / F.col("ulcer_index")).otherwise(none).alias("martin_ratio"))


METRICS: dict[str, Callable[..., DataFrame]] = {"profit_factor": profit_factor, "sharpe": sharpe, "max_drawdown": max_drawdown, "ulcer_index": ulcer_index, "martin_ratio": martin_ratio}


def evaluate(path: DataFrame, by: list[str], names: list[str] | None = None) -> DataFrame:
    """All metrics of each run, side by side."""
    out = path.select(*by).distinct()
    for n in names or METRICS:
        out = out.join(METRICS[n](path, by), by, "left")
    return out
