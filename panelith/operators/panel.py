"""Panels: long tables with one row an asset and time, numbers as doubles, missing as NULL."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.compiler import compute
from ..functions.dsl import Call, Data, Num
from ..functions.kernels import Axis


class Frequency(Enum):
    HOURLY = "hour"
    DAILY = "day"
    MONTHLY = "month"
    YEARLY = "year"
    ANNUAL = "year"

    @classmethod
    def of(cls, x: Frequency | str) -> Frequency:
        if isinstance(x, cls):
            return x
        short = {"H": "HOURLY", "D": "DAILY", "M": "MONTHLY", "Y": "YEARLY", "A": "YEARLY", "HOUR": "HOURLY", "DAY": "DAILY", "MONTH": "MONTHLY", "YEAR": "YEARLY"}
        name = str(x).upper()
        name = short.get(name, name)
        if name not in cls.__members__:
            raise ValueError(f"unsupported frequency {x!r}")
        return cls[name]


def truncated(time: Column, frequency: Frequency | str) -> Column:
    return F.date_trunc(Frequency.of(frequency).value, time).cast("timestamp_ntz")


def is_number(t: T.DataType) -> bool:
    return isinstance(t, (T.NumericType, T.BooleanType))


def without_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


@dataclass(frozen=True)
class Panel:
    """``within``: further keys, each of whose values is a panel of its own (such as a segment)."""

    df: DataFrame
    asset: str = "asset"
    time: str = "time"
    within: tuple[str, ...] = ()

    @property
    def axis(self) -> Axis:
        return Axis(self.asset, self.time, within=self.within)

    @property
    def keys(self) -> list[str]:
        return [*self.within, self.asset, self.time]

    @property
    def features(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.keys]

    @property
    def numeric(self) -> list[str]:
        return [f.name for f in self.df.schema.fields if f.name in self.features and is_number(f.dataType)]

    def on(self, df: DataFrame) -> Panel:
        return replace(self, df=df)

    # ---- time

    def sel(self, at, strict: bool = False) -> Panel:
        """One time, a list of times, or slice(start, end), both ends included.  ``strict``: a
        time that is not there is a KeyError."""
        t = F.col(self.time)
        stamp = lambda x: F.lit(x).cast("timestamp_ntz")
        if isinstance(at, slice):
            return self.slice_time(at.start, at.stop)
        wanted = list(at) if isinstance(at, (list, tuple)) else [at]
        out = self.df.where(t.isin([stamp(x) for x in wanted]))
        if strict and (found := out.select(self.time).distinct().count()) < len(set(wanted)):
            raise KeyError(f"{len(set(wanted)) - found} of the times are not in the panel")
        return self.on(out)

    def slice_time(self, start=None, end=None) -> Panel:
        out, t = self.df, F.col(self.time)
        if start is not None:
            out = out.where(t >= F.lit(start).cast("timestamp_ntz"))
        if end is not None:
            out = out.where(t <= F.lit(end).cast("timestamp_ntz"))
        return self.on(out)

    def bounds(self):
        return tuple(self.df.agg(F.min(self.time), F.max(self.time)).first())

    # ---- along assets

    def shift(self, n: int = 1, columns: list[str] | None = None) -> Panel:
        """Each numeric column n of its own rows back; other columns stay."""
        columns = columns or self.numeric
        return self.on(compute(self.df, self.axis, {c: Call("shift", (Data(c), Num(n))) for c in columns}).select(*self.df.columns))

    def rolling(self, window: int, columns: list[str] | None = None) -> Rolling:
        return Rolling(self, window, columns or self.numeric)

    def cross_section(self, function: str, *parameters: float, columns: list[str] | None = None) -> Panel:
        """A cross-sectional function of each numeric column, put in its place."""
        wanted = {c: Call(function, (Data(c), *map(Num, parameters))) for c in columns or self.numeric}
        return self.on(compute(self.df, self.axis, wanted).select(*self.df.columns))

    def mask(self, column: str) -> Column:
        return F.col(column).isNotNull()

    def per_asset(self, *columns: str) -> Panel:
        """Each column becomes one value an asset: its largest."""
        from pyspark.sql import Window

        return self.on(self.df.withColumns({c: F.max(c).over(Window.partitionBy(*self.axis.assets)) for c in columns}))


@dataclass(frozen=True)
class Rolling:
    """Rolling windows over columns of a panel, put in their place."""

    panel: Panel
    window: int
    columns: list[str]

    def _all(self, name: str) -> Panel:
        wanted = {c: Call(name, (Data(c), Num(self.window))) for c in self.columns}
        return self.panel.on(compute(self.panel.df, self.panel.axis, wanted).select(*self.panel.df.columns))

    def mean(self) -> Panel:
        return self._all("sma")

    def sum(self) -> Panel:
        return self._all("rolling_sum")

    def median(self) -> Panel:
        return self._all("moving_median")

    def std(self) -> Panel:
        return self._all("rolling_std")

    def reduce(self, function: str) -> Panel:
        """Any registered function of (column, window): see functions.kernels.register."""
        return self._all(function)


def from_table(df: DataFrame, time: str, asset: str, features: list[str] | None = None, frequency: Frequency | str = "day", order: list[str] | None = None) -> Panel:
    """A panel from a table: times truncated, numbers as doubles, one row an asset and time.

    Of rows that meet in a cell the last holds: the one with the latest time, then by ``order``,
    then by the features themselves, so that the result is defined.  A null time is an error in
    the reading of the table, not dropped in silence: it raises when the panel is computed.
    """
    features = features or [c for c in df.columns if c not in (time, asset, "year", "month", "day", "hour")]
    missing = [c for c in [time, asset, *features] if c not in df.columns]
    if missing:
        raise ValueError(f"no column {missing}")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    stamp = F.col(time).cast("timestamp_ntz")
    stamp = F.when(stamp.isNull(), F.raise_error(F.lit(f"a time in {time!r} is missing or invalid")).cast("timestamp_ntz")).otherwise(stamp)
    clean = df.select(
        F.col(asset).alias("asset"), stamp.alias("__at"),
        *[(without_nan(F.col(c).cast("double")) if is_number(kinds[c]) else F.col(c)).alias(c) for c in features],
        *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order or [])],
    )
    last = F.struct("__at", *[f"__o{i}" for i in range(len(order or []))], *features)
    cells = clean.groupBy("asset", truncated(F.col("__at"), frequency).alias("time")).agg(F.max(last).alias("x"))
    return Panel(cells.select("asset", "time", *[F.col(f"x.{c}").alias(c) for c in features]))


def simulated(spark: SparkSession, assets: int, steps: int, variables: int, frequency: Frequency | str = "day", start: str = "2020-01-01", seed: int = 42) -> Panel:
    """Normal variables for every asset and time."""
    unit = Frequency.of(frequency).value
    step = F.expr({"hour": "make_interval(0,0,0,0,cast(n as int))", "day": "make_interval(0,0,0,cast(n as int))", "month": "make_interval(0,cast(n as int))", "year": "make_interval(cast(n as int))"}[unit])
    rows = spark.range(assets * steps).select((F.col("id") / steps).cast("long").alias("a"), (F.col("id") % steps).alias("n"))
    time = F.lit(start).cast("timestamp_ntz") + step
    return Panel(rows.select(F.concat(F.lit("asset_"), F.col("a") + 1).alias("asset"), time.alias("time"), *[F.randn(seed + i).alias(f"var_{i + 1}") for i in range(variables)]))


def sas_date(days: Column) -> Column:
    """Days since 1960 as a date."""
    return F.date_add(F.lit("1960-01-01").cast("date"), days.cast("int"))
