"""The functions that formulas can call.

Four kinds, by what a value depends on:

* ``scalar``: other columns of the same row;
* ``time``: rows of the same asset, by window expressions;
* ``cross``: rows of the same time, by window expressions;
* ``scan``: a recurrence along an asset's rows, run once over rows that are sorted by asset and
  time, in constant memory.

Rolling windows count rows of the panel.  A missing value in a window counts as 0 unless a
function says otherwise.  The first w - 1 outputs repeat the first full one (``warmup``
"backfill", the default) or are missing ("null"); an asset of fewer than w rows has none.
``shift`` counts a column's own rows that are not missing.  Missing is NULL, never NaN.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Axis:
    """The keys of a panel, and options that hold for a whole evaluation."""

    asset: str = "asset"
    time: str = "time"
    warmup: str = "backfill"
    within: tuple[str, ...] = ()  # further keys, each of whose values is a panel of its own

    @property
    def assets(self) -> tuple[str, ...]:
        """The keys of one asset's rows."""
        return (*self.within, self.asset)

    @property
    def times(self) -> tuple[str, ...]:
        """The keys of one cross-section."""
        return (*self.within, self.time)

    def rows(self, *more: Column):
        return Window.partitionBy(*self.assets, *more).orderBy(self.time)

    def trailing(self, w: int):
        return self.rows().rowsBetween(1 - w, 0)

    def slice(self, *more: Column):
        return Window.partitionBy(*self.times, *more)


@dataclass(frozen=True)
class Function:
    name: str
    kind: str
    build: Callable
    data: int = 1  # leading arguments that are columns (-1: all)
    category: str = "general"
    defaults: tuple = field(default=())

    @property
    def doc(self) -> str:
        return (self.build.__doc__ or "").strip()


REGISTRY: dict[str, Function] = {}


def register(name: str, kind: str = "scalar", data: int = -1, category: str = "custom", defaults: tuple = (), replace: bool = False):
    """Makes a function callable from formulas: scalar(*columns), time or cross(axis, *columns,
    *parameters), scan(*parameters) giving a kernel (see ``Kernel``)."""
    if kind not in ("scalar", "time", "cross", "scan"):
        raise ValueError(f"unknown kind {kind!r}")

    def put(build):
        if name in REGISTRY and not replace:
            raise KeyError(f"{name!r} is registered already")
        REGISTRY[name] = Function(name, kind, build, data, category, defaults)
        return build

    return put


def unregister(name: str) -> None:
    del REGISTRY[name]


def reset() -> None:
    """Back to the built-in functions."""
    REGISTRY.clear()
    REGISTRY.update(_BUILT_IN)


def by_category() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for f in REGISTRY.values():
        out.setdefault(f.category, []).append(f.name)
    return out


def finite(c: Column) -> Column:
    """NaN and infinities become missing."""
    return F.when(F.abs(c) < float("inf"), c)


# ---- scalar ------------------------------------------------------------------------------------


@register("coalesce", category="scalar")
def _coalesce(*args):
    return F.coalesce(*args)


@register("sqrt", category="scalar")
def _sqrt(x):
    return F.when(x >= 0, F.sqrt(x))


@register("abs", category="scalar")
def _abs(x):
    return F.abs(x)


@register("log", category="scalar")
def _log(x):
    return F.ln(x)


@register("exp", category="scalar")
def _exp(x):
    return finite(F.exp(x))


def _compare(name: str, op):
    @register(name, category="comparison")
    def compare(a, b):
        """A missing side makes it false."""
        return F.coalesce(op(a, b), F.lit(False))


for _name, _op in {"gt": Column.__gt__, "lt": Column.__lt__, "ge": Column.__ge__, "le": Column.__le__, "eq": Column.__eq__}.items():
    _compare(_name, _op)


@register("nan_const", category="scalar", data=0)
def _nan_const():
    return F.lit(None).cast("double")


@register("where", category="scalar")
def _where(condition, yes, no):
    """A missing condition is false."""
    return F.when(F.coalesce(condition.cast("boolean"), F.lit(False)), yes).otherwise(no)


@register("assign_bucket", category="cross-section")
def _assign_bucket(x, *points):
    """How many break points lie below x; a missing one lies nowhere."""
    if not 1 <= len(points) <= 3:
        raise ValueError("assign_bucket takes one to three break points")
    return F.when(x.isNotNull(), sum((F.coalesce((x > p).cast("int"), F.lit(0)) for p in points), F.lit(0)).cast("double"))


# ---- along an asset's rows ---------------------------------------------------------------------


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def _rolled(axis: Axis, value: Column, w: int) -> Column:
    """Missing before the w-th row; ``backfilled`` closes the gap one layer later."""
    if w <= 1:
        return value
    return F.when(F.row_number().over(axis.rows()) >= w, value)


@register("sma", "time", 1, "rolling", (20,))
def _sma(axis, x, w):
    return _rolled(axis, F.avg(_zero(x)).over(axis.trailing(w)), w)


@register("rolling_sum", "time", 1, "rolling", (20,))
def _rolling_sum(axis, x, w):
    return _rolled(axis, F.sum(_zero(x)).over(axis.trailing(w)), w)


@register("row_position", "time", 1, "rolling")
def _row_position(axis, x):
    """The number of the asset's rows before."""
    return (F.row_number().over(axis.rows()) - 1).cast("double")


def _block(axis: Axis, position: Column, w: int):
    return Window.partitionBy(*axis.assets, F.floor(position / w))


@register("block_head", "time", 2, "rolling", (20,))
def _block_head(axis, x, position, w):
    """The sum from the start of the row's block of w rows to the row."""
    return F.sum(_zero(x)).over(_block(axis, position, w).orderBy(axis.time).rowsBetween(Window.unboundedPreceding, 0))


@register("block_tail", "time", 2, "rolling", (20,))
def _block_tail(axis, x, position, w):
    """The sum from the row to the end of its block."""
    return F.sum(_zero(x)).over(_block(axis, position, w).orderBy(F.desc(axis.time)).rowsBetween(Window.unboundedPreceding, 0))


@register("sum_of_blocks", "time", 3, "rolling", (20,))
def _sum_of_blocks(axis, head, tail, position, w):
    """The rolling sum: the end of the block before and the start of the row's own block."""
    whole = position % w == w - 1
    return _rolled(axis, F.when(whole, head).otherwise(head + F.lag(tail, w - 1).over(axis.rows())), w)


@register("rolling_std", "time", 1, "rolling", (20,))
def _rolling_std(axis, x, w):
    return _rolled(axis, F.stddev_pop(_zero(x)).over(axis.trailing(w)), w)


@register("moving_median", "time", 1, "rolling", (20,))
def _moving_median(axis, x, w):
    return _rolled(axis, F.percentile(_zero(x), F.lit(0.5)).over(axis.trailing(w)), w)


@register("moving_mode", "time", 1, "rolling", (20,))
def _moving_mode(axis, x, w):
    """The most frequent value, of equally frequent ones the smallest."""
    return _rolled(axis, F.mode(_zero(x), True).over(axis.trailing(w)), w)


@register("wma", "time", 1, "rolling", (20, None))
def _wma(axis, x, w, weights=None):
    """Weighted mean; the first weight is the oldest row's (1, 2, ... w if there are none)."""
    weights = [float(v) for v in weights] if weights is not None else [float(i) for i in range(1, w + 1)]
    if len(weights) != w:
        raise ValueError(f"{len(weights)} weights for a window of {w}")
    if w <= 16:
        rows = axis.rows()
        terms = [F.lit(v) * _zero(F.lag(x, w - 1 - i).over(rows) if i < w - 1 else x) for i, v in enumerate(weights)]
        total = sum(terms[1:], terms[0])
    else:
        frame = F.collect_list(_zero(x)).over(axis.trailing(w))
        total = F.aggregate(F.zip_with(frame, F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    return _rolled(axis, total / sum(weights), w)


@register("gain", "time", 1, "momentum", (1,))
def _gain(axis, x, w=1):
    step = _zero(x) - F.lag(_zero(x)).over(axis.rows())
    return _rolled(axis, F.greatest(F.coalesce(step, F.lit(0.0)), F.lit(0.0)), w)


@register("loss", "time", 1, "momentum", (1,))
def _loss(axis, x, w=1):
    step = F.lag(_zero(x)).over(axis.rows()) - _zero(x)
    return _rolled(axis, F.greatest(F.coalesce(step, F.lit(0.0)), F.lit(0.0)), w)


@register("shift", "time", 1, "time", (1,))
def _shift(axis, x, n=1):
    """n of x's own rows that are not missing back (forward, if n is negative)."""
    if n == 0:
        return x
    rows = axis.rows(x.isNull())
    return F.when(x.isNotNull(), F.lag(x, n).over(rows) if n > 0 else F.lead(x, -n).over(rows))


@register("returns", "time", 1, "time", (1,))
def _returns(axis, x, n=1):
    return F.try_divide(x, _shift(axis, x, n)) - 1


@register("ffill", "time", 1, "time")
def _ffill(axis, x):
    return F.last(x, ignorenulls=True).over(axis.rows().rowsBetween(Window.unboundedPreceding, 0))


@register("month_coord", "time", 1, "time")
def _month_coord(axis, x):
    return F.month(F.col(axis.time)).cast("double")


#: Functions whose first w - 1 outputs repeat the first full one.
WARM = ("sma", "rolling_sum", "sum_of_blocks", "rolling_std", "moving_median", "moving_mode", "wma", "gain", "loss", "ema", "rma")


def backfilled(axis: Axis, value: Column, w: int) -> Column:
    """value, or of the next w - 1 rows the first that has one: only the gap at the start is any
    shorter than w."""
    return F.coalesce(value, F.first(value, ignorenulls=True).over(axis.rows().rowsBetween(0, w - 1)))


# ---- across the assets of a time ---------------------------------------------------------------


@register("cs_rank", "cross", 1, "cross-section")
def _cs_rank(axis, x):
    """Place among the values of the time, from 0 to 1; ties by asset; missing for a lone value."""
    order = axis.slice(x.isNull()).orderBy(x, axis.asset)
    n = F.count(x).over(axis.slice())
    return F.when(x.isNotNull() & (n > 1), (F.row_number().over(order) - 1) / (n - 1))


@register("cs_quantile", "cross", 1, "cross-section")
def _cs_quantile(axis, x, q):
    if not 0 <= q <= 1:
        raise ValueError(f"quantile {q}")
    return F.percentile(x, F.lit(float(q))).over(axis.slice())


@register("cs_demean", "cross", 1, "cross-section")
def _cs_demean(axis, x):
    return x - F.avg(x).over(axis.slice())


@register("cs_zscore", "cross", 1, "cross-section")
def _cs_zscore(axis, x):
    """Across the assets of a time (the processor of the like name works along an asset)."""
    return F.try_divide(x - F.avg(x).over(axis.slice()), F.stddev_pop(x).over(axis.slice()))


AGGREGATES = {
    "sum": lambda x: F.coalesce(F.sum(x), F.lit(0.0)), "mean": F.avg, "std": F.stddev_pop, "var": F.var_pop, "min": F.min, "max": F.max,
}


def _aggregate(name: str, build):
    def over(partition):
        def f(axis, x):
            spec = Window.partitionBy(*getattr(axis, partition))
            if name == "sum":
                return F.coalesce(F.sum(x).over(spec), F.lit(0.0))
            return build(x).over(spec)

        return f

    register(f"ts_{name}", "time", 1, "aggregate")(over("assets"))
    register(f"cs_{name}", "cross", 1, "aggregate")(over("times"))


for _name, _build in AGGREGATES.items():
    _aggregate(_name, _build)


# ---- recurrences -------------------------------------------------------------------------------


class Kernel:
    """A recurrence: start() at an asset's first row, then step(*values) for each row.

    ``window``: rows that the first output needs; step gives None before.  Kernels of one's own
    need no more; the built-in ones work on whole columns (``LinearKernel``).
    """

    window = 1

    def start(self) -> None: ...

    def step(self, *values: float | None) -> float | None:
        raise NotImplementedError


def affine_scan(a: np.ndarray, b: np.ndarray, before: float) -> np.ndarray:
    """y[t] = a[t] * y[t - 1] + b[t] from y[-1] = before, by doubling: in round k every row takes in
    the 2^k rows before it.  A row with a = 0 begins anew."""
    a, b = a.copy(), b.copy()
    if len(a):
        b[0] += a[0] * before
        a[0] = 0.0
    step = 1
    while step < len(a) and a.any():
        b[step:] += a[step:] * b[:-step]
        a[step:] = a[step:] * a[:-step]
        step *= 2
    return b


class LinearKernel(Kernel):
    """A recurrence that is linear in its last output, for many rows at once.

    fresh: rows that begin an asset; columns: values, NaN where missing.  Gives the outputs (NaN:
    none); what the next rows need stays in the kernel.
    """

    def run(self, fresh: np.ndarray, *columns: np.ndarray) -> np.ndarray:
        raise NotImplementedError


def counted(fresh: np.ndarray, before: int) -> np.ndarray:
    """The number of each row in its asset, from 1; ``before`` rows of the first one came earlier."""
    row = np.arange(len(fresh))
    start = np.maximum.accumulate(np.where(fresh, row, -before))
    return row - start + 1


class Smoothed(LinearKernel):
    """alpha * x + (1 - alpha) * before, from ``seed`` times the sum of the first window."""

    def __init__(self, window: int, alpha: float, seed: float):
        self.window, self.alpha, self.seed = window, alpha, seed
        self.n, self.value = 0, 0.0

    def run(self, fresh, x):
        x, w = np.nan_to_num(x), self.window
        n = counted(fresh, self.n)
        a = np.where(n < w, 1.0, np.where(n == w, self.seed, 1 - self.alpha))
        b = x * np.where(n < w, 1.0, np.where(n == w, self.seed, self.alpha))
        a[n == 1] = 0.0
        y = affine_scan(a, b, self.value)
        if len(n):
            self.n, self.value = int(n[-1]), float(y[-1])
        return np.where(n >= w, y, np.nan)


@register("ema", "scan", 1, "rolling", (20,))
def _ema(w):
    """Exponential mean with alpha 2 / (w + 1), from alpha times the sum of the first w."""
    return Smoothed(w, 2 / (w + 1), 2 / (w + 1))


@register("rma", "scan", 1, "rolling", (20,))
def _rma(w):
    """Running mean with alpha 1 / w, from the mean of the first w."""
    return Smoothed(w, 1 / w, 1 / w)


class HoltWinters(LinearKernel):
    """Level, trend and acceleration, each smoothed; gives level + trend + acceleration / 2.

    The state (level, trend, acceleration) is M times the one before plus v times x.
    """

    def __init__(self, alpha: float, beta: float, gamma: float):
        if not all(0 < v < 1 for v in (alpha, beta, gamma)):
            raise ValueError("smoothing parameters lie between 0 and 1")
        level = (1 - alpha) * np.array([1.0, 1.0, 0.5])
        trend = (1 - beta) * np.array([0.0, 1.0, 1.0]) + beta * (level - [1.0, 0.0, 0.0])
        accel = (1 - gamma) * np.array([0.0, 0.0, 1.0]) + gamma * (trend - [0.0, 1.0, 0.0])
        self.m = np.array([level, trend, accel])
        self.v = alpha * np.array([1.0, beta, beta * gamma])
        self.n, self.state = 0, np.zeros(3)

    def run(self, fresh, x):
        x = np.nan_to_num(x)
        n = counted(fresh, self.n)
        s = x[:, None] * self.v
        first = n == 1  # the state before it is (x, 0, 0)
        s[first] += x[first, None] * self.m[:, 0]
        if len(n) and not first[0]:
            s[0] += self.m @ self.state
        step, power, row = 1, self.m, np.arange(len(n))
        reach = np.minimum(n - 1, row)  # rows before in the same asset and batch
        while step < len(n) and (reach >= step).any():
            at = np.flatnonzero(reach >= step)
            s[at] += s[at - step] @ power.T
            step, power = 2 * step, power @ power
        if len(n):
            self.n, self.state = int(n[-1]), s[-1].copy()
        return s[:, 0] + s[:, 1] + 0.5 * s[:, 2]


@register("triple_exponential_smoothing", "scan", 1, "rolling", (0.2, 0.1, 0.1))
def _triple(alpha=0.2, beta=0.1, gamma=0.1):
    return HoltWinters(alpha, beta, gamma)


class Adaptive(LinearKernel):
    """s * x + (1 - s) * before, with s from the second column; a missing side keeps the value,
    the first row with both gives 0."""

    def __init__(self):
        self.seen, self.value = 0, 0.0

    def run(self, fresh, x, s):
        both = ~(np.isnan(x) | np.isnan(s))
        total = np.cumsum(both)
        at_start = np.maximum.accumulate(np.where(fresh, total - both, -self.seen))
        seen = total - at_start  # rows with both sides in the asset so far
        begins = fresh | (both & (seen == 1))
        go_on = both & (seen > 1)
        a = np.where(begins, 0.0, np.where(go_on, 1 - np.nan_to_num(s), 1.0))
        y = affine_scan(a, np.where(go_on, np.nan_to_num(s) * np.nan_to_num(x), 0.0), self.value)
        if len(y):
            self.seen, self.value = int(seen[-1]), float(y[-1])
        return np.where(seen > 0, y, np.nan)


@register("adaptive_ema", "scan", 2, "rolling")
def _adaptive():
    return Adaptive()


_BUILT_IN = dict(REGISTRY)

