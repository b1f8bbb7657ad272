"""Processors: fit on one panel, transform another; sorts, portfolios and spreads.

Results at a coarser grain than the panel (portfolio returns, factor spreads) are frames of their
own in ``View.frames``, never joined back on every row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compiler import compute
from ..functions.dsl import Call, Data
from ..functions.manager import FormulaManager, with_formula
from .panel import Panel


@dataclass(frozen=True)
class View:
    panel: Panel
    frames: dict[str, DataFrame] = field(default_factory=dict)

    def on(self, df: DataFrame) -> View:
        return View(self.panel.on(df), self.frames)

    def plus(self, name: str, df: DataFrame) -> View:
        return View(self.panel, {**self.frames, name: df})


class Processor:
    """fit gives a state (or None); transform uses it."""

    name: str = ""

    def fit(self, view: View):
        return None

    def transform(self, view: View, state=None) -> View:
        raise NotImplementedError

    def fit_transform(self, view: View) -> tuple[View, object]:
        state = self.fit(view)
        return self.transform(view, state), state


# ---- normalisation -----------------------------------------------------------------------------


@dataclass
class AssetZScore(Processor):
    """(x - mean) / (deviation + 1e-8) with the asset's own mean and population deviation."""

    vars: list[str] | None = None
    out_suffix: str = "_csz"
    name: str = "cs_zscore"

    def fit(self, view: View) -> DataFrame:
        p = view.panel
        columns = self.vars or p.numeric
        stats = [f for c in columns for f in (F.avg(c).alias(f"__mu_{c}"), F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(f"__sd_{c}"))]
        return p.df.groupBy(*p.axis.assets).agg(*stats)

    def transform(self, view: View, state: DataFrame | None = None) -> View:
        p = view.panel
        state = self.fit(view) if state is None else state
        columns = self.vars or p.numeric
        joined = p.df.join(state, list(p.axis.assets), "left")
        made = {f"{c}{self.out_suffix}": (F.col(c) - F.col(f"__mu_{c}")) / (F.col(f"__sd_{c}") + 1e-8) for c in columns}
        return view.on(joined.withColumns(made).drop(*[c for c in state.columns if c not in p.keys]))


@dataclass
class ForwardFill(Processor):
    vars: list[str] | None = None
    name: str = "per_asset_ffill"

    def transform(self, view: View, state=None) -> View:
        p = view.panel
        columns = self.vars or p.numeric
        return view.on(compute(p.df, p.axis, {c: Call("ffill", (Data(c),)) for c in columns}).select(*p.df.columns))


@dataclass
class FormulaEval(Processor):
    """Named formulas, many at once; ``expressions`` adds formula text by name."""

    formula_configs: dict | list | str = field(default_factory=dict)
    static_context: dict = field(default_factory=lambda: {"price": "close"})
    expressions: dict[str, str] = field(default_factory=dict)
    prefix: str = ""
    assign_in_place: bool = True
    manager: FormulaManager | None = None
    name: str = "formula_eval"

    def transform(self, view: View, state=None) -> View:
        p, m = view.panel, self.manager or FormulaManager()
        alias = {k: v for k, v in self.static_context.items() if isinstance(v, str) and v in p.df.columns}
        trees = m.trees(self.formula_configs, alias) if self.formula_configs else {}
        prefix = "" if self.assign_in_place else self.prefix
        df = compute(p.df, p.axis, {prefix + k: v for k, v in trees.items()})
        for name, text in self.expressions.items():
            df = with_formula(df, text, name, p.axis, dict(self.static_context), m)
        return view.on(df if self.assign_in_place else df.select(*p.keys, *[prefix + k for k in trees], *self.expressions))


# ---- sorts and portfolios ----------------------------------------------------------------------


@dataclass
class CrossSectionalSort(Processor):
    """Buckets 0 .. n-1 of ``signal`` at each time, in column <signal>_port.

    Break points are quantiles of the assets in ``scope`` (a boolean or 0/1 column; missing is
    out), and hold for all assets; a value at a break point goes up.  ``bp_digits`` rounds both
    sides of that comparison, which keeps ties apart from the last bit of an interpolation.
    """

    signal: str
    n_bins: int = 2
    scope: str | None = None
    quantiles: list[float] | None = None
    bp_digits: int | None = None
    name: str = "sort"

    def transform(self, view: View, state=None) -> View:
        p = view.panel
        cuts = self.quantiles or [i / self.n_bins for i in range(1, self.n_bins)]
        if len(cuts) != self.n_bins - 1 or sorted(cuts) != list(cuts) or not all(0 < q < 1 for q in cuts):
            raise ValueError(f"{self.n_bins} bins need {self.n_bins - 1} rising quantiles")
        x = F.col(self.signal).cast("double")
        inside = F.when(F.coalesce(F.col(self.scope).cast("boolean"), F.lit(False)), x) if self.scope else x
        points = F.percentile(inside, F.array(*[F.lit(float(q)) for q in cuts])).over(p.axis.slice())
        near = (lambda c: F.round(c, self.bp_digits)) if self.bp_digits is not None else (lambda c: c)
        bucket = sum(((near(x) >= near(F.col("__bp")[i])).cast("int") for i in range(len(cuts))), F.lit(0)).cast("double")
        made = p.df.withColumn("__bp", points).withColumn(f"{self.signal}_port", F.when(x.isNotNull() & F.col("__bp").isNotNull(), bucket))
        return view.on(made.drop("__bp"))


@dataclass
class PortfolioReturns(Processor):
    """Mean return of each bucket at each time, weighted if ``weights_var`` is given.

    The frame port_ret_<groups> has the time, one column <group>_dim for each group, and value;
    with ``dense`` every combination of buckets from 0 to the largest is there.
    """

    groupby: list[str] | str
    returns_var: str = "ret"
    weights_var: str | None = None
    dense: bool = False
    name: str = "port_ret"

    @property
    def groups(self) -> list[str]:
        return [self.groupby] if isinstance(self.groupby, str) else list(self.groupby)

    @property
    def frame(self) -> str:
        return "port_ret_" + "_".join(self.groups)

    def transform(self, view: View, state=None) -> View:
        p = view.panel
        r = F.col(self.returns_var)
        w = F.col(self.weights_var) if self.weights_var else F.lit(1.0)
        both = r.isNotNull() & w.isNotNull()
        rows = p.df.where(" and ".join(f"`{g}` is not null" for g in self.groups))
        keys = [F.col(g).alias(f"{g}_dim") for g in self.groups]
        out = rows.groupBy(*p.axis.times, *keys).agg(F.try_divide(F.sum(F.when(both, r * w)), F.sum(F.when(both, w))).alias("value"))
        if self.dense:
            # the grid has times x buckets rows, a table of the result's own grain
            grid = p.df.select(*p.axis.times).distinct()
            tops = p.df.agg(*[F.max(g).alias(g) for g in self.groups]).first()
            for g in self.groups:
                grid = grid.withColumn(f"{g}_dim", F.explode(F.array(*[F.lit(float(i)) for i in range(int(tops[g] if tops[g] is not None else -1) + 1)])))
            out = grid.join(out, [*p.axis.times, *[f"{g}_dim" for g in self.groups]], "left")
        return view.plus(self.frame, out)


@dataclass
class FactorSpread(Processor):
    """Long less short: means over the other buckets of the chosen ones.

    factors: {name: {"long": {dim: bucket}, "short": {dim: bucket}, "average_over": dim}}.
    """

    source: str
    factors: dict[str, dict]
    name: str = "factors"

    def transform(self, view: View, state=None) -> View:
        if self.source not in view.frames:
            raise ValueError(f"no frame {self.source!r}; there are {sorted(view.frames)}")

        def leg(where: dict) -> Column:
            hit = F.lit(True)
            for dim, bucket in where.items():
                hit = hit & (F.col(dim) == float(bucket))
            return F.avg(F.when(hit, F.col("value")))

        made = [(leg(f["long"]) - leg(f["short"])).alias(k) for k, f in self.factors.items()]
        return view.plus(self.name, view.frames[self.source].groupBy(*view.panel.axis.times).agg(*made))


# ---- source transforms -------------------------------------------------------------------------


def set_coordinate(panel: Panel, column: str) -> Panel:
    """permno, permco: one value an asset."""
    return panel.per_asset(column)


def preferred_stock(panel: Panel) -> Panel:
    """ps: redemption, else liquidating, else par value, else 0; a missing txditc counts as 0."""
    have = panel.df.columns
    chain = [F.col(c) for c in ("pstkrv", "pstkl", "pstk") if c in have]
    tax = F.coalesce(F.col("txditc"), F.lit(0.0)) if "txditc" in have else F.lit(0.0)
    return panel.on(panel.df.withColumns({"ps": F.coalesce(*chain, F.lit(0.0)), "txditc": tax}))


def fix_market_equity(panel: Panel) -> Panel:
    """me = |prc| * shrout; at each time, the largest share class of a company gets its total."""
    if "permco" not in panel.df.columns:
        raise ValueError("fix_market_equity needs permco")
    firm = panel.axis.slice(F.col("permco"))
    me = F.abs(F.col("prc")) * F.col("shrout")
    df = panel.df.withColumn("__me", me)
    lead = F.col("permco").isNotNull() & (F.col("__me") == F.max("__me").over(firm))
    return panel.on(df.withColumn("me", F.when(lead, F.sum("__me").over(firm)).otherwise(F.col("__me"))).drop("__me"))


TRANSFORMS: dict[str, Callable[..., Panel]] = {
    "set_permno": lambda p: set_coordinate(p, "permno"), "set_permco": lambda p: set_coordinate(p, "permco"),
    "set_coordinates": lambda p, coord_type="permco": set_coordinate(p, coord_type), "ps": preferred_stock, "preferred_stock": preferred_stock,
    "fix_mke": fix_market_equity, "fix_market_equity": fix_market_equity,
}


def apply_transforms(panel: Panel, config: list | dict | None) -> Panel:
    """A list of names or {"type": name, ...}, or {"transforms": list}."""
    for step in (config.get("transforms", []) if isinstance(config, dict) else config or []):
        step = {"type": step} if isinstance(step, str) else dict(step)
        kind = step.pop("type")
        if kind not in TRANSFORMS:
            raise ValueError(f"unknown transform {kind!r}")
        panel = TRANSFORMS[kind](panel, **step)
    return panel


# ---- registry and handler ----------------------------------------------------------------------

PROCESSORS: dict[str, type[Processor]] = {
    "cs_zscore": AssetZScore, "per_asset_ffill": ForwardFill, "formula_eval": FormulaEval,
    "cross_sectional_sort": CrossSectionalSort, "sort": CrossSectionalSort,
    "portfolio_returns": PortfolioReturns, "port_ret": PortfolioReturns, "factor_spread": FactorSpread,
}


def register_processor(name: str, kind: type[Processor]) -> None:
    if not issubclass(kind, Processor):
        raise TypeError(f"{kind} is no Processor")
    PROCESSORS[name] = kind


def create_processor(spec: dict, position: int = 0) -> Processor:
    spec = dict(spec)
    kind = spec.pop("type", None)
    if kind not in PROCESSORS:
        raise ValueError(f"unknown processor {kind!r}; there are {', '.join(sorted(PROCESSORS))}")
    spec.setdefault("name", f"{kind}_{position}")
    try:
        return PROCESSORS[kind](**spec)
    except TypeError as e:
        raise ValueError(f"{kind}: {e}") from e


class PipelineMode(Enum):
    INDEPENDENT = "independent"
    APPEND = "append"


class Side(Enum):
    RAW = "raw"
    LEARN = "learn"
    INFER = "infer"


@dataclass
class HandlerConfig:
    shared: list[Processor] = field(default_factory=list)
    learn: list[Processor] = field(default_factory=list)
    infer: list[Processor] = field(default_factory=list)
    mode: PipelineMode = PipelineMode.INDEPENDENT
    feature_cols: list[str] | None = None
    label_cols: list[str] | None = None


class DataHandler:
    """Shared processors first; then learn and infer processors, each from the shared view, or
    (APPEND) infer after learn.  Views are lazy."""

    def __init__(self, base: Panel, config: HandlerConfig | None = None):
        self.base, self.config = base, config or HandlerConfig()
        self.states: list = []
        self._views: dict[Side, View] = {}

    @staticmethod
    def run(view: View, steps: list[Processor]) -> tuple[View, list]:
        states = []
        for s in steps:
            view, state = s.fit_transform(view)
            states.append(state)
        return view, states

    def shared_view(self) -> View:
        return self.run(View(self.base), self.config.shared)[0]

    def build(self) -> DataHandler:
        shared = self.shared_view()
        learn, self.states = self.fit_learn(shared)
        infer = self.apply_infer(learn if self.config.mode == PipelineMode.APPEND else shared)
        self._views = {Side.RAW: View(self.base), Side.LEARN: learn, Side.INFER: infer}
        return self

    def view(self, side: Side | str = Side.INFER) -> View:
        if not self._views:
            self.build()
        return self._views[Side(side)]

    def fetch(self, side: Side | str, columns: str | list[str] | None = None) -> DataFrame:
        """A view's rows; ``features`` or ``labels`` picks the configured columns."""
        p = self.view(side).panel
        groups = {"feature": self.config.feature_cols, "features": self.config.feature_cols, "label": self.config.label_cols, "labels": self.config.label_cols}
        chosen = groups.get(columns) if isinstance(columns, str) else columns
        have = [c for c in chosen or [] if c in p.df.columns]
        return p.df.select(*p.keys, *have) if have else p.df

    def slice_time(self, panel: Panel, start, end) -> Panel:
        return panel.slice_time(start, end)

    def to_arrays(self, panel: Panel, features: list[str], label: str | None = None, drop_missing: bool = True, max_rows: int = 1_000_000):
        """Driver-side arrays of a small panel: keys, features and label.  A panel of more than
        ``max_rows`` rows is an error: learn from it where it lies (``ModelRunner``)."""
        wanted = [*features, *([label] if label else [])]
        df = panel.df.select(panel.asset, panel.time, *wanted)
        df = df.dropna(how="all", subset=features) if drop_missing else df
        if df.limit(max_rows + 1).count() > max_rows:
            raise ValueError(f"more than {max_rows} rows for arrays on the driver")
        got = df.orderBy(panel.time, panel.asset).toPandas()
        return got[[panel.asset, panel.time]], got[features].to_numpy(float), got[label].to_numpy(float) if label else None

    def fit_learn(self, view: View) -> tuple[View, list]:
        return self.run(view, self.config.learn)

    def transform_with_learn(self, view: View, states: list | None = None) -> View:
        for s, state in zip(self.config.learn, self.states if states is None else states):
            view = s.transform(view, state)
        return view

    def apply_infer(self, view: View) -> View:
        return self.run(view, self.config.infer)[0]
