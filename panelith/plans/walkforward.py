"""Walk-forward plans: train and inference windows, and how a panel meets them.

A plan is a short list on the driver; met with a panel it becomes a small table that is joined by
range, so that all segments run at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.panel import Panel
from ..operators.processors import DataHandler, View

TICK = timedelta(microseconds=1)


@dataclass(frozen=True)
class Segment:
    train_start: datetime
    train_end: datetime
    infer_start: datetime
    infer_end: datetime

    def __post_init__(self):
        if self.train_start > self.train_end or self.infer_start > self.infer_end:
            raise ValueError("a window ends before it starts")

    @property
    def train_span(self) -> timedelta:
        return self.train_end - self.train_start

    @property
    def infer_span(self) -> timedelta:
        return self.infer_end - self.infer_start

    @property
    def gap(self) -> timedelta:
        return self.infer_start - self.train_end

    def overlaps(self, other: Segment) -> bool:
        return self.infer_start <= other.infer_end and other.infer_start <= self.infer_end


@dataclass(frozen=True)
class SegmentConfig:
    start: datetime
    end: datetime
    train: timedelta
    infer: timedelta
    step: timedelta
    gap: timedelta = timedelta(0)
    clip: bool = False

    def __post_init__(self):
        if self.start >= self.end:
            raise ValueError("start is not before end")
        if min(self.train, self.infer, self.step) <= timedelta(0) or self.gap < timedelta(0):
            raise ValueError("spans are positive, a gap not negative")


@dataclass
class SegmentPlan:
    segments: list[Segment] = field(default_factory=list)

    def __iter__(self):
        return iter(self.segments)

    def __len__(self) -> int:
        return len(self.segments)

    def __getitem__(self, i: int) -> Segment:
        return self.segments[i]

    def add(self, s: Segment) -> None:
        self.segments.append(s)

    def validate(self) -> list[str]:
        """What is odd: inference before training ends, or windows out of order."""
        out = [f"segment {i}: inference starts before training ends" for i, s in enumerate(self) if s.infer_start < s.train_end]
        return out + [f"segment {i + 1} starts before segment {i}" for i, (a, b) in enumerate(zip(self.segments, self.segments[1:])) if b.train_start < a.train_start]

    def overlapping(self) -> list[tuple[int, int]]:
        """Pairs of neighbours, in order of start, whose inference windows overlap."""
        by = sorted(range(len(self)), key=lambda i: self[i].infer_start)
        return [(a, b) for a, b in zip(by, by[1:]) if self[a].overlaps(self[b])]

    def total_train(self) -> timedelta:
        return sum((s.train_span for s in self), timedelta(0))

    def total_infer(self) -> timedelta:
        return sum((s.infer_span for s in self), timedelta(0))

    def table(self, spark) -> DataFrame:
        rows = [(i, s.train_start, s.train_end, s.infer_start, s.infer_end) for i, s in enumerate(self)]
        return spark.createDataFrame(rows, "segment int, train_start timestamp_ntz, train_end timestamp_ntz, infer_start timestamp_ntz, infer_end timestamp_ntz")


def make_plan(config: SegmentConfig, panel: Panel | None = None) -> SegmentPlan:
    """A segment every step: train from s to s + train, infer from its end + gap for ``infer`` less
    a tick; kept while it starts, and its inference starts, by the end.  ``clip``: windows are cut
    to the panel's times and empty ones dropped."""
    plan, s = SegmentPlan(), config.start
    low, high = panel.bounds() if panel is not None and config.clip else (None, None)
    while s <= config.end:
        a, b = s, s + config.train
        c, d = b + config.gap, b + config.gap + config.infer - TICK
        if c <= config.end:
            if low is not None:
                a, b, c, d = max(a, low), min(b, high), max(c, low), min(d, high)
            if low is None or high is not None and a <= b and c <= d:
                plan.add(Segment(a, b, c, d))
        s += config.step
    return plan


def expand_plan(plan: SegmentPlan, config: SegmentConfig, start: datetime | None = None, end: datetime | None = None) -> SegmentPlan:
    """More segments of the same shape before and after a plan."""
    out = list(plan)
    if not out:
        return SegmentPlan(out)
    shifted = lambda s, by: Segment(s.train_start + by, s.train_end + by, s.infer_start + by, s.infer_end + by)
    while start is not None and out[0].train_start - config.step >= start:
        out.insert(0, shifted(out[0], -config.step))
    while end is not None and shifted(out[-1], config.step).infer_start <= end:
        out.append(shifted(out[-1], config.step))
    return SegmentPlan(out)


def windows(panel: Panel, plan: SegmentPlan, part: str, closed: str = "both") -> DataFrame:
    """Panel rows by segment; a row is in every window that holds its time.  ``closed`` "left"
    leaves a training window's last time out.

    Time is cut into slots of a quarter of the longest window (a second at least); a row meets only
    the windows that touch its slot, in an equi join, and the bounds are checked on those.
    """
    t, bounds = F.col(panel.time), [(getattr(s, f"{part}_start"), getattr(s, f"{part}_end")) for s in plan]
    half_open = closed == "left" and part == "train"
    if not bounds:
        return panel.df.withColumn("segment", F.lit(None).cast("int")).limit(0)
    second = timedelta(seconds=1)
    width = max(1, int(max(z - a for a, z in bounds) / 4 / second))
    origin = min(a for a, _ in bounds)
    slot = lambda x: (x - origin) // second // width
    # five slots a segment at most
    rows = [(n, i, a, z) for i, (a, z) in enumerate(bounds) for n in range(slot(a), slot(z) + 1)]
    table = panel.df.sparkSession.createDataFrame(rows, "__slot long, segment int, __a timestamp_ntz, __z timestamp_ntz")
    # times without a zone: the difference does not depend on the session's
    mine = F.floor((t.cast("timestamp_ntz") - F.lit(origin.isoformat()).cast("timestamp_ntz")).cast("bigint") / F.lit(width)).cast("long")
    inside = (t >= F.col("__a")) & ((t < F.col("__z")) if half_open else (t <= F.col("__z")))
    return panel.df.withColumn("__slot", mine).join(table, "__slot").where(inside).drop("__slot", "__a", "__z")


def window_counts(panel: Panel, plan: SegmentPlan) -> DataFrame:
    """segment, n_train, n_infer: distinct times in each window."""
    times = panel.on(panel.df.select(panel.time).distinct())
    count = lambda part: windows(times, plan, part).groupBy("segment").agg(F.count(F.lit(1)).alias(f"n_{part}"))
    base = plan.table(panel.df.sparkSession).select("segment")
    return base.join(count("train"), "segment", "left").join(count("infer"), "segment", "left").fillna(0, ["n_train", "n_infer"])


def optimize_plan(plan: SegmentPlan, panel: Panel, min_train: int = 100, min_infer: int = 10) -> SegmentPlan:
    """Segments with enough times in both windows."""
    keep = {r.segment for r in window_counts(panel, plan).where((F.col("n_train") >= min_train) & (F.col("n_infer") >= min_infer)).collect()}
    return SegmentPlan([s for i, s in enumerate(plan) if i in keep])


def resolve(df: DataFrame, keys: list[str], values: list[str], policy: str = "last") -> DataFrame:
    """One row a key from rows by segment: the value of the last (first) segment that has one."""
    if policy not in ("last", "first"):
        raise ValueError(f"unknown overlap policy {policy!r}")
    pick = F.max_by if policy == "last" else F.min_by
    return df.groupBy(*keys).agg(*[pick(v, F.when(F.col(v).isNotNull(), F.col("segment"))).alias(v) for v in values])


class WalkForwardRunner:
    """Shared processors once; in each segment the learn processors are fitted on the training
    window and applied to the inference window, then the infer processors.

    Every segment is a panel of its own (``Panel.within``), so all segments are one job.  Columns
    that learning adds stay in the result.
    """

    def __init__(self, handler: DataHandler, plan: SegmentPlan, overlap_policy: str = "last", closed: str = "both"):
        self.handler, self.plan, self.policy, self.closed = handler, plan, overlap_policy, closed

    def _keyed(self, panel: Panel, part: str) -> Panel:
        return Panel(windows(panel, self.plan, part, self.closed), panel.asset, panel.time, ("segment",))

    def run(self) -> Panel:
        shared = self.handler.shared_view().panel
        learn, infer = self._keyed(shared, "train"), self._keyed(shared, "infer")
        view = View(infer)
        fitted = View(learn)
        for p in self.handler.config.learn:
            fitted, state = p.fit_transform(fitted)
            view = p.transform(view, state)
        view = self.handler.apply_infer(view)
        return shared.on(resolve(view.panel.df, [shared.asset, shared.time], view.panel.features, self.policy))

    def run_segment(self, i: int) -> Panel:
        return WalkForwardRunner(self.handler, SegmentPlan([self.plan[i]]), self.policy, self.closed).run()

    def summary(self) -> dict:
        return {"segments": len(self.plan), "train": self.plan.total_train(), "infer": self.plan.total_infer(), "overlaps": len(self.plan.overlapping()), "policy": self.policy}
