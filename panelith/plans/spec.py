"""Pipelines from YAML: data, merges, features, preprocessing, a walk-forward model."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass, field
from datetime import datetime, timedelta
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from ..functions.manager import FormulaManager
from ..operators.joins import implicit, merge_all
from ..operators.panel import Panel
from ..operators.processors import DataHandler, FormulaEval, HandlerConfig, PipelineMode, Side, View, create_processor
from ..sources.readers import DataManager, SourceConfig
from .cache import Cache, Stage
from .models import ModelRunner
from .walkforward import SegmentConfig, make_plan


class SpecError(ValueError):
    pass


@dataclass
class Operation:
    name: str
    formulas: dict = field(default_factory=dict)
    expressions: dict[str, str] = field(default_factory=dict)
    depends_on: list[str] = field(default_factory=list)


@dataclass
class PipelineSpec:
    name: str
    version: str
    start: str
    end: str
    data: dict[str, dict]
    merges: list[dict] = field(default_factory=list)
    base: str | None = None
    operations: list[Operation] = field(default_factory=list)
    preprocessing: dict | None = None
    model: dict | None = None
    metadata: dict = field(default_factory=dict)

    @classmethod
    def parse(cls, raw: dict) -> PipelineSpec:
        if not isinstance(raw, dict):
            raise SpecError("a specification is a mapping")
        for part in ("name", "time_range", "data"):
            if part not in raw:
                raise SpecError(f"{part!r} is missing")
        ops = []
        for op in (raw.get("features") or {}).get("operations", []):
            formulas, expressions = {}, {}
            for k, v in (op.get("formulas") or {}).items():
                if isinstance(v, dict) and "expression" in v:
                    expressions[k] = v["expression"]
                else:
                    formulas[k] = v
            ops.append(Operation(op["name"], formulas, expressions, list(op.get("depends_on") or [])))
        data = dict(raw["data"])
        merges, base = data.pop("merges", None) or raw.get("merges") or [], data.pop("base", None) or raw.get("base")
        spec = cls(raw["name"], str(raw.get("version", "1.0")), str(raw["time_range"]["start"]), str(raw["time_range"]["end"]), data, merges, base, ops, raw.get("preprocessing"), raw.get("model"), raw.get("metadata") or {})
        spec.validate()
        return spec

    @classmethod
    def load(cls, path: str | Path) -> PipelineSpec:
        return cls.parse(yaml.safe_load(Path(path).read_text()))

    def dump(self) -> str:
        ops = [{"name": o.name, "formulas": {**o.formulas, **{k: {"expression": v} for k, v in o.expressions.items()}}, "depends_on": o.depends_on} for o in self.operations]
        raw = {"name": self.name, "version": self.version, "time_range": {"start": self.start, "end": self.end}, "data": self.data, "merges": self.merges, "base": self.base, "features": {"operations": ops}, "preprocessing": self.preprocessing, "model": self.model, "metadata": self.metadata}
        return yaml.safe_dump({k: v for k, v in raw.items() if v not in (None, [], {})}, sort_keys=False)

    def save(self, path: str | Path) -> None:
        Path(path).write_text(self.dump())

    def validate(self) -> None:
        if not self.data:
            raise SpecError("no data source")
        try:
            if datetime.fromisoformat(self.start) >= datetime.fromisoformat(self.end):
                raise SpecError("the time range ends before it starts")
        except ValueError as e:
            raise SpecError(f"time_range: {e}") from e
        names = [o.name for o in self.operations]
        if len(set(names)) < len(names):
            raise SpecError("two operations have one name")
        self.order()
        used = {m.get("source") or m.get("right") for m in self.merges}
        if used - set(self.data):
            raise SpecError(f"merges of unknown sources: {sorted(map(str, used - set(self.data)))}")
        if self.merges and set(self.data) - used - {self.base or next(iter(self.data))}:
            raise SpecError("sources without a merge: " + ", ".join(sorted(set(self.data) - used - {self.base or next(iter(self.data))})))
        if self.model and not {"type", "features", "walk_forward"} <= set(self.model):
            raise SpecError("a model has a type, features and walk_forward")

    def order(self) -> list[Operation]:
        """Operations after those they depend on, else as written."""
        left, done, out = list(self.operations), set(), []
        for o in left:
            if unknown := set(o.depends_on) - {x.name for x in left}:
                raise SpecError(f"{o.name} depends on unknown {sorted(unknown)}")
        while left:
            ready = next((o for o in left if set(o.depends_on) <= done), None)
            if ready is None:
                raise SpecError(f"operations depend on each other: {sorted(o.name for o in left)}")
            left.remove(ready)
            done.add(ready.name)
            out.append(ready)
        return out


@dataclass
class ExecutionResult:
    sources: dict[str, Panel]
    features: Panel
    preprocessed: View | None = None
    predictions: DataFrame | None = None
    keys: dict[str, str] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)
    cache: dict = field(default_factory=dict)

    @property
    def final(self) -> Panel:
        return self.preprocessed.panel if self.preprocessed else self.features


def spans(walk: dict, low: datetime, high: datetime) -> SegmentConfig:
    """walk_forward settings in hours or days; a missing bound is the data's own."""
    def span(name: str, default: float) -> timedelta:
        if f"{name}_days" in walk:
            return timedelta(days=float(walk[f"{name}_days"]))
        return timedelta(hours=float(walk.get(f"{name}_hours", default)))

    at = lambda x, other: other if x is None else x if isinstance(x, datetime) else datetime.fromisoformat(str(x))
    return SegmentConfig(at(walk.get("start"), low), at(walk.get("end"), high), span("train_span", 120), span("infer_span", 24), span("step", 24), span("gap", 0))


class PipelineExecutor:
    """Runs a specification stage by stage; with a cache, each stage's result is stored by content:
    its settings, the files read (names, sizes, times), the formulas' definitions, its parents."""

    def __init__(self, spark: SparkSession, manager: DataManager | None = None, cache: Cache | None = None, formulas: FormulaManager | None = None):
        self.spark, self.manager, self.cache = spark, manager or DataManager(spark), cache
        self.formulas = formulas or FormulaManager()

    def _stage(self, result: ExecutionResult, name: str, stage: Stage, config, make, parents: list[str]) -> DataFrame:
        began = time.time()
        if self.cache is None:
            df = make()
        else:
            df, result.keys[name] = self.cache.get_or_compute(stage, config, make, parents)
        result.seconds[name] = time.time() - began
        return df

    def execute(self, spec: PipelineSpec | str | Path) -> ExecutionResult:
        spec = spec if isinstance(spec, PipelineSpec) else PipelineSpec.load(spec)
        result = ExecutionResult({}, None)
        for name, raw in spec.data.items():
            config = SourceConfig.of({"start_date": spec.start, "end_date": spec.end, **raw})
            df = self._stage(result, f"data:{name}", Stage.L2_POSTPROCESSED, [asdict(config), self.manager.inputs(config)], lambda c=config: self.manager.load(c).df, [])
            result.sources[name] = Panel(df)
        panel = self._merged(spec, result.sources)
        parents = [k for n, k in result.keys.items() if n.startswith("data:")]
        for op in spec.order():
            step = FormulaEval(op.formulas, expressions=op.expressions, manager=self.formulas)
            df = self._stage(result, f"features:{op.name}", Stage.L3_FEATURES, [asdict(op), spec.merges, self.formulas.formulas], lambda p=panel, s=step: s.transform(View(p)).panel.df, parents + [result.keys[f"features:{d}"] for d in op.depends_on if f"features:{d}" in result.keys] + [k for n, k in list(result.keys.items())[-1:] if n.startswith("features:")])
            panel = panel.on(df)
        result.features = panel
        handler = DataHandler(panel, self._handler(spec.preprocessing))
        parents = list(result.keys.values())
        if spec.preprocessing:
            side = Side.INFER if handler.config.infer and not handler.config.learn else Side.LEARN
            view = handler.view(side)
            df = self._stage(result, "preprocessing", Stage.L4_PREPROCESSED, spec.preprocessing, lambda: view.panel.df, parents)
            result.preprocessed = View(view.panel.on(df), view.frames)
        if spec.model:
            result.predictions = self._stage(result, "model", Stage.L5_MODEL, spec.model, lambda: self._model(spec, result.final), list(result.keys.values()))
        if self.cache:
            result.cache = self.cache.stats()
        return result

    def _merged(self, spec: PipelineSpec, sources: dict[str, Panel]) -> Panel:
        if not spec.merges:
            return implicit(list(sources.values()))
        base = spec.base or next(iter(sources))
        return merge_all(sources[base], {k: v for k, v in sources.items() if k != base}, spec.merges)

    @staticmethod
    def _handler(raw: dict | None) -> HandlerConfig:
        raw = raw or {}
        make = lambda part: [create_processor(p, i) for i, p in enumerate(raw.get(part) or [])]
        return HandlerConfig(make("shared"), make("learn"), make("infer"), PipelineMode(raw.get("mode", "independent")))

    @staticmethod
    def _model(spec: PipelineSpec, panel: Panel) -> DataFrame:
        m = spec.model
        walk = m["walk_forward"]
        low, high = panel.bounds() if not {"start", "end"} <= set(walk) else (None, None)
        plan = make_plan(spans(walk, low, high))
        adapter, runner = m.get("adapter_params") or {}, m.get("runner_params") or {}
        run = ModelRunner(m["type"], m["features"], m.get("target"), m.get("params"), adapter.get("output_var", "pred"), runner.get("overlap_policy", "last"))
        return run.run(panel, plan)
