"""Named formulas: definitions, dependencies, evaluation of many configurations at once."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

import yaml
from pyspark.sql import DataFrame

from .compiler import compute
from .dsl import Binary, Call, Data, FormulaError, Name, Node, Null, Num, Seq, children, parse, rebuild, walk
from .kernels import REGISTRY, Axis
from .weights import generator

LIBRARY = Path(__file__).with_name("formulas.yaml")

_KEYS = {"about", "formula", "parameters"}


class FormulaManager:
    def __init__(self, *files: str | Path, builtin: bool = True):
        self.formulas: dict[str, dict] = {}
        for f in ([LIBRARY] if builtin else []) + list(files):
            self.load(f)

    # ---- definitions

    def load(self, path: str | Path) -> None:
        for name, definition in (yaml.safe_load(Path(path).read_text()) or {}).items():
            self.add(name, definition)

    def add(self, name: str, definition: dict) -> None:
        if name in self.formulas:
            raise KeyError(f"formula {name!r} exists already")
        unknown = set(definition) - _KEYS
        if unknown or not isinstance(definition.get("formula"), str):
            raise FormulaError(f"{name}: a definition has a text 'formula', and may have 'about' and 'parameters'; found {sorted(unknown)}")
        parse(definition["formula"])
        for p, spec in (definition.get("parameters") or {}).items():
            if not isinstance(spec, dict) or set(spec) - {"default", "min", "max", "generator", "with"}:
                raise FormulaError(f"{name}: parameter {p!r} is not understood")
            if "generator" in spec:
                generator(spec["generator"])
        self.formulas[name] = {"about": "", "parameters": {}, **{k: v for k, v in definition.items() if v is not None}}

    def get(self, name: str) -> dict:
        """A definition; a plain function of one column has one too."""
        if name in self.formulas:
            return self.formulas[name]
        if name in REGISTRY and REGISTRY[name].data == 1:
            f = REGISTRY[name]
            names = {"shift": ["periods"], "returns": ["periods"], "cs_quantile": ["q"], "wma": ["window", "weights"]}.get(name, ["window", "beta", "gamma"])
            defaults = list(f.defaults) or ([0.5] if name == "cs_quantile" else [])
            names = names[: len(defaults)]
            args = "".join(f", ${n}" for n in names)
            return {"about": f.doc, "formula": f"{name}($price{args})", "parameters": {n: {"default": d} for n, d in zip(names, defaults)}}
        raise KeyError(f"no formula {name!r}")

    def list(self) -> list[str]:
        return sorted(self.formulas)

    def info(self, name: str) -> dict:
        return {"name": name, **self.get(name), "dependencies": sorted(self.dependencies(name)), "variables": sorted(self.inputs(name))}

    def dependencies(self, name: str) -> set[str]:
        """Formulas that it calls or names as a variable."""
        definition = self.get(name)
        found = {n.name for n in walk(parse(definition["formula"])) if isinstance(n, (Call, Data, Name))} - set(definition["parameters"])
        return {f for f in found if f in self.formulas and f != name and not (f in REGISTRY and self._called(definition, f))}

    def _called(self, definition: dict, f: str) -> bool:
        return any(isinstance(n, Call) and n.name == f for n in walk(parse(definition["formula"])))

    def inputs(self, name: str) -> set[str]:
        """Columns that it needs."""
        return {n.name for n in walk(self.tree(name)) if isinstance(n, (Data, Name))}

    def order(self, names: Iterable[str] | None = None) -> list[str]:
        """Dependencies first, by layers, sorted within a layer; a cycle is an error."""
        want, todo = set(names if names is not None else self.formulas), []
        stack = list(want)
        while stack:
            n = stack.pop()
            if n not in todo:
                todo.append(n)
                stack += self.dependencies(n)
        done, out = set(), []
        while len(done) < len(todo):
            layer = sorted(n for n in todo if n not in done and self.dependencies(n) <= done)
            if not layer:
                raise FormulaError(f"formulas depend on each other: {sorted(set(todo) - done)}")
            done.update(layer)
            out += layer
        return out

    # ---- trees

    def values(self, name: str, config: dict) -> dict:
        """Parameters with defaults, checks and generated values."""
        spec, out = self.get(name)["parameters"], {}
        for p, s in spec.items():
            if p in config:
                out[p] = config[p]
            elif "generator" not in s:
                if "default" not in s:
                    raise FormulaError(f"{name}: parameter {p!r} is missing")
                out[p] = s["default"]
            v = out.get(p)
            if isinstance(v, (int, float)) and not isinstance(v, bool):
                if "min" in s and v < s["min"] or "max" in s and v > s["max"]:
                    raise FormulaError(f"{name}: {p} = {v} is outside {s.get('min')} to {s.get('max')}")
            elif p in out and isinstance(s.get("default"), (int, float)) and not isinstance(s["default"], bool):
                raise FormulaError(f"{name}: {p} = {v!r} is not a number")
        for p, s in spec.items():
            if p not in out:
                out[p] = generator(s["generator"])(*(out[w] for w in s.get("with", ())))
        return out

    def tree(self, name: str, config: dict | None = None, alias: dict[str, str] | None = None, _open: tuple[str, ...] = ()) -> Node:
        """The formula with parameters filled in, names resolved and other formulas expanded.

        ``config`` may also map a variable to a column: {"price": "close"}.
        """
        if name in _open:
            raise FormulaError(f"formulas depend on each other: {[*_open, name]}")
        config, definition = dict(config or {}), self.get(name)
        values = self.values(name, config)
        columns = {**(alias or {}), **{k: v for k, v in config.items() if isinstance(v, str) and k not in values}}
        return self.expand(parse(definition["formula"]), values, columns, (*_open, name), alias)

    def expand(self, node: Node, values: dict | None = None, columns: dict | None = None, _open: tuple[str, ...] = (), alias: dict | None = None) -> Node:
        """Resolves the names in a tree: parameter, then column given for it, then formula, then column."""
        values, columns = values or {}, columns or {}
        if isinstance(node, (Data, Name)):
            if node.name in values:
                v = values[node.name]
                return Null() if v is None else Seq(tuple(map(float, v))) if isinstance(v, (list, tuple)) else Data(v) if isinstance(v, str) else v if isinstance(v, Node) else Num(int(v) if isinstance(v, bool) else v)
            if node.name in columns:
                return Data(columns[node.name])
            if node.name in self.formulas and node.name not in _open:
                return self.tree(node.name, {}, alias, _open)
            if node.name in _open[:-1]:
                raise FormulaError(f"formulas depend on each other: {[*_open, node.name]}")
            return Data(node.name)
        if isinstance(node, Call):
            args = tuple(self.expand(a, values, columns, _open, alias) for a in node.args)
            if node.name == "compounded":
                return _compounded(*args)
            if node.name in REGISTRY:
                return Call(node.name, args)
            if node.name in self.formulas:
                return self._inline(node.name, args, _open, alias)
            raise FormulaError(f"unknown function {node.name!r}")
        return rebuild(node, tuple(self.expand(c, values, columns, _open, alias) for c in children(node))) if children(node) else node

    def _inline(self, name: str, args: tuple[Node, ...], _open: tuple[str, ...], alias: dict | None) -> Node:
        """A formula called like a function: its variables in the order of the text, then parameters."""
        if name in _open:
            raise FormulaError(f"formulas depend on each other: {[*_open, name]}")
        definition = self.get(name)
        names = [n.name for n in walk(parse(definition["formula"])) if isinstance(n, (Data, Name)) and n.name not in definition["parameters"]]
        slots = [*dict.fromkeys(names), *(p for p, s in definition["parameters"].items() if "generator" not in s)]
        given = dict(zip(slots, args))
        numbers = {k: v.value for k, v in given.items() if isinstance(v, Num) and k in definition["parameters"]}
        values = {**self.values(name, numbers), **{k: v for k, v in given.items() if k not in numbers}}
        return self.expand(parse(definition["formula"]), values, alias, (*_open, name), alias)

    # ---- evaluation

    def column_name(self, name: str, config: dict, number: int | None, taken: Iterable[str]) -> str:
        """The formula's name; with parameters that are no defaults, their short forms and values."""
        spec, parts = self.get(name)["parameters"], []
        for p, v in sorted(config.items()):
            if p.startswith("_") or p in ("price", "lag"):
                continue
            default = spec.get(p, {}).get("default")
            if default is None or v != default:
                short = "".join(c for c in p if c.isupper() or c == p[0]).lower() or p[:1]
                if isinstance(v, bool):
                    text = "T" if v else "F"
                elif isinstance(v, (int, float)):
                    text = str(int(v)) if float(v).is_integer() else str(v).replace(".", "p")
                else:
                    text = str(v)[:3]
                parts.append(short + text)
        if parts:
            return "_".join([name, *parts])
        return name if name not in taken or number is None else f"{name}_{number}"

    def trees(self, request: str | list | dict, alias: dict[str, str] | None = None) -> dict[str, Node]:
        """Columns by name for a name, a list of names, or {name: configuration or list of them}."""
        if isinstance(request, str):
            request = [request]
        if not isinstance(request, dict):
            request = {n: {} for n in request}
        out: dict[str, Node] = {}
        for name, configs in request.items():
            configs = [c or {} for c in (configs if isinstance(configs, list) else [configs])]
            for number, config in enumerate(configs):
                label = self.column_name(name, config, number if len(configs) > 1 else None, out)
                node = self.tree(name, {k: v for k, v in config.items() if k != "lag"}, alias)
                if config.get("lag") is None:
                    out[label] = node
                else:
                    for k in config["lag"] if isinstance(config["lag"], list) else [config["lag"]]:
                        out[f"{label}_lag{k}" if k >= 0 else f"{label}_lead{-k}"] = Call("shift", (node, Num(k)))
        return out

    def evaluate(self, df: DataFrame, request: str | list | dict, axis: Axis | None = None, alias: dict[str, str] | None = None, dependencies: bool = False) -> DataFrame:
        """df with the requested columns; with ``dependencies``, also those of the formulas that
        they name, at their defaults (worked out once in any case)."""
        wanted = self.trees(request, alias)
        if dependencies:
            names = [request] if isinstance(request, str) else list(request)
            wanted = {**{n: self.tree(n, {}, alias) for n in self.order(names) if n not in names}, **wanted}
        return compute(df, axis or Axis(), wanted)

    def evaluate_all(self, df: DataFrame, axis: Axis | None = None, alias: dict[str, str] | None = None) -> DataFrame:
        """Every formula whose columns are there."""
        have = set(df.columns)
        return self.evaluate(df, [n for n in self.order() if {(alias or {}).get(v, v) for v in self.inputs(n)} <= have], axis, alias)


def _compounded(x: Node, n: Node) -> Node:
    """(1 + x) times the same of its n - 1 predecessors, less 1."""
    out: Node = Binary("+", Num(1), x)
    for i in range(1, int(n.value)):
        out = Binary("*", out, Binary("+", Num(1), Call("shift", (x, Num(i)))))
    return Binary("-", out, Num(1))


def with_formula(df: DataFrame, text: str, name: str | None = None, axis: Axis | None = None, parameters: dict | None = None, manager: FormulaManager | None = None) -> DataFrame:
    """Adds one column from formula text; ``parameters`` gives numbers, lists or column aliases.
    The default name is the first 50 characters of the text."""
    node = (manager or FormulaManager()).expand(parse(text), parameters)
    return compute(df, axis or Axis(), {name or text[:50]: node})
