"""From formula trees to Spark columns.

Scalar parts become plain expressions.  Calls that look at other rows are lowered layer by layer:
all calls whose arguments are ready go into the same step, equal calls are worked out once, and
calls along an asset share one partitioning and sort, as do calls across the assets of a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dsl import Binary, Call, Data, FormulaError, Name, Node, Null, Num, Seq, Unary, children, fold, rebuild, walk
from .kernels import REGISTRY, WARM, Axis, backfilled, finite
from .scan import Recurrence, scan


def function(name: str):
    if name not in REGISTRY:
        raise FormulaError(f"unknown function {name!r}")
    return REGISTRY[name]


def parameter(node: Node):
    node = fold(node)
    if isinstance(node, Num):
        return int(node.value) if float(node.value).is_integer() else float(node.value)
    if isinstance(node, Seq):
        return list(node.values)
    if isinstance(node, Null):
        return None
    raise FormulaError(f"{node} is not a number")


def column(node: Node) -> Column:
    """A tree without calls that look at other rows."""
    if isinstance(node, Num):
        return F.lit(float(node.value))
    if isinstance(node, (Data, Name)):
        return F.col(f"`{node.name}`")
    if isinstance(node, Null):
        return F.lit(None).cast("double")
    if isinstance(node, Unary):
        return -column(node.arg)
    if isinstance(node, Binary):
        a, b = column(node.left), column(node.right)
        if node.op == "/":
            return F.try_divide(a, b)
        if node.op == "^":
            return finite(F.pow(a, b))
        return {"+": Column.__add__, "-": Column.__sub__, "*": Column.__mul__}[node.op](a, b)
    if isinstance(node, Call):
        return function(node.name).build(*map(column, node.args))
    raise FormulaError(f"{node} is not a column")


class _Lowering:
    def __init__(self, df: DataFrame, axis: Axis):
        self.df, self.axis, self.done, self.made = df, axis, {}, []

    def name(self, stem: str) -> str:
        self.made.append(f"__{stem}{len(self.made)}")
        return self.made[-1]

    def replaced(self, node: Node) -> Node:
        if node in self.done:
            return Data(self.done[node])
        node = rebuild(node, tuple(map(self.replaced, children(node)))) if children(node) else node
        return Data(self.done[node]) if node in self.done else node

    def ready(self, nodes: list[Node]) -> list[Call]:
        out: dict[Call, None] = {}
        for root in nodes:
            for node in walk(root):
                if isinstance(node, Call) and function(node.name).kind != "scalar":
                    inner = [n for a in node.args for n in walk(a)]
                    if not any(isinstance(n, Call) and function(n.name).kind != "scalar" for n in inner):
                        out[node] = None
        return list(out)

    def layer(self, calls: list[Call]) -> None:
        arguments: dict[Node, str] = {}
        for call in calls:
            f = function(call.name)
            if len(call.args) < f.data:
                raise FormulaError(f"{call.name} needs {f.data} columns")
            for a in call.args[: f.data]:
                if not isinstance(a, (Data, Name)) and a not in arguments:
                    arguments[a] = self.name("a")
        if arguments:
            self.df = self.df.withColumns({name: column(a).cast("double") for a, name in arguments.items()})
        at = lambda a: arguments.get(a) or a.name
        windows, scans, gaps = {}, [], {}
        for call in calls:
            f, name = function(call.name), self.name("w")
            values = [parameter(a) for a in call.args[f.data :]]
            values += list(f.defaults[len(values) :])
            self.done[call] = name
            if f.kind == "scan":
                kernel = f.build(*values)
                scans.append(Recurrence(name, kernel, tuple(at(a) for a in call.args[: f.data])))
                w = kernel.window
            else:
                windows[name] = f.build(self.axis, *(F.col(f"`{at(a)}`") for a in call.args[: f.data]), *values)
                w = values[0] if call.name in WARM else 1
            if call.name in WARM and w > 1:
                gaps[name] = w
        if windows:
            self.df = self.df.withColumns(windows)
        if scans:
            self.df = scan(self.df, list(self.axis.assets), self.axis.time, scans)
        if gaps and self.axis.warmup == "backfill":
            self.df = self.df.withColumns({n: backfilled(self.axis, F.col(n), w) for n, w in gaps.items()})


#: A frame of w rows is added up anew for every row; from this window on, sums and means are put
#: together from running sums within blocks of w rows.  Nothing is subtracted, so both ways agree but
#: for rounding in the last digits.
LONG_WINDOW = 200


def long_windows(node: Node) -> Node:
    node = rebuild(node, tuple(map(long_windows, children(node)))) if children(node) else node
    if isinstance(node, Call) and node.name in ("sma", "rolling_sum") and len(node.args) == 2:
        w = fold(node.args[1])
        if isinstance(w, Num) and w.value >= LONG_WINDOW:
            at = (node.args[0], Call("row_position", node.args[:1]), w)
            total = Call("sum_of_blocks", (Call("block_head", at), Call("block_tail", at), *at[1:]))
            return Binary("/", total, w) if node.name == "sma" else total
    return node


def compute(df: DataFrame, axis: Axis, wanted: dict[str, Node]) -> DataFrame:
    """df with a column for each formula; names that exist are replaced."""
    low, nodes = _Lowering(df, axis), {k: long_windows(v) for k, v in wanted.items()}
    while calls := low.ready(list(nodes.values())):
        low.layer(calls)
        nodes = {k: low.replaced(v) for k, v in nodes.items()}
    return low.df.withColumns({k: column(v) for k, v in nodes.items()}).drop(*low.made)
