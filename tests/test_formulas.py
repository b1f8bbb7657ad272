"""The language, its compiler and the manager."""

import math

import pytest

from panelith.functions import kernels, weights
from panelith.functions.compiler import compute
from panelith.functions.dsl import FormulaError, Num, calls, fold, parse, tokenize, tree, valid, variables
from panelith.functions.kernels import Axis
from panelith.functions.manager import FormulaManager, with_formula


def series(spark, values, column="x", asset="a"):
    rows = [(asset, f"2020-01-{i + 1:02d}", None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"asset string, t string, {column} double").selectExpr("asset", "cast(t as timestamp_ntz) as time", column)


def out(df, column="value"):
    return [r[column] for r in df.orderBy("asset", "time").collect()]


@pytest.mark.parametrize("text, value", [("2 + 3 * 4", 14), ("2 ^ 3 ^ 2", 512), ("-2 ^ 2", -4), ("(1 + 2) * -3", -9), ("2 ** 3", 8), ("10 / 4 - 1", 1.5), ("1e2 + .5", 100.5), ("2 - 3 - 4", -5)])
def test_precedence(text, value):
    assert fold(parse(text)) == Num(value) or fold(parse(text)).value == value


@pytest.mark.parametrize("text", ["", "1 +", "f(1,", "f(1,)", "a b", "x.y", "f(x=1)", "'s'", "1 < 2", "((1)", "import os", "$", "f()()", "1 2"])
def test_rejected(text):
    assert not valid(text)
    with pytest.raises(FormulaError):
        parse(text)


def test_introspection():
    text = "ema($price, $w) + cs_rank(size) / 2"
    assert variables(text) == {"price", "w", "size"} and calls(text) == {"ema", "cs_rank"}
    assert parse(str(parse(text))) == parse(text)
    assert [k for k, _ in tokenize("1+$a")] == ["number", "sign", "data"]
    assert "ema" in tree(parse(text))
    assert str(fold(parse("1 / 0"))) == "1 / 0"


def test_sma_warm_up(spark):
    df = series(spark, [1, 2, 3, 4, 5, 6])
    assert out(with_formula(df, "sma($x, 3)", "value")) == [2, 2, 2, 3, 4, 5]
    assert out(compute(df, Axis(warmup="null"), {"value": parse("sma($x, 3)")})) == [None, None, 2, 3, 4, 5]
    assert out(with_formula(df, "sma($x, 7)", "value")) == [None] * 6


def test_rolling_values(spark):
    df = series(spark, [3, None, 5, 1, 1])
    assert out(with_formula(df, "rolling_sum($x, 2)", "value")) == [3, 3, 5, 6, 2]
    assert out(with_formula(df, "moving_median($x, 3)", "value")) == [3, 3, 3, 1, 1]
    assert out(with_formula(df, "moving_mode($x, 3)", "value")) == [0, 0, 0, 0, 1]
    assert out(with_formula(df, "gain($x, 1)", "value")) == [0, 0, 5, 0, 0]
    assert out(with_formula(df, "loss($x, 1)", "value")) == [0, 3, 0, 4, 0]
    assert out(with_formula(df, "shift($x, 1)", "value")) == [None, None, 3, 5, 1]
    assert out(with_formula(df, "shift($x, -1)", "value")) == [5, None, 1, 1, None]
    assert out(with_formula(df, "ffill($x)", "value")) == [3, 3, 5, 1, 1]


def test_recurrences_against_loops(spark):
    x = [math.sin(i) * 10 + i for i in range(25)]
    df = series(spark, x)

    def smooth(w, alpha, seed):
        v = seed * sum(x[:w])
        want = [v] * w
        for a in x[w:]:
            v = alpha * a + (1 - alpha) * v
            want.append(v)
        return want

    assert out(with_formula(df, "ema($x, 6)", "value")) == pytest.approx(smooth(6, 2 / 7, 2 / 7))
    assert out(with_formula(df, "rma($x, 6)", "value")) == pytest.approx(smooth(6, 1 / 6, 1 / 6))
    two = df.unionByName(series(spark, [1, 2, 3], asset="b"))
    assert out(with_formula(two, "ema($x, 6)", "value"))[25:] == [None] * 3


@pytest.mark.parametrize("parts", [1, 7])
def test_partitions_do_not_matter(spark, parts):
    df = series(spark, range(20)).unionByName(series(spark, [5, 1, 4], asset="b")).repartition(parts)
    assert out(with_formula(df, "ema(sma($x, 2), 3) + cs_rank($x)", "value")) == out(with_formula(df.coalesce(1), "ema(sma($x, 2), 3) + cs_rank($x)", "value"))


def cross(spark, values, name="x"):
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], f"asset int, {name} double").selectExpr("asset", "timestamp_ntz'2020-01-01' as time", name)


@pytest.mark.parametrize("text, values, want", [
    ("cs_rank($x)", [10, 30, 20, 40, 50], [0, 0.5, 0.25, 0.75, 1]),
    ("cs_rank($x)", [10, None, 20, None, 50], [0, None, 0.5, None, 1]),
    ("cs_rank($x)", [None, None, 10, None, None], [None] * 5),
    ("cs_quantile($x, 0.5)", [10, 20, 30, 40, 50], [30] * 5),
    ("cs_demean($x)", [10, None, 30], [-10, None, 10]),
    ("where(gt($x, 0), $x, 0)", [-1, 2, -3, 4, 0], [0, 2, 0, 4, 0]),
    ("assign_bucket($x, 30, 60)", [10, 25, 35, 50, 80], [0, 0, 1, 1, 2]),
    ("assign_bucket($x, cs_quantile($x, 0.5))", [10, 20, 30, 40, 50], [0, 0, 0, 1, 1]),
    ("1 / $x", [0, 2, None], [None, 0.5, None]),
    ("log($x)", [0, 1, -1], [None, 0, None]),
    ("sqrt($x)", [4, -4, None], [2, None, None]),
    ("where(lt($x, 1), 1, 2)", [None, 0, 3], [2, 1, 2]),
])
def test_cross_section(spark, text, values, want):
    assert out(with_formula(cross(spark, values), text, "value")) == pytest.approx(want)


def test_layers_share_work(spark):
    df = series(spark, range(10))
    plan = compute(df, Axis(), {"a": parse("sma($x, 3) + shift($x, 1)"), "b": parse("sma($x, 3) * 2")})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(asset") == 1 and "Python" not in plan


def test_manager_names_and_lags(spark):
    m = FormulaManager()
    names = list(m.trees({"sma": [{"window": 20}, {"window": 50}], "rsi": [{"window": 14}, {"window": 7}], "alma": {"offset": 0.5}, "hwma": {"na": 0.25}}, {"price": "x"}))
    assert names == ["sma", "sma_ww50", "rsi", "rsi_ww7", "alma_o0p5", "hwma_n0p25"]
    assert list(m.trees({"price_ret_var": {"periods": 3, "lag": [1, -2]}})) == ["price_ret_var_p3_lag1", "price_ret_var_p3_lead2"]
    got = m.evaluate(series(spark, range(1, 9), "close"), {"price_ret_var": {"prc": "close", "periods": 2}}, alias={"prc": "close"})
    assert out(got, [c for c in got.columns if c.startswith("price_ret")][0])[2] == 2.0


def test_manager_dependencies(spark):
    m, df = FormulaManager(), series(spark, range(1, 30), "price")
    assert m.dependencies("ts_combined") == {"ts_signal", "rsi"} and m.inputs("ts_combined") == {"price"}
    order = m.order(["ts_combined"])
    assert order.index("ts_momentum") < order.index("ts_signal") < order.index("ts_combined")
    m.add("one", {"formula": "$two + 1"})
    m.add("two", {"formula": "$one * 2"})
    with pytest.raises(FormulaError):
        m.tree("one")
    with pytest.raises(FormulaError):
        m.order(["one"])
    with pytest.raises(KeyError):
        m.add("rsi", {"formula": "1"})
    with pytest.raises(FormulaError):
        m.add("bad", {"formula": "1 +"})
    with pytest.raises(FormulaError):
        m.add("odd", {"formula": "1", "parameters": {"w": {"generator": "alma", "module": "os"}}})
    with pytest.raises(FormulaError):
        m.tree("rsi", {"window": 1000})
    with pytest.raises(FormulaError):
        m.tree("rsi", {"window": "x"})
    assert {"ts_momentum", "ts_signal", "rsi", "ts_combined"} <= set(m.evaluate(df, "ts_combined", dependencies=True).columns)
    assert len(m.list()) >= 43 and m.info("alma")["variables"] == ["price"]


def test_all_formulas_compile(spark):
    m = FormulaManager()
    inputs = sorted({v for n in m.list() for v in m.inputs(n)})
    df = spark.range(30).selectExpr("id % 2 as asset", "timestamp_ntz'2020-01-01' + make_dt_interval(cast(id as int)) as time", *[f"cast(id * 7 % 11 + 1 as double) as {c}" for c in inputs])
    got = m.evaluate_all(df)
    assert set(m.list()) <= set(got.columns) and got.count() == 30


def test_registered_function(spark):
    @kernels.register("double_it")
    def double_it(x):
        return x * 2

    try:
        assert out(with_formula(cross(spark, [1, 2]), "double_it($x) + 1", "value")) == [3, 5]
        with pytest.raises(KeyError):
            kernels.register("double_it")(double_it)
    finally:
        kernels.reset()
    with pytest.raises(FormulaError):
        compute(cross(spark, [1]), Axis(), {"v": parse("double_it($x)")})
    assert "ema" in kernels.by_category()["rolling"]


def test_weights():
    assert weights.linear(3) == [1, 2, 3]
    assert weights.fibonacci(5)[-1] == pytest.approx(5 / 12) and weights.fibonacci(1) == [1]
    assert weights.triangular(4) == pytest.approx([1 / 6, 2 / 6, 2 / 6, 1 / 6])
    assert sum(weights.alma(10)) == pytest.approx(1) and weights.alma(10)[0] > weights.alma(10)[-1]
    assert weights.exponential(3)[-1] == 1 and weights.half_window(21) == 10 and weights.sqrt_window(21) == 4
    with pytest.raises(ValueError):
        weights.custom(3, [1, 2])
    with pytest.raises(KeyError):
        weights.generator("os.system")


def test_long_windows_use_block_sums(spark, monkeypatch):
    from panelith.functions import compiler

    df = series(spark, [i * 7 % 5 + 1e15 * (i == 3) for i in range(30)])
    want = out(with_formula(df, "sma($x, 8) + rolling_sum($x, 9)", "value"))
    monkeypatch.setattr(compiler, "LONG_WINDOW", 8)
    got = out(with_formula(df, "sma($x, 8) + rolling_sum($x, 9)", "value"))
    assert got == pytest.approx(want)
    # nothing is left of a large value once it is out of the window
    assert got[15:] == want[15:]


def test_recurrences_over_batches():
    """Whole columns, cut into batches anywhere, against one step after the other."""
    import numpy as np

    from panelith.functions.kernels import Adaptive, HoltWinters, Smoothed

    r = np.random.default_rng(4)
    assets = np.repeat(np.arange(40), r.integers(1, 30, 40))
    x, s = (np.where(r.uniform(size=len(assets)) < 0.2, np.nan, r.normal(size=len(assets)) * 100) for _ in range(2))
    s = s / 300

    def plain(kind):
        out = []
        for k in range(40):
            mine, sk = x[assets == k], s[assets == k]
            if kind == "smoothed":
                y = 0.0
                for n, v in enumerate(np.nan_to_num(mine), 1):
                    y = y + v if n < 4 else 0.25 * (y + v) if n == 4 else 0.4 * v + 0.6 * y
                    out.append(y if n >= 4 else None)
            elif kind == "adaptive":
                y = None
                for v, w in zip(mine, sk):
                    if not (np.isnan(v) or np.isnan(w)):
                        y = 0.0 if y is None else w * v + (1 - w) * y
                    out.append(y)
            else:
                state = None
                for v in np.nan_to_num(mine):
                    f, t, a = state or (v, 0.0, 0.0)
                    f2 = 0.8 * (f + t + a / 2) + 0.2 * v
                    t2 = 0.9 * (t + a) + 0.1 * (f2 - f)
                    a2 = 0.7 * a + 0.3 * (t2 - t)
                    state = (f2, t2, a2)
                    out.append(f2 + t2 + a2 / 2)
        return out

    for kind, make, columns in (("smoothed", lambda: Smoothed(4, 0.4, 0.25), (x,)), ("adaptive", Adaptive, (x, s)), ("holt", lambda: HoltWinters(0.2, 0.1, 0.3), (x,))):
        for cut in (1, 7, 100, len(x)):
            kernel, got = make(), []
            fresh = np.concatenate([[True], assets[1:] != assets[:-1]])
            for a in range(0, len(x), cut):
                got += kernel.run(fresh[a : a + cut], *(c[a : a + cut] for c in columns)).tolist()
            assert [None if v != v else v for v in got] == pytest.approx(plain(kind)), (kind, cut)
