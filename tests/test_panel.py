"""Tables, filters, joins, processors, walk-forward, backtests, specifications, cache."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelith.operators import backtest, filters, joins, processors
from panelith.operators.panel import Panel, from_table, simulated
from panelith.plans.cache import Cache, Stage, content_key
from panelith.plans.models import MODELS, ModelRunner, create_model
from panelith.plans.spec import PipelineExecutor, PipelineSpec, SpecError
from panelith.plans.walkforward import Segment, SegmentConfig, expand_plan, make_plan, optimize_plan
from panelith.sources.readers import DataManager, SourceBuilder, builtin, get_provider, load_sources


def test_from_table(spark):
    t = spark.createDataFrame([("a", "2020-01-05 10:00:00", 1.0, "p"), ("a", "2020-01-20 00:00:00", 2.0, "q"), ("b", "2020-01-01 00:00:00", float("nan"), "r")], "id string, ts string, v double, s string")
    p = from_table(t, "ts", "id", frequency="monthly")
    got = {r.asset: (str(r.time), r.v, r.s) for r in p.df.collect()}
    assert got == {"a": ("2020-01-01 00:00:00", 2.0, "q"), "b": ("2020-01-01 00:00:00", None, "r")}
    with pytest.raises(ValueError):
        from_table(t, "ts", "id", ["nope"])
    with pytest.raises(ValueError):
        from_table(t, "ts", "id", frequency="weekly")
    with pytest.raises(Exception, match="missing or invalid"):
        from_table(t.withColumn("ts", F.lit(None).cast("string")), "ts", "id").df.collect()


def test_panel_selection(spark):
    p = simulated(spark, 3, 10, 2)
    assert p.df.count() == 30 and p.numeric == ["var_1", "var_2"]
    assert p.sel("2020-01-03").df.count() == 3 and p.sel(["2020-01-03", "2020-01-04"]).df.count() == 6
    assert p.sel(slice("2020-01-02", "2020-01-04")).df.count() == 9
    with pytest.raises(KeyError):
        p.sel("2021-01-01", strict=True)
    assert p.shift(2).df.where("var_1 is null").count() == 6
    assert p.rolling(3).mean().df.count() == p.rolling(3).std().df.count() == 30
    assert p.rolling(3, ["var_1"]).reduce("rma").df.columns == p.df.columns


def test_filters(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "b")], "x int, s string")
    count = lambda f: filters.apply(df, f).count()
    assert count({"x__ne": 1}) == 2 and count({"x__nin": [1]}) == 2 and count({"x__in": [1, 2]}) == 2
    assert count({"x": 1}) == 1 and count({"x__range": (1, 2)}) == 2 and count(None) == 3
    with pytest.warns(UserWarning):
        assert count({"date__gte": 1}) == 3
    for bad in ({"x__like": 1}, [{"type": "no"}], [{"type": "equality_filter", "column": "x", "value": None}], [{"type": "range_filter", "column": "x"}]):
        with pytest.raises(ValueError):
            count(bad)


def stamp(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("time", F.col("time").cast("timestamp_ntz"))


def test_as_of_limit_and_offset(spark):
    left = Panel(stamp(spark, [("a", f"2020-{m:02d}-01", float(m)) for m in range(1, 8)], "asset string, time string, l double"))
    right = Panel(stamp(spark, [("a", "2020-02-01", 20.0), ("a", "2020-05-15", 55.0), ("z", "2020-01-01", 1.0)], "asset string, time string, r double"))
    get = lambda **k: [x.r for x in joins.merge(left, right, joins.MergeSpec(**k)).df.orderBy("time").collect()]
    assert get() == [None, 20, 20, 20, 20, 55, 55]
    assert get(limit=2) == [None, 20, 20, None, None, 55, 55]
    assert get(alignment="bfill") == [20, 20, 55, 55, 55, None, None]
    assert get(alignment="nearest") == [20, 20, 20, 55, 55, 55, 55]
    assert get(offset_months=2) == [None, None, None, 20, 20, 20, 20]
    assert joins.merge(left, right, joins.MergeSpec("exact", "outer")).df.count() == 9
    numbers = Panel(right.df.withColumn("asset", F.lit(1)))
    assert joins.merge(Panel(left.df.withColumn("asset", F.lit("1.0"))), numbers).df.where("r = 20").count() == 4
    with pytest.raises(ValueError):
        joins.merge_all(left, {}, [{"source": "x"}])


def test_scoped_sort(spark):
    df = stamp(spark, [(i, "2020-01-01", float(10 * (i + 1)), i < 5) for i in range(10)], "asset int, time string, s double, ok boolean")
    got = [r.s_port for r in processors.CrossSectionalSort("s", 2, "ok").transform(processors.View(Panel(df))).panel.df.orderBy("asset").collect()]
    assert got == [0, 0, 1, 1, 1, 1, 1, 1, 1, 1]  # a value at the break point goes up
    thirds = [r.s_port for r in processors.CrossSectionalSort("s", 3, None, [0.3, 0.7]).transform(processors.View(Panel(df))).panel.df.orderBy("asset").collect()]
    assert (thirds[0], thirds[4], thirds[9]) == (0, 1, 2)
    none = processors.CrossSectionalSort("s", 2, "ok").transform(processors.View(Panel(df.withColumn("ok", F.lit(None).cast("boolean"))))).panel.df
    assert none.where("s_port is not null").count() == 0
    with pytest.raises(ValueError):
        processors.CrossSectionalSort("s", 3, None, [0.7, 0.3]).transform(processors.View(Panel(df)))


def test_portfolios_and_spread(spark):
    df = stamp(spark, [(i, "2020-01-01", float(i % 2), float(i % 3), i / 10, float(i)) for i in range(12)], "asset int, time string, g double, h double, ret double, w double")
    view = processors.PortfolioReturns(["g", "h"], "ret", "w", dense=True).transform(processors.View(Panel(df)))
    got = {(r.g_dim, r.h_dim): r.value for r in view.frames["port_ret_g_h"].collect()}
    assert len(got) == 6
    for (g, h), v in got.items():
        own = [i for i in range(12) if i % 2 == g and i % 3 == h]
        assert v == pytest.approx(sum(i * i / 10 for i in own) / sum(own))
    spread = processors.FactorSpread("port_ret_g_h", {"S": {"long": {"g_dim": 0}, "short": {"g_dim": 1}, "average_over": "h_dim"}}).transform(view).frames["factors"].first()
    assert spread.S == pytest.approx(np.mean([v for k, v in got.items() if k[0] == 0]) - np.mean([v for k, v in got.items() if k[0] == 1]))
    with pytest.raises(ValueError):
        processors.FactorSpread("none", {}).transform(view)


def test_handler_views(spark):
    p = simulated(spark, 2, 20, 2)
    learn, infer = processors.AssetZScore(["var_1"]), processors.ForwardFill(["var_2"])
    handler = processors.DataHandler(p, processors.HandlerConfig(learn=[learn], infer=[infer], feature_cols=["var_1"]))
    assert handler.view("raw").panel.df is p.df
    z = handler.view("learn").panel.df.groupBy("asset").agg(F.avg("var_1_csz").alias("m"), F.stddev_pop("var_1_csz").alias("s")).first()
    assert abs(z.m) < 1e-6 and abs(z.s - 1) < 1e-6
    assert handler.fetch("infer", "features").columns == ["asset", "time", "var_1"]
    _, x, y = handler.to_arrays(p, ["var_1"], "var_2")
    assert x.shape == (40, 1) and y.shape == (40,)
    append = processors.DataHandler(p, processors.HandlerConfig(learn=[learn], infer=[infer], mode=processors.PipelineMode.APPEND))
    assert "var_1_csz" in append.view("infer").panel.df.columns
    with pytest.raises(ValueError):
        processors.create_processor({"type": "nope"})
    with pytest.raises(ValueError):
        processors.create_processor({"type": "sort", "wrong": 1})


def test_company_equity(spark):
    df = stamp(spark, [(1, "2020-01-01", -10.0, 5.0, 7), (2, "2020-01-01", 10.0, 2.0, 7), (3, "2020-01-01", 1.0, 1.0, None)], "asset int, time string, prc double, shrout double, permco int")
    got = [r.me for r in processors.apply_transforms(Panel(df), ["fix_mke"]).df.orderBy("asset").collect()]
    assert got == [70, 20, 1]


CONFIG = SegmentConfig(datetime(2020, 1, 1), datetime(2021, 12, 31), timedelta(days=180), timedelta(days=30), timedelta(days=30), timedelta(days=7))


def test_plan():
    plan = make_plan(CONFIG)
    assert all(s.infer_start - s.train_end == timedelta(days=7) and s.infer_start <= CONFIG.end for s in plan)
    assert not plan.validate() and not plan.overlapping()
    assert plan.total_train() == timedelta(days=180) * len(plan)
    more = expand_plan(plan, CONFIG, start=datetime(2019, 11, 1), end=datetime(2022, 3, 1))
    assert len(more) > len(plan) and not more.validate()
    for bad in (dict(start=CONFIG.end), dict(train=timedelta(0)), dict(gap=timedelta(days=-1))):
        with pytest.raises(ValueError):
            SegmentConfig(**{**CONFIG.__dict__, **bad})
    with pytest.raises(ValueError):
        Segment(datetime(2020, 2, 1), datetime(2020, 1, 1), datetime(2020, 2, 1), datetime(2020, 3, 1))


def test_clip_and_optimize(spark):
    p = simulated(spark, 2, 300, 1)
    clipped = make_plan(SegmentConfig(**{**CONFIG.__dict__, "clip": True}), p)
    assert max(s.infer_end for s in clipped) <= datetime(2020, 10, 26)
    assert 0 < len(optimize_plan(make_plan(CONFIG), p, 100, 10)) < len(make_plan(CONFIG))


@pytest.mark.parametrize("name", list(MODELS))
def test_models_learn(name):
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 2))
    y = (x[:, 0] > 0).astype(float) if name == "LogisticRegression" or name.endswith(("Classifier", "SVC")) else 2 * x[:, 0] - x[:, 1] + 3
    model = create_model(name, {"alpha": 0.01} if name in ("Lasso", "ElasticNet", "Ridge") else None)
    model.fit(x, y)
    assert np.corrcoef(model.predict(x), y)[0, 1] > 0.75
    other = create_model(name)
    other.load_state(model.get_state())
    assert np.allclose(other.predict(x), model.predict(x))


def test_linear_runner_equals_adapter(spark):
    p = simulated(spark, 4, 200, 3)
    p = p.on(p.df.withColumn("y", F.when(F.rand(1) > 0.1, F.col("var_1") * 2 - F.col("var_2") + 0.1 * F.col("var_3"))).cache())
    plan = make_plan(SegmentConfig(datetime(2020, 1, 1), datetime(2020, 6, 30), timedelta(days=40), timedelta(days=30), timedelta(days=20)))
    for model, params, adapter in (("LinearRegression", {}, lambda: create_model("LinearRegression")), ("Ridge", {"alpha": 2.0}, lambda: create_model("Ridge", {"alpha": 2.0}))):
        a = ModelRunner(model, ["var_1", "var_2"], "y", params).run(p, plan).orderBy("asset", "time").toPandas()
        b = ModelRunner(adapter, ["var_1", "var_2"], "y").run(p, plan).orderBy("asset", "time").toPandas()
        assert len(a) == len(b) > 300 and np.allclose(a["pred"], b["pred"])
    first = ModelRunner("LinearRegression", ["var_1"], "y", overlap_policy="first").run(p, plan)
    assert first.count() == len(a)


BARS = [("A", i, 10.0 + i, 10.5 + i) for i in range(6)] + [("B", i, 20.0 - i, 19.5 - i) for i in range(6)]


def bars(spark):
    rows = [(a, f"2020-01-{i + 1:02d}", o, max(o, c), min(o, c), c, 1.0) for a, i, o, c in BARS]
    return Panel(stamp(spark, rows, "asset string, time string, open double, high double, low double, close double, volume double"))


class BuyOnce(backtest.Strategy):
    def next(self, market, assets, state):
        return [backtest.MarketOrder("A", backtest.Direction.BUY, 1000.0)] if state.bar == 0 else []


def test_backtest_fills(spark):
    got = backtest.run(bars(spark), {"s": BuyOnce()}, cash=110.0, commissions=0.1, check=True).orderBy("time").collect()
    n = 110 / (11 * 1.1)  # cut to the cash, at the second bar's open
    assert [r.value for r in got] == pytest.approx([n * (10.5 + i) for i in range(1, 6)] + [n * 15.5])
    assert got[0].cash == pytest.approx(0) and got[0].fill_time == got[1].time and got[-1].fill_time is None
    grid = backtest.run(bars(spark), {"s": BuyOnce(), "none": backtest.NoTrades()}, commissions=[0.0, 0.1])
    assert grid.groupBy("run", "commission").count().count() == 4


def test_orders():
    order = backtest.MarketOrder("A", backtest.Direction.SELL, 2.0)
    assert order.price == -1
    state = backtest.State(0.0)
    assert backtest.fill([order], state, {"A": float("nan")}, 0.0) == [order] and order.status is backtest.Status.PENDING
    assert backtest.fill([order], state, {"A": 5.0}, 0.1) == [] and (state.cash, state.positions["A"]) == (9.0, -2.0)
    poor = backtest.MarketOrder("A", backtest.Direction.BUY, 1.0)
    backtest.fill([poor], backtest.State(0.0), {"A": 5.0}, 0.0)
    assert poor.status is backtest.Status.REJECTED
    with pytest.raises(ValueError):
        backtest.MarketOrder("A", backtest.Direction.BUY, 0)


def test_metrics(spark):
    value = [100.0, 110.0, 99.0, 120.0]
    path = stamp(spark, [("r", f"2020-01-{i + 1:02d}", v) for i, v in enumerate(value)], "run string, time string, value double")
    got = backtest.evaluate(path, ["run"]).first()
    assert got.profit_factor == pytest.approx(31 / 11) and got.max_drawdown == pytest.approx(-0.1)
    assert got.ulcer_index == pytest.approx(math.sqrt(100 / 4))
    change = np.array([0.1, -0.1, 120 / 99 - 1]) - (1.01 ** (1 / 252) - 1)
    assert got.sharpe == pytest.approx(change.mean() / change.std(ddof=1) * math.sqrt(252)) and got.martin_ratio == pytest.approx(change.mean() / got.ulcer_index)
    flat = backtest.evaluate(path.withColumn("value", F.lit(1.0)), ["run"]).first()
    assert (flat.profit_factor, flat.sharpe, flat.martin_ratio, flat.max_drawdown) == (1, 0, 0, 0)
    assert backtest.log_returns(path, ["run"]).orderBy(F.desc("time")).first().cumulative_log_return == pytest.approx(math.log(1.2))


SPEC = """
name: demo
time_range: {start: "2020-01-01", end: "2020-12-31"}
data:
  prices: {provider: files, dataset: bars, frequency: daily, path: PATH, schema: {time_var: date, identifier_var: sym}, filters: {sym__ne: ZZZ}}
features:
  operations:
    - {name: second, depends_on: [first], formulas: {spread: {expression: "$close - $sma_ww3"}}}
    - {name: first, formulas: {sma: [{window: 3}], rsi: [{window: 5}]}}
preprocessing:
  shared: [{type: per_asset_ffill, vars: [close]}]
  learn: [{type: cs_zscore, vars: [close, sma_ww3], out_suffix: _norm}]
model:
  type: LinearRegression
  features: [sma_ww3_norm]
  target: close
  walk_forward: {train_span_hours: 240, infer_span_hours: 48, step_hours: 48}
  adapter_params: {output_var: close_pred}
"""


@pytest.fixture()
def spec(spark, tmp_path):
    days = spark.range(60).selectExpr("explode(array('AAA', 'BBB', 'ZZZ')) as sym", "date_add(date'2020-01-01', cast(id as int)) as date", "100 + id * ascii(sym) % 17 as close", "1.0 as volume")
    days.write.parquet(str(tmp_path / "bars.parquet"))
    (tmp_path / "spec.yaml").write_text(SPEC.replace("PATH", str(tmp_path / "bars.parquet")))
    return tmp_path / "spec.yaml"


def test_spec_runs_and_is_cached(spark, spec, tmp_path):
    cache = Cache(spark, str(tmp_path / "cache"))
    first = PipelineExecutor(spark, cache=cache).execute(spec)
    assert {"sma_ww3", "rsi_ww5", "spread", "sma_ww3_norm"} <= set(first.final.df.columns)
    assert first.final.df.count() == 120 and first.predictions.count() > 50 and cache.misses == 5
    again = PipelineExecutor(spark, cache=cache).execute(spec)
    assert cache.hits == 5 and again.keys == first.keys
    assert again.predictions.exceptAll(first.predictions).count() == 0
    gone = cache.invalidate(first.keys["features:first"])
    assert set(gone) == {first.keys[k] for k in ("features:first", "features:second", "preprocessing", "model")}
    assert cache.stats()["entries"] == {"l2_postprocessed": 1}
    plain = PipelineExecutor(spark).execute(spec)
    assert plain.final.df.count() == 120


def test_spec_checks(spec, tmp_path):
    good = PipelineSpec.load(spec)
    assert [o.name for o in good.order()] == ["first", "second"]
    good.save(tmp_path / "copy.yaml")
    assert PipelineSpec.load(tmp_path / "copy.yaml") == good
    import yaml

    raw = yaml.safe_load(spec.read_text())
    loop = {"operations": [{"name": "a", "depends_on": ["b"]}, {"name": "b", "depends_on": ["a"]}]}
    for change in ({"time_range": {"start": "2021-01-01", "end": "2020-01-01"}}, {"time_range": {"start": "x", "end": "y"}}, {"features": loop}, {"merges": [{"source": "none"}]}, {"model": {"type": "x"}}, {"features": {"operations": [{"name": "a", "depends_on": ["c"]}]}}):
        with pytest.raises(SpecError):
            PipelineSpec.parse({**raw, **change})


def test_cache_keys():
    a = content_key(Stage.L3_FEATURES, {"x": 1, "y": 2}, ["p", "q"])
    assert a == content_key(Stage.L3_FEATURES, {"y": 2, "x": 1}, ["q", "p"]) and len(a) == 16
    assert a != content_key(Stage.L4_PREPROCESSED, {"x": 1, "y": 2}, ["p", "q"])
    assert [s.level for s in Stage] == [1, 2, 3, 4, 5]


def test_sources(spark, tmp_path):
    (tmp_path / "BTC.csv").write_text("datetime,Open,Close\n2020-01-01 00:00:00,1,2\n2020-01-01 01:00:00,x,4\n")
    (tmp_path / "ETH.csv").write_text("datetime,Open,Close\n2020-01-01 00:00:00,5,6\n")
    source = SourceBuilder("2020-01-01", "2020-12-31").add("c", "crypto", "spot/any", path=str(tmp_path), frequency="H", schema={"time_var": "date"}).build()["c"]
    got = {(r.asset, r.open, r.close) for r in DataManager(spark).load(source).df.collect()}
    assert got == {("BTC", 1.0, 2.0), ("BTC", None, 4.0), ("ETH", 5.0, 6.0)}
    assert load_sources(builtin("equity_standard"))["equity_prices"].filters["exchcd__in"] == [1, 2, 3]
    for f in (lambda: builtin("none"), lambda: get_provider("none"), lambda: get_provider("crypto").loaders["none"]):
        with pytest.raises(KeyError):
            f()


def test_fundamentals_are_linked(spark, tmp_path):
    spark.sql("select 'g1' as gvkey, timestamp_ntz'2019-12-31' as datadate, 5.0D as seq union all select 'g2', timestamp_ntz'2019-12-31', 6.0D").write.parquet(str(tmp_path / "f.parquet"))
    spark.sql("select 'g1' as gvkey, 77L as lpermno, timestamp_ntz'2015-01-01' as linkdt, cast(null as timestamp_ntz) as linkenddt, 'LC' as linktype, 'P' as linkprim union all select 'g2', 88L, timestamp_ntz'2015-01-01', timestamp_ntz'2019-12-31', 'LC', 'P'").write.parquet(str(tmp_path / "l.parquet"))
    source = SourceBuilder("2019-01-01", "2020-12-31").add("f", "wrds", "compustat", path=str(tmp_path / "f.parquet"), frequency="annual", identifier="permno", options={"link": str(tmp_path / "l.parquet")}).build()["f"]
    assert [(r.asset, r.seq) for r in DataManager(spark).load(source).df.collect()] == [(77, 5.0)]


def test_streams(spark, tmp_path):
    from panelith.streaming.live import bars as stream_bars
    from panelith.streaming.live import exponential_mean

    rows = [("a", f"2020-01-01 00:{i:02d}:00", float(i)) for i in range(10)]
    df = stamp(spark, rows, "asset string, time string, v double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, made, mode in (("ema_out", exponential_mean(stream, "asset", "time", "v", 3), "append"), ("bar_out", stream_bars(stream, "asset", "time", "v", "5 minutes"), "complete")):
        made.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    from panelith.functions.manager import with_formula

    want = [r.value for r in with_formula(df, "ema($v, 3)", "value").orderBy("time").collect()]
    got = [r.value for r in spark.table("ema_out").orderBy("time").collect()]
    assert got[2:] == pytest.approx(want[2:]) and got[:2] == [None, None]
    assert [(r.open, r.close, r.volume) for r in spark.table("bar_out").orderBy("time").collect()] == [(0, 4, 5), (5, 9, 5)]


def test_windows_do_not_depend_on_the_time_zone(spark):
    from panelith.plans.walkforward import windows

    p = simulated(spark, 1, 24 * 400, 1, "hour", start="2020-01-01")
    plan = make_plan(SegmentConfig(datetime(2020, 1, 1), datetime(2020, 12, 31), timedelta(days=20), timedelta(hours=30), timedelta(days=5)))
    count = lambda: [r["count"] for r in windows(p, plan, "infer").groupBy("segment").count().orderBy("segment").collect()]
    want = count()
    assert set(want) == {30}
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert count() == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert windows(p, plan, "train", "left").where("segment = 0").count() == 480 and windows(p, plan, "train").where("segment = 0").count() == 481


def test_slots_follow_short_windows(spark, monkeypatch):
    """A segment meets a handful of slots however short its windows are."""
    from panelith.plans import walkforward

    p = simulated(spark, 1, 48, 1, "hour", start="2020-01-01")
    plan = make_plan(SegmentConfig(datetime(2020, 1, 1), datetime(2020, 1, 2), timedelta(minutes=1), timedelta(minutes=1), timedelta(minutes=60)))
    rows = []
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, schema, f=type(spark).createDataFrame: rows.append(len(data)) or f(self, data, schema))
    got = walkforward.windows(p, plan, "train")
    assert rows[0] <= 6 * len(plan) and got.count() == len(plan)


def test_calendar_functions_in_segments(spark):
    p = simulated(spark, 2, 200, 1)
    handler = processors.DataHandler(p, processors.HandlerConfig(learn=[processors.FormulaEval(expressions={"m": "month_coord($var_1)", "r": "cs_rank($var_1)", "e": "ema($var_1, 3)"})]))
    plan = make_plan(SegmentConfig(datetime(2020, 1, 1), datetime(2020, 6, 1), timedelta(days=60), timedelta(days=20), timedelta(days=20)))
    from panelith.plans.walkforward import WalkForwardRunner

    out = WalkForwardRunner(handler, plan).run()
    rows = out.df.collect()
    assert rows and out.df.columns[:2] == ["asset", "time"] and all(r.m == r.time.month and r.r in (0.0, 1.0) and r.e is not None for r in rows)


def test_csv_files_are_read_by_their_own_headers(spark, tmp_path):
    (tmp_path / "A.csv").write_text("date,open,close\n2020-01-01,1,2\n")
    (tmp_path / "B.csv").write_text("date,Close,Open,volume\n2020-01-01,20,10,5\n")
    (tmp_path / "C+ 1.csv").write_text("datetime,open\n2020-01-01,100\n2020-01-02,no number\n")
    (tmp_path / "D.csv").write_text("")
    from panelith.sources.readers import SourceConfig, market_csv

    config = SourceConfig("crypto", "x", str(tmp_path))
    got = sorted((r.identifier, str(r.date)[:10], r.open, r.close, r.volume) for r in market_csv(spark, config).collect())
    assert got == [("A", "2020-01-01", 1.0, 2.0, None), ("B", "2020-01-01", 10.0, 20.0, 5.0), ("C+ 1", "2020-01-01", 100.0, None, None), ("C+ 1", "2020-01-02", None, None, None)]
    few = market_csv(spark, SourceConfig("crypto", "x", str(tmp_path), symbols=["B"], columns=["close"]))
    assert few.columns == ["date", "identifier", "close"] and [r.close for r in few.collect()] == [20.0]


def test_mixed_keys_keep_fractions_apart(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    right = spark.createDataFrame([("1",), ("1.0",), ("1.5",), ("x",), (None,)], "k string")
    a, b = joins.same_key(left, right, "k")
    keys = [r.k for r in b.collect()]
    assert sorted(r.k for r in a.collect() if r.k is not None) == [1, 2]
    assert keys[0] == keys[1] == 1 and len(set(keys)) == 4 and keys[4] is None


def test_arrays_have_a_bound(spark):
    handler = processors.DataHandler(simulated(spark, 2, 20, 1))
    assert len(handler.to_arrays(handler.base, ["var_1"])[1]) == 40
    with pytest.raises(ValueError, match="more than 30"):
        handler.to_arrays(handler.base, ["var_1"], max_rows=30)


def test_changed_inputs_and_formulas_are_no_hits(spark, spec, tmp_path):
    from panelith.functions.manager import FormulaManager

    cache = Cache(spark, str(tmp_path / "cache"))
    first = PipelineExecutor(spark, cache=cache).execute(spec)
    changed = FormulaManager()
    changed.formulas["rsi"] = {**changed.formulas["rsi"], "formula": "gain($price, 1)"}
    other = PipelineExecutor(spark, cache=cache, formulas=changed).execute(spec)
    assert other.keys["data:prices"] == first.keys["data:prices"] and other.keys["features:first"] != first.keys["features:first"]
    one = spark.read.parquet(str(tmp_path / "bars.parquet")).where("sym = 'AAA'").limit(1).withColumn("date", F.lit(datetime(2020, 5, 1).date()))
    spark.createDataFrame(one.collect(), one.schema).write.mode("append").parquet(str(tmp_path / "bars.parquet"))
    third = PipelineExecutor(spark, cache=cache).execute(spec)
    assert third.keys["data:prices"] != first.keys["data:prices"] and third.sources["prices"].df.count() == first.sources["prices"].df.count() + 1


def test_sources_are_stored_in_two_levels(spark, spec, tmp_path):
    cache = Cache(spark, str(tmp_path / "levels"))
    raw = {"provider": "files", "dataset": "bars", "frequency": "daily", "path": str(tmp_path / "bars.parquet"), "start_date": "2020-01-01", "end_date": "2020-02-01", "schema": {"time_var": "date", "identifier_var": "sym"}}
    one = DataManager(spark, cache).load(raw).df
    assert cache.stats() == {"hits": 0, "misses": 2, "entries": {"l1_raw": 1, "l2_postprocessed": 1}}
    assert DataManager(spark, cache).load(raw).df.exceptAll(one).count() == 0 and cache.hits == 2
    DataManager(spark, cache).load({**raw, "filters": {"sym__ne": "ZZZ"}})
    assert cache.stats()["entries"] == {"l1_raw": 1, "l2_postprocessed": 2}
    DataManager(spark, cache).load({**raw, "end_date": "2020-01-15"})
    assert cache.stats()["entries"] == {"l1_raw": 2, "l2_postprocessed": 3}


def test_classes_neighbours_and_margins():
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 2))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0.2).astype(float)
    for name in ("DecisionTreeClassifier", "RandomForestClassifier", "GradientBoostingClassifier", "KNeighborsClassifier", "LinearSVC", "LogisticRegression"):
        model = create_model(name)
        model.fit(x[:300], y[:300])
        p = model.predict(x[300:])
        assert p.min() >= -1e-9 and p.max() <= 1 + 1e-9 and ((p > 0.5) == y[300:]).mean() > 0.85, name
    line = create_model("LinearSVR")
    line.fit(x, 3 * x[:, 0] - x[:, 1] + 2)
    assert line.predict(x) == pytest.approx(3 * x[:, 0] - x[:, 1] + 2, abs=0.1)
    near = create_model("KNeighborsRegressor", {"n_neighbors": 2})
    near.fit(np.array([[0.0], [1.0], [2.0], [10.0]]), np.array([0.0, 10.0, 20.0, 30.0]))
    assert near.predict(np.array([[0.4], [1.5], [9.0]])).tolist() == [5.0, 15.0, 25.0]


def test_foreign_estimators(spark):
    from panelith.plans.models import Foreign

    class Mean:
        def fit(self, x, y, sample_weight=None):
            self.m = np.average(y, weights=sample_weight)

        def predict(self, x):
            return np.full(len(x), self.m)

        def predict_proba(self, x):
            return np.column_stack([np.full(len(x), 1 - self.m), np.full(len(x), self.m)])

    x, y = np.zeros((4, 1)), np.array([0.0, 0, 0, 1])
    for probability, want in ((None, 0.25), (True, 0.25), (0, 0.75), (1, 0.25)):
        model = Foreign(Mean, probability)
        model.fit(x, y)
        assert model.predict(x).tolist() == [want] * 4
    model = Foreign(Mean, 2)
    model.fit(x, y, np.array([0, 0, 1.0, 1]))
    with pytest.raises(ValueError, match="no column 2"):
        model.predict(x)
    p = simulated(spark, 2, 60, 1)
    plan = make_plan(SegmentConfig(datetime(2020, 1, 1), datetime(2020, 2, 20), timedelta(days=20), timedelta(days=10), timedelta(days=10)))
    assert ModelRunner(lambda: Foreign(Mean), ["var_1"], "var_1").run(p, plan).where("pred is not null").count() > 20


@pytest.mark.parametrize("weight", [None, "w"])
def test_segments_are_no_python_groups(spark, weight):
    """The adapter's tree, ties and weights too, from rows that come by batches and not as one group."""
    r = np.random.default_rng(4)
    start = datetime(2020, 1, 1)
    rows = [(k, start + timedelta(days=d), *map(float, r.integers(0, 9, 3)), float(r.integers(1, 4)) if r.random() > 0.1 else None, float(r.integers(0, 5))) for k in range(6) for d in range(80)]
    p = Panel(spark.createDataFrame(rows, "f long, time timestamp_ntz, a double, b double, c double, y double, w double").withColumn("w", F.col("w") + 1), "f", "time")
    plan = make_plan(SegmentConfig(start, start + timedelta(days=79), timedelta(days=20), timedelta(days=20), timedelta(days=15)))
    for depth, leaf in ((0, 5), (2, 5), (4, 3)):
        params = {"max_depth": depth, "min_leaf": leaf}
        got = ModelRunner("DecisionTreeRegressor", ["a", "b", "c"], "y", params, weight=weight).segments(p, plan)
        assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
        want, inside = {}, lambda t, a, z: [x for x in rows if a <= x[1] <= z]
        for i, s in enumerate(plan):
            train, infer = [x for x in inside(rows, s.train_start, s.train_end) if x[5] is not None], inside(rows, s.infer_start, s.infer_end)
            tree = create_model("DecisionTreeRegressor", params)
            tree.fit(np.array([x[2:5] for x in train]), np.array([x[5] for x in train]), np.array([x[6] + 1 for x in train]) if weight else None)
            want |= {(i, *x[:2]): v for x, v in zip(infer, tree.predict(np.array([x[2:5] for x in infer])).tolist())} if infer else {}
        got = {(x.segment, x.f, x.time): x.pred for x in got.collect()}
        assert len(want) > 300 and got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)
    hollow = p.on(p.df.withColumn("y", F.when(F.col("time") > start + timedelta(days=40), F.col("y"))))
    assert 0 < ModelRunner("DecisionTreeRegressor", ["a"], "y", {"max_depth": 2}).segments(hollow, plan).where("pred is null").count()


def test_backtests_have_a_bound(spark):
    p = simulated(spark, 2, 20, 1)
    bars = p.on(p.df.selectExpr("asset", "time", "1.0 as open", "1.0 as high", "1.0 as low", "1.0 as close", "1.0 as volume"))
    assert backtest.run(bars, {"n": backtest.NoTrades()}).count() == 20
    with pytest.raises(ValueError, match="more than 30"):
        backtest.run(bars, {"n": backtest.NoTrades()}, max_bars=30)
