"""The driver's queries for the panel operators, each with the same in SQL.

Panels derived from the driver's tables (see FIXTURES.md): monthly suppliers (PA), user events
(PB), hourly bars (PC), annual fundamentals (PD).  Values are rounded where engines may differ in
the last bits; break points are compared after rounding for the same reason.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.compiler import compute
from ..functions.dsl import Call, Data, parse
from ..functions.kernels import AGGREGATES, Axis
from ..functions.manager import FormulaManager, with_formula
from ..operators import backtest, filters, joins, processors
from ..operators.panel import Panel, from_table, sas_date, simulated, truncated
from .models import ModelRunner, information_coefficient
from ..sources import readers
from ..sources.readers import DataManager, SourceConfig
from .walkforward import SegmentConfig, SegmentPlan, WalkForwardRunner, expand_plan, make_plan, optimize_plan, window_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


# ---- panels ------------------------------------------------------------------------------------


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pa(spark: SparkSession, d: str) -> Panel:
    li = table(spark, d, "lineitem")
    df = li.groupBy(F.col("l_suppkey").alias("asset"), truncated(F.col("l_shipdate"), "month").alias("time")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("me"), F.sum("l_quantity").alias("vol"), F.round(F.avg("l_discount") - F.avg("l_tax"), 9).alias("ret")
    )
    odd = (F.col("asset") + F.month("time")) % 7 == 0
    return Panel(df.withColumns({"exchcd": F.col("asset") % 3 + 1, "x": F.when(~odd, F.col("me")), "bm": F.try_divide(F.col("vol"), F.col("me")) * 1000, "shrcd": F.col("asset") % 4 + 9}))


_PA0 = """pa0 AS (SELECT l_suppkey AS asset, date_trunc('month', l_shipdate) AS time, round(sum(l_extendedprice), 2) AS me, sum(l_quantity) AS vol,
  round(avg(l_discount) - avg(l_tax), 9) AS ret FROM lineitem GROUP BY 1, 2)"""
_PA = f"""WITH {_PA0}, pa AS (SELECT *, asset % 3 + 1 AS exchcd, CASE WHEN (asset + month(time)) % 7 <> 0 THEN me END AS x, vol / me * 1000 AS bm, asset % 4 + 9 AS shrcd,
  row_number() OVER (PARTITION BY asset ORDER BY time) AS rn FROM pa0)"""


def pb(spark: SparkSession, d: str) -> Panel:
    return Panel(table(spark, d, "events").groupBy(F.col("user_id").alias("asset"), F.col("ts").alias("time")).agg(F.max("value").alias("x")))


_PB = """WITH RECURSIVE pb AS (SELECT asset, time, x, row_number() OVER (PARTITION BY asset ORDER BY time) AS rn, count(*) OVER (PARTITION BY asset) AS n
  FROM (SELECT user_id AS asset, ts AS time, max(value) AS x FROM events GROUP BY 1, 2))"""


def pc(spark: SparkSession, d: str) -> Panel:
    ev = table(spark, d, "events").withColumn("k", F.struct("ts", "event_id"))
    df = ev.groupBy(F.col("event_type").alias("asset"), truncated(F.col("ts"), "hour").alias("time")).agg(
        F.min_by("value", "k").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "k").alias("close"), F.count("value").cast("double").alias("volume")
    )
    return Panel(df)


def pd_(spark: SparkSession, d: str) -> Panel:
    df = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("asset"), F.date_trunc("year", "l_shipdate").cast("timestamp_ntz").alias("time")).agg(F.round(F.sum("l_extendedprice"), 2).alias("seq"), F.sum("l_quantity").alias("txditc"))
    return Panel(df.withColumn("pstk", F.when(F.year("time") % 2 == 0, F.col("txditc") / 2)))


_PD = """pd AS (SELECT l_suppkey AS asset, date_trunc('year', l_shipdate) AS time, round(sum(l_extendedprice), 2) AS seq, sum(l_quantity) AS txditc FROM lineitem GROUP BY 1, 2)"""

_T = "strftime(time, '%Y-%m-%d %H:%M:%S') AS time"


def _nudge(digits: int) -> float:
    """Added before rounding: decimals that end in a 5 would be rounded up or down by their last bit."""
    return 1.7 * 10.0 ** -(digits + 3)


def shown(df: DataFrame, *values: str, digits: int = 6, keys: tuple[str, ...] = ("asset", "time")) -> DataFrame:
    kinds = dict(df.dtypes)
    out: list[Column] = []
    for k in keys:
        out.append(F.date_format(k, "yyyy-MM-dd HH:mm:ss").alias(k) if kinds[k].startswith("timestamp") else F.col(k))
    for v in values:
        number = kinds[v] in ("double", "float", "int", "bigint", "boolean")
        out.append((F.round(F.col(v).cast("double") + _nudge(digits), digits) + F.lit(0.0)).alias(v) if number else F.col(v))
    return df.select(*out)


def _r(expr: str, name: str = "value", digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE) + {_nudge(digits)!r}::DOUBLE, {digits}) + 0.0::DOUBLE AS {name}"


# ---- sources and filters -----------------------------------------------------------------------

for _unit in ("month", "year", "day", "hour"):

    def _from_table(spark, d, unit=_unit):
        t = table(spark, d, "events").select("event_id", "ts", "user_id", "value")
        return shown(from_table(t, "ts", "user_id", ["value"], unit, order=["event_id"]).df, "value")

    query(f"src_from_table_{_unit}", f"SELECT user_id AS asset, strftime(date_trunc('{_unit}', ts), '%Y-%m-%d %H:%M:%S') AS time, round(arg_max(value, (ts, event_id)) + 1.7e-09::DOUBLE, 6) + 0.0::DOUBLE AS value FROM events GROUP BY 1, 2")(_from_table)

_ORDERS = "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS price, o_orderstatus AS status, o_orderdate AS date FROM orders)"


def _orders(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("price"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("date"))


_FILTERS = {
    "eq": ({"type": "equality_filter", "column": "status", "value": "F"}, "status = 'F'"),
    "ne": ({"type": "comparison_filter", "column": "price", "operator": "!=", "value": 1000.0}, "price IS DISTINCT FROM 1000.0"),
    "gt": ({"type": "comparison_filter", "column": "price", "operator": ">", "value": 50000}, "price > 50000"),
    "gte": ({"type": "comparison_filter", "column": "price", "operator": ">=", "value": 50000}, "price >= 50000"),
    "lt": ({"type": "comparison_filter", "column": "price", "operator": "<", "value": 50000}, "price < 50000"),
    "lte": ({"type": "comparison_filter", "column": "price", "operator": "<=", "value": 50000}, "price <= 50000"),
    "in": ({"type": "in_filter", "column": "status", "values": ["F", "O"]}, "status IN ('F', 'O')"),
    "nin": ({"type": "not_in_filter", "column": "status", "values": ["F"]}, "status IS NULL OR status NOT IN ('F')"),
    "range": ({"type": "range_filter", "column": "price", "min_value": 20000, "max_value": 90000}, "price BETWEEN 20000 AND 90000"),
    "date": ({"type": "date_range_filter", "date_column": "date", "start_date": "1996-01-01", "end_date": "1997-06-30"}, "date BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-06-30'"),
}
for _name, (_spec, _where) in _FILTERS.items():
    query(f"filter_{_name}", f"{_ORDERS} SELECT o_orderkey, round(price + 1.7e-09::DOUBLE, 6) + 0.0::DOUBLE AS price, status FROM o WHERE {_where}")(
        lambda spark, d, spec=_spec: shown(filters.apply(_orders(spark, d), [spec]), "price", "status", keys=("o_orderkey",))
    )


@query("filter_django", f"{_ORDERS} SELECT o_orderkey, round(price + 1.7e-09::DOUBLE, 6) + 0.0::DOUBLE AS price, status FROM o WHERE price >= 20000 AND price < 200000 AND status IN ('F', 'O') AND o_orderkey <> 5")
def filter_django(spark, d):
    return shown(filters.apply(_orders(spark, d), {"price__gte": 20000, "price__lt": 200000, "status__in": ["F", "O"], "o_orderkey__ne": 5}), "price", "status", keys=("o_orderkey",))


@query("sel_point", f"{_PA} SELECT asset, {_T}, round(me + 1.7e-09::DOUBLE, 6) + 0.0::DOUBLE AS me FROM pa WHERE time = TIMESTAMP '1998-06-01'")
def sel_point(spark, d):
    return shown(pa(spark, d).sel("1998-06-01").df, "me")


@query("sel_slice", f"{_PA} SELECT asset, {_T}, round(me + 1.7e-09::DOUBLE, 6) + 0.0::DOUBLE AS me FROM pa WHERE time BETWEEN TIMESTAMP '1997-01-15' AND TIMESTAMP '1998-06-01'")
def sel_slice(spark, d):
    return shown(pa(spark, d).sel(slice("1997-01-15", "1998-06-01")).df, "me")


@query("dedupe_last", "SELECT user_id AS k, round(arg_max(value, (ts, event_id)) + 1.7e-09::DOUBLE, 6) + 0.0::DOUBLE AS value FROM events GROUP BY 1")
def dedupe_last(spark, d):
    e = table(spark, d, "events")
    return shown(joins.last_of(e, ["user_id"], ["value"], ["ts", "event_id"]).withColumnRenamed("user_id", "k"), "value", keys=("k",))


# ---- formulas on the monthly panel -------------------------------------------------------------


def _text(name: str, text: str, sql: str, parameters: dict | None = None, digits: int = 6) -> None:
    """A formula over PA against one SQL expression."""

    def run(spark, d):
        p = pa(spark, d)
        return shown(with_formula(p.df, text, "value", p.axis, parameters), "value", digits=digits)

    query(name, f"{_PA} SELECT asset, {_T}, {_r(sql, digits=digits)} FROM pa")(run)


_W = "OVER (PARTITION BY asset ORDER BY time)"
_S = "OVER (PARTITION BY time)"
_text("dsl_arith", "($me - 2 * $vol) / ($vol + 1) - -3", "(me - 2 * vol) / (vol + 1) + 3")
_text("dsl_pow", "2 ^ 3 ^ 2 + ($ret ^ 2) ^ 0.5", "512 + abs(ret)")
_text("dsl_alias", "$price / $k", "me / 12", {"price": "me", "k": 12})
_text("fold_const", "(2 + 3 * 4) * $vol - 6 / 4", "14 * vol - 1.5")
_text("div_by_zero", "$vol / ($exchcd - 1)", "vol / nullif(exchcd - 1, 0)")
_text("fn_sqrt", "sqrt($ret)", "CASE WHEN ret >= 0 THEN sqrt(ret) END")
_text("fn_abs", "abs($ret)", "abs(ret)")
_text("fn_log", "log($ret)", "CASE WHEN ret > 0 THEN ln(ret) END")
_text("fn_exp", "exp($ret)", "exp(ret)")
_text("fn_coalesce", "coalesce($x, $vol)", "coalesce(x, vol)")
_text("fn_where", "where(gt($x, 300000), $me, 0 - $me)", "CASE WHEN coalesce(x > 300000, false) THEN me ELSE -me END")
for _name, _op in {"gt": ">", "lt": "<", "ge": ">=", "le": "<=", "eq": "="}.items():
    _text(f"fn_{_name}", f"{_name}($x, 300000.25)", f"CAST(coalesce(x {_op} 300000.25, false) AS INT)")
_text("fn_nan_const", "coalesce(nan_const(), $vol)", "vol")
_text("gain", "gain($me)", f"greatest(coalesce(me - lag(me) {_W}, 0), 0)")
_text("loss", "loss($x)", f"greatest(coalesce(lag(coalesce(x, 0)) {_W} - coalesce(x, 0), 0), 0)")
for _label, _n in {"1": 1, "6": 6, "neg1": -1}.items():
    _lag = f"lag(x, {_n})" if _n > 0 else f"lead(x, {-_n})"
    _text(f"shift_{_label}", f"shift($x, {_n})", f"CASE WHEN x IS NOT NULL THEN {_lag} OVER (PARTITION BY asset, x IS NULL ORDER BY time) END")
_text("returns", "returns($me, 2)", f"me / nullif(lag(me, 2) {_W}, 0) - 1")
_text("ffill", "ffill($x)", "last_value(x IGNORE NULLS) OVER (PARTITION BY asset ORDER BY time ROWS UNBOUNDED PRECEDING)")
_text("month_coord", "month_coord($x)", "month(time)")
_text("cs_rank", "cs_rank($x)", "CASE WHEN x IS NOT NULL AND count(x) OVER (PARTITION BY time) > 1 THEN (row_number() OVER (PARTITION BY time, x IS NULL ORDER BY x, asset) - 1) / (count(x) OVER (PARTITION BY time) - 1) END")
_text("cs_quantile", "cs_quantile($x, 0.3)", f"quantile_cont(x, 0.3) {_S}", digits=4)
_text("cs_demean", "cs_demean($x)", f"x - avg(x) {_S}", digits=4)
_text("cs_zscore", "cs_zscore($ret)", f"(ret - avg(ret) {_S}) / nullif(stddev_pop(ret) {_S}, 0)", digits=5)
_text("assign_bucket_2", "assign_bucket($x, 300000.005)", "CASE WHEN x IS NOT NULL THEN CAST(x > 300000.005 AS INT) END")
_text("assign_bucket_3", "assign_bucket($x, 200000.005, 400000.005)", "CASE WHEN x IS NOT NULL THEN CAST(x > 200000.005 AS INT) + CAST(x > 400000.005 AS INT) END")
_text("assign_bucket_4", "assign_bucket($x, 100000.005, 200000.005, 400000.005)", "CASE WHEN x IS NOT NULL THEN CAST(x > 100000.005 AS INT) + CAST(x > 200000.005 AS INT) + CAST(x > 400000.005 AS INT) END")


def _rolling(name: str, call: str, w: int, sql: str, digits: int = 4) -> None:
    """A rolling function against SQL over its frame; the warm-up repeats the first full value."""
    frame = f"OVER (PARTITION BY asset ORDER BY time ROWS {w - 1} PRECEDING)"

    def run(spark, d):
        p = pa(spark, d)
        return shown(with_formula(p.df, call, "value", p.axis), "value", digits=digits)

    value = f"{_PA}, v AS (SELECT asset, time, rn, {sql.format(f=frame)} AS v FROM pa)"
    query(name, f"{value} SELECT asset, {_T}, {_r(f'CASE WHEN rn >= {w} THEN v ELSE max(CASE WHEN rn = {w} THEN v END) OVER (PARTITION BY asset) END', digits=digits)} FROM v")(run)


_rolling("roll_sma", "sma($x, 5)", 5, "avg(coalesce(x, 0)) {f}")
_rolling("roll_sum", "rolling_sum($x, 5)", 5, "sum(coalesce(x, 0)) {f}")
_rolling("roll_std", "rolling_std($vol, 5)", 5, "stddev_pop(vol) {f}")
_rolling("roll_median", "moving_median($x, 5)", 5, "quantile_cont(coalesce(x, 0), 0.5) {f}")
_rolling("roll_wma", "wma($x, 5)", 5, "(" + " + ".join(f"{5 - i} * coalesce(lag(x, {i}) {_W}, 0)" for i in range(5)) + ") / 15")
_rolling("roll_mode", "moving_mode($exchcd + month_coord($x) * 0, 3)", 3, "max(exchcd) {f}")


@query("roll_mode_values", f"""{_PA}, m AS (SELECT asset, time, rn, CAST(floor(vol / 100) AS DOUBLE) AS k FROM pa), w AS (
  SELECT a.asset, a.time, a.rn, b.k, count(*) AS n FROM m a JOIN m b ON a.asset = b.asset AND b.rn BETWEEN a.rn - 5 AND a.rn GROUP BY ALL), v AS (
  SELECT asset, time, rn, arg_max(k, (n, -k)) AS v FROM w GROUP BY ALL)
  SELECT asset, {_T}, {_r("CASE WHEN rn >= 6 THEN v ELSE max(CASE WHEN rn = 6 THEN v END) OVER (PARTITION BY asset) END")} FROM v""")
def roll_mode_values(spark, d):
    p = pa(spark, d)
    return shown(compute(p.df.withColumn("k", F.floor(F.col("vol") / 100).cast("double")), p.axis, {"value": Call("moving_mode", (Data("k"), parse("6")))}), "value")


# ---- aggregates --------------------------------------------------------------------------------

_DUCK = {"sum": "coalesce(sum(x), 0)", "mean": "avg(x)", "std": "stddev_pop(x)", "var": "var_pop(x)", "min": "min(x)", "max": "max(x)"}
for _name, _build in AGGREGATES.items():
    for _by in ("asset", "time"):
        _key = _T if _by == "time" else "asset"

        def _agg(spark, d, by=_by, build=_build):
            return shown(pa(spark, d).df.withColumn("x", F.col("x") / 1000).groupBy(by).agg(build("x").alias("value")), "value", keys=(by,), digits=4)

        query(f"agg_{_name}_{_by}", f"{_PA}, q AS (SELECT asset, time, x / 1000 AS x FROM pa), g AS (SELECT {_by}, {_DUCK[_name]} AS v FROM q GROUP BY 1) SELECT {_key}, {_r('v', digits=4)} FROM g")(_agg)


for _name, _build in AGGREGATES.items():
    query(f"agg_{_name}_all", f"{_PA}, q AS (SELECT x / 1000 AS x FROM pa) SELECT 'all' AS scope, {_r(_DUCK[_name], digits=3)} FROM q")(
        lambda spark, d, build=_build: shown(pa(spark, d).df.withColumn("x", F.col("x") / 1000).agg(build("x").alias("value")).withColumn("scope", F.lit("all")), "value", keys=("scope",), digits=3)
    )


@query("distinct_times", f"{_PA}, t AS (SELECT DISTINCT time FROM pa) SELECT {_T} FROM t")
def distinct_times(spark, d):
    return shown(pa(spark, d).df.select("time").distinct(), keys=("time",))


@query("ordinal", f"{_PA} SELECT asset, {_T}, rn - 1 AS n FROM pa")
def ordinal(spark, d):
    from pyspark.sql import Window

    p = pa(spark, d)
    return shown(p.df, keys=("asset", "time")).withColumn("n", (F.row_number().over(Window.partitionBy("asset").orderBy("time")) - 1).cast("bigint"))


for _name, _sql in {"mean": "avg", "sum": "sum", "std": "stddev_pop", "median": "median"}.items():
    _v = f"{_PA}, v AS (SELECT *, {_sql}(vol) OVER (PARTITION BY asset ORDER BY time ROWS 3 PRECEDING) AS v FROM pa)"
    query(f"rolling_{_name}", f"{_v} SELECT asset, {_T}, {_r('CASE WHEN rn >= 4 THEN v ELSE max(CASE WHEN rn = 4 THEN v END) OVER (PARTITION BY asset) END', 'vol', 4)} FROM v")(
        lambda spark, d, n=_name: shown(getattr(pa(spark, d).rolling(4, ["vol"]), n)().df, "vol", digits=4)
    )


@query("cs_all", f"{_PA} SELECT asset, {_T}, {_r(f'me - avg(me) {_S}', 'me', 3)}, {_r(f'vol - avg(vol) {_S}', 'vol', 3)} FROM pa")
def cs_all(spark, d):
    return shown(pa(spark, d).cross_section("cs_demean", columns=["me", "vol"]).df, "me", "vol", digits=3)


_LONG = """WITH b AS (SELECT event_type AS asset, date_trunc('hour', ts) AS time, arg_max(value, (ts, event_id)) + 1e9::DOUBLE AS x FROM events GROUP BY 1, 2), n AS (
  SELECT *, row_number() OVER (PARTITION BY asset ORDER BY time) AS rn, avg(x - 1e9::DOUBLE) OVER (PARTITION BY asset ORDER BY time ROWS 199 PRECEDING) + 1e9::DOUBLE AS v FROM b)"""


@query("long_window", f"{_LONG} SELECT asset, {_T}, {_r('CASE WHEN rn >= 200 THEN v ELSE max(CASE WHEN rn = 200 THEN v END) OVER (PARTITION BY asset) END', digits=3)} FROM n")
def long_window(spark, d):
    """Values far from 0: sums must not lose their digits."""
    p = pc(spark, d)
    return shown(with_formula(p.df.withColumn("x", F.col("close") + 1e9), "sma($x, 200)", "value", p.axis), "value", digits=3)


@query("fn_dates", """SELECT o_orderkey AS k, CAST(DATE '1960-01-01' + CAST(o_orderkey % 20000 AS INTEGER) AS VARCHAR) AS sas, CAST(last_day(make_date(year(o_orderdate), 12, 31) + INTERVAL 6 MONTH) AS VARCHAR) AS published,
  CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d FROM orders""")
def fn_dates(spark, d):
    o = table(spark, d, "orders")
    t = F.col("o_orderdate")
    return o.select(F.col("o_orderkey").alias("k"), sas_date(F.col("o_orderkey") % 20000).cast("string").alias("sas"), joins.publication_date(F.year(t)).cast("date").cast("string").alias("published"), F.year(t).alias("y"), F.month(t).alias("m"), F.day(t).alias("d"))


@query("zscore_asset", f"{_PA} SELECT asset, {_T}, {_r('(ret - avg(ret) OVER (PARTITION BY asset)) / (coalesce(stddev_pop(ret) OVER (PARTITION BY asset), 0) + 1e-8)', 'ret_csz', 5)} FROM pa")
def zscore_asset(spark, d):
    return shown(processors.AssetZScore(["ret"]).transform(processors.View(pa(spark, d))).panel.df, "ret_csz", digits=5)


@query("fix_mke", f"""{_PA}, f AS (SELECT asset, time, asset % 5 AS permco, abs(vol) * 10 AS m FROM pa)
  SELECT asset, {_T}, {_r("CASE WHEN m = max(m) OVER (PARTITION BY time, permco) THEN sum(m) OVER (PARTITION BY time, permco) ELSE m END", "me")} FROM f""")
def fix_mke(spark, d):
    p = pa(spark, d)
    p = p.on(p.df.select("asset", "time", (-F.col("vol")).alias("prc"), F.lit(10.0).alias("shrout"), (F.col("asset") % 5).alias("permco")))
    return shown(processors.apply_transforms(p, [{"type": "fix_mke"}]).df, "me")


@query("ps", f"WITH {_PD} SELECT asset, {_T}, {_r('CASE WHEN year(time) % 2 = 0 THEN txditc / 2 ELSE 0 END', 'ps')} FROM pd")
def ps(spark, d):
    return shown(processors.preferred_stock(pd_(spark, d)).df, "ps")


# ---- sorts, portfolios, spreads ----------------------------------------------------------------

_NYSE = "exchcd = 1"


def _cut(signal: str, scope: str | None, quantiles: list[float]) -> str:
    inside = f"CASE WHEN {scope} THEN {signal} END" if scope else signal
    points = [f"round({signal}, 7) >= round(quantile_cont({inside}, {q}) OVER (PARTITION BY time), 7)" for q in quantiles]
    some = f"count({inside}) OVER (PARTITION BY time) > 0"
    return f"CASE WHEN {signal} IS NOT NULL AND {some} THEN " + " + ".join(f"CAST({p} AS INT)" for p in points) + " END"


def _sorted(spark, d, signal: str, quantiles: list[float], scope: str | None) -> Panel:
    p = pa(spark, d)
    p = p.on(p.df.withColumn("nyse", F.col("exchcd") == 1))
    step = processors.CrossSectionalSort(signal, len(quantiles) + 1, scope, quantiles, bp_digits=7)
    return step.transform(processors.View(p)).panel


for _name, _signal, _q, _scope in (("median", "x", [0.5], None), ("q3070", "bm", [0.3, 0.7], None), ("scoped", "bm", [0.3, 0.7], "nyse")):
    query(f"sort_{_name}", f"{_PA} SELECT asset, {_T}, {_r(_cut(_signal, _NYSE if _scope else None, _q))} FROM pa")(
        lambda spark, d, s=_signal, q=_q, c=_scope: shown(_sorted(spark, d, s, q, c).df.withColumnRenamed(f"{s}_port", "value"), "value")
    )


def _portfolios(spark, d, groups: list[str], weights: str | None, dense: bool = False) -> processors.View:
    view = processors.View(_sorted(spark, d, "x", [0.5], "nyse"))
    view = processors.CrossSectionalSort("bm", 3, "nyse", [0.3, 0.7], bp_digits=7).transform(view)
    return processors.PortfolioReturns(groups, "ret", weights, dense).transform(view)


_SORTED = f"{_PA}, s AS (SELECT *, {_cut('x', _NYSE, [0.5])} AS g1, {_cut('bm', _NYSE, [0.3, 0.7])} AS g2 FROM pa)"


@query("port_ret_ew", f"{_SORTED} SELECT {_T}, CAST(g1 AS DOUBLE) AS x_port_dim, {_r('avg(ret)', digits=8)} FROM s WHERE g1 IS NOT NULL GROUP BY time, g1")
def port_ret_ew(spark, d):
    return shown(_portfolios(spark, d, ["x_port"], None).frames["port_ret_x_port"], "x_port_dim", "value", keys=("time",), digits=8)


@query("port_ret_vw", f"{_SORTED} SELECT {_T}, CAST(g1 AS DOUBLE) AS x_port_dim, {_r('sum(ret * me) / nullif(sum(me), 0)', digits=8)} FROM s WHERE g1 IS NOT NULL GROUP BY time, g1")
def port_ret_vw(spark, d):
    return shown(_portfolios(spark, d, ["x_port"], "me").frames["port_ret_x_port"], "x_port_dim", "value", keys=("time",), digits=8)


_P23 = f"{_SORTED}, p AS (SELECT time, g1, g2, sum(ret * me) / nullif(sum(me), 0) AS v FROM s WHERE g1 IS NOT NULL AND g2 IS NOT NULL GROUP BY 1, 2, 3)"


@query("port_ret_2x3", f"{_P23} SELECT strftime(t.time, '%Y-%m-%d %H:%M:%S') AS time, CAST(a.g1 AS DOUBLE) AS x_port_dim, CAST(b.g2 AS DOUBLE) AS bm_port_dim, {_r('p.v', digits=8)} FROM (SELECT DISTINCT time FROM pa) t CROSS JOIN (SELECT unnest([0, 1]) AS g1) a CROSS JOIN (SELECT unnest([0, 1, 2]) AS g2) b LEFT JOIN p ON p.time = t.time AND p.g1 = a.g1 AND p.g2 = b.g2")
def port_ret_2x3(spark, d):
    return shown(_portfolios(spark, d, ["x_port", "bm_port"], "me", dense=True).frames["port_ret_x_port_bm_port"], "x_port_dim", "bm_port_dim", "value", keys=("time",), digits=8)


def spreads(view: processors.View, source: str, size: str, value: str) -> DataFrame:
    step = processors.FactorSpread(source, {
        "SMB": {"long": {size: 0}, "short": {size: 1}, "average_over": value}, "HML": {"long": {value: 2}, "short": {value: 0}, "average_over": size},
    })
    return step.transform(view).frames["factors"]


_FACTORS = "avg(CASE WHEN g1 = 0 THEN v END) - avg(CASE WHEN g1 = 1 THEN v END)", "avg(CASE WHEN g2 = 2 THEN v END) - avg(CASE WHEN g2 = 0 THEN v END)"


@query("factor_spread", f"{_P23} SELECT {_T}, {_r(_FACTORS[0], 'SMB', 8)}, {_r(_FACTORS[1], 'HML', 8)} FROM p GROUP BY time")
def factor_spread(spark, d):
    return shown(spreads(_portfolios(spark, d, ["x_port", "bm_port"], "me"), "port_ret_x_port_bm_port", "x_port_dim", "bm_port_dim"), "SMB", "HML", keys=("time",), digits=8)


def june_chain(spark: SparkSession, d: str) -> DataFrame:
    """Yearly two-by-three sort: ratios of lagged values, formed in June by scoped break points,
    held until the next June, weighted by last month's size."""
    p = pa(spark, d)
    texts = {"lagged": "shift($vol, 6) / shift($me, 6)", "me_lag1": "shift($me, 1)", "me_june": "where(eq(month_coord($me), 6), $me, nan_const())", "nyse": "eq($exchcd, 1)"}
    m = FormulaManager(builtin=False)
    df = compute(p.df, p.axis, {k: m.expand(parse(v)) for k, v in texts.items()})
    df = with_formula(df, "where(eq(month_coord($me), 6), $lagged * 1000, nan_const())", "beme_june", p.axis)
    view = processors.View(p.on(df))
    for step in (
        processors.CrossSectionalSort("me_june", 2, "nyse", bp_digits=7), processors.CrossSectionalSort("beme_june", 3, "nyse", [0.3, 0.7], bp_digits=7),
        processors.ForwardFill(["me_june_port", "beme_june_port"]), processors.PortfolioReturns(["me_june_port", "beme_june_port"], "ret", "me_lag1"),
    ):
        view = step.transform(view)
    return spreads(view, "port_ret_me_june_port_beme_june_port", "me_june_port_dim", "beme_june_port_dim")


_JUNE = f"""{_PA}, a AS (SELECT *, lag(vol, 6) {_W} / lag(me, 6) {_W} AS lagged, lag(me) {_W} AS w FROM pa), b AS (
  SELECT *, CASE WHEN month(time) = 6 THEN me END AS mj, CASE WHEN month(time) = 6 THEN lagged * 1000 END AS bj FROM a), c AS (
  SELECT *, {_cut('mj', _NYSE, [0.5])} AS p1, {_cut('bj', _NYSE, [0.3, 0.7])} AS p2 FROM b), s AS (
  SELECT *, last_value(p1 IGNORE NULLS) OVER (PARTITION BY asset ORDER BY time ROWS UNBOUNDED PRECEDING) AS g1, last_value(p2 IGNORE NULLS) OVER (PARTITION BY asset ORDER BY time ROWS UNBOUNDED PRECEDING) AS g2 FROM c), p AS (
  SELECT time, g1, g2, sum(ret * w) / nullif(sum(CASE WHEN ret IS NOT NULL THEN w END), 0) AS v FROM s WHERE g1 IS NOT NULL AND g2 IS NOT NULL GROUP BY 1, 2, 3)
  SELECT {_T}, {_r(_FACTORS[0], 'SMB', 8)}, {_r(_FACTORS[1], 'HML', 8)} FROM p GROUP BY time"""
query("ff_june_chain", _JUNE)(lambda spark, d: shown(june_chain(spark, d), "SMB", "HML", keys=("time",), digits=8))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Monthly panel, moving mean, rank, scoped two-by-three sort, weighted returns, spreads."""
    p = pa(spark, d)
    df = FormulaManager().evaluate(p.df, {"sma": {"window": 5}}, p.axis, {"price": "me"})
    df = with_formula(df, "cs_rank($sma_ww5)", "rank", p.axis).withColumn("nyse", F.col("exchcd") == 1)
    view = processors.View(p.on(df))
    for step in (processors.CrossSectionalSort("rank", 2, "nyse", bp_digits=7), processors.CrossSectionalSort("bm", 3, "nyse", [0.3, 0.7], bp_digits=7), processors.PortfolioReturns(["rank_port", "bm_port"], "ret", "me")):
        view = step.transform(view)
    return shown(spreads(view, "port_ret_rank_port_bm_port", "rank_port_dim", "bm_port_dim"), "SMB", "HML", keys=("time",), digits=8)


query("flagship", f"""{_PA}, v AS (SELECT *, round(avg(me) OVER (PARTITION BY asset ORDER BY time ROWS 4 PRECEDING), 9) AS v0 FROM pa), m AS (
  SELECT *, CASE WHEN rn >= 5 THEN v0 ELSE max(CASE WHEN rn = 5 THEN v0 END) OVER (PARTITION BY asset) END AS sma FROM v), k AS (
  SELECT *, CASE WHEN sma IS NOT NULL AND count(sma) {_S} > 1 THEN (row_number() OVER (PARTITION BY time, sma IS NULL ORDER BY sma, asset) - 1) / (count(sma) {_S} - 1) END AS rk FROM m), s AS (
  SELECT *, {_cut('rk', _NYSE, [0.5])} AS g1, {_cut('bm', _NYSE, [0.3, 0.7])} AS g2 FROM k), p AS (
  SELECT time, g1, g2, sum(ret * me) / nullif(sum(me), 0) AS v FROM s WHERE g1 IS NOT NULL AND g2 IS NOT NULL GROUP BY 1, 2, 3)
  SELECT {_T}, {_r(_FACTORS[0], 'SMB', 8)}, {_r(_FACTORS[1], 'HML', 8)} FROM p GROUP BY time""")(flagship)


# ---- joins and merges --------------------------------------------------------------------------


@query("join_lookup", f"{_PA} SELECT asset, {_T}, round(me + 1.7e-09::DOUBLE, 6) + 0.0::DOUBLE AS me, s_name AS name FROM pa LEFT JOIN supplier ON s_suppkey = asset AND s_suppkey % 9 <> 0")
def join_lookup(spark, d):
    s = table(spark, d, "supplier").where("s_suppkey % 9 <> 0").select(F.col("s_suppkey").alias("asset"), F.col("s_name").alias("name"))
    return shown(joins.lookup(pa(spark, d).df, s.unionByName(s), "asset", ["name"]), "me", "name")


@query("join_replace", f"{_PA} SELECT asset, {_T}, {_r('CASE WHEN asset % 3 = 0 AND month(time) = 6 THEN -ret * 2 ELSE ret END', 'ret')} FROM pa")
def join_replace(spark, d):
    p = pa(spark, d).df
    events = p.where("asset % 3 = 0 and month(time) = 6").select("asset", F.col("time").alias("dlstdt"), (-F.col("ret") * 2).alias("dlret"))
    return shown(joins.replace_values(p, events, "asset", "time", "dlstdt", "dlret", "ret"), "ret")


@query("join_timeseries", f"{_PA} SELECT asset, {_T}, {_r('CASE WHEN month(time) % 2 = 0 THEN vol END', 'extra')} FROM pa")
def join_timeseries(spark, d):
    p = pa(spark, d).df
    right = p.where("month(time) % 2 = 0").select("asset", F.col("time").alias("at"), F.col("vol").alias("extra"))
    return shown(joins.timeseries(p, right, "asset", "time", "at", ["extra"]), "extra")


@query("join_link_range", """WITH a AS (SELECT l_suppkey AS gvkey, year(l_shipdate) AS y, round(sum(l_extendedprice), 2) AS seq FROM lineitem GROUP BY 1, 2), k AS (
  SELECT l_suppkey AS gvkey, year(l_shipdate) AS y, min(l_shipdate) AS f, CASE WHEN year(l_shipdate) % 4 <> 0 THEN max(l_shipdate) + INTERVAL 400 DAY ELSE TIMESTAMP '2020-01-01' END AS t,
  l_suppkey * 10 + 1 AS permno FROM lineitem GROUP BY 1, 2)
  SELECT a.gvkey, CAST(a.y AS INT) AS y, round(a.seq, 6) AS seq, k.permno FROM a JOIN k ON a.gvkey = k.gvkey AND k.gvkey % 5 <> 0 AND CAST(last_day(make_date(a.y, 12, 31) + INTERVAL 6 MONTH) AS TIMESTAMP) BETWEEN k.f AND k.t""")
def join_link_range(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("gvkey"), F.year("l_shipdate").alias("y")).agg(F.round(F.sum("l_extendedprice"), 2).alias("seq"), F.min("l_shipdate").alias("linkdt"), F.max("l_shipdate").alias("hi"))
    links = li.select("gvkey", "linkdt", F.when(F.col("y") % 4 != 0, F.expr("hi + interval 400 days")).alias("linkenddt"), F.when(F.col("gvkey") % 5 != 0, "LU").otherwise("NR").alias("linktype"), F.lit("P").alias("linkprim"), (F.col("gvkey") * 10 + 1).alias("permno"))
    out = joins.link_range(li.select("gvkey", "y", "seq"), links, "gvkey", joins.publication_date(F.col("y")), "permno", today=F.lit("2020-01-01").cast("timestamp_ntz"))
    return out.select("gvkey", "y", F.round("seq", 6).alias("seq"), "permno")


def _quarters(spark, d) -> Panel:
    p = pa(spark, d)
    return p.on(p.df.where("month(time) % 3 = 0").select("asset", "time", F.col("vol").alias("q")))


_Q = f"{_PA}, q AS (SELECT asset, time, vol AS q FROM pa WHERE month(time) % 3 = 0)"


def _merged(spark, d, **spec) -> DataFrame:
    left = pa(spark, d)
    return joins.merge(left.on(left.df.select("asset", "time", "me")), _quarters(spark, d), joins.MergeSpec(**spec)).df


_SEL = "SELECT p.asset, strftime(p.time, '%Y-%m-%d %H:%M:%S') AS time, round(p.me + 1.7e-09::DOUBLE, 6) + 0.0::DOUBLE AS me"
query("merge_exact", f"{_Q} {_SEL}, round(q.q + 1.7e-09::DOUBLE, 6) + 0.0::DOUBLE AS q FROM pa p LEFT JOIN q ON p.asset = q.asset AND p.time = q.time")(lambda s, d: shown(_merged(s, d, alignment="exact"), "me", "q"))
for _kind in ("as_of", "ffill"):
    query(f"merge_{_kind.replace('_', '')}", f"{_Q} {_SEL}, round(q.q + 1.7e-09::DOUBLE, 6) + 0.0::DOUBLE AS q FROM pa p ASOF LEFT JOIN q ON p.asset = q.asset AND p.time >= q.time")(lambda s, d, k=_kind: shown(_merged(s, d, alignment=k), "me", "q"))
query("merge_bfill", f"{_Q} {_SEL}, round(q.q + 1.7e-09::DOUBLE, 6) + 0.0::DOUBLE AS q FROM pa p ASOF LEFT JOIN q ON p.asset = q.asset AND p.time <= q.time")(lambda s, d: shown(_merged(s, d, alignment="bfill"), "me", "q"))
query("merge_nearest", f"{_Q}, n AS (SELECT p.asset, p.time, p.me, arg_min(q.q, (abs(epoch_us(p.time) - epoch_us(q.time)), epoch_us(q.time))) AS q FROM pa p LEFT JOIN q ON p.asset = q.asset GROUP BY ALL) SELECT asset, {_T}, round(me + 1.7e-09::DOUBLE, 6) + 0.0::DOUBLE AS me, round(q + 1.7e-09::DOUBLE, 6) + 0.0::DOUBLE AS q FROM n")(lambda s, d: shown(_merged(s, d, alignment="nearest"), "me", "q"))
query("merge_prefix", f"{_Q} {_SEL}, round(q.q + 1.7e-09::DOUBLE, 6) + 0.0::DOUBLE AS f_q_x FROM pa p LEFT JOIN q ON p.asset = q.asset AND p.time = q.time")(lambda s, d: shown(_merged(s, d, alignment="exact", prefix="f_", suffix="_x"), "me", "f_q_x"))
query("merge_inner", f"{_Q} {_SEL}, round(q.q + 1.7e-09::DOUBLE, 6) + 0.0::DOUBLE AS q FROM pa p JOIN q ON p.asset = q.asset AND p.time = q.time")(lambda s, d: shown(_merged(s, d, alignment="exact", method="inner"), "me", "q"))
for _n in (0, 6, 12, 18):
    _year = f"year(p.time) - {_n // 12} - " + (f"CAST(month(p.time) <= {_n % 12} AS INT)" if _n % 12 else "0")

    def _lagged(spark, d, n=_n):
        left = pa(spark, d)
        return shown(joins.merge(left.on(left.df.select("asset", "time", "me")), pd_(spark, d), joins.MergeSpec("exact", offset_months=n, variables=["seq"], grain="year")).df, "me", "seq")

    query(f"merge_lag{_n}", f"{_PA}, {_PD} {_SEL}, round(y.seq + 1.7e-09::DOUBLE, 6) + 0.0::DOUBLE AS seq FROM pa p LEFT JOIN pd y ON p.asset = y.asset AND year(y.time) = {_year}")(_lagged)


@query("merge_outer_implicit", f"{_Q}, l AS (SELECT asset, time, me FROM pa WHERE asset % 2 = 0) SELECT coalesce(l.asset, q.asset) AS asset, strftime(coalesce(l.time, q.time), '%Y-%m-%d %H:%M:%S') AS time, round(me + 1.7e-09::DOUBLE, 6) + 0.0::DOUBLE AS me, round(q + 1.7e-09::DOUBLE, 6) + 0.0::DOUBLE AS q FROM l FULL JOIN q ON l.asset = q.asset AND l.time = q.time")
def merge_outer_implicit(spark, d):
    left = pa(spark, d)
    return shown(joins.implicit([left.on(left.df.where("asset % 2 = 0").select("asset", "time", "me")), _quarters(spark, d)]).df, "me", "q")


# ---- recurrences on user events ----------------------------------------------------------------


def _formula_pb(name: str, request: dict, column: str, sql: str, digits: int = 5) -> None:
    def run(spark, d):
        p = pb(spark, d)
        df = FormulaManager().evaluate(p.df, request, p.axis, {"price": "x"}).withColumn("value", F.col(column))
        return shown(df, "value", digits=digits)

    query(name, sql)(run)


def _smoothed(w: int, alpha: str, seed: str, x: str = "x", source: str = "pb", name: str = "e") -> str:
    """A recursive smoothing over ``source`` (asset, time, rn, n, x)."""
    return f"""{name}s AS (SELECT asset, {seed} * sum({x}) AS s FROM {source} WHERE rn <= {w} GROUP BY asset HAVING count(*) = {w}),
  {name}r AS (SELECT p.asset, p.rn, s.s AS v FROM {source} p JOIN {name}s s USING (asset) WHERE rn = {w}
    UNION ALL SELECT r.asset, p.rn, {alpha} * p.{x} + (1 - {alpha}) * r.v FROM {name}r r JOIN {source} p ON p.asset = r.asset AND p.rn = r.rn + 1),
  {name} AS (SELECT p.*, CASE WHEN p.rn < {w} THEN s.s ELSE r.v END AS {name}v FROM {source} p LEFT JOIN {name}s s ON p.asset = s.asset LEFT JOIN {name}r r ON r.asset = p.asset AND r.rn = p.rn)"""


_formula_pb("ema", {"ema": {"window": 5}}, "ema_ww5", f"{_PB}, {_smoothed(5, '(2.0 / 6)', '(2.0 / 6)')} SELECT asset, {_T}, {_r('ev', digits=5)} FROM e")
_formula_pb("rma", {"rma": {"window": 5}}, "rma_ww5", f"{_PB}, {_smoothed(5, '0.2', '0.2')} SELECT asset, {_T}, {_r('ev', digits=5)} FROM e")
_formula_pb("dema", {"dema": {"window": 4}}, "dema_ww4", f"{_PB}, {_smoothed(4, '0.4', '0.4')}, {_smoothed(4, '0.4', '0.4', 'ev', 'e', 'f')} SELECT asset, {_T}, {_r('2 * ev - fv', digits=5)} FROM f")
_CHANGES = f"{_PB}, c AS (SELECT asset, time, rn, n, greatest(coalesce(x - lag(x) {_W}, 0), 0) AS g, greatest(coalesce(lag(x) {_W} - x, 0), 0) AS l FROM pb)"
_formula_pb("rsi", {"rsi": {"window": 6}}, "rsi_ww6", f"{_CHANGES}, {_smoothed(6, '(1.0 / 6)', '(1.0 / 6)', 'g', 'c', 'u')}, {_smoothed(6, '(1.0 / 6)', '(1.0 / 6)', 'l', 'u', 'd')} SELECT asset, {_T}, {_r('100 * uv / nullif(uv + dv, 0)', digits=5)} FROM d")
_HW = f"""{_PB}, h AS (SELECT asset, rn, 0.8 * x + 0.2 * x AS f, 0.0::DOUBLE AS v, 0.0::DOUBLE AS a FROM pb WHERE rn = 1
  UNION ALL SELECT asset, rn, f2, v2, 0.9 * a + 0.1 * (v2 - v) FROM (SELECT *, 0.9 * (v + a) + 0.1 * (f2 - f) AS v2 FROM (
    SELECT h.asset, p.rn, h.f, h.v, h.a, 0.8 * (h.f + h.v + 0.5 * h.a) + 0.2 * p.x AS f2 FROM h JOIN pb p ON p.asset = h.asset AND p.rn = h.rn + 1)))
  SELECT p.asset, strftime(p.time, '%Y-%m-%d %H:%M:%S') AS time, {_r('h.f + h.v + 0.5 * h.a', digits=5)} FROM h JOIN pb p USING (asset, rn)"""
_formula_pb("hwma", {"hwma": {}}, "hwma", _HW)
_formula_pb("triple_exponential_smoothing", {"triple_exponential_smoothing": {"data": "x"}}, "triple_exponential_smoothing_dx", _HW)


@query("adaptive_ema", f"""{_PB}, b AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY rn) AS k FROM (SELECT *, CASE WHEN rn % 4 <> 0 THEN x END AS y, 1.0 / (1 + rn % 3) AS s FROM pb) WHERE y IS NOT NULL), h AS (
  SELECT asset, rn, k, 0.0::DOUBLE AS v FROM b WHERE k = 1 UNION ALL SELECT h.asset, b.rn, b.k, b.s * b.y + (1 - b.s) * h.v FROM h JOIN b ON b.asset = h.asset AND b.k = h.k + 1)
  SELECT asset, {_T}, {_r('v', digits=5)} FROM (SELECT p.asset, p.time, last_value(h.v IGNORE NULLS) OVER (PARTITION BY p.asset ORDER BY p.rn ROWS UNBOUNDED PRECEDING) AS v FROM pb p LEFT JOIN h USING (asset, rn))""")
def adaptive_ema(spark, d):
    from pyspark.sql import Window

    p = pb(spark, d)
    rn = F.row_number().over(Window.partitionBy("asset").orderBy("time"))
    df = p.df.withColumn("rn", rn).select("asset", "time", F.when(F.col("rn") % 4 != 0, F.col("x")).alias("y"), (1.0 / (1 + F.col("rn") % 3)).alias("s"))
    return shown(with_formula(df, "adaptive_ema($y, $s)", "value", p.axis), "value", digits=5)


_KAMA = f"""{_PB}, a AS (SELECT *, abs(x - lag(x, 3) {_W}) AS move, coalesce(abs(x - lag(x) {_W}), 0) AS step FROM pb), b AS (
  SELECT *, sum(step) OVER (PARTITION BY asset ORDER BY time ROWS 2 PRECEDING) AS v0 FROM a), c AS (
  SELECT *, CASE WHEN rn >= 3 THEN v0 ELSE max(CASE WHEN rn = 3 THEN v0 END) OVER (PARTITION BY asset) END AS noise FROM b), e AS (
  SELECT *, pow(move / nullif(noise, 0) * (0.6667 - 0.0645) + 0.0645, 2) AS s FROM c), g AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY rn) AS k FROM e WHERE s IS NOT NULL), h AS (
  SELECT asset, rn, k, 0.0::DOUBLE AS v FROM g WHERE k = 1 UNION ALL SELECT h.asset, g.rn, g.k, g.s * g.x + (1 - g.s) * h.v FROM h JOIN g ON g.asset = h.asset AND g.k = h.k + 1)
  SELECT asset, {_T}, {_r('v', digits=4)} FROM (SELECT p.asset, p.time, last_value(h.v IGNORE NULLS) OVER (PARTITION BY p.asset ORDER BY p.rn ROWS UNBOUNDED PRECEDING) AS v FROM pb p LEFT JOIN h USING (asset, rn))"""
_formula_pb("kama", {"kama": {"length": 3}}, "kama_l3", _KAMA, 4)


def _weighted(x: str, weights: list[float], w: int) -> str:
    """Weights from the oldest row; the warm-up repeats the first full value."""
    total = " + ".join(f"{v!r} * lag({x}, {w - 1 - i}) {_W}" if i < w - 1 else f"{v!r} * {x}" for i, v in enumerate(weights))
    return f"({total}) / {sum(weights)!r}"


def _filled(v: str, w: int) -> str:
    return f"CASE WHEN rn >= {w} THEN {v} ELSE max(CASE WHEN rn = {w} THEN {v} END) OVER (PARTITION BY asset) END"


def _formula_pa(name: str, request: dict, column: str, sql: str, alias: dict | None = None, digits: int = 5, prepare: Callable[[DataFrame], DataFrame] | None = None) -> None:
    def run(spark, d):
        p = pa(spark, d)
        df = prepare(p.df) if prepare else p.df
        return shown(FormulaManager().evaluate(df, request, p.axis, alias).withColumn("value", F.col(column)), "value", digits=digits)

    query(name, sql)(run)


def _weights_of(name: str, *args) -> list[float]:
    from ..functions.weights import generator

    return generator(name)(*args)


_price = {"price": "vol"}
for _name, _request, _column, _weights in (
    ("wma_formula", {"wma": {"window": 4}}, "wma_ww4", _weights_of("linear", 4)),
    ("alma", {"alma": {"window": 6}}, "alma_ww6", _weights_of("alma", 6, 0.85, 6)),
    ("fwma", {"fwma": {"window": 5}}, "fwma_ww5", _weights_of("fibonacci", 5, True)),
):
    _n = len(_weights)
    _formula_pa(_name, _request, _column, f"{_PA}, v AS (SELECT *, {_weighted('vol', _weights, _n)} AS v FROM pa) SELECT asset, {_T}, {_r(_filled('v', _n), digits=5)} FROM v", _price)
_formula_pa("hma", {"hma": {"window": 5}}, "hma_ww5", f"""{_PA}, a AS (SELECT *, {_weighted('vol', [1.0, 2.0], 2)} AS a0, {_weighted('vol', [1.0, 2.0, 3.0, 4.0, 5.0], 5)} AS b0 FROM pa), b AS (
  SELECT asset, time, rn, 2 * ({_filled('a0', 2)}) - ({_filled('b0', 5)}) AS y FROM a), c AS (SELECT asset, time, rn, {_weighted('coalesce(y, 0)', [1.0, 2.0], 2)} AS v FROM b)
  SELECT asset, {_T}, {_r(_filled('v', 2), digits=5)} FROM c""", _price)


# ---- the formula library -----------------------------------------------------------------------


def _stock(df: DataFrame) -> DataFrame:
    """Stand-ins for the inputs of market characteristics."""
    return df.withColumns({
        "prc": F.col("vol") + 10, "cfacpr": F.col("exchcd").cast("double"), "retx": F.col("ret") - 0.01, "shrout": F.col("vol") * 2, "cfacshr": F.lit(1.5),
        "be_raw": F.col("me") - 300000, "bm_nyse": F.when(F.col("exchcd") == 1, F.col("bm")),
    })


_ST = f"""{_PA}, st AS (SELECT *, vol + 10 AS prc, CAST(exchcd AS DOUBLE) AS cfacpr, ret - 0.01 AS retx, vol * 2 AS shrout, 1.5::DOUBLE AS cfacshr, me - 300000 AS be_raw,
  CASE WHEN exchcd = 1 THEN bm END AS bm_nyse, (vol + 10) / exchcd AS prc_adj, vol * 3 AS sh, (ret - (ret - 0.01)) * ((vol + 10) / exchcd) AS dv FROM pa)"""


def _lib(name: str, sql: str, digits: int = 5, request: dict | None = None, column: str | None = None) -> None:
    _formula_pa(f"lib_{column or name}", request or {name: {}}, column or name, f"{_ST} SELECT asset, {_T}, {_r(sql, digits=digits)} FROM st", None, digits, _stock)


_lib("market_equity", "me")
_lib("prc_adj", "prc_adj")
_lib("price_ret", f"prc_adj / lag(prc_adj) {_W} - 1")
_lib("price_ret_var", f"prc / lag(prc, 3) {_W} - 1", request={"price_ret_var": {"periods": 3}}, column="price_ret_var_p3")
_lib("fwd_return", f"lead(prc, 2) {_W} / prc - 1", request={"fwd_return": {"periods": 2}}, column="fwd_return_p2")
_lib("dividend", "dv")
_lib("shares_adj", "sh")
_lib("dividend_times_shares", "sh * dv")
for _n in (1, 3, 6, 12):
    _roll = f"sum(sh * dv) OVER (PARTITION BY asset ORDER BY time ROWS {_n - 1} PRECEDING)"
    _formula_pa(f"lib_div{_n}m_me", {f"div{_n}m_me": {}}, f"div{_n}m_me", f"{_ST}, v AS (SELECT *, {_roll} AS v FROM st), w AS (SELECT *, {_filled('v', _n)} AS f FROM v) SELECT asset, {_T}, {_r('f / me', digits=5)} FROM w", None, 5, _stock)
    _lib(f"chcsho_{_n}m", f"sh / lag(sh, {_n}) {_W} - 1")
    _lib(f"ret_{_n}m", " * ".join(["(1 + ret)", *[f"(1 + lag(ret, {i}) {_W})" for i in range(1, _n)]]) + " - 1" if _n > 1 else "ret")
_lib("is_nyse", "CAST(exchcd = 1 AS INT)")
_lib("is_common_share", "CASE WHEN shrcd IN (10, 11) THEN 1 END")
_lib("book_equity_clean", "CASE WHEN be_raw > 0 THEN be_raw END")
_lib("me_nyse", "CASE WHEN exchcd = 1 THEN me END")
for _c in ("me", "bm"):
    _lib(f"{_c}_cs_rank", f"CASE WHEN count({_c}) {_S} > 1 THEN (row_number() OVER (PARTITION BY time ORDER BY {_c}, asset) - 1) / (count({_c}) {_S} - 1) END")
_lib("sz_bucket", f"CASE WHEN me IS NOT NULL THEN coalesce(CAST(me > quantile_cont(CASE WHEN exchcd = 1 THEN me END, 0.5) {_S} AS INT), 0) END")
_lib("ret_cs_demeaned", f"ret - avg(ret) {_S}")
_lib("me_cs_demeaned", f"me - avg(me) {_S}", digits=3)
_lib("market_equity", f"lag(me, 2) {_W}", request={"market_equity": {"lag": [2]}}, column="market_equity_lag2")
_lib("market_equity", f"lead(me, 1) {_W}", request={"market_equity": {"lag": -1}}, column="market_equity_lead1")


@query("lib_bm_bucket", f"{_ST} SELECT asset, {_T}, {_r(f'CASE WHEN bm IS NOT NULL THEN coalesce(CAST(round(bm, 9) > round(quantile_cont(bm_nyse, 0.3) {_S}, 9) AS INT), 0) + coalesce(CAST(round(bm, 9) > round(quantile_cont(bm_nyse, 0.7) {_S}, 9) AS INT), 0) END')} FROM st")
def lib_bm_bucket(spark, d):
    """The library's formula, its break points rounded as in the SQL."""
    p = pa(spark, d)
    df = compute(_stock(p.df), p.axis, {f"q{q}": parse(f"cs_quantile($bm_nyse, 0.{q})") for q in (3, 7)})
    df = df.withColumns({c: F.round(c, 9) for c in ("bm", "q3", "q7")})
    return shown(with_formula(df, "assign_bucket($bm, $q3, $q7)", "value", p.axis), "value")


_RSI = f"{_CHANGES}, {_smoothed(14, '(1.0 / 14)', '(1.0 / 14)', 'g', 'c', 'u')}, {_smoothed(14, '(1.0 / 14)', '(1.0 / 14)', 'l', 'u', 'd')}, z AS (SELECT d.*, 100 * uv / nullif(uv + dv, 0) AS rsi FROM d)"
_MOM = f"x / nullif(lag(x, 5) {_W}, 0) - 1"
_formula_pb("lib_simple_rsi_momentum", {"simple_rsi_momentum": {}}, "simple_rsi_momentum", f"{_RSI} SELECT asset, {_T}, {_r('rsi - 50', digits=5)} FROM z")
_formula_pb("lib_ts_momentum", {"ts_momentum": {}}, "ts_momentum", f"{_PB} SELECT asset, {_T}, {_r(_MOM, digits=5)} FROM pb")
_formula_pb("lib_ts_signal", {"ts_signal": {}}, "ts_signal", f"{_PB} SELECT asset, {_T}, {_r(f'2 * ({_MOM})', digits=5)} FROM pb")
_formula_pb("lib_ts_combined", {"ts_combined": {}}, "ts_combined", f"{_RSI} SELECT z.asset, strftime(z.time, '%Y-%m-%d %H:%M:%S') AS time, {_r('2 * m.m + z.rsi', digits=5)} FROM z JOIN (SELECT asset, rn, {_MOM} AS m FROM pb) m USING (asset, rn)")


# ---- walk-forward and models -------------------------------------------------------------------

def plan_of(panel: Panel):
    """Windows over all times of the panel."""
    low, high = panel.bounds()
    return make_plan(SegmentConfig(low, high, timedelta(days=365), timedelta(days=120), timedelta(days=90), timedelta(days=10)))


_SEG = """bd AS (SELECT min(time) AS lo, max(time) AS hi FROM pa), sg AS (SELECT CAST(i AS INT) AS segment, lo + i * INTERVAL 90 DAY AS a, lo + i * INTERVAL 90 DAY + INTERVAL 365 DAY AS b,
  lo + i * INTERVAL 90 DAY + INTERVAL 375 DAY AS c, lo + i * INTERVAL 90 DAY + INTERVAL 495 DAY - INTERVAL 1 MICROSECOND AS e
  FROM bd, range(1000) r(i) WHERE lo + i * INTERVAL 90 DAY + INTERVAL 375 DAY <= hi)"""
_SEGMENTS = "SELECT segment, CAST(a AS VARCHAR) AS train_start, CAST(b AS VARCHAR) AS train_end, CAST(c AS VARCHAR) AS infer_start, CAST(e AS VARCHAR) AS infer_end FROM sg"


def _shown_plan(plan, spark) -> DataFrame:
    t = plan.table(spark)
    return t.select("segment", *[F.col(c).cast("string").alias(c) for c in t.columns if c != "segment"])


query("wf_plan", f"{_PA}, {_SEG} {_SEGMENTS}")(lambda spark, d: _shown_plan(plan_of(pa(spark, d)), spark))


@query("wf_expand", f"{_PA}, {_SEG} {_SEGMENTS}")
def wf_expand(spark, d):
    """One segment in the middle, expanded to both ends."""
    p = pa(spark, d)
    low, high = p.bounds()
    config = SegmentConfig(low, high, timedelta(days=365), timedelta(days=120), timedelta(days=90), timedelta(days=10))
    whole = make_plan(config)
    return _shown_plan(expand_plan(SegmentPlan([whole[len(whole) // 2]]), config, low, high), spark)


@query("wf_counts", f"{_PA}, {_SEG}, t AS (SELECT DISTINCT time FROM pa) SELECT segment, count(CASE WHEN time BETWEEN a AND b THEN 1 END) AS n_train, count(CASE WHEN time BETWEEN c AND e THEN 1 END) AS n_infer FROM sg, t GROUP BY segment")
def wf_counts(spark, d):
    p = pa(spark, d)
    return window_counts(p, plan_of(p))


@query("wf_optimize", f"{_PA}, {_SEG}, t AS (SELECT DISTINCT time FROM pa), n AS (SELECT a, count(CASE WHEN time BETWEEN a AND b THEN 1 END) AS k, count(CASE WHEN time BETWEEN c AND e THEN 1 END) AS m FROM sg, t GROUP BY segment, a) SELECT CAST(a AS VARCHAR) AS train_start FROM n WHERE k >= 12 AND m >= 4")
def wf_optimize(spark, d):
    p = pa(spark, d)
    return optimize_plan(plan_of(p), p, 12, 4).table(spark).select(F.col("train_start").cast("string").alias("train_start"))


@query("wf_zscore", f"""{_PA}, {_SEG}, st AS (SELECT segment, asset, avg(ret) AS mu, coalesce(stddev_pop(ret), 0) AS sd FROM sg JOIN pa ON time BETWEEN a AND b GROUP BY 1, 2), z AS (
  SELECT sg.segment, pa.asset, pa.time, (ret - mu) / (sd + 1e-8) AS z FROM sg JOIN pa ON time BETWEEN c AND e LEFT JOIN st ON st.segment = sg.segment AND st.asset = pa.asset)
  SELECT asset, {_T}, {_r("arg_max(z, segment) FILTER (WHERE z IS NOT NULL)", "ret_csz", 3)} FROM z GROUP BY asset, time""")
def wf_zscore(spark, d):
    # (training windows with a single month have no spread: the rounding is coarse for them)
    p = pa(spark, d)
    handler = processors.DataHandler(p.on(p.df.select("asset", "time", "ret")), processors.HandlerConfig(learn=[processors.AssetZScore(["ret"])]))
    return shown(WalkForwardRunner(handler, plan_of(p)).run().df, "ret_csz", digits=3)


def _predicted(panel: Panel, runner: ModelRunner) -> DataFrame:
    return runner.run(panel, plan_of(panel))


@query("wf_month", f"""{_PA}, {_SEG}, y AS (SELECT sg.segment, pa.asset, pa.time, month(time) * (ret - avg(ret) OVER (PARTITION BY sg.segment, pa.time)) AS v FROM sg JOIN pa ON time BETWEEN c AND e)
  SELECT asset, {_T}, {_r('arg_max(v, segment)', 'm', 6)} FROM y GROUP BY asset, time""")
def wf_month(spark, d):
    """Calendar and cross-sectional functions within segments."""
    p = pa(spark, d)
    step = processors.FormulaEval(expressions={"m": "month_coord($ret) * cs_demean($ret)"}, manager=FormulaManager(builtin=False))
    handler = processors.DataHandler(p.on(p.df.select("asset", "time", "ret")), processors.HandlerConfig(learn=[step]))
    return shown(WalkForwardRunner(handler, plan_of(p)).run().df, "m", digits=6)


@query("wf_segment", f"""{_PA}, {_SEG}, st AS (SELECT asset, avg(ret) AS mu, coalesce(stddev_pop(ret), 0) AS sd FROM sg JOIN pa ON time BETWEEN a AND b WHERE segment = 3 GROUP BY 1)
  SELECT pa.asset, {_T.replace('time,', 'pa.time,', 1)}, {_r("(ret - mu) / (sd + 1e-8)", "ret_csz", 3)} FROM sg JOIN pa ON time BETWEEN c AND e LEFT JOIN st ON st.asset = pa.asset WHERE segment = 3""")
def wf_segment(spark, d):
    p = pa(spark, d)
    handler = processors.DataHandler(p.on(p.df.select("asset", "time", "ret")), processors.HandlerConfig(learn=[processors.AssetZScore(["ret"])]))
    return shown(WalkForwardRunner(handler, plan_of(p)).run_segment(3).df, "ret_csz", digits=3)


_FIT = f"{_PA}, {_SEG}, m AS (SELECT segment, regr_slope(ret, bm) AS k, regr_intercept(ret, bm) AS i FROM sg JOIN pa ON time BETWEEN a AND b GROUP BY 1), y AS (SELECT sg.segment, pa.asset, pa.time, i + k * bm AS v FROM sg JOIN pa ON time BETWEEN c AND e JOIN m USING (segment))"
for _policy, _pick in (("last", "arg_max"), ("first", "arg_min")):
    query(f"wf_ols_{_policy}", f"{_FIT} SELECT asset, {_T}, {_r(f'{_pick}(v, segment)', 'pred', 7)} FROM y GROUP BY asset, time")(
        lambda spark, d, p=_policy: shown(_predicted(pa(spark, d), ModelRunner("LinearRegression", ["bm"], "ret", overlap_policy=p)), "pred", digits=7)
    )


@query("wf_ridge", f"""{_PA}, {_SEG}, m AS (SELECT segment, regr_sxy(ret, bm) / (regr_sxx(ret, bm) + 0.5) AS k, avg(ret) AS y, avg(bm) AS x FROM sg JOIN pa ON time BETWEEN a AND b GROUP BY 1), y AS (
  SELECT sg.segment, pa.asset, pa.time, m.y + k * (bm - m.x) AS v FROM sg JOIN pa ON time BETWEEN c AND e JOIN m USING (segment)) SELECT asset, {_T}, {_r('arg_max(v, segment)', 'pred', 7)} FROM y GROUP BY asset, time""")
def wf_ridge(spark, d):
    return shown(_predicted(pa(spark, d), ModelRunner("Ridge", ["bm"], "ret", {"alpha": 0.5})), "pred", digits=7)


def _level(n: int, source: str) -> str:
    """One level of a least-squares tree over bm and vol, with 5 rows a leaf at least: the best cut of
    each node, and the rows with their new nodes."""
    rows = f"SELECT segment, node, 0 AS f, bm AS v, y FROM {source} UNION ALL SELECT segment, node, 1 AS f, vol AS v, y FROM {source}"
    w = "OVER (PARTITION BY segment, node, f ORDER BY v)"
    side = lambda t: f"CASE WHEN k.f IS NULL THEN {t}.node WHEN CASE WHEN k.f = 0 THEN {t}.bm ELSE {t}.vol END <= k.cut THEN {t}.node || 'l' ELSE {t}.node || 'r' END AS node"
    at = "segment = k.segment AND {t}.node = k.node"
    return f"""c{n} AS (SELECT *, row_number() {w} AS rn, count(*) OVER (PARTITION BY segment, node, f) AS m, sum(y) OVER (PARTITION BY segment, node, f ORDER BY v ROWS UNBOUNDED PRECEDING) AS cy,
    sum(y) OVER (PARTITION BY segment, node, f) AS ty, lead(v) {w} AS nv FROM ({rows})),
  g{n} AS (SELECT *, cy * cy / rn + (ty - cy) * (ty - cy) / (m - rn) AS gain FROM c{n} WHERE rn >= 5 AND m - rn >= 5 AND v < nv{" AND node <> ''" if n > 1 else ""}),
  k{n} AS (SELECT segment, node, f, cut FROM (SELECT *, (v + nv) / 2 AS cut, row_number() OVER (PARTITION BY segment, node ORDER BY gain DESC, f, rn) AS best FROM g{n}) WHERE best = 1 AND gain > ty * ty / m + 1e-12),
  tr{n} AS (SELECT r.* EXCLUDE (node), {side("r")} FROM {source} r LEFT JOIN k{n} k ON r.{at.format(t="r")}),
  yi{n} AS (SELECT i.* EXCLUDE (node), {side("i")} FROM {source.replace("tr", "yi")} i LEFT JOIN k{n} k ON i.{at.format(t="i")})"""


@query("wf_tree", f"""{_PA}, {_SEG}, tr0 AS (SELECT segment, asset, time, bm, vol, ret AS y, '' AS node FROM sg JOIN pa ON time BETWEEN a AND b), yi0 AS (SELECT segment, asset, time, bm, vol, '' AS node FROM sg JOIN pa ON time BETWEEN c AND e),
  {_level(1, "tr0")}, {_level(2, "tr1")}, lf AS (SELECT segment, node, avg(y) AS v FROM tr2 GROUP BY 1, 2), y AS (SELECT i.asset, i.time, i.segment, lf.v FROM yi2 i LEFT JOIN lf ON i.segment = lf.segment AND i.node = lf.node)
  SELECT asset, {_T}, {_r("arg_max(v, segment) FILTER (WHERE v IS NOT NULL)", "pred", 7)} FROM y GROUP BY asset, time""")
def wf_tree(spark, d):
    return shown(_predicted(pa(spark, d), ModelRunner("DecisionTreeRegressor", ["bm", "vol"], "ret", {"max_depth": 2})), "pred", digits=7)


@query("ic_by_time", f"{_PA} SELECT {_T}, {_r('corr(bm, ret)', 'ic')}, count(*) AS n FROM pa GROUP BY time HAVING count(*) > 2")
def ic_by_time(spark, d):
    out = information_coefficient(pa(spark, d).df, "bm", "ret", "time").where("n > 2")
    return out.select(F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"), F.round("ic", 6).alias("ic"), "n")


# ---- sources, projections, chains ---------------------------------------------------------------


@query("src_manager", "SELECT user_id AS asset, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS time, round(arg_max(value, (ts, value)) + 1.7e-09::DOUBLE, 6) + 0.0::DOUBLE AS value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20' AND event_type = 'click' AND value >= 10 GROUP BY 1, 2")
def src_manager(spark, d):
    """A configured source: projection, dates, filters, panel."""
    raw = {"provider": "files", "dataset": "events", "path": f"{d}/events.parquet", "frequency": "daily", "columns_to_read": ["ts", "user_id", "event_type", "value"], "schema": {"time_var": "ts", "identifier_var": "user_id"}}
    config = SourceConfig.of({**raw, "start_date": "2024-01-03", "end_date": "2024-01-20", "filters": {"event_type": "click", "value__gte": 10}})
    table = DataManager(spark).table(config)
    return shown(from_table(table, "ts", "user_id", ["value"], config.frequency, order=["ts", "value"]).df, "value")


@query("src_columns", "SELECT s_suppkey AS k, round(s_acctbal + 1.7e-09::DOUBLE, 6) + 0.0::DOUBLE AS s_acctbal FROM supplier")
def src_columns(spark, d):
    config = SourceConfig("files", "supplier", f"{d}/supplier.parquet", columns=["S_SUPPKEY", "S_ACCTBAL"])
    df = readers.get_provider("files").loader("supplier")(spark, config)
    return shown(df.withColumnRenamed("s_suppkey", "k"), "s_acctbal", keys=("k",))


@query("src_simulated", "SELECT a.range AS asset, CAST(DATE '2020-01-01' + CAST(t.range AS INTEGER) AS VARCHAR) AS day, true AS drawn FROM range(4) a, range(30) t")
def src_simulated(spark, d):
    number = F.regexp_extract("asset", r"(\d+)$", 1).cast("bigint")
    return simulated(spark, 4, 30, 2, start="2020-01-01").df.select((number - 1).alias("asset"), F.to_date("time").cast("string").alias("day"), (F.col("var_1").isNotNull() & F.col("var_2").isNotNull()).alias("drawn"))


@query("join_chain", f"""{_PA}, x AS (SELECT pa.*, s_name AS name FROM pa LEFT JOIN supplier ON s_suppkey = asset AND s_suppkey % 9 <> 0)
  SELECT asset, {_T}, name, {_r('CASE WHEN asset % 3 = 0 AND month(time) = 6 THEN -ret * 2 ELSE ret END', 'ret')}, {_r('CASE WHEN month(time) % 2 = 0 THEN vol END', 'extra')} FROM x""")
def join_chain(spark, d):
    """Lookup, replacement and time series, one after the other."""
    p = pa(spark, d).df
    tables = {
        "names": table(spark, d, "supplier").where("s_suppkey % 9 <> 0").select(F.col("s_suppkey").alias("asset"), F.col("s_name").alias("name")),
        "exits": p.where("asset % 3 = 0 and month(time) = 6").select("asset", F.col("time").alias("dlstdt"), (-F.col("ret") * 2).alias("dlret")),
        "more": p.where("month(time) % 2 = 0").select("asset", F.col("time").alias("at"), F.col("vol").alias("extra")),
    }
    chain = [
        {"path": "names", "type": "lookup", "columns": ["name"]}, {"path": "exits", "type": "replace", "time_column": "dlstdt", "from_column": "dlret", "to_column": "ret"},
        {"path": "more", "type": "timeseries", "time_column": "at", "columns": ["extra"]},
    ]
    return shown(joins.external_tables(p, chain, tables.__getitem__, "asset", "time"), "name", "ret", "extra")


@query("merge_all", f"{_Q}, {_PD}, m AS (SELECT p.asset, p.time, p.me, q.q FROM pa p ASOF LEFT JOIN q ON p.asset = q.asset AND p.time >= q.time) SELECT m.asset, strftime(m.time, '%Y-%m-%d %H:%M:%S') AS time, round(m.me + 1.7e-09::DOUBLE, 6) + 0.0::DOUBLE AS me, round(m.q + 1.7e-09::DOUBLE, 6) + 0.0::DOUBLE AS q, round(y.seq + 1.7e-09::DOUBLE, 6) + 0.0::DOUBLE AS a_seq FROM m LEFT JOIN pd y ON m.asset = y.asset AND year(y.time) = year(m.time) - CAST(month(m.time) <= 6 AS INT)")
def merge_all(spark, d):
    left = pa(spark, d)
    rules = [{"source": "quarters", "alignment": "as_of"}, {"source": "annual", "alignment": "exact", "offset": {"months": 6}, "variables": ["seq"], "grain": "year", "prefix": "a_"}]
    return shown(joins.merge_all(left.on(left.df.select("asset", "time", "me")), {"quarters": _quarters(spark, d), "annual": pd_(spark, d)}, rules).df, "me", "q", "a_seq")


@query("merge_mixed_keys", f"{_PA} SELECT asset, {_T}, round(me + 1.7e-09::DOUBLE, 6) + 0.0::DOUBLE AS me, CASE WHEN asset % 3 <> 2 THEN round(vol + 1.7e-09::DOUBLE, 6) + 0.0::DOUBLE END AS q FROM pa")
def merge_mixed_keys(spark, d):
    """Numbers on the left, text on the right: 7 and 7.0 are one key, 7.5 is another."""
    left = pa(spark, d)
    text = F.when(F.col("asset") % 3 == 0, F.col("asset").cast("string")).when(F.col("asset") % 3 == 1, F.concat(F.col("asset").cast("string"), F.lit(".0"))).otherwise(F.concat(F.col("asset").cast("string"), F.lit(".5")))
    right = left.on(left.df.select(text.alias("asset"), "time", F.col("vol").alias("q")))
    return shown(joins.merge(left.on(left.df.select("asset", "time", "me")), right, joins.MergeSpec("exact")).df, "me", "q")


for _name, _args in {"exponential": (5, 0.3), "triangular": (5,), "custom": (5, [1, 0, 2, 0, 4])}.items():

    def _weights_query(spark, d, n=_name, args=_args):
        p = pa(spark, d)
        return shown(with_formula(p.df, "wma($vol, 5, $w)", "value", p.axis, {"w": _weights_of(n, *args)}), "value", digits=5)

    query(f"weights_{_name}", f"{_PA}, v AS (SELECT asset, time, rn, {_weighted('vol', _weights_of(_name, *_args), 5)} AS v FROM pa) SELECT asset, {_T}, {_r(_filled('v', 5), digits=5)} FROM v")(_weights_query)


@query("view_fetch", f"{_PA} SELECT asset, {_T}, {_r('(ret - avg(ret) OVER (PARTITION BY asset)) / (coalesce(stddev_pop(ret) OVER (PARTITION BY asset), 0) + 1e-8)', 'ret_csz', 5)}, {_r('last_value(x IGNORE NULLS) OVER (PARTITION BY asset ORDER BY time ROWS UNBOUNDED PRECEDING)', 'x', 5)} FROM pa")
def view_fetch(spark, d):
    """Processors made by name, shared before learned ones, one column group of the view."""
    steps = [processors.create_processor(raw, i) for i, raw in enumerate([{"type": "per_asset_ffill", "vars": ["x"]}, {"type": "cs_zscore", "vars": ["ret"]}])]
    handler = processors.DataHandler(pa(spark, d), processors.HandlerConfig(shared=steps[:1], learn=steps[1:], feature_cols=["ret_csz", "x"]))
    return shown(handler.fetch("learn", "features"), "ret_csz", "x", digits=5)


@query("mask", f"{_PA} SELECT asset, {_T}, x IS NOT NULL AS known FROM pa")
def mask(spark, d):
    p = pa(spark, d)
    return p.df.select("asset", F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"), p.mask("x").alias("known"))


# ---- backtests ---------------------------------------------------------------------------------


def _run(spark, d, strategy, **settings) -> DataFrame:
    return backtest.run(pc(spark, d), {"s": strategy}, **settings)


_BARS = "WITH b AS (SELECT event_type AS asset, date_trunc('hour', ts) AS time, arg_min(value, (ts, event_id)) AS open, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY 1, 2), t AS (SELECT DISTINCT time FROM b)"
_NO = f"{_BARS} SELECT {_T}, 100000.0::DOUBLE AS value FROM t"
query("bt_no_trades", _NO)(lambda spark, d: shown(_run(spark, d, backtest.NoTrades()), "value", keys=("time",)))


def _simulated(commissions: list[float], orders: str) -> str:
    """The event loop as a recursion over bars: cash, positions and waiting orders (asset, quantity,
    sign) as lists.  ``orders``: a list of new ones, from the row s (state) and the bars g (this one,
    with closes of ``w`` bars before) and h (the next)."""
    fill = """list_reduce(list_concat([{'cash': s.cash, 'pos': s.pos, 'rest': []::STRUCT(i BIGINT, n DOUBLE, sgn INTEGER)[], 'i': 0::BIGINT, 'n': 0::DOUBLE, 'sgn': 0, 'p': 0::DOUBLE}],
      list_transform(list_concat(s.queue, s.fresh), lambda q: {'cash': 0::DOUBLE, 'pos': []::DOUBLE[], 'rest': []::STRUCT(i BIGINT, n DOUBLE, sgn INTEGER)[], 'i': q.i, 'n': q.n, 'sgn': q.sgn, 'p': s.opens[q.i]})),
      lambda a, x: {'cash': CASE WHEN x.p > 0 AND (x.sgn < 0 OR least(x.n, a.cash / (x.p * (1 + s.rate))) >= 1e-6) THEN a.cash - (x.sgn + s.rate) * x.p * CASE WHEN x.sgn > 0 THEN least(x.n, a.cash / (x.p * (1 + s.rate))) ELSE x.n END ELSE a.cash END,
        'pos': CASE WHEN x.p > 0 AND (x.sgn < 0 OR least(x.n, a.cash / (x.p * (1 + s.rate))) >= 1e-6) THEN list_transform(a.pos, lambda v, j: CASE WHEN j = x.i THEN coalesce(v, 0) + x.sgn * CASE WHEN x.sgn > 0 THEN least(x.n, a.cash / (x.p * (1 + s.rate))) ELSE x.n END ELSE v END) ELSE a.pos END,
        'rest': CASE WHEN coalesce(x.p, 0) > 0 THEN a.rest ELSE list_append(a.rest, {'i': x.i, 'n': x.n, 'sgn': x.sgn}) END, 'i': 0::BIGINT, 'n': 0::DOUBLE, 'sgn': 0, 'p': 0::DOUBLE})"""
    rates = ", ".join(f"{c!r}::DOUBLE" for c in commissions)
    return f"""WITH RECURSIVE b AS (SELECT event_type AS asset, date_trunc('hour', ts) AS time, arg_min(value, (ts, event_id)) AS open, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY 1, 2),
  t AS (SELECT time, row_number() OVER (ORDER BY time) AS k, count(*) OVER () AS last FROM (SELECT DISTINCT time FROM b)), n AS (SELECT asset, row_number() OVER (ORDER BY asset) AS i FROM (SELECT DISTINCT asset FROM b)),
  c AS (SELECT t.k, t.time, t.last, n.i, b.open, coalesce(last_value(b.close IGNORE NULLS) OVER (PARTITION BY n.i ORDER BY t.k ROWS UNBOUNDED PRECEDING), 0) AS close FROM t CROSS JOIN n LEFT JOIN b ON b.time = t.time AND b.asset = n.asset),
  g AS (SELECT k, time, last, list(open ORDER BY i) AS opens, list(close ORDER BY i) AS closes FROM c GROUP BY 1, 2, 3),
  bars AS (SELECT g.*, lead(opens) OVER (ORDER BY k) AS next_opens, lead(closes) OVER (ORDER BY k) AS next_closes, lag(closes, 5) OVER (ORDER BY k) AS old FROM g),
  r AS (SELECT unnest([{rates}]) AS rate),
  z AS (SELECT 0::BIGINT AS k, rate, 100000.0::DOUBLE AS cash, list_transform(closes, lambda v: NULL::DOUBLE) AS pos, []::STRUCT(i BIGINT, n DOUBLE, sgn INTEGER)[] AS queue, 100000.0::DOUBLE AS value FROM r, bars WHERE k = 1
    UNION ALL SELECT k, rate, f.cash, f.pos, f.rest, f.cash + list_sum(list_transform(f.pos, lambda v, j: coalesce(v, 0) * closes[j])) FROM (
      SELECT s.k, s.rate, s.closes, {fill} AS f FROM (
        SELECT s.*, g.k AS at, g.next_opens AS opens, g.next_closes AS closes, {orders} AS fresh FROM (SELECT * EXCLUDE (k), k + 1 AS k FROM z) s JOIN bars g ON g.k = s.k WHERE g.k < g.last) s)),
  path AS (SELECT g.time, z.rate, z.cash, z.value FROM z JOIN bars g ON z.k = g.k UNION ALL SELECT g.time, z.rate, z.cash, z.value FROM z JOIN bars g ON g.k = g.last AND z.k = g.last - 1)"""


_NONE = "[]::STRUCT(i BIGINT, n DOUBLE, sgn INTEGER)[]"
#: All cash, split evenly, while nothing is held.
_HOLD = f"CASE WHEN len(list_filter(s.pos, lambda v: v IS NOT NULL)) > 0 THEN {_NONE} ELSE list_filter(list_transform(g.closes, lambda v, j: {{'i': j, 'n': CASE WHEN v > 0 THEN s.cash / len(g.closes) / v END, 'sgn': 1}}), lambda q: q.n IS NOT NULL) END"
#: Sell all but the best of the last six bars, buy that for the whole value.
_CHANGE = "list_transform(g.closes, lambda v, j: CASE WHEN g.old[j] > 0 THEN v / g.old[j] - 1 ELSE '-infinity'::DOUBLE END)"
_TOP = f"list_position({_CHANGE}, list_max({_CHANGE}))"
_HELD = "list_filter(list_transform(s.pos, lambda v, j: {'i': j, 'n': v, 'sgn': -1}), lambda q: q.n > 1e-9)"
_BEST = f"""CASE WHEN g.old IS NULL OR (len({_HELD}) = 1 AND {_HELD}[1].i = {_TOP}) THEN {_NONE} ELSE list_concat(list_filter({_HELD}, lambda q: q.i <> {_TOP}),
  CASE WHEN g.closes[{_TOP}] > 0 AND s.value > 0 THEN [{{'i': {_TOP}::BIGINT, 'n': s.value / g.closes[{_TOP}], 'sgn': 1}}] ELSE {_NONE} END) END"""


@query("bt_buy_hold", f"""{_simulated([0.001], _HOLD)}, l AS (SELECT *, coalesce(ln(value / lag(value) OVER (ORDER BY time)), 0) AS g FROM path)
  SELECT 's' AS run, {_T}, {_r('cash', 'cash', 4)}, {_r('value', 'value', 4)}, {_r('sum(g) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING)', 'cumulative_log_return', 4)} FROM l""")
def bt_buy_hold(spark, d):
    return shown(backtest.log_returns(_run(spark, d, backtest.BuyAndHold(), commissions=0.001), ["run", "commission"]), "cash", "value", "cumulative_log_return", keys=("run", "time"), digits=4)


@query("bt_momentum", f"{_simulated([0.001], _BEST)} SELECT 's' AS run, {_T}, {_r('cash', 'cash', 4)}, {_r('value', 'value', 4)} FROM path")
def bt_momentum(spark, d):
    return shown(_run(spark, d, backtest.Momentum(6), commissions=0.001), "cash", "value", keys=("run", "time"), digits=4)


@query("bt_commission_grid", f"{_simulated([0.0, 0.001, 0.01], _BEST)} SELECT 's' AS run, {_T}, {_r('rate', 'commission', 4)}, {_r('value', 'value', 4)} FROM path")
def bt_commission_grid(spark, d):
    return shown(_run(spark, d, backtest.Momentum(6), commissions=[0.0, 0.001, 0.01]), "commission", "value", keys=("run", "time"), digits=4)


def _path(spark, d) -> DataFrame:
    """Supplier sizes as value paths."""
    return pa(spark, d).df.select("asset", "time", F.col("me").alias("value"))


_PATH = f"{_PA}, p AS (SELECT asset, time, me AS value, lag(me) {_W} AS before, max(me) OVER (PARTITION BY asset ORDER BY time ROWS UNBOUNDED PRECEDING) AS top FROM pa)"
_RATE = "(power(1.01, 1.0 / 252) - 1)"
_METRIC = {
    "profit_factor": "CASE WHEN coalesce(sum(greatest(before - value, 0)), 0) > 0 THEN coalesce(sum(greatest(value - before, 0)), 0) / sum(greatest(before - value, 0)) WHEN sum(greatest(value - before, 0)) > 0 THEN 'infinity'::DOUBLE ELSE 1 END",
    "sharpe": f"CASE WHEN count(before) >= 2 THEN coalesce(avg(value / before - 1 - {_RATE}) / nullif(stddev_samp(value / before - 1 - {_RATE}), 0) * sqrt(252), 0) ELSE 0 END",
    "max_drawdown": "min(value / top - 1)",
    "ulcer_index": "sqrt(avg(power((value / top - 1) * 100, 2)))",
    "martin_ratio": f"CASE WHEN sqrt(avg(power((value / top - 1) * 100, 2))) > 0 THEN avg(value / before - 1 - {_RATE}) / sqrt(avg(power((value / top - 1) * 100, 2))) WHEN avg(value / before - 1 - {_RATE}) > 0 THEN 'infinity'::DOUBLE ELSE 0 END",
}
for _name, _sql in _METRIC.items():
    query(f"metric_{_name}", f"{_PATH} SELECT asset, {_r(_sql)} FROM p GROUP BY asset")(
        lambda spark, d, n=_name: shown(backtest.METRICS[n](_path(spark, d), ["asset"]).withColumnRenamed(n, "value"), "value", keys=("asset",))
    )

__all__ = ["Axis", "QUERIES", "SQL", "flagship"]
