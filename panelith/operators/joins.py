"""Joins that enrich tables and merge panels of different frequency.

Lookups are plain joins: Spark broadcasts a side only where its size, known to the planner or
seen at run time, is below its threshold, and sorts and merges otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import Panel


def last_of(right: DataFrame, keys: list[str], columns: list[str], order: list[str] | None = None) -> DataFrame:
    """One row a key: the last by ``order`` and then by the columns."""
    keep = [c for c in columns if c not in keys]
    return right.groupBy(*keys).agg(F.max(F.struct(*(order or []), *keep)).alias("__x")).select(*keys, *[F.col(f"__x.{c}").alias(c) for c in keep])


def lookup(left: DataFrame, right: DataFrame, on: str, columns: list[str], order: list[str] | None = None) -> DataFrame:
    """Static columns by key; columns that the left side has already are replaced."""
    right = last_of(right, [on], columns, order)
    return left.drop(*[c for c in columns if c != on]).join(right, on, "left")


def replace_values(left: DataFrame, right: DataFrame, on: str, time: str, right_time: str, source: str, target: str, order: list[str] | None = None) -> DataFrame:
    """``target`` becomes ``source`` of the same key and time where there is one."""
    keyed = right.select(F.col(on), F.col(right_time).alias(time), F.col(source).alias("__new"), *(order or []))
    fresh = last_of(keyed, [on, time], ["__new"], order)
    return left.join(fresh, [on, time], "left").withColumn(target, F.coalesce("__new", target)).drop("__new").select(*left.columns)


def timeseries(left: DataFrame, right: DataFrame, on: str, time: str, right_time: str, columns: list[str], order: list[str] | None = None) -> DataFrame:
    """Columns of the same key and time."""
    keyed = right.select(F.col(on), F.col(right_time).alias(time), *columns, *[c for c in order or [] if c not in columns])
    return left.drop(*columns).join(last_of(keyed, [on, time], columns, order), [on, time], "left")


def external_tables(df: DataFrame, tables: list[dict], read, id_column: str, time_column: str) -> DataFrame:
    """A chain of the three joins above; each has ``path`` (for read), ``type`` and its settings."""
    for t in tables:
        right, kind, on = read(t["path"]), t.get("type", "lookup"), t.get("on", id_column)
        if kind == "lookup":
            df = lookup(df, right, on, t["columns"])
        elif kind == "replace":
            df = replace_values(df, right, on, time_column, t["time_column"], t["from_column"], t["to_column"])
        elif kind == "timeseries":
            df = timeseries(df, right, on, time_column, t["time_column"], t["columns"])
        else:
            raise ValueError(f"unknown kind of table {kind!r}")
    return df


def link_range(left: DataFrame, links: DataFrame, on: str, at: Column, identifier: str, start: str = "linkdt", end: str = "linkenddt", today: Column | None = None) -> DataFrame:
    """Identifiers that hold on a date: an equi join on the key with the range as a residual.

    Only links of type L... that are primary (C or P) count; an open end is today.  Rows without
    an identifier go.
    """
    good = links.where(F.col("linktype").startswith("L") & F.col("linkprim").isin("C", "P") & F.col(identifier).isNotNull()).select(F.col(on).alias("__k"), F.col(identifier).alias("__new"), F.col(start).alias("__from"), F.coalesce(F.col(end), today if today is not None else F.current_timestamp().cast("timestamp_ntz")).alias("__to"))
    out = left.drop(identifier).withColumn("__at", at).join(good, (F.col(on) == F.col("__k")) & F.col("__at").between(F.col("__from"), F.col("__to")))
    return out.withColumn(identifier, F.col("__new")).drop("__k", "__new", "__from", "__to", "__at")


def publication_date(year: Column, months: int = 6) -> Column:
    """The month end ``months`` after a year's end."""
    return F.last_day(F.add_months(F.make_date(year, F.lit(12), F.lit(31)), months)).cast("timestamp_ntz")


# ---- panels of different frequency -------------------------------------------------------------


class Alignment(Enum):
    EXACT = "exact"
    FFILL = "ffill"
    AS_OF = "as_of"
    BFILL = "bfill"
    NEAREST = "nearest"


class Method(Enum):
    LEFT = "left"
    RIGHT = "right"
    INNER = "inner"
    OUTER = "outer"


@dataclass(frozen=True)
class MergeSpec:
    alignment: Alignment | str = Alignment.AS_OF
    method: Method | str = Method.LEFT
    offset_months: int = 0
    prefix: str = ""
    suffix: str = ""
    variables: list[str] | None = None
    drop: list[str] = field(default_factory=list)
    limit: int | None = None  # EXACT to AS_OF: rows of the left side that a value lasts at most
    grain: str | None = None  # the right side's own frequency: year or month


def same_key(left: DataFrame, right: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Keys of unequal type become whole numbers where they read as such (``7``, ``7.0``), else
    hashes of their text; fractions stay apart from whole numbers."""
    a, b = dict(left.dtypes)[name], dict(right.dtypes)[name]
    if a == b:
        return left, right
    if {a, b} <= {"tinyint", "smallint", "int", "bigint"}:
        return left.withColumn(name, F.col(name).cast("bigint")), right.withColumn(name, F.col(name).cast("bigint"))

    def key(c: str):
        text, number = F.col(c).cast("string"), F.expr(f"try_cast(`{c}` as double)")
        whole = F.when(number == F.floor(number), F.expr(f"coalesce(try_cast(`{c}` as bigint), try_cast(try_cast(`{c}` as double) as bigint))"))
        return F.when(text.isNotNull(), F.coalesce(whole, F.xxhash64(F.when(number.isNotNull(), number.cast("string")).otherwise(text))))

    return left.withColumn(name, key(name)), right.withColumn(name, key(name))


def merge(left: Panel, right: Panel, spec: MergeSpec | None = None) -> Panel:
    """right's columns on left's rows.

    On a clash of names left's column stays.  LEFT and INNER keep left's assets; RIGHT and OUTER
    are available for exact merges.  AS_OF (and FFILL, the same) takes the latest row of right at
    or before a time, BFILL the first at or after it, NEAREST the closer (the earlier of two as
    close).  An annual right side with an offset is matched by year: months up to the offset
    belong to the year before.
    """
    spec = spec or MergeSpec()
    how, alignment = Method(spec.method), Alignment(spec.alignment)
    keys = [left.asset, left.time]
    r = right.df.withColumnsRenamed({right.asset: left.asset, right.time: left.time})
    names = [c for c in (spec.variables or right.features) if c not in spec.drop]
    renamed = {c: f"{spec.prefix}{c}{spec.suffix}" for c in names}
    r = r.select(*keys, *[F.col(c).alias(n) for c, n in renamed.items() if n not in left.df.columns])
    l, r = same_key(left.df, r, left.asset)
    new = [c for c in r.columns if c not in keys]
    if spec.grain == "year" and (spec.offset_months or alignment == Alignment.EXACT):
        out = _by_year(left, l, r, new, spec.offset_months, how)
    elif alignment == Alignment.EXACT:
        if spec.grain == "month":
            month = F.date_trunc("month", F.col(left.time)).cast("timestamp_ntz")
            r = r.withColumn(left.time, month).withColumnRenamed(left.time, "__g")
            out = l.withColumn("__g", month).join(r, [left.asset, "__g"], "inner" if how == Method.INNER else "left").drop("__g")
        else:
            out = l.join(r, keys, {"outer": "full"}.get(how.value, how.value))
    else:
        if how not in (Method.LEFT, Method.INNER):
            raise ValueError("as-of merges keep the left side's rows")
        out = _as_of(left, l, r, new, alignment, spec)
        if how == Method.INNER:
            out = out.where(F.coalesce(*[F.col(c).cast("string") for c in new]).isNotNull())
    return left.on(out.select(*keys, *left.features, *new))


def _by_year(left: Panel, l: DataFrame, r: DataFrame, new: list[str], offset: int, how: Method) -> DataFrame:
    t = F.col(left.time)
    cutoff = offset % 12
    year = F.year(t) - offset // 12 - ((F.month(t) <= cutoff).cast("int") if cutoff else F.lit(0))
    r = r.withColumn("__y", F.year(left.time)).drop(left.time)
    return l.withColumn("__y", year).join(r, [left.asset, "__y"], "inner" if how == Method.INNER else "left").drop("__y")


def _as_of(left: Panel, l: DataFrame, r: DataFrame, new: list[str], alignment: Alignment, spec: MergeSpec) -> DataFrame:
    """One union, one shuffle by asset, one sort: each left row looks at its neighbours of the
    other side."""
    a, t = left.asset, left.time
    if spec.offset_months:
        r = r.withColumn(t, F.expr(f"`{t}` + make_ym_interval(0, {int(spec.offset_months)})"))
    both = l.withColumn("__l", F.struct(*[c for c in l.columns if c not in (a, t)])).select(a, t, "__l", F.lit(None).alias("__r"), F.lit(1).alias("__s")).unionByName(
        r.select(a, t, F.lit(None).alias("__l"), F.struct(F.col(t).alias("__t"), *new).alias("__r"), F.lit(0).alias("__s"))
    )
    w = Window.partitionBy(a).orderBy(t, "__s")
    back = F.last("__r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead_order = Window.partitionBy(a).orderBy(t, F.desc("__s"))
    ahead = F.first("__r", ignorenulls=True).over(ahead_order.rowsBetween(0, Window.unboundedFollowing))
    if alignment in (Alignment.AS_OF, Alignment.FFILL):
        found = both.withColumn("__x", back)
    elif alignment == Alignment.BFILL:
        found = both.withColumn("__x", ahead)
    else:
        found = both.withColumn("__b", back).withColumn("__f", ahead)
        gap = lambda x: F.abs(F.unix_micros(F.col(t).cast("timestamp")) - F.unix_micros(F.col(f"{x}.__t").cast("timestamp")))
        found = found.withColumn("__x", F.when(F.col("__f").isNull() | (gap("__b") <= gap("__f")), F.col("__b")).otherwise(F.col("__f")))
    if spec.limit is not None:
        uses = F.row_number().over(Window.partitionBy(a, "__x.__t", "__s").orderBy(t))
        found = found.withColumn("__u", uses).withColumn("__x", F.when(F.col("__u") <= spec.limit, F.col("__x")))
    return found.where("__s = 1").select(a, t, *[F.col(f"__l.{c}").alias(c) for c in l.columns if c not in (a, t)], *[F.col(f"__x.{c}").alias(c) for c in new])


def merge_all(base: Panel, others: dict[str, Panel], merges: list[dict]) -> Panel:
    """Merges in order; an offset is months, or {"years": .., "months": ..}."""
    for m in merges:
        m = dict(m)
        name = m.pop("source", None) or m.pop("right", None)
        if name not in others:
            raise ValueError(f"merge of unknown source {name!r}")
        offset = m.pop("offset", m.pop("offset_months", 0)) or 0
        if isinstance(offset, dict):
            offset = 12 * int(offset.get("years", 0)) + int(offset.get("months", 0))
        base = merge(base, others[name], MergeSpec(offset_months=int(offset), **{k: v for k, v in m.items() if k in MergeSpec.__dataclass_fields__}))
    return base


def implicit(panels: list[Panel]) -> Panel:
    """Sources without merge rules: a full join on asset and time, the first side's columns first."""
    first, *rest = panels
    for p in rest:
        right = p.df.withColumnsRenamed({p.asset: first.asset, p.time: first.time})
        clash = [c for c in p.features if c in first.df.columns]
        joined = first.df.join(right.withColumnsRenamed({c: f"__{c}" for c in clash}), [first.asset, first.time], "full")
        first = first.on(joined.withColumns({c: F.coalesce(c, f"__{c}") for c in clash}).drop(*[f"__{c}" for c in clash]))
    return first
