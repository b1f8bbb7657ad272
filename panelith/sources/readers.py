"""Readers: files to tables, tables to panels, by provider and configuration."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters
from ..operators.joins import external_tables, link_range, publication_date
from ..operators.panel import Panel, from_table, sas_date, simulated
from ..operators.processors import apply_transforms
from ..plans.cache import Cache, Stage, input_files

Loader = Callable[[SparkSession, "SourceConfig"], DataFrame]


@dataclass
class SourceConfig:
    provider: str
    dataset: str
    path: str | None = None
    frequency: str = "daily"
    start: str | None = None
    end: str | None = None
    time: str = "date"
    identifier: str = "identifier"
    columns: list[str] | None = None
    symbols: list[str] | None = None
    filters: dict | list = field(default_factory=dict)
    external_tables: list[dict] = field(default_factory=list)
    processors: list | dict = field(default_factory=list)
    options: dict = field(default_factory=dict)

    @classmethod
    def of(cls, raw: dict) -> SourceConfig:
        raw = dict(raw)
        schema = raw.pop("schema", {}) or {}
        names = {"time_var": "time", "identifier_var": "identifier", "start_date": "start", "end_date": "end", "columns_to_read": "columns"}
        raw = {names.get(k, k): v for k, v in {**raw, **schema}.items()}
        unknown = set(raw) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown settings of a source: {sorted(unknown)}")
        if "provider" not in raw or "dataset" not in raw:
            raise ValueError("a source has a provider and a dataset")
        return cls(**{k: v for k, v in raw.items() if v is not None})


# ---- providers ---------------------------------------------------------------------------------


@dataclass
class Provider:
    name: str
    loaders: dict[str, Loader] = field(default_factory=dict)

    def register(self, dataset: str):
        def put(f: Loader) -> Loader:
            self.loaders[dataset] = f
            return f

        return put

    def loader(self, dataset: str) -> Loader:
        for known in (dataset, dataset.split("/")[0], "*"):
            if known in self.loaders:
                return self.loaders[known]
        raise KeyError(f"provider {self.name!r} has no dataset {dataset!r}")


PROVIDERS: dict[str, Provider] = {}


def register_provider(name: str) -> Provider:
    return PROVIDERS.setdefault(name, Provider(name))


def get_provider(name: str) -> Provider:
    if name not in PROVIDERS:
        raise KeyError(f"no provider {name!r}; there are {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name]


# ---- tables ------------------------------------------------------------------------------------


def lowered(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def numbers(df: DataFrame, keep: list[str]) -> DataFrame:
    """All other columns as doubles; what is no number is missing."""
    return df.select(*[F.col(c) if c in keep else F.expr(f"try_cast(`{c}` as double)").alias(c) for c in df.columns])


def file_table(spark: SparkSession, config: SourceConfig, default: str = "parquet") -> DataFrame:
    if not config.path:
        raise ValueError(f"{config.provider}/{config.dataset}: no path")
    kind = config.options.get("format") or next((k for k in ("csv", "parquet", "json", "orc") if config.path.rstrip("/").endswith(k)), default)
    reader = spark.read.options(**{k: v for k, v in config.options.items() if k != "format"})
    return reader.option("header", True).csv(config.path) if kind == "csv" else reader.format(kind).load(config.path)


def headers(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(path, first line) of the CSV files in a folder, on any file system Spark knows."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    paths = sorted(s.getPath().toString() for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(at, "*.csv")) or [])

    def first(path: str) -> str:
        try:
            reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(jvm.org.apache.hadoop.fs.Path(path)), "UTF-8"))
        except Py4JJavaError:
            return ""
        try:
            return reader.readLine() or ""
        finally:
            reader.close()

    with ThreadPoolExecutor(16) as pool:
        return list(zip(paths, pool.map(first, paths)))


def market_csv(spark: SparkSession, config: SourceConfig) -> DataFrame:
    """A folder of CSV files, one a symbol (the file's name), each read by its own header; columns
    that a file lacks and values that are no numbers are missing.

    The headers (first lines) are read first, on the driver, some bytes a file; files of one header
    are one scan, and the scans are put together by name.  Files that cannot be read or have no
    header are skipped.
    """
    by_header: dict[str, list[str]] = {}
    for path, header in headers(spark, config.path):
        if header.strip() and (not config.symbols or path.rsplit("/", 1)[-1].removesuffix(".csv") in config.symbols):
            by_header.setdefault(header, []).append(path)
    out = None
    for _, files in sorted(by_header.items()):
        df = lowered(spark.read.options(header=True, mode="PERMISSIVE", ignoreCorruptFiles=True, enforceSchema=False).csv(files))
        df = df.withColumn("identifier", F.regexp_extract(F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))), r"(.+)\.csv$", 1))
        df = df.withColumnRenamed("datetime", "date") if "date" not in df.columns and "datetime" in df.columns else df
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], "date timestamp_ntz, identifier string")
    if config.columns:
        out = out.select("date", "identifier", *[c.lower() for c in config.columns if c.lower() not in ("date", "identifier")])
    out = out.withColumn("date", F.expr("try_cast(date as timestamp_ntz)"))
    return numbers(out, ["date", "identifier"])


def generic_table(spark: SparkSession, config: SourceConfig) -> DataFrame:
    df = lowered(file_table(spark, config))
    return df.select(*[c.lower() for c in config.columns]) if config.columns else df


def stock_table(spark: SparkSession, config: SourceConfig) -> DataFrame:
    """Daily or monthly stock files (``dsf``, ``msf`` below the path); the identifier is permno."""
    name = {"d": "dsf", "m": "msf"}.get(config.frequency[:1].lower())
    if name is None:
        raise ValueError(f"no stock file of frequency {config.frequency!r}")
    at = SourceConfig(**{**config.__dict__, "path": f"{config.path.rstrip('/')}/{name}.{config.options.get('format', 'parquet')}"})
    df = generic_table(spark, at)
    return df.withColumns({c: F.col(c).cast("bigint") for c in ("permno", "permco", "shrcd", "exchcd") if c in df.columns})


def fundamentals_table(spark: SparkSession, config: SourceConfig) -> DataFrame:
    """Annual fundamentals with the linked identifier; dates become the year's end.

    ``options.link`` is the path of the link table.  Adds count, the number of earlier rows of the
    company.
    """
    from pyspark.sql import Window

    link = config.options.get("link")
    slim = SourceConfig(**{**config.__dict__, "options": {k: v for k, v in config.options.items() if k != "link"}})
    df = generic_table(spark, slim)
    df = df.withColumn("count", F.row_number().over(Window.partitionBy("gvkey").orderBy("datadate")) - 1)
    if link:
        links = lowered(spark.read.parquet(link)).withColumnRenamed("lpermno", "permno")
        df = link_range(df, links, "gvkey", publication_date(F.year("datadate")), "permno")
    return df.withColumn("date", F.make_date(F.year("datadate"), F.lit(12), F.lit(31)).cast("timestamp_ntz"))


register_provider("crypto").register("*")(market_csv)
register_provider("files").register("*")(generic_table)
register_provider("wrds").loaders.update({"crsp": stock_table, "compustat": fundamentals_table, "*": generic_table})


def days_to_time(days: Column) -> Column:
    return sas_date(days).cast("timestamp_ntz")


# ---- sources to panels -------------------------------------------------------------------------


class DataManager:
    """Loads configured sources as panels.

    Order: read, times, date range, external tables, filters (which may use looked-up columns),
    panel, transforms.  Loads are kept by configuration and input files for the life of the manager.

    With a cache, two levels are stored by content: the table as read within its dates (L1), and the
    panel after everything else (L2).  Their keys hold the settings, dates included, and names,
    sizes and times of the files read.
    """

    def __init__(self, spark: SparkSession, cache: Cache | None = None):
        self.spark, self.cache, self._kept = spark, cache, {}

    def inputs(self, config: SourceConfig) -> list[list]:
        return input_files(self.spark, [config.path, config.options.get("link"), *(t.get("path") for t in config.external_tables)])

    def raw(self, config: SourceConfig) -> DataFrame:
        """The table as its loader gives it, with times, within the dates."""
        df = get_provider(config.provider).loader(config.dataset)(self.spark, config)
        kind = dict(df.dtypes)[config.time]
        stamp = days_to_time(F.col(config.time)) if kind in ("double", "float", "int", "bigint") else F.col(config.time).cast("timestamp_ntz")
        df = df.withColumn(config.time, stamp)
        return filters.apply(df, [{"type": "date_range_filter", "date_column": config.time, "start_date": config.start, "end_date": config.end}])

    def table(self, config: SourceConfig, raw: DataFrame | None = None) -> DataFrame:
        df = self.raw(config) if raw is None else raw
        df = external_tables(df, config.external_tables, lambda p: lowered(self.spark.read.parquet(p)), config.identifier, config.time)
        return filters.apply(df, config.filters)

    def load(self, config: SourceConfig | dict) -> Panel:
        config = config if isinstance(config, SourceConfig) else SourceConfig.of(config)
        state = [config.__dict__, self.inputs(config)]
        key = yaml.safe_dump(state, sort_keys=True)
        if key not in self._kept:
            self._kept[key] = self._stored(config, state) if self.cache else self._made(config)
        return self._kept[key]

    def _made(self, config: SourceConfig, raw: DataFrame | None = None) -> Panel:
        return apply_transforms(from_table(self.table(config, raw), config.time, config.identifier, frequency=config.frequency), config.processors)

    def _stored(self, config: SourceConfig, state: list) -> Panel:
        early = {k: v for k, v in config.__dict__.items() if k not in ("filters", "external_tables", "processors")}
        raw, first = self.cache.get_or_compute(Stage.L1_RAW, [early, input_files(self.spark, [config.path, config.options.get("link")])], lambda: self.raw(config))
        df, _ = self.cache.get_or_compute(Stage.L2_POSTPROCESSED, state, lambda: self._made(config, raw).df, [first])
        return Panel(df)

    def load_all(self, sources: dict[str, SourceConfig | dict]) -> dict[str, Panel]:
        return {k: self.load(v) for k, v in sources.items()}

    def load_file(self, path: str | Path) -> dict[str, Panel]:
        return self.load_all(load_sources(path))

    def load_builtin(self, name: str, **changes) -> dict[str, Panel]:
        return self.load_all({k: SourceConfig(**{**v.__dict__, **changes}) for k, v in load_sources(builtin(name)).items()})

    def simulated(self, **settings) -> Panel:
        return simulated(self.spark, **settings)


def builtin(name: str) -> Path:
    path = Path(__file__).with_name("configs") / f"{name}.yaml"
    if not path.exists():
        raise KeyError(f"no built-in configuration {name!r}; there are {', '.join(sorted(p.stem for p in path.parent.glob('*.yaml')))}")
    return path


def load_sources(path: str | Path) -> dict[str, SourceConfig]:
    """Sources of a YAML file: {data: {start_date, end_date, sources: {name: settings}}}."""
    data = yaml.safe_load(Path(path).read_text())["data"]
    common = {k: str(data[k]) for k in ("start_date", "end_date") if k in data}
    return {name: SourceConfig.of({**common, **raw}) for name, raw in data["sources"].items()}


class SourceBuilder:
    """Sources put together in code."""

    def __init__(self, start: str, end: str):
        self.common, self.sources = {"start_date": start, "end_date": end}, {}

    def add(self, name: str, provider: str, dataset: str, **settings) -> SourceBuilder:
        self.sources[name] = SourceConfig.of({**self.common, "provider": provider, "dataset": dataset, **settings})
        return self

    def build(self) -> dict[str, SourceConfig]:
        return dict(self.sources)
