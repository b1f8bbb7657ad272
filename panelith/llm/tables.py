"""Small shared helpers: reading tables, Arrow maps, shared folders."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tokenizer files are found through the installed package of public vocabularies.
BYTE_FILE, WORD_FILE = "byte_bpe_50k.json", "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod5(id_col: str):
    """crc32 of the id as text, mod 5 (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors and the driver share.

    Where the setting is absent (tests, local runs) a folder below the warehouse is used and
    recorded as the session's checkpoint folder.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Sets the context's checkpoint folder from spark.checkpoint.dir if nobody has."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if base:
            sc.setCheckpointDir(base)
        else:
            shared_folder(spark, "unused")


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: a cut in the lineage that survives
    lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, make, schema: str, rows: int = 1024) -> DataFrame:
    """``make()`` runs once a task and gives a function from one Arrow batch to another; it gets
    at most ``rows`` rows at a time, which bounds the Python objects made of them."""

    def run(batches):
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield f(batch.slice(at, rows))

    return df.mapInArrow(run, schema)


#: Keys that hold more than a 1/HOT of all rows count as hot: there are fewer than HOT of them.
HOT = 1000


def join_hot(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join of ``rows`` with ``keyed`` (stored; one row a key, with the number of rows that
    have it in column ``count``), where some keys may hold a large share of all rows.

    Hot keys are fewer than ``HOT``, so they are broadcast; their rows are spread by a hash of the
    whole row and meet nothing in the shuffle that joins the others.
    """
    total, most = keyed.agg(F.sum(count), F.max(count)).first()
    if not total or most * HOT <= total:
        return rows.join(keyed, keys)
    is_hot, values = F.col(count) * HOT > total, F.struct(*[c for c in keyed.columns if c not in keys])
    few, rest, salt, other, *names = free_names(rows, "few", "rest", "salt", "other", *(f"key{i}" for i in range(len(keys))))
    hot = keyed.where(is_hot).limit(HOT).select(*keys, values.alias(few))  # the limit never cuts: it states the bound
    others = keyed.where(~is_hot).select(*[F.col(k).alias(n) for k, n in zip(keys, names)], values.alias(rest))
    marked = rows.join(F.broadcast(hot), keys, "left").withColumn(salt, F.when(F.col(few).isNotNull(), F.xxhash64(*rows.columns)).otherwise(F.lit(0).cast("long")))
    # 0, but nothing that could be folded: the salt has to be a key of the shuffle
    others = others.withColumn(other, F.pmod(F.xxhash64(*names), F.lit(1).cast("long")))
    same = F.col(salt) == F.col(other)
    for k, n in zip(keys, names):
        same = same & (F.col(k) == F.col(n))
    found = marked.join(others, same, "left")
    return found.withColumn(rest, F.coalesce(few, rest)).where(F.col(rest).isNotNull()).select(*[F.col(c) for c in rows.columns], f"{rest}.*")


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """Column names that df does not have (whatever their case)."""
    taken = {c.lower() for c in df.columns}
    return [next(n for k in range(len(taken) + 1) if (n := f"{stem}_{k}") not in taken) for stem in stems]


def batch(fields: dict) -> pa.RecordBatch:
    """A batch from {name: (values, Arrow type)}."""
    arrays = [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, t) for v, t in fields.values()]
    return pa.RecordBatch.from_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays], names=list(fields))


def texts_of(b: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in b.column(b.schema.get_field_index(name)).to_pylist()]


def slices(texts: list[str], most: int = 512, chars: int = 1 << 20):
    """(from, to) of runs of texts that together have about ``chars`` characters."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars or i + 1 - a >= most:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)
