"""Recurrences along sorted rows, in one pass over each partition.

Rows are dealt out by asset and sorted by asset and time; a task then goes through its rows once,
batch by batch, and keeps one small state per recurrence, so a long history needs no more memory
than a short one and no group is ever gathered.  All recurrences of a layer share the pass.
Built-in recurrences work on whole columns; one of the user's own is called row by row.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .kernels import LinearKernel


@dataclass(frozen=True)
class Recurrence:
    name: str
    kernel: object
    columns: tuple[str, ...]


def fresh_rows(batch: pa.RecordBatch, keys: list[str], last: tuple | None) -> tuple[np.ndarray, tuple | None]:
    """Rows whose keys differ from the row before (``last``: the keys before the first)."""
    out = np.zeros(batch.num_rows, bool)
    columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
    for c in columns:
        at = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out[1:] |= at[1:] != at[:-1]
    if batch.num_rows:
        out[0] = tuple(c[0].as_py() for c in columns) != last
        last = tuple(c[-1].as_py() for c in columns)
    return out, last


def scan(df: DataFrame, assets: list[str], time: str, recurrences: list[Recurrence]) -> DataFrame:
    """Adds a double column for each recurrence."""
    schema = T.StructType([*df.schema.fields, *(T.StructField(r.name, T.DoubleType()) for r in recurrences)])

    def run(batches):
        last = None
        kernels = [copy.deepcopy(r.kernel) for r in recurrences]
        for b in batches:
            fresh, last = fresh_rows(b, assets, last)
            added = []
            for r, kernel in zip(recurrences, kernels):
                columns = [b.column(b.schema.get_field_index(c)) for c in r.columns]
                if isinstance(kernel, LinearKernel):
                    out = kernel.run(fresh, *(c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns))
                    added.append(pa.array(out, pa.float64(), mask=np.isnan(out)))
                    continue
                out = []
                for begins, values in zip(fresh.tolist(), zip(*(c.to_pylist() for c in columns))):
                    if begins:
                        kernel.start()
                    out.append(kernel.step(*values))
                added.append(pa.array(out, pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=[*b.schema.names, *(r.name for r in recurrences)])

    return df.repartition(*assets).sortWithinPartitions(*assets, time).mapInArrow(run, schema)
