"""A cache of stage results by content: a key is a hash of the stage, its settings and its parents.

Results are Parquet folders with a JSON sidecar, on whatever file system the path names.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from enum import Enum

from pyspark.sql import DataFrame, SparkSession


class Stage(Enum):
    L1_RAW = ("l1_raw", 1)
    L2_POSTPROCESSED = ("l2_postprocessed", 2)
    L3_FEATURES = ("l3_features", 3)
    L4_PREPROCESSED = ("l4_preprocessed", 4)
    L5_MODEL = ("l5_model", 5)

    @property
    def label(self) -> str:
        return self.value[0]

    @property
    def level(self) -> int:
        return self.value[1]


def input_files(spark: SparkSession, paths: list[str | None]) -> list[list]:
    """Name, size and time of change of every file below the paths: what a stored result was read
    from.  A path that is not there gives nothing."""
    out, jvm = [], spark._jvm
    for path in paths:
        if not path:
            continue
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(at):
            files = fs.listFiles(at, True)
            while files.hasNext():
                s = files.next()
                out.append([s.getPath().toString(), s.getLen(), s.getModificationTime()])
    return sorted(out)


def content_key(stage: Stage, config, parents: list[str] = ()) -> str:
    text = json.dumps([stage.label, config, sorted(parents)], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


class Cache:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.hits = self.misses = 0

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _at(self, stage: Stage, key: str) -> str:
        return f"{self.root}/{stage.label}/{key}"

    def _has(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def metadata(self, stage: Stage, key: str) -> dict | None:
        at = f"{self._at(stage, key)}/meta"
        return json.loads(self.spark.read.text(at, wholetext=True).first()[0]) if self._has(f"{at}/_SUCCESS") else None

    def get_or_compute(self, stage: Stage, config, compute: Callable[[], DataFrame], parents: list[str] = ()) -> tuple[DataFrame, str]:
        """The stored result of (stage, config, parents), written first if need be; and its key."""
        key = content_key(stage, config, list(parents))
        at = self._at(stage, key)
        if self.metadata(stage, key) is None:
            self.misses += 1
            compute().write.mode("overwrite").parquet(f"{at}/data")
            meta = {"stage": stage.label, "key": key, "config": config, "parent_keys": sorted(parents), "created": time.time()}
            self.spark.createDataFrame([(json.dumps(meta, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/meta")
        else:
            self.hits += 1
        return self.spark.read.parquet(f"{at}/data"), key

    def entries(self) -> list[dict]:
        out = []
        for stage in Stage:
            fs, p = self._fs(f"{self.root}/{stage.label}")
            if fs.exists(p):
                for s in fs.listStatus(p):
                    if meta := self.metadata(stage, s.getPath().getName()):
                        out.append(meta)
        return out

    def invalidate(self, key: str, recursive: bool = True) -> list[str]:
        """Removes a result and, with ``recursive``, all that were made from it."""
        gone, todo, known = [], [key], self.entries()
        while todo:
            k = todo.pop()
            for e in known:
                if e["key"] == k and k not in gone:
                    stage = next(s for s in Stage if s.label == e["stage"])
                    fs, p = self._fs(self._at(stage, k))
                    fs.delete(p, True)
                    gone.append(k)
            if recursive:
                todo += [e["key"] for e in known if k in e["parent_keys"] and e["key"] not in gone]
        return gone

    def stats(self) -> dict:
        by: dict[str, int] = {}
        for e in self.entries():
            by[e["stage"]] = by.get(e["stage"], 0) + 1
        return {"hits": self.hits, "misses": self.misses, "entries": by}
