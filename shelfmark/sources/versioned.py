"""A table that upserts are written to: immutable folders of rows by buckets of the key, and a manifest that is swapped whole.

A merge reads and rewrites the buckets that its changes touch, then publishes a manifest that names the folder of every
bucket. Readers see the version before or the one after. The manifest remembers the last batch of each writer, so a
micro-batch that is written again after a failure changes nothing. One writer at a time: publishing a version that is
there already fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import written


class VersionedTable:
    """root: the table's folder, in any store that Spark writes to. keys: the key's columns. keep_old: columns whose old value stays where a change has none."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: list[str], keep_old: tuple[str, ...] = (), buckets: int = 32):
        self.spark, self.root, self.schema, self.keys, self.keep_old, self.buckets = spark, root.rstrip("/"), schema, keys, keep_old, buckets

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path, fs = self._fs(f"{self.root}/manifests")
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(path) if s.getPath().getName().endswith(".json")) if fs.exists(path) else []

    def manifest(self, version: int | None = None) -> dict:
        held = self.versions()
        if not held:
            return {"version": 0, "buckets": self.buckets, "folders": {}, "batches": {}}
        path, fs = self._fs(f"{self.root}/manifests/{held[-1] if version is None else version:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        final, fs = self._fs(f"{self.root}/manifests/{manifest['version']:012d}.json")
        draft, _ = self._fs(f"{self.root}/manifests/_draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"version {manifest['version']} was written by somebody else")

    def _rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the last one); a table that was never written is empty."""
        return self._rows(list(self.manifest(version)["folders"].values()))

    def merge(self, changes: DataFrame, batch: tuple[str, int] | None = None, gone: str | None = None, wiped: tuple[str, list] | None = None) -> int:
        """Upserts changes (one row of each key; a null key is a key) and returns the version. Rows marked in the column `gone` delete their key.

        batch: a writer and its number of this batch; one that isn't above the writer's last changes nothing. wiped: a
        key column and values whose rows go first (a bounded list).
        """
        now = self.manifest()
        if batch and now["batches"].get(batch[0], -1) >= batch[1]:
            return now["version"]
        rest = [c for c in self.schema.names if c not in self.keys]
        columns = [F.col(c).cast(self.schema[c].dataType).alias(c) for c in self.schema.names]
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(now["buckets"])).cast("int")
        new = written(changes.select(*columns, F.coalesce(F.col(gone), F.lit(False)).alias("_gone") if gone else F.lit(False).alias("_gone")).withColumn("_bucket", bucket), "changes")
        touched = {str(r[0]) for r in new.select("_bucket").distinct().collect()}  # at most `buckets` numbers
        wiping = wiped is not None and bool(wiped[1])
        folders = dict(now["folders"])
        if wiping:
            touched |= set(folders)
        old = self._rows([folders[b] for b in touched if b in folders])
        if wiping:
            old = old.filter(~F.coalesce(F.col(wiped[0]).isin(*wiped[1]), F.lit(False)))
        left = old.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)], *[F.col(c).alias(f"_o_{c}") for c in rest], F.lit(True).alias("_old"))
        same = None
        for i, k in enumerate(self.keys):
            part = F.col(k).eqNullSafe(F.col(f"_k{i}"))
            same = part if same is None else same & part
        both = new.withColumn("_new", F.lit(True)).join(left, same, "full").filter("_new IS NULL OR NOT _gone")
        value = lambda c: F.when(F.col("_new"), F.coalesce(c, f"_o_{c}") if c in self.keep_old else F.col(c)).otherwise(F.col(f"_o_{c}")).alias(c)
        merged = both.select(*[F.when(F.col("_new"), F.col(k)).otherwise(F.col(f"_k{i}")).alias(k) for i, k in enumerate(self.keys)], *[value(c) for c in rest]).select(*self.schema.names)
        folder = f"{self.root}/data/{now['version'] + 1:012d}-{uuid.uuid4().hex}"
        merged.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
        path, fs = self._fs(folder)
        there = {s.getPath().getName().removeprefix("_bucket=") for s in fs.listStatus(path) if s.isDirectory()}
        for b in touched:
            folders.pop(b, None)
            if b in there:
                folders[b] = f"{folder}/_bucket={b}"
        self._publish(now | {"version": now["version"] + 1, "folders": folders, "batches": now["batches"] | ({batch[0]: batch[1]} if batch else {})})
        return now["version"] + 1

    def vacuum(self, keep: int = 2) -> int:
        """Deletes what only versions before the last `keep` name; how many folders went. Nobody may be reading those versions."""
        held = self.versions()
        named = {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for v in held[-keep:] for f in self.manifest(v)["folders"].values()}
        path, fs = self._fs(f"{self.root}/data")
        gone = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName() not in named] if held and fs.exists(path) else []
        for v in held[:-keep]:
            fs.delete(self._fs(f"{self.root}/manifests/{v:012d}.json")[0], False)
        for p in gone:
            fs.delete(p, True)
        return len(gone)
