"""Bulk inserts into several tables that become visible at once, or not at all.

Each table's rows are written by Spark's own writer to a folder of this attempt; nothing reads it yet. Then one small file,
the manifest of the batch, is put in place; it names the folders of all tables. Readers read what manifests name. So a job
that dies before the manifest leaves only folders that nobody sees, a task that is tried again is the writer's business, and
a batch id whose manifest exists is never inserted twice: of two runs at a time one manifest stays, and the other run's
folders stay unseen (which of the two is told that it inserted is exact where the store's rename is atomic, as HDFS's is).
All files are reached through the store's own client, wherever the path is.

Rows may be empty, and then the table exists with its columns. Tables without a batch cannot be read. vacuum() removes
folders that no manifest names; it is for times when no insert runs.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


class Store:
    """Small files and folders below a path, through Hadoop's client."""

    def __init__(self, spark: SparkSession, path: str):
        self.gateway, self.jvm, self.root = spark.sparkContext._gateway, spark.sparkContext._jvm, path.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put_once(self, name: str, text: str) -> bool:
        """Whether this call put the file there, whole. Where it is there already, it stays as it is."""
        target = self.path(name)
        if self.fs.exists(target):
            return False
        self.fs.mkdirs(target.getParent())
        draft = self.path(f"{name}.{uuid.uuid4().hex}.draft")
        stream = self.fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.fs.getConf())
        try:
            context.rename(draft, target, self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception:
            self.fs.delete(draft, False)
            if not self.fs.exists(target):
                raise
            return False
        return True

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def _manifest(batch: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_-]{1,100}", batch):
        raise ValueError("a batch id has letters, digits, _ and -")
    return f"manifests/{batch}.json"


def bulk_insert(tables: dict[str, DataFrame], path: str, batch: str) -> bool:
    """Inserts the rows of all tables as one batch; False, and nothing is done, if this batch has been inserted."""
    spark = next(iter(tables.values())).sparkSession
    store, manifest = Store(spark, path), _manifest(batch)
    if store.fs.exists(store.path(manifest)):
        return False
    attempt = f"{batch}-{uuid.uuid4().hex}"
    for name, rows in tables.items():
        rows.write.parquet(f"{store.root}/data/{name}/{attempt}")
    said = {name: {"folder": f"data/{name}/{attempt}", "schema": rows.schema.jsonValue()} for name, rows in tables.items()}
    return store.put_once(manifest, json.dumps(said))


def bulk_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows of a table in all batches that have a manifest; columns by name, null where a batch lacks one."""
    from pyspark.sql.types import StructType

    store, parts = Store(spark, path), []
    for file in store.names("manifests"):
        if file.endswith(".json"):
            held = json.loads(store.read(f"manifests/{file}")).get(name)
            if held:
                parts.append((f"{store.root}/{held['folder']}", json.dumps(held["schema"], sort_keys=True)))
    if not parts:
        raise ValueError(f"no batch of table {name}")
    by_schema: dict[str, list[str]] = {}
    for folder, schema in parts:
        by_schema.setdefault(schema, []).append(folder)
    out = None
    for schema, folders in by_schema.items():
        rows = spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*folders)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def vacuum(spark: SparkSession, path: str) -> int:
    """Removes folders and drafts that no manifest names; how many."""
    store, gone = Store(spark, path), 0
    files = store.names("manifests")
    named = {t["folder"] for f in files if f.endswith(".json") for t in json.loads(store.read(f"manifests/{f}")).values()}
    lost = [f"data/{t}/{a}" for t in store.names("data") for a in store.names(f"data/{t}") if f"data/{t}/{a}" not in named] + [f"manifests/{f}" for f in files if f.endswith(".draft")]
    for name in lost:
        store.remove(name)
        gone += 1
    return gone
