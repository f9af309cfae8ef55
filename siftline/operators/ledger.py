"""A table that batches are committed to: all of a batch or nothing of it, once, with a tally of its rows.

A batch is staged under a name of its own attempt and becomes visible by the rename
of one small manifest; readers read what manifests name.  A task that is run
again, a driver that dies half way and a batch that is sent twice leave the table
as it was.  Manifests are one short file per batch.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a batch's run comes to.
COMPLETED, PARTIAL, FAILED = "COMPLETED", "PARTIAL", "FAILED"


class Ledger:
    """Batches of rows under a root folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path("commits"))

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def manifests(self) -> list[dict]:
        """What has been committed, in order."""
        found = [s.getPath() for s in self.fs.listStatus(self._path("commits")) if s.getPath().getName().endswith(".json")]
        out = []
        for path in found:
            stream = self.fs.open(path)
            out.append(json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()))
            stream.close()
        return sorted(out, key=lambda m: m["version"])

    def _commit(self, manifest: dict) -> bool:
        """Make a manifest visible, unless its batch already is."""
        staged, at = self._path(f"commits/.{uuid.uuid4().hex}"), self._path(f"commits/{manifest['batch']}.json")
        stream = self.fs.create(staged, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        won = not self.fs.exists(at) and self.fs.rename(staged, at)
        if not won:
            self.fs.delete(staged, False)
        return bool(won)

    def _known(self, batch: str) -> dict | None:
        return next((m for m in self.manifests() if m["batch"] == batch), None)

    def append(self, df: DataFrame, batch: str, checks: dict[str, Column] | None = None, dry: bool = False) -> dict:
        """Commit a batch: rows that pass all checks are added, the others kept apart with the names of what they failed.

        Returns the tally.  A dry run counts and writes nothing; a batch that is known
        is not written again and gives the tally it had.
        """
        if (known := self._known(batch)) is not None:
            return known
        failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in (checks or {}).items()])) if checks else F.array().cast("array<string>")
        judged = df.withColumn("__failed", failed)
        if dry:
            n = judged.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.size("__failed") == 0, 1)).alias("good")).first()
            return self._tally(batch, n["good"], n["n"] - n["good"], {}, None, 0)
        attempt = uuid.uuid4().hex[:12]
        at = f"data/{batch}-{attempt}"
        judged.withColumn("__bad", F.size("__failed") > 0).write.partitionBy("__bad").parquet(f"{self.root}/{at}")
        stored = self.spark.read.schema(judged.schema.add("__bad", "boolean")).parquet(f"{self.root}/{at}")
        counts = stored.filter("__bad").select(F.explode("__failed").alias("why")).groupBy("why").agg(F.count(F.lit(1)).alias("n")).collect()
        total = {r["__bad"]: r["n"] for r in stored.groupBy("__bad").agg(F.count(F.lit(1)).alias("n")).collect()}
        why = {r["why"]: r["n"] for r in counts}
        manifest = self._tally(batch, total.get(False, 0), total.get(True, 0), why, at, len(self.manifests()) + 1)
        if self._commit(manifest):
            return manifest
        self.fs.delete(self._path(at), True)
        return self._known(batch)

    @staticmethod
    def _tally(batch: str, good: int, bad: int, why: dict, at: str | None, version: int) -> dict:
        status = COMPLETED if bad == 0 else PARTIAL if good else FAILED
        return {"batch": batch, "written": good, "rejected": bad, "reasons": why, "status": status, "at": at, "version": version}

    def upsert(self, df: DataFrame, batch: str, key: list[str], protected: list[str] | None = None) -> dict:
        """Commit a new state: incoming rows (one per key) replace those of their key, protected columns stay as they were.

        The manifest counts what was created, updated and left unchanged.
        """
        if (known := self._known(batch)) is not None:
            return known
        columns, kept = df.columns, protected or []
        state = self.state()
        old = (state if state is not None else df.limit(0)).select(*[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__old"))
        new = df.withColumn("__new", F.lit(True))
        both = new.join(old, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__{k}") for k in key]), "full_outer")
        there, here = F.col("__old").isNotNull(), F.col("__new").isNotNull()
        value = lambda c: F.when(here & ~(there & F.lit(c in kept)), F.col(c)).otherwise(F.col(f"__{c}")).alias(c)
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns if c not in kept])
        action = F.when(~there, "created").when(~here, "absent").when(same, "unchanged").otherwise("updated")
        at = f"state/{batch}-{uuid.uuid4().hex[:12]}"
        both.select(*[value(c) for c in columns], action.alias("__action")).write.partitionBy("__action").parquet(f"{self.root}/{at}")
        schema = df.schema.add("__action", "string")
        n = {r["__action"]: r["n"] for r in self.spark.read.schema(schema).parquet(f"{self.root}/{at}").groupBy("__action").agg(F.count(F.lit(1)).alias("n")).collect()}
        manifest = {"batch": batch, "state": at, "schema": df.schema.json(), "status": COMPLETED, "version": len(self.manifests()) + 1, **{a: n.get(a, 0) for a in ("created", "updated", "unchanged", "absent")}}
        if self._commit(manifest):
            return manifest
        self.fs.delete(self._path(at), True)
        return self._known(batch)

    def state(self) -> DataFrame | None:
        """The table after the last upsert."""
        from pyspark.sql.types import StructType

        last = [m for m in self.manifests() if "state" in m]
        if not last:
            return None
        schema = StructType.fromJson(json.loads(last[-1]["schema"]))
        return self.spark.read.schema(schema).parquet(f"{self.root}/{last[-1]['state']}").drop("__action")

    def rows(self, rejected: bool = False) -> DataFrame | None:
        """Rows of all committed batches; or those kept apart, with __failed."""
        paths = [f"{self.root}/{m['at']}" for m in self.manifests() if m.get("at")]
        if not paths:
            return None
        out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self.spark.read.parquet(p) for p in paths]).filter(F.col("__bad").cast("boolean") == rejected)
        return out.drop("__bad") if rejected else out.drop("__bad", "__failed")


def synced(wanted: DataFrame, present: DataFrame, key: str, check: Column) -> DataFrame:
    """Each wanted row with what a sync to a sheet does: append, skip (already there) or fail (check), row by row."""
    there = present.select(F.col(key).alias("__key")).distinct().withColumn("__there", F.lit(True))
    out = wanted.join(there, F.col(key) == F.col("__key"), "left")
    status = F.when(F.col("__there").isNotNull(), "skipped").when(~F.coalesce(check, F.lit(False)), "failed").otherwise("appended")
    return out.withColumn("sync", status).drop("__key", "__there")
