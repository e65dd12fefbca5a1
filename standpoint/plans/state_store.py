"""Tables of a run kept under one folder over any number of batches; a batch writes what it changes.

Every table lies in segments: a base, and since then one delta a version with the rows that came and, beside them, the keys whose
rows went. Rows carry the bucket of their task (readings: of their pair), bases are partitioned by it. A manifest a version lists
the segments that make up the tables; it is one file, written last, so a version is there whole or not at all, and a batch that
runs again after a failure finds its tag in the manifest and leaves the store as it is. Readers merge: a row counts unless a later
segment names its key. Reading some tasks opens their buckets only.

A batch reads the buckets of the tasks it names (and those the clock or a new definition reaches) and writes in proportion to
what it changes, whatever the tables hold. When deltas hold ``COMPACT`` of the base's rows, the table is written anew as one base, so
each row is rewritten a bounded number of times on average. Segments that none of the last ``KEEP`` versions uses are deleted.

The driver handles a manifest (a row per segment) and bucket numbers, both bounded by parameters of the store.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from standpoint.plans.flow import Flow
from standpoint.plans.refresh import KEYS, Delta, Tables, changed_definitions, delta, full_run, passed_by
from standpoint.session import cut_lineage

BUCKETS, COMPACT, KEEP = 64, 0.25, 2
DEFINITIONS = ("predicates", "gates", "actions")
#: What the rows of a table are dealt by, and what a later segment names to take them away.
DEALT = {n: "pair" if n == "readings" else "task_id" for n in KEYS} | {n: "task_id" for n in DEFINITIONS}
GOES_BY = KEYS | {n: ["task_id"] for n in DEFINITIONS}
MANIFEST = "table string, version long, folder string, base boolean, rows long, gone long, columns string, buckets int, clock double, tag string"


class StateStore:
    """One writer at a time; readers see the last complete version."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, compact: float = COMPACT, keep: int = KEEP):
        self.spark, self.path, self.compact, self.keep = spark, path.rstrip("/"), compact, keep
        versions = self._versions()
        self.version = max(versions, default=-1)
        self.segments = self._manifest(self.version) if versions else []
        self.buckets = self.segments[0]["buckets"] if self.segments else buckets

    # ---- manifests

    def _fs(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _versions(self) -> list[int]:
        fs, folder = self._fs(), self._path("manifest")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("version=") and fs.exists(self._path("manifest", n, "_SUCCESS")))

    def _manifest(self, version: int) -> list[dict]:
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/version={version}").collect()
        return sorted((r.asDict() for r in rows), key=lambda r: (r["table"], r["version"]))

    def _commit(self, segments: list[dict], now: float | None, tag: str | None) -> None:
        version = self.version + 1
        rows = [s | {"clock": now, "tag": tag, "buckets": self.buckets} for s in segments]
        order = [c.split()[0] for c in MANIFEST.split(", ")]
        frame = self.spark.createDataFrame([tuple(r[c] for c in order) for r in rows], MANIFEST)
        frame.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")
        self.version, self.segments = version, self._manifest(version)
        self._drop_old()

    def _drop_old(self) -> None:
        fs, versions = self._fs(), self._versions()
        kept = versions[-self.keep:]
        used = {s["folder"] for v in kept for s in self._manifest(v)}
        for v in versions[:-self.keep]:
            fs.delete(self._path("manifest", f"version={v}"), True)
        for table in GOES_BY:  # also what compaction or a failed try left behind
            for s in fs.listStatus(self._path(table)):
                if s.getPath().getName() not in used:
                    fs.delete(s.getPath(), True)

    @property
    def now(self) -> float | None:
        return self.segments[0]["clock"] if self.segments else None

    @property
    def tag(self) -> str | None:
        return self.segments[0]["tag"] if self.segments else None

    # ---- segments

    def _bucket(self, key: str):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _write(self, table: str, rows: DataFrame, gone: DataFrame | None, base: bool) -> dict:
        """A segment in a folder of its own, so that a failed try leaves nothing that a later one could take for its own."""
        folder = f"v{self.version + 1}-{uuid.uuid4().hex}"
        target = f"{self.path}/{table}/{folder}"
        dealt = rows.withColumn("bucket", self._bucket(DEALT[table]))
        if base:
            # buckets are few: a plain repartition would leave all rows to as many tasks, however many rows there are
            dealt.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{target}/rows")
        else:
            dealt.sortWithinPartitions("bucket").write.parquet(f"{target}/rows")
        n, g = self.spark.read.schema(dealt.schema).parquet(f"{target}/rows").count(), 0
        if gone is not None:
            keys = gone.select(*GOES_BY[table]).withColumn("bucket", self._bucket(DEALT[table]))
            keys.sortWithinPartitions("bucket").write.parquet(f"{target}/gone")
            g = self.spark.read.schema(keys.schema).parquet(f"{target}/gone").count()
        return {"table": table, "version": self.version + 1, "folder": folder, "base": base, "rows": n, "gone": g, "columns": rows.schema.json()}

    def _of(self, table: str) -> list[dict]:
        return [s for s in self.segments if s["table"] == table]

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a table, of some buckets if given. Deltas are merged by key."""
        segments = self._of(name)
        part = (lambda d: d) if buckets is None else (lambda d: d.filter(F.col("bucket").isin(buckets)))
        schema = StructType.fromJson(json.loads(segments[0]["columns"]))
        bucket = StructField("bucket", IntegerType())
        keyed = StructType([*(f for f in schema if f.name in GOES_BY[name]), bucket])
        out = gone = None
        for s in segments:
            at = f"{self.path}/{name}/{s['folder']}"
            rows = part(self.spark.read.schema(StructType([*schema.fields, bucket])).parquet(f"{at}/rows")).withColumn("_v", F.lit(s["version"]))
            if out is None or s["rows"]:
                out = rows if out is None else out.unionByName(rows)
            if s["gone"]:
                keys = part(self.spark.read.schema(keyed).parquet(f"{at}/gone")).withColumn("_gone", F.lit(s["version"]))
                gone = keys if gone is None else gone.unionByName(keys)
        if gone is not None:
            last = gone.groupBy(*GOES_BY[name]).agg(F.max("_gone").alias("_gone"))
            out = out.join(last, GOES_BY[name], "left").filter(F.col("_gone").isNull() | (F.col("_v") >= F.col("_gone")))
        return out.select(*schema.names)

    def tables(self, buckets: list[int] | None = None) -> Tables:
        """All tables, of the tasks in some buckets if given; readings, which belong to no task, are whole."""
        return Tables(**{n: self.table(n, None if n == "readings" else buckets) for n in KEYS}, now=self.now)

    def definitions(self, buckets: list[int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        return tuple(self.table(n, buckets) for n in DEFINITIONS)

    # ---- versions

    def create(self, f: Flow, tag: str | None = None) -> Tables:
        """The first version: a full run over the events of ``f``."""
        t = full_run(f)
        segments = [self._write(n, getattr(t, n), None, True) for n in KEYS]
        segments += [self._write(n, getattr(f, n), None, True) for n in DEFINITIONS]
        self._commit(segments, f.now, tag)
        return t

    def advance(self, new_events: DataFrame, f: Flow, now: float | None = None, tag: str | None = None, definitions: bool = False,
                before: Callable[[Delta], None] | None = None) -> Delta | None:
        """The next version. ``definitions``: look for tasks whose definition in ``f`` is another than the stored one, and apply it.
        ``before`` sees the changes before the version counts. A tag that is the last version's own changes nothing and gives None."""
        if tag is not None and tag == self.tag:
            return None
        now = self.now if now is None else now
        new_events = cut_lineage(new_events)
        redefined = cut_lineage(changed_definitions(self.definitions(), f)) if definitions else None
        tasks = new_events.select("task_id").unionByName(passed_by(self.table("state"), self.now, now).select("task_id"))
        if redefined is not None:
            tasks = tasks.unionByName(redefined)
        buckets = sorted(r.b for r in tasks.select(self._bucket("task_id").alias("b")).distinct().collect())
        d = delta(self.tables(buckets), new_events, f, now, redefined)
        if before is not None:
            before(d)
        segments = list(self.segments)
        for n, rows in d.rows.items():
            segments.append(self._write(n, rows, d.gone.get(n), False))
        if redefined is not None:
            for n in DEFINITIONS:
                segments.append(self._write(n, getattr(f, n).join(redefined, "task_id", "left_semi").select(*self.table(n).columns), redefined, False))
        self._commit(self._compacted(segments), now, tag)
        return d

    def _compacted(self, segments: list[dict]) -> list[dict]:
        """Tables whose deltas have grown to a share of the base are written as one base; others keep their segments."""
        out, before = [], self.segments
        for n in sorted({s["table"] for s in segments}):
            mine = [s for s in segments if s["table"] == n]
            base = sum(s["rows"] for s in mine if s["base"])
            late = sum(s["rows"] + s["gone"] for s in mine if not s["base"])
            if late > self.compact * base:
                self.segments = segments
                mine = [self._write(n, self.table(n), None, True)]
                self.segments = before
            out += mine
        return out
