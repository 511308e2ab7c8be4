"""Size-tiered compaction of immutable Parquet shards under a versioned manifest.

Arrivals are written as they come, one small shard a task, without a shuffle. A shard's tier is the power of
``fanout`` that its size has reached. As soon as a tier holds ``fanout`` shards below the target size, its shards are
merged, smallest first, into files of about ``target_bytes``; every merge reads and writes each of its rows once and
shuffles nothing (one task a merged file). Each append and each compaction becomes visible by one manifest file
``manifest/<version>.json`` that is renamed into place and fails if that version exists, so of two writers one wins
and the other raises. A manifest holds what its version adds and removes, each tenth one the whole list. Readers
see one version; ``vacuum`` drops old versions with the files that only they list.

Defined results: nulls, empty and very long texts, ties and clashing names are plain values and names; repeated rows stay repeated; an empty arrival adds no
shard but a version; columns keep their names whatever they are; an arrival with another schema is refused.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import hadoop


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 256 << 20, fanout: int = 4, least_bytes: int = 1 << 20, groups_a_job: int = 64):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fanout, self.least_bytes, self.groups_a_job = target_bytes, fanout, least_bytes, groups_a_job

    # manifest
    def versions(self) -> list[int]:
        fs, p = hadoop(self.spark, f"{self.root}/manifest")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))

    def _load(self, version: int) -> dict:
        fs, p = hadoop(self.spark, f"{self.root}/manifest/{version:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def state(self, version: int | None = None) -> tuple[dict[str, Shard], str | None]:
        """The shards of a version by path, and their schema as JSON."""
        known = self.versions()
        if version is not None and version not in known:
            raise ValueError(f"no version {version}")
        shards: dict[str, Shard] = {}
        schema, log = None, []
        for v in reversed([v for v in known if version is None or v <= version]):
            log.append(self._load(v))
            if log[-1]["whole"]:
                break
        for entry in reversed(log):
            for path in entry["removed"]:
                shards.pop(path, None)
            shards.update({s["path"]: Shard(**s) for s in entry["added"]})
            schema = entry["schema"] or schema
        return shards, schema

    def _commit(self, base: int, added: list[Shard], removed: list[str], schema: str | None, whole: bool = False) -> int:
        version = base + 1
        entry = {"version": version, "whole": False, "schema": schema, "removed": removed, "added": [asdict(s) for s in added]}
        if whole or version % 10 == 0:
            shards, old = self.state(base)
            kept = {k: s for k, s in shards.items() if k not in set(removed)} | {s.path: s for s in added}
            entry |= {"whole": True, "schema": schema or old, "removed": [], "added": [asdict(s) for s in kept.values()]}
        jvm = self.spark._jvm
        fs, temp = hadoop(self.spark, f"{self.root}/manifest/.{version:012d}-{uuid.uuid4().hex}")
        stream = fs.create(temp, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        final = jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest/{version:012d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(context.makeQualified(temp), context.makeQualified(final), options)
        except Exception as error:
            fs.delete(temp, False)
            if fs.exists(final):
                raise CommitConflict(f"version {version} exists") from error
            raise
        return version

    def _written(self, folder: str, schema: StructType) -> list[Shard]:
        """The shards that a finished job left in its folder; Spark's committer shows only those of successful tasks."""
        fs, p = hadoop(self.spark, folder)
        sizes = {s.getPath().getName(): (s.getPath().toString(), s.getLen()) for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")}
        counts = self.spark.read.schema(schema).parquet(folder).groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n")) if sizes else None
        rows = {r["file"].rsplit("/", 1)[-1]: r["n"] for r in counts.collect()} if counts is not None else {}
        return [Shard(*sizes[name], rows[name]) for name in sorted(sizes) if rows.get(name)]

    # writing
    def append(self, df: DataFrame, landed: str | None = None) -> int:
        """Add an arrival as small shards and commit it. ``landed``: a folder that a finished job wrote df's rows to."""
        base = max(self.versions(), default=0)
        schema = df.schema.json()
        old = self.state()[1] if base else None
        if old and [(f.name, f.dataType) for f in StructType.fromJson(json.loads(old)).fields] != [(f.name, f.dataType) for f in df.schema.fields]:
            raise ValueError("the arrival's columns differ from the store's")
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        if landed is None:
            df.write.parquet(folder)
        else:
            self._rename(landed, folder)
        return self._commit(base, self._written(folder, df.schema), [], None if old else schema)

    def _rename(self, source: str, target: str) -> None:
        fs, p = hadoop(self.spark, target)
        fs.mkdirs(p.getParent())
        if not fs.rename(hadoop(self.spark, source)[1], p):
            raise RuntimeError(f"{source} cannot be moved to {target}")

    def tier(self, size: int) -> int:
        return 0 if size < self.least_bytes else 1 + int(math.log(size / self.least_bytes, self.fanout))

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """Groups to merge: of each tier with at least fanout shards below the target, cut where a group reaches the target."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target_bytes:
                tiers.setdefault(self.tier(s.bytes), []).append(s)
        groups = []
        for _, members in sorted(tiers.items()):
            if len(members) < self.fanout:
                continue
            group: list[Shard] = []
            for s in sorted(members, key=lambda s: (s.bytes, s.path)):
                group.append(s)
                if sum(x.bytes for x in group) >= self.target_bytes:
                    groups.append(group)
                    group = []
            groups.append(group)
        return [g for g in groups if len(g) > 1]

    def compact(self) -> int:
        """Merge until no tier holds fanout shards; each round is one committed version. Returns the last version."""
        while True:
            base = max(self.versions(), default=0)
            shards, schema_json = self.state()
            groups = self.plan(list(shards.values()))
            if not groups:
                return base
            schema = StructType.fromJson(json.loads(schema_json))
            added: list[Shard] = []
            for at in range(0, len(groups), self.groups_a_job):
                part = groups[at : at + self.groups_a_job]
                merged = None
                for g in part:
                    one = self.spark.read.schema(schema).parquet(*[s.path for s in g]).coalesce(1)
                    merged = one if merged is None else merged.union(one)
                folder = f"{self.root}/data/{uuid.uuid4().hex}"
                merged.write.parquet(folder)
                new = self._written(folder, schema)
                if sum(s.rows for s in new) != sum(s.rows for g in part for s in g):
                    raise RuntimeError("a merge has lost or repeated rows")
                added += new
            self._commit(base, added, [s.path for g in groups for s in g], None)

    def read(self, version: int | None = None) -> DataFrame:
        shards, schema_json = self.state(version)
        if schema_json is None:
            raise AnalysisException("the store is empty")
        schema = StructType.fromJson(json.loads(schema_json))
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*sorted(shards))

    def vacuum(self, keep: int = 1, least_age: float = 86_400.0) -> int:
        """Drop versions before the last ``keep`` and delete files that no version left lists. Returns how many.

        A whole manifest that repeats the last version is committed first; the versions kept are it and those from the
        last whole manifest before the others on, so that every manifest that stays can be read with all its files.
        Files younger than ``least_age`` seconds stay, as a writer may not have committed them yet.
        """
        last = self.versions()[-1:]
        if not last:
            return 0
        if keep <= 1:
            known = [self._commit(last[0], [], [], None, whole=True)]
        else:
            known = self.versions()
            whole = [v for v in known[: len(known) - keep + 1] if self._load(v)["whole"]] or known[:1]
            known = [v for v in known if v >= whole[-1]]
        fs, p = hadoop(self.spark, f"{self.root}/manifest")
        old = [v for v in self.versions() if v < known[0]]
        listed = {path for v in known for path in self.state(v)[0]}
        for v in old:
            fs.delete(hadoop(self.spark, f"{self.root}/manifest/{v:012d}.json")[1], False)
        fs, p = hadoop(self.spark, f"{self.root}/data")
        gone, now = 0, time.time() * 1000
        for folder in fs.listStatus(p) if fs.exists(p) else []:
            for f in fs.listStatus(folder.getPath()):
                if f.getPath().getName().endswith(".parquet") and f.getPath().toString() not in listed and now - f.getModificationTime() >= least_age * 1000:
                    gone += fs.delete(f.getPath(), False)
        return gone


def ingest(store: ShardStore, docs: DataFrame, arrivals: int | None = None) -> DataFrame:
    """Append the rows of docs as arrivals in turn (twice the fan-out unless given), compact after each, and return the last
    version's rows. One job writes all arrivals, row by row in turn, to folders of their own; each becomes an append by
    moving its folder. The store must be this call's own, as files without a version are deleted at once."""
    spark, n = store.spark, arrivals or 2 * store.fanout
    column = "arrival"
    while column in docs.columns:
        column += "_"
    landing = f"{store.root}/landing/{uuid.uuid4().hex}"
    key = "spark.sql.maxConcurrentOutputFileWriters"
    usual = spark.conf.get(key)
    spark.conf.set(key, str(n))  # so many open files a task instead of a sort
    try:
        docs.withColumn(column, F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")).write.partitionBy(column).parquet(landing)
    finally:
        spark.conf.set(key, usual)
    nothing = spark.createDataFrame([], docs.schema)
    store.append(nothing)  # so that an empty table has a version, too
    for i in range(n):
        fs, p = hadoop(spark, f"{landing}/{column}={i}")
        if fs.exists(p):
            store.append(nothing, landed=p.toString())
            store.compact()
            store.vacuum(least_age=0)
    return store.read()
