"""Tables whose loads become visible as a whole, or not at all.

A load is written to a fresh folder that nobody reads, and audited while it is written. Publishing
adds one small manifest file that names, for every table and partition, the folder that counts from now on. It is
created with the file system's create-if-absent call: a load over many partitions and several tables is
one step, a reader sees the version before or the version after, and of two writers that start
from one version the second fails. Older folders stay until they are expired, so an earlier version
can be read, or published again.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import gather_by_partition

#: Partition name of a table without partitions.
WHOLE = "*"


class AuditFailed(ValueError):
    """A staged load breaks its rules; ``failed`` has the number of rows per rule."""

    def __init__(self, table: str, failed: dict[str, int]):
        super().__init__(f"load of {table} fails its audit: {failed}")
        self.table, self.failed = table, failed


class Conflict(RuntimeError):
    """Another load was published since the version this one started from."""


@dataclass(frozen=True)
class Staged:
    """A written load that is not visible yet. ``parts`` are folder names such as ``event_date=2024-01-01``."""

    table: str
    load: str
    parts: tuple[str, ...]
    rows: int
    failed: dict[str, int]
    schema: T.StructType


@dataclass
class Manifest:
    version: int = 0
    live: dict[tuple[str, str], str] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)


class Published:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ---- file system -----------------------------------------------------
    def _at(self, *parts: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        place, fs = self._at(*parts)
        return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []

    # ---- versions ----------------------------------------------------------
    def versions(self) -> list[int]:
        """Published versions, oldest first."""
        found = (re.fullmatch(r"v(\d+)\.json", n) for n in self._names("manifest"))
        return sorted(int(m[1]) for m in found if m)

    def manifest(self, version: int | None = None) -> Manifest:
        """The given version, or the newest complete one."""
        for v in [version] if version is not None else reversed(self.versions()):
            text = self.spark.read.text(f"{self.path}/manifest/v{v:09d}.json", wholetext=True).first()
            try:
                body = json.loads(text[0]) if text else {}
                return Manifest(v, {(t, p): load for t, p, load in body["live"]}, body["schemas"])
            except (ValueError, KeyError):
                if version is not None:
                    raise
                continue  # its writer was lost before the end; the version before it counts
        return Manifest()

    def _commit(self, new: Manifest) -> int:
        body = {"live": [[t, p, load] for (t, p), load in sorted(new.live.items())], "schemas": new.schemas}
        place, fs = self._at("manifest", f"v{new.version:09d}.json")
        try:
            out = fs.create(place, False)
        except Py4JJavaError as e:
            if fs.exists(place):
                raise Conflict(f"version {new.version} of {self.path} is taken") from e
            raise
        try:
            out.write(bytearray(json.dumps(body).encode()))
        finally:
            out.close()
        return new.version

    # ---- loads -------------------------------------------------------------
    def stage(
        self, table: str, rows: DataFrame, by: str | None = None, rules: dict[str, Column] | None = None, gather: bool = True
    ) -> Staged:
        """Write a load to a folder of its own and count, in the same pass, the rows that break a rule.

        ``gather=False`` leaves the rows of a partition in the tasks where they are, each of which writes a file of it.
        """
        load = f"load{uuid.uuid4().hex}"
        seen = Observation()
        names = list(rules or {})
        broken = [F.count_if(~F.coalesce((rules or {})[n], F.lit(False))).alias(f"r{k}") for k, n in enumerate(names)]
        counted = [F.count(F.lit(1)).alias("rows"), *broken]
        watched = rows.observe(seen, *counted)
        target = f"{self.path}/{table}/load={load}"
        if by:
            (gather_by_partition(watched, [by]) if gather else watched).write.partitionBy(by).parquet(target)
        else:
            watched.write.parquet(target)
        try:
            counts = seen.get
        except Py4JJavaError:  # of a plan that is known to be empty nothing is observed; count what was written
            counts = self.spark.read.schema(rows.schema).parquet(target).agg(*counted).first().asDict()
        parts = tuple(sorted(n for n in self._names(table, f"load={load}") if "=" in n)) if by else (WHOLE,)
        failed = {n: counts[f"r{k}"] for k, n in enumerate(names) if counts[f"r{k}"]}
        return Staged(table, load, parts, counts["rows"], failed, rows.schema)

    def publish(
        self, *staged: Staged, base: Manifest | None = None, drop: Iterable[tuple[str, str]] = (), append: bool = False
    ) -> int:
        """Make loads visible in one step; a load replaces the partitions it has, others stay.

        ``append`` adds unpartitioned loads to those before them. ``drop`` takes (table, partition) pairs out.
        """
        for s in staged:
            if s.failed:
                raise AuditFailed(s.table, s.failed)
        base = self.manifest() if base is None else base
        live, schemas = dict(base.live), dict(base.schemas)
        for pair in drop:
            live.pop(pair, None)
        for s in staged:
            whole = f"{WHOLE}{s.load}" if append else WHOLE
            live |= {(s.table, whole if p == WHOLE else p): s.load for p in s.parts}
            schemas[s.table] = s.schema.json()
        return self._commit(Manifest(base.version + 1, live, schemas))

    def load(self, table: str, rows: DataFrame, by: str | None = None, rules: dict[str, Column] | None = None) -> int:
        """Stage, audit and publish."""
        base = self.manifest()
        return self.publish(self.stage(table, rows, by, rules), base=base)

    def rollback(self, version: int) -> int:
        """Publish the content of an earlier version again, as a new version."""
        old = self.manifest(version)
        return self._commit(Manifest(self.manifest().version + 1, old.live, old.schemas))

    # ---- reading -----------------------------------------------------------
    def parts(self, table: str, base: Manifest | None = None) -> list[str]:
        return sorted(p for t, p in (base or self.manifest()).live if t == table)

    def read(self, table: str, base: Manifest | None = None, parts: Sequence[str] | None = None) -> DataFrame:
        """The visible rows of a table, or of some partitions; no other folder is listed or opened."""
        base = base or self.manifest()
        schema = T.StructType.fromJson(json.loads(base.schemas[table]))
        wanted = None if parts is None else set(parts)
        folders = [
            f"{self.path}/{table}/load={load}" + ("" if p.startswith(WHOLE) else f"/{p}")
            for (t, p), load in sorted(base.live.items())
            if t == table and (wanted is None or p in wanted)
        ]
        if not folders:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}")
        return reader.parquet(*folders).select(*schema.fieldNames())

    def view(self, name: str, table: str, base: Manifest | None = None) -> None:
        """Point a catalog view at a version: one catalog call, with partition filters that prune."""
        base = base or self.manifest()
        schema = T.StructType.fromJson(json.loads(base.schemas[table]))
        by_load: dict[str, list[str]] = {}
        for (t, p), load in sorted(base.live.items()):
            if t == table:
                by_load.setdefault(load, []).append(p)
        cases = []
        for load, parts in by_load.items():
            case = f"load = '{load}'"
            if not parts[0].startswith(WHOLE):
                column = parts[0].split("=", 1)[0]
                quote = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
                values = ", ".join("'" + quote(p.split("=", 1)[1]).replace("'", "''") + "'" for p in parts)
                case += f" AND `{column}` IN ({values})"
            cases.append(f"({case})")
        columns = ", ".join(f"`{c}`" for c in schema.fieldNames())
        self.spark.sql(
            f"CREATE OR REPLACE VIEW {name} AS SELECT {columns} FROM parquet.`{self.path}/{table}` "
            f"WHERE {' OR '.join(cases) or 'false'}"
        )

    # ---- retention -----------------------------------------------------------
    def expire(self, keep: int = 2, grace_seconds: int = 86_400) -> list[str]:
        """Remove loads that none of the last ``keep`` versions names and that are older than the grace time.

        The grace time protects loads that are being written and readers of a version just replaced.
        """
        recent = [self.manifest(v) for v in self.versions()[-keep:]]
        used = {(t, load) for m in recent for (t, _), load in m.live.items()}
        gone = []
        for table in {t for m in recent for t in m.schemas}:
            for name in self._names(table):
                place, fs = self._at(table, name)
                old = fs.getFileStatus(place).getModificationTime() / 1000 < time.time() - grace_seconds
                if name.startswith("load=") and (table, name[5:]) not in used and old:
                    fs.delete(place, True)
                    gone.append(f"{table}/{name}")
        return sorted(gone)
