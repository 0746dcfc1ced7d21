"""Versioned Parquet tables: snapshots, time travel, change feed, row identity, maintenance.

Each row keeps ``rowid`` from its insert on, through updates and compaction,
and carries ``snapshot_id`` of the commit that wrote it. Deletes are positions
in deletion vectors; an update deletes the old image and appends the new one
in the same commit. Readers never lock: a DataFrame keeps the files of the
version it was built from.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeglean.operators.compaction import ChecksumMismatch, advisory, multiset_checksum
from lakeglean.operators.incremental import FILE, POSITION, CommitConflict, ManifestTable

ROWID, SNAPSHOT = "rowid", "snapshot_id"


class ConstraintError(ValueError):
    pass


class VersionExpired(ValueError):
    pass


class LakeTable:
    """A table at ``root``; ``not_null`` columns are checked on every write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.log = spark, ManifestTable(spark, root)

    # -- reading -----------------------------------------------------------
    def version(self) -> int:
        return self.log.version()

    def _meta(self, version: int | None = None) -> dict:
        """Options of the newest commit that set them, and the next rowid."""
        out: dict = {"next_rowid": 0, "sorted_by": [], "not_null": [], "options": {}}
        version = self.version() if version is None else version
        for v in reversed([v for v in self.log.versions() if v <= version]):
            return out | self.log.manifest(v).get("meta", {})
        return out

    def at(self, version: int | None = None, system: bool = False) -> DataFrame:
        """The rows at a version; with ``system`` also rowid and snapshot_id."""
        if version is not None and version < self.horizon():
            raise VersionExpired(f"version {version} has expired")
        df = self.log.read(version)
        return df if system else df.drop(ROWID, SNAPSHOT)

    def horizon(self) -> int:
        names = [int(n[:-8]) for n in self.log.fs.names("_log") if n.endswith(".horizon")]
        return max(names, default=0)

    def snapshots(self) -> DataFrame:
        rows = []
        for v in self.log.versions():
            m = self.log.manifest(v)
            rows.append((v, m.get("op"), m.get("at"), len(m.get("add", [])), len(m["remove"])))
        return self.spark.createDataFrame(rows, "snapshot_id long, operation string, committed_at double, files_added int, files_removed int")

    def files(self, version: int | None = None) -> DataFrame:
        s = self.log.snapshot(version)
        return self.spark.createDataFrame([(f"{self.log.root}/data/{p}", a["size"]) for p, a in s.files.items()], "path string, size long")

    def changes(self, first: int, last: int | None = None) -> DataFrame:
        """Row changes of the commits first..last: change_type, snapshot_id of the change, rowid and the row.

        change_type is insert, delete, update_preimage or update_postimage.
        Commits that only rewrote files change nothing.
        """
        last = self.version() if last is None else last
        if first <= self.horizon() and self.horizon():
            raise VersionExpired(f"version {first} has expired")
        out, schema = None, self.log.snapshot(first - 1).schema if first > 1 else None
        for v in (v for v in self.log.versions() if first <= v <= last):
            m = self.log.manifest(v)
            schema = m.get("schema") or schema
            if not m.get("data_change", True):
                continue
            update, parts = m.get("op") == "update", []
            if m.get("add"):
                rows = self.log._rows(self._shaped(schema), [a["path"] for a in m["add"]])
                parts.append(rows.withColumn("change_type", F.lit("update_postimage" if update else "insert")))
            if m.get("vectors") or m["remove"]:
                before = self.log.snapshot(v - 1)
                if m["remove"]:
                    rows = self.log._live(before, [p for p in m["remove"] if p in before.files])
                    parts.append(rows.withColumn("change_type", F.lit("delete")))
                if m.get("vectors"):
                    rows = self.log.deleted(before, m["vectors"])
                    parts.append(rows.withColumn("change_type", F.lit("update_preimage" if update else "delete")))
            for p in parts:
                p = p.withColumn(SNAPSHOT, F.lit(v).cast("long")).drop(FILE, POSITION)
                out = p if out is None else out.unionByName(p)
        if out is None:
            s = T.StructType.fromJson(json.loads(schema)) if schema else T.StructType([T.StructField(ROWID, T.LongType()), T.StructField(SNAPSHOT, T.LongType())])
            return self.spark.createDataFrame([], s.add("change_type", "string"))
        return out

    @staticmethod
    def _shaped(schema: str):
        from lakeglean.operators.incremental import Snapshot

        return Snapshot(schema=schema)

    # -- writing -----------------------------------------------------------
    def _laid_out(self, df: DataFrame, meta: dict) -> DataFrame:
        if meta["sorted_by"]:
            return df.repartitionByRange(*meta["sorted_by"]).sortWithinPartitions(*meta["sorted_by"])
        return df

    def _check(self, df: DataFrame, meta: dict) -> None:
        if meta["not_null"]:
            bad = None
            for c in meta["not_null"]:
                t = F.col(f"`{c}`").isNull()
                bad = t if bad is None else bad | t
            if df.filter(bad).limit(1).count():
                raise ConstraintError(f"NOT NULL constraint failed: {meta['not_null']}")

    def _commit(self, op: str, meta: dict, base: int, **kw) -> int:
        if isinstance(kw.get("add"), DataFrame):
            kw["add"] = self.log.write_files(kw["add"], meta["options"])
        return self.log.commit(op=op, meta=meta, at=time.time(), expect=base, **kw)

    def create(self, df: DataFrame, sorted_by: list[str] = (), not_null: list[str] = (), options: dict | None = None) -> int:
        """The first version from a DataFrame (may be empty). ``options`` go to the Parquet writer: compression, parquet.block.size, ..."""
        if self.version():
            raise CommitConflict("the table exists")
        meta = {"next_rowid": 0, "sorted_by": list(sorted_by), "not_null": list(not_null), "options": options or {}}
        return self._append(df, meta, 0, "create")

    def insert(self, df: DataFrame) -> int:
        """Append rows, matched by column name and cast to the table's types; a column too many is an error, one too few is null."""
        base = self.version()
        want = [f for f in self.log._schema(self.log.snapshot(base)).fields if f.name not in (ROWID, SNAPSHOT)]
        if extra := [c for c in df.columns if c not in {f.name for f in want}]:
            raise ValueError(f"the table has no column {extra[0]!r}")
        own = df.select(*((F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want))
        return self._append(own, self._meta(base), base, "insert")

    def _append(self, df: DataFrame, meta: dict, base: int, op: str) -> int:
        self._check(df, meta)
        df = self._laid_out(df, meta)
        # ids are unique and rise with the version; each partition of a write leaves a gap behind it
        rows = df.withColumn(ROWID, F.monotonically_increasing_id() + F.lit(meta["next_rowid"])).withColumn(SNAPSHOT, F.lit(base + 1).cast("long"))
        written = self.log.write_files(rows, meta["options"])
        last = self.log._rows(self._shaped(written["schema"]), [a["path"] for a in written["add"]]).agg(F.max(ROWID)).first()[0]
        return self._commit(op, meta | {"next_rowid": meta["next_rowid"] if last is None else last + 1}, base, add=written)

    def _hit(self, condition: Column | str, base: int) -> DataFrame:
        return self.log.read(base, positions=True).filter(F.coalesce(F.expr(condition) if isinstance(condition, str) else condition, F.lit(False)))

    def delete(self, condition: Column | str) -> int:
        """Delete the rows for which the condition is true; no version if there are none."""
        base = self.version()
        dead = self.log.write_vector(self._hit(condition, base).select(FILE, POSITION))
        return base if dead is None else self._commit("delete", self._meta(base), base, vector=dead)

    def update(self, condition: Column | str, assign: dict[str, Column]) -> int:
        """Set columns where the condition is true; rows keep their rowid."""
        base = self.version()
        meta, hit = self._meta(base), self._hit(condition, base)
        dead = self.log.write_vector(hit.select(FILE, POSITION))
        if dead is None:
            return base
        rows = hit.drop(FILE, POSITION)
        kinds = {f.name: f.dataType for f in rows.schema.fields}
        new = rows.withColumns({c: v.cast(kinds[c]) for c, v in assign.items()} | {SNAPSHOT: F.lit(base + 1).cast("long")})
        self._check(new, meta)
        return self._commit("update", meta, base, vector=dead, add=new)

    def drop(self) -> None:
        self.log.fs.delete("")

    def set_sorted_by(self, columns: list[str]) -> int:
        base = self.version()
        return self._commit("options", self._meta(base) | {"sorted_by": list(columns)}, base, data_change=False)

    def add_files(self, paths: list[str]) -> int:
        """Take over finished Parquet files; they are copied into the table's own immutable ones."""
        return self.insert(self.spark.read.parquet(*paths))

    # -- maintenance -------------------------------------------------------
    def _rewritten(self, op: str, meta: dict, base: int, before: DataFrame, laid: DataFrame, **kw) -> int:
        """Write ``laid``, compare it with ``before`` as multisets, and only then publish it."""
        staged = self.log.write_files(laid, meta["options"])
        if multiset_checksum(before) != multiset_checksum(self.log._rows(self._shaped(staged["schema"]), [a["path"] for a in staged["add"]]).drop(FILE, POSITION)):
            for a in staged["add"]:
                self.log.fs.delete(f"data/{a['path']}")
            raise ChecksumMismatch(f"{op} would have changed the rows; nothing was published")
        return self._commit(op, meta, base, add=staged, data_change=False, **kw)

    def compact(self, target_bytes: int = 128 << 20) -> int:
        """Rewrite all files into well-sized ones without deleted rows; rows and their ids stay the same."""
        base = self.version()
        s, meta = self.log.snapshot(base), self._meta(base)
        rows = self.log.read(base)
        with advisory(self.spark, target_bytes):
            laid = self._laid_out(rows, meta) if meta["sorted_by"] else rows.hint("rebalance")
            return self._rewritten("compact", meta, base, rows, laid, remove=list(s.files), clear=list(s.vectors))

    def rewrite(self, delete_threshold: float = 0.1) -> int:
        """Rewrite the files of which at least this share of rows is deleted; only files that a vector touches are read."""
        base = self.version()
        s, meta = self.log.snapshot(base), self._meta(base)
        touched = {f for v in s.vectors.values() for f in v["files"]}.intersection(s.files)
        if not touched:
            return base
        rows = self.log._rows(s, sorted(touched)).groupBy(FILE).agg(F.count(F.lit(1)).alias("n"))
        dead = self.log._dead(list(s.vectors)).distinct().groupBy(FILE).agg(F.count(F.lit(1)).alias("d"))
        bad = [r[0] for r in rows.join(dead, FILE).filter(F.col("d") >= F.col("n") * delete_threshold).select(FILE).collect()]
        if not bad:
            return base
        live = self.log._live(s, bad).drop(FILE, POSITION)
        left = set(s.files) - set(bad)
        return self._rewritten("rewrite", meta, base, live, live, remove=bad, clear=[k for k, v in s.vectors.items() if not left.intersection(v["files"])])

    def expire(self, before: int) -> int:
        """Versions below ``before`` can't be read any more; the new horizon."""
        before = min(before, self.version())
        if before > self.horizon():
            self.log.fs.put_if_absent(f"_log/{before:020d}.horizon", "")
        return self.horizon()

    def cleanup(self, grace: float = 600.0) -> int:
        """Delete files that no readable version names and that are older than the grace; how many."""
        keep: set[str] = set()
        versions = [v for v in self.log.versions() if v >= self.horizon()]
        for v in versions:
            s = self.log.snapshot(v)
            keep |= {f"data/{p}" for p in s.files} | set(s.vectors)
        n = 0
        for part in ("data", "vectors"):
            for p, _, ms in self.log.fs.files(part):
                if p.endswith(".parquet") and p not in keep and p.rsplit("/", 1)[0] not in keep and ms / 1000 <= time.time() - grace:
                    n += self.log.fs.delete(p)
        return n
