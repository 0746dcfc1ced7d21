"""Versioned databases: one fenced writer, numbered generations, pinned and following readers.

All state is a log of entries created exclusively one after the other. Attaching
a writer appends an entry with the next epoch; from then on an older writer
finds its next entry taken by a higher epoch and fails. Publishing appends the
tables of generation N + 1 in one entry.
"""

from __future__ import annotations

import json
import re
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeglean.sources.fs import Fs
from lakeglean.sources.lake import ConstraintError, VersionExpired


class Fenced(RuntimeError):
    """Another writer has attached; nothing of this one is published any more."""


class Snapshot:
    """The tables of one generation; what it returns never changes."""

    def __init__(self, db: Database, gen: int, tables: dict, extra: dict):
        self.db, self.gen, self.tables, self.extra = db, gen, tables, extra

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"no table {name!r} at generation {self.gen}")
        t = self.tables[name]
        schema = T.StructType.fromJson(t["schema"])
        if not t["folders"]:
            return self.db.spark.createDataFrame([], schema)
        return self.db.spark.read.schema(schema).parquet(*(f"{self.db.fs.root}/data/{f}" for f in t["folders"]))

    def views(self, prefix: str = "") -> None:
        """Register each table, and each stored view, as a temporary view."""
        for name in self.tables:
            self.table(name).createOrReplaceTempView(prefix + name)
        for name, sql in self.extra.get("views", {}).items():
            self.db.spark.sql(sql).createOrReplaceTempView(prefix + name)


class Database:
    """Reader side of a database at ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.fs = spark, Fs(spark, root)

    def _entries(self) -> list[dict]:
        names = [n for n in self.fs.names("log") if re.fullmatch(r"\d{20}\.json", n)]
        return [json.loads(t) for t in self.fs.read_many([f"log/{n}" for n in names])]

    def gen(self) -> int:
        """The newest published generation; 0 before any."""
        return max((e["gen"] for e in self._entries() if e["kind"] == "publish"), default=0)

    def horizon(self) -> int:
        return max((e["horizon"] for e in self._entries() if e["kind"] == "horizon"), default=0)

    def at(self, gen: int | None = None) -> Snapshot:
        """Newest generation, or a pinned one; a reaped one is an error."""
        entries = self._entries()
        newest = max((e["gen"] for e in entries if e["kind"] == "publish"), default=0)
        horizon = max((e["horizon"] for e in entries if e["kind"] == "horizon"), default=0)
        gen = newest if gen is None else gen
        if gen < horizon:
            raise VersionExpired(f"generation {gen} has expired")
        if not gen:
            return Snapshot(self, 0, {}, {})
        e = next((e for e in entries if e["kind"] == "publish" and e["gen"] == gen), None)
        if e is None:
            raise ValueError(f"generation {gen} does not exist")
        return Snapshot(self, gen, e["tables"], e["extra"])

    def writer(self) -> Writer:
        return Writer(self.spark, self.fs.root)

    def follow(self, interval: float = 10.0, prefix: str = "") -> Follower:
        return Follower(self, interval, prefix)

    def reap(self, keep_from: int, grace: float = 600.0) -> int:
        """Expire generations below ``keep_from`` and delete the folders only they name; how many."""
        keep_from = min(keep_from, self.gen())
        if keep_from > self.horizon():
            while not self.fs.put_if_absent(f"log/{len(self._entries()):020d}.json", json.dumps({"kind": "horizon", "horizon": keep_from, "epoch": max((e["epoch"] for e in self._entries()), default=0)})):
                pass
        entries = [e for e in self._entries() if e["kind"] == "publish"]
        kept = {f for e in entries if e["gen"] >= self.horizon() for t in e["tables"].values() for f in t["folders"]}
        old = {f for e in entries for t in e["tables"].values() for f in t["folders"]} - kept
        stale = [f for f in old if self.fs.exists(f"data/{f}") and all(ms / 1000 <= time.time() - grace for _, _, ms in self.fs.files(f"data/{f}"))]
        return sum(self.fs.delete(f"data/{f}") for f in stale)


class Writer(Database):
    """The one writer; attaching fences any other."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root)
        self.fs.mkdirs("log")
        while True:
            entries = self._entries()
            self.epoch = max((e["epoch"] for e in entries), default=0) + 1
            if self.fs.put_if_absent(f"log/{len(entries):020d}.json", json.dumps({"kind": "attach", "epoch": self.epoch, "at": time.time()})):
                break
        self._position = len(entries) + 1
        base = self.at()
        self._gen, self._tables, self._extra, self._dirty = base.gen, dict(base.tables), dict(base.extra), False

    def current(self) -> Snapshot:
        """What this writer sees: the published tables with what it staged."""
        return Snapshot(self, self._gen, dict(self._tables), self._extra)

    def table(self, name: str) -> DataFrame:
        return self.current().table(name)

    def _stage(self, df: DataFrame) -> str:
        folder = uuid.uuid4().hex
        df.write.parquet(f"{self.fs.root}/data/{folder}")
        return folder

    def create(self, name: str, df: DataFrame, *, primary_key: list[str] = (), unique: list[list[str]] = (), not_null: list[str] = (), checks: list[str] = (), foreign_keys: list[tuple[list[str], str, list[str]]] = ()) -> None:
        if name in self._tables:
            raise ValueError(f"table {name!r} exists")
        rules = {"unique": [list(primary_key)] * bool(primary_key) + [list(u) for u in unique], "not_null": [*primary_key, *not_null], "checks": list(checks),
                 "foreign_keys": [[list(a), t, list(b)] for a, t, b in foreign_keys]}
        self._tables[name] = {"schema": df.schema.jsonValue(), "folders": [self._stage(df)], "rules": rules}
        self._dirty = True

    def append(self, name: str, df: DataFrame) -> None:
        t = self._tables[name]
        want = T.StructType.fromJson(t["schema"])
        own = df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in want.fields))
        self._tables[name] = t | {"folders": [*t["folders"], self._stage(own)]}
        self._dirty = True

    def replace(self, name: str, df: DataFrame) -> None:
        self._tables[name] = self._tables[name] | {"schema": df.schema.jsonValue(), "folders": [self._stage(df)]}
        self._dirty = True

    def drop(self, name: str) -> None:
        del self._tables[name]
        self._dirty = True

    def rename(self, name: str, to: str) -> None:
        self._tables[to] = self._tables.pop(name)
        self._dirty = True

    def view(self, name: str, sql: str) -> None:
        self._extra = self._extra | {"views": self._extra.get("views", {}) | {name: sql}}
        self._dirty = True

    def next_value(self, sequence: str, n: int = 1) -> int:
        """The first of ``n`` values of a sequence; taken for good once published."""
        seqs = self._extra.get("sequences", {})
        first = seqs.get(sequence, 1)
        self._extra = self._extra | {"sequences": seqs | {sequence: first + n}}
        self._dirty = True
        return first

    def validate(self) -> None:
        """Raise ConstraintError for the first rule that the staged tables break."""
        for name, t in self._tables.items():
            rules, df = t["rules"], self.table(name)
            for c in rules["not_null"]:
                if df.filter(F.col(f"`{c}`").isNull()).limit(1).count():
                    raise ConstraintError(f"NOT NULL failed: {name}.{c}")
            for cols in rules["unique"]:
                if unique_violations(df, cols).limit(1).count():
                    raise ConstraintError(f"UNIQUE failed: {name}{cols}")
            for c in rules["checks"]:
                if df.filter(f"not ({c})").limit(1).count():
                    raise ConstraintError(f"CHECK failed: {name}: {c}")
            for cols, other, theirs in rules["foreign_keys"]:
                if missing_references(df, cols, self.table(other), theirs).limit(1).count():
                    raise ConstraintError(f"FOREIGN KEY failed: {name}{cols}")

    def commit(self) -> int:
        """Publish what was staged as one generation; nothing staged publishes nothing."""
        if not self._dirty:
            return self._gen
        self.validate()
        entry = {"kind": "publish", "gen": self._gen + 1, "epoch": self.epoch, "at": time.time(), "tables": self._tables, "extra": self._extra}
        while not self.fs.put_if_absent(f"log/{self._position:020d}.json", json.dumps(entry)):
            taken = self._entries()[self._position:]
            if any(e["epoch"] > self.epoch for e in taken):
                raise Fenced(f"epoch {self.epoch} was fenced")
            self._position += len(taken)  # a horizon moved meanwhile
        self._position += 1
        self._gen, self._dirty = self._gen + 1, False
        return self._gen

    def rollback(self) -> None:
        base = self.at(self._gen) if self._gen else Snapshot(self, 0, {}, {})
        self._tables, self._extra, self._dirty = dict(base.tables), dict(base.extra), False


class Follower:
    """Keeps temporary views at the newest generation; DataFrames already built keep theirs."""

    def __init__(self, db: Database, interval: float, prefix: str):
        self.db, self.interval, self.prefix, self.gen = db, interval, prefix, -1
        self._stop = threading.Event()
        self._thread: threading.Thread | None = None
        self.refresh()

    def refresh(self) -> bool:
        """Move to the newest generation; whether there was a newer one."""
        snap = self.db.at()
        if snap.gen == self.gen:
            return False
        snap.views(self.prefix)
        self.gen = snap.gen
        return True

    def start(self) -> Follower:
        def run() -> None:
            while not self._stop.wait(self.interval):
                self.refresh()

        if self.interval > 0:
            self._thread = threading.Thread(target=run, daemon=True)
            self._thread.start()
        return self

    def stop(self) -> None:
        self._stop.set()
        if self._thread:
            self._thread.join()


def unique_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, n) of key values that occur more than once; keys with a null never do."""
    keep = None
    for c in columns:
        t = F.col(f"`{c}`").isNotNull()
        keep = t if keep is None else keep & t
    return df.filter(keep).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def missing_references(df: DataFrame, columns: list[str], parent: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key, if it has no null, is not in ``parent``."""
    keep = None
    for c in columns:
        t = F.col(f"`{c}`").isNotNull()
        keep = t if keep is None else keep & t
    p = parent.select(*(F.col(f"`{k}`").alias(f"__{k}") for k in keys)).distinct()
    on = None
    for c, k in zip(columns, keys):
        t = df[c] == p[f"__{k}"]
        on = t if on is None else on & t
    return df.filter(keep).join(p, on, "left_anti")
