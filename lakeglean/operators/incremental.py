"""Processing only new or changed records, by diffing immutable table versions.

A :class:`ManifestTable` is a folder of immutable Parquet files and a log of
numbered manifests. A manifest lists files added, files removed and deletion
vectors (positions in a file whose rows are gone). :meth:`ManifestTable.diff`
compares two versions by their *manifests* and reads only the files in which
they differ, so its cost follows the change and not the table.

:func:`run_incremental` saves the processed version in the same commit that
publishes the output, so a run that dies before that commit leaves nothing and
one that dies after it is never repeated.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeglean.session import scratch
from lakeglean.sources.fs import Fs

CHECKPOINT_EVERY = 50
POSITION = "__pos"
FILE = "__file"
CHANGE = "_change"
#: Commits in which deliveries and runs arrive.
BATCHES = 3
#: Deletion vectors of at most this many rows in all (about 30 MB) are broadcast to the files they touch; beyond it Spark shuffles those files.
BROADCAST_DEAD = 200_000


class CommitConflict(RuntimeError):
    """Another writer published the version first."""


@dataclass
class Snapshot:
    """The files of one version, and its deletion vectors: folder to the files it touches and its number of rows."""

    version: int = 0
    schema: str | None = None
    files: dict[str, dict] = field(default_factory=dict)
    vectors: dict[str, dict] = field(default_factory=dict)
    txn: dict[str, int] = field(default_factory=dict)
    moved_in: set[str] = field(default_factory=set)
    moved_out: set[str] = field(default_factory=set)


class ManifestTable:
    """A versioned table of immutable files below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.fs = spark, root.rstrip("/"), Fs(spark, root)

    # -- log ---------------------------------------------------------------
    def versions(self) -> list[int]:
        return [int(m[1]) for n in self.fs.names("_log") if (m := re.fullmatch(r"(\d{20})\.json", n))]

    def version(self) -> int:
        """The newest version; 0 is the empty table before any commit."""
        return max(self.versions(), default=0)

    def _saved(self) -> list[int]:
        return [int(n[:20]) for n in self.fs.names("_log") if re.fullmatch(r"\d{20}\.checkpoint", n)]

    def manifest(self, version: int) -> dict:
        return json.loads(self.fs.read_many([f"_log/{version:020d}.json"])[0])

    def snapshot(self, version: int | None = None, since: int | None = None) -> Snapshot:
        """State at ``version``. Files moved by commits after ``since`` that change no record are noted."""
        version = self.version() if version is None else version
        known = self.versions()
        if version and version not in known:
            raise ValueError(f"version {version} does not exist")
        s, start = Snapshot(version), 0
        saved = [v for v in self._saved() if v <= version and (since is None or v <= since)]
        if saved:
            start = saved[-1]
            c = json.loads(self.fs.read_many([f"_log/{start:020d}.checkpoint"])[0])
            s.schema, s.files, s.vectors, s.txn = c["schema"], c["files"], c["vectors"], c["txn"]
        wanted = [v for v in known if start < v <= version]
        for v, text in zip(wanted, self.fs.read_many([f"_log/{v:020d}.json" for v in wanted])):
            m = json.loads(text)
            s.schema = m.get("schema") or s.schema
            changes = m.get("data_change", True)
            for p in m.get("remove", []):
                s.files.pop(p, None)
                if not changes and since is not None and v > since:
                    s.moved_out.add(p)
            for a in m.get("add", []):
                s.files[a["path"]] = a
                if not changes and since is not None and v > since:
                    s.moved_in.add(a["path"])
            s.vectors |= {x["folder"]: x for x in m.get("vectors", [])}
            for x in m.get("clear", []):
                s.vectors.pop(x, None)
            s.txn |= m.get("txn", {})
        return s

    def write_files(self, df: DataFrame, options: dict | None = None) -> dict:
        """Write immutable files that no version names yet; what a commit needs to name them."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.options(**(options or {})).parquet(f"{self.root}/{folder}")
        return self._named(folder, df.schema.json())

    def adopt(self, folder: str, schema: str) -> dict:
        """The same for a finished folder of Parquet files, which moves below the table; an absent one holds nothing."""
        own, fs = f"data/{uuid.uuid4().hex}", Fs(self.spark, folder)
        if fs.exists():
            self.fs.mkdirs("data")
            fs._fs.rename(fs.path(""), self.fs.path(own))
        return self._named(own, schema)

    def _named(self, folder: str, schema: str) -> dict:
        made = self.fs.data_files(folder)
        return {"add": [{"path": p[len("data/"):], "size": n, "of": len(made)} for p, n in made], "schema": schema}

    def write_vector(self, dead: DataFrame) -> dict | None:
        """Write (__file, __pos) of rows to delete, and note which files they lie in; None for no row."""
        folder = f"vectors/{uuid.uuid4().hex}"
        dead.select(F.col(FILE).cast("string"), F.col(POSITION).cast("long")).write.parquet(f"{self.root}/{folder}")
        return self._noted(folder)

    def adopt_vector(self, folder: str) -> dict | None:
        """The same for rows that are written already."""
        own, fs = f"vectors/{uuid.uuid4().hex}", Fs(self.spark, folder)
        if not fs.exists():
            return None
        self.fs.mkdirs("vectors")
        fs._fs.rename(fs.path(""), self.fs.path(own))
        return self._noted(own)

    def _noted(self, folder: str) -> dict | None:
        counts = self._dead([folder]).groupBy(FILE).agg(F.count(F.lit(1)).alias("n")).collect()  # one row a file of the table
        if not counts:
            self.fs.delete(folder)
            return None
        return {"folder": folder, "files": sorted(r[0] for r in counts), "rows": sum(r[1] for r in counts)}

    def commit(self, *, add: DataFrame | dict | None = None, remove: list[str] = (), vector: DataFrame | dict | None = None,
               txn: dict[str, int] | None = None, data_change: bool = True, expect: int | None = None, clear: list[str] = (), **extra) -> int:
        """Publish one version. ``vector`` holds (__file, __pos) of rows to delete; ``clear`` names vectors that no file needs any more.

        Files are written first and only named by the manifest, whose exclusive
        creation is the commit; a writer that loses the race gets CommitConflict.
        """
        base = self.version() if expect is None else expect
        m: dict = {"remove": list(remove), "clear": list(clear), "txn": txn or {}, "data_change": data_change} | extra
        if add is not None:
            m |= add if isinstance(add, dict) else self.write_files(add)
        if isinstance(vector, DataFrame):
            vector = self.write_vector(vector)
        if vector is not None:
            m["vectors"] = [vector]
        self.fs.mkdirs("_log")
        if not self.fs.put_if_absent(f"_log/{base + 1:020d}.json", json.dumps(m)):
            raise CommitConflict(f"version {base + 1} was published by another writer")
        if (base + 1) % CHECKPOINT_EVERY == 0:  # readers then replay at most so many manifests
            s = self.snapshot(base + 1)
            self.fs.put_if_absent(f"_log/{base + 1:020d}.checkpoint", json.dumps({"schema": s.schema, "files": s.files, "vectors": s.vectors, "txn": s.txn}))
        return base + 1

    # -- reading -----------------------------------------------------------
    def _schema(self, s: Snapshot):
        return StructType.fromJson(json.loads(s.schema))

    def _rows(self, s: Snapshot, paths: list[str]) -> DataFrame:
        """Rows of these files with their place; a folder of which all files are meant is read as one path."""
        schema = self._schema(s)
        if not paths:
            return self.spark.createDataFrame([], schema).withColumns({FILE: F.lit(""), POSITION: F.lit(0).cast("long")})
        folders: dict[str, list[str]] = {}
        for p in paths:
            folders.setdefault(p.rsplit("/", 1)[0], []).append(p)
        named = [x for f, own in folders.items() for x in ([f] if s.files.get(own[0], {}).get("of") == len(own) else own)]
        return (self.spark.read.schema(schema).parquet(*(f"{self.root}/data/{p}" for p in named))
                .selectExpr("*", f"substring_index(_metadata.file_path, '/', -2) as {FILE}", f"_metadata.row_index as {POSITION}"))

    def _dead(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(f"{FILE} string, {POSITION} long").parquet(*(f"{self.root}/{f}" for f in folders))

    def _picked(self, rows: DataFrame, vectors: list[dict], how: str) -> DataFrame:
        dead = self._dead([v["folder"] for v in vectors])
        if how == "left_semi":
            dead = dead.distinct()
        return rows.join(F.broadcast(dead) if sum(v["rows"] for v in vectors) <= BROADCAST_DEAD else dead, [FILE, POSITION], how)

    def _live(self, s: Snapshot, paths: list[str]) -> DataFrame:
        """Rows of these files that the version's vectors leave; files that no vector touches meet no join."""
        touched = {f for v in s.vectors.values() for f in v["files"]}.intersection(paths)
        clean = self._rows(s, [p for p in paths if p not in touched])
        if not touched:
            return clean
        own = [v for v in s.vectors.values() if touched.intersection(v["files"])]
        rows = self._picked(self._rows(s, [p for p in paths if p in touched]), own, "left_anti")
        return rows if len(touched) == len(paths) else clean.unionByName(rows)

    def deleted(self, s: Snapshot, vectors: list[dict]) -> DataFrame:
        """Rows live at ``s`` that these vectors delete; only the files they touch are read."""
        touched = {f for v in vectors for f in v["files"]}
        files = [p for p in s.files if p in touched]
        return self._picked(self._live(s, files), vectors, "left_semi")

    def read(self, version: int | None = None, positions: bool = False) -> DataFrame:
        """Live rows at ``version``; with ``positions`` also (__file, __pos)."""
        s = self.snapshot(version)
        if s.schema is None:
            raise ValueError("the table has no version yet")
        df = self._live(s, list(s.files))
        return df if positions else df.drop(FILE, POSITION)

    def changed_files(self, old: int, new: int | None = None) -> list[str]:
        """The data files that :meth:`diff` reads, known from the manifests alone."""
        a, b = self.snapshot(old), self.snapshot(new, since=old)
        fresh = {f for k, v in b.vectors.items() if k not in a.vectors for f in v["files"]}
        return sorted(set(a.files).symmetric_difference(b.files) | fresh.intersection(a.files).intersection(b.files))

    def diff(self, old: int, new: int | None = None) -> DataFrame:
        """Record deltas between two versions, with ``_change`` = insert or delete.

        * a file only in ``new``: its rows, less those its vectors delete, are inserts;
        * a file only in ``old``: its rows live at ``old`` are deletes;
        * a file in both that a new vector touches: the rows it deleted are deletes.

        Other files are not read. Rows of files that commits without record
        changes (compaction) took out or brought in are first cancelled against
        each other as multisets, so rewriting never looks like new data and
        hides none either.
        """
        b = self.snapshot(new, since=old)
        a = self.snapshot(old)
        added = [p for p in b.files if p not in a.files and p not in b.moved_in]
        gone = [p for p in a.files if p not in b.files and p not in b.moved_out]
        new_moved = [p for p in b.files if p not in a.files and p in b.moved_in]
        old_moved = [p for p in a.files if p not in b.files and p in b.moved_out]
        a.schema = b.schema
        out = self._live(b, added).withColumn(CHANGE, F.lit("insert"))
        if gone:
            out = out.unionByName(self._live(a, gone).withColumn(CHANGE, F.lit("delete")))
        kept = [v for k, v in b.vectors.items() if k not in a.vectors]
        if any(p in a.files and p in b.files for v in kept for p in v["files"]):
            both = Snapshot(b.version, b.schema, {p: f for p, f in a.files.items() if p in b.files}, a.vectors)
            out = out.unionByName(self.deleted(both, kept).withColumn(CHANGE, F.lit("delete")))
        out = out.drop(FILE, POSITION)
        if new_moved or old_moved:
            now, then = self._live(b, new_moved).drop(FILE, POSITION), self._live(a, old_moved).drop(FILE, POSITION)
            out = (out.unionByName(now.exceptAll(then).withColumn(CHANGE, F.lit("insert")))
                   .unionByName(then.exceptAll(now).withColumn(CHANGE, F.lit("delete"))))
        return out


def run_incremental(source: ManifestTable | dict[str, ManifestTable], sink: ManifestTable, app: str, transform: Callable) -> int | dict[str, int] | None:
    """Process what ``source`` gained since the version saved by ``app`` in ``sink``.

    ``transform`` takes the record delta and returns rows to add, or the
    arguments of a commit (``add``, ``vector``, ``remove``). Of several named
    sources it takes the deltas and the versions they lead to, by name.

    Returns the version processed (or those by name), or None if there was
    nothing new. The output, the processed versions and the number of files
    read are one commit; the commit names the sink version it was computed on,
    so of two concurrent runs one fails untouched, and a run that dies between
    writing and committing leaves files that no version names.
    """
    base = sink.version()
    saved, many = sink.snapshot(base).txn, isinstance(source, dict)
    sources = {f"{app}/{n}": t for n, t in source.items()} if many else {app: source}
    targets = {k: t.version() for k, t in sources.items()}
    if all(saved.get(k, 0) >= v for k, v in targets.items()):
        return None
    deltas = {k.removeprefix(f"{app}/"): t.diff(saved.get(k, 0), targets[k]) for k, t in sources.items()}
    reached = {k.removeprefix(f"{app}/"): v for k, v in targets.items()}
    change = transform(deltas, reached) if many else transform(deltas[app])
    read = {k: len(t.changed_files(saved.get(k, 0), targets[k])) for k, t in sources.items()}
    sink.commit(**(change if isinstance(change, dict) else {"add": change}), txn=targets, expect=base, files_read=read)
    return reached if many else targets[app]


# -- coverage of numbered versions by logged runs ---------------------------
_BASE = 16
_SALTS = 16


def _blocks(runs: DataFrame, levels: int) -> DataFrame:
    """Cover the range (from_gen, to_gen] of each run by aligned blocks of 1, 16, 256, ... numbers.

    A range of length n gives at most 30 blocks a level, however long it is, so
    ranges are matched to numbers by equality instead of a range join. Large
    blocks meet many versions of a database and come in ``_SALTS`` copies.
    """
    none = "cast(array() as array<bigint>)"
    cur = runs.filter("from_gen < to_gen").selectExpr("db_id", "started_at", "from_gen + 1 as lo", "to_gen as hi")
    own = ["db_id", "started_at"]
    for level in range(levels):
        # the range at this level, null where a lower one took all of it; its inner part goes on to the next
        up, down = f"(lo + pmod(-lo, {_BASE}))", f"((hi + 1) - pmod(hi + 1, {_BASE}) - 1)"
        inner = "false" if level == levels - 1 else f"({up} <= {down})"
        ends = f"concat(if(lo < {up}, sequence(lo, {up} - 1), {none}), if({down} < hi, sequence({down} + 1, hi), {none}))"
        here = f"case when lo is null then {none} when {inner} then {ends} else sequence(lo, hi) end"
        cur = cur.selectExpr(*own, f"transform({here}, x -> struct({level} as level, x as block)) as a{level}", f"if({inner}, shiftright({up}, 4), null) as lo", f"if({inner}, shiftright({down}, 4), null) as hi")
        own.append(f"a{level}")
    each = cur.selectExpr("db_id", "started_at", f"inline(flatten(array({', '.join(own[2:])})))")
    salts = f"explode(if(level >= 2, sequence(0, {_SALTS - 1}), array(0))) as salt"
    return each.selectExpr("*", salts).groupBy("db_id", "level", "block", "salt").agg(F.expr("max(started_at) as run_at"))


def levels_for(runs: DataFrame) -> int:
    """Levels of blocks that the longest of these runs needs."""
    longest, levels = runs.agg(F.max(F.col("to_gen") - F.col("from_gen"))).first()[0] or 1, 1
    while _BASE ** levels < longest and levels < 15:
        levels += 1
    return levels


def coverage(versions: DataFrame, runs: DataFrame, levels: int | None = None) -> DataFrame:
    """``versions`` (db_id, gen, newest, ...), distinct, with ``covered``: whether a run already processed them.

    ``runs`` is (db_id, from_gen, to_gen, started_at); a run processes
    from_gen < gen <= to_gen. A version counts as processed if such a run
    started at or after ``newest``; if ``newest`` is null, any such run will do.
    Runs with a null bound or an empty range cover nothing.

    Large blocks meet many versions of a database, so they are copied to
    ``_SALTS`` salts over which the versions spread.
    """
    levels = levels_for(runs) if levels is None else levels
    blocks = _blocks(runs, levels).selectExpr("*", "true as hit")
    probes = versions.selectExpr("*", f"explode(sequence(0, {levels - 1})) as level")
    probes = probes.selectExpr("*", "shiftright(gen, level * 4) as block", f"if(level >= 2, cast(pmod(gen, {_SALTS}) as int), 0) as salt")
    met = probes.join(blocks, ["db_id", "level", "block", "salt"], "left")
    return met.groupBy(*versions.columns).agg(F.expr("coalesce(max(hit and (newest is null or coalesce(run_at >= newest, false))), false) as covered"))


def covered(versions: DataFrame, runs: DataFrame) -> DataFrame:
    """The rows of ``versions`` that a run already processed, once each."""
    return coverage(versions, runs).filter("covered").drop("covered")


def successful_runs(runs: DataFrame) -> DataFrame:
    """Rows of runs one of whose rows says ``succeeded``, whatever its case and blanks."""
    ok = runs.filter(F.lower(F.regexp_replace("status", r"^\s+|\s+$", "")) == "succeeded").select("run_id").distinct()
    return runs.join(ok, "run_id", "left_semi").select("db_id", "from_gen", "to_gen", "started_at")


class PendingVersions:
    """The versions that the next run must take, kept up to date by what arrives.

    Deliveries (db_id, gen, committed_at) and successful runs (db_id, from_gen,
    to_gen, started_at) are two manifest tables below ``root`` that only grow.
    :meth:`run` takes the record deltas of both since the versions it processed
    last, which are saved in the commit of its output, the table ``pending``
    (db_id, gen, newest):

    * a delivered version that no run so far covers is added; if it was pending
      already, its row is replaced by one with the newer time;
    * a pending version that a new run covers is deleted by a vector.

    Deliveries that stay covered touch nothing: a version is pending exactly
    if no run covers its newest delivery, in whatever order deliveries and runs
    arrive, late and repeated ones too. A run that was logged again, or a version
    delivered twice, changes nothing. Null db_id or gen is no version.
    """

    def __init__(self, spark: SparkSession, root: str, levels: int | None = None):
        self.spark, self.levels = spark, levels
        self.gens, self.runs, self.pending = (ManifestTable(spark, f"{root}/{n}") for n in ("gens", "runs", "pending"))

    def run(self) -> dict[str, int] | None:
        return run_incremental({"gens": self.gens, "runs": self.runs}, self.pending, "pending", self._step)

    def _step(self, deltas: dict[str, DataFrame], reached: dict[str, int]) -> dict:
        new = deltas["gens"].filter(f"{CHANGE} = 'insert' and db_id is not null and gen is not null")
        rows = new.selectExpr("db_id", "gen", "committed_at as newest", "true as arrived", f"cast(null as string) as {FILE}", f"cast(null as bigint) as {POSITION}")
        schema = StructType(rows.schema.fields[:3])
        if self.pending.version():
            rows = rows.unionByName(self.pending.read(positions=True).selectExpr("*", "false as arrived"))
        rows = rows.groupBy("db_id", "gen").agg(*(F.expr(f"max({c}) as {c}") for c in rows.columns[2:]))
        # what was pending was covered by no earlier run, so all runs cover of it what the new ones do
        seen = coverage(rows, self.runs.read(reached["runs"]), self.levels).filter("covered or arrived")
        parts = f"explode(filter(array(if(covered, null, 'add'), if({FILE} is null, null, 'dead')), x -> x is not null)) as __part"
        folder = scratch(self.spark, "step")
        seen.selectExpr("db_id", "gen", "newest", FILE, POSITION, parts).write.partitionBy("__part").parquet(folder)
        add = self.pending.adopt(f"{folder}/__part=add", schema.json())
        dead = self.pending.adopt_vector(f"{folder}/__part=dead")
        Fs(self.spark, folder).delete("")
        return {"add": add, "vector": dead}


def split_by_time(df: DataFrame, time: str, cuts: list[int], schema: list[str], folder: str) -> list[str]:
    """Write ``df`` once, as one folder for each of the periods between ``cuts`` (microseconds); a null time is before all."""
    period = " + ".join(f"if(unix_micros(cast({time} as timestamp)) > {c}, 1, 0)" for c in cuts) or "0"
    df.selectExpr(*schema, f"{period} as __period").write.partitionBy("__period").parquet(folder)
    return [f"{folder}/__period={n}" for n in range(len(cuts) + 1)]


def pending_versions(gens: DataFrame, dbs: DataFrame, runs: DataFrame, root: str, batches: int = BATCHES) -> DataFrame:
    """(db_id, gen, newest) that the next run must take: new, late, or delivered again since they were processed.

    Deliveries and runs arrive in ``batches`` commits, one for each period of
    equal numbers of deliveries, and :class:`PendingVersions` runs after each
    on its delta alone. Published versions are those not above the largest
    ``committed_gen`` of the database's rows, judged when the result is read.

    Null db_id or gen is no version. An empty table of runs leaves everything
    pending; empty gens or dbs give no row. Extra columns are ignored.
    """
    keep = PendingVersions(gens.sparkSession, root, levels_for(runs))
    gens, runs = gens.select("db_id", "gen", "committed_at"), successful_runs(runs)
    at = gens.select(F.unix_micros(F.col("committed_at").cast("timestamp")).alias("t"))
    cuts = sorted(set(map(int, at.approxQuantile("t", [i / batches for i in range(1, batches)], 0.02)))) if batches > 1 else []
    parts = [(t, df.schema.json(), split_by_time(df, time, cuts, df.columns, f"{root}/arrived-{n}"))
             for n, t, df, time in (("gens", keep.gens, gens, "committed_at"), ("runs", keep.runs, runs, "started_at"))]
    for n in range(len(cuts) + 1):
        for t, schema, folders in parts:
            t.commit(add=t.adopt(folders[n], schema))
        keep.run()
    head = dbs.groupBy("db_id").agg(F.max("committed_gen").alias("head"))
    return keep.pending.read().join(head, "db_id").filter("gen <= head").drop("head")
