"""A full-text index that follows a lake table through its change feed.

State is a log of commits ``{snapshot, splits, dead}``: the watermark, the
splits with the snapshot each was built from, and folders of invalidated
(rowid, snapshot). All three are published by one exclusive create, so a run
that dies is repeated whole and one that finished is never repeated.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeglean.operators import index
from lakeglean.operators.incremental import CommitConflict
from lakeglean.operators.search import Index
from lakeglean.sources.fs import Fs
from lakeglean.sources.lake import ROWID, SNAPSHOT, LakeTable


def latest_per_row(changes: DataFrame) -> DataFrame:
    """The last event of each rowid; of an update the new image."""
    w = Window.partitionBy(ROWID).orderBy(F.desc(SNAPSHOT), F.asc(F.col("change_type") == "update_preimage"))
    return changes.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


class IncrementalIndex:
    """``schema`` needs no rowid field: one is added, fast and stored."""

    def __init__(self, spark: SparkSession, table: LakeTable, root: str, schema: list, analyzers: dict | None = None):
        self.spark, self.table, self.root, self.fs = spark, table, root.rstrip("/"), Fs(spark, root)
        self.schema = [{"name": ROWID, "type": "i64", "options": {"fast": True, "stored": True}}, *schema]
        self.analyzers = analyzers

    def _log(self) -> list[int]:
        return [int(n[:20]) for n in self.fs.names("_state") if re.fullmatch(r"\d{20}\.json", n)]

    def state(self) -> dict:
        """{snapshot, splits: [{path, snapshot, docs}], dead: [folders]} of the newest commit."""
        log = self._log()
        return json.loads(self.fs.read_many([f"_state/{log[-1]:020d}.json"])[0]) if log else {"snapshot": 0, "splits": [], "dead": []}

    def _publish(self, state: dict) -> None:
        self.fs.mkdirs("_state")
        n = (self._log() or [0])[-1] + 1
        if not self.fs.put_if_absent(f"_state/{n:020d}.json", json.dumps(state)):
            raise CommitConflict("another run published first")

    def run(self) -> int:
        """Index what changed since the watermark; the snapshot indexed. Delete-only ranges move it too."""
        s = self.state()
        target = self.table.version()
        if target <= s["snapshot"]:
            return s["snapshot"]
        folder = f"{self.root}/work-{uuid.uuid4().hex}"
        latest_per_row(self.table.changes(s["snapshot"] + 1, target)).write.parquet(folder)
        last = self.spark.read.parquet(folder)
        dead = f"dead/{uuid.uuid4().hex}"
        # whatever older splits hold of these rows is void from their snapshot on
        last.select(F.col(ROWID), F.col(SNAPSHOT).alias("dead_at")).write.parquet(f"{self.root}/{dead}")
        path = f"{self.root}/splits/{uuid.uuid4().hex}"
        made = index.build(last.filter("change_type <> 'delete'"), path, self.schema, self.analyzers)
        docs = made.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
        splits = s["splits"] + ([{"path": path, "snapshot": target, "docs": docs}] if docs else [])
        self._publish({"snapshot": target, "splits": splits, "dead": [*s["dead"], dead]})
        return target

    def dead(self, state: dict | None = None) -> DataFrame:
        s = state or self.state()
        if not s["dead"]:
            return self.spark.createDataFrame([], f"{ROWID} long, dead_at long")
        return self.spark.read.parquet(*(f"{self.root}/{f}" for f in s["dead"]))

    def search(self, query, options: dict | None = None) -> DataFrame:
        """(rowid, score) at the indexed snapshot: hits that no later event voided, ranked as one."""
        s = self.state()
        ix = Index(self.spark, [x["path"] for x in s["splits"]])
        o = dict(options or {})
        top, offset = o.pop("top_k", None), o.pop("offset", 0)
        if not ix.splits:
            return self.spark.createDataFrame([], f"{ROWID} long, score double")
        built = F.element_at(F.array(*(F.lit(x["snapshot"]) for x in s["splits"])), F.col("_split") + 1)
        h = ix.matches(query, o).join(ix.docs().select("_split", "_doc", F.col(f"f_{ROWID}").alias(ROWID)), ["_split", "_doc"]).withColumn("__built", built)
        newest = self.dead(s).groupBy(ROWID).agg(F.max("dead_at").alias("dead_at"))
        h = h.join(newest, ROWID, "left").filter("dead_at is null or dead_at <= __built").orderBy(F.desc("score"), "_split", "_doc").select(ROWID, "score")
        h = h.offset(offset) if offset else h
        return h.limit(top) if top is not None else h

    def rows(self, query, options: dict | None = None) -> DataFrame:
        """Hits joined with the table as it was at the indexed snapshot."""
        return self.search(query, options).join(self.table.at(self.state()["snapshot"], system=True), ROWID)

    def compact(self) -> int:
        """Merge all splits into one, each without its own voided rows; the documents kept."""
        s = self.state()
        if not s["splits"]:
            return 0
        newest = self.dead(s).groupBy(ROWID).agg(F.max("dead_at").alias("dead_at"))
        cleaned = []
        for x in s["splits"]:
            to = f"{self.root}/splits/{uuid.uuid4().hex}"
            if index.merge(self.spark, [x["path"]], to, ROWID, newest.filter(F.col("dead_at") > x["snapshot"]).select(ROWID)):
                cleaned.append(to)
        path = f"{self.root}/splits/{uuid.uuid4().hex}"
        docs = index.merge(self.spark, cleaned, path) if cleaned else 0
        self._publish({"snapshot": s["snapshot"], "splits": [{"path": path, "snapshot": s["snapshot"], "docs": docs}] if docs else [], "dead": []})
        return docs

    def follow(self, checkpoint: str, continuous: bool = False):
        """A streaming query over the table's log that indexes each batch of commits.

        Without ``continuous`` it takes what is there and ends. The stream only
        wakes the run: the watermark lives in the index, so a replayed batch
        finds nothing left to do.
        """
        stream = self.spark.readStream.schema("value string").option("pathGlobFilter", "*.json").text(f"{self.table.log.root}/_log")
        write = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: self.run() and None)
        return (write.trigger(processingTime="10 seconds") if continuous else write.trigger(availableNow=True)).start()
