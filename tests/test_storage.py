"""Volumes, versioned tables and databases, incremental indexing, vectors."""

import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeglean.operators import ivf
from lakeglean.operators.compaction import ChecksumMismatch
from lakeglean.session import scratch
from lakeglean.sources.database import Database, Fenced
from lakeglean.sources.lake import ConstraintError, LakeTable, VersionExpired
from lakeglean.sources.volume import PublishConflict, VolumeError, VolumeStore, glob_regex, prefix_end
from lakeglean.streaming.incremental_index import IncrementalIndex


@pytest.fixture
def store(spark):
    return VolumeStore(spark, scratch(spark, "v"))


def test_publish_read_replace(store):
    store.publish("v1", "a/x", b"0123456789")
    assert store.read("v1", "a/x", 2, 3) == b"234" and store.read("v1", "a/x", 10) == b"" and store.stat("v1", "a/x").size == 10
    with pytest.raises(VolumeError):
        store.read("v1", "a/x", 8, 3)
    first = store.stat("v1", "a/x").file_id
    store.publish("v1", "a/x", b"")
    assert store.read("v1", "a/x") == b"" and store.stat("v1", "a/x").file_id != first
    with pytest.raises(RuntimeError), store.writer("v1", "a/y") as out:
        out.write(b"1")
        raise RuntimeError
    assert not store.exists("v1", "a/y")
    for volume, path in (("V", "a"), ("", "a"), ("v1", ""), ("v1", "x" * 1025), ("v1", "a\0b"), ("-v", "a")):
        with pytest.raises(VolumeError):
            store.publish(volume, path, b"")


def test_listing_glob_rename_drop_vacuum(store):
    for p in ("a/é", "a/b/c.txt", "a/b/d.bin", "a/z", "b", "a"):
        store.publish("v", p, p.encode())
    assert [e.path for e in store.list("v", "a/")] == ["a/b/c.txt", "a/b/d.bin", "a/z", "a/é"] and len(store.list("v", "a/", 2)) == 2
    assert store.list_directory("v", "a") == ["b/", "z", "é"] and store.list_directory("v") == ["a", "a/", "b"]
    assert store.glob("v", "a/*") == ["a/z", "a/é"] and store.glob("v", "a/**/*.txt") == ["a/b/c.txt"] and store.glob("v", "a/b/[cd].*") == ["a/b/c.txt", "a/b/d.bin"] and store.glob("v", "a/b/[!c].*") == ["a/b/d.bin"]
    store.rename("v", "b", "a/z")
    assert store.read("v", "a/z") == b"b" and not store.exists("v", "b")
    with pytest.raises(FileNotFoundError):
        store.remove("v", "b")
    assert store.try_remove("v", "b") is False and store.remove_directory("v", "a/b") == 2
    assert store.vacuum("v") == 0 and store.vacuum("v", grace=0, max_files=1) == 1 and store.vacuum("v", grace=0) == 2 and store.vacuum("v", grace=0) == 0
    assert store.drop_volume("v") == 3 and store.drop_volume("v") == 0 and store.drop_volume(None) is None
    assert '"publishes": 6' in store.stats()
    assert glob_regex("a?c").fullmatch("a/c") is None
    assert prefix_end("ab") == "ac" and prefix_end("a\U0010ffff") == "b" and prefix_end("퟿") == "" and prefix_end("") is None


def test_publish_race_and_checkpoint(store):
    with pytest.raises(PublishConflict), store.writer("v", "same") as out:
        out.write(b"slow")
        store.publish("v", "same", b"fast")
    assert store.read("v", "same") == b"fast"
    ts = [threading.Thread(target=lambda i=i: [store.publish("v", f"{i}/{j}", b"x") for j in range(26)]) for i in range(4)]
    [t.start() for t in ts], [t.join() for t in ts]
    assert len(store.list("v")) == 105
    reader = VolumeStore(store.spark, store.root, read_only=True)
    assert len(reader.list("v")) == 105
    with pytest.raises(VolumeError):
        reader.publish("v", "n", b"")


def test_lake_against_a_model(spark):
    """Random writes; every version must read as the model had it, also after maintenance."""
    rnd, t, model, states = random.Random(42), LakeTable(spark, scratch(spark, "t")), {}, {}
    t.create(spark.createDataFrame([(i, i) for i in range(20)], "k int, v int"), sorted_by=["k"], not_null=["k"])
    model = {i: i for i in range(20)}
    states[1] = dict(model)
    for step in range(7):
        op, m = rnd.choice(("insert", "update", "delete", "compact", "rewrite")), rnd.randrange(2, 6)
        if op == "insert":
            new = {100 * (step + 1) + i: i for i in range(m)}
            v = t.insert(spark.createDataFrame(list(new.items()), "k int, v int"))
            model |= new
        elif op == "update":
            v = t.update(f"k % {m} = 0", {"v": F.col("v") + 1000})
            model = {k: x + 1000 if k % m == 0 else x for k, x in model.items()}
        elif op == "delete":
            v = t.delete(f"k % {m} = 1")
            model = {k: x for k, x in model.items() if k % m != 1}
        else:
            v = getattr(t, op)()
        states[v] = dict(model)
    for v, want in states.items():
        assert dict(map(tuple, t.at(v).collect())) == want
    ids = [r.rowid for r in t.at(system=True).collect()]
    assert len(set(ids)) == len(ids)
    ch = t.changes(2)
    state = dict(states[1])
    for r in sorted(ch.collect(), key=lambda r: (r.snapshot_id, r.change_type in ("insert", "update_postimage"))):
        if r.change_type in ("insert", "update_postimage"):
            state[r.k] = r.v
        else:
            assert state.pop(r.k) == r.v
    assert state == model
    with pytest.raises(ConstraintError):
        t.insert(spark.createDataFrame([(None, 1)], "k int, v int"))
    last = t.compact()
    t.expire(last)
    assert t.cleanup(0) >= 0 and dict(map(tuple, t.at().collect())) == model
    with pytest.raises(VersionExpired):
        t.at(1)


def test_lake_empty_and_same_rows(spark):
    t = LakeTable(spark, scratch(spark, "t"))
    t.create(spark.createDataFrame([], "k int, v int"))
    assert t.at().count() == 0 and t.delete("k = 1") == 1 and t.changes(1).count() == 0
    t.insert(spark.createDataFrame([(1, 1)] * 3, "k int, v int"))
    assert t.at().count() == 3 and t.update("v is null", {"v": F.lit(1)}) == 2 and t.snapshots().count() == 2


def test_failed_maintenance_publishes_nothing(spark, monkeypatch):
    t = LakeTable(spark, scratch(spark, "t"))
    t.create(spark.createDataFrame([(i,) for i in range(40)], "k int"))
    t.delete("k % 2 = 0")
    write = t.log.write_files
    for name in ("compact", "rewrite"):
        monkeypatch.setattr(t.log, "write_files", lambda df, o=None: write(df.filter("k <> 5"), o))
        with pytest.raises(ChecksumMismatch):
            getattr(t, name)()
        assert t.version() == 2 and t.at().count() == 20
        monkeypatch.undo()
    assert t.rewrite() == 3 and t.compact() == 4 and t.at().count() == 20 and not t.log.snapshot().vectors


def test_database(spark):
    db = Database(spark, scratch(spark, "d"))
    w = db.writer()
    w.create("c", spark.createDataFrame([(1, "x")], "id long, name string"), primary_key=["id"])
    w.create("o", spark.createDataFrame([(1, 1, 5.0)], "id long, c long, amount double"), foreign_keys=[(["c"], "c", ["id"])], checks=["amount >= 0"])
    assert db.gen() == 0 and w.table("c").count() == 1
    assert w.commit() == 1 and w.commit() == 1
    pinned = db.at()
    follower = db.follow(prefix="f_")
    for bad in ([(2, 9, 1.0)], [(2, 1, -1.0)]):
        w.append("o", spark.createDataFrame(bad, "id long, c long, amount double"))
        with pytest.raises(ConstraintError):
            w.commit()
        w.rollback()
    w.append("c", spark.createDataFrame([(1, "again")], "id long, name string"))
    with pytest.raises(ConstraintError):
        w.commit()
    w.rollback()
    w.append("o", spark.createDataFrame([(2, 1, 7.0), (3, None, 0.0)], "id long, c long, amount double"))
    assert w.next_value("s", 5) == 1 and w.next_value("s") == 6
    w.view("big", "select * from f_o where amount > 6")
    assert w.commit() == 2
    assert pinned.table("o").count() == 1 and db.at(2).table("o").count() == 3 and spark.table("f_o").count() == 1
    assert follower.refresh() and not follower.refresh() and spark.table("f_big").count() == 1
    other = db.writer()
    w.drop("o")
    with pytest.raises(Fenced):
        w.commit()
    other.rename("o", "orders")
    other.replace("orders", spark.createDataFrame([], "id long, c long, amount double"))
    assert other.commit() == 3 and db.at().table("orders").count() == 0
    assert db.reap(3, grace=0) >= 1 and db.at().table("c").count() == 1
    with pytest.raises(VersionExpired):
        db.at(1)
    with pytest.raises(ValueError):
        db.at(9)


def test_incremental_index(spark):
    t = LakeTable(spark, scratch(spark, "t"))
    t.create(spark.createDataFrame([(i, f"word{i} common") for i in range(6)], "id long, body string"))
    ix = IncrementalIndex(spark, t, scratch(spark, "i"), [{"name": "id", "type": "i64", "options": {"fast": True}}, {"name": "body", "type": "text"}])
    ids = lambda q, **o: sorted(r.id for r in ix.rows(q, o).collect())
    assert ix.run() == 1 and ix.run() == 1 and ids("common") == list(range(6))
    t.update("id = 2", {"body": F.lit("changed common")})
    t.insert(spark.createDataFrame([(9, "common brief")], "id long, body string"))
    t.delete("id in (3, 9)")
    assert ids("common") == list(range(6))  # coherent with the indexed snapshot
    ix.run()
    assert ids("common") == [0, 1, 2, 4, 5] and ids("word2") == [] and ids("changed") == [2]
    t.delete("id = 0")
    assert ix.run() == 5 and ids("word0") == [] and len(ids("common", top_k=2)) == 2
    assert ix.compact() == 4 and ids("common") == [1, 2, 4, 5]


def test_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4)).astype("float32")
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(99, None)], "vec_id long, embedding array<float>").repartition(3)
    got = ivf.knn(df, df.filter("vec_id % 20 = 0"), 5)
    for q in (0, 20, 40):
        d = np.sqrt(((x.astype("float64") - x[q]) ** 2).sum(1))
        assert [r.vec_id for r in got.filter(F.col("query_id") == q).orderBy("rank").collect()] == list(np.lexsort((np.arange(60), d))[:5])
    assert [r.vec_id for r in ivf.nearest(df, [float(v) for v in x[3]], 3).collect()][0] == 3
    c = ivf.train(df, 6)
    idx = ivf.assign(df, c)
    assert idx.count() == 60 and ivf.recall(ivf.search(idx, df.filter("vec_id % 20 = 0"), c, 5, 6), got).first()["recall"] == 1.0
    assert ivf.knn(df.limit(0), df, 3).count() == 0 and ivf.knn(df, df.limit(0), 3).count() == 0


def test_manifest_checkpoints(spark, monkeypatch):
    from lakeglean.operators import incremental

    monkeypatch.setattr(incremental, "CHECKPOINT_EVERY", 3)
    t = LakeTable(spark, scratch(spark, "t"))
    t.create(spark.createDataFrame([(0, 0)], "k int, v int"))
    for i in range(1, 5):
        t.insert(spark.createDataFrame([(i,)], "k int"))
    assert t.log._saved() == [3] and sorted(r.k for r in t.at().collect()) == list(range(5)) and t.at(2).count() == 2 and t.at(4).count() == 4
    assert t.log.diff(4).count() == 1 and t.log.diff(1, 5).count() == 4 and t.changes(5).count() == 1
    with pytest.raises(ValueError):
        t.insert(spark.createDataFrame([(1, 2)], "k int, zz int"))


def test_two_level_lists(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 3)).astype("float32")
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    levels = ivf.train_two_level(df, 4, 3)
    idx = ivf.assign_two_level(df, levels).select("vec_id", "embedding", F.get("clusters", F.lit(0)).alias("cluster"))
    q = df.filter("vec_id % 20 = 0")
    near = ivf.assign_two_level(q, levels, probes=4, inner=3).select(F.col("vec_id").alias("query_id"), "clusters")
    found = ivf.knn(idx, q, 5, cluster_col="cluster", probes=near)
    assert idx.filter("cluster < 0").count() == 0 and ivf.recall(found, ivf.knn(df, q, 5)).first()["recall"] == 1.0  # all lists probed


def test_curves(spark):
    from lakeglean.functions.curves import hilbert_index, scaled, zorder_key

    side = np.arange(16)
    xs, ys = np.repeat(side, 16), np.tile(side, 16)
    d = hilbert_index(xs, ys, 4)
    assert sorted(d) == list(range(256))
    walk = np.argsort(d)
    assert (np.abs(np.diff(xs[walk])) + np.abs(np.diff(ys[walk])) == 1).all()  # neighbours along the curve are neighbours
    r = spark.createDataFrame([(3, 1), (0, 2)], "x int, y int").select(zorder_key(F.col("x"), F.col("y")).alias("k"), scaled(F.col("x"), 0, 2).alias("s")).collect()
    assert [tuple(v) for v in r] == [(0b0111, 65535), (0b1000, 0)]
