"""The data-preparation operators on small cases: nulls, ties, repeats, empty tables, clashing columns."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lakeglean.operators import changefeed, compaction, incremental, orphans, skew
from lakeglean.session import scratch

T = lambda h: dt.datetime(2025, 1, 1, h)
GENS, DBS, RUNS = "db_id int, gen long, committed_at timestamp_ntz, head string", "db_id int, committed_gen long", "run_id long, db_id int, from_gen long, to_gen long, started_at timestamp_ntz, status string"


def pending(spark, rows, gens, dbs, runs):
    out = incremental.pending_versions(rows(GENS, gens), rows(DBS, dbs), rows(RUNS, runs), scratch(spark, "t"))
    return sorted((r.db_id, r.gen) for r in out.collect())


def test_pending_versions_small(spark, rows):
    gens = [(1, 1, T(1), "x"), (1, 1, T(5), None), (1, 2, T(2), None), (1, 3, None, None), (1, 4, T(4), None), (1, 9, T(1), None), (2, 1, None, None), (None, 1, T(1), None), (3, None, T(1), None)]
    dbs = [(1, 4), (1, None), (1, 2), (2, 1), (3, 5)]
    runs = [(1, 1, 0, 3, T(3), "running"), (1, 1, 0, 3, T(3), " SUCCEEDED "), (2, 1, 3, 4, T(9), "failed"), (3, 2, 0, 1, None, "Succeeded"), (4, None, 0, 9, T(9), "succeeded"), (5, 1, 7, 7, T(9), "succeeded")]
    # gen 1 was delivered again after the run, 4 only failed, 9 isn't published; a null time is covered by any run
    assert pending(spark, rows, gens, dbs, runs) == [(1, 1), (1, 4)]


def test_pending_versions_empty(spark, rows):
    assert pending(spark, rows, [], [], []) == []
    assert pending(spark, rows, [(1, 1, T(1), None)], [(1, 1)], []) == [(1, 1)]


def test_covered_against_brute_force(spark, rows):
    rnd = random.Random(3)
    gens = [(db, g, T(rnd.randrange(20)) if rnd.random() < 0.9 else None) for db in (1, 2) for g in rnd.sample(range(1, 5000), 150)]
    runs = [(rnd.choice((1, 2, 3)), a, a + rnd.choice((1, 2, 15, 16, 17, 300, 4000)), T(rnd.randrange(20)) if rnd.random() < 0.9 else None) for a in (rnd.randrange(5000) for _ in range(25))]
    got = incremental.covered(rows("db_id int, gen long, newest timestamp_ntz", gens), rows("db_id int, from_gen long, to_gen long, started_at timestamp_ntz", runs)).distinct().collect()
    want = {(db, g) for db, g, n in gens if any(d == db and a < g <= b and (n is None or s is not None and s >= n) for d, a, b, s in runs)}
    assert {(r.db_id, r.gen) for r in got} == want


def net(diff):
    return Counter({(r._change, r.k): 1 for r in diff.collect()})


def test_manifest_diff_with_vectors_removal_and_compaction(spark, rows):
    t = incremental.ManifestTable(spark, scratch(spark, "t"))
    t.commit(add=rows("k int", [(1,), (2,), (3,)]))
    t.commit(add=rows("k int", [(4,), (5,)]))
    at = t.read(positions=True)
    t.commit(vector=at.filter("k in (2, 5)").select(incremental.FILE, incremental.POSITION))
    assert net(t.diff(0)) == Counter({("insert", 1): 1, ("insert", 3): 1, ("insert", 4): 1})
    assert net(t.diff(1, 3)) == Counter({("insert", 4): 1, ("delete", 2): 1})
    s = t.snapshot()
    t.commit(add=t.read(), remove=list(s.files), clear=s.vectors, data_change=False)  # compaction
    assert net(t.diff(3)) == Counter()
    assert net(t.diff(2)) == Counter({("delete", 2): 1, ("delete", 5): 1})
    assert sorted(r.k for r in t.read().collect()) == [1, 3, 4]
    t.commit(remove=list(t.snapshot().files))
    assert net(t.diff(4)) == Counter({("delete", 1): 1, ("delete", 3): 1, ("delete", 4): 1})


def test_incremental_runs_are_exactly_once(spark, rows):
    src, out = (incremental.ManifestTable(spark, scratch(spark, "t")) for _ in range(2))
    src.commit(add=rows("k int", [(1,), (2,)]))
    step = lambda d: d.filter("_change = 'insert'").drop("_change")
    assert incremental.run_incremental(src, out, "job", step) == 1
    assert incremental.run_incremental(src, out, "job", step) is None
    src.commit(add=rows("k int", [(3,)]))

    def fails(d):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        incremental.run_incremental(src, out, "job", fails)
    assert incremental.run_incremental(src, out, "job", step) == 2
    assert sorted(r.k for r in out.read().collect()) == [1, 2, 3]
    with pytest.raises(incremental.CommitConflict):
        out.commit(add=rows("k int", [(9,)]), expect=1)


def test_sequence_profile(spark, rows):
    data = [(1, i % 700) for i in range(2000)] + [(2, 0), (2, 5), (2, 5), (3, None), (4, -1), (None, 1), (None, 3)]
    got = {r.file_id: tuple(r)[1:] for r in skew.sequence_profile(rows("file_id long, no int, salt string", [(*x, "clash") for x in data]), share=0.3, salts=4).collect()}
    assert got == {1: (2000, 700, 0, 699, 0), 2: (3, 2, 0, 5, 4), 3: (1, 0, None, None, 0), 4: (1, 1, -1, -1, 0), None: (2, 2, 1, 3, 2)}
    assert skew.sequence_profile(rows("file_id long, no int")).count() == 0
    assert skew.heavy_keys(rows("file_id long", [(1,), (1,), (2,), (None,)]), "file_id", 0.5) == (4, [1])
    with pytest.raises(ValueError):
        skew.heavy_keys(rows("file_id long"), "file_id", 0)


def test_orphans(spark, rows):
    refs = rows("file_id long, n string", [(i % 50, "a") for i in range(200)] + [(None, "b"), (1000, "c"), (1000, "c")])
    parents = rows("file_id long, n int", [(i, 0) for i in range(40)] + [(3, 1), (None, 2)])
    got = Counter((r.file_id, r.n) for r in orphans.orphans(refs, parents).collect())
    assert got == Counter({(i, "a"): 4 for i in range(40, 50)} | {(1000, "c"): 2})
    assert orphans.orphans(refs, rows("file_id long")).count() == 202
    assert orphans.orphans(rows("file_id long"), parents).count() == 0


def test_store_orphans_by_month(spark, rows):
    gens = rows("db_id int, gen long, committed_at timestamp_ntz, changes array<long>", [(1, 1, dt.datetime(2025, 2, 3), [7, 0, 1, 8, 1, 2]), (1, 1, dt.datetime(2025, 3, 3), []), (1, 2, None, None)])
    e = lambda s: rows(s)
    out = orphans.store_orphans(e("file_id long"), e("file_id long"), e("file_id long"), rows("db_id int, gen long, file_id long", [(1, 1, 9), (1, 5, 9), (1, 1, None)]),
                                rows("file_id long", [(None,), (4,)]), gens, rows("file_id long", [(8,)]))
    march = dt.date(2025, 3, 1)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("dbchunks", None, 4, 1), ("dbfiles", march, 9, 1), ("dbfiles", None, 9, 1), ("dbgens", march, 7, 1)], key=str)


FILES = "volume string, path string, file_id long, size long"


def test_small_files_and_plan(spark, rows):
    files = [("v", f"a/é {i}", i, 10) for i in range(6)] + [("v", "a/é 0", 0, 10), ("v", "a/é 0", 50, 20), ("v", "a/gone", 60, 1), ("v", "a/big", 61, 1 << 20), ("v", "a/unknown", 62, None), ("v", "a/minus", 63, -1)]
    files += [("w", f"top{i}", 100 + i, 0) for i in range(4)] + [(None, f"n{i}", 200 + i, 5) for i in range(5)]
    small = compaction.small_files(rows(FILES, files), rows("file_id long", [(60,), (60,), (None,), (999,)]))
    assert sorted(r.file_id for r in small.collect()) == [1, 2, 3, 4, 5, 50, 200, 201, 202, 203, 204]
    plan = compaction.plan_merges(small, target=30).collect()
    outs = defaultdict(list)
    for r in plan:
        outs[r.volume, r.output].append(r)
    for own in outs.values():
        assert len({(r.volume, r.dir) for r in own}) == 1 and sum(r.size for r in own) <= 30
        at = 0
        for r in sorted(own, key=lambda r: (r.first_byte, r.size)):
            assert r.first_byte == at
            at += r.size
    assert compaction.plan_merges(compaction.small_files(rows(FILES), rows("file_id long"))).count() == 0


def test_compact_files(spark, rows):
    src, out = scratch(spark, "t"), scratch(spark, "t")
    df = rows("k int, s string", [(i % 7, None if i % 5 == 0 else str(i)) for i in range(100)] + [(1, "x")] * 3)
    df.repartition(20).write.parquet(src)
    assert compaction.compact(spark, src, out)["files_after"] < 20
    assert compaction.multiset_checksum(spark.read.parquet(out)) == compaction.multiset_checksum(df)
    assert compaction.multiset_checksum(df) != compaction.multiset_checksum(df.dropDuplicates())
    with pytest.raises(FileExistsError):
        compaction.compact(spark, src, out)


FEED = "db_id int, path string, gen long, file_id long, size long, head string"


def live(spark, rows, feed, dbs, **kw):
    out = changefeed.committed_files(rows(FEED, [(*f, "clash") for f in feed]), rows(DBS, dbs), **kw)
    return sorted((tuple(r)[:4] for r in out.collect()), key=str)


def test_change_feed(spark, rows):
    feed = [(1, "", 1, 10, 1), (1, "", 1, 10, 1), (1, "", 3, 11, None), (1, "", 9, 12, 1), (1, "a", 2, 20, 1), (1, "a", 3, None, None), (1, "b", 2, None, None), (1, "b", 2, 30, 1), (2, "", 1, 40, 1), (3, "", 1, 50, 1), (1, None, 1, 60, 1)]
    want = sorted([(1, "", 3, 11), (1, "b", 2, 30), (1, None, 1, 60), (2, "", 1, 40)], key=str)
    for n in (1, 2, 3):
        assert live(spark, rows, feed, [(1, 3), (1, 1), (2, 1), (2, None), (3, None)], batches=n) == want
    assert live(spark, rows, [], [(1, 1)]) == [] and live(spark, rows, feed, []) == []


def test_change_feed_random_with_base(spark, rows):
    rnd = random.Random(5)
    feed = [(rnd.randrange(30), rnd.randrange(100), None if rnd.random() < 0.3 else rnd.randrange(1000)) for _ in range(300)]
    base = [(k, 0, k) for k in range(20, 60)]
    got = changefeed.resolve(rows("k int, g long, v long", feed), ["k"], "g", ["v"], base=rows("k int, g long, v long", base), tombstone=F.col("v").isNull(), batches=4)
    state = {k: (g, v) for k, g, v in base}
    for k, g, v in sorted(feed, key=lambda x: (x[1], -1 if x[2] is None else x[2])):
        state[k] = (g, v)
    assert sorted(map(tuple, got.collect())) == sorted((k, g, v) for k, (g, v) in state.items() if v is not None)


def test_change_feed_older_than_base(spark, rows):
    base = rows("k int, g long, v long", [(1, 5, 10), (2, 5, 20), (3, None, 30), (None, 5, 40)])
    feed = rows("k int, g long, v long, note string", [(1, 3, 11, "late"), (2, 5, 21, ""), (3, 1, None, ""), (None, None, 41, "late"), (4, None, 44, "")])
    got = changefeed.resolve(feed, ["k"], "g", ["v"], base=base, tombstone=F.col("v").isNull())
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 5, 10), (2, 5, 21), (None, 5, 40), (4, None, 44)], key=str)
    assert changefeed.resolve(rows("k int, g long, v long"), ["k"], "g", ["v"], base=base).count() == 4


def test_salt_splits_a_key_with_one_number(spark, rows):
    """All rows of a heavy key have the same number: only the salt can spread them."""
    data = rows("file_id long, no int", [(1, 7)] * 4000 + [(i, 0) for i in range(2, 200)])
    total, heavy = skew.heavy_keys(data, "file_id")
    assert (total, heavy) == (4198, [1])
    parts = [r.n for r in skew.partials(data, heavy, 8).filter("file_id = 1").collect()]
    assert len(parts) == 8 and sum(parts) == 4000 and max(parts) < 4000 / 4
    assert len(skew.partials(data, [], 8).filter("file_id = 1").collect()) == 1
    assert {r.file_id: r.n_rows for r in skew.sequence_profile(data).filter("file_id < 3").collect()} == {1: 4000, 2: 1}


def test_pending_in_any_order_of_arrival_and_after_a_crash(spark, rows, monkeypatch):
    rnd = random.Random(11)
    gens = [(db, g, T(rnd.randrange(20)) if rnd.random() < 0.9 else None) for db in (1, 2) for g in rnd.choices(range(1, 60), k=120)]
    runs = [(rnd.choice((1, 2)), a, a + rnd.choice((1, 3, 17)), T(rnd.randrange(20)) if rnd.random() < 0.9 else None) for a in (rnd.randrange(60) for _ in range(30))]
    log = incremental.PendingVersions(spark, scratch(spark, "t"))
    for n in range(3):
        log.gens.commit(add=rows("db_id int, gen long, committed_at timestamp_ntz", gens[n::3]))
        log.runs.commit(add=rows("db_id int, from_gen long, to_gen long, started_at timestamp_ntz", runs[n::3]))
        if n == 1:  # dies between writing and committing
            with monkeypatch.context() as m:
                m.setattr(incremental.ManifestTable, "commit", lambda *a, **k: 1 / 0)
                with pytest.raises(ZeroDivisionError):
                    log.run()
        assert log.run() == {"gens": n + 1, "runs": n + 1} and log.run() is None
    newest = {}
    for db, g, at in gens:
        newest[db, g] = max((x for x in (newest.get((db, g)), at) if x is not None), default=None)
    want = {(k, at) for k, at in newest.items() if not any(d == k[0] and a < k[1] <= b and (at is None or s is not None and s >= at) for d, a, b, s in runs)}
    assert {((r.db_id, r.gen), r.newest) for r in log.pending.read().collect()} == want
    read = [log.pending.manifest(v)["files_read"]["pending/gens"] for v in (1, 2, 3)]
    assert read == [len(log.gens.manifest(v)["add"]) for v in (1, 2, 3)]


def test_diff_reads_only_touched_files(spark, rows):
    t = incremental.ManifestTable(spark, scratch(spark, "t"))
    for i in range(3):
        t.commit(add=rows("k int", [(10 * i + j,) for j in range(4)]).coalesce(1))
    before = t.snapshot()
    t.commit(vector=t.read(positions=True).filter("k = 11").select(incremental.FILE, incremental.POSITION))
    v = list(t.snapshot().vectors.values())
    assert v[0]["rows"] == 1 and len(v[0]["files"]) == 1 and t.changed_files(3) == v[0]["files"]
    assert {p.rsplit("/data/", 1)[1] for p in t.diff(3).inputFiles() if "/data/" in p} == set(v[0]["files"])
    assert net(t.diff(3)) == Counter({("delete", 11): 1}) and t.read().count() == 11
    assert t.deleted(before, v).select("k").collect()[0].k == 11
