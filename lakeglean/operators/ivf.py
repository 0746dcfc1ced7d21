"""Vector search: exact neighbours of a query set, and inverted lists by nearest centroid."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeglean.session import ship

#: A query or centroid block that is sent to every executor has at most this many numbers (512 MB would be 2**26).
BLOCK_NUMBERS = 1 << 23
#: Up to so many lists that a block of queries probes are named to the scan.
PROBED_LISTS = 1000


def l2(a, b):
    """Distance of two array columns, in double, without leaving the JVM."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0).cast("double"), lambda s, x: s + x))


def cosine_distance(a, b):
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.lit(1.0) - dot / (norm(a) * norm(b))


def nearest(df: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding", metric=l2) -> DataFrame:
    """(id, distance) of the ``k`` rows nearest to one vector; ties by id."""
    q = F.array(*(F.lit(float(x)) for x in query))
    fits = F.size(vec_col) == len(query)
    return (df.filter(F.col(vec_col).isNotNull() & fits).select(id_col, metric(F.col(vec_col), q).alias("distance"))
            .orderBy("distance", id_col).limit(k))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; a zero vector stays zero, at distance 1 from all."""
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(n == 0, 1, n)


class _Top:
    """mapInArrow function: the best ``k`` of this partition for each query of a block."""

    def __init__(self, sent, k: int, lists: bool, cosine: bool):
        self.sent, self.k, self.lists, self.cosine = sent, k, lists, cosine

    def __call__(self, batches):
        import pyarrow as pa

        ids, q, probes = self.sent.value
        q = _unit(q) if self.cosine else q
        norms = (q * q).sum(1)
        best_d = np.full((len(ids), self.k), np.inf)
        best_i = np.full((len(ids), self.k), np.iinfo(np.int64).max)

        def improve(own, pid, part) -> None:
            """Hold these rows against these queries."""
            mine = q[own]
            if self.cosine:
                d = np.abs(1 - mine @ _unit(part).T)
            else:
                d = np.sqrt(np.maximum(norms[own, None] + (part * part).sum(1)[None] - 2 * mine @ part.T, 0))
            alld = np.concatenate([best_d[own], d], 1)
            alli = np.concatenate([best_i[own], np.broadcast_to(pid, d.shape)], 1)
            order = np.lexsort((alli, alld), axis=1)[:, : self.k]
            best_d[own], best_i[own] = np.take_along_axis(alld, order, 1), np.take_along_axis(alli, order, 1)

        every, asking = np.arange(len(ids)), {}
        for b in batches:
            own, vectors = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            if not len(own):
                continue
            x = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(own), -1)
            for at in range(0, len(own), 4096):
                part, pid = x[at:at + 4096], own[at:at + 4096]
                if not self.lists:
                    improve(every, pid, part)
                    continue
                cluster = b.column(2).to_numpy(zero_copy_only=False)[at:at + 4096]
                for c in np.unique(cluster).tolist():  # a list meets only the queries that probe it
                    if c not in asking:
                        asking[c] = np.flatnonzero((probes == c).any(1))
                    if len(asking[c]):
                        improve(asking[c], pid[cluster == c], part[cluster == c])
        keep = np.isfinite(best_d)
        rows = np.repeat(ids, self.k).reshape(keep.shape)[keep]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(best_i[keep], pa.int64()), pa.array(best_d[keep], pa.float64())], ["query_id", "vec_id", "distance"])


def _blocks(df: DataFrame, extra: list[str] = ()):
    """Query rows in blocks of bounded size, streamed to the driver."""
    rows, size = [], 0
    for r in df.toLocalIterator():
        rows.append(r)
        size += len(r[1])
        if size >= BLOCK_NUMBERS:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def knn(base: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", cluster_col: str | None = None, probes: DataFrame | None = None, cosine: bool = False) -> DataFrame:
    """(query_id, vec_id, distance, rank) of the ``k`` nearest rows for every query.

    A stated set of queries against all rows, a block of queries at a time:
    each partition keeps its best ``k`` for each query, so only those are
    shuffled, and a window ranks them. With ``cluster_col`` and ``probes``
    (query_id, clusters) a row meets only the queries that probe its cluster. The distance is
    Euclidean, or one minus the cosine. Rows and
    queries with a null vector are left out; all vectors need one length.
    """
    spark = base.sparkSession
    ship(spark)
    rows = base.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(vec_col), *([F.col(cluster_col).cast("long")] if cluster_col else []))
    q = queries.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    if probes is not None:
        q = q.join(probes, q["id"] == probes["query_id"]).select("id", "v", "clusters")
    schema, out = "query_id long, vec_id long, distance double", spark.createDataFrame([], "query_id long, vec_id long, distance double")
    for block in _blocks(q):
        ids, vs = np.array([r[0] for r in block], np.int64), np.array([r[1] for r in block], np.float64)
        lists, scanned = (np.array([r[2] for r in block], np.int64), rows) if probes is not None else (None, rows)
        if lists is not None and len(probed := np.unique(lists)) <= PROBED_LISTS:  # lists sorted by cluster are then read in part
            scanned = rows.filter(F.col(cluster_col).isin(probed.tolist()))
        sent = spark.sparkContext.broadcast((ids, vs, lists))
        out = out.unionByName(scanned.mapInArrow(_Top(sent, k, probes is not None, cosine), schema))
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# -- inverted lists ----------------------------------------------------------
def train(df: DataFrame, clusters: int, sample: int = 50_000, iterations: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> np.ndarray:
    """Centroids by k-means on at most ``sample`` rows (those of least id hash), which bounds the driver's work.

    Every row is indexed by :func:`assign`; only the centroids come from the sample.
    """
    rows = df.filter(F.col(vec_col).isNotNull()).select(vec_col).orderBy(F.xxhash64(id_col), id_col).limit(sample).collect()
    if not rows:
        raise ValueError("no vectors to train on")
    return _means(np.array([r[0] for r in rows], np.float64), clusters, iterations)


def _means(x: np.ndarray, clusters: int, iterations: int = 8) -> np.ndarray:
    c = x[: min(clusters, len(x))].copy()
    for _ in range(iterations):
        near = _closest(x, c)
        for j in range(len(c)):
            own = x[near == j]
            if len(own):
                c[j] = own.mean(0)
    return c


def _closest(x: np.ndarray, c: np.ndarray, n: int = 1) -> np.ndarray:
    norms, out = (c * c).sum(1), []
    for at in range(0, len(x), 4096):
        d = norms[None] - 2 * x[at:at + 4096] @ c.T
        out.append(np.argmin(d, 1) if n == 1 else np.argsort(d, 1, kind="stable")[:, :n])
    return np.concatenate(out) if out else np.zeros((0,) if n == 1 else (0, n), np.int64)


class _Assign:
    def __init__(self, sent, n: int):
        self.sent, self.n = sent, n

    def __call__(self, batches):
        import pyarrow as pa

        for b in batches:
            x = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, self.sent.value.shape[1]))
            near = _closest(x, self.sent.value, self.n)
            got = pa.array(near, pa.int64()) if self.n == 1 else pa.array(near.tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), got], ["vec_id", "embedding", "cluster" if self.n == 1 else "clusters"])


def assign(df: DataFrame, centroids: np.ndarray, n: int = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding, cluster), or with ``n`` > 1 the ``n`` nearest ``clusters``; also for rows that come later."""
    spark = df.sparkSession
    ship(spark)
    if centroids.size > BLOCK_NUMBERS:
        raise ValueError("too many centroids to send at once; nest two levels")
    n = min(n, len(centroids))
    sent = spark.sparkContext.broadcast(centroids)
    own = df.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding"))
    if n == 1:
        return own.mapInArrow(_Assign(sent, 1), "vec_id long, embedding array<float>, cluster long")
    return own.mapInArrow(_Assign(sent, n), "vec_id long, embedding array<float>, clusters array<long>")


class TwoLevel:
    """Coarse centroids, each with its own fine ones: a row meets coarse + fine of them instead of coarse * fine."""

    def __init__(self, coarse: np.ndarray, fine: list[np.ndarray]):
        self.coarse, self.fine, self.width = coarse, fine, max(len(f) for f in fine)

    def nearest(self, x: np.ndarray, probes: int = 1, inner: int = 1) -> np.ndarray:
        """(rows, probes * inner) list ids of the nearest fine lists within the nearest coarse ones; -1 where there are fewer."""
        probes = min(probes, len(self.coarse))
        near = _closest(x, self.coarse, probes).reshape(len(x), -1)
        out = np.full((len(x), probes * inner), -1, np.int64)
        for k in range(probes):
            for j in np.unique(near[:, k]):
                at, n = np.flatnonzero(near[:, k] == j), min(inner, len(self.fine[j]))
                out[at, k * inner:k * inner + n] = j * self.width + _closest(x[at], self.fine[j], n).reshape(len(at), -1)
        return out


def train_two_level(df: DataFrame, coarse: int, fine: int, sample: int = 50_000, id_col: str = "vec_id", vec_col: str = "embedding") -> TwoLevel:
    """k-means of the sample, then of each coarse list's part of it; an empty list keeps its coarse centroid."""
    top = train(df, coarse, sample, id_col=id_col, vec_col=vec_col)
    rows = df.filter(F.col(vec_col).isNotNull()).select(vec_col).orderBy(F.xxhash64(id_col), id_col).limit(sample).collect()
    x = np.array([r[0] for r in rows], np.float64)
    near, parts = _closest(x, top), []
    for j in range(len(top)):
        own = x[near == j]
        parts.append(_means(own, fine) if len(own) else top[j:j + 1])
    return TwoLevel(top, parts)


class _AssignTwo:
    def __init__(self, sent, probes: int, inner: int):
        self.sent, self.probes, self.inner = sent, probes, inner

    def __call__(self, batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(b.num_rows, -1)
            lists = self.sent.value.nearest(x, self.probes, self.inner)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists.tolist(), pa.list_(pa.int64()))], ["vec_id", "embedding", "clusters"])


def assign_two_level(df: DataFrame, levels: TwoLevel, probes: int = 1, inner: int = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding, clusters): with one probe the list a row belongs to, with more those a query should look into."""
    spark = df.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(levels)
    own = df.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding"))
    return own.mapInArrow(_AssignTwo(sent, probes, inner), "vec_id long, embedding array<float>, clusters array<long>")


def write_lists(assigned: DataFrame, path: str) -> None:
    """The index as Parquet sorted by cluster with small row groups, so that literal cluster ids prune the scan."""
    assigned.repartitionByRange("cluster").sortWithinPartitions("cluster", "vec_id").write.option("parquet.block.size", 1 << 20).parquet(path)


def probe(spark: SparkSession, path: str, centroids: np.ndarray, query: list[float], k: int, probes: int) -> DataFrame:
    """(vec_id, distance): exact re-rank of the ``probes`` nearest lists. Their ids are literals, so the scan reads only those."""
    lists = [int(i) for i in np.atleast_1d(_closest(np.array([query], np.float64), centroids, max(probes, 1)).reshape(-1))]
    return nearest(spark.read.parquet(path).filter(F.col("cluster").isin(lists)), query, k)


def search(index: DataFrame, queries: DataFrame, centroids: np.ndarray, k: int, probes: int) -> DataFrame:
    """(query_id, vec_id, distance, rank) of a query set over an assigned index."""
    near = assign(queries, centroids, max(probes, 2)).select(F.col("vec_id").alias("query_id"), F.slice("clusters", 1, probes).alias("clusters"))
    return knn(index, queries, k, cluster_col="cluster", probes=near)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(n, hits, recall) of approximate neighbours against exact ones."""
    both = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id").withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return both.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits")).withColumn("recall", F.col("hits") / F.col("n"))
