"""File operations through Hadoop's FileSystem API, so any store Spark reads works."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Fs:
    """Small wrapper over ``org.apache.hadoop.fs.FileSystem``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self.path("").getFileSystem(self._conf)
        self.local = self._fs.getUri().getScheme() == "file"
        self._base = self.path("").toUri().getPath() if self.local else ""

    def path(self, rel: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{rel}" if rel else self.root)

    def _os(self, rel: str) -> str:
        return f"{self._base}/{rel}" if rel else self._base

    def exists(self, rel: str = "") -> bool:
        if self.local:
            return os.path.exists(self._os(rel))
        return self._fs.exists(self.path(rel))

    def mkdirs(self, rel: str = "") -> None:
        if self.local:
            return os.makedirs(self._os(rel), exist_ok=True)
        self._fs.mkdirs(self.path(rel))

    def delete(self, rel: str) -> bool:
        return self._fs.delete(self.path(rel), True)

    def rename(self, a: str, b: str) -> bool:
        return self._fs.rename(self.path(a), self.path(b))

    def names(self, rel: str = "") -> list[str]:
        """Names in one directory, in byte order; empty if it is absent."""
        if self.local:
            try:
                return sorted(os.listdir(self._os(rel)), key=lambda n: n.encode())
            except FileNotFoundError:
                return []
        if not self.exists(rel):
            return []
        return sorted((s.getPath().getName() for s in self._fs.listStatus(self.path(rel))), key=lambda n: n.encode())

    def files(self, rel: str = "") -> list[tuple[str, int, int]]:
        """(path below root, size, modified ms) of every file below ``rel``."""
        if self.local:
            base, out = self._os(""), []
            for folder, _, own in os.walk(self._os(rel)):
                for p in (f"{folder}/{n}" for n in own):
                    s = os.stat(p)
                    out.append((os.path.relpath(p, base), s.st_size, s.st_mtime_ns // 1_000_000))
            return sorted(out, key=lambda x: x[0].encode())
        if not self.exists(rel):
            return []
        base, out = self.path("").toUri().getPath().rstrip("/") + "/", []
        it = self._fs.listFiles(self.path(rel), True)
        while it.hasNext():
            s = it.next()
            out.append((s.getPath().toUri().getPath()[len(base):], s.getLen(), s.getModificationTime()))
        return sorted(out, key=lambda x: x[0].encode())

    def data_files(self, rel: str) -> list[tuple[str, int]]:
        """The Parquet files that Spark left below ``rel``."""
        return [(p, n) for p, n, _ in self.files(rel) if p.endswith(".parquet") and not p.rsplit("/", 1)[-1].startswith(("_", "."))]

    def read(self, rel: str) -> str:
        stream = self._fs.open(self.path(rel))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def read_many(self, rels: list[str]) -> list[str]:
        if self.local:
            return [open(self._os(r), encoding="utf-8").read() for r in rels]
        return [self.read(r) for r in rels]

    def write_bytes(self, rel: str, data: bytes, overwrite: bool = False) -> None:
        if self.local:
            os.makedirs(os.path.dirname(self._os(rel)), exist_ok=True)
            with open(self._os(rel), "wb" if overwrite else "xb") as f:
                f.write(data)
            return
        out = self._fs.create(self.path(rel), overwrite)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def create(self, rel: str):
        """A new file open for writing; it must not exist."""
        if self.local:
            os.makedirs(os.path.dirname(self._os(rel)), exist_ok=True)
            return open(self._os(rel), "xb")
        out = self._fs.create(self.path(rel), False)

        class Stream:
            @staticmethod
            def write(data: bytes) -> None:
                out.write(bytearray(data))

            close = staticmethod(out.close)

        return Stream

    def put_if_absent(self, rel: str, text: str) -> bool:
        """Create ``rel`` with this content, whole or not at all; False if it is there.

        Local files use a hard link, which fails when the name exists; other
        stores use rename onto an absent name (atomic on HDFS; object stores
        need a committer with conditional puts).
        """
        tmp = f"{rel}.{uuid.uuid4().hex}.tmp"
        self.write_bytes(tmp, text.encode())
        if self.local:
            try:
                os.link(self._os(tmp), self._os(rel))
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(self._os(tmp))
        if self.exists(rel) or not self.rename(tmp, rel):
            self.delete(tmp)
            return False
        return True
