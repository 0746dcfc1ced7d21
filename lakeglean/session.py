"""Session helpers: table loading and the folder all executors share."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SHARED: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application.

    They may run on machines, or from folders, where it isn't importable.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    from lakeglean.sources.fs import Fs

    root, packed = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    folder, name = scratch(spark, "package"), "lakeglean_package.zip"
    Fs(spark, folder).write_bytes(name, packed.getvalue())
    sc.addPyFile(f"{folder}/{name}")
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables; a file or a directory of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share.

    Only where the setting is absent and everything runs in one JVM (tests) is
    a temporary folder made; on a cluster a missing setting is an error,
    because a machine-local folder would not be seen by the other machines.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (conf.get("spark.master", "") or "").startswith(("local[", "local")) or "cluster" in conf.get("spark.master", ""):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SHARED:
        _LOCAL_SHARED[app] = "file://" + tempfile.mkdtemp(prefix="lakeglean-")
    return _LOCAL_SHARED[app]


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below this application's part of the shared folder."""
    return f"{shared_dir(spark)}/lakeglean-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete what :func:`scratch` named in this application; DataFrames still to be read from there are lost."""
    from lakeglean.sources.fs import Fs

    Fs(spark, shared_dir(spark)).delete(f"lakeglean-{spark.sparkContext.applicationId}")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: cuts the lineage.

    Unlike a local checkpoint this survives the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

