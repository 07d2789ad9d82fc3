"""Reading input tables and cutting lineage safely."""

from __future__ import annotations

import atexit
import hashlib
import json
import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_OWN: list[tuple[SparkSession, str]] = []


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a warehouse folder, one Parquet file or folder per table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the one named in ``spark.checkpoint.dir``, or else the session's checkpoint directory.

    Only in local mode, as in tests on one machine, a temporary folder is made and put into the session's settings where both are unset. On a
    cluster that would give wrong results, so it is an error there.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        at = "file://" + tempfile.mkdtemp(prefix="codestrata-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Unlike a plain ``cache``, the written table survives the loss of executors, cuts the plan's
    lineage and gives the optimizer true sizes for the joins that follow. Tables written by this
    process are removed when it ends, or by :func:`release` before.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/codestrata/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _OWN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def cached(spark: SparkSession, folder: str, key: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` makes, kept in a folder under a key, such as a head commit, a window and a revision. A key seen before is read; a table half written is made again."""
    name = hashlib.sha256(json.dumps(key, sort_keys=True, default=str).encode()).hexdigest()[:24]
    path = f"{folder.rstrip('/')}/{name}.parquet"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def release(spark: SparkSession | None = None) -> None:
    """Remove the tables written so far, of one session or of all; for long sessions, once the results that read them are done with."""
    kept = []
    for own, path in _OWN:
        if spark is not None and own is not spark:
            kept.append((own, path))
            continue
        try:
            jvm = own.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(own.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may be gone before this
            local = path.removeprefix("file://")
            if local.startswith("/") and os.path.isdir(local):
                import shutil

                shutil.rmtree(local, ignore_errors=True)
    _OWN[:] = kept


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Give CPU-heavy per-row work enough partitions.

    A table in few splits would leave most cores idle; it is then dealt out round-robin. Inputs that
    already have several splits per core, which is every large one, are left as they are.
    """
    want = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


atexit.register(release)
