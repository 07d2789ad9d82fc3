"""Source trees from folders and archives, as tables of files and their bytes."""

from __future__ import annotations

import io
import tarfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from codestrata.operators.files import BINARY_EXT, is_skipped, module_of


def read_tree(spark: SparkSession, root: str, include_build: bool = False) -> DataFrame:
    """(path, ext, size, module, sha, content, is_source) of the files below ``root``, folders that scans leave out excepted."""
    base = root.rstrip("/") + "/"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    at = F.instr("path", base)
    path = F.substring(F.col("path"), at + len(base), F.lit(1 << 30))
    return (rows.select(path.alias("path"), F.col("length").alias("size"), "content").where(~is_skipped(F.col("path"), include_build))
            .select("path", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("ext"), "size", module_of(F.col("path")).alias("module"), F.sha2("content", 256).alias("sha"), "content")
            .withColumn("is_source", ~F.col("ext").isin(*BINARY_EXT)))


def _inside(target: Path, name: str) -> None:
    if name.startswith(("/", "\\")) or ".." in Path(name.replace("\\", "/")).parts or not (target / name).resolve().is_relative_to(target):
        raise ValueError(f"archive member outside the target: {name}")


def _only_folder(target: Path) -> str:
    inside = [p for p in target.iterdir() if not p.name.startswith("__MACOSX")]
    return str(inside[0] if len(inside) == 1 and inside[0].is_dir() else target)


def untar(data: bytes, to: str) -> str:
    """Unpack a package's tarball, compressed or not, as :func:`unzip` does an archive. Links and devices are refused as well."""
    target = Path(to).resolve()
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        for m in t.getmembers():
            _inside(target, m.name)
            if not (m.isfile() or m.isdir()):
                raise ValueError(f"archive member is no file or folder: {m.name}")
        t.extractall(target, filter="data")
    return _only_folder(target)


def unzip(data: bytes, to: str) -> str:
    """Unpack an archive and give the folder that holds its tree, the only folder at its top if there is just one.

    Members that would land outside are refused.
    """
    target = Path(to).resolve()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in z.namelist():
            _inside(target, name)
        z.extractall(target)
    return _only_folder(target)
