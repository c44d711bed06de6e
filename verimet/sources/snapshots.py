"""A partitioned table whose versions change at once.

Data files are only ever added, below a folder of their own for each commit.  A version is a small file that
names the folder of every partition; it is written under a temporary name and then renamed to the next
number, which fails if that number exists.  So a reader sees the old or the new version of all partitions, a
writer that stops on the way leaves the old one readable, and of two writers from the same version one wins.

The rename has to be atomic and must not replace a file, as in HDFS and local file systems; stores
without such a rename need a committer of their own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from verimet.operators.setops import latest_per_key, upsert
from verimet.sources.sinks import write_partitions

_COMMIT = "commit"


class VersionConflict(RuntimeError):
    """Another writer has committed since the version this one started from."""


class Version(NamedTuple):
    """`parts`: folder of each partition below data/, by its name; `by`: the partition columns."""

    number: int
    by: list[str]
    parts: dict[str, str]


def _files(spark: SparkSession, path: str):
    """Hadoop's file context and path class: what Spark itself reaches the store with."""
    hadoop = spark._jvm.org.apache.hadoop
    place = hadoop.fs.Path(path)
    return hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration()), hadoop


def _names(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(name, whether it is a folder) of what lies in a folder; empty if it doesn't exist."""
    context, hadoop = _files(spark, path)
    place = hadoop.fs.Path(path)
    if not context.util().exists(place):
        return []
    return [(s.getPath().getName(), s.isDirectory()) for s in context.util().listStatus(place)]


def _version_file(path: str, number: int) -> str:
    return f"{path}/_versions/{number:020d}"


def current_version(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """The newest version, or the one with a number; None if there is none yet."""
    numbers = sorted(int(name) for name, _ in _names(spark, f"{path}/_versions") if name.isdigit())
    if number is None and not numbers:
        return None
    if number is not None and number not in numbers:
        raise ValueError(f"{path} has no version {number}")
    number = numbers[-1] if number is None else number
    held = json.loads("\n".join(r.value for r in spark.read.option("wholetext", "true").text(_version_file(path, number)).collect()))
    return Version(number, held["by"], held["parts"])


def _commit(spark: SparkSession, path: str, version: Version) -> None:
    """Publish a version, or raise if its number is taken."""
    context, hadoop = _files(spark, path)
    file_system = hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    file_system.mkdirs(hadoop.fs.Path(f"{path}/_versions"))
    draft = hadoop.fs.Path(f"{path}/_versions/_{uuid.uuid4().hex}")
    out = file_system.create(draft, False)
    try:
        out.write(bytearray(json.dumps({"by": version.by, "parts": version.parts}).encode()))
    finally:
        out.close()
    never = spark.sparkContext._gateway.new_array(hadoop.fs.Options.Rename, 1)
    never[0] = getattr(hadoop.fs.Options.Rename, "NONE")
    try:
        context.rename(draft, hadoop.fs.Path(_version_file(path, version.number)), never)
    except Exception as error:
        file_system.delete(draft, False)
        if "FileAlreadyExists" in str(error):
            raise VersionConflict(f"version {version.number} of {path} was committed by another writer") from None
        raise


def _folders(spark: SparkSession, root: str, depth: int, below: str = "") -> list[str]:
    """Names such as fh=1/metvar=tp of the partition folders that lie `depth` levels below `root`."""
    if not depth:
        return [below]
    folders = [name for name, is_folder in _names(spark, f"{root}/{below}") if is_folder and "=" in name]
    return [leaf for name in folders for leaf in _folders(spark, root, depth - 1, f"{below}/{name}".lstrip("/"))]


def read_version(spark: SparkSession, path: str, version: Version | int | None = None) -> DataFrame | None:
    """The rows of a version (the newest by default); None if the table has none.  Only its own folders are listed."""
    held = version if isinstance(version, Version) else current_version(spark, path, version)
    if held is None or not held.parts:
        return None
    data = f"{path}/data"
    return spark.read.option("basePath", data).parquet(*[f"{data}/{folder}" for folder in held.parts.values()]).drop(_COMMIT)


def upsert_version(
    new: DataFrame, path: str, keys: Sequence[str], by: Sequence[str], order: Sequence[str] = (), base: Version | None = None,
) -> Version:
    """Merge rows into the table, the new row wins per key; returns the version that holds them.

    Only partitions the new rows touch are read and written anew.  `base` is the version the caller has looked at, the
    newest one by default.  Raises VersionConflict, and changes nothing, if another writer was faster; a caller may
    then start over.  `by` must be among the keys.
    """
    spark, by = new.sparkSession, list(by)
    if not set(by) <= set(keys):
        raise ValueError(f"partition columns {by} must be among the keys {list(keys)}")
    base = base or current_version(spark, path)
    if base is not None and base.by != by:
        raise ValueError(f"{path} is partitioned by {base.by}")
    old = read_version(spark, path, base) if base else None
    if old is None:
        merged = latest_per_key(new, keys, list(order) or list(keys))
    else:
        types = {f.name: f.dataType for f in new.schema}
        old = old.select(*[old[c].cast(types[c]).alias(c) for c in new.columns])
        merged = upsert(old.join(new.select(*by).distinct(), by, "left_semi"), new, keys, order)
    commit = f"{_COMMIT}={uuid.uuid4().hex}"
    write_partitions(merged, f"{path}/data/{commit}", by)
    written = {part: f"{commit}/{part}" for part in _folders(spark, f"{path}/data/{commit}", len(by))}
    version = Version(base.number + 1 if base else 0, by, {**(base.parts if base else {}), **written})
    _commit(spark, path, version)
    return version
