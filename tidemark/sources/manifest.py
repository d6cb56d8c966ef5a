"""Which files of a partitioned table count: a small list, replaced by one rename.

Files are only ever added to the table's folder; ``_manifest/<number>.json`` names those that
make up a version. A reader takes the highest number and reads the files it names, so it sees
a version whole or not at all, whatever a writer is doing, and a run that was cut off leaves
nothing but files nobody names. There is one writer at a time; a second one that publishes the
same number is refused. What no kept version names is deleted by ``sweep``, not by writers.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import SparkSession

#: Versions whose files a sweep keeps, so that readers of the last one can finish.
KEPT_VERSIONS = 2


@dataclass(frozen=True)
class Version:
    number: int
    files: tuple[str, ...]


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return hadoop, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _found(spark: SparkSession, root: str, pattern: str) -> list[str]:
    """Paths under ``root`` that match, relative to it."""
    hadoop, files = _fs(spark, root)
    base = hadoop.Path(root).makeQualified(files.getUri(), files.getWorkingDirectory()).toString().rstrip("/") + "/"
    return sorted(s.getPath().toString().removeprefix(base) for s in files.globStatus(hadoop.Path(f"{root}/{pattern}")) or [])


def stored_files(spark: SparkSession, root: str, partitions: Iterable[str]) -> set[str]:
    """The data files that lie under ``root``, named by a version or not."""
    return set(_found(spark, root, "/".join([*(f"{p}=*" for p in partitions), "part-*"])))


def current(spark: SparkSession, root: str) -> Version | None:
    """The last published version, or None where none has been published."""
    names = _found(spark, root, "_manifest/*.json")
    return _read(spark, root, names[-1]) if names else None


def _read(spark: SparkSession, root: str, name: str) -> Version:
    hadoop, files = _fs(spark, root)
    stream = files.open(hadoop.Path(f"{root}/{name}"))
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Version(int(name.rpartition("/")[2].removesuffix(".json")), tuple(json.loads(text)["files"]))


def publish(spark: SparkSession, root: str, files: Iterable[str], after: Version | None) -> Version:
    """Makes ``files`` the version that follows ``after``, by one rename."""
    hadoop, system = _fs(spark, root)
    version = Version(after.number + 1 if after else 0, tuple(sorted(files)))
    final = hadoop.Path(f"{root}/_manifest/{version.number:010d}.json")
    draft = hadoop.Path(f"{root}/_manifest/.{version.number:010d}-{spark.sparkContext.applicationId}")
    out = system.create(draft, True)
    out.write(json.dumps({"files": version.files}).encode())
    out.close()
    if system.exists(final) or not system.rename(draft, final):
        system.delete(draft, False)
        raise RuntimeError(f"version {version.number} of {root} has been published by someone else")
    return version


def sweep(spark: SparkSession, root: str, partitions: Iterable[str]) -> list[str]:
    """Deletes data files that none of the last versions names; run it while nothing writes. Returns what went."""
    names = _found(spark, root, "_manifest/*.json")[-KEPT_VERSIONS:]
    named = {f for n in names for f in _read(spark, root, n).files}
    gone = sorted(stored_files(spark, root, partitions) - named) if names else []
    hadoop, files = _fs(spark, root)
    for file in gone:
        files.delete(hadoop.Path(f"{root}/{file}"), False)
    return gone
